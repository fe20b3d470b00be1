"""The pipeline on a small table against a plain walk through its stages."""

import corpus_pipeline
from nomen.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    out, kept = docs, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, out, SF_SMALL), "test")
        rows = out.collect()
        assert out.columns == columns and rows, name
        ids = {r.doc_id for r in rows}
        assert ids <= kept and all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in rows)
        if name != "mixing":
            assert len(ids) == len(rows) and all(r.text == texts[r.doc_id] for r in rows)
        if name == "exact_dedup":
            assert len({"".join(r.text.split()) for r in rows}) == len(rows) == len({"".join(texts[i].split()) for i in kept})
        kept = ids
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF_SMALL)
    assert last.count() == len(rows) == corpus_pipeline.run(spark, SF_SMALL).count()


CLASHES = ["id", "row", "_row", "key", "n", "fp", "score", "kept", "keep_id", "component_id", "shard", "_shard", "place", "_place", "_taken", "copies", "pass", "_", "slot", "a.b"]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, a long text and extra columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    prose = ["the river runs past the old stone mill and on to the sea", "a quiet morning in the hills above the harbour town"]
    given = [(1, prose[0], "en", "a"), (2, prose[0] + " ", "en", "b"), (3, None, None, None), (4, "", None, "a"), (5, prose[1], "en", None),
             (None, prose[1] + " again", None, "b"), (None, None, None, None), (7, " \n", "x", "b"), (8, "word " * 30000, "en", "a"), (1, prose[0], "en", "a")]
    rows = [(*r, len(r[1] or ""), *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(given)]
    docs = spark.createDataFrame(rows, schema)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, out, SF_SMALL), "test")
        got = out.collect()
        assert out.columns == docs.columns and got, name
        # every row is one of the given ones: its extra columns all come from that row
        for r in got:
            i = int(r["id"][2:])
            assert [r[c] for c in CLASHES] == [f"{c}{i}" for c in CLASHES] and r.doc_id == given[i][0] and r.source == given[i][3]
            assert (given[i][1] or "").startswith(r.text or "")
        if name == "toxicity":
            assert len(got) == len(rows)
        if name == "exact_dedup":
            assert sorted("".join((r.text or "").split()) for r in got) == sorted({"".join((t or "").split()) for _, t, *_ in given})
            assert 2 in {r.doc_id for r in got} and 1 not in {r.doc_id for r in got}        # most code points
        if name == "mixing":
            assert all(r.n_chars == len(r.text) for r in got)
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF_SMALL)
    assert last.count() == len(got)


def test_stages_on_an_empty_table(spark):
    out = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, SF_SMALL), "test")
        assert out.count() == 0, name


def test_queries_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
