"""GeoJSON features cut out of files by byte ranges.

A FeatureCollection is one JSON document, often one line, and may be far larger
than a task. Spark's text reader cuts it at every ``{`` (``lineSep``), so a file
is read by as many tasks as it has splits. What a split starts with (inside a
string or not, how many objects are open) follows from the splits before it:

1. each split is reduced to a function: for either string state at its start, the
   state at its end and the change of depth (one row per split, no text);
2. these are put together per file on the driver, which holds the list of
   splits anyway;
3. each split, knowing its start, gives the text of the objects on the second
   level; an object that goes on in the next split is given as fragments
   (at most two per split), which are joined per file.

Braces and escaped quotes inside strings are text. Whatever Spark's readers can
open can be read; nothing is opened by path in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK_RE = re.compile(r'\\.|"|\}', re.DOTALL)
ROOT_FEATURE_RE = re.compile(r'"type"\s*:\s*"Feature"')
PIECE = "path string, start long, whole boolean, value string"
OBJECT = "path string, start long, seq long, kind string, text string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between opening braces, in file order within a split."""
    m = F.col("_metadata")
    return (spark.read.option("lineSep", "{").text(path)
            .select(m["file_path"].alias("path"), m["file_block_start"].alias("start"),
                    ((m["file_block_start"] == 0) & (m["file_block_length"] >= m["file_size"])).alias("whole"), "value"))


def _splits(batches) -> Iterator[tuple[str, int, bool, Iterator[str]]]:
    """(path, start, whole file, pieces) of each split of a task."""
    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    it = rows()
    nxt = next(it, None)
    while nxt is not None:
        key = nxt[:3]

        def pieces():
            nonlocal nxt
            while nxt is not None and nxt[:3] == key:
                value, nxt = nxt[3], next(it, None)
                yield value
        part = pieces()
        yield *key, part
        for _ in part:                        # what the caller left
            pass


def _change(pieces: Iterator[str], start: int) -> list[int]:
    """(string state, depth) at the end of a split for either state at its start."""
    state, depth = [0, 1], [0, 0]
    for k, text in enumerate(pieces):
        if k or start:                        # an opening brace stands before the piece
            for i in (0, 1):
                depth[i] += state[i] == 0
        for m in MARK_RE.finditer(text):
            if m[0] == '"':
                state = [1 - x for x in state]
            elif m[0] == "}":
                for i in (0, 1):
                    depth[i] -= state[i] == 0
    return [state[0], depth[0], state[1], depth[1]]


def _changes(batches):
    for path, start, _, pieces in _splits(batches):
        s0, d0, s1, d1 = _change(pieces, start)
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "s0": s0, "d0": d0, "s1": s1, "d1": d1}])


def objects(pieces: Iterator[str], start: int, state: int, depth: int):
    """(kind, text) of the second-level objects of a split: ``whole``; ``head`` or ``tail`` at its edges, ``middle`` when
    the split lies in one object; ``root`` when the document itself says that it is a Feature."""
    out = [] if depth >= 2 else None          # text of the open object
    begun = False                             # whether its start is in this split
    for k, text in enumerate(pieces):
        if k or start:
            if state == 0:
                depth += 1
                if depth == 2:
                    out, begun = [], True
            if out is not None:
                out.append("{")
        at = 0
        for m in MARK_RE.finditer(text):
            if m[0] == '"':
                state = 1 - state
            elif m[0] == "}" and state == 0:
                depth -= 1
                if depth == 1 and out is not None:
                    out.append(text[: m.end()])
                    yield "whole" if begun else "head", "".join(out)
                    out, at = None, m.end()
        if out is not None:
            out.append(text)
        elif depth == 1 and ROOT_FEATURE_RE.search(text, at):
            yield "root", ""
    if out is not None:
        yield "tail" if begun else "middle", "".join(out)


def _objects(starts: dict):
    def run(batches):
        for path, start, whole, pieces in _splits(batches):
            if (path, start) not in starts:
                raise RuntimeError(f"the splits of {path} changed while it was read")
            kept = []

            def noted(pieces=pieces, keep=whole, kept=kept):
                for x in pieces:
                    if keep:
                        kept.append(x)
                    yield x
            rows = []
            for seq, (kind, text) in enumerate(objects(noted(), start, *starts[path, start])):
                if kind == "root":
                    if not whole:
                        raise ValueError(f"{path} is one Feature larger than a split: read it with multiline=True")
                    for _ in pieces:
                        kept.append(_)
                    rows = [{"path": path, "start": start, "seq": 0, "kind": "whole", "text": "{".join(kept)}]
                    break
                rows.append({"path": path, "start": start, "seq": seq, "kind": kind, "text": text})
                if not whole and len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
    return run


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every second-level object of the documents (or of a document that is one Feature)."""
    pieces = _pieces(spark, path)
    changes = pieces.mapInArrow(_changes, "path string, start long, s0 long, d0 long, s1 long, d1 long").collect()   # one row per split
    starts, state, depth, last = {}, 0, 0, None
    for r in sorted(changes, key=lambda r: (r.path, r.start)):
        if r.path != last:
            state, depth, last = 0, 0, r.path
        starts[r.path, r.start] = (state, depth)
        state, depth = (r.s1, depth + r.d1) if state else (r.s0, depth + r.d0)
    found = pieces.mapInArrow(_objects(starts), OBJECT)
    whole = found.where("kind = 'whole'").select("text")
    order = Window.partitionBy("path").orderBy("start", "seq")                                                # at most two fragments per split
    edges = (found.where("kind <> 'whole'")
             .withColumn("object", F.sum((F.col("kind") == "tail").cast("int")).over(order))
             .groupBy("path", "object").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))).alias("parts")))
    return whole.unionByName(edges.select(F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text")))
