"""Structure repair of conversations: cheapest edits to ``(s?(ua)+)?`` by Four-Russians block tables.

A row is one of nine symbols: must be deleted (blank or duplicate), or the initial of its role (system, user,
assistant, other) with or without a missing end mark. The cheapest cost of repairing the rest of a conversation is a
vector over the four states of the pattern (start, after s, after u, after a).

* **Normalised vectors.** Costs of the states differ by a bounded amount, so only a few vectors occur once their least
  entry is taken off (found by closure from the vector of the end).
* **Block tables.** For every such vector behind every block of ``BLOCK`` symbols the vector before it is tabulated;
  a conversation is processed from its end by one lookup a block.
* **Tracing.** Forwards, a block is expanded backwards again from the vector behind it, and each row takes the
  ASCII-least edit that is cheapest. Every edit letter leads to one state, so the greedy trace is the least of all
  cheapest traces.

On Spark: rows are sorted once and numbered in two passes; faults come from aggregations keyed by conversation and content;
conversations are cut into chunks of ``CHUNK`` symbols. A chunk of a longer conversation is a function from the vector behind
it and the state before it, which are composed one row a chunk; so no task holds more than that of one conversation.

Defined cases: null roles and texts are one space, null turns come first, rows of one turn are ordered by role and text; a
role is known by its first letter, an empty one counts as other; a null conversation id is a conversation; rows equal in all
are kept (and are duplicates); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize
from nomen.operators.windows import number_rows

BLOCK = 3
CHUNK = 4096
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
INITIALS = "sua"                    # any other is 3
GONE = 8                            # the symbol of rows that must go; else 2 * initial + truncated
SYMBOLS = 9
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FOLLOWS = (2, 2, 3, 2)              # state after the user or assistant turn that a state waits for
LEGAL = {(0, 1), (1, 2), (2, 1)}    # su, ua, au
ROLE = {2: "user", 3: "assistant"}  # by the state that a turn leads to


def _keeps(sym: int, q: int) -> int | None:
    """State after keeping a row, None if the pattern forbids it."""
    initial = sym // 2
    if initial == 0:
        return 1 if q == 0 else None
    return FOLLOWS[q] if initial == FOLLOWS[q] - 1 else None


def _rows(vec: tuple, sym: int):
    """Edits that use up a row: per state a list of (letter, cost to the end, state after)."""
    out = []
    for q in range(4):
        edits = [("D", DELETE + vec[q], q)]
        if sym != GONE:
            extra = TRUNCATED * (sym % 2)
            kept = _keeps(sym, q)
            if kept is not None:
                edits.append(("K", extra + vec[kept], kept))
            edits.append(("R", REROLE + extra + vec[FOLLOWS[q]], FOLLOWS[q]))
        out.append(edits)
    return out


def _before(vec: tuple, sym: int) -> tuple:
    """Cost vector before a row, from the one behind it."""
    v = [min(cost for _, cost, _ in edits) for edits in _rows(vec, sym)]
    for _ in range(3):
        v = [min(v[q], INSERT + v[FOLLOWS[q]]) for q in range(4)]
    return tuple(v)


def _normal(vec: tuple) -> tuple:
    return tuple(x - min(vec) for x in vec)


class Tables:
    """``one[v, s]`` and ``block[v, code]``: the vector before a symbol or a block; ``act[v][s][q]``: the letters of
    inserts and of the edit of a row, and the state after; ``state[v, s, q]``: that state."""

    def __init__(self):
        self.vectors = [(0, 2 * INSERT, INSERT, 0)]             # behind the last row
        number = {self.vectors[0]: 0}
        one = []
        for vec in self.vectors:                                # grows while it is read
            for sym in range(SYMBOLS):
                new = _normal(_before(vec, sym))
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
            one.append([number[_normal(_before(vec, sym))] for sym in range(SYMBOLS)])
        self.one = np.array(one, np.int32)
        codes = np.array(list(product(range(SYMBOLS), repeat=BLOCK)))
        at = np.repeat(np.arange(len(one))[:, None], len(codes), 1)
        for i in range(BLOCK - 1, -1, -1):
            at = self.one[at, codes[None, :, i]]
        self.block = at
        self.act = [[[self._choose(vec, sym, q) for q in range(4)] for sym in range(SYMBOLS)] for vec in self.vectors]
        self.state = np.array([[[a[2] for a in x] for x in y] for y in self.act], np.int32)
        self.one_list, self.block_list = self.one.tolist(), self.block.tolist()

    @staticmethod
    def _choose(vec, sym, q):
        """(roles inserted, edit, state after, cost) of the ASCII-least cheapest edits up to and with the row."""
        best, rows, inserted, cost = _before(vec, sym), _rows(vec, sym), [], 0
        while True:
            options = [(letter, q2) for letter, c, q2 in rows[q] if c == best[q]]
            if INSERT + best[FOLLOWS[q]] == best[q]:
                options.append(("I", FOLLOWS[q]))
            letter, q2 = min(options)
            if letter != "I":
                spent = {"D": DELETE, "K": 0, "R": REROLE}[letter] + (TRUNCATED * (sym % 2) if letter != "D" and sym != GONE else 0)
                return tuple(inserted), letter, q2, cost + spent
            inserted.append(q2)
            cost += INSERT
            q = q2


@functools.cache
def tables() -> Tables:
    return Tables()


def backwards(sym: list[int], vec: int) -> list[int]:
    """Vector behind each block of a chunk, and before the chunk (last entry), by table lookups from its end."""
    t = tables()
    full = len(sym) // BLOCK
    for s in reversed(sym[full * BLOCK:]):
        vec = t.one_list[vec][s]
    behind = [0] * full + [vec]
    for i in range(full - 1, -1, -1):
        code = 0
        for s in sym[i * BLOCK: (i + 1) * BLOCK]:
            code = code * SYMBOLS + s
        behind[i] = vec
        vec = t.block_list[vec][code]
    behind[-1] = vec
    return behind


def trace(sym: list[int], vec: int, q: int):
    """(edits of each row: (states of inserted turns, letter, state after), state at the end, cost) of a chunk."""
    t = tables()
    behind = backwards(sym, vec)
    out, cost, full = [], 0, len(sym) // BLOCK
    for i in range(full + 1):
        part = sym[i * BLOCK: (i + 1) * BLOCK]
        inner = [behind[i] if i < full else vec]
        for s in reversed(part[1:]):                            # a block is expanded from its end
            inner.append(t.one_list[inner[-1]][s])
        for s, v in zip(part, reversed(inner), strict=False):
            a = t.act[v][s][q]
            out.append(a[:3])
            q = a[2]
            cost += a[3]
    return out, q, cost


def closing(q: int) -> list[int]:
    """States of the turns inserted after the last row."""
    out = []
    while q in (1, 2):
        q = FOLLOWS[q]
        out.append(q)
    return out


def _function(sym: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every vector behind a chunk: the vector before it, and the state after it by the state before it."""
    t = tables()
    at = [np.arange(len(t.vectors))]
    for s in reversed(sym):
        at.append(t.one[at[-1], s])
    state = np.tile(np.arange(4), (len(t.vectors), 1))
    for s, v in zip(sym, reversed(at[:-1]), strict=True):
        state = t.state[v[:, None], s, state]
    return at[-1], state


# --- Spark -----------------------------------------------------------------------------------------------------------

def prepared(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv`` (text; empty for null)``, turn, role, text`` without nulls in role and text."""
    return conversations.select(F.coalesce(col(conv).cast("string"), F.lit("")).alias("conv"), col(turn).cast("long").alias("turn"),
                                F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of end marks, repeated or given to the user, by crc32(``conv:turn``) % 20."""
    space = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(" ")).otherwise(c)
    x = F.crc32(F.concat(space(F.col("conv")), F.lit(":"), space(F.col("turn").cast("string"))).cast("binary")) % 20
    out = rows.withColumn("x", x).where("x != 0")
    out = out.withColumn("copy", F.explode(F.when(F.col("x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.select("conv", "turn", F.when(F.col("x") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      F.when(F.col("x") == 1, F.lit("")).when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))


class Repair:
    """Faults and cheapest repair of conversations (``conv, turn, role, text`` as :func:`prepared` gives them).

    ``stats``: one row per conversation; ``repaired_rows``: the repaired conversations; ``digests``: their SHA-256."""

    def __init__(self, rows: DataFrame, chunk: int = CHUNK):
        n = number_rows(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
        self.counts = materialize(n.groupBy("conv").agg(
            F.min("n").alias("first"), F.count(F.lit(1)).alias("size"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")), "repair-counts")
        self.rows = n.join(self.counts.select("conv", "first", "size"), "conv").withColumn("chunk", F.expr(f"(n - first) div {chunk}"))
        self.chunk = chunk
        self.plan = self._plan()

    def _symbols(self) -> DataFrame:
        end = F.rtrim(F.col("text"), F.lit(WHITE))
        initial = F.substring("role", 1, 1)
        number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        t = self.rows.select("conv", "size", "chunk", "n", number.alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
                             F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("sha"))
        t = materialize(t, "repair-marks")
        new = materialize(t.groupBy("conv", "sha").agg(F.min("n").alias("n")).select("n"), "repair-new").withColumn("new", F.lit(True))
        fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("cut"), "t").otherwise("")
        return t.drop("sha").join(new, "n", "left").select("conv", "size", "chunk", "n", "initial", fault.alias("fault"))

    def _plan(self) -> DataFrame:
        """One row per chunk: its rows' edits, cost, fault counts, initials at its edges."""
        sym = F.when(F.col("fault").isin("b", "d"), GONE).otherwise(2 * F.col("initial") + F.when(F.col("fault") == "t", 1).otherwise(0))
        cut = (self._symbols().withColumn("sym", sym).groupBy("conv", "size", "chunk")
               .agg(F.sort_array(F.collect_list(F.struct("n", "sym", "initial"))).alias("s"),                       # at most CHUNK rows
                    *[F.sum(F.when(F.col("fault") == k, 1).otherwise(0)).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]))
        cut = materialize(cut.select("conv", "size", "chunk", F.col("s.sym").alias("sym"), F.col("s.initial").alias("initial"), "blank", "duplicate", "truncated"), "repair-chunks")
        several = F.col("size") > self.chunk
        between = (cut.where(several).select("conv", "chunk", "sym").mapInArrow(_functions, "conv string, chunk long, body binary")
                   .repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_compose, "conv string, chunk long, vec int, state int"))
        whole = cut.where(~several).withColumns({"vec": F.lit(0), "state": F.lit(0)})
        cut = whole.unionByName(cut.where(several).join(between, ["conv", "chunk"]))
        last = (F.col("chunk") + 1) * self.chunk >= F.col("size")
        out = cut.select("conv", "chunk", "sym", "initial", "vec", "state", last.alias("last"), "blank", "duplicate", "truncated").mapInArrow(
            _traces, "conv string, chunk long, blank long, duplicate long, truncated long, illegal long, head int, tail int, cost long, audit string, edits array<string>")
        return materialize(out, "repair-plan")

    def stats(self) -> DataFrame:
        """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of conversations with rows."""
        p = self.plan
        seam = p.select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("before"))
        seam = (p.where("chunk > 0").join(seam, ["conv", "chunk"]).where(~F.concat(F.col("before").cast("string"), F.col("head").cast("string")).isin(*[f"{a}{b}" for a, b in LEGAL]))
                .groupBy("conv").agg(F.count(F.lit(1)).alias("seams")))
        total = p.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                      F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        return (total.join(seam, "conv", "left").join(self.counts.select("conv", "gaps"), "conv")
                .select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seams", F.lit(0))).alias("illegal"), "cost", "audit"))

    def _streams(self) -> DataFrame:
        """Rows of a conversation in order, each chunk's edits before them."""
        edits = self.plan.select("conv", "chunk", F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edits")
        rows = self.rows.select("conv", "chunk", "n", "role", "text", F.lit(None).cast("array<string>").alias("edits"))
        return edits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "chunk", "n")

    def repaired_rows(self) -> DataFrame:
        """``conv, place`` (from 1)``, role, text``."""
        return self._streams().mapInArrow(_repaired, "conv string, place long, role string, text string")

    def digests(self) -> DataFrame:
        """``conv, repaired_sha256``: of the repaired ``role:text`` lines. The digest is serial by definition: a
        conversation's rows are one task's stream, hashed as they come and never held."""
        return self._streams().mapInArrow(_digests, "conv string, repaired_sha256 string")


def _functions(batches):
    for b in batches:
        bodies = []
        for sym in b.column("sym").to_pylist():
            vec, state = _function(sym)
            bodies.append(vec.astype(np.int32).tobytes() + state.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), pa.array(bodies, pa.binary())], names=["conv", "chunk", "body"])


def _compose(batches):
    """Vector behind and state before each chunk; the chunks of a conversation come together and in order."""
    def finish(conv, bodies):
        m = len(tables().vectors)
        parts = [np.frombuffer(x, np.int32) for x in bodies]
        vec, behind = 0, []
        for p in reversed(parts):
            behind.append(vec)
            vec = int(p[vec])
        behind.reverse()
        state, before = 0, []
        for p, v in zip(parts, behind, strict=True):
            before.append(state)
            state = int(p[m + 4 * v + state])
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(behind, pa.int32()), pa.array(before, pa.int32())],
                                          names=["conv", "chunk", "vec", "state"])

    conv, bodies = None, []
    for b in batches:
        for c, body in zip(b.column("conv").to_pylist(), b.column("body").to_pylist(), strict=True):
            if c != conv and bodies:
                yield finish(conv, bodies)
                bodies = []
            conv = c
            bodies.append(body)
    if bodies:
        yield finish(conv, bodies)


def _traces(batches):
    letter = {("R", 2): "U", ("R", 3): "A"}
    for b in batches:
        illegal, head, tail, cost, audit, edits = [], [], [], [], [], []
        for r in b.select(["sym", "initial", "vec", "state", "last"]).to_pylist():
            out, q, spent = trace(r["sym"], r["vec"], r["state"])
            end = closing(q) if r["last"] else []
            ini = r["initial"]
            illegal.append(sum(x not in LEGAL for x in zip(ini, ini[1:], strict=False)))
            head.append(ini[0])
            tail.append(ini[-1])
            cost.append(spent + INSERT * len(end))
            audit.append("".join("I" * len(i) + x for i, x, _ in out) + "I" * len(end))
            # per row: u or a for every turn inserted before it, then K, D, U or A; after the last row: inserted turns
            edits.append(["".join("xxua"[s] for s in i) + letter.get((x, s2), x) for i, x, s2 in out] + ["".join("xxua"[s] for s in end)] * r["last"])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "chunk", "blank", "duplicate", "truncated")), pa.array(illegal, pa.int64()), pa.array(head, pa.int32()),
                                          pa.array(tail, pa.int32()), pa.array(cost, pa.int64()), pa.array(audit), pa.array(edits, pa.list_(pa.string()))],
                                         names=["conv", "chunk", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cost", "audit", "edits"])


def _lines(batches):
    """(conversation, role, text) of the repaired rows in order; (conversation, None, None) starts each."""
    full = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
    conv, edits, at = None, [], 0
    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    yield from ((conv, full[x], "") for x in edits[at])
                conv, edits = r["conv"], []
                yield conv, None, None
            if r["edits"] is not None:
                edits, at = r["edits"], 0
                continue
            *inserted, op = edits[at]
            at += 1
            yield from ((conv, full[x], "") for x in inserted)
            if op != "D":
                yield conv, full.get(op, r["role"]), r["text"]
    if conv is not None:
        yield from ((conv, full[x], "") for x in edits[at])


def _repaired(batches, chunk=5000):
    out, place = [], 0
    for conv, role, text in _lines(batches):
        place = 0 if role is None else place + 1
        if role is not None:
            out.append((conv, place, role, text))
        if len(out) == chunk:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv", "place", "role", "text"), x, strict=True)) for x in out])
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("conv", "place", "role", "text"), x, strict=True)) for x in out])


def _digests(batches, chunk=5000):
    out, current, digest, n = [], None, None, 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["conv", "repaired_sha256"])

    for conv, role, text in _lines(batches):
        if role is None:
            if digest:
                out.append((current, digest.hexdigest()))
            current, digest, n = conv, hashlib.sha256(), 0
        else:
            digest.update(("\n" * (n > 0) + role + ":" + text).encode())
            n += 1
        if len(out) == chunk:
            yield batch()
            out.clear()
    if digest:
        out.append((current, digest.hexdigest()))
    if out:
        yield batch()


def structure_report(conversations: DataFrame, damage: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation,
    with the rows damaged first if asked for."""
    rows = prepared(conversations)
    repair = Repair(damaged(rows) if damage else rows, chunk)
    out = rows.select("conv").distinct().join(repair.stats(), "conv", "left").join(repair.digests(), "conv", "left")
    return out.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
