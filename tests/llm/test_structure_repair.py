"""Structure repair against exhaustive search over edits and a plain-Python report."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from nomen.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n long, chunk int"
PATTERN = re.compile("(s?(ua)+)?")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def search(rows):
    """(cost, audit, repaired) by a uniform-cost search over all edit strings, least string first."""
    todo = [(0, "", 0, "", ())]
    seen = set()
    best = None
    while todo:
        cost, audit, i, made, lines = heapq.heappop(todo)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and PATTERN.fullmatch(made) and (best is None or audit < best[1]):
            best = (cost, audit, lines)
        if (cost, audit, i, made) in seen:
            continue
        seen.add((cost, audit, i, made))
        if not re.fullmatch("(s?(ua)*u?)?", made):
            continue
        grow = [(5, "I", i, made + r[0], (*lines, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            grow.append((2, "D", i + 1, made, lines))
            if fault not in "bd" or not fault:
                extra = 5 * (fault == "t")
                grow.append((extra, "K", i + 1, made + (role[:1] or "?"), (*lines, (role, text))))
                grow += [(1 + extra, "R", i + 1, made + r[0], (*lines, (r, text))) for r in ("user", "assistant")]
        for c, x, j, m, ls in grow:
            if cost + c <= 2 * len(rows):                          # deleting everything costs that
                heapq.heappush(todo, (cost + c, audit + x, j, m, ls))
    return best


def test_tables_against_search():
    """All conversations of up to three rows over all symbols, and random ones of five."""
    rng = random.Random(1)
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "t")] + [("user", "b")]
    symbol = [2 * (i // 2) + i % 2 for i in range(8)] + [sr.GONE]
    cases = [c for n in range(4) for c in product(range(9), repeat=n)] + [tuple(rng.choices(range(9), k=5)) for _ in range(60)]
    for case in cases:
        rows = [(kinds[i][0], "x", kinds[i][1]) for i in case]
        out, q, cost = sr.trace([symbol[i] for i in case], 0, 0)
        end = sr.closing(q)
        audit = "".join("I" * len(i) + x for i, x, _ in out) + "I" * len(end)
        want = search(rows)
        assert (cost + 5 * len(end), audit) == want[:2], case


def test_chunk_functions_compose():
    rng = random.Random(2)
    for _ in range(50):
        sym = rng.choices(range(9), k=rng.randrange(1, 40))
        cut = rng.randrange(len(sym) + 1)
        whole = sr.trace(sym, 0, 0)
        vec, state = sr._function(sym[cut:])
        behind = int(vec[0])
        first = sr.trace(sym[:cut], behind, 0)
        second = sr.trace(sym[cut:], 0, first[1])
        assert first[0] + second[0] == whole[0] and first[2] + second[2] == whole[2] and int(state[0, first[1]]) == second[1]
        assert sr.backwards(sym, 0)[-1] == int(sr._function(sym)[0][0])


def rows():
    rng = random.Random(5)
    out = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 4, 6])):
            out.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                        rng.choice(["Hi.", "no mark", "What? ", "", None, " \n", "Done!\t", "a.b.c", "long " * 30 + "."])))
    out += [(70, 1, "user", "x."), (70, 1, "user", "x."), (None, 1, "user", "x."), (None, None, None, None)]
    out += [(90, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", f"c{t}."])) for t in range(40)]
    return [(*r, "z", 3, 4) for r in out]


def brute(all_rows):
    convs = {}
    for c, t, r, x, *_ in all_rows:
        r, x = " " if r is None else r, " " if x is None else x
        here = convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (t is not None, t or 0, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            here += [row] * (2 if k == 3 else 1)
    for c, here in convs.items():
        here.sort()
        seen, marked, count = set(), [], dict.fromkeys("bdt", 0)
        for _, _, r, x in here:
            s = x.rstrip(WHITE)
            f = "b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else ""
            seen.add((r, x))
            if f:
                count[f] += 1
            marked.append((r, x, f))
        turns = [t for ok, t, *_ in here if ok]
        ini = [r[:1] for _, _, r, _ in here]
        yield c, here, marked, count, (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:], strict=False))


@pytest.mark.parametrize("chunk", [sr.CHUNK, 5])
def test_report(spark, chunk):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = {r.conv_id: r for r in sr.structure_report(df, damage=True, chunk=chunk).collect()}
    want = list(brute(rows()))
    assert len(got) == len(want)
    for c, here, marked, count, gaps, illegal in want:
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (gaps, count["b"], count["d"], count["t"], illegal), c
        if len(here) <= 8:
            cost, audit, lines = search(marked)
            assert (r.cost, r.audit) == (cost, audit), c
            assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
    # the long conversation gives one answer however it is cut
    out, q, cost = sr.trace([sr.GONE if f in ("b", "d") else 2 * ("sua".find(r[:1]) if r[:1] in tuple("sua") else 3) + (f == "t")
                             for r, _, f in next(m for c, _, m, *_ in want if c == 90)], 0, 0)
    end = sr.closing(q)
    assert (got[90].cost, got[90].audit) == (cost + 5 * len(end), "".join("I" * len(i) + x for i, x, _ in out) + "I" * len(end))


def test_repaired_rows_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    lines = {}
    for r in sorted(sr.Repair(sr.prepared(df), 7).repaired_rows().collect(), key=lambda r: r.place):
        lines.setdefault(r.conv, []).append((r.role, r.text))
    digest = {r.conv_id: r for r in sr.structure_report(df, chunk=7).collect()}
    for c, r in digest.items():
        have = lines.get("" if c is None else str(c), [])
        assert PATTERN.fullmatch("".join(a[:1] for a, _ in have))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in have).encode()).hexdigest()
    assert sr.structure_report(df.limit(0), damage=True).count() == 0
