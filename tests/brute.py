"""Brute force of the matcher in DuckDB: every owner against every company, from the oracle's SQL."""

import duckdb
import pyarrow as pa

from nomen.plans import oracle as Q


def _con(**tables):
    con = duckdb.connect()
    for name, (column, values) in tables.items():
        con.register(f"{name}_arrow", pa.table({column: pa.array(list(values), pa.string())}))
        con.execute(f"CREATE TABLE {name} AS {Q.profile_select(f'SELECT DISTINCT {column} FROM {name}_arrow WHERE {column} IS NOT NULL', column)}")
    return con


def profiles(names):
    """{name: (normal form, variations, terms)}"""
    rows = _con(t=("name", names)).execute("SELECT name, norm, vars, terms FROM t").fetchall()
    return {n: (norm, set(v), set(t)) for n, norm, v, t in rows}


_TIER = Q.tier_sql("o.vars", "o.terms", "o.coop", "c.vars", "c.terms", "c.coop")


def scores(owners, companies):
    """{(owner, company): confidence} of all pairs"""
    con = _con(o=("owner", owners), c=("company", companies))
    return {(a, b): float(x) for a, b, x in con.execute(f"SELECT owner, company, {_TIER} FROM o, c").fetchall()}


def best(owners, companies):
    """{owner: (first company of the highest confidence, confidence)}"""
    out = {o: (None, 0.0) for o in owners if o is not None}
    for (o, c), x in sorted(scores(owners, companies).items(), key=lambda r: (r[0][0], -r[1], r[0][1])):
        if x > 0 and out[o][0] is None:
            out[o] = (c, x)
    return out


def per_tier(owners, companies):
    """{owner: first company of each of the three joins}"""
    con = _con(o=("owner", owners), c=("company", companies))
    part = "len(list_filter(o.terms, lambda a: len(list_filter(c.terms, lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0"
    rows = con.execute(f"""SELECT owner, min(company) FILTER (len(list_intersect(o.vars, c.vars)) > 0),
        min(company) FILTER (len(list_intersect(o.terms, c.terms)) > 0), min(company) FILTER ({part} OR o.coop OR c.coop)
        FROM o, c GROUP BY owner""").fetchall()
    return {r[0]: r[1:] for r in rows}
