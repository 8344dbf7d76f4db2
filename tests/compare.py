"""Strict comparison of a Spark query with its SQL: names, kinds of type, rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


def engine(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def difference(con, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in found.description}
    rows = found.fetchall()
    order = [c[0] for c in found.description]
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if ours != theirs:
        both = set(ours.items()) ^ set(theirs.items())
        return f"schema differs: {sorted(both)}"
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    other = sorted((tuple(r[order.index(n)] for n in names) for r in rows), key=repr)
    if len(mine) != len(other):
        return f"{len(mine)} rows, SQL has {len(other)}"
    wrong = [(m, o) for m, o in zip(mine, other) if m != o]
    if wrong:
        m, o = wrong[0]
        return f"{len(wrong)} of {len(mine)} rows differ, first: {[(n, x, y) for n, x, y in zip(names, m, o) if x != y]}"
    return None
