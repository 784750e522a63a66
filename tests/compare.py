"""Compare a registered query with its SQL: names, types, and values regardless of order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def difference(df, con, sql):
    """A short text on the first difference, or None."""
    names = sorted(df.columns)
    got_types = dict(df.dtypes)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}"
    wrong = [(n, got_types[n], described[n]) for n in names if TYPES.get(got_types[n]) != described[n]]
    if wrong:
        return f"types {wrong}"
    quoted = ", ".join(f'"{n}"' for n in names)
    want = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_order)
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_order)
    if len(want) != len(got):
        return f"rows {len(got)} against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(_same, g, w))]
    return f"{len(bad)} of {len(got)} rows, columns {names}, first {bad[0]}" if bad else None
