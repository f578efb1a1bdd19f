"""Spark and DuckDB side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir)
    kinds = {n: t for n, t in got.dtypes}
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    b = rows_of(names, cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {[x for x in a[1] if x not in set(b[1])][:3]} {[x for x in b[1] if x not in set(a[1])][:3]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a[1])} rows differ, such as {bad[0]}; columns {a[0]}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(n, kinds[n], types[n]) for n in names if same.get(kinds[n], types[n]) != types[n] and not (types[n] == "STRING" and kinds[n] == "string") and not (types[n] == "NUMBER")]
    return f"types {odd}" if odd and not all(t in ("STRING", "NUMBER", "bool") for _, _, t in odd) else ""
