"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in got.fetchall())


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())
