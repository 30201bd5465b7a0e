"""Rows of two engines in one comparable form."""

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir=SMALL):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    return "null" if v is None else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(shown(r[n]) for n in names) for r in df.collect())


def duck_rows(relation):
    names = sorted(relation.columns)
    place = [relation.columns.index(n) for n in names]
    return names, sorted(tuple(shown(r[i]) for i in place) for r in relation.fetchall())
