"""Runs queries and their oracle SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    for f in glob.glob(os.path.join(d, "*.parquet")):
        src = f if os.path.isfile(f) else f + "/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{src}'")
    return c


def compare(spark, c, d, query, sql, tmp):
    """The number of rows on either side and of rows that only one of them has."""
    df = query(spark, d)
    cols = sorted(df.columns)
    df.select(*cols).write.mode("overwrite").parquet(tmp)
    want = c.execute(f"SELECT * FROM ({sql}) LIMIT 0").description
    assert sorted(x[0] for x in want) == cols
    names = ", ".join(f'"{x}"' for x in cols)
    c.execute(f"CREATE OR REPLACE TEMP TABLE wanted AS SELECT {names} FROM ({sql})")
    c.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT {names} FROM read_parquet('{tmp}/*.parquet')")
    one = lambda q: c.execute(q).fetchone()[0]
    return (one("SELECT count(*) FROM wanted"), one("SELECT count(*) FROM got"),
            one("SELECT count(*) FROM (FROM wanted EXCEPT ALL FROM got)"), one("SELECT count(*) FROM (FROM got EXCEPT ALL FROM wanted)"))
