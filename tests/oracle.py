"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def differences(con, df, sql: str, folder: str) -> tuple[int, int]:
    """Rows that only the query has, and rows that only the SQL has; columns must be the same."""
    df.write.mode("overwrite").parquet(folder)
    con.sql(f"CREATE OR REPLACE TABLE expected AS {sql}")
    names = sorted(df.columns)
    assert sorted(r[0] for r in con.sql("DESCRIBE expected").fetchall()) == names
    cols = ", ".join(f'"{n}"' for n in names)
    got, want = f"SELECT {cols} FROM read_parquet('{folder}/*.parquet')", f"SELECT {cols} FROM expected"
    n = lambda a, b: len(con.sql(f"{a} EXCEPT ALL {b}").fetchall())
    return n(got, want), n(want, got)
