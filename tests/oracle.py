"""Run a query's SQL in DuckDB on the same tables and compare the rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _shown(x):
    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return f"{float(x):.8g}"
    return str(x)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(_shown(v) for v in r) for r in df.itertuples(index=False, name=None))
