"""A query's rows and those of its SQL, as the driver compares them."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    one = lambda v: "~" if not isinstance(v, (list, dict)) and pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(one, row)) for row in frame.to_numpy().tolist()), key=lambda row: tuple(map(str, row)))


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return found


def same(query, sql: str, spark, sf_dir: str) -> None:
    want, got = database(sf_dir).execute(sql).df(), query(spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)
