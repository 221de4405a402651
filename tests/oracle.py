"""Side-by-side run of a registered query and its SQL oracle."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

BASE = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for row in pdf.itertuples(index=False):
        cells = []
        for v in row:
            if pd.isna(v):
                cells.append("~null~")
            elif isinstance(v, float):
                cells.append(f"{v:.9g}")
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def difference(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> str | None:
    """None if the results agree, else a short description."""
    got = _rows(fn(spark, sf_dir).toPandas())
    want = _rows((con or connect(sf_dir)).sql(sql).df())
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"{name}: spark {len(got)} rows, sql {len(want)} rows\n spark only: {extra[:3]}\n sql only: {missing[:3]}"
