"""Panels from arrays, and comparison with the oracle engine."""

import datetime as dt

import numpy as np
import pandas as pd

TESTDATA = "/root/testdata/sf0.001"


def business_days(n, start="2018-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def frame(spark, px, assets="ABCDEFGH", start="2018-01-01", dates=None):
    """Long prices from an array (bars x assets); NaN cells are missing rows."""
    px = np.asarray(px, float)
    if px.ndim == 1:
        px = px[:, None]
    days = dates or business_days(len(px), start)
    rows = [(days[i], assets[j], float(px[i, j])) for i in range(px.shape[0]) for j in range(px.shape[1]) if not np.isnan(px[i, j])]
    return spark.createDataFrame(rows, "dt date, asset string, px double")


def wide(df, value, index="bar"):
    p = df.toPandas()
    return p.pivot(index=index, columns="asset", values=value).sort_index()


def walk(n, k, seed=3, gaps=0.02):
    rng = np.random.default_rng(seed)
    px = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, (n, k)), 0))
    px[rng.random((n, k)) < gaps] = np.nan
    return px


def date(text):
    return dt.date.fromisoformat(text)


def cells(df):
    """Rows as sorted tuples of comparable values, columns by name."""
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return "~"
        if isinstance(x, (float, np.floating)):
            return str(int(x)) if x == int(x) else repr(float(x))
        return str(x)

    return sorted(tuple(plain(x) if not (isinstance(x, float) and np.isinf(x)) else str(x) for x in row) for row in df.itertuples(index=False))


def oracle(sql, **tables):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name, t in tables.items():
        if isinstance(t, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
        else:
            con.register(name, t)
    return con.execute(sql).df()
