"""Order-free comparison of a Spark result with DuckDB's."""

import numpy as np
import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.map(_cell).values.tolist()))


def same(spark_df, con, sql):
    ours, theirs = spark_df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
