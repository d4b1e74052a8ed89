"""Comparison of a query's rows with its SQL."""

import numpy as np


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, duck, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())
