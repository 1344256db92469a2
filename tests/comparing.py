"""Rows of two engines as comparable text."""

import math

import pandas as pd


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, bytearray, dict)):
        return str([cell(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(x)) if x.is_integer() and abs(x) < 2**53 else f"{x:.6f}" if abs(x) < 2**53 else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(zip(*[[cell(v) for v in df[c]] for c in df.columns]), key=str)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert rows(a) == rows(b)
