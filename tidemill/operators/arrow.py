"""Applies numpy kernels to columns through Arrow: one call for each row's arrays, or for each batch of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_kernel(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of a row's values -> a function of columns. Nulls give null."""

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            if any(v is None for v in row):
                out.append(None)
                continue
            got = f(*row)
            out.append(got.astype(np.float64).reshape(-1) if isinstance(got, np.ndarray) else got)
        return pd.Series(out, dtype=object)

    if len(returns) == 0:
        raise ValueError("a kernel needs a return type")

    def one(*columns: Column) -> Column:
        n = len(columns)
        # Arrow functions are recognised by their hints, one for each argument
        shapes = {
            1: lambda a: run(a),
            2: lambda a, b: run(a, b),
            3: lambda a, b, c: run(a, b, c),
            4: lambda a, b, c, d: run(a, b, c, d),
        }
        g = shapes[n]
        g.__annotations__ = {**{k: pd.Series for k in "abcd"[:n]}, "return": pd.Series}
        return F.pandas_udf(g, returns)(*columns)

    return one


#: Samples that are computed together.
AT_ONCE = 1 << 22


def stacked_kernel(f: Callable) -> Callable[[Column], Column]:
    """A function of [time, channels] that treats channels alike -> a function of a column of mono clips, to arrays.

    Clips of one length are channels of one call. Nulls give null.
    """

    def run(clips: pd.Series) -> pd.Series:
        out = np.empty(len(clips), object)
        sizes = np.array([-1 if c is None else len(c) for c in clips])
        for size in np.unique(sizes[sizes >= 0]):
            which = np.flatnonzero(sizes == size)
            step = max(1, AT_ONCE // max(int(size), 1))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                got = np.asarray(f(np.stack([clips.iloc[i] for i in some], axis=1).astype(np.float32)), np.float64)
                rows = np.moveaxis(got, -1, 0).reshape(len(some), -1)
                for i, row in zip(some, rows, strict=True):
                    out[i] = row
        return pd.Series(out)

    def one(clips: Column) -> Column:
        run.__annotations__ = {"clips": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<double>")(clips)

    return one


def batch_kernel(df: DataFrame, keys: list[str], f: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on all rows of a mini-batch at once; a batch is a bounded number of rows by construction."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return f(key, pdf)

    return df.groupBy(*keys).applyInPandas(run, schema)
