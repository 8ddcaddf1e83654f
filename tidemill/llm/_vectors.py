"""Vectors of a table: which take part, a bounded sample to fit on, k-means, inverted lists dealt into even cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import stage

#: Rows that centroids and codes are fitted on, at most: the least by a hash of their id.
FITTED = 20_000


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths -> rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, one by one, so that equal rows give equal values wherever they stand."""
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def fitting_sample(rows: DataFrame, key: str, vector: str, most: int = FITTED) -> np.ndarray:
    """Unit vectors of at most ``most`` rows."""
    got = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(most).toArrow()
    return unit(matrix(got.column(1).combine_chunks())) if got.num_rows else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


#: Queries of a cell that are compared at once.
ASKED_AT_ONCE = 1024


def dealt(index: DataFrame, asked: DataFrame, by: list[str], rows: int, queries: int, path: str) -> DataFrame:
    """Lists that are asked -> (by, cell, parts, turns): a number for each, and into how many even shares of at most
    about ``rows`` entries and ``queries`` queries it is dealt. ``asked`` has a row (by, n) for some of each's queries."""
    parts = index.groupBy(*by).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    turns = asked.groupBy(*by).agg(F.ceil(F.sum("n") / queries).cast("int").alias("turns"))
    return stage(parts.join(turns, by).withColumn("cell", F.monotonically_increasing_id()), path)


def brought_together(index: DataFrame, asked: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Entries (kind 0), then queries (kind 1) of each share of a cell, next to each other in one partition.

    A share holds a part of a list's entries and a part of its queries, and each entry meets each query in one share.
    """
    part, turn = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(8)), F.col("turns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [c for c in index.columns if c not in by or c == "list"]
    left = index.join(cells, by).select("cell", part.alias("part"), every("turns").alias("turn"), F.lit(0).alias("kind"), *own)
    right = asked.join(cells, by).select("cell", every("parts").alias("part"), turn.alias("turn"), F.lit(1).alias("kind"), *[c for c in own if c in asked.columns])
    where = ["cell", "part", "turn"]
    return left.unionByName(right, allowMissingColumns=True).repartition(*where).sortWithinPartitions(*where, "kind")


def met(batches):
    """Partitions of ``brought_together`` -> tables (entries, at most ASKED_AT_ONCE queries) of each share."""
    key, rows, queries, held = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if key != tuple(keys[a].tolist()):
                if rows and queries:
                    yield pa.Table.from_batches(rows), pa.Table.from_batches(queries)
                key, rows, queries, held = tuple(keys[a].tolist()), [], [], 0
            part = batch.slice(a, b - a)
            n = pc.sum(pc.equal(part.column(3), 0)).as_py()
            if n:
                rows.append(part.slice(0, n))
            for at in range(n, b - a, ASKED_AT_ONCE):
                queries.append(part.slice(at, min(ASKED_AT_ONCE, b - a - at)))
                held += queries[-1].num_rows
                if held >= ASKED_AT_ONCE and rows:
                    yield pa.Table.from_batches(rows), pa.Table.from_batches(queries)
                    queries, held = [], 0
    if rows and queries:
        yield pa.Table.from_batches(rows), pa.Table.from_batches(queries)
