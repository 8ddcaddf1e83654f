"""Nearest neighbours by cosine: inverted lists that are scanned by blocks of dimensions, with early abandoning.

Unit vectors are rotated at random, so the first d dimensions of a difference are a fair sample of all: its partial
squared length, scaled by D / d, estimates the whole, with an error that falls as 1 / sqrt(d). After each block of
dimensions a candidate is abandoned if the hypothesis that it lies within the k-th best distance found so far can be
rejected. What survives all blocks is ranked by exact double-precision cosines of the original vectors.

Every row is in the index; centroids are fitted on a bounded sample, their number grows with the square root of the
rows. Large lists are dealt into even shares, and so are the queries that probe them, so a list with a third of all
rows is scanned by many tasks. A query that finds fewer than k in its lists is asked of all lists, without abandoning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import freed, shared_dir, stage
from tidemill.llm._vectors import brought_together, cosines, dealt, fitting_sample, kmeans, matrix, met, nearest, squared, unit, usable

#: Dimensions of a block, and how many standard errors the test allows.
BLOCK, ERRORS = 16, 2.1
#: Share of true neighbours, measured on the sample, whose lists must be among those probed; vectors it is measured on.
REACHED, MEASURED = 0.97, 400
#: Lists at most, 8 MB of centroids in 64 dimensions; beyond that they get longer and are dealt into more shares.
MOST_LISTS = 16_384
#: Entries and queries of a share, and queries that are compared at once.
SHARE_ROWS, SHARE_QUERIES, AT_ONCE = 16_384, 8192, 64


def _placed(centroids, probes: int, kind: str):
    """(id, vector) -> a row for each of the ``probes`` nearest lists."""

    def run(batches):
        c = centroids.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for i in range(0, len(x), PLACED):
                part = x[i : i + PLACED]
                near = np.argpartition(squared(unit(part), c), min(probes, len(c)) - 1, axis=1)[:, :probes]
                raw = pa.array([r.tobytes() for r in part.astype(kind)], pa.binary())
                where = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), pa.array(ids[i : i + PLACED], pa.int64()).take(where), raw.take(where)], ["list", "id", "x"])

    return run


#: Vectors that are placed together.
PLACED = 512


def scan_list(q: np.ndarray, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows that may be among the k nearest to each query; all are rotated unit vectors."""
    n, dims = rotated.shape
    if n <= k:
        return np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
    # the distance of the k-th best among those that the first block likes most
    head = squared(q[:, :BLOCK], rotated[:, :BLOCK])
    some = min(n, 4 * k)
    first = np.argpartition(head, some - 1, axis=1)[:, :some]
    limit = np.partition(((rotated[first] - q[:, None]) ** 2).sum(2), k - 1, axis=1)[:, k - 1]
    seen = min(BLOCK, dims)
    a, b = np.nonzero(head * (dims / seen) <= _allowed(limit, seen, dims)[:, None])
    part = head[a, b]
    for at in range(seen, dims, BLOCK):
        to = min(dims, at + BLOCK)
        part += ((rotated[b, at:to] - q[a, at:to]) ** 2).sum(1)
        keep = part * (dims / to) <= _allowed(limit, to, dims)[a]
        a, b, part = a[keep], b[keep], part[keep]
    return a, b


def _allowed(limit: np.ndarray, seen: int, dims: int) -> np.ndarray:
    """What an estimate from ``seen`` dimensions may be, if the distance is within the limit."""
    return limit * (1 + (ERRORS / np.sqrt(seen) if seen < dims else 1e-9)) ** 2 + 1e-9


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """How many lists of a query hold the stated share of its neighbours, by brute force within the sample.

    Neighbours within a sample are farther than within all rows, so this asks for too many rather than too few.
    """
    asked = sample[:: max(1, len(sample) // MEASURED)][:MEASURED]
    if len(sample) <= k + 1:
        return len(centroids)
    near = np.argpartition(-(asked @ sample.T), k, axis=1)[:, : k + 1]  # a query is among its own
    home = nearest(sample, centroids)
    order = np.argsort(np.argsort(squared(asked, centroids), axis=1), axis=1)
    ranks = np.take_along_axis(order, home[near], 1)
    return int(np.quantile(ranks, REACHED, method="higher")) + 1


FOUND = "query_id long, vec_id long, score double"


def searched(rotation: np.ndarray, k: int, kind: str, everything: bool = False):
    """Shares of lists -> the k best distinct ids of each query in it."""

    def best(ids, x, rotated, who, y):
        k_own = k + int((who[:, None] == ids).sum(1).max(initial=0))  # a query is nearest to itself
        a, b = scan_list(unit(y) @ rotation, rotated, len(ids) if everything else k_own)
        other = who[a] != ids[b]
        a, b = a[other], b[other]
        score = cosines(x[b], y[a])
        order = np.lexsort((-score, ids[b], a))  # an id that repeats counts once, with its best
        a, b, score = a[order], b[order], score[order]
        new = np.append(True, (a[1:] != a[:-1]) | (ids[b[1:]] != ids[b[:-1]]))[: len(a)]
        a, b, score = a[new], b[new], score[new]
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        return who[a[rank < k]], ids[b[rank < k]], score[rank < k]

    def run(batches):
        vectors = lambda t: np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(t.num_rows, -1).astype(np.float64)
        for rows, queries in met(batches):
            ids, x = rows.column("id").to_numpy(), vectors(rows)
            rotated, who, y = unit(x) @ rotation, queries.column("id").to_numpy(), vectors(queries)
            out = [best(ids, x, rotated, who[i : i + AT_ONCE], y[i : i + AT_ONCE]) for i in range(0, len(y), AT_ONCE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(rows: DataFrame, queries: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """For each row where ``queries`` holds, its k nearest other rows: query_id, rank, vec_id, score.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do those of another
    length than the most common (the shorter of equals), nor rows with a null key. A row that repeats a query's key
    is not its neighbour; a neighbour's key counts once, with its best score. Ties go to the smaller key. With fewer
    than k candidates all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "ann")
    all_rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    all_rows = all_rows.filter(F.col("id").isNotNull() & usable(F.col("x")))
    lengths = all_rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = lengths["dims"], lengths["n"]
    all_rows = all_rows.filter(F.size("x") == dims)
    sample = fitting_sample(all_rows, "id", "x")
    centroids = kmeans(sample, min(MOST_LISTS, max(1, int(np.sqrt(n)))), seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS vectors
    probes = probes_needed(sample, centroids, k)
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"  # as the table has them

    schema = "list int, id long, x binary"
    index = stage(all_rows.select("id", "x").mapInArrow(freed(_placed(shared, 1, kind)), schema), f"{path}/index")
    asking = stage(all_rows.filter("asks").dropDuplicates(["id"]).select("id", "x"), f"{path}/asking")

    def search(some: DataFrame, lists: int, everything: bool, name: str) -> DataFrame:
        asked = stage(some.mapInArrow(freed(_placed(shared, lists, kind)), schema), f"{path}/{name}-queries")
        cells = dealt(index, asked.groupBy("list").agg(F.count("*").alias("n")), ["list"], SHARE_ROWS, SHARE_QUERIES, f"{path}/{name}-cells")
        met_rows = brought_together(index, asked, cells, ["list"])
        return stage(met_rows.mapInArrow(freed(searched(rotation, k, kind, everything)), FOUND), f"{path}/{name}-found")

    found = search(asking, probes, False, "probed")
    wanted = min(k, all_rows.select("id").distinct().count() - 1)
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= wanted)
    short = asking.join(enough, asking["id"] == enough["query_id"], "left_anti")
    if not short.isEmpty():
        found = found.union(search(short, len(centroids), True, "short"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
