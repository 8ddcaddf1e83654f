"""Near-duplicate vectors by product quantisation: every link of a cosine limit, none lost.

Vectors (of a label) lie in coarse inverted lists; what is left after the centroid is coded in subspaces. Two vectors
at most r apart whose lists differ lie on two sides of the plane halfway between the centroids, so their distances to
it add up to r at most, and one of them is within r / 2. So a vector that probes the lists whose plane is within r / 2
of it meets every partner, or the partner meets it: half the radius rules out most lists and loses nothing. In a list,
distances come from tables (query's subvector to each code, summed by the codes of a vector). A code's own error is
stored, so by the triangle inequality a table distance over r + error rules a vector out for certain; all others are
verified by exact double-precision cosines. The number of lists grows with the square root of the rows.

Equal vectors of a label are one entry with a count. Links are counted where they are found and only a spanning
forest of each task's links leaves it, so a group of copies sends as many rows as it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import components, freed, shared_dir, stage
from tidemill.llm._vectors import brought_together, cosines, dealt, fitting_sample, kmeans, matrix, met, nearest, squared, unit, usable

#: Lists by the root of the distinct vectors, and the most: 8 MB of centroids in 64 dimensions. Beyond that lists get
#: longer, and are dealt into more shares.
LISTS, MOST_LISTS = 4, 16_384
SUBSPACES, CODES = 8, 64
SHARE_ROWS, SHARE_QUERIES = 8192, 16_384
#: Vectors or queries whose tables are made at once, room for rounding in distances, and how near to the limit a
#: margin is worked out again in a way that does not depend on the rows beside it.
AT_ONCE, ROUNDING, CLOSE = 128, 1e-6, 1e-9


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, r: float, seed: int):
        self.lists = kmeans(sample, lists, seed, rounds=4)
        self.reach = r / 2 + ROUNDING
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.lists[nearest(sample, self.lists)]
        self.books = [kmeans(rest[:, c], CODES, seed + 1 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the distance between a vector and what its codes stand for."""
        home = nearest(x, self.lists)
        rest = x - self.lists[home]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        stands = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return home, codes.astype(np.uint8), np.sqrt(((rest - stands) ** 2).sum(1))

    def margin(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each vector is from the plane between two lists; negative on the other's side. Row by row."""
        a, b = self.lists[home], self.lists[other]
        apart = np.sqrt(((a - b) ** 2).sum(1))
        away = ((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)
        return np.where(apart > 0, away / (2 * np.where(apart > 0, apart, 1)), 0.0)

    def probes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """[vectors, lists]: whether the list's plane is within reach."""
        out = np.empty((len(x), len(self.lists)), bool)
        for i in range(0, len(x), AT_ONCE):
            part, own = x[i : i + AT_ONCE], home[i : i + AT_ONCE]
            d, apart = squared(part, self.lists), np.sqrt(squared(self.lists[own], self.lists))
            with np.errstate(divide="ignore", invalid="ignore"):
                away = np.where(apart > 0, (d - d[np.arange(len(part)), own][:, None]) / (2 * apart), 0.0)
            got = away <= self.reach
            near = np.nonzero((np.abs(away - self.reach) < CLOSE * 1e3) | (apart < 1e-3))
            got[near] = self.margin(part[near[0]], own[near[0]], near[1]) <= self.reach
            out[i : i + AT_ONCE] = got
        out[np.arange(len(x)), home] = True
        return out

    def probe(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether each vector probes one list: what ``probes`` says."""
        return (home == other) | (self.margin(x, home, other) <= self.reach)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        rest = x - self.lists[at]
        out = np.full((len(x), len(self.cuts), CODES), np.inf)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, i, : len(b)] = squared(rest[:, c], b)
        return out


def _vectors(raw, kind: str) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.empty((0, 0))


def _indexed(quantiser, kind: str):
    def run(batches):
        z = quantiser.value
        for batch in batches:
            x = matrix(batch.column(2))
            if len(x):
                home, codes, error = z.encode(unit(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32)), batch.column(3), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["id", "label", "list", "n", "x", "codes", "error"])

    return run


def _probing(quantiser, kind: str, counts: bool):
    """Entries -> a row for each list that one probes; or, with ``counts``, how many probe each list."""

    def run(batches):
        z = quantiser.value
        for batch in batches:
            label, home = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            x = _vectors(batch.column(4).to_pylist(), kind)
            for i in range(0, len(x), PROBING):
                part = slice(i, i + PROBING)
                who, where = np.nonzero(z.probes(unit(x[part]), home[part]))
                labels = label.slice(i, len(home[part])).take(pa.array(who))
                if counts:
                    got = pa.table([labels, pa.array(where.astype(np.int32))], ["label", "list"]).group_by(["label", "list"]).aggregate([([], "count_all")])
                    yield from got.select(["label", "list", "count_all"]).rename_columns(["label", "list", "n"]).combine_chunks().to_batches()
                else:
                    rows = batch.slice(i, len(home[part]))
                    take = lambda k: rows.column(k).take(pa.array(who))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([take(0), labels, pa.array(where.astype(np.int32)), take(2), take(3), take(4)], ["id", "label", "list", "home", "n", "x"])

    return run


#: Vectors whose probes are sent together.
PROBING = 2048


def forest(rows: list[tuple[int, np.ndarray]], ids: np.ndarray) -> list[tuple[int, int]]:
    """Links of each query (id, places in ids) -> links that connect the same."""
    group = np.arange(len(ids))  # of each place
    of: dict[int, int] = {int(i): k for k, i in enumerate(ids)}
    nxt, extra, out = len(ids), {}, []
    for q, places in rows:
        own = of.get(q)
        mine = group[own] if own is not None else extra.get(q)
        reached = np.unique(group[places])
        if mine is not None and len(reached) == 1 and reached[0] == mine:
            continue
        first = dict(zip(*(x.tolist() for x in (group[places][::-1], places[::-1])), strict=True))
        out += [(q, int(ids[p])) for g, p in first.items() if g != mine]
        joined = set(reached.tolist()) | ({mine} if mine is not None else set())
        group[np.isin(group, list(joined))] = nxt
        extra = {k: nxt if v in joined else v for k, v in extra.items()} if extra else extra
        if own is None:
            extra[q] = nxt
        nxt += 1
    return out


FOUND = "id long, n long, other long"


def linked(quantiser, least: float, r: float, kind: str):
    """Shares of lists -> FOUND: links of a query (n), or of an entry that does not meet the query from its own side,
    and links that connect what was found (other)."""

    def share(z, rows: pa.Table, queries: pa.Table):
        at = rows.column("list")[0].as_py()
        ids, weight, error = (rows.column(c).to_numpy() for c in ("id", "n", "error"))
        y = _vectors(rows.column("x").to_pylist(), kind)
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(y), -1).astype(np.int64)
        who, home, own = (queries.column(c).to_numpy() for c in ("id", "home", "n"))
        x, limit = _vectors(queries.column("x").to_pylist(), kind), (r + error + ROUNDING) ** 2
        found, of_queries, of_entries = [], np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for i in range(0, len(x), AT_ONCE):
            part = x[i : i + AT_ONCE]
            tables = z.tables(unit(part), at)
            d = sum(tables[:, m][:, codes[:, m]] for m in range(codes.shape[1]))
            a, b = np.nonzero(d <= limit)
            ok = np.concatenate([cosines(part[a[s : s + 20_000]], y[b[s : s + 20_000]]) >= least for s in range(0, len(a), 20_000)]) if len(a) else np.empty(0, bool)
            ok &= who[i + a] != ids[b]
            a, b = i + a[ok], b[ok]
            if not len(a):
                continue
            of_queries += np.bincount(a, weight[b], len(x)).astype(np.int64)
            alone = ~z.probe(unit(y[b]), np.full(len(b), at), home[a])
            of_entries += np.bincount(b[alone], own[a[alone]], len(y)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist()
            found += [(int(who[a[p]]), b[p:q]) for p, q in zip(cuts, [*cuts[1:], len(a)], strict=True)]
        for name, n in ((who, of_queries), (ids, of_entries)):
            some = np.flatnonzero(n)
            if len(some):
                yield name[some].tolist(), n[some].tolist(), [None] * len(some)
        if found:
            a, b = zip(*forest(found, ids), strict=True)
            yield list(a), [0] * len(a), list(b)

    def run(batches):
        z = quantiser.value
        for rows, queries in met(batches):
            for a, n, b in share(z, rows, queries):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["id", "n", "other"])

    return run


def near_vectors(rows: DataFrame, *, least: float = 0.8, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 13) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Two rows link if their labels are equal and not null and the cosine of their vectors is ``least`` or more.
    Vectors that are null, all zero, hold null or non-finite components, or have another length than the most common
    (the shorter of equals), and rows with a null label or key, link with nothing: n_links 0, their own component
    (null for a null key). Rows that repeat a key are one node, its links counted over all. Equal vectors of a label
    link with each other. An empty table gives no rows. Other columns are ignored.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "near-vectors")
    # vectors travel as the table has them; all arithmetic is in double precision
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    every = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("string").alias("label"))
    part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"))
    lengths = every.filter(part).groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    alone = F.when(F.col("id").isNotNull(), F.lit(True))
    if lengths is None:
        return every.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), alone.alias("kept"))
    part = F.coalesce(part & (F.size("x") == lengths["dims"]), F.lit(False))
    print_of = [F.when(part, F.xxhash64(F.lit(s), "label", "x")).alias(f"h{s}") for s in (1, 2)]
    every = every.select("id", "x", "label", *print_of)
    classes = every.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("x").alias("x"))
    # a key that stands for two classes is told apart by its class's number
    classes = stage(classes.select("h1", "h2", "rep", F.col("h1").alias("id"), "label", "x", "n"), f"{path}/classes")
    size = classes.count()
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sample = fitting_sample(classes, "id", "x")
    quantiser = Quantiser(sample, min(MOST_LISTS, len(sample), max(1, int(LISTS * np.sqrt(size)))), r, seed)
    shared = spark.sparkContext.broadcast(quantiser)  # at most MOST_LISTS centroids and SUBSPACES * CODES codes

    index = stage(classes.select("id", "label", "x", "n").mapInArrow(_indexed(shared, kind), "id long, label string, list int, n long, x binary, codes binary, error double"), f"{path}/index")
    entries = index.select("id", "label", "list", "n", "x")
    both = ["label", "list"]
    counts = entries.mapInArrow(freed(_probing(shared, kind, True)), "label string, list int, n long")
    cells = dealt(index, counts, both, SHARE_ROWS, SHARE_QUERIES, f"{path}/cells")
    asked = entries.mapInArrow(freed(_probing(shared, kind, False)), "id long, label string, list int, home int, n long, x binary")
    index = index.select("id", "label", "list", F.col("list").alias("home"), "n", "x", "codes", "error")
    found = stage(brought_together(index, asked, cells, both).mapInArrow(freed(linked(shared, least, r, kind)), FOUND), f"{path}/found")

    counted = found.groupBy("id").agg(F.sum("n").alias("links"))
    joined = components(found.filter("other is not null").select("id", "other"), "near-vectors-components")
    placed = classes.select("h1", "h2", "rep", "n", "id").join(counted, "id", "left").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    least_of = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least_of, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = every.select("id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), (F.col("id") == component).alias("kept"))
