"""What several operators of this subpackage use: shared folders, word hashes, packed exchanges, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Entries after which a worker's word table is emptied, so that its memory stays bounded.
WORD_TABLE = 200_000


#: Of sessions without a checkpoint folder (local tests), by application.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below one of our own only where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="tidemill-")
        base = _own_folders[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it again: cuts the lineage, and a lost executor costs no recomputation."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(path: str):
    """What reads and writes a shared path, and the path as it names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_new(folder: str, name: str, suffix: str):
    """A stream to a file of a name that no other attempt of the task has, in a shared folder; and its path."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{suffix}"
    return store.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def new_file(folder: str, name: str, suffix: str, blob: bytes) -> str:
    """Write such a file whole; returns its path."""
    out, path = open_new(folder, name, suffix)
    with out:
        out.write(blob)
    return path


def read_range(path: str, start: int, length: int) -> bytes:
    """Some bytes of a file in a shared folder."""
    store, path = _store(path)
    with store.open_input_file(path) as f:
        return f.read_at(length, start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker keeps at hand while a task runs: emptied by ``freed``.
_kept: list = []


def kept(table):
    """``table``, to be emptied whenever a task ends."""
    _kept.append(table)
    return table


def freed(f):
    """A function over batches whose worker gives back at its end what it held: tables and freed memory.

    Workers are used again by later stages, so what they keep would add up over a job.
    """

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    for table in _kept:
        table.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class WordHashes(dict):
    """Bytes of a word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def ngrams(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``n`` values, by doubling; shorter by n - 1 than ``h``."""
    if len(h) < n:
        return np.empty(0, U64)
    done, size, out, power = 0, 1, None, h  # out covers the first `done` values of a run
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out = power
                else:
                    m = len(h) - done - size + 1
                    out = out[:m] * U64(pow(base, size, 1 << 64)) + power[done : done + m]
                done += size
            size *= 2
            if size > n:
                break
            m = len(power) - size // 2
            power = power[:m] * U64(pow(base, size // 2, 1 << 64)) + power[size // 2 : size // 2 + m]
    return mixed(out)


def blocks(column, limit: int = 4 << 20):
    """An Arrow text column -> (first row, bytes or None of each text) in runs of about ``limit`` bytes.

    What a task makes of its texts then never grows with the number of rows that arrive together.
    """
    import pyarrow as pa

    raw = column.cast(pa.binary())
    size = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield at, raw.slice(at, to - at).to_pylist()
        at = to


def contracted(batches):
    """Edges (u, v) of a partition -> a spanning star of each of its components, by union-find."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded: what is known so far goes out as edges
            yield _stars(parent, root, pa)
            parent.clear()
    yield _stars(parent, root, pa)


def _stars(parent, root, pa):
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """Edges of two long columns -> (node, component), the least node reachable, for every node with an edge to another.

    Alternating large-star and small-star steps. Minima are pre-aggregated, hub rows meet only in joins that
    adaptive execution splits, and nothing is collected but two counters a round.
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession, name)
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    e = stage(e.mapInArrow(contracted, "u long, v long").distinct(), f"{path}/0")
    seen, k = None, 0
    while True:
        k += 1
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if tuple(got) == seen or not got[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(got)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), f"{path}/{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stage(e.distinct(), f"{path}/{k}s")
