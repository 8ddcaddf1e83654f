"""Removal of word windows that start more than once, by a log-structured fingerprint index.

Documents are packed into chunks of whole texts. Within each run of ``window - gram + 1`` grams of a window the
least gram hash is the window's anchor: equal windows have equal anchors, and there is about one anchor for eight
words. A chunk's anchors, sorted and cut by hash range, are its run. ``FingerprintIndex`` keeps runs as immutable
Parquet files; an entry that has been seen once also tells its chunk. A new batch's runs are merge-joined with them
range by range: the batch's chunks learn which of their anchors occur more than once so far, and a chunk of an earlier
batch learns it when its anchor is seen for the second time. So nothing is hashed again, whatever comes later.
``compact`` merges runs into one that keeps each hash once, and ranges are halved as the index grows. Only windows with
a repeated anchor are then verified by a 128-bit fingerprint of the window itself, again merged range by range.

All exchanges carry sorted binary runs, one row for a chunk and a hash range, and a hash occurs in such a row once
however often the chunk holds it: a passage that a third of all documents share adds one entry a chunk.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import U64, WordHashes, blocks, freed, kept, mixed, ngrams, open_new, read_range, shared_dir, stage

WINDOW, GRAM = 35, 20
#: Bytes of text in a chunk, and for each hash range.
CHUNK_BYTES, RANGE_BYTES = 4 << 20, 3 << 20
#: Tasks that chunks are dealt to, at least, and bytes of text for each beyond that.
LEAST_TASKS, TASK_BYTES = 32, 64 << 20
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

#: A chunk's texts lie in a file of the task that packed it: rows that are exchanged stay small.
CHUNK = "chunk long, bytes long, ids array<long>, sizes binary, file string, start long, length long"
#: ``many``: bits of the hashes that occur more than once; ``owners``: in merged runs, the chunk of each other one.
RUN = "chunk long, part int, n int, hashes binary, many binary, owners binary"
#: Batches that a table is dealt into, and runs that are merged into one when there are more.
BATCHES, FAN_IN = 4, 2
_words = kept(WordHashes())


def pack(folder: str):
    """(doc_id, text) batches -> chunk rows; a null text has size -1."""

    def run(batches):
        ids, texts, held, k, at = [], [], 0, 0, 0
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        out = path = None

        def row():
            sizes = np.array([-1 if t is None else len(t) for t in texts], "<i8")
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(t for t in texts if t))
            out.write(blob)
            return pa.RecordBatch.from_arrays(
                [pa.array([(number << 24) + k]), pa.array([held]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()]), pa.array([path]), pa.array([at]), pa.array([len(blob)])],
                ["chunk", "bytes", "ids", "sizes", "file", "start", "length"],
            )

        try:
            for batch in batches:
                for first, raw in blocks(batch.column(1)):
                    if out is None:
                        out, path = open_new(folder, f"texts-{number:07d}", ".zst")
                    for i, t in zip(batch.column(0).slice(first, len(raw)).to_pylist(), raw, strict=True):
                        ids.append(i)
                        texts.append(t)
                        held += len(t or b"")
                        if held >= CHUNK_BYTES:
                            made = row()
                            yield made
                            ids, texts, held, k, at = [], [], 0, k + 1, at + made.column(6)[0].as_py()
            if ids:
                yield row()
        finally:
            if out is not None:
                out.close()

    return run


def unpack(x: dict) -> list[bytes]:
    """The texts of a chunk row, with nothing for null."""
    sizes, blob = x["sizes"], read_range(x["file"], x["start"], x["length"])
    sizes = np.maximum(np.frombuffer(sizes, "<i8"), 0)
    text = zstandard.ZstdDecompressor().decompress(blob) if sizes.sum() else b""
    ends = np.cumsum(sizes).tolist()
    return [text[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


class Windows:
    """Word windows of a chunk: ``words`` by document, ``starts`` of the valid windows, their anchors."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.h = _words.of(list(itertools.chain.from_iterable(self.words)))
        self.window = window
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        self.valid = ends - np.arange(len(self.h)) >= window
        self.starts = np.flatnonzero(self.valid)
        grams = ngrams(self.h, gram, BASE_A)
        span = window - gram + 1
        least = _sliding(grams, span, np.minimum)  # of window i
        ok = self.valid[: len(least)]
        self.anchors = least[ok]
        # a gram is an anchor where some window over it takes it
        taken = _sliding(np.concatenate([np.zeros(span - 1, U64), np.where(ok, least, U64(0)), np.zeros(span - 1, U64)]), span, np.maximum) if len(least) else least
        self.picked = grams[grams == taken] if len(least) else grams

    def prints(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows that start at ``which``."""
        a, b = ngrams(self.h, self.window, BASE_A), ngrams(mixed(self.h ^ U64(BASE_A)), self.window, BASE_B)
        return a[which], b[which]


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    size = 1
    if len(x) < n:
        return x[:0]
    while size * 2 <= n:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _cut(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range begins in the sorted ``h``; parts + 1 places."""
    edges = np.array([(i << 64) // parts for i in range(parts)], U64)
    return np.append(np.searchsorted(h, edges), len(h))


def _rows(chunk: int, parts: int, h: np.ndarray, many: np.ndarray, wide: np.ndarray | None = None):
    """The run of a chunk as rows of RUN. wide: second hashes, stored after the first ones."""
    cuts = _cut(h, parts)
    rows = [(chunk, i, b - a, h[a:b].tobytes() + (wide[a:b].tobytes() if wide is not None else b""), _bits(many[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    c = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary()), pa.nulls(len(c[0]), pa.binary())], ["chunk", "part", "n", "hashes", "many", "owners"])


def anchor_runs(parts: int, window: int, gram: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                w = Windows(unpack(x), window, gram)
                h, n = np.unique(w.picked, return_counts=True)
                yield _rows(x["chunk"], parts, h, n > 1)

    return run


def repeated(keys: tuple, pdf):
    """The window runs of one hash range -> for each run of a chunk that has any, which of its pairs of hashes occur
    more than once."""
    import pandas as pd

    table = pdf.sort_values("chunk")
    runs = [np.frombuffer(b, U64).reshape(2, -1) for b in table["hashes"]]
    every = np.concatenate(runs, axis=1)
    many = np.concatenate([_unbits(b, n) for b, n in zip(table["many"], table["n"], strict=True)])
    order = np.lexsort(every[::-1])
    s = every[:, order]
    new = np.ones(s.shape[1], bool)
    new[1:] = (s[:, 1:] != s[:, :-1]).any(axis=0)
    group = np.cumsum(new) - 1
    hot = np.bincount(group) > 1
    hot |= np.bincount(group, many[order]) > 0
    flag = np.empty(len(order), bool)
    flag[order] = hot[group]
    out, at = [], 0
    for chunk, n in zip(table["chunk"], table["n"], strict=True):
        if flag[at : at + n].any():
            out.append((chunk, keys[0], n, _bits(flag[at : at + n])))
        at += n
    return pd.DataFrame(out, columns=["chunk", "part", "n", "flags"])


FLAGS = "chunk long, part int, n int, flags binary"


def _entries(pdf):
    """The runs of one hash range, sorted by hash: hashes, whether many, owners, rows, and the number of each group."""
    h = np.concatenate([np.frombuffer(b, U64) for b in pdf["hashes"]])
    many = np.concatenate([_unbits(b, n) for b, n in zip(pdf["many"], pdf["n"], strict=True)])
    owners = np.concatenate([np.full(n, c) if o is None else np.frombuffer(o, "<i8") for c, n, o in zip(pdf["chunk"], pdf["n"], pdf["owners"], strict=True)])
    row = np.repeat(np.arange(len(pdf)), pdf["n"])
    order = np.argsort(h, kind="stable")
    h, many, owners, row = h[order], many[order], owners[order], row[order]
    return h, many, owners, row, np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1


HOT = "chunk long, part int, hashes binary"


def awakened(keys: tuple, pdf):
    """Earlier runs and a batch's of one hash range -> the anchors that chunks learn to be repeated."""
    import pandas as pd

    if not pdf["fresh"].any():
        return pd.DataFrame([], columns=["chunk", "part", "hashes"])
    h, many, owners, row, group = _entries(pdf)
    fresh = pdf["fresh"].to_numpy()[row]
    earlier = np.bincount(group, ~fresh)
    hot = (np.bincount(group) > 1) | (np.bincount(group, many) > 0)
    knew = (earlier > 1) | (np.bincount(group, many & ~fresh) > 0)  # all chunks of earlier batches were told
    tell = hot[group] & (fresh | (~knew & (np.bincount(group, fresh) > 0))[group])
    chunk, h = owners[tell], h[tell]
    if not len(h):
        return pd.DataFrame([], columns=["chunk", "part", "hashes"])
    order = np.argsort(chunk, kind="stable")
    chunk, h = chunk[order], h[order]
    cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])[: len(chunk)]).tolist()
    return pd.DataFrame([(chunk[a], keys[0], h[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True)], columns=["chunk", "part", "hashes"])


def merged(keys: tuple, pdf):
    """The runs of one hash range -> one run, marked by chunk -1."""
    import pandas as pd

    h, many, owners, _, group = _entries(pdf)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    several = (np.bincount(group) > 1) | (np.bincount(group, many) > 0)
    owner = np.where(several, -1, owners[first]).astype("<i8")
    return pd.DataFrame([(-1, keys[0], len(first), h[first].tobytes(), _bits(several), owner.tobytes())], columns=["chunk", "part", "n", "hashes", "many", "owners"])


def split_ranges(times: int):
    """Runs of hash ranges -> of ``times`` as many (a power of two)."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                h, many = np.frombuffer(x["hashes"], U64), _unbits(x["many"], x["n"])
                owners = None if x["owners"] is None else np.frombuffer(x["owners"], "<i8")
                bits = int(x["parts"]).bit_length() - 1 + times.bit_length() - 1
                cuts = np.searchsorted(h >> U64(64 - bits), np.arange(times, dtype=U64) + U64(x["part"] * times)).tolist()
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)):
                    if b > a:
                        out.append((x["chunk"], x["part"] * times + k, b - a, h[a:b].tobytes(), _bits(many[a:b]), None if owners is None else owners[a:b].tobytes()))
            c = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), *(pa.array(x, pa.binary()) for x in c[3:])], ["chunk", "part", "n", "hashes", "many", "owners"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of anchor hashes under ``path``, each cut into as many hash ranges as it was made for.

    ``append`` merge-joins a batch's run with the others, then stores it; ``compact`` merges all runs into one. Older
    files stay until the caller removes the folder, so readers are never cut off.
    """

    def __init__(self, spark, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in, self.made = spark, path, fan_in, 0
        self.runs: list[tuple[DataFrame, int]] = []
        self.compacted = 0

    def append(self, batch: DataFrame, parts: int) -> DataFrame:
        """HOT: what the chunks of the batch, and those of earlier ones, learn."""
        self.made += 1
        run = stage(batch, f"{self.path}/run-{self.made}")
        rows = run.withColumn("fresh", F.lit(True))
        if self.runs:
            rows = rows.union(self.all(parts).withColumn("fresh", F.lit(False)))
        hot = stage(rows.groupBy("part").applyInPandas(awakened, HOT), f"{self.path}/hot-{self.made}")
        self.runs.append((run, parts))
        if len(self.runs) > self.fan_in:
            self.compact(parts)
        return hot

    def all(self, parts: int) -> DataFrame:
        """The rows of all runs, in ``parts`` ranges (no fewer than any run has)."""
        out = None
        for run, own in self.runs:
            if own < parts:
                run = run.withColumn("parts", F.lit(own)).mapInArrow(split_ranges(parts // own), RUN)
            out = run if out is None else out.union(run)
        return out

    def compact(self, parts: int) -> None:
        self.made += 1
        self.compacted += 1
        self.runs = [(stage(self.all(parts).groupBy("part").applyInPandas(merged, RUN), f"{self.path}/run-{self.made}"), parts)]


def _by_chunk(flags: DataFrame, name: str) -> DataFrame:
    """One row a chunk: its flags in the order of the ranges. As many entries as ranges, each some bits."""
    return flags.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "n", "flags"))).alias(name))


def _hot_of_chunk(hot: DataFrame) -> DataFrame:
    """One row a chunk: its repeated anchors, in sorted pieces."""
    return hot.groupBy("chunk").agg(F.collect_list("hashes").alias("anchors"))


def _flagged(h: np.ndarray, flags: list | None, parts: int) -> np.ndarray:
    got = np.zeros(len(h), bool)
    cuts = _cut(h, parts)
    for x in flags or []:
        a, b = cuts[x["part"]], cuts[x["part"] + 1]
        got[a:b] = _unbits(x["flags"], b - a)
    return got


def _suspects(x: dict, window: int, gram: int):
    """The windows of a chunk whose anchor occurs more than once: the chunk, their starts, their two hashes."""
    w = Windows(unpack(x), window, gram)
    hot = np.sort(np.frombuffer(b"".join(x["anchors"] or []), U64))
    if not len(hot):
        return w, np.empty(0, np.int64), np.empty(0, U64), np.empty(0, U64)
    at = np.minimum(np.searchsorted(hot, w.anchors), len(hot) - 1)
    starts = w.starts[hot[at] == w.anchors]
    return w, starts, *w.prints(starts)


def _unique_prints(a: np.ndarray, b: np.ndarray):
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = group
    return sa[new], sb[new], inverse, np.bincount(group, minlength=0)


def window_runs(parts: int, window: int, gram: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                _, _, a, b = _suspects(x, window, gram)
                ua, ub, _, n = _unique_prints(a, b)
                yield _rows(x["chunk"], parts, ua, n > 1, ub)

    return run


CLEAN = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def cleaned(parts: int, window: int, gram: int, texts: bool):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                w, starts, a, b = _suspects(x, window, gram)
                gone = np.zeros(len(w.h) + 1, np.int64)
                if len(starts):
                    ua, _, inverse, _ = _unique_prints(a, b)
                    doubled = starts[_flagged(ua, x["window_flags"], parts)[inverse]]
                    gone += np.bincount(doubled, minlength=len(gone)) - np.bincount(doubled + window, minlength=len(gone))[: len(gone)]
                keep = np.cumsum(gone)[:-1] == 0
                rows, at = [], 0
                for i, words in zip(x["ids"], w.words, strict=True):
                    mine = keep[at : at + len(words)]
                    at += len(words)
                    left = words if mine.all() else list(itertools.compress(words, mine.tolist()))
                    text = b" ".join(left)
                    rows.append((i, len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), text.decode() if texts else None))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


class SubstringDedup:
    """Incremental deduplication: ``add`` batches of documents, then ``result`` over all that were added."""

    def __init__(self, spark, *, window: int = WINDOW, gram: int = GRAM, range_bytes: int = RANGE_BYTES, least_parts: int = 32):
        self.spark, self.window, self.gram = spark, window, gram
        self.path = shared_dir(spark, "substring-dedup")
        self.index = FingerprintIndex(spark, f"{self.path}/index")
        self.range_bytes, self.parts, self.bytes = range_bytes, least_parts, 0
        self.chunks: list[DataFrame] = []
        self.hot: list[DataFrame] = []

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 1) -> list[DataFrame]:
        """Index documents, in ``batches`` one after the other; HOT of each: the anchors that chunks, new or old, learn
        to be repeated."""
        b = len(self.chunks)
        rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(freed(pack(f"{self.path}/texts")), CHUNK)
        rows = rows.withColumn("chunk", F.col("chunk") + F.lit(b << 54)).withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)).cast("int"))
        path = f"{self.path}/chunks-{b}"
        rows.write.partitionBy("batch").parquet(path)
        chunks = self.spark.read.schema(rows.schema).parquet(path)
        self.chunks.append(chunks.drop("batch"))
        sizes = {r["batch"]: r["n"] for r in chunks.groupBy("batch").agg(F.sum("bytes").alias("n")).collect()}
        told = []
        for k in range(batches):
            self.bytes += sizes.get(k, 0)
            while self.parts * self.range_bytes < self.bytes:
                self.parts *= 2
            own = self._spread(chunks.filter(F.col("batch") == k).drop("batch"))
            told.append(self.index.append(own.mapInArrow(freed(anchor_runs(self.parts, self.window, self.gram)), RUN), self.parts))
        self.hot += told
        return told

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Chunk rows over tasks by the bytes that they stand for: the rows are small, and would be put together."""
        return rows.repartition(max(LEAST_TASKS, self.bytes // TASK_BYTES), "chunk")

    def result(self, texts: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (and kept) of every document of every batch."""
        every = lambda parts: functools.reduce(DataFrame.union, parts)
        both = self._spread(every(self.chunks).join(_hot_of_chunk(every(self.hot)), "chunk", "left"))
        windows = both.filter("anchors is not null").mapInArrow(freed(window_runs(self.parts, self.window, self.gram)), RUN)
        flags = stage(windows.groupBy("part").applyInPandas(repeated, FLAGS), f"{self.path}/window-flags-{len(self.chunks)}-{uuid.uuid4().hex}")
        out = self._spread(both.join(_by_chunk(flags, "window_flags"), "chunk", "left")).mapInArrow(freed(cleaned(self.parts, self.window, self.gram, texts)), CLEAN)
        return out if texts else out.drop("kept")


def substring_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = False, batches: int = BATCHES) -> DataFrame:
    """Words ``[^\\x20\\x09-\\x0D]+`` of ``docs`` without those covered by a window that starts anywhere else too.

    One row a document: doc_id, n_words, n_removed, kept_sha256, with ``texts`` also the kept words joined by one
    space. A null or empty text has no words; documents shorter than a window lose none; repeated rows (a key twice)
    are documents of their own and remove each other; a null key stays null; an empty table gives no rows. Columns
    other than key and text are ignored. The table enters the index in ``batches``; their number changes no result.
    """
    job = SubstringDedup(docs.sparkSession, window=window, gram=max(1, window * 4 // 7))
    job.add(docs, key, text, batches)
    return job.result(texts)
