"""Quality of texts by a byte-level convolutional network, trained and applied in numpy.

A document is cut into chunks of ``2 * STEP`` bytes that overlap by half and cover it to its last byte. Each byte is
a learned vector and one channel that tells whether its last four bytes also stand a short way before them. Learned
filters give a value for each chunk; each filter's largest value over the document enters two dense layers that
combine them into one probability. Chunks share halves, so a half is multiplied once for each side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import blocks, freed

STEP, WIDTH, FILTERS, HIDDEN = 8, 8, 40, 16
#: Distances at which four bytes are looked for again.
LAGS = range(2, 21)
#: Bytes that are laid out at once.
BLOCK = 1 << 20
PAD = 256
#: Bytes before a piece of a very long text: what its first chunk and their recurrence look back to, in whole halves.
BEFORE = 6 * STEP


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (PAD between), recurrence of each, and the first half-chunk of each document; one more ends the last."""
    halves = np.array([max(2, -(-len(t) // STEP)) for t in texts], np.int64)
    starts = np.append(0, np.cumsum(halves))
    data = np.frombuffer(b"".join(t.ljust(n * STEP, b"\0") for t, n in zip(texts, halves.tolist(), strict=True)), np.uint8)
    # zeros pad a document, and a zero within one counts as padding too
    x = data.astype(np.int16)
    x[data == 0] = PAD
    four = np.zeros(len(data), np.uint32)
    if len(data) > 3:
        for k in range(4):
            four[3:] |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(len(data), bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag] if lag < len(four) else False
    again &= data > 0
    first = np.repeat(starts[:-1] * STEP, halves * STEP)
    again &= np.arange(len(data)) - first >= 8  # not with the document before
    return x, again, starts


@dataclass
class Network:
    vectors: np.ndarray  # [257, WIDTH], the last of padding stays zero
    early: np.ndarray  # [STEP * (WIDTH + 1), FILTERS], for the first half of a chunk
    late: np.ndarray  # the same for the second
    bias: np.ndarray  # [FILTERS]
    dense: np.ndarray  # [FILTERS, HIDDEN]
    dense_bias: np.ndarray
    out: np.ndarray  # [HIDDEN]
    out_bias: np.ndarray  # [1]

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        vectors = draw(0.5, 257, WIDTH)
        vectors[PAD] = 0
        n = STEP * (WIDTH + 1)
        return cls(vectors, draw(0.1, n, FILTERS), draw(0.1, n, FILTERS), np.zeros(FILTERS, np.float32), draw(0.2, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(0.3, HIDDEN), np.zeros(1, np.float32))

    def halves(self, x: np.ndarray, again: np.ndarray) -> np.ndarray:
        rows = np.empty((len(x), WIDTH + 1), np.float32)
        rows[:, :WIDTH] = self.vectors[x]
        rows[:, WIDTH] = again
        return rows.reshape(-1, STEP * (WIDTH + 1))

    def chunks(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A filter's value for each chunk, which starts at a half; the last half of a document starts none."""
        got = h @ self.early
        got[:-1] += (h @ self.late)[1:]
        got[starts[1:] - 1] = -np.inf
        return got

    def head(self, pooled: np.ndarray):
        a = np.maximum(pooled + self.bias, 0)
        b = a @ self.dense + self.dense_bias
        return a, b, np.maximum(b, 0) @ self.out + self.out_bias[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, i = np.empty(len(texts)), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
                size += len(texts[j])
                j += 1
            out[i:j] = self._scores(texts[i:j])
            i = j
        return out

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:  # a very long text in pieces, with the same chunks
            t, pooled = texts[0], None
            for at in range(0, len(t), BLOCK):
                p = self._pooled([t[max(0, at - BEFORE) : at + BLOCK]], (BEFORE - STEP) // STEP if at else 0)
                pooled = p if pooled is None else np.maximum(pooled, p)
        else:
            pooled = self._pooled(texts)
        return 1 / (1 + np.exp(-np.clip(self.head(pooled)[2].astype(np.float64), -30, 30)))

    def _pooled(self, texts: list[bytes], skip: int = 0) -> np.ndarray:
        """Each filter's largest value; the first ``skip`` chunks only tell what comes before the others."""
        x, again, starts = laid_out(texts)
        got = self.chunks(self.halves(x, again), starts)
        got[:skip] = -np.inf
        return np.maximum.reduceat(got, starts[:-1], axis=0)

    def gradients(self, x: np.ndarray, again: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; a chunk that gives a filter's largest value gets its gradient."""
        h = self.halves(x, again)
        values = self.chunks(h, starts)
        best = np.stack([values[a:b].argmax(0) + a for a, b in zip(starts[:-1], starts[1:], strict=True)])  # [docs, filters]
        pooled = np.take_along_axis(values, best, 0)
        a, b, z = self.head(pooled)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)).astype(np.float32)
        db = dz[:, None] * self.out * (b > 0)
        da = db @ self.dense.T * (a > 0)
        grad = {"out": np.maximum(b, 0).T @ dz, "out_bias": dz.sum(keepdims=True), "dense": a.T @ db, "dense_bias": db.sum(0), "bias": da.sum(0)}
        first, second = h[best], h[best + 1]  # [docs, filters, inputs]
        grad["early"], grad["late"] = np.einsum("df,dfi->if", da, first), np.einsum("df,dfi->if", da, second)
        back = np.zeros_like(self.vectors)
        for side, w in ((best, self.early), (best + 1, self.late)):
            d = (da[:, :, None] * w.T[None]).reshape(-1, STEP, WIDTH + 1)[:, :, :WIDTH].reshape(-1, WIDTH)
            np.add.at(back, x.reshape(-1, STEP)[side].reshape(-1), d)
        back[PAD] = 0
        return grad | {"vectors": back}


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = 10, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Network:
    """Logistic loss, Adam, a rate that falls to a tenth."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    weights = vars(net)
    m, v = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    t = 0
    laid = [laid_out([x]) for x in texts]
    total = max(1, epochs * -(-len(texts) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            which = order[at : at + batch]
            x, again = np.concatenate([laid[i][0] for i in which]), np.concatenate([laid[i][1] for i in which])
            starts = np.append(0, np.cumsum([laid[i][2][1] for i in which]))
            grad = net.gradients(x, again, starts, labels[which])
            t += 1
            step = rate * (1 - 0.9 * t / total)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the key as text leaves 2 when divided by 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


#: Labelled rows that are learned from, at most: the least by a hash of their key, as long as their texts add up to no
#: more than so many bytes.
LEARNED, LEARNED_BYTES = 4000, 32 << 20


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", learned: int = LEARNED, learned_bytes: int = LEARNED_BYTES, seed: int = 5) -> Network:
    """A network from at most ``learned`` labelled rows, of ``learned_bytes``, that are not held out; without rows of
    both labels, it scores 0.5. Of rows that repeat a key, one is learned from: the least by a hash of its text."""
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null")
    known = known.filter(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(learned)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(known), "k").withColumn("h", F.xxhash64("t"))
    sizes = rows.groupBy("k").agg(F.min_by(F.octet_length("t"), "h").alias("n"), F.min("h").alias("h")).orderBy(F.xxhash64(F.lit(seed), "k"), "k").toPandas()
    some = sizes[sizes["n"].cumsum() <= learned_bytes]
    chosen = docs.sparkSession.createDataFrame([(int(k), int(h)) for k, h in zip(some["k"], some["h"], strict=True)], "k long, h long")
    got = rows.join(F.broadcast(chosen), ["k", "h"]).dropDuplicates(["k"]).select("k", "t", "y").toPandas().sort_values("k")
    texts = [t.encode() for t in got["t"]]
    if got["y"].nunique() > 1:
        return train(texts, got["y"].to_numpy(np.float32), seed=seed)
    net = Network.new(seed)
    net.out[:] = 0
    return net


def scored(net: Network):
    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                got = net.scores([t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), pa.array(got, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, net: Network, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null text is scored as an empty one. A null key is held out of nothing (held_out false) and kept as null.
    Repeated rows get the same score. An empty table gives no rows. Only the text enters the score.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    got = rows.mapInArrow(freed(scored(net)), "doc_id long, score double")
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeps(net: Network, at: int, threshold: float):
    def run(batches):
        for batch in batches:
            got = [net.scores([t or b"" for t in texts]) for _, texts in blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(got) >= threshold)) if got else batch

    return run


def keep_good(docs: DataFrame, net: Network, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches ``threshold``; all of them where nothing was learned."""
    if not net.out.any():
        return docs
    return docs.mapInArrow(freed(_keeps(net, docs.columns.index(text), threshold)), docs.schema)
