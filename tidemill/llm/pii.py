"""Personal data in texts: fixed patterns, and identifiers found by bootstrapping their contexts.

What the fixed patterns find are the seeds; strings that are built like a credential (a hexadecimal digest, a key with
a known beginning) are weak seeds of a fifth kind, ``secret``. Every seed and every other token that looks like an
identifier (it holds a digit or an @) is an instance. Its contexts are patterns: the two words before it, the word
before it if that ends in ``:`` or ``=``, the words on both sides, the two words after it.

Patterns and instances form a graph that Spark scores in rounds. A pattern is as good, for a kind, as the share of
what stands in it that is known to be of that kind: distinct instances, and every plain word of the whole corpus that
stands in the same context (counted in a second pass, for patterns with enough seeds). An instance becomes known by
the good patterns that lead to it, and makes other patterns good. Tokens that a good pattern leads to, that reach the
limit and that are built like the kind are new spans, though no fixed pattern matches them. Words that seeds happen to
stand next to also stand next to plain words, so they never gain a score.

Edges are distinct (pattern, instance) pairs of 64-bit hashes, so a passage that many documents repeat counts once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import U64, blocks, freed, kept, mixed, shared_dir, stage

KINDS = ("email", "ip", "card", "phone")
#: With what only bootstrapping finds.
ALL_KINDS = (*KINDS, "secret")
#: The contract's patterns. Digit runs are possessive and an address is found by its @, so that no text
#: takes more than linear time; the matches are the same.
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What a bootstrapped run needs: rounds, different seeds of a pattern, what a pattern's share is divided by besides
#: what stands in it, the score of a weak seed, and the scores from which a pattern is good and an instance is taken.
ROUNDS, LEAST_SEEDS, DOUBT, WEAK, GOOD_PATTERN, GOOD_INSTANCE = 3, 5, 1.0, 0.8, 0.6, 0.8

CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
WORD = re.compile(r"\S+")
EDGES = "\"'()[]{}<>,;:!?.#*&%$"
#: Credentials by their build: digests in hexadecimal, keys with a known beginning, signed tokens.
WEAK_SEED = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)")
#: How a token must be built to be taken for a kind, more loosely than the fixed patterns have it.
BUILT = (
    re.compile(r"[^@]+(?:@|[\[({]at[\])}])[^@]+"),
    re.compile(r"[0-9]+(?:[.:][0-9]+){3,}"),
    re.compile(r"(?=(?:-?[0-9]){12,19}\Z)[0-9-]+"),
    re.compile(r"(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*\Z)[+(]?[0-9]+[().0-9/-]*[().-][().0-9/-]*[0-9]"),
    re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}"),
)
#: Bits of the filter by which plain words in known contexts are told, in buckets of Spark's bitmaps: one megabyte.
FILTER_BITS, BUCKET_BITS = 23, 15
BASE = U64(0x9E3779B97F4A7C15)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[\x20-]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Words(dict):
    """A word -> a hash of its lower-case form without digits; the lowest bit tells a plain word (no digit, no @).

    The next bit tells whether it ends in : or =.
    """

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        plain = not any(c.isdigit() or c == "@" for c in word)
        h = xxhash.xxh3_64_intdigest(re.sub(r"[0-9]+", "0", word.lower()).encode("utf-8", "surrogatepass"))
        got = self[word] = h & ~3 | (word[-1] in ":=") << 1 | plain
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_words = kept(Words())


def contexts(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """[instances, 4]: the patterns of what stands at words ``first`` to ``last``; 0 where there is none."""
    around = np.concatenate([np.zeros(2, U64), h & ~U64(1), np.zeros(2, U64)])
    b2, b1, a1, a2 = around[first], around[first + 1], around[last + 3], around[last + 4]
    out = np.zeros((len(first), 4), U64)
    with np.errstate(over="ignore"):
        for k, (x, y, on) in enumerate(((b2, b1, (b2 > 0) & (b1 > 0)), (b1, b1, b1 & U64(2) > 0), (b1, a1, (b1 > 0) & (a1 > 0)), (a1, a2, (a1 > 0) & (a2 > 0)))):
            out[:, k] = np.where(on, mixed(mixed(x * BASE + U64(k + 1)) + y) | U64(1), U64(0))
    return out


def name_of(instance: str) -> int:
    return xxhash.xxh3_64_intdigest(instance.encode("utf-8", "surrogatepass")) - (1 << 63)


def instances(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind or "", kinds it is built like as bits, name) of the seeds and of other tokens with a digit or
    an @; the kind of a weak seed is ``secret``."""
    out = [(a, b, kind, 0, name_of(text[a:b])) for a, b, kind in base]
    starts, ends, reach = [a for a, _, _ in base], [], 0
    for _, b, _ in base:
        reach = max(reach, b)
        ends.append(reach)
    for m in CANDIDATE.finditer(text):
        token = m.group()
        a = m.start() + len(token) - len(token.lstrip(EDGES))
        b = m.end() - (len(token) - len(token.rstrip(EDGES)))
        i = bisect_right(starts, b - 1) - 1  # spans that start before this token's end
        if b - a >= 5 and not (i >= 0 and ends[i] > a) and any(c.isdigit() or c == "@" for c in text[a:b]):
            own = text[a:b]
            could = sum(1 << k for k, built in enumerate(BUILT) if built.fullmatch(own))
            out.append((a, b, "secret" if WEAK_SEED.fullmatch(own) else "", could, name_of(own)))
    return out


def patterns_of(text: str, found: list) -> np.ndarray:
    """[instances, 4]: the contexts of each of ``found`` (start, end, ...)."""
    places = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    h = _words.of(text.split()) if len(places) else np.empty(0, U64)
    if len(h) != len(places):  # where the two take different characters for white space
        h = _words.of([text[a:b] for a, b in places.tolist()])
    a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    return contexts(h, np.searchsorted(places[:, 0], a, "right") - 1, np.searchsorted(places[:, 0], b - 1, "right") - 1)


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, print long, base string, found array<struct<kind: string, start: int, end: int, could: int, instance: long, patterns: array<long>>>"
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("could", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
#: Bytes of text that are searched together.
SEARCHED = 4 << 20


def scan(batches):
    """(doc_id, print, text) -> FOUND. The print marks a row by its text, so that spans find their row again."""
    for batch in batches:
        for at, raw in blocks(batch.column(2), SEARCHED):
            base, found = [], []
            for t in raw:
                text = t.decode() if t else ""
                spans = base_spans(text)
                some = instances(text, spans)
                base.append(listed(spans))
                lists = [[x for x in row if x] for row in patterns_of(text, some).view(np.int64).tolist()] if some else []
                found.append([{"kind": k, "start": a, "end": b, "could": c, "instance": i, "patterns": p} for (a, b, k, c, i), p in zip(some, lists, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), batch.column(1).slice(at, len(raw)), pa.array(base), pa.array(found, SPAN)], ["doc_id", "print", "base", "found"])


def plain_words(wanted: np.ndarray):
    """Texts -> (pattern, n): how many plain words stand in contexts that the filter ``wanted`` may hold."""

    def run(batches):
        for batch in batches:
            for _, raw in blocks(batch.column(0), SEARCHED):
                out = []
                for t in raw:
                    h = _words.of(t.decode().split()) if t else ()
                    if len(h):
                        plain = np.flatnonzero(h & U64(1))
                        p = contexts(h, plain, plain).ravel()
                        bit = (p >> U64(64 - FILTER_BITS)).astype(np.int64)
                        out.append(p[(wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0) & (p > 0)])
                p, n = np.unique(np.concatenate(out), return_counts=True) if out else (np.empty(0, U64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n)], ["pattern", "n"])

    return run


def filter_of(patterns: DataFrame) -> np.ndarray:
    """A bit for each pattern's highest bits: 2^FILTER_BITS bits, whatever their number."""
    bit = F.shiftrightunsigned("pattern", 64 - FILTER_BITS)
    rows = patterns.select(F.shiftright(bit, BUCKET_BITS).alias("bucket"), F.pmod(bit, F.lit(1 << BUCKET_BITS)).alias("bit"))
    rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 256 buckets of 4 KB
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        at = r["bucket"] << (BUCKET_BITS - 3)
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def good_patterns(found: DataFrame, texts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (instance, kind, score) after the rounds. ``found``: kind, instance, pattern."""
    pairs = stage(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), f"{path}/edges")
    edges = pairs.select("pattern", "instance")
    seeds = pairs.filter("kind <> ''").groupBy("instance").agg(F.max("kind").alias("kind"))
    seeds = stage(seeds.withColumn("score", F.when(F.col("kind") == "secret", WEAK).otherwise(1.0)), f"{path}/seeds")
    # only patterns with enough seeds are ever scored, and what else stands in those is counted
    enough = edges.join(seeds, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS)
    enough = stage(enough.select("pattern", "kind"), f"{path}/enough")
    edges = stage(edges.join(enough.select("pattern").distinct(), "pattern"), f"{path}/scored-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    plain = texts.mapInArrow(freed(plain_words(filter_of(enough))), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("plain"))
    size = size.join(plain, "pattern", "left").select("pattern", (F.col("size") + F.coalesce("plain", F.lit(0)) + DOUBT).alias("size"))
    size = stage(size, f"{path}/sizes")
    known, patterns = seeds, None
    for i in range(ROUNDS):
        share = edges.join(known, "instance").join(enough, ["pattern", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        share = share.join(size, "pattern").withColumn("score", F.col("s") / F.col("size"))
        patterns = stage(share.filter(F.col("score") >= GOOD_PATTERN).select("pattern", "kind", "score"), f"{path}/patterns-{i}")
        led = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("score"))
        known = stage(seeds.union(led).groupBy("instance", "kind").agg(F.max("score").alias("score")), f"{path}/instances-{i}")
    return patterns, known


def _bootstrapped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, print, base), and its new spans (doc_id, print, new)."""
    path = shared_dir(docs.sparkSession, "pii")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("print"), F.col(text).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(freed(scan), FOUND), f"{path}/scan")
    each = rows.select("doc_id", "print", F.explode("found").alias("x")).select("doc_id", "print", "x.*")
    patterns, known = good_patterns(each.select("kind", "instance", F.explode("patterns").alias("pattern")), texts.select("text"), path)
    taken = known.filter(F.col("score") >= GOOD_INSTANCE).select("instance", "kind")
    led = patterns.select("pattern", "kind", F.col("score").alias("by"))
    # an occurrence is new where a good pattern leads to a taken instance; of two kinds, the better pattern's
    bit = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")).cast("int") - 1
    new = each.filter("kind in ('', 'secret')").drop("kind").withColumn("pattern", F.explode("patterns")).drop("patterns")
    new = new.join(led, "pattern").filter(F.getbit("could", bit) == 1).join(taken, ["instance", "kind"])
    new = new.groupBy("doc_id", "print", "start", "end").agg(F.max_by("kind", F.struct("by", "kind")).alias("kind"))
    new = new.groupBy("doc_id", "print").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("new"))
    return rows.select("doc_id", "print", "base"), stage(new, f"{path}/new")


ALL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_new long"


def merge(base: str, new: list | None) -> list[tuple[int, int, str]]:
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base.split(",") if x)]
    return sorted(spans + [(x["start"], x["end"], x["kind"]) for x in new or []], key=lambda s: (s[0], ALL_KINDS.index(s[2])))


def summed(batches):
    for batch in batches:
        out = []
        for doc, base, new in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            kinds = [x.split(":")[0] for x in base.split(",") if x]
            out.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(merge(base, new)), len(new or ())))
        c = list(zip(*out, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], pa.string()), pa.array(c[6], pa.string()), pa.array(c[7], pa.int64())], [x.split()[0] for x in ALL.split(", ")])


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_new.

    Counts and ``base_sha256`` are of the fixed patterns' spans; ``spans`` also holds the bootstrapped ones, n_new
    of them. A null or empty text has none (the digest is that of nothing). Rows with equal key and text have equal
    spans; a null key stays null. An empty table gives no rows. Other columns are ignored.
    """
    rows, new = _bootstrapped(docs, key, text)
    got = rows.join(new, (rows["doc_id"].eqNullSafe(new["doc_id"])) & (rows["print"] == new["print"]), "left").select(rows["doc_id"], rows["base"], new["new"])
    return got.mapInArrow(freed(summed), ALL)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind; of spans that overlap, the one that starts first names them."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def without_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; ``size``, if there, follows.

    No row goes. A null text stays null.
    """
    _, new = _bootstrapped(docs, key, text)
    names = docs.columns
    at = names.index(text)
    extra = new.select(F.col("doc_id").alias("_pii_doc"), F.col("print").alias("_pii_mark"), F.col("new").alias("_pii_new"))
    some = docs.withColumn("_pii_mark_of", F.xxhash64(F.col(text).cast("string")))
    joined = some.join(extra, some[key].cast("long").eqNullSafe(extra["_pii_doc"]) & (some["_pii_mark_of"] == extra["_pii_mark"]), "left").select(*[some[c] for c in names], "_pii_new")
    n = names.index(size) if size in names else None

    def run(batches):
        for batch in batches:
            for start, raw in blocks(batch.column(at), SEARCHED):
                part = batch.slice(start, len(raw))
                texts = [t if t is None else t.decode() for t in raw]
                done = [t and redact(t, merge(listed(base_spans(t)), x)) for t, x in zip(texts, part.column(len(names)).to_pylist(), strict=True)]
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = pa.array(done, pa.string())
                if n is not None:
                    columns[n] = pa.array([old if t is None else len(t) for t, old in zip(done, columns[n].to_pylist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(freed(run), docs.schema)
