"""Exact Jaccard join of word-shingle sets by T-occurrence search with DivideSkip.

Sets with an overlap of T share one of their first n - T + 1 shingles under any order that all sets agree on. The
order used puts short inverted lists first: shingles that many documents hold (found by counting) come last, by
their counts. So a posting list is only built for the short lists of each document, as sorted binary runs that are
exchanged by hash range. Rows with equal sets are one class, which is one entry of a list.

Pairs that share a short list are first held against bounds: their sizes, what follows the shared shingle in both,
and 1,024 parity bits of each set, whose differing bits are differing shingles.

Links are found in two rounds. First, each entry of a list is paired with one earlier entry of each group that the
bounds allow, which takes as many pairs as entries; most of them are verified, and join groups of copies. Then every
two entries that lie in different components so far, and that the bounds allow, are verified. Pairs within a component
need no check where only components are asked for, so a group of copies costs what it has members, not pairs. Where
links are to be counted, every two entries that the bounds allow are verified, in one round.
Long lists are cut into blocks of entries of like size, and each two blocks are a group of their own.
Verification is T-occurrence search: a document's candidates form a small inverted index; its short lists are
heap-merged, its longest T - 1 lists only probed by binary search, and those that reach T stay.
"""

from __future__ import annotations

import heapq
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import U64, WordHashes, blocks, components, freed, kept, mixed, ngrams, shared_dir, stage

BASE = 0x9E3779B97F4A7C15
#: Documents counted together for long lists, and how many of them must hold a shingle.
COUNT_DOCS, COUNT_LEAST = 8192, 2
#: Long lists that are told apart, the longest: the bound of the one table that is broadcast (16 bytes each). What it
#: leaves out is ordered by hash; any order gives the same links.
MOST_LONG = 400_000
#: Bits of a set's parity.
PARITY = 1024
#: Postings for each hash range, and entries of a list after which it is cut into blocks.
RANGE_POSTINGS, BLOCK = 150_000, 20_000

_words = kept(WordHashes())


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or b"").lower().split() for t in texts]
    h = _words.of(list(chain.from_iterable(words)))
    grams, out, at = ngrams(h, n, BASE), [], 0
    for w in words:
        k = len(w)
        if k >= n:
            out.append(np.unique(grams[at : at + k - n + 1]))
        else:
            out.append(mixed(ngrams(h[at : at + k], k, BASE) ^ U64(k + 1)) if k else np.empty(0, U64))
        at += k
    return out


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of these sizes need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(s: np.ndarray) -> bytes:
    """For each of PARITY groups of hashes, whether the set holds an odd number of it."""
    return np.packbits(np.bincount((s >> U64(54)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()


PROFILE = "doc_id long, n long, f long, parity binary, hashes binary, counts binary"


def profiles(n: int):
    """Rows of documents (doc_id, n, f), and rows of shingles that several of some thousand documents hold."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 3 + [pa.array([None], pa.binary()), pa.array([h[many].tobytes()]), pa.array([c[many].astype("<i4").tobytes()])], ["doc_id", "n", "f", "parity", "hashes", "counts"])

        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                sets = shingle_sets(texts, n)
                nothing = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), nothing, nothing], ["doc_id", "n", "f", "parity", "hashes", "counts"])
                held += sets
                if len(held) >= COUNT_DOCS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    return run


def _spread(batches):
    """Packed (hashes, counts) -> a row for each."""
    for batch in batches:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<i8")), pa.array(np.frombuffer(c, "<i4").astype("<i8"))], ["h", "c"])


POSTINGS = "part int, n int, postings binary"
POSTING = np.dtype([("h", "<u8"), ("f", "<i8"), ("size", "<i4"), ("place", "<i4")])


def posting_runs(n: int, percent: int, parts: int, long_lists):
    """The short lists of each document, sorted, a row for each hash range."""

    def run(batches):
        by_hash, rank = long_lists.value  # sorted hashes, and their places in the order by count
        held, size, classes = [], 0, set()

        def rows():
            a = np.concatenate(held)
            a = a[np.argsort(a["h"], kind="stable")]
            cuts = np.append(np.searchsorted(a["h"], np.array([(i << 64) // parts for i in range(parts)], U64)), len(a)).tolist()
            got = [(i, y - x, a[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            c = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], ["part", "n", "postings"])

        for batch in batches:
            for _, texts in blocks(batch.column(1)):
                for s in shingle_sets(texts, n):
                    f = fingerprint(s)
                    if not len(s) or f in classes:  # equal sets are one entry
                        continue
                    classes.add(f)
                    p = prefix_length(len(s), percent)
                    if len(by_hash):
                        at = np.minimum(np.searchsorted(by_hash, s), len(by_hash) - 1)
                        long = by_hash[at] == s
                        first = s[~long][:p]
                        if len(first) < p:
                            first = np.concatenate([first, s[long][np.argsort(rank[at[long]])][: p - len(first)]])
                    else:
                        first = s[:p]
                    x = np.empty(len(first), POSTING)
                    x["h"], x["f"], x["size"], x["place"] = first, f, len(s), np.arange(len(first))
                    held.append(x)
                    size += len(x)
                if size > 1_000_000:
                    yield rows()
                    held, size, classes = [], 0, set()
        if held:
            yield rows()

    return run


#: ``number`` is 0 for the short lists of a range, else tells long ones apart; ``block`` and ``blocks`` are of those,
#: with the sizes of the block's sets.
LISTS = "part int, number int, block int, blocks int, low int, high int, n int, postings binary"


def shared_lists(most: int):
    """The lists of a hash range that several classes are on; those of over ``most`` entries in blocks by size."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.frombuffer(b, POSTING) for b in pdf["postings"]])
        h = np.sort(a["h"])
        several = h[1:][h[1:] == h[:-1]]  # far fewer than all; only those are sorted by class
        names = [x.split()[0] for x in LISTS.split(", ")]
        if not len(several):
            return pd.DataFrame([], columns=names)
        at = np.minimum(np.searchsorted(several, a["h"]), len(several) - 1)
        a = a[several[at] == a["h"]]
        a = a[np.lexsort((a["f"], a["h"]))]
        a = a[np.append(True, (a["h"][1:] != a["h"][:-1]) | (a["f"][1:] != a["f"][:-1]))]
        starts = np.flatnonzero(np.append(True, a["h"][1:] != a["h"][:-1]))
        count = np.diff(np.append(starts, len(a)))
        short = a[np.repeat((count > 1) & (count <= most), count)]
        rows = [(key[0], 0, 0, 1, 0, 0, len(short), short.tobytes())] if len(short) else []
        for number, (i, n) in enumerate(zip(starts[count > most].tolist(), count[count > most].tolist(), strict=True), 1):
            x = a[i : i + n]
            x = x[np.argsort(x["size"], kind="stable")]
            blocks = -(-n // most)
            for k in range(blocks):
                own = x[k * most : (k + 1) * most]
                rows.append((key[0], number, k, blocks, int(own["size"][0]), int(own["size"][-1]), len(own), own.tobytes()))
        return pd.DataFrame(rows, columns=names)

    return run


def in_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Blocks of long lists with each block (itself too) whose sizes allow a link: ``first`` and ``second`` block."""
    blocks = lists.select("part", "number", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high")).filter("number > 0")
    long = lists.filter("number > 0").join(blocks, ["part", "number"]).filter(f"100L * least(high, other_high) >= {percent}L * greatest(low, other_low) or block = other")
    long = long.select("part", "number", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "postings")
    return lists.filter("number = 0").select("part", "number", F.lit(0).alias("first"), F.lit(0).alias("second"), "block", "postings").union(long)


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


#: What a group of lists is told by.
KEYS = ["part", "number", "first", "second"]
MEMBERS = "part int, number int, block int, f long"


def _members(batches):
    """Lists -> the classes on each one's."""
    for batch in batches:
        for part, number, block, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 7)), strict=True):
            f = np.unique(np.frombuffer(b, POSTING)["f"])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(f), k, "i4")) for k in (part, number, block)), pa.array(f)], ["part", "number", "block", "f"])


def partners(percent: int, all_pairs: bool, within: bool = False):
    """The lists of a group and what is known of their classes (f, parity, component c) -> pairs to verify.

    Only pairs of different components (or, with ``within``, any) that sizes, places and parities allow. With
    ``all_pairs`` each of them; else for each entry one of each group that earlier pairs of its list would make. Of two
    different blocks, only pairs across.
    """

    def run(key, lists: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, "<i8"), np.empty(0, "<i8"))]
        if len(lists):
            known = members.drop_duplicates("f").sort_values("f")
            f_of, c_of = known["f"].to_numpy(), known["c"].to_numpy()
            bits_of = np.frombuffer(b"".join(known["parity"]), np.uint64).reshape(len(known), -1)
            x = np.concatenate([np.frombuffer(b, POSTING) for b in lists["postings"]])
            block = np.repeat(lists["block"].to_numpy(), [len(b) // POSTING.itemsize for b in lists["postings"]])
            order = np.lexsort((x["f"], x["size"], x["h"]))
            x, block, across = x[order], block[order], key[2] != key[3]
            row = np.searchsorted(f_of, x["f"])
            f, c, size = x["f"], c_of[row], x["size"].astype(np.int64)
            after = size - x["place"]
            starts = np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1]))
            some = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
            some |= within
            for i, j in zip(starts[some].tolist(), np.append(starts[1:], len(x))[some].tolist(), strict=True):
                group = c[i:j].copy()
                for k in range(i + 1, j):  # sizes ascend: those too small for k come first
                    lo = i + int(np.searchsorted(size[i:k], -(-percent * size[k] // 100)))
                    own = group[k - i]
                    place = np.arange(lo, k) if within else lo + np.flatnonzero(group[lo - i : k - i] != own)
                    if across:
                        place = place[block[place] != block[k]]
                    need = least_overlap(size[place], size[k], percent)
                    ok = np.minimum(after[place], after[k]) >= need
                    place, need = place[ok], need[ok]
                    differ = np.bitwise_count(bits_of[row[place]] ^ bits_of[row[k]]).sum(1)
                    place = place[differ <= size[place] + size[k] - 2 * need]
                    if not len(place):
                        continue
                    if not all_pairs:
                        met, first = np.unique(group[place - i], return_index=True)
                        place = place[first]
                        group[np.isin(group, met)] = own
                    out.append((f[place], np.full(len(place), f[k])))
        a, b = (np.concatenate([o[n] for o in out]) for n in (0, 1))
        return pd.DataFrame(dict(zip("ab", _distinct(a, b), strict=True)))

    return run


def divide_skip(query: np.ndarray, sets: list[np.ndarray], need: list[int]) -> list[int]:
    """The places of those of ``sets`` that share ``need`` or more values with ``query``; all are sorted and distinct."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    lo, hi = np.searchsorted(value, query), np.searchsorted(value, query, "right")
    longest = min(max(min(need) - 1, 0), len(query))  # so many lists are probed, not merged
    by_length = np.argsort(hi - lo, kind="stable")
    short, long = by_length[: len(query) - longest], np.sort(query[by_length[len(query) - longest :]])
    lists = [owner[a:b].tolist() for a, b in zip(lo[short].tolist(), hi[short].tolist(), strict=True) if b > a]
    kept = []
    for i, hits in groupby(heapq.merge(*lists)):
        n = sum(1 for _ in hits)
        if n >= need[i] - longest:
            s = sets[i]
            at = np.minimum(np.searchsorted(s, long), len(s) - 1)
            if n + int((s[at] == long).sum()) >= need[i]:
                kept.append(i)
    return kept


def verified(percent: int):
    """(a, b, set of a, set of b) -> the pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True), key=lambda r: r[0])
            got = []
            for a, own in groupby(rows, key=lambda r: r[0]):
                own = list(own)
                query, sets = np.frombuffer(own[0][2], U64), [np.frombuffer(r[3], U64) for r in own]
                need = [int(least_overlap(len(query), len(s), percent)) for s in sets]
                got += [(a, own[i][1]) for i in divide_skip(query, sets, need)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    return run


def packed_sets(n: int):
    def run(batches):
        for batch in batches:
            for _, texts in blocks(batch.column(1)):
                sets = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["f", "shingles"])

    return run


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, count_links: bool = False, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_shingles (its set's size), component_id (least doc_id reachable by links).

    With ``count_links`` also n_links, the other rows that it links with: all pairs that the bounds allow are then
    verified, also within a component.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a set holds the distinct runs of ``words``
    words, or the whole sequence where there are fewer. Documents link when 100 * intersection >= percent * union.
    A null, empty or blank text has an empty set and links with nothing. A row with a null key has a null component
    and takes no part; rows that repeat a key are one node. An empty table gives no rows. Other columns are ignored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "jaccard-join")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = stage(rows.mapInArrow(freed(profiles(words)), PROFILE), f"{path}/profiles")
    each = profile.filter("hashes is null").select("doc_id", "n", "f")
    total, postings = each.agg(F.count("*"), F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()
    counts = profile.filter("hashes is not null").select("hashes", "counts").mapInArrow(_spread, "h long, c long")
    counts = stage(counts.groupBy("h").agg(F.sum("c").alias("c")), f"{path}/counts")
    held = counts.count()
    if held > MOST_LONG:
        counts = counts.filter(F.col("c") > counts.approxQuantile("c", [1 - MOST_LONG / held], 0.001)[0])
    long = counts.toArrow()  # MOST_LONG rows at most, within the quantile's error
    h, c = long.column("h").to_numpy().view(U64), long.column("c").to_numpy()
    by_hash = np.argsort(h)
    rank = np.empty(len(h), np.int32)
    rank[np.lexsort((h, c))] = np.arange(len(h), dtype=np.int32)
    shared = spark.sparkContext.broadcast((h[by_hash], rank[by_hash]))

    parts = max(32, -(-(postings or 0) // RANGE_POSTINGS))
    keyed = rows.filter("doc_id is not null")
    runs = keyed.mapInArrow(freed(posting_runs(words, percent, parts, shared)), POSTINGS)
    lists = stage(runs.groupBy("part").applyInPandas(shared_lists(block), LISTS), f"{path}/lists")

    some = each.filter("doc_id is not null").groupBy("f").agg(F.min("doc_id").alias("doc_id"))
    marks = profile.filter("doc_id is not null").groupBy("f").agg(F.first("parity").alias("parity"))
    members = stage(lists.mapInArrow(_members, MEMBERS).join(marks, "f"), f"{path}/members")
    alone = lists.select("part", "number", F.col("block").alias("first"), F.col("block").alias("second"), "block", "postings")
    every = in_pairs(lists, percent)

    def pairs_of(groups: DataFrame, known: DataFrame | None, all_pairs: bool, name: str) -> DataFrame:
        if known is None:
            placed = members.withColumn("c", F.col("f"))
        else:
            placed = members.join(known.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("c", F.coalesce("component", "f")).drop("component")
        # short lists are a group as they are; the members of a block go with it
        short = placed.filter("number = 0").select("part", "number", F.lit(0).alias("first"), F.lit(0).alias("second"), "f", "parity", "c")
        where = groups.filter("number > 0").select(*KEYS, "block")
        placed = short.union(where.join(placed, ["part", "number", "block"]).select(*KEYS, "f", "parity", "c"))
        got = groups.groupBy(*KEYS).cogroup(placed.groupBy(*KEYS)).applyInPandas(partners(percent, all_pairs, count_links), "a long, b long")
        return stage(got.distinct(), f"{path}/{name}-pairs")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link. Sets are made anew from the texts of those asked for only."""
        asked = pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct()
        wanted = some.join(asked, "f").select("doc_id").distinct()
        # a key that repeats gives a set twice, which finds its links twice
        sets = keyed.join(wanted, "doc_id", "left_semi").mapInArrow(freed(packed_sets(words)), "f long, shingles binary")
        sets = stage(sets, f"{path}/{name}-sets")
        both = pairs.join(sets.select(F.col("f").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.join(sets.select(F.col("f").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
        return stage(both.mapInArrow(freed(verified(percent)), "a long, b long"), f"{path}/{name}-links")

    if count_links:
        links = check(pairs_of(every, None, True, "all"), "all")
    else:
        first = check(pairs_of(alone, None, False, "first"), "first")
        known = components(first, "jaccard-first")
        links = first.union(check(pairs_of(every, known, True, "second"), "second"))

    found = components(links, "jaccard-all").select(F.col("node").alias("f"), "component")
    classes = some.join(found, "f", "left").withColumn("component", F.coalesce("component", "f"))
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(names, "component").select("f", "component_id")
    counted = []
    if count_links:
        links = links.distinct()  # a key that repeats found its links twice
        sizes = each.filter("doc_id is not null").groupBy("f").agg(F.count("*").alias("rows"))
        ends = links.select(F.col("a").alias("f"), F.col("b").alias("g")).union(links.select("b", "a"))
        linked = ends.join(sizes.select(F.col("f").alias("g"), "rows"), "g").groupBy("f").agg(F.sum("rows").alias("others"))
        own = F.coalesce("others", F.lit(0)) + F.col("rows") - 1
        named = named.join(sizes, "f").join(linked, "f", "left").select("f", "component_id", own.alias("links"))
        takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        counted = [F.when(takes_part, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")]
    out = each.join(named, "f", "left")
    reached = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), reached).alias("component_id"), *counted)
