"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann, jaccard_join, mixing, near_vectors, piece_sampling, pii, quality, substring_dedup, token_output, warc
from tidemill.llm._shared import components, ngrams

tokenizers_path = pytest.importorskip("public_tokenizers").path
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, w string"


def make_docs(seed: int = 0, n: int = 60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(50))
    for i in range(0, n, 9):
        texts[i] = texts[i] + " " + passage + " " + texts[i + 1][:40]
    texts[5] = texts[6]
    texts[7] = texts[8].replace("alpha", "ALPHA") + " extra"
    texts[11] = "In " * 80
    texts += [None, "", " \t\n ", "one", "a b c", "x" * 5000, passage, passage, "tailé 日本 " * 30]
    rows = [(i, t, "en", f"src{0 if i % 3 else i % 5}", len(t or ""), i, "w") for i, t in enumerate(texts)]
    rows.append((None, "a text without a key", None, None, None, 1, "w"))
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_ngrams_are_those_of_a_plain_polynomial():
    h = np.random.default_rng(0).integers(0, 1 << 62, 50).astype(np.uint64)
    for n in (1, 2, 5, 35):
        assert len(ngrams(h, n, 31)) == 51 - n
        assert ngrams(h, n, 31)[3] == ngrams(h[3 : 3 + n], n, 31)[0]
    assert len(ngrams(h[:2], 3, 31)) == 0


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[k] == 5 for k in range(200, 260)) and got[9] == 8
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


# --- 1


def test_mixture_keeps_every_window_and_differs_by_less_than_a_block(spark):
    sizes = {"a": 700, "b": 200, "c": 100, None: 24}
    rows = [(i, s, "x") for i, s in enumerate(itertools.chain.from_iterable([k] * n for k, n in sizes.items()))]
    df = spark.createDataFrame(rows, "doc_id long, source string, w string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "": 0.05}
    got = mixing.pfair_mix(df, weights=weights, block_rows=4, period=20).toPandas()
    assert sorted(got["doc_id"]) == list(range(1024)) and got["mix_position"].is_unique
    assert ((got["mix_slot"] >= got["mix_release"]) & (got["mix_slot"] < got["mix_deadline"])).all()
    blocks = got[got["in_mix"]].drop_duplicates("mix_slot").sort_values("mix_slot")
    assert blocks["mix_slot"].tolist() == list(range(len(blocks)))
    share = {k: round(w * 20) for k, w in weights.items()}
    done = collections.Counter()
    for t, source in enumerate(blocks["source"].fillna(""), 1):
        done[source] += 1
        assert all(abs(done[k] - t * share[k] / 20) < 1 for k in share)


def test_mixture_of_nothing_clashing_names_and_repeats(spark, docs):
    assert mixing.pfair_mix(docs.limit(0)).count() == 0
    got = mixing.pfair_mix(docs.withColumn("mix_slot", F.lit("old")))
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert mixing.in_mixed_order(docs).columns == docs.columns
    a, b = (mixing.pfair_mix(docs.repartition(k)).orderBy("mix_position").select("mix_position", "text").collect() for k in (1, 5))
    assert a == b


def test_null_keys_and_repeats_are_spread_and_blocks_are_bounded(spark, monkeypatch):
    df = spark.range(400).selectExpr("if(id % 2 = 0, null, 7L) as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "id as other")
    got = mixing.pfair_mix(df, block_rows=4)
    assert got.select("mix_position").distinct().count() == got.count() == 400
    firsts = got.filter("source = 'b'").orderBy("mix_position").select("other").collect()
    assert [r["other"] for r in firsts] != sorted(r["other"] for r in firsts)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    assert mixing.pfair_mix(df).select("mix_block", "source").distinct().count() <= 12


def test_mixture_follows_unrounded_weights_over_many_slots_and_sources(spark):
    sizes = {"hot": 17_000} | {f"s{i:02}": 1_700 for i in range(19)}
    total = sum(n**0.5 for n in sizes.values())
    rows = [(s, n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "source string, n int").selectExpr("source", "explode(sequence(1, n)) as k").selectExpr("xxhash64(source, k) as doc_id", "source")
    got = mixing.pfair_mix(df, block_rows=1).filter("in_mix").select("mix_slot", "source").toPandas().sort_values("mix_slot")
    assert len(got) > 20_000 and got["mix_slot"].tolist() == list(range(len(got)))
    t = np.arange(1, len(got) + 1)
    for s, n in sizes.items():
        assert (abs((got["source"] == s).cumsum() - t * n**0.5 / total) < 1.001).all()
    many = spark.range(2_200).selectExpr("id as doc_id", "concat('s', id % 1100) as source")
    got = mixing.pfair_mix(many, block_rows=1).toPandas().sort_values("mix_slot")
    assert len(got) == 2_200 and got["mix_position"].is_unique and got["in_mix"].all()
    assert all(got["source"][k : k + 1100].nunique() == 1100 for k in (0, 1100))
    few = spark.range(60).selectExpr("id as doc_id", "concat('s', id % 5) as source")
    left = mixing.pfair_mix(few, weights={"s1": 2.0, "s2": 1.0}, block_rows=1).toPandas()
    assert len(left) == 60 and left["mix_position"].is_unique
    assert left[left["in_mix"]]["source"].value_counts()["s1"] == 12


# --- 2


def test_quality_learns_held_out_rows_and_covers_the_whole_text(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 80)))
    bad = lambda: good() + " " + " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (None, good()), (3, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels)
    got = quality.quality_scores(df, net).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    own = got[got["doc_id"] < 400]
    assert ((zlib.crc32(str(int(i)).encode()) % 4 == 2) == h for i, h in zip(own["doc_id"], own["held_out"], strict=True))
    held = own[own["held_out"]]
    assert ((held["doc_id"] % 4 > 0) == (held["predicted"] == 1)).mean() > 0.9
    tail = "alpha " * 20_000 + "BETA!! " * 30
    assert net.scores([tail.encode()])[0] < net.scores([b"alpha beta gamma delta iota"])[0]
    assert quality.keep_good(df, net).columns == df.columns
    assert quality.quality_scores(df.limit(0), net).count() == 0
    unlearned = quality.fit(df, labels.limit(0))
    assert np.allclose(unlearned.scores([b"", b"abc"]), 0.5)


def test_quality_scores_do_not_depend_on_what_stands_beside():
    net = quality.Network.new(3)
    texts = [b"", b"a", b"hello world " * 50, bytes(range(1, 200)), b"zz\0zz"]
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6)


def naive_score(net, text):
    """One chunk, one filter and one byte at a time."""
    size = max(2, -(-len(text) // quality.STEP)) * quality.STEP
    data = text.ljust(size, b"\0")

    def recurs(i):
        if data[i] == 0 or i < 8:
            return False
        return any(i - lag >= 3 and data[i - 3 : i + 1] == data[i - lag - 3 : i - lag + 1] for lag in quality.LAGS)

    inputs = [[*net.vectors[data[i] or quality.PAD], float(recurs(i))] for i in range(size)]
    halves = [np.concatenate(inputs[i : i + quality.STEP]) for i in range(0, size, quality.STEP)]
    pooled = [max(float(np.dot(a, net.early[:, f]) + np.dot(b, net.late[:, f])) for a, b in itertools.pairwise(halves)) for f in range(quality.FILTERS)]
    a = [max(0.0, p + float(b)) for p, b in zip(pooled, net.bias, strict=True)]
    b = [max(0.0, sum(a[i] * float(net.dense[i, j]) for i in range(len(a))) + float(net.dense_bias[j])) for j in range(quality.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(x * float(w) for x, w in zip(b, net.out, strict=True)) + float(net.out_bias[0]))))


def test_quality_scores_are_those_of_a_plain_convolution(monkeypatch):
    net, rng = quality.Network.new(7), random.Random(3)
    net.bias[:] = 0.3
    texts = [b"", b"a", b"abc abc abc abc abc", "häuser über äcker".encode() * 4, bytes(rng.choice(b"ab \0") for _ in range(300))]
    assert np.allclose(net.scores(texts), [naive_score(net, t) for t in texts], atol=1e-5)
    long = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (4096, 5000, 6151)]
    whole = net.scores(long)
    monkeypatch.setattr(quality, "BLOCK", 1024)
    assert np.allclose(net.scores(long), whole, rtol=0, atol=1e-6)
    planted = b"q" * 1020 + b"zebrazebrazebra" + b"q" * 3000  # across the border of two pieces
    assert np.allclose(net.scores([planted]), naive_score(net, planted), atol=1e-5)


def test_quality_gradients_are_differences_of_the_loss():
    net = quality.Network.new(2)
    texts, labels = [b"good words stand here in a row", b"BAD!! BAD!! words", b"more of it", b""], np.array([1, 0, 1, 0], np.float32)
    for name, w in vars(net).items():
        vars(net)[name] = w.astype(np.float64)
    net.bias += 0.05  # an empty text is not where the loss has no slope
    net.dense_bias += 0.03

    def loss():
        x, again, starts = quality.laid_out(texts)
        rows = np.concatenate([net.vectors[x], again[:, None]], axis=1).reshape(-1, quality.STEP * (quality.WIDTH + 1))
        z = net.head(np.maximum.reduceat(net.chunks(rows, starts), starts[:-1], axis=0))[2]
        return float(np.mean(np.log1p(np.exp(-np.where(labels > 0, z, -z)))))

    grads, rng = net.gradients(*quality.laid_out(texts), labels), np.random.default_rng(1)
    for name, g in grads.items():
        w = vars(net)[name]
        for at in rng.integers(0, w.size, 12):
            if name == "vectors" and at // quality.WIDTH == quality.PAD:
                continue
            was, h = w.flat[at], 1e-5
            w.flat[at] = was + h
            up = loss()
            w.flat[at] = was - h
            down = loss()
            w.flat[at] = was
            assert abs((up - down) / (2 * h) - g.flat[at]) < 1e-4, name


def test_what_is_learned_from_is_bounded(spark):
    rows = [(i % 50, f"text {i} " * (1 + i % 7), "x", 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    real, quality.train = quality.train, lambda texts, y, seed: seen.append(texts) or quality.Network.new(seed)
    try:
        quality.fit(df, labels, learned_bytes=300)
        quality.fit(df, labels, learned=10)
    finally:
        quality.train = real
    assert 0 < sum(map(len, seen[0])) <= 300 and 1 < len(seen[1]) <= 10
    assert quality.quality_scores(df, quality.Network.new(1)).columns == ["doc_id", "held_out", "score", "predicted"]


# --- 3


def paths_of(table, node):
    if node < 0:
        return [((), 0.0)]
    first, count = table.first[node], table.count[node]
    return [((int(table.piece[e]), *s), table.logp[e] + p) for e in range(first, first + count) for s, p in paths_of(table, table.next[e])]


def test_sampled_segmentations_follow_the_lattice_without_replacement():
    table = piece_sampling.Lattices(tokenizers_path("piece_bpe_32k.model"))
    nodes = table.of(["abc", "de"])
    every = collections.defaultdict(float)
    for (a, p), (b, q) in itertools.product(paths_of(table, nodes[0]), paths_of(table, nodes[1])):
        every[a + b] += np.exp(p + q)
    assert abs(sum(every.values()) - 1) < 1e-9
    n = 4000
    got = piece_sampling.top_k(table, ["abc de"] * n, np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    first = collections.Counter(tuple(x[0][0].tolist()) for x in got)
    best = max(every, key=every.get)
    assert abs(first[best] / n - every[best]) < 0.03
    for x in got[:200]:
        assert len({tuple(y[0].tolist()) for y in x}) == 3 and x[0][2] > x[1][2] > x[2][2]
        assert all(abs(lp - np.log(every[tuple(i.tolist())])) < 1e-9 for i, lp, _, _, _ in x)
        assert all(abs(np.exp(log_w) - w) < 1e-12 for _, _, _, w, log_w in x)
    # inverse inclusion scores estimate the whole mass
    assert abs(np.mean([sum(np.exp(lp) / w for _, lp, _, w, _ in x) for x in got]) - 1) < 0.02


def test_few_segmentations_are_all_given_however_unlikely():
    table = piece_sampling.Lattices(tokenizers_path("piece_bpe_32k.model"))
    for word in ("ab", "the"):
        paths = paths_of(table, table.of([word])[0])
        got = piece_sampling.top_k(table, [word], np.array([3], np.uint64), 50)[0]
        assert {tuple(x[0].tolist()) for x in got} == {p for p, _ in paths} and all(x[3] == 1 and x[4] == 0 for x in got)
    first, n = table.first[table.of(["the"])[0]], table.count[table.of(["the"])[0]]
    assert n > 1
    table.logp[first : first + n] = [-1e-18, *[-42.0] * (n - 1)]  # all but one next to impossible
    table.cdf[first : first + n] = 1.0
    table.rest[first : first + n] = piece_sampling.others(np.exp(table.logp[first : first + n]), np.array([0]), np.array([n]))
    assert len(piece_sampling.top_k(table, ["the"], np.array([3], np.uint64), 50)[0]) == len(paths)


def test_a_full_table_of_lattices_is_used_again_and_words_do_not_change_each_other(monkeypatch):
    monkeypatch.setattr(piece_sampling, "EDGE_TABLE", 20_000)
    table = piece_sampling.Lattices(tokenizers_path("piece_bpe_32k.model"))
    odd = ["internationalisation", "", "\u2581x\u2581", "\U0001f600\U00013000", "aé" * 50, piece_sampling.CONTINUES + "\u2581theatre"]

    def edges(node):  # of the first node and those that follow each longest piece
        while node >= 0:
            e = slice(table.first[node], table.first[node] + table.count[node])
            yield table.piece[e].tolist(), table.logp[e].tolist(), table.cdf[e].tolist(), table.rest[e].tolist()
            node = table.next[e][0]

    found, rooms = [], []
    for turn in range(8):  # each fills the table
        table.of([f"word{turn}x{i}ing" for i in range(3000)])
        found.append([list(edges(v)) for v in table.of([*odd, *(f"other{i}{turn}" for i in range(500))])[: len(odd)]])
        rooms.append(table.cdf)
    assert all(x == found[0] for x in found)
    assert all(x is rooms[2] for x in rooms[3:])
    table.clear()
    assert not table.words and not len(table.cdf)


def test_a_worker_that_samples_pieces_takes_little_memory():
    import subprocess
    import sys

    code = """
import random, re, threading, time
import pyarrow as pa
import public_tokenizers
from tidemill.llm import piece_sampling as ps

def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(1)
parts = ["th", "er", "in", "on", "an", "ed", "tion", "ing", "es", "at"]
word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 7)))
texts = [" ".join(word() for _ in range(500)) for _ in range(2500)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
ps.lattices(path)
del texts
most, start = 0.0, anon()

def watch():
    global most
    while True:
        most = max(most, anon() - start)
        time.sleep(0.02)

threading.Thread(target=watch, daemon=True).start()
n = sum(len(x) for x in ps.sampled(path, 2, 23, True)([batch]))
print(n, most)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert int(out[0]) == 5000 and float(out[1]) < 160, out


def test_sampled_pieces_give_every_text_back(spark, docs):
    odd = [(898, "internationalisation of " * 3000), (899, "aé" * 100_000 + " b"), (900, "\U0001f600"), (901, "▁ a▁b"), (902, "\U00013000x\U00013001"), (903, "tab\t and\nline")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    model = tokenizers_path("piece_bpe_32k.model")
    got = piece_sampling.sample_pieces(df, model=model, ids=True).toPandas()
    assert got["decodes"].all() and (got["inclusion"] <= 1).all() and np.isfinite(got["log_inclusion"]).all() and (got["log_inclusion"] <= 0).all()
    assert got.loc[got["doc_id"] == 898, "log_inclusion"].min() < -100
    assert got.groupby("doc_id").size().max() <= 4 and set(got["doc_id"].dropna()) == {r["doc_id"] for r in df.collect() if r["doc_id"] is not None}
    again = piece_sampling.sample_pieces(df.repartition(7), model=model, ids=True).toPandas()
    key = lambda t: sorted((str(r.doc_id), r.sample, tuple(r.piece_ids)) for r in t.itertuples())
    assert key(got) == key(again)
    assert piece_sampling.sample_pieces(df.limit(0), model=model).count() == 0


# --- 4

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_fixed_patterns_are_those_of_plain_regular_expressions():
    rng = random.Random(2)
    texts = ["a@b.c@d.e f", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111", "+1 (2) 33-44.55 6677", "x@y a.b@c-d.e"]
    texts += ["".join(rng.choice("ab129.@+ -()") for _ in range(50)) for _ in range(2000)]
    assert all(pii.listed(pii.base_spans(t)) == plain_spans(t) for t in texts)


def naive_new_spans(texts):
    """Bootstrapping on strings, dictionaries and lists: (text, start, end, kind) of what is new."""
    plain = lambda w: re.sub(r"[0-9]+", "0", w.lower())

    def around(words, i, j):
        at = lambda k: plain(words[k]) if 0 <= k < len(words) else None
        out = [("bb", at(i - 2), at(i - 1)), ("b", at(i - 1)), ("ba", at(i - 1), at(j + 1)), ("aa", at(j + 1), at(j + 2))]
        return [p for p in out if None not in p and (p[0] != "b" or p[1][-1] in ":=")]

    seen, edges, filler = [], collections.defaultdict(dict), collections.Counter()
    for n, text in enumerate(texts):
        words, places = text.split(), [m.span() for m in re.finditer(r"\S+", text)]
        for a, b, kind, could, _ in pii.instances(text, pii.base_spans(text)):
            i, j = (max(k for k, (x, _) in enumerate(places) if x <= c) for c in (a, b - 1))
            seen.append((n, a, b, kind, could, around(words, i, j)))
            for p in seen[-1][5]:
                edges[p][text[a:b]] = max(kind, edges[p].get(text[a:b], ""))
        for i, w in enumerate(words):
            if not any(c.isdigit() or c == "@" for c in w):
                filler.update(around(words, i, i))
    seeds = {}
    for own in edges.values():
        for x, kind in own.items():
            seeds[x] = max(kind, seeds.get(x, ""))
    seeds = {x: {kind: pii.WEAK if kind == "secret" else 1.0} for x, kind in seeds.items() if kind}
    enough = {(p, k) for p, own in edges.items() for k in pii.ALL_KINDS if sum(k in seeds.get(x, ()) for x in own) >= pii.LEAST_SEEDS}
    known = seeds
    for _ in range(pii.ROUNDS):
        good = {(p, k): sum(known.get(x, {}).get(k, 0) for x in edges[p]) / (len(edges[p]) + filler[p] + pii.DOUBT) for p, k in enough}
        good = {pk: s for pk, s in good.items() if s >= pii.GOOD_PATTERN}
        led = {x: dict(v) for x, v in seeds.items()}
        miss = collections.defaultdict(lambda: 1.0)
        for (p, k), s in good.items():
            for x in edges[p]:
                miss[x, k] *= 1 - min(s, 0.999)
        for (x, k), m in miss.items():
            led.setdefault(x, {})[k] = max(led.get(x, {}).get(k, 0), 1 - m)
        known = led
    out = set()
    for n, a, b, kind, could, own in seen:
        if kind in ("", "secret"):
            by = [(good[p, k], k) for p in own for k in pii.ALL_KINDS if (p, k) in good and could >> pii.ALL_KINDS.index(k) & 1 and known.get(texts[n][a:b], {}).get(k, 0) >= pii.GOOD_INSTANCE]
            if by:
                out.add((n, a, b, max(by)[1]))
    return out


def test_bootstrapping_is_that_of_dictionaries(spark):
    rng = random.Random(12)
    words = ["the", "of", "and", "to", "rate", "is", "von", "que"]
    digest = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [*[lambda: f"token = \"{digest(40)}\""] * 6, lambda: f"TOKEN = \"{digest(40).upper()}\"", lambda: f"key: {digest(20)}x1", lambda: f"mail to me{rng.randrange(99)}@a.example.com please", lambda: f"mail to you{rng.randrange(99)}@host please", lambda: str(rng.randrange(10**9)), lambda: f"server 10.0.{rng.randrange(300)}.{rng.randrange(300)} down", lambda: digest(40)]
    texts = [" ".join(rng.choice(made)() if rng.random() < 0.12 else rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(150)]
    want = naive_new_spans(texts)
    assert {k for *_, k in want} >= {"secret", "email", "ip"}
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    base = {r["doc_id"]: set(pii.listed(pii.base_spans(texts[r["doc_id"]])).split(",")) for r in got}
    new = {(r["doc_id"], int(a), int(b), k) for r in got for k, a, b in (x.split(":") for x in set(r["spans"].split(",")) - base[r["doc_id"]] if x)}
    assert new == want and sum(r["n_new"] for r in got) == len(want)


def test_a_long_text_without_spaces_and_long_identifiers(spark):
    long = "x" * 300 + "7"
    rows = [(i, f"auth code = {'q' * 90}{i}{i} end") for i in range(8)] + [(20, "a1" * 60_000), (21, "@" * 5000 + "1.2.3.4"), (22, long)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 11 and got[21]["n_ip"] == 1 and got[22]["spans"] == ""


def test_contexts_of_seeds_find_what_no_pattern_matches(spark):
    rows = [(i, f"filler {i} please write to user{i}@mail.example.com now") for i in range(12)]
    rows += [(50 + i, f"other {i} please write to handle{i}[at]mail today") for i in range(3)]
    rows += [(100, None), (101, ""), (102, "room 12345 here"), (None, "write to a@b.cd"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect() if r["doc_id"] is not None}
    assert pii.find_pii(df).count() == len(rows)
    assert all(got[i]["n_email"] == 1 and got[i]["n_new"] == 0 for i in range(12))
    assert all(got[50 + i]["n_new"] == 1 and got[50 + i]["n_email"] == 0 and got[50 + i]["spans"].startswith("email:") for i in range(3))
    assert got[102]["spans"] == "" and got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.without_pii(df).collect()}
    assert clean[0] == "filler 0 please write to <EMAIL> now" and "handle" not in clean[50] and clean[100] is None
    assert pii.find_pii(df.limit(0)).count() == 0


# --- 5


def plain_dedup(rows, window):
    texts = [words_of(t) for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [7, 35])
def test_windows_that_start_twice_go(spark, docs, window):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring_dedup.substring_dedup(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows, window)


def test_batches_compaction_and_growing_ranges_agree_with_one_load(spark, docs):
    keyed = docs.filter("doc_id is not null")
    rows = [(r["doc_id"], r["text"]) for r in keyed.collect()]
    want = plain_dedup(rows, 7)
    read = lambda job: sorted(map(tuple, job.result().select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    # ranges are halved again and again, as each is for 200 bytes of text
    job = substring_dedup.SubstringDedup(spark, window=7, gram=4, range_bytes=200, least_parts=2)
    parts = []
    for k in range(5):
        job.add(keyed.filter(F.col("doc_id") % 5 == k))
        parts.append(job.parts)
    assert parts == sorted(parts) and parts[-1] > parts[0] and job.index.compacted >= 1
    assert read(job) == want
    for batches in (1, 3):
        job = substring_dedup.SubstringDedup(spark, window=7, gram=4)
        job.add(keyed, batches=batches)
        assert read(job) == want
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_an_earlier_chunk_is_told_once_when_its_anchor_comes_again(spark):
    text = " ".join(f"w{i}" for i in range(40))
    job = substring_dedup.SubstringDedup(spark, window=35, gram=20)
    told = []
    for k, t in enumerate([text, "other words", text, "x " + text, text]):
        (hot,) = job.add(spark.createDataFrame([(k, t)], "doc_id long, text string"))
        told.append({r["chunk"] >> 54 for r in hot.collect()})
    assert told == [set(), set(), {0, 2}, {3}, {4}] and job.index.compacted == 2
    assert {r["doc_id"]: r["n_removed"] for r in job.result().collect()} == {0: 40, 1: 0, 2: 40, 3: 40, 4: 40}


# --- 6, 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:130] = x[100] + 0.05 * rng.standard_normal((30, 16))
    x[200:205] = x[200]
    rows = [(i, [float(v) for v in x[i]], i % 3 if i < 100 or i >= 130 else 1, "w") for i in range(300)]
    rows += [(400, None, 1, "w"), (401, [0.0] * 16, 1, "w"), (402, [float("nan")] + [1.0] * 15, 1, "w"), (403, [1.0, None] + [1.0] * 14, 1, "w"), (404, [1.0] * 8, 1, "w"), (405, rows[100][1], None, "w"), (None, rows[100][1], 1, "w")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")


def plain_vectors(vectors):
    rows = [r for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 16 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    x = np.array([r["embedding"] for r in rows])
    return [r["vec_id"] for r in rows], x / np.linalg.norm(x, axis=1, keepdims=True), [r["label"] for r in rows]


def test_neighbours_and_their_recall(spark, vectors):
    ids, x, _ = plain_vectors(vectors)
    got = ann.nearest_neighbours(vectors, F.col("vec_id") % 10 == 0).toPandas()
    hits = total = 0
    for q, own in got.groupby("query_id"):
        i = ids.index(q)
        s = np.where(np.array(ids) == q, -9, x @ x[i])
        best = np.lexsort((ids, -s.round(12)))[:5]
        assert own.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own["vec_id"])
        assert np.allclose([s[ids.index(v)] for v in own["vec_id"]], own["score"])
        hits += len({ids[k] for k in best} & set(own["vec_id"]))
        total += 5
    assert total == 5 * 30 and hits / total >= 0.9
    assert ann.nearest_neighbours(vectors.limit(0), F.lit(True)).count() == 0
    few = vectors.filter("vec_id < 3")
    assert ann.nearest_neighbours(few, F.col("vec_id") == 0).count() == 2


def test_equal_scores_go_to_the_smaller_key_and_lists_are_topped_up(spark):
    rng = np.random.default_rng(5)
    far = [(i, [float(v) for v in rng.standard_normal(8) * 0.01 + np.eye(8)[i % 8]]) for i in range(400)]
    same = [(1000 - i, [2.0**i, *[0.0] * 6, -(2.0**i)]) for i in range(9)]
    df = spark.createDataFrame([*far, *same, same[0], (1001, [-1.0] * 8)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") >= 990, k=5).toPandas().sort_values(["query_id", "rank"])
    assert got.loc[got["query_id"] == 1000, "vec_id"].tolist() == [992, 993, 994, 995, 996]
    assert (got.groupby("query_id").size() == 5).all() and got["query_id"].nunique() == 10
    all_of = ann.nearest_neighbours(df, F.col("vec_id") == 1001, k=600).toPandas().sort_values("rank")
    assert sorted(all_of["vec_id"]) == [*range(400), *range(992, 1001)] and all_of["rank"].tolist() == list(range(1, 410))
    assert all_of["score"].is_monotonic_decreasing


@pytest.mark.parametrize("name", ["embeddings"])
def test_recall_on_the_drivers_table(spark, name):
    rows = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(rows, F.col("vec_id") % 5 == 0).collect()}
    ids, x, _ = [np.array(c) for c in zip(*((r["vec_id"], r["embedding"], 0) for r in rows.collect()), strict=True)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 5 == 0) for j in np.argsort(-np.where(ids == ids[i], -9, x @ x[i]), kind="stable")[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_one_of_two_vectors_within_the_radius_probes_the_others_list():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = float(np.sqrt(2 - 2 * 0.93))
    z = near_vectors.Quantiser(x, 200, r, 1)
    y = x + rng.standard_normal(x.shape)
    y = x + (y - x) / np.linalg.norm(y - x, axis=1, keepdims=True) * r * rng.random((len(x), 1)) ** 0.1
    hx, hy = (near_vectors.nearest(v, z.lists) for v in (x, y))
    px, py = z.probes(x, hx), z.probes(y, hy)
    rows = np.arange(len(x))
    assert (px[rows, hy] | py[rows, hx]).all() and (hx != hy).sum() > 300
    assert px.mean() < 0.25
    assert np.array_equal(z.probe(np.repeat(x[:50], 200, axis=0), np.repeat(hx[:50], 200), np.tile(np.arange(200), 50)), px[:50].ravel())


def test_links_of_vectors_are_those_of_all_pairs(spark, vectors):
    ids, x, labels = plain_vectors(vectors)
    parent = {i: i for i in ids}
    links = collections.Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if labels[a] is not None and labels[a] == labels[b] and x[a] @ x[b] >= 0.93:
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = sorted((root(ids[a]), root(ids[b])))
            parent[q] = p
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(vectors, least=0.93).collect()}
    assert len(got) == vectors.count()
    for r in vectors.collect():
        i = r["vec_id"]
        want = (links[i], root(i)) if i in parent else (0, i)
        assert (got[i]["n_links"], got[i]["component_id"]) == want and got[i]["kept"] == (None if i is None else i == want[1])
    assert near_vectors.near_vectors(vectors.limit(0)).count() == 0


# --- 7


def test_pages_come_back_and_equal_payloads_are_stored_once(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "z" * 100_000]
    pages = spark.createDataFrame([(i + 1, f"http://x/{i}\n", h, "w") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "w")], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages).collect()}
    assert len(got) == 9
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        want = first.setdefault(b, i + 1)
        r = got[i + 1]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == i + 1 else ("revisit", want))
    assert got[None]["record_type"] == "response"
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_what_is_quarantined_is_listed_and_revisits_name_their_response(spark, tmp_path, packed):
    if not packed:
        with pytest.raises(ValueError, match="headers do not end"):
            warc.parse_record(b"WARC/1.1\r\n" + b"x" * warc.HEAD_BYTES + b"\r\n\r\n")
        return
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "other")], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "archives")
    written = warc.write_warc(pages, folder).persist()
    heads = {}
    for r in written.collect():
        path = r["path"]
        with open(path, "rb") as f:
            data = f.read()
        heads |= {h["x-page-id"]: h for _, _, _, h, _ in warc.salvage(data)}
    assert heads["2"]["warc-refers-to"] == heads["1"]["warc-record-id"] and heads["2"]["warc-refers-to-target-uri"] == "http://a/"
    start = next(a for _, a, _, _, _ in warc.salvage(data))
    with open(path, "wb") as f:
        f.write(data[: start + 30] + b"????" + data[start + 34 :])
    gaps = [r for r in warc.read_warc(spark, written, folder).collect() if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["at"] == start and gaps[0]["reason"]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_the_records_it_touches(packed):
    make = warc.member if packed else bytes
    records = [make(warc.record("response", f"http://x/{i}", f"page {i} ".encode() * 200, "", [("X-Page-ID", str(i))])) for i in range(8)]
    data = bytearray(b"".join(records))
    starts = np.cumsum([0] + [len(r) for r in records])
    data[starts[2] + len(records[2]) // 2] ^= 0xFF
    data[starts[5] : starts[5] + 6] = b"\0" * 6
    data = bytes(data[: starts[7] + len(records[7]) // 2])
    got = list(warc.salvage(data))
    assert [int(h["x-page-id"]) for k, _, _, h, _ in got if k == "record"] == [0, 1, 3, 4, 6]
    gaps = [(a, b) for k, a, b, _, _ in got if k == "gap"]
    assert gaps == [(starts[2], starts[3]), (starts[5], starts[6]), (starts[7], len(data))]
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"noise")] == ["gap"]


# --- 9


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components_are_those_of_all_pairs(spark, docs, n, percent):
    rows = [(r["doc_id"], words_of((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in docs.collect() if r["doc_id"] is not None]
    sets = {i: ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()) for i, w in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = jaccard_join.jaccard_components(docs, words=n, percent=percent).collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"])) for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("block", [3, 20_000])
def test_links_are_counted_and_long_lists_are_cut(spark, docs, block):
    n, percent = 2, 50
    rows = [(r["doc_id"], r["text"] or "") for r in docs.filter("doc_id is not null").collect()]
    words = [words_of(t.translate({c: c + 32 for c in range(65, 91)})) for _, t in rows]
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in words]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= percent * len(a | b)
    want = sorted((i, sum(linked(s, t) for k, t in enumerate(sets) if k != j)) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard_join.jaccard_components(docs, words=n, percent=percent, count_links=True, block=block)
    assert sorted((r["doc_id"], r["n_links"]) for r in got.filter("doc_id is not null").collect()) == want
    plain = jaccard_join.jaccard_components(docs, words=n, percent=percent, block=block)
    key = lambda df: sorted(map(str, df.select("doc_id", "n_shingles", "component_id").collect()))
    assert key(got) == key(plain) == key(jaccard_join.jaccard_components(docs, words=n, percent=percent))


def test_divide_skip_counts_like_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        query = np.unique(rng.integers(0, 60, 30)).astype(np.uint64)
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(6)]
        need = [int(rng.integers(1, 20)) for _ in sets]
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(query, s)) >= need[i]]
        assert jaccard_join.divide_skip(query, sets, need) == want


# --- 10


def test_token_shards_hold_what_the_library_gives(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").collect()), key=lambda r: r[0])
    got = token_output.token_output(docs.filter("doc_id is not null"), tokenizer=path).orderBy("start").collect()
    at = 0
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.token_output(docs, tokenizer=path).count() == docs.count()
    assert token_output.token_output(docs.limit(0), tokenizer=path).count() == 0


def test_grammar_decodes_any_stretch():
    rng = np.random.default_rng(6)
    for ids in (np.empty(0, np.uint32), np.zeros(50, np.uint32), rng.integers(0, 9, 5000).astype(np.uint32), np.tile(np.arange(7, dtype=np.uint32), 300)):
        s = token_output.Shard(token_output.pack_shard([1, None], [len(ids), 0], ids, 10))
        assert s.keys == [1, None] and (s.ids() == ids).all()
        for _ in range(50):
            a, b = np.sort(rng.integers(0, len(ids) + 1, 2))
            assert (s.ids(int(a), int(b)) == ids[a:b]).all()


def test_no_pair_that_stands_eight_times_is_left_in_a_long_shard():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 40_000, 900_000).astype(np.uint32)
    phrases = rng.integers(0, 40_000, (500, 12))
    for k, at in enumerate(np.arange(10_000) * 88):
        ids[at : at + 12] = phrases[k % 500]
    ids[:20_000] = 7
    seq, rules = token_output.repair(ids, 40_000)
    pairs = collections.Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
    assert max(pairs.values()) < 8 and len(rules) >= 500
    s = token_output.Shard(token_output.pack_shard([1], [len(ids)], ids, 40_000))
    assert (s.ids() == ids).all() and (s.ids(88 * 700 - 5, 88 * 900) == ids[88 * 700 - 5 : 88 * 900]).all()


def test_encoder_cuts_only_where_the_rule_does():
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), token_output.encoder(path)
    rng = random.Random(7)
    texts = ["", " ", "a  b", " a", "a ", "it's 'll", " x 　 y", "a\x1c b"] + ["".join(rng.choice("ab' \n\t.1é　,") for _ in range(30)) for _ in range(1500)]
    texts += ["".join(rng.choice("ab'1.é　日\x85\xa0\u200b\u2028\u0301Ġ,$") for _ in range(6)) + " " + rng.choice(["x", "\u0301", "Ġb"]) for _ in range(1500)]
    fresh = token_output.Encoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in fresh.encode_all(texts)] == want and len(fresh) > 1000
    assert [x.tolist() for x in fresh.encode_all(texts[::-1])] == want[::-1]
    assert all(e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_words_are_merged_together_as_the_library_merges_each():
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), token_output.Encoder(path)
    rng = random.Random(12)
    words = ["the", "a" * 39, "a" * 40, "th" * 500, "日本語" * 20, "é", "x'll", "'s", "$1,000.00", "a\nb", "\u0301", "Ġb", "!" * 60, "1" * 41, "aaaaaaa"]
    words += ["".join(rng.choice(["th", "er", "ing", "a", "E", "é", "日", "1", ".", "'s", "\U0001f600"]) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]
    words = list(dict.fromkeys(words))
    found = e.merged(words)
    assert list(sorted(found)) == sorted(words)
    assert all(found[w] == np.array(library.encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    assert e.merged([]) == {} and list(e.merged(["日" * 30])) == ["日" * 30]
    assert not token_output.Merges.of({"type": "BPE", "dropout": 0.5, "vocab": {}, "merges": []})


def test_added_tokens_in_a_text_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), token_output.encoder(path)
    end, rng = "<|endoftext|>", random.Random(10)
    texts = [f"a{end}b", end, end * 2, f" {end} ", f"one two {end} three{end}\n four", f"<|endoftext{end}|>", f"a  {end}  b"]
    texts += ["".join(rng.choice([*"ab' \n.1é,", end, "<|", "endoftext"]) for _ in range(30)) for _ in range(500)]
    assert e.encode(texts[0]).tolist() == [64, 50256, 65]
    assert [x.tolist() for x in e.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)


# --- the pipeline


def test_pipeline_stages_keep_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(8, 60)))
    rows = [(i, good() if i % 5 else "JUNK!! " * 30, "en", f"src{i % 3}", 0) for i in range(200)]
    rows += [(500, rows[1][1], "en", "src0", 0), (501, good() + " mail bob.k@x.example.org soon", "en", None, 0), (1, rows[1][1], "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(i % 5)), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = out
    assert all(i % 5 for i in kept["quality_classifier"] if i < 200) and len(kept["quality_classifier"]) >= 155
    assert 500 not in kept["jaccard_join"] and 1 in kept["jaccard_join"] and docs.filter("doc_id = 1").count() == 2
    assert kept["pii"][501].endswith("mail <EMAIL> soon") and kept["mixing"] == kept["pii"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_take_empty_tables_nulls_and_repeated_keys(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a text of some words that stands here", None, None, None), (1, "quite another text with other words in it", "en", "x", 3), (None, None, None, None, None), (2, None, None, None, None), (3, "", "en", "x", 0), (None, "a text of some words that stands here", "en", "x", 1), (2, None, None, None, None)]
    for k, data in enumerate(([], rows)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/docs-{k}")
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, spark.read.parquet(f"{tmp_path}/docs-{k}"), str(tmp_path))
            n = {"jaccard_join": 6}.get(name, len(data)) if data else 0
            if name == "piece_sampling":
                assert out.filter("sample = 0").count() == n
            else:
                assert out.columns == [c.split()[0] for c in schema.split(", ")] and out.count() == n


def test_the_mixture_reaches_the_last_rows_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [(i, f"text {i}", "en", "hot" if i < 200 else f"src{i % 3}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stages["mixing"](spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    want = [r["doc_id"] for r in mixing.pfair_mix(docs).orderBy("mix_position").collect()]
    order = lambda df: [r["doc_id"] for r in stages["piece_sampling"](spark, df, "").filter("sample = 0").orderBy("mix_position").collect()]
    assert order(spark.read.parquet(f"{tmp_path}/mixed")) == want
    assert order(docs) != want and sorted(order(docs)) == sorted(want)
    got = stages["piece_sampling"](spark, stages["mixing"](spark, docs, ""), "")
    assert [r["mix_position"] for r in got.filter("sample = 0").orderBy("mix_position").collect()] == list(range(300))


def test_the_query_of_samples_gives_the_segmentations(spark):
    from tidemill.llm.queries import QUERIES

    got = QUERIES["op3_piece_sampling"](spark, "/root/testdata/sf0.001").select("doc_id", "n_pieces", "piece_ids").collect()
    assert all(len(r["piece_ids"]) == r["n_pieces"] for r in got)
    assert len({(r["doc_id"], *r["piece_ids"]) for r in got}) == len(got)


@pytest.mark.parametrize("name", ["op1_pfair_mix", "op2_quality_classifier", "op4_pii", "op5_substring_dedup", "op9_jaccard_join", "op10_token_output", "op3_piece_sampling"])
def test_queries_return_a_row_for_each_document(spark, name):
    from tidemill.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    got = QUERIES[name](spark, d)
    assert got.select("doc_id").distinct().count() == n and (name == "op3_piece_sampling" or got.count() == n)
