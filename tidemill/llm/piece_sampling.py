"""Sampled segmentations of texts into a SentencePiece model's pieces, without replacement, and their decoding.

A text's lattice has a node between any two characters and an edge for each piece that matches there; characters
that no piece covers are byte pieces. Pieces do not cross from one word into the next (nor, in a word without end,
over a multiple of 65,536 characters), so the lattice is a row of word lattices, and each distinct word's is built
once, with the log-sum of all paths to its end at every node.

Gumbel top-k by perturbed A*: each subtree of the search (all segmentations with a given beginning) has as its bound
the largest perturbed log-probability in it, which can be drawn without looking inside. The subtree with the largest
bound is taken; following the edges that hold its maximum gives its best segmentation, and at each node that is
passed, the edges not taken form a subtree with a bound drawn below that maximum. The next largest bound gives the
next segmentation. So k searches give k distinct segmentations, exactly as sampling without replacement from the
lattice's distribution would. The bound that is largest after them, kappa, gives inclusion scores
1 - exp(-exp(log_prob - kappa)). All draws are hashes of the row's key, so a row gives the same samples anywhere.

The model holds merges, not probabilities: a piece of rank r weighs -log(r + 2), which is Zipf's law.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import U64, blocks, freed, kept, mixed

SPACE = "▁"
#: Edges after which a worker's lattices are dropped, and characters whose lattices are made together.
EDGE_TABLE, MADE_AT_ONCE = 2_000_000, 30_000
BASE, SPREAD = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
#: Bytes of text that are sampled together. With the table it bounds what a worker takes beside its input, some 200 MB.
SAMPLED_AT_ONCE = 1 << 18
#: Characters of a word after which the next piece begins anew, and what marks the rest of such a word: no character.
LONGEST_WORD, CONTINUES = 1 << 16, "\ud800"
#: Stands after a word among others: no character either.
END = "\udfff"


class Known(dict):
    """Word -> its first node. One not known yet is noted as new and gets -1 less its place among the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        got = self[word] = -1 - len(self.new)
        self.new.append(word)
        return got


class Lattices:
    """Word -> its first node. A node owns a range of edges; -1 follows the last piece of a word."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.byte_id, self.id_of = np.zeros(256, np.int32), {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or SPACE in p[1:]):
                self.id_of[p] = i
        self.bytes_of = np.array(self.bytes_of, object)
        self.weight = np.array([-np.log(max(0.0, -model.get_score(i)) + 2.0) for i in range(n)])
        self.byte_weight = -float(np.log(n + 2.0))
        self.longest = max(map(len, self.id_of))
        # pieces by a hash of their characters; tables of its top bits lead to them, and turn other strings away
        known = list(self.id_of)
        prints = self._prints(known)
        order = np.argsort(prints)
        self.prints, self.print_ids = prints[order], np.array([self.id_of[p] for p in known], np.int32)[order]
        top = self._top(self.prints)
        self.kind = np.zeros(1 << 20, np.uint8)  # 1: a piece may stand here; 2: the beginning of one, so a longer one may
        self.kind[top] = 1
        self.kind[self._top(self._prints(sorted({p[:n] for p in known for n in range(1, len(p))})))] |= 2
        # pieces whose top bits agree stand next to each other
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[top[::-1]] = np.arange(len(top), dtype=np.int32)[::-1]
        self.crowd = int(np.unique(top, return_counts=True)[1].max())
        self.words = Known()
        self.clear()

    @staticmethod
    def _top(prints: np.ndarray) -> np.ndarray:
        return (prints >> U64(44)).astype(np.int64)

    @staticmethod
    def _prints(pieces: list[str]) -> np.ndarray:
        out, size = np.empty(len(pieces), U64), np.array(list(map(len, pieces)))
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            code = np.array([list(map(ord, pieces[i])) for i in which.tolist()], U64)
            h = np.zeros(len(which), U64)
            for c in code.T:
                h = h * BASE + c
            out[which] = h * SPREAD
        return out

    def clear(self) -> None:
        """Forget all words and give their memory back."""
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int32)  # of each node
        self.cdf, self.logp, self.rest = (np.empty(0) for _ in range(3))  # of each edge; rest: of the others
        self.piece, self.next = np.empty(0, np.int32), np.empty(0, np.int64)
        self.forget()

    def forget(self) -> None:
        """Forget all words; their memory is used again."""
        self.words.clear()
        self.nodes = self.edges = 0

    def of(self, words: list[str]) -> np.ndarray:
        if self.edges > EDGE_TABLE:
            self.forget()
        nodes = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        some, self.words.new = self.words.new, []
        if some:
            size = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            cuts = [0, *(np.flatnonzero(np.diff(size // MADE_AT_ONCE)) + 1).tolist(), len(some)]
            made = np.concatenate([self.add(some[a:b]) for a, b in itertools.pairwise(cuts)])
            new = np.flatnonzero(nodes < 0)
            nodes[new] = made[-1 - nodes[new]]
        return nodes

    def _room(self, nodes: int, edges: int) -> None:
        # what is not written yet takes no memory: room for all that a full table may come to
        for names, need, least in ((("first", "count"), self.nodes + nodes, EDGE_TABLE), (("cdf", "logp", "rest", "piece", "next"), self.edges + edges, EDGE_TABLE * 5 // 4)):
            for name in names:
                old = getattr(self, name)
                if len(old) < need:
                    grown = np.empty(max(need, least, len(old) * 5 // 4), old.dtype)
                    grown[: len(old)] = old
                    setattr(self, name, grown)

    def _matches(self, code: np.ndarray, at: np.ndarray):
        """Of each length the places, out of ``at``, where a piece of this length begins, and its id."""
        h = np.zeros(len(at), U64)
        for size in range(1, self.longest + 1):
            if not len(at):
                return
            h *= BASE
            h += code[at + (size - 1)]
            p = h * SPREAD
            top = (p >> U64(44)).view(np.int64)
            kind = self.kind[top]
            hit = np.flatnonzero(kind & 1)
            want, k = p[hit], self.slot[top[hit]]
            same = self.prints[k] == want
            for _ in range(self.crowd - 1):
                k = np.where(same, k, np.minimum(k + 1, len(self.prints) - 1))
                same = self.prints[k] == want
            yield size, at[hit[same]], self.print_ids[k[same]]
            on = np.flatnonzero(kind & 2)
            at, h = at[on], h[on]

    def add(self, words: list[str]) -> np.ndarray:
        """Append the lattices of "a space and the word", or of a long word's next stretch, all at once; their nodes.

        A character that no piece starts at is a chain of byte pieces; a mark that stands for a space but is none too.
        After each word stands an end, a node without edges and a character of no piece.
        """
        text = SPACE + (END + SPACE).join(words) + END
        sizes, whole = np.fromiter(map(len, words), np.int64, len(words)) + 1, slice(None)
        if CONTINUES in text:
            whole = np.array([w[:1] != CONTINUES for w in words], bool)
            texts = [SPACE + w if is_whole else w[1:] for w, is_whole in zip(words, whole.tolist(), strict=True)]
            text = END.join(texts) + END
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        n = len(code)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        far = np.repeat(ends, sizes + 1) - np.arange(n)  # characters to the word's end
        inner = code == ord(SPACE)
        inner[starts[whole]] = False
        found = list(self._matches(np.append(code, np.full(self.longest, ord(END), U64)), np.flatnonzero(~(inner | is_end))))
        count = np.zeros(n, np.int32)
        for _, at, _ in found:
            count[at] += 1
        bare = np.flatnonzero((count == 0) & ~is_end)
        count[bare] = 1
        # edges by their node's distance from the word's end, then by node, of a node the longest piece first: as a
        # rule it is the likeliest
        by_far = np.argsort(far.astype(np.int16) if sizes.max() < 1 << 15 else far, kind="stable")
        spans = count[by_far].astype(np.int64)
        firsts = np.cumsum(spans) - spans
        first = np.empty(n, np.int64)
        first[by_far] = firsts
        m = int(spans.sum())
        piece, to, weight = np.empty(m, np.int32), np.empty(m, np.int64), np.empty(m)
        place = first.copy()
        for size, at, ids in reversed(found):
            e = place[at]
            place[at] += 1
            piece[e], to[e] = ids, at + size
            weight[e] = self.weight[ids]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[bare].tolist()]
        e = first[bare]
        piece[e], to[e] = self.byte_id[[r[0] for r in raw]], bare + 1
        weight[e] = [self.byte_weight * len(r) for r in raw]
        # log-sums to the word's end, for all nodes at the same distance from it
        beta, score = np.zeros(n), np.empty(m)
        cuts = np.append(np.flatnonzero(np.diff(far[by_far])) + 1, n).tolist()
        bounds = [*firsts[cuts[:-1]].tolist(), m]
        for a, b, x, y in zip(cuts[:-1], cuts[1:], bounds[:-1], bounds[1:], strict=True):
            value, heads, own = weight[x:y] + beta[to[x:y]], firsts[a:b] - x, spans[a:b]
            top = np.maximum.reduceat(value, heads)
            total = np.log(np.add.reduceat(np.exp(value - np.repeat(top, own)), heads)) + top
            beta[by_far[a:b]] = total
            score[x:y] = value - np.repeat(total, own)
        p = np.exp(score)
        heads, spans = firsts[len(words) :], spans[len(words) :]
        cdf, rest = shares(p, heads, spans)
        # places among all nodes; the end of a word is -1
        base = self.nodes
        target = np.where(is_end[to], -1, to + base)
        chain = [(i, r) for i, r in zip(e.tolist(), raw, strict=True) if len(r) > 1]
        extra = sum(len(r) - 1 for _, r in chain)  # further nodes, for the bytes of a character after the first
        self._room(n + extra, m + extra)
        f, v = slice(self.edges, self.edges + m), slice(base, base + n)
        if extra:
            g, u = slice(self.edges + m, self.edges + m + extra), slice(base + n, base + n + extra)
            own = np.arange(base + n, base + n + extra)
            after = own + 1
            last = np.cumsum([len(r) - 1 for _, r in chain]) - 1
            heads = [i for i, _ in chain]
            after[last] = target[heads]
            target[heads] = own[np.append(0, last[:-1] + 1)]
            self.cdf[g], self.logp[g], self.rest[g], self.next[g] = 1.0, 0.0, 0.0, after
            self.piece[g] = self.byte_id[[b for _, r in chain for b in r[1:]]]
            self.first[u], self.count[u] = np.arange(self.edges + m, self.edges + m + extra), 1
        self.cdf[f], self.logp[f], self.rest[f], self.piece[f], self.next[f] = cdf, score, rest, piece, target
        self.first[v], self.count[v] = first + self.edges, count
        self.nodes += n + extra
        self.edges += m + extra
        nodes = starts + base
        self.words.update(zip(words, nodes.tolist(), strict=True))
        return nodes

    def arrays(self):
        return self.first, self.count, self.cdf, self.logp, self.piece, self.next, self.rest

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8."""
        return b"".join(self.bytes_of[ids].tolist())[1:]


def shares(p: np.ndarray, heads: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values in groups that start at ``heads``: their running sums, and the sum of the group's others.

    Both depend on the group alone, and no sum is a difference of sums.
    """
    cdf, out = p.copy(), np.zeros(len(p))
    order = np.argsort(spans.astype(np.int16), kind="stable")
    number = np.bincount(spans)
    ends = np.cumsum(number)
    for size in (np.flatnonzero(number[2:]) + 2).tolist():
        at = heads[order[ends[size - 1] : ends[size]]]
        before, after = p[at], p[at + (size - 1)]
        for k in range(1, size):  # before: the sum up to k - 1
            out[at + k] = before
            before = before + p[at + k]
            cdf[at + k] = before
        for k in range(size - 2, -1, -1):
            out[at + k] += after
            after = after + p[at + k]
    return cdf, out


def others(p: np.ndarray, heads: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For values in groups that start at ``heads``: the sum of the group's others."""
    return shares(p, heads, spans)[1]


def uniform(seed: np.ndarray, turn: np.ndarray | int, at: np.ndarray, what: int = 0, of: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Numbers in (0, 1) that depend on a row's seed, the search, a place in the text and the purpose alone.

    of: which seed each place has; without it one each.
    """
    with np.errstate(over="ignore"):
        x = np.asarray(seed, U64) + np.asarray(turn, np.int64).astype(U64) * BASE + U64(0x632BE59BD9B4E019) * U64(what + 1)
        x = mixed(mixed(x)[of] + np.asarray(at, np.int64).astype(U64) * BASE)
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def below(limit: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at ``location``, given that it is less than ``limit``."""
    with np.errstate(divide="ignore", over="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - location)


class Walk:
    """Paths through the lattices of many documents at once, as edges in order of document, word and step."""

    def __init__(self, arrays, doc: np.ndarray, word: np.ndarray, node: np.ndarray, seeds: np.ndarray, turn: np.ndarray):
        """Follow ``node`` of each (doc, word), in that order, to the word's end; seeds and turn by document."""
        first, count, cdf, logp, piece, to, _ = arrays
        n = len(node)
        steps, k, step = [], np.arange(n), 0
        with np.errstate(over="ignore"):
            own = mixed(seeds + turn.astype(U64) * BASE)[doc] + word.astype(U64) * U64(0xD6E8FEB86659FD93)
        while len(k):
            u = (mixed(own[k] + U64(step * int(BASE) & (1 << 64) - 1)) >> U64(11)).astype(np.float64) / float(1 << 53)
            e = first[node]
            left = np.flatnonzero(u > cdf[e])
            last = e + count[node] - 1
            while len(left):
                left = left[e[left] < last[left]]
                e[left] += 1
                left = left[u[left] > cdf[e[left]]]
            steps.append((k, e, node))
            node = to[e]
            on = node >= 0
            k, node, step = k[on], node[on], step + 1
        # each word's edges stand together, at the place that the counts of the words before give
        sizes = np.zeros(n, np.int64)
        for at, (k, _, _) in enumerate(steps):
            sizes[k] = at + 1
        places = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        self.edge, self.node = np.empty(total, np.int64), np.empty(total, np.int64)
        for at, (k, e, v) in enumerate(steps):
            p = places[k] + at
            self.edge[p], self.node[p] = e, v
        self.doc, self.word = np.repeat(doc, sizes), np.repeat(word, sizes)


def stretches(text: str) -> list[str]:
    """Words, long ones in stretches."""
    words = text.split(" ")
    if len(text) <= LONGEST_WORD:
        return words
    return [x for w in words for x in [w[:LONGEST_WORD], *(CONTINUES + w[i : i + LONGEST_WORD] for i in range(LONGEST_WORD, len(w), LONGEST_WORD))]]


def top_k(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int):
    """For each text a list of at most k (ids, log_prob, perturbed, inclusion, its logarithm), best first."""
    split = [stretches(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    nodes = lattices.of([w for ws in split for w in ws])
    arrays = lattices.arrays()
    first, count, cdf, logp, piece, to, _ = arrays
    n = len(texts)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(n), sizes)
    word = np.arange(len(nodes)) - starts[doc] if len(nodes) else nodes
    g = -np.log(-np.log(uniform(seeds, 0, 0, 1)))
    found: list[list] = [[] for _ in texts]
    # the agenda of each document: the subtrees along its paths
    paths: list[list[Path]] = [[] for _ in texts]
    walk = Walk(arrays, doc, word, nodes, seeds, np.zeros(n, np.int64))
    live = np.arange(n)
    _extend(found, paths, live, walk, arrays, g, np.zeros(n), seeds, 0, None)
    kappa = np.full(n, -np.inf)
    for turn in range(1, k + 1):
        # the largest bound on each agenda
        best = np.full(n, -np.inf)
        where: list[tuple[int, int] | None] = [None] * n
        for i in live.tolist():
            for p, path in enumerate(paths[i]):
                if len(path.bound):
                    at = int(path.bound.argmax())
                    if path.bound[at] > best[i]:
                        best[i], where[i] = path.bound[at], (p, at)
        kappa[live] = best[live]
        live = np.array([i for i in live.tolist() if where[i] is not None], np.int64)
        if turn == k or not len(live):
            break
        _branch(found, paths, live, where, best, arrays, nodes, starts, sizes, seeds, turn)
    out = []
    for i in range(n):
        rows = []
        for ids, lp, g_i in found[i]:
            over = min(lp - kappa[i], 700.0)  # for the least, the logarithm is that of exp(over) itself
            log_inclusion = 0.0 if kappa[i] == -np.inf else float(over if over < -30 else np.log(-np.expm1(-np.exp(over))))
            rows.append((ids, lp, g_i, float(np.exp(log_inclusion)), log_inclusion))
        out.append(rows)
    return out


def _extend(found, paths, live, walk, arrays, g, head, seeds, turn, prefix):
    """Record the path of each live document and put the subtrees it leaves aside on the agenda.

    prefix: of each document the ids that come before its path, with log-probability ``head``.
    """
    _, _, _, logp, piece, _, rest_of = arrays
    lp = logp[walk.edge]
    ends = np.searchsorted(walk.doc, live, "right")
    begins = np.searchsorted(walk.doc, live, "left")
    total = np.cumsum(lp)
    before = np.append(0.0, total)[begins]
    at = np.repeat(np.arange(len(live)), ends - begins)
    phi = total - lp - before[at] + head[live][at] if len(lp) else lp  # of the node where the edge was chosen
    rest = rest_of[walk.edge]  # the share of the edges not taken
    some = np.flatnonzero(rest > 0)
    bound = np.full(len(lp), -np.inf)
    of = at[some]
    u = uniform(seeds[live], turn, some - begins[of], 2, of)
    bound[some] = below(g[live][of], phi[some] + np.log(rest[some]), u)
    ids = piece[walk.edge]
    for x, i in enumerate(live.tolist()):
        a, b = begins[x], ends[x]
        own = ids[a:b]
        whole = own if prefix is None else np.concatenate([prefix[i], own])
        found[i].append((whole, float(head[i] + (total[b - 1] - before[x] if b > a else 0.0)), float(g[i])))
        paths[i].append(Path(whole, len(whole) - len(own), bound[a:b], walk.node[a:b], walk.word[a:b], walk.edge[a:b], phi[a:b], {}))


@dataclass
class Path:
    """A segmentation, and from place ``skip`` on the subtrees it leaves aside: their bounds, where they hang."""

    ids: np.ndarray
    skip: int
    bound: np.ndarray
    node: np.ndarray
    word: np.ndarray
    edge: np.ndarray
    phi: np.ndarray
    tried: dict[int, set[int]]


def _branch(found, paths, live, where, best, arrays, nodes, starts, sizes, seeds, turn):
    """Take the largest subtree of each live document: an edge not tried yet at its node, then the words after it."""
    first, count, cdf, logp, piece, to, _ = arrays
    n = len(paths)
    prefix: list = [None] * n
    head = np.zeros(n)
    docs, words, at_node = [], [], []
    for i in live.tolist():
        p, at = where[i]
        x = paths[i][p]
        node = int(x.node[at])
        used = x.tried.setdefault(at, {int(x.edge[at])})
        edges = [e for e in range(int(first[node]), int(first[node] + count[node])) if e not in used]
        weights = np.exp(logp[edges])
        u = float(uniform(seeds[i : i + 1], turn, 0, 3)[0])
        e = edges[min(int(np.searchsorted(np.cumsum(weights), u * weights.sum())), len(edges) - 1)]
        used.add(e)
        left = float(sum(np.exp(logp[y]) for y in edges if y != e))
        if left > 0:
            v = uniform(seeds[i : i + 1], turn, 0, 4)
            x.bound[at] = below(best[i : i + 1], np.array([x.phi[at] + np.log(left)]), v)[0]
        else:
            x.bound[at] = -np.inf
        prefix[i] = np.append(x.ids[: x.skip + at], piece[e])
        head[i] = x.phi[at] + logp[e]
        w = int(x.word[at])
        follow = np.arange(w + 1, int(sizes[i]))
        if to[e] >= 0:  # the rest of the word
            docs.append(np.array([i]))
            words.append(np.array([w]))
            at_node.append(np.array([to[e]]))
        docs.append(np.full(len(follow), i))
        words.append(follow)
        at_node.append(nodes[starts[i] + follow])
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    walk = Walk(arrays, cat(docs), cat(words), cat(at_node), seeds, np.full(n, turn))
    _extend(found, paths, live, walk, arrays, best, head, seeds, turn, prefix)


_lattices: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _lattices:
        _lattices[path] = kept(Lattices(path))
    return _lattices[path]


SAMPLES = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double, decodes boolean, piece_ids array<int>"
NAMES = [x.split()[0] for x in SAMPLES.split(", ")]


def sampled(path: str, k: int, seed: int, ids: bool, carry: str | None = None):
    def run(batches):
        table = lattices(path)
        for batch in batches:
            for at, raw in blocks(batch.column(1), SAMPLED_AT_ONCE):
                texts = [t.decode() if t else "" for t in raw]
                keys = batch.column(0).slice(at, len(texts)).to_pylist()
                carried = batch.column(2).slice(at, len(texts)).to_pylist() if carry else keys
                seeds = np.array([xxhash.xxh3_64_intdigest(repr(x).encode(), seed) for x in keys], U64)
                rows = []
                for key, text, other, got in zip(keys, raw, carried, top_k(table, texts, seeds, k), strict=True):
                    for s, (p, lp, g, inclusion, log_inclusion) in enumerate(got):
                        rows.append((key, s, len(p), lp, g, inclusion, log_inclusion, table.decode(p) == (text or b""), p if ids else None, other))
                c = list(zip(*rows, strict=True))
                arrays = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), *(pa.array(x, pa.float64()) for x in c[3:7]), pa.array(c[7]), pa.array(c[8], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(c[9], pa.int64())] if carry else arrays, [*NAMES, carry] if carry else NAMES)

    return run


def sample_pieces(docs: DataFrame, *, model: str, k: int = 2, seed: int = 23, key: str = "doc_id", text: str = "text", ids: bool = False, carry: str | None = None) -> DataFrame:
    """k distinct sampled segmentations of every text, best first: doc_id, sample, n_pieces, log_prob, perturbed,
    inclusion and its logarithm (log_inclusion, the weight to use where texts are long and inclusion is next to
    nothing), decodes (the pieces give the text back), and with ``ids`` the piece ids.

    A text with fewer segmentations gives all, with inclusion 1. A null or empty text gives one of no pieces. Rows
    that repeat a key get the same draws; a null key is a key. An empty table gives no rows. ``carry`` names a long
    column that each sample takes from its row; other columns are ignored.
    """
    kept = [F.col(carry).cast("long").alias(carry)] if carry else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *kept)
    out = rows.mapInArrow(freed(sampled(model, k, seed, ids, carry)), f"{SAMPLES}, `{carry}` long" if carry else SAMPLES)
    return out if ids else out.drop("piece_ids")
