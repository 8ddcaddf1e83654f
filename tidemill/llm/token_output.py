"""Token ids of documents in grammar-compressed binary shards, and their readers.

A shard holds the ids of a range of documents in key order. Re-Pair: frequent pairs of neighbouring symbols are
replaced by new nonterminals, again and again; the shard stores the rules, the length each rule expands to, and the
remaining sequence. Prefix sums of expansion lengths find the symbol that covers any id, so a document is decoded
without what stands before it.

Encoding splits a text where a word ends and one space and a word follow. The byte-level rule never joins two sides
of such a place, so each word is encoded once, all new ones of some texts together, and looked up after that. Pieces
are merged as the library merges them, with its ranks; where a tokenizer has another model, the library is called.
Added tokens that a text quotes (<|endoftext|>) are ids of their own, as in the library's plain call; texts are
split at them first.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import blocks, new_file, shared_dir, stage

MAGIC = b"RPGRAM02"
#: Words after which a worker's table is emptied, and how many new ones are encoded in a call.
PIECE_TABLE, LEARNED_AT_ONCE = 500_000, 1000
#: Bytes of a piece that is merged beside others, and what ranks a pair that is never merged.
LONGEST_PIECE, NEVER = 40, 1 << 24
#: Bytes of text that are encoded together.
ENCODED_AT_ONCE = 2 << 20
#: A round replaces the pairs that are at least this share of the most frequent one.
OF_THE_MOST = 16
#: Values that are packed into bits at once, a multiple of eight, and pairs that are looked up at once.
PACKED, SCANNED = 1 << 18, 1 << 15
#: Share of the live places with frequent pairs below which the others are dropped.
DROPPED_BELOW = 0.6
#: What stands behind the last symbol.
END = np.uint32(0xFFFFFFFF)
#: How the byte-level alphabet writes the byte of a space.
SPACE_BYTE = "\u0120"
#: Its letter for each byte: printable ones stand for themselves, the others for the letters from 256 on, in order.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = [chr(b) if b in PRINTABLE else chr(256 + b - sum(p < b for p in PRINTABLE)) for b in range(256)]
#: The byte-level rule by which these tokenizers cut a text before merging.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Unsafe(Exception):
    """A place between spaces is not where one word ends and the next begins."""


class Merges:
    """Byte-pair merging of many pieces at once: of each, the leftmost pair of the least rank, until none has a rank."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.byte = np.array([vocab[c] for c in BYTE_LEVEL], np.uint32)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.pairs = Places(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64))

    @staticmethod
    def of(model: dict) -> Merges | None:
        """None for a model that does anything else besides, or makes a symbol in two ways."""
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or not set(BYTE_LEVEL) <= model["vocab"].keys() or not 0 < len(model["merges"]) < NEVER:
            return None
        made = {"".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]}
        return Merges(model["vocab"], model["merges"]) if len(made) == len(model["merges"]) else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.each(left.ravel().astype(np.uint64) << np.uint64(32) | right.ravel(), NEVER).reshape(left.shape)

    def merged(self, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of these sizes that ``text`` consists of, one after another, and how many each has.

        None may be longer than LONGEST_PIECE.

        Pieces of as many symbols stand together as columns; one merge makes them columns among those of one less.
        """
        size, code, starts = size.copy(), self.byte[np.frombuffer(text, np.uint8)], np.cumsum(size) - size
        by_size = np.argsort(size.astype(np.int8), kind="stable")
        cuts = np.searchsorted(size[by_size], np.arange(LONGEST_PIECE + 2))
        which, symbols, ranks, ended = np.empty(0, np.int64), None, None, []
        for n in range(int(size.max(initial=0)), 0, -1):
            own = by_size[cuts[n] : cuts[n + 1]]
            fresh = code[starts[own] + np.arange(n)[:, None]]
            first = self.rank(fresh[:-1], fresh[1:])
            if len(which):
                own, fresh, first = np.append(which, own), np.hstack([symbols, fresh]), np.hstack([ranks, first])
            if n == 1:
                ended.append((own, fresh))
                break
            least = ((first << 6) + np.arange(n - 1, dtype=np.int32)[:, None]).min(axis=0)
            on = least < NEVER << 6
            ended.append((own[~on], fresh[:, ~on]))
            which, symbols, ranks, least = own[on], fresh[:, on], first[:, on], least[on]
            at, new = least & 63, self.into[least >> 6]
            before = np.arange(n - 1)[:, None] < at
            symbols = np.where(before, symbols[:-1], symbols[1:])
            every = np.arange(len(which))
            symbols[at, every] = new
            ranks = np.where(before[:-1], ranks[:-1], ranks[1:])
            k = np.flatnonzero(at > 0)
            ranks[at[k] - 1, k] = self.rank(symbols[at[k] - 1, k], new[k])
            k = np.flatnonzero(at < n - 2)
            ranks[at[k], k] = self.rank(new[k], symbols[at[k] + 1, k])
        for own, got in ended:
            size[own] = len(got)
        out, starts = np.empty(int(size.sum()), "<u4"), np.cumsum(size) - size
        for own, got in ended:
            out[starts[own] + np.arange(len(got))[:, None]] = got
        return out, size


class Encoder(dict):
    """A word that follows one space -> the bytes of its ids (unsigned 32-bit, little-endian)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        cut, added = known["pre_tokenizer"] or {}, known["added_tokens"]
        self.plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.plain = self.plain and not known["normalizer"] and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)
        # the library finds added tokens before it cuts words: the longest of those that start first
        texts = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, texts))})") if texts else None
        self.cut, self.parts = regex.compile(RULE), {}
        self.merges = Merges.of(known["model"]) if self.plain else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACE_BYTE)]] = True

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= PIECE_TABLE // 8:
                self.parts.clear()
            got = self.parts[text] = self.ids(text)
        return got

    def any(self, text: str) -> bytes:
        return b"".join(map(self.part, self.cut.findall(text)))

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        got = self[word] = self.ids(" " + word)
        return got

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Words that are not in the table -> their ids, but for those that are not cut off where they begin.

        Without ``merges``, letters alone are one piece, which goes to the library's model as the byte-level alphabet
        writes it, and other words are cut by the library, LEARNED_AT_ONCE in a call.
        """
        if len(self) >= PIECE_TABLE:
            self.clear()
        if self.merges:
            found = self.merged(words)
            self.update(found)
            return found
        merge = self.tokenizer.model.tokenize
        letters = [w for w in words if w.isalpha()]
        written = [SPACE_BYTE + (w if w.isascii() else "".join(map(BYTE_LEVEL.__getitem__, w.encode()))) for w in letters]
        found = dict(zip(letters, [array("I", [t.id for t in merge(w)]).tobytes() for w in written], strict=True))
        rest = [w for w in words if w not in found] if len(found) < len(words) else []
        for at in range(0, len(rest), LEARNED_AT_ONCE):
            some = rest[at : at + LEARNED_AT_ONCE]
            (got,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            heads = np.flatnonzero(self.spaced[ids])  # a word starts with the id that holds its space
            if len(heads) == len(some):
                raw, cuts = ids.tobytes(), (4 * np.append(heads, len(ids))).tolist()
                found.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        self.update(found)
        return found

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """Words -> ids: letters alone are one piece, other words are cut by the rule; all pieces are merged together."""
        letters, rest = [], []
        for w in words:
            (letters if w.isalpha() else rest).append(w)
        cut = self.cut.findall(" " + " ".join(rest)) if rest else []
        heads = [k for k, p in enumerate(cut, len(letters)) if p[0] == " "]  # a word starts with the piece that holds its space
        if len(heads) != len(rest):
            rest, cut, heads = [], [], []
        heads = np.append(np.arange(len(letters)), np.array(heads, np.int64))
        text = "".join([" " * bool(letters), " ".join(letters), *cut])
        data = text.encode()
        if len(data) == len(text):
            size = np.append(np.fromiter(map(len, letters), np.int64, len(letters)) + 1, np.fromiter(map(len, cut), np.int64, len(cut)))
        else:
            size = np.array([*(len(w.encode()) + 1 for w in letters), *(len(p.encode()) for p in cut)], np.int64)
        long, ends = np.flatnonzero(size > LONGEST_PIECE).tolist(), np.cumsum(size)
        whole, parts, at = [], [], 0
        for k in long:  # by the library's model, one by one
            parts.append(data[at : ends[k] - size[k]])
            at = ends[k]
            written = "".join(map(BYTE_LEVEL.__getitem__, data[at - size[k] : at]))
            whole.append(np.array([t.id for t in self.tokenizer.model.tokenize(written)], "<u4"))
        size[long] = 0
        ids, size = self.merges.merged(b"".join([*parts, data[at:]]), size)
        ends, parts, at = np.cumsum(size), [], 0
        for k, x in zip(long, whole, strict=True):
            parts += [ids[at : ends[k]], x]
            at, size[k] = ends[k], len(x)
        ids = np.concatenate([*parts, ids[at:]])
        raw, cuts = ids.tobytes(), (4 * np.append((np.cumsum(size) - size)[heads], len(ids))).tolist()
        return dict(zip(itertools.chain(letters, rest), map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The words of all are looked up together, so that each new one is asked for once."""
        odd = [not self.plain or bool(self.added and self.added.search(t)) for t in texts]
        split = [[] if other else t.split(" ") for t, other in zip(texts, odd, strict=True)]
        local = dict.fromkeys(itertools.chain.from_iterable(w[1:] for w in split))
        local = dict(zip(local, map(self.get, local), strict=True))
        new = [w for w, ids in local.items() if ids is None and w and w.strip() == w]
        local.update(self.learn(new))
        out = []
        for text, other, words in zip(texts, odd, split, strict=True):
            first = words[0] if words else ""
            if other or len(words) > 1 and (not first or first[-1].isspace()):
                out.append(self.encode(text))
                continue
            try:  # words with white space at an end are never in the table, and None cannot be joined
                out.append(np.frombuffer(b"".join([self.any(first), *map(local.__getitem__, words[1:])]), "<u4"))
            except TypeError:
                out.append(self.encode(text))
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self.plain:
            return np.frombuffer(self.ids(text), "<u4")
        if self.added and self.added.search(text):  # every second part is an added token
            parts = self.added.split(text)
            return np.concatenate([np.frombuffer(self.ids(p), "<u4") if k % 2 else self.between(p) for k, p in enumerate(parts)])
        return self.between(text)

    def between(self, text: str) -> np.ndarray:
        """Ids of a text that holds no added token."""
        first, *words = text.split(" ")
        if not words or first and not first[-1].isspace():
            try:  # words with white space at an end are never in the table
                return np.frombuffer(self.any(first) + b"".join(map(self.__getitem__, words)), "<u4")
            except Unsafe:
                pass
        first, *words = SPACES.split(text)
        return np.frombuffer(self.any(first) + b"".join([self.get(w) or self.any(" " + w) for w in words]), "<u4")


#: A space between the end of one word and the start of another.
SPACES = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Places:
    """Where each of some distinct 64-bit values stands: tables by hash, each for the values that lost their slot before."""

    def __init__(self, values: np.ndarray):
        self.values, left, self.tables = np.append(values, ~np.uint64(0)), np.arange(len(values)), []
        for k in range(64):
            if not len(left):
                break
            bits = (8 * len(left)).bit_length()
            factor, shift = np.uint64(0x9E3779B97F4A7C15 + (k << 17)), np.uint64(64 - bits)
            table, slots = np.full(1 << bits, -1, np.int32), (values[left] * factor) >> shift
            table[slots] = left
            self.tables.append((table, factor, shift))
            left = left[table[slots] != left]

    def each(self, x: np.ndarray, none: int) -> np.ndarray:
        """Which of the values each place in ``x`` holds, or ``none``."""
        table, factor, shift = self.tables[0]
        got = table[(x * factor) >> shift]
        same = self.values[got] == x
        out = np.where(same, got, np.int32(none))
        left = np.flatnonzero(~same & (got >= 0))  # a value that lost its slot lost it to another
        for table, factor, shift in self.tables[1:]:
            part = x[left]
            got = table[(part * factor) >> shift]
            same = self.values[got] == part
            out[left[same]] = got[same]
            left = left[~same & (got >= 0)]
        return out

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``x`` that hold one of the values, ascending, and which it is."""
        hits, found = [], []
        for at in range(0, len(x), SCANNED):
            which = self.each(x[at : at + SCANNED], -1)
            some = np.flatnonzero(which >= 0)
            hits.append(some + at)
            found.append(which[some])
        return np.concatenate(hits), np.concatenate(found)


def repair(ids: np.ndarray, base: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules: nonterminal base + k stands for the two symbols in rules[k].

    The sequence is a linked list. A round counts the pairs at all ``live`` places, replaces the most frequent ones,
    and drops places whose pair is rarer than ``least``: a pair of old symbols is never made again, so it stays rare
    until a neighbour is replaced, which makes its place live again. Every pair is counted at all its places, as long
    as it is frequent. A pair that is chosen is replaced, or gone because a neighbour was, everywhere.
    """
    n, rules, first = len(ids), [], base
    seq = np.append(ids.astype(np.uint32), END)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    live, stays = np.ones(n + 1, bool), np.ones(n + 1, bool)
    while True:
        live[n] = False
        at = np.flatnonzero(live)
        pairs = np.empty(len(at), np.uint64)
        for k in range(0, len(at), SCANNED):
            some = at[k : k + SCANNED]
            pairs[k : k + SCANNED] = seq[some].astype(np.uint64) << np.uint64(32) | seq[after[some]]
        ordered = np.sort(pairs)
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        count = np.diff(heads, append=len(ordered))
        known, count = ordered[heads[count >= least]], count[count >= least]
        if not len(known):
            break
        chosen = count >= int(count.max()) // OF_THE_MOST
        if int(count.sum()) > DROPPED_BELOW * len(at):  # few places are rare, and stay for now
            known, chosen = known[chosen], chosen[chosen]
            places, which = Places(known).of(pairs)
        else:
            places, which = Places(known).of(pairs)
            live[at] = False
            live[at[places]] = True
        at = at[places]
        hits, which = at[chosen[which]], which[chosen[which]]
        new = np.append(True, hits[1:] != after[hits[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))
        every = (np.arange(len(hits)) - start) % 2 == 0  # of overlapping pairs, every second
        hits, which = hits[every], which[every]
        chosen[:] = False
        chosen[which] = True
        best = known[chosen]
        seq[hits] = first + (np.cumsum(chosen) - 1)[which]
        gone = after[hits]
        follow = after[gone]
        after[hits], before[follow] = follow, hits
        stays[gone] = live[gone] = False
        live[hits] = live[before[hits]] = True
        rules.append(np.stack([best >> np.uint64(32), best & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        first += len(best)
    return seq[:n][stays[:n]], np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def unfold(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Nonterminals replaced by their pairs until none is left."""
    while (deep := seq >= base).any():
        ends = np.cumsum(1 + deep)
        out = np.empty(ends[-1], np.uint32)
        of = rules[seq[deep] - base]
        out[(ends - 1)[~deep]] = seq[~deep]
        out[(ends - 2)[deep]], out[(ends - 1)[deep]] = of[:, 0], of[:, 1]
        seq = out
    return seq


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append(sum(1 if x < base else out[x - base] for x in (a, b)))
    return np.array(out, np.uint32)


def bits_of(largest: int) -> int:
    return max(1, int(largest).bit_length())


def packed(values: np.ndarray, bits: int) -> bytes:
    out = []
    for at in range(0, len(values), PACKED):
        wide = np.unpackbits(values[at : at + PACKED].astype(">u4").view(np.uint8)).reshape(-1, 32)
        out.append(np.packbits(wide[:, 32 - bits :]).tobytes())
    return b"".join(out)


def unpacked(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    for at in range(0, n, PACKED):
        m = min(PACKED, n - at)
        wide = np.zeros((m, 32), np.uint8)
        wide[:, 32 - bits :] = np.unpackbits(data[at * bits // 8 :][: (m * bits + 7) // 8], count=m * bits).reshape(m, bits)
        out[at : at + m] = np.packbits(wide).view(">u4")
    return out


def pack_shard(keys: list[int | None], counts: list[int], ids: np.ndarray, base: int) -> bytes:
    seq, rules = repair(ids, base)
    lengths = lengths_of(rules, base)
    bits, length_bits = bits_of(base + len(rules) - 1), bits_of(lengths.max(initial=0))
    known = np.array([k is not None for k in keys], bool)
    head = json.dumps({"docs": len(keys), "ids": len(ids), "base": base, "rules": len(rules), "symbols": len(seq), "bits": bits, "length_bits": length_bits}).encode()
    body = [np.array([k or 0 for k in keys], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(counts, "<i8").tobytes(), packed(rules.ravel(), bits), packed(lengths, length_bits), packed(seq, bits)]
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class Shard:
    """A shard's bytes: its documents' keys and id counts, and decoding of all or some ids."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", blob, 8)
        h, at = json.loads(blob[12 : 12 + n]), 12 + n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, count, at)
            at += got.nbytes
            return got

        keys = take("<i8", h["docs"])
        known = np.unpackbits(take("u1", (h["docs"] + 7) // 8), count=h["docs"]).astype(bool)
        self.keys = [k if is_key else None for k, is_key in zip(keys.tolist(), known.tolist(), strict=True)]
        self.counts = take("<i8", h["docs"])

        def values(bits: int, count: int) -> np.ndarray:
            return unpacked(take("u1", (count * bits + 7) // 8), bits, count)

        self.rules = values(h["bits"], 2 * h["rules"]).reshape(-1, 2)
        self.lengths = values(h["length_bits"], h["rules"]).astype(np.int64)
        self.seq, self.base, self.n = values(h["bits"], h["symbols"]), h["base"], h["ids"]
        n = np.ones(len(self.seq), np.int64)
        deep = self.seq >= self.base
        n[deep] = self.lengths[self.seq[deep] - self.base]
        self.ends = np.cumsum(n)  # of each symbol, in ids
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = unfold(np.arange(self.base, self.base + h["rules"], dtype=np.uint32), self.rules, self.base)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Symbols -> ids: runs of terminals are copied, nonterminals replaced by their expansion."""
        n = np.ones(len(seq), np.int64)
        deep = seq >= self.base
        n[deep] = self.lengths[seq[deep] - self.base]
        ends = np.cumsum(n)
        out = np.empty(ends[-1] if len(ends) else 0, "<u4")
        out[(ends - n)[~deep]] = seq[~deep]
        if deep.any():
            which, m, to = seq[deep] - self.base, n[deep], (ends - n)[deep]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(to, m) + inner] = self.flat[np.repeat(self.first[which], m) + inner]
        return out

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi; only the symbols that cover them are expanded."""
        hi = self.n if hi is None else hi
        if (lo, hi) == (0, self.n):
            return self.expand(self.seq)
        a, b = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.ends, hi, "left") + 1
        skip = lo - int(self.ends[a - 1] if a else 0) if a < len(self.ends) else 0
        return self.expand(self.seq[a:b])[skip : skip + hi - lo]


WRITTEN = "part int, shard int, name string, docs long, ids long"
#: Ids of a shard, at most about: what a task holds at once. Ids that are decoded together.
SHARD_IDS, DECODED_AT_ONCE = 12_000_000, 1 << 17


def write_shards(folder: str, tokenizer: str, end_id: int | None, base: int):
    """Partitions in key order -> shard files, and a row for each: partition, number in it, name, documents, ids."""

    def run(batches):
        enc, task = encoder(tokenizer), TaskContext.get()
        part, k = task.partitionId() if task else 0, 0
        keys, counts, parts, held = [], [], [], 0
        tail = np.array([] if end_id is None else [end_id], "<u4")

        def flush():
            path = new_file(folder, f"shard-{part:07d}-{k:07d}", ".rpg", pack_shard(keys, counts, np.concatenate(parts), base))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([path.rsplit("/", 1)[1]]), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64())], ["part", "shard", "name", "docs", "ids"])

        for batch in batches:
            for at, some in blocks(batch.column(1), ENCODED_AT_ONCE):
                texts = [t.decode() if t else "" for t in some]
                for key, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), enc.encode_all(texts), strict=True):
                    parts += [ids, tail]
                    keys.append(key)
                    counts.append(len(ids) + len(tail))
                    held += counts[-1]
                    if held >= SHARD_IDS:
                        yield flush()
                        keys, counts, parts, held, k = [], [], [], 0, k + 1
        if keys:
            yield flush()

    return run


READ = "name string, doc_id long, at long, n_tokens long, ids_crc32 long"


def read_shards(batches):
    """(name, content) -> its documents, with the crc of their ids as unsigned 32-bit integers.

    Some documents at a time are decoded by random access, so a shard is never held whole.
    """
    for batch in batches:
        for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard, crc = Shard(blob), []
            ends = np.cumsum(shard.counts)
            starts = ends - shard.counts
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + DECODED_AT_ONCE, "right")))
                ids, lo = shard.ids(int(starts[at]), int(ends[to - 1])), starts[at]
                crc += [zlib.crc32(memoryview(ids[a:b])) for a, b in zip((starts[at:to] - lo).tolist(), (ends[at:to] - lo).tolist(), strict=True)]
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(crc)), pa.array(shard.keys, pa.int64()), pa.array(starts), pa.array(shard.counts), pa.array(crc, pa.int64())], ["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, base: int = 1 << 16) -> DataFrame:
    """Shard files under ``folder`` in ascending key order (nulls first); returns WRITTEN, in order of (part, shard).

    Files carry a name of their own for each attempt, so a task that runs twice leaves one that no row names.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.mapInArrow(write_shards(folder, tokenizer, end_id, base), WRITTEN)


def read_tokens(spark, written: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("of_parts"))  # a row for each partition
    base = written.select("part", "name", earlier(Window.partitionBy("part").orderBy("shard")).alias("in_part"))
    base = base.join(parts, "part").select("name", (F.col("of_parts") + F.col("in_part")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpg").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = files.join(written.select("name"), "name", "left_semi").mapInArrow(read_shards, READ)
    return got.join(base, "name").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, base: int = 50257) -> DataFrame:
    """Encode, write and read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A null or empty text is its end id alone. Rows with a null key come first; rows that repeat a key follow each
    other by the hash of their text. An empty table gives no rows and no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "token-output")
    written = stage(write_tokens(docs, f"{path}/shards", tokenizer=tokenizer, key=key, text=text, end_id=end_id, base=base), f"{path}/written")
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, written, f"{path}/shards")
