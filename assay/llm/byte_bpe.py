"""Byte-level BPE: exact encoding by longest matches with backtracking, and decoding.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary gives all
tokens that start at each byte. A sequence of tokens is the BPE encoding exactly when each adjacent pair
is: merging across the seam never wins. That test is memoised; longest matches that fail it are
shortened or taken back, and a position that was given up is not tried again. The short pre-tokens of
many texts that are not known yet take these steps side by side, in arrays; a long one takes them alone.
"""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from assay.llm.text import annotate, fresh_name

#: Pre-tokens longer than this, and pairs or pre-tokens beyond the next number, are not remembered.
CACHED_LENGTH = 48
CACHED = 120_000
#: Bytes of text encoded at once inside a task, characters of texts that are split at once, and pre-tokens encoded side by side.
SHARD = 3 << 20
SPLIT = 1 << 20
SIDE_BY_SIDE = 1 << 15
#: Places, a power of two, where verdicts on pairs are kept for arrays; a later pair takes the place of an earlier one.
PLACES = 1 << 18
#: What follows a pre-token in an array of bytes.
END = 256


class Trie:
    """The vocabulary as arrays. Nodes are the starts of tokens by length, then bytes, so an edge's place among the sorted edges names its node."""

    def __init__(self, rank: dict[str, int], names: list[str]):
        starts = {name[:n] for name in rank for n in range(1, len(name) + 1)}
        nodes = sorted(starts, key=lambda s: (len(s), s))
        number = {"": 0} | {s: i for i, s in enumerate(nodes, 1)}
        self.edges = np.array([number[s[:-1]] * (END + 1) + ord(s[-1]) for s in nodes], np.int64)
        #: The longest token that a node's bytes start with; -1 for none, and for no node, -1.
        best = [-1]
        for s in nodes:
            best.append(rank.get(s, best[number[s[:-1]]]))
        self.best = np.array([*best, -1], np.int64)
        self.size = np.array([len(name) for name in names], np.int64)
        #: The longest token that a token starts with, other than itself.
        self.shorter = np.full(len(names), -1, np.int64)
        for name, token in rank.items():
            self.shorter[token] = best[number[name[:-1]]]
        first, second = np.divmod(np.arange(END * (END + 1)), END + 1)
        self.two = self.step(self.step(np.zeros_like(first), first), second)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes one byte further; -1 for none, and from none."""
        key = node * (END + 1) + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((self.edges[at] == key) & (node >= 0), at + 1, -1)

    def longest(self, data: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The longest token at each position of data; -1 for none."""
        first, second = data[pos], data[pos + 1]
        node = self.two[first * (END + 1) + second]
        found = self.best[self.step(np.zeros_like(first), first)]
        left = np.flatnonzero(node >= 0)
        node, at = node[left], pos[left] + 2
        while len(left):
            found[left] = self.best[node]
            node = self.step(node, data[at])
            on = node >= 0
            left, node, at = left[on], node[on], at[on] + 1
        return found


class Codec:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        self.split = regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {}
        self.rank: dict[str, int] = {}
        for line in ranks.splitlines():
            if not line.strip():
                continue
            token, number = line.split()
            raw = base64.b64decode(token)
            self.tokens[int(number)] = raw
            self.rank[raw.decode("latin-1")] = int(number)
        size = max(self.tokens) + 1
        self.pieces = [self.tokens.get(i, b"") for i in range(size)]
        self.names = [p.decode("latin-1") for p in self.pieces]
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.pairs = np.full(PLACES, -1, np.int64)
        self.verdicts = np.zeros(PLACES, bool)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for key, number in self.rank.items():
            found.add_word(key, (len(key), number))
        found.make_automaton()
        return found

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.rank, self.names)

    @cached_property
    def column(self) -> pa.Array:
        return pa.array(self.pieces, pa.large_binary())

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; None for one byte, (-1, -1) if no merges make it."""
        if token in self.parts:
            return self.parts[token]
        name = self.names[token]
        if len(name) == 1:
            made = None
        else:
            parts = list(name)
            rank = self.rank
            while len(parts) > 2:
                best, at = min(((rank.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)))
                if best >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 and parts[0] in rank and parts[1] in rank else (-1, -1)
        self.parts[token] = made
        return made

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when they meet.

        Merges are undone from the latest one on; a merge across the seam that would have come before
        the one just undone breaks the pair. At equal rank the left merge comes first.
        """
        names, rank, halves = self.names, self.rank, self.halves
        before = 1 << 31
        while True:
            across = rank.get(names[left] + names[right])
            if across is not None and across < before:
                return False
            a, b = halves(left), halves(right)
            if (a and a[0] < 0) or (b and b[0] < 0):
                return False
            if a is not None and (b is None or left > right):
                before, left = left, a[1]
            elif b is not None:
                before, right = right + 1, b[0]
            else:
                return True

    def fit(self, left: int, right: int) -> bool:
        """apart, remembered."""
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= CACHED:
                self.fits.clear()
            known = self.fits[pair] = self.apart(left, right)
        return known

    def first(self, token: int) -> bool:
        """Whether merges make token, so that it can be the first one."""
        made = self.halves(token)
        return made is None or made[0] >= 0

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one pre-token, given as Latin-1 characters of its bytes."""
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(piece):
            at[end + 1 - found[0]].append(found)
        out: list[int] = []
        taken: list[int] = []
        dead: set[int] = set()
        pos, k = 0, len(at[0]) - 1
        fit = self.fit
        while pos < n:
            options = at[pos]
            while k >= 0:
                size, token = options[k]
                if pos + size not in dead:
                    if out:
                        if fit(out[-1], token):
                            break
                    elif self.first(token):
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                taken.append(k)
                pos += size
                k = len(at[pos]) - 1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                dead.add(pos)
                pos -= len(self.names[out.pop()])
                k = taken.pop() - 1
        return out

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """apart for each pair, remembered; where left is -1, whether right can be a first token."""
        key = (left + 1) * len(self.names) + right
        place = (key * 0x9E3779B97F4A7C1 >> 20) & (PLACES - 1)
        fits = self.verdicts[place]
        new = np.flatnonzero(self.pairs[place] != key)
        if len(new):
            keys, where = np.unique(key[new], return_inverse=True)
            lefts, rights = np.divmod(keys, len(self.names))
            found = np.array([self.apart(a - 1, b) if a else self.first(b) for a, b in zip(lefts.tolist(), rights.tolist())], bool)[where]
            fits[new] = found
            # Of pairs that share a place, the same one must leave its key and its verdict.
            last = len(new) - 1 - np.unique(place[new][::-1], return_index=True)[1]
            self.pairs[place[new[last]]], self.verdicts[place[new[last]]] = key[new[last]], found[last]
        return fits

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that are not empty; each array step moves every one that is not done."""
        trie = self.trie
        size, shorter = trie.size, trie.shorter
        lengths = np.array([len(p) for p in pieces], np.int64)
        stops = np.cumsum(lengths + 1) - 1
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        data[stops] = END
        ending = np.full(len(data), -1, np.int64)  # the token that ends before each position
        dead = np.zeros(len(data), bool)
        pos, stop = stops - lengths, stops
        last, token = np.full(len(pos), -1, np.int64), trie.longest(data, pos)
        while len(pos):
            back = token < 0
            if back.any():
                if (last[back] < 0).any():
                    raise ValueError("the vocabulary lacks single bytes of this text")
                dead[pos[back]] = True
                gone = last[back]
                pos[back] -= size[gone]
                last[back], token[back] = ending[pos[back]], shorter[gone]
            real = token >= 0
            good = real & ~dead[pos + np.where(real, size[token], 0)]
            at = np.flatnonzero(good)
            good[at] = self.fit_all(last[at], token[at])
            at = np.flatnonzero(good)
            pos[at] += size[token[at]]
            last[at] = ending[pos[at]] = token[at]
            at = np.flatnonzero(real & ~good)
            token[at] = shorter[token[at]]
            on = pos < stop
            if not on.all():
                pos, stop, last, token, good = pos[on], stop[on], last[on], token[on], good[on]
            at = np.flatnonzero(good)
            token[at] = trie.longest(data, pos[at])
        kept = np.zeros(len(data), bool)
        begin, at = stops - lengths, stops
        while len(at):
            kept[at] = True
            at = at - size[ending[at]]
            on = at > begin
            begin, at = begin[on], at[on]
        packed = ending[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept)[stops]).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, start, held = [], 0, 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= SPLIT or end == len(texts):
                out += self._encode_all(texts[start:end])
                start, held = end, 0
        return out

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        used = set().union(*split)
        new = used - self.known.keys()
        if len(self.known) + len(new) > CACHED:
            self.known = {p: self.known[p] for p in used - new}
        known, alone = self.known, [p for p in new if not 0 < len(p) <= CACHED_LENGTH]
        short = list(new.difference(alone))
        for i in range(0, len(short), SIDE_BY_SIDE):
            part = short[i : i + SIDE_BY_SIDE]
            known.update(zip(part, self.encode_short([p.encode("utf-8") for p in part])))
        for p in alone:
            known[p] = np.array(self.encode_piece(p.encode("utf-8").decode("latin-1")), "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for p in alone:
            del known[p]
        if len(known) > CACHED:
            self.known = {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that each packed text stands for; all are looked up at once."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        if not len(ids):
            return [b""] * len(coded)
        found = self.column.take(pa.array(ids))
        starts = np.frombuffer(found.buffers()[1], "<i8", len(ids) + 1)
        edges = starts[np.cumsum([0, *(len(c) // 4 for c in coded)])].tolist()
        data = memoryview(found.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _ranks(spark, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> tuple[DataFrame, str]:
    """docs with a struct column holding ``ids`` (packed little-endian unsigned 32-bit); and its name.

    The ranks file is read on the driver and broadcast; its size is that of the vocabulary. A null text
    counts as empty and gives no ids. Rows, repeated or not, are annotated in place.
    """
    ranks = _ranks(docs.sparkSession, path)
    name = fresh_name(docs, name)

    def make():
        own = codec(ranks.value, pattern)

        def work(batch: pa.RecordBatch):
            return [own.encode_all([t or "" for t in batch.column(text).to_pylist()])]
        return work

    return annotate(docs, name, StructType([StructField("ids", BinaryType(), False)]), make, text, SHARD), name


def decode(frame: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> tuple[DataFrame, str]:
    """frame with a struct column holding the decoded ``bytes`` of the packed ids; and its name. Null ids give none."""
    ranks = _ranks(frame.sparkSession, path)
    name = fresh_name(frame, name)

    def make():
        own = codec(ranks.value, pattern)

        def work(batch: pa.RecordBatch):
            return [own.decode_all([x or b"" for x in batch.column(ids).to_pylist()])]
        return work

    return annotate(frame, name, StructType([StructField("bytes", BinaryType(), False)]), make, ids, SHARD), name


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    coded, name = encode(docs.select("doc_id", "text"), path, pattern)
    coded = coded.select("doc_id", F.col(name)["ids"].alias("ids"))
    both, back = decode(coded, path, pattern)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col(back)["bytes"], 256).alias("decoded_sha256"),
    )
