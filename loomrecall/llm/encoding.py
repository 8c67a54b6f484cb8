"""Token ids of a corpus by a public byte-level BPE vocabulary.

Inside each task the distinct words of a batch become rows of length-bucketed, padded numpy matrices, whatever their length. Each round,
every row merges its leftmost pair of least rank, and from there to the right every further place of that pair: a pair with the new id
always ranks after the pair that made it, so these are the row's next merges anyway. Pairs are found in an open-addressed hash table, finished
rows are taken out and the rest is compacted. Words already met are kept in a bounded cache of the Python worker.

Defined cases: null and empty texts give an empty list; blank texts are encoded like others; strings of special tokens are ordinary
text; an empty table gives an empty table; repeated rows are encoded each; columns that are not named are not read.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomrecall.session import spread

#: Where the vocabulary files lie; a parameter everywhere below.
TOKENIZERS = os.environ.get("LOOMRECALL_TOKENIZERS", "/opt/tokenizers")
#: The word pattern of this vocabulary family (fixed value, published with it).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Widths of the narrow matrices; from the last one on they double. Cells of one matrix.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32)
CELLS = 1 << 21
#: Entries of the word cache of one Python worker; it is emptied when full.
CACHE = 200_000
NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from a pair of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, bits: int = 18):
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        rank = np.arange(len(keys), dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where the pair doesn't merge, or one side is padding) and merged id."""
        keys = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        keys = np.where((a < 0) | (b < 0), -2, keys)
        slot = self._slot(keys)
        rank, merged = np.full(keys.shape, NONE, np.int32), np.zeros(keys.shape, np.int32)
        open_ = np.ones(keys.shape, bool)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = open_ & (held == keys)
            rank[hit], merged[hit] = self.rank[slot[hit]], self.merged[slot[hit]]
            open_ &= ~hit & (held != -1)
            if not open_.any():
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return rank, merged


def load_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[str, np.ndarray]:
    """The id of each byte and the merges in rank order: three arrays of fixed size, from the public files."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte_ids = np.zeros(256, np.int32)
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        for line in f:
            token, rank = line.split()
            raw = base64.b64decode(token)
            if len(raw) == 1:
                byte_ids[raw[0]] = int(rank)
    as_ids = lambda xs: np.array([vocab[x] for x in xs], np.int32)
    return {"bytes": byte_ids, "left": as_ids(p[0] for p in pairs), "right": as_ids(p[1] for p in pairs), "merged": as_ids("".join(p) for p in pairs)}


def _places(hit: np.ndarray) -> np.ndarray:
    """``hit`` without the places that overlap the one before: of a run of neighbours (as in "aaaa") every other one, from the left."""
    if not (hit[:, 1:] & hit[:, :-1]).any():
        return hit
    at = np.arange(hit.shape[1])
    begins = np.where(hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1], at, 0)
    return hit & ((at - np.maximum.accumulate(begins, axis=1)) % 2 == 0)


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge each row (padded with -1) of ``ids`` to its end; the result is padded likewise."""
    out = np.full_like(ids, -1)
    rows = np.arange(len(ids))
    none = np.full((len(ids), 1), NONE, np.int32)
    rank, merged = pairs.find(ids[:, :-1], ids[:, 1:])
    rank, merged = np.concatenate([rank, none], axis=1), np.concatenate([merged, np.zeros_like(none)], axis=1)
    while len(rows):
        least = rank.min(axis=1)
        live = least != NONE
        if not live.all():
            out[rows[~live], : ids.shape[1]] = ids[~live]
            ids, rank, merged, rows, least = ids[live], rank[live], merged[live], rows[live], least[live]
            if not len(rows):
                break
        hit = _places(rank == least[:, None])
        ids[hit] = merged[hit]
        keep = ids >= 0
        keep[:, 1:] &= ~hit[:, :-1]
        size = keep.sum(axis=1)
        slot = np.arange(size.max()) < size[:, None]
        line, at = np.nonzero(hit)
        at = at - np.cumsum(hit, axis=1)[line, at] + 1  # where the merged ones stand in the shorter rows

        def shorter(x: np.ndarray, empty: int, keep: np.ndarray = keep, slot: np.ndarray = slot) -> np.ndarray:
            y = np.full(slot.shape, empty, np.int32)
            y[slot] = x[keep]
            return y

        ids, rank, merged = shorter(ids, -1), shorter(rank, NONE), shorter(merged, 0)
        for side in (at - 1, at):
            ok = (side >= 0) & (side + 1 < ids.shape[1])
            rank[line[~ok & (side >= 0)], side[~ok & (side >= 0)]] = NONE
            r, m = pairs.find(ids[line[ok], side[ok]], ids[line[ok], side[ok] + 1])
            rank[line[ok], side[ok]], merged[line[ok], side[ok]] = r, m
    return out


def widths(longest: int) -> Iterator[int]:
    """The widths of the matrices up to that of the longest word."""
    yield from BUCKETS
    width = BUCKETS[-1]
    while width < longest:
        width *= 2
        yield width


class Encoder:
    """Words to ids, with a bounded cache."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        import regex

        self.find = regex.compile(WORDS).findall
        self.bytes = vocabulary["bytes"]
        self.pairs = PairTable(vocabulary["left"], vocabulary["right"], vocabulary["merged"])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        raw = [np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8) for w in words]
        sizes = np.array([len(x) for x in raw])
        got: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lower = 0
        for width in widths(int(sizes.max(initial=0))):
            held = np.flatnonzero((sizes > lower) & (sizes <= width))
            lower = width
            step = max(1, CELLS // width)
            for inside in (held[k : k + step] for k in range(0, len(held), step)):
                lens = sizes[inside]
                grid = np.full((len(inside), int(lens.max())), -1, np.int32)
                mask = np.arange(grid.shape[1]) < lens[:, None]
                grid[mask] = self.bytes[np.concatenate([raw[i] for i in inside])]
                done = merge_matrix(grid, self.pairs)
                left = (done >= 0).sum(axis=1)
                for i, row, n in zip(inside, done, left, strict=True):
                    got[i] = row[:n]
        size = np.array([len(x) for x in got], np.int64)
        base = len(self.flat)
        self.known.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.concatenate([self.start, base + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *got])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        pieces = [self.find(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if len(self.known) > CACHE:
            self.forget()
        known = self.known
        new = {w for p in pieces for w in p if w not in known}
        if new:
            self.learn(list(new))
        index = np.fromiter((known[w] for p in pieces for w in p), np.int64, int(counts.sum()))
        size = self.size[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(total)]
        by_word = np.concatenate([[0], ends])
        offsets = by_word[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


@lru_cache(maxsize=2)
def _encoder(key: str, held: object) -> Encoder:
    return Encoder(held.value)


def portions(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Borders of runs of texts with about ``chars`` characters each; a longer text is a run of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t or "") > chars:
            yield begin, i
            begin, total = i, 0
        total += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``ident`` and ``ids`` (array<int>) of each row's ``text``, without special tokens. The vocabulary that is broadcast has a fixed size (about 50,000 merges)."""
    held = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary, folder))
    schema = T.StructType([df.schema[ident], T.StructField("ids", T.ArrayType(T.IntegerType(), True), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, held)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), encoder.encode(texts[a:b])], names=[ident, "ids"])

    return spread(df.select(ident, text)).mapInArrow(run, schema)
