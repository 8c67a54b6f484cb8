"""Held-out test passages inside a training corpus, by suffix arrays over shards of the corpus.

Both sides become runs of words: text is NFC-normalized, invisible characters go, case is folded, and everything that is no letter or
digit ends a word. Words that no test item has cannot be part of a match, so a shard keeps only runs of test words, parted by a
sentinel. Each shard (a portion of a task's documents) is sorted into a suffix array; every suffix of every test item is
binary-searched in it, and the matches are extended to their full length. Suffixes that begin alike are sorted by the word before them,
so the places where a match could begin earlier are one range of the array and are never listed.

The test side is cut into blocks by the running sum of its characters, at most ``BLOCK_CHARS`` in one unless a single item is longer.
A block's numbered words and suffix starts are made once and broadcast; each task takes the blocks one after another over the documents
it has read and tokenized once, so any number of items works and the corpus is scanned once.

Defined cases: null or empty texts match nothing; items with fewer than ``min_words`` words match nothing; repeated items count for
each of their ids; repeated documents each come out; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrecall.session import spread

MIN_WORDS = 12
#: Characters of test text that one broadcast may hold.
BLOCK_CHARS = 8_000_000
#: Characters of documents in one shard.
SHARD_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
#: Default-ignorable code points that are no format characters by category.
_IGNORABLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted({*_IGNORABLE, *(c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cf")})) + "\U000e0001-\U000e01ef]")


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text)).casefold()
    else:
        text = text.lower()
    return _WORD.findall(text)


def suffix_ranks(seq: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each start of ``seq`` by its first ``depth`` values, by prefix doubling; equal ones share a rank."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and len(seq):
        by = min(step, depth - step)  # at the last step the two halves overlap, so that exactly ``depth`` values count
        follow = np.full(len(seq), 0, np.int64)
        follow[:-by] = rank[by:] + 1
        rank = np.unique(rank * (len(seq) + 2) + follow, return_inverse=True)[1].astype(np.int64)
        step += by
    return rank


def _windows(seq: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    padded = np.concatenate([seq, np.zeros(n, seq.dtype)])
    return padded[starts[:, None] + np.arange(n)]


def _below(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
    differs = a != b
    first = differs.argmax(axis=1)
    line = np.arange(len(a))
    less = a[line, first] < b[line, first]
    return np.where(differs[line, first], less, or_equal)


def _search(seq: np.ndarray, order: np.ndarray, want: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of each row of ``want`` among the suffixes, all rows at once."""
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        go = _below(_windows(seq, order[mid], want.shape[1]), want[open_], upper)
        lo[open_[go]] = mid[go] + 1
        hi[open_[~go]] = mid[~go]
    return lo


class TestSide:
    """The words of a block of test items as one sequence of numbers, items parted by 0: the arrays that are broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.vocabulary: dict[str, int] = {}
        seq, owner, start = [], [], []
        for ident, text in items:
            ws = words_of(text)
            if len(ws) < min_words:
                continue
            seq += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws] + [0]
            owner += [ident] * (len(ws) + 1)
            start += [*range(len(ws)), -1]
        self.seq, self.owner, self.at = np.array(seq, np.int64), np.array(owner, np.int64), np.array(start, np.int64)
        self.n = min_words
        ends = np.flatnonzero(self.seq == 0)
        left = ends[np.searchsorted(ends, np.arange(len(self.seq)))] - np.arange(len(self.seq)) if len(ends) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(left >= min_words)


def match_shard(side: TestSide, docs: list[list[str]]) -> list[np.ndarray]:
    """For each maximal match: document number, item id, words matched, first word in the document, first word in the item."""
    seq, owner, place = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
    get = side.vocabulary.get
    for d, ws in enumerate(docs):
        if len(ws) < side.n:
            continue
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        gaps = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
        for k in np.flatnonzero(np.diff(gaps) > side.n):
            a, b = gaps[k] + 1, gaps[k + 1]
            seq += [ids[a:b], np.zeros(1, np.int64)]
            owner.append(np.full(b - a + 1, d))
            place.append(np.arange(a, b + 1))
    text, doc, at = np.concatenate(seq), np.concatenate(owner), np.concatenate(place)
    none = [np.zeros(0, np.int64)] * 5
    if len(text) == 1 or not len(side.starts):
        return none
    rank = suffix_ranks(text, side.n)
    before = np.concatenate([np.zeros(1, np.int64), text[:-1]])
    order = np.lexsort((before, rank))
    want = _windows(side.seq, side.starts, side.n)
    low, high = _search(text, order, want, False), _search(text, order, want, True)
    met = high > low
    starts, low, high = side.starts[met], low[met], high[met]
    if not len(starts):
        return none
    # Of the suffixes from low to high, those behind the test word's own forerunner belong to a longer match.
    wide = np.int64(text.max()) + 2
    key = rank[order] * wide + before[order]
    prior = np.where(starts > 0, side.seq[starts - 1], 0)
    own = rank[order[low]] * wide + prior
    cut = np.searchsorted(key, own), np.searchsorted(key, own, "right")
    skip = np.where((prior > 0) & (prior < wide), cut[1] - cut[0], 0)
    left, right = np.where(skip > 0, cut[0], high), np.where(skip > 0, cut[1], high)
    begins, ends, t = np.concatenate([low, right]), np.concatenate([left, high]), np.concatenate([starts, starts])
    hits = ends - begins
    total = int(hits.sum())
    if not total:
        return none
    t = np.repeat(t, hits)
    x = order[np.repeat(begins - (np.cumsum(hits) - hits), hits) + np.arange(total)]
    length = np.full(len(t), side.n, np.int64)
    grow = np.arange(len(t))
    while grow.size:
        a, b = side.seq[t[grow] + length[grow]], text[x[grow] + length[grow]]
        grow = grow[(a == b) & (a != 0)]
        length[grow] += 1
    return [doc[x], side.owner[t], length, at[x], side.at[t]]


def item_blocks(test: DataFrame, min_words: int) -> Iterator[TestSide]:
    """The test items (i, t) as blocks of bounded size. They stream through the driver a block at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in test.orderBy("i", "t").toLocalIterator():
        if held and size + len(r.t) > BLOCK_CHARS:
            yield TestSide(held, min_words)
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    yield TestSide(held, min_words)


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """One row for each maximal run of at least ``min_words`` words shared by a document and a test item: ids, ``words``, ``doc_word``, ``item_word``."""
    test = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("words", "doc_word", "item_word")]])
    source = spread(documents.select(doc_id, text).where(F.length(text) >= 2 * min_words - 1))
    blocks = [source.sparkSession.sparkContext.broadcast(side) for side in item_blocks(test, min_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[object] = []
        docs: list[list[str]] = []
        size = 0
        batch_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            for held in blocks:
                doc, item, length, at, start = match_shard(held.value, docs)
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], batch_type), *[pa.array(x, pa.int64()) for x in (item, length, at, start)]], names=schema.names)
                if len(blocks) > 1:
                    _forget(held)

        for batch in batches:
            batch_type = batch.schema.field(0).type
            for ident, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(ident)
                docs.append(words_of(body))
                size += len(body or "")
                if size >= SHARD_CHARS:
                    yield from flush()
                    ids, docs, size = [], [], 0
        if ids:
            yield from flush()

    return source.mapInArrow(run, schema)


def _forget(held: object) -> None:
    """Let go of a broadcast's value in this Python worker; it is read again from the local file when it is next asked for."""
    held.__dict__.pop("_value", None)


def leaked_items(leaks: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return leaks.select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage."""
    return documents.join(leaks.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")
