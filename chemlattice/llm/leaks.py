"""Evaluation texts inside training text, by suffix arrays over shards of the corpus.

A word is a longest run of ASCII letters, digits and underscores, case
ignored. The corpus is cut into shards of up to ``SHARD_BYTES`` of text, whole
documents each. A shard's words are numbered, and its suffix array holds all
of its suffixes in order, sorted by doubling to the depth of ``depth`` words
(those that agree so far stand in order of place). A test suffix whose first
words all occur in the shard is looked up by binary search; the range it
finds holds all places where the corpus continues in the same way, and each
is extended to the longest verbatim match.

``spans``, ``leaked`` and ``clean`` build a shard's array in the task that reads
it, search it and let it go: nothing is shuffled but the matches, and ``clean``
drops affected documents in the same pass. ``build`` writes the arrays, so
that ``search`` answers further test sets from them alone, without reading
text again; a new part of a corpus is built on its own and put beside.

The items are sent to all tasks. Should they exceed ``ITEM_WORDS`` words, they
are searched in blocks of that size.

Defined results: NULL or empty texts and items, and those without id, hold nothing; items shorter than
``words`` words cannot match; equal texts each match under their own id; a
passage does not run across the ends of a document; other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.functions.canon import mix
from chemlattice.session import spread

WORDS = 13
DEPTH = 16  # words to which suffixes are sorted, at least
SHARD_BYTES = 3_000_000
ITEM_WORDS = 2_000_000

_KIND = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _KIND[_c] = ord(chr(_c).lower())
_TABLE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word; ``edges`` are bytes at which a text begins."""
    low = _KIND[data]
    inside = low > 0
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edges[edges < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    at = np.flatnonzero(inside)
    own = np.cumsum(~before[at]) - 1
    place = at - start[own]
    power = np.ones(int(place.max()) + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.uint64(_BASE)
        power = np.cumprod(power, dtype=np.uint64)
        first = np.searchsorted(at, start)
        h = np.add.reduceat(_TABLE[low[at]] * power[place], first)
    length = np.diff(np.append(first, len(at)))
    return mix(h + length.astype(np.uint64)), start, start + length


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and ends (one more entry than texts)."""
    column = column.cast(pa.large_string())
    column = pa.concat_arrays([column])
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


class Items:
    """All evaluation items as one run of word numbers, and their suffixes."""

    def __init__(self, ids: list[int], texts: list[str], words: int) -> None:
        data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        edges = np.cumsum([0, *map(len, data)])
        h, start, _ = words_of(np.concatenate([*data, np.zeros(0, np.uint8)]), edges[:-1])
        self.vocabulary, number = np.unique(h, return_inverse=True)
        owner = np.searchsorted(edges, start, side="right") - 1
        # A number that no word has stands after each item.
        stop = len(self.vocabulary)
        self.run = np.full(len(h) + len(ids), stop, np.int32)
        self.run[np.arange(len(h)) + owner] = number
        self.item_at = np.full(len(self.run), -1, np.int64)
        self.item_at[np.arange(len(h)) + owner] = np.array(ids, np.int64)[owner] if len(ids) else 0
        self.words = words


def doubled(run: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of ``run``: places in the order of what follows, to ``depth`` numbers at least; ties by place."""
    rank = np.unique(run, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        key = rank * (len(run) + 1)
        key[:-k] += rank[k:] + 1
        held, rank = np.unique(key, return_inverse=True)
        if len(held) == len(run):
            break
        k *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


class Shard:
    """Documents as one run of word numbers with a stop after each, where their words stand, and the suffix array."""

    def __init__(self, vocabulary: np.ndarray, run: np.ndarray, first: np.ndarray, length: np.ndarray, owner: np.ndarray, array: np.ndarray) -> None:
        self.vocabulary, self.run, self.first, self.length, self.owner, self.array = vocabulary, run, first, length, owner, array

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, depth: int) -> Shard:
        """``offsets`` are the bytes at which the documents begin, and the end."""
        h, start, end = words_of(data, offsets[:-1])
        vocabulary, number = np.unique(h, return_inverse=True)
        owner = np.searchsorted(offsets, start, side="right") - 1
        at = np.arange(len(h)) + owner
        n = len(h) + len(offsets) - 1
        run = np.zeros(n, np.int32)  # 0 is the stop
        first, length, own = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        run[at], first[at], length[at], own[at] = number + 1, start - offsets[owner], end - start, owner
        array = doubled(run, depth)
        return cls(vocabulary, run, first, length, own, array[np.searchsorted(run[array], 1) :])  # suffixes that begin with a stop are left out

    def find(self, items: Items) -> tuple[np.ndarray, ...]:
        """Document place, item, first byte, end and words of each longest match."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        w, n, m = items.words, len(self.run), len(items.run)
        if len(self.array) < w or m < w or not len(items.vocabulary):
            return none
        place = np.searchsorted(self.vocabulary, items.vocabulary)
        place[place == len(self.vocabulary)] = 0
        to = np.append(np.where(self.vocabulary[place] == items.vocabulary, place + 1, -1), -1)  # the shard's number of each item word
        run = to[items.run]
        total = np.concatenate([[0], np.cumsum(run > 0)])
        suffix = np.flatnonzero(total[w:] - total[:-w] == w)
        if not len(suffix):
            return none
        lo, hi = self._range(run, suffix, w)
        many = hi - lo
        which = np.repeat(suffix, many)
        at = self.array[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)].astype(np.int64)
        # Only where the match does not begin earlier: that one covers this one.
        new = ~((at > 0) & (which > 0) & (self.run[np.maximum(at - 1, 0)] == run[np.maximum(which - 1, 0)]))
        at, which = at[new], which[new]
        length = np.full(len(at), w, np.int64)
        alive = np.arange(len(at))
        while len(alive):
            i, j = at[alive] + length[alive], which[alive] + length[alive]
            ok = (i < n) & (j < m)
            alive, i, j = alive[ok], i[ok], j[ok]
            alive = alive[self.run[i] == run[j]]  # a stop equals nothing in an item
            length[alive] += 1
        last = at + length - 1
        return self.owner[at].astype(np.int64), items.item_at[which], self.first[at].astype(np.int64), self.first[last].astype(np.int64) + self.length[last], length

    def _range(self, run: np.ndarray, suffix: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the array of the suffixes that begin with the ``w`` words of each test suffix."""
        head = self.run[self.array]
        lo, hi = np.searchsorted(head, run[suffix]), np.searchsorted(head, run[suffix], side="right")
        span = np.arange(w)

        def bound(right: bool) -> np.ndarray:
            a, z = lo.copy(), hi.copy()
            todo = np.flatnonzero(a < z)
            while len(todo):
                mid = (a[todo] + z[todo]) >> 1
                at = self.array[mid].astype(np.int64)[:, None] + span
                held = np.where(at < len(self.run), self.run[np.minimum(at, len(self.run) - 1)], 0)
                key = run[suffix[todo][:, None] + span]
                differs = held != key
                k = differs.argmax(axis=1)
                row = np.arange(len(todo))
                less = np.where(differs[row, k], held[row, k] < key[row, k], right)
                a[todo[less]] = mid[less] + 1
                z[todo[~less]] = mid[~less]
                todo = todo[a[todo] < z[todo]]
            return a

        return bound(False), bound(True)


def match_shard(data: np.ndarray, offsets: np.ndarray, items: Items, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    return Shard.of(data, offsets, max(depth, items.words)).find(items)


_SPAN_SQL = "doc_id long, item_id long, first_byte long, end_byte long, n_words int"
_SPAN = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("n_words", pa.int32())])
_SHARD_SQL = "docs binary, vocabulary binary, run binary, first binary, length binary, owner binary, suffixes binary"
_SHARD = pa.schema([(c.split(" ")[0], pa.binary()) for c in _SHARD_SQL.split(", ")])


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with up to ``SHARD_BYTES`` of text, one row at least: rows, bytes and where each text begins."""
    data, offsets = texts_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SHARD_BYTES, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _spans_of(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    doc, item, first, end, n = found
    return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(item), pa.array(first), pa.array(end), pa.array(n.astype(np.int32))], schema=_SPAN)


def _in_task(held, depth: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in _pieces(b.column(1)) if b.num_rows else ():
                found = match_shard(data, offsets, held.value, depth)
                if len(found[0]):
                    yield _spans_of(b.column(0).to_numpy()[lo:hi], found)

    return each


def _blocks(items: DataFrame, words: int) -> Iterator[Items]:
    """The items, a bounded number of words at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if ids and size + n > ITEM_WORDS:
            yield Items(ids, texts, words)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Items(ids, texts, words)


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _each_block(rows: DataFrame, items: DataFrame, words: int, step) -> DataFrame:
    """``step`` of each block of items over the rows, put together."""
    out = None
    for block in _blocks(items, words):
        part = rows.mapInArrow(step(rows.sparkSession.sparkContext.broadcast(block)), _SPAN_SQL)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], _SPAN_SQL)


def spans(docs: DataFrame, items: DataFrame, words: int = WORDS, depth: int = DEPTH) -> DataFrame:
    """All longest verbatim matches of at least ``words`` words, with their places in the document (in bytes)."""
    return _each_block(_texts(docs), items, words, lambda held: _in_task(held, depth))


def leaked(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, item_id`` of each document and each item of which it holds a passage."""
    return _pairs(spans(docs, items, words), items)


def _pairs(found: DataFrame, items: DataFrame) -> DataFrame:
    kind = dict(items.dtypes)["item_id"]
    return found.select("doc_id", F.col("item_id").cast(kind).alias("item_id")).distinct()


def clean(docs: DataFrame, items: DataFrame, words: int = WORDS, depth: int = DEPTH) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns; dropped in the pass that finds them, so no text is shuffled."""
    out = spread(docs)
    at, ids = docs.columns.index("text"), docs.columns.index("doc_id")
    for block in _blocks(items, words):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                text = pc.if_else(b.column(ids).is_valid(), pc.fill_null(b.column(at).cast(pa.string()), ""), "")
                for lo, _, data, offsets in _pieces(text) if b.num_rows else ():
                    keep[lo + np.unique(match_shard(data, offsets, held.value, depth)[0])] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(each, docs.schema)
    return out


# Kept arrays


def build(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row for each shard: its documents, words and suffix array. Write it; the text is not needed for a search."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in _pieces(b.column(1)) if b.num_rows else ():
                s = Shard.of(data, offsets, depth)
                ids = b.column(0).to_numpy()[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, s.vocabulary, s.run, s.first, s.length, s.owner, s.array)], schema=_SHARD)

    return _texts(docs).mapInArrow(each, _SHARD_SQL)


def search(arrays: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """``spans`` of the corpus of which ``build`` gave the arrays; ``words`` is at most the depth they were built to."""

    def step(held):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    get = lambda c, t: np.frombuffer(b[c][i].as_buffer(), t)  # noqa: B023, E731
                    s = Shard(get("vocabulary", np.uint64), *(get(c, np.int32) for c in ("run", "first", "length", "owner", "suffixes")))
                    found = s.find(held.value)
                    if len(found[0]):
                        yield _spans_of(get("docs", np.int64), found)

        return each

    return _each_block(arrays, items, words, step)


def leaked_in(arrays: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """``leaked`` from kept arrays."""
    return _pairs(search(arrays, items, words), items)
