"""All similar pairs between set-valued records, by a size-aware overlap join.

Tokens are ordered from rare to frequent. Two sets with likeness of at least
t share at least ceil(t * size) tokens, so their first common token stands
among the first s + 1 of either, s = size - ceil(t * size), their second
among the first s + 2, and so on. Each record is sent to the inverted lists of
subsets of its tokens: a subset is the first common tokens of the pairs that
are found in its list.

Subsets form a tree. Those of one token come first; a list too long for a task to
hold (``HELD`` times ``LIST_ROWS`` records, fewer of large sets) is divided into those
of its next common tokens, level by level, as counts over all records show. Each
division sends a record some six times as often, so lists are divided as late as
memory allows. Of a list that is divided, the records small enough to have no
further common token go to a list of their own.

Lists stand in the order of the tree and are joined in waves of ``WAVE`` times as many
rows as there are sets. A wave's rows are shuffled, joined and deleted before the
next one's are sent, so the disk holds a multiple of the input however
often records are sent in all.

Small sets: within a list, members enumerate further common tokens
in the same way, some groups at a time (``STEP``), until a list is short or the subset has
``DEPTH`` tokens; the members of such a list are compared. Large sets (over ``LARGE``
tokens, of which the subsets would be too many) are compared with the whole
inverted list instead. The union of both is filtered by the exact likeness. A
pair comes out of one list only: the one whose tokens are exactly the pair's
first common ones. Before words are compared, places decide: the smaller set of
a pair shares even more of its own tokens, so the subset must stand further in
front in it, and what stands behind the subset bounds what can be shared.

A list that stays long with ``DEPTH`` tokens is cut into blocks of ``LIST_ROWS``, and
each pair of blocks is a task of its own. No list, candidate or pair is dropped.

Equal sets form one class and are compared once. ``set_pairs`` gives pairs
of classes, which with the classes' members are the whole result;
``expand`` makes pairs of records of it, a class in blocks of ``MEMBERS``.

Defined results: as in ``fingerprints``; sets without tokens match nothing;
equal sets have likeness 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.llm.fingerprints import N_BITS, N_WORDS, WORDS, classes, matrix, members, unpack, valid
from chemlattice.session import drop_staged, freeing, shared_dir, slots, stage, tasks_for

LARGE = 160
DEPTH = 6
SHORT = 128
LIST_ROWS = 20_000
HELD = 10  # times LIST_ROWS that a task holds of a list whose members are enumerated
STEP = 1_000_000  # members enumerated at once, unless one group has more
WAVE = 1.5  # rows of lists on disk at once, for each set
WAVE_ROWS = 500_000  # the same at least
NODES = 4096  # divided lists of a level at most; where there would be more, lists may be longer in proportion
BLOCK = 100_000
MEMBERS = 2000


def needed(size: np.ndarray, t: float) -> np.ndarray:
    """Tokens that a set must share with any partner."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _ordered(words: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sets' tokens as ranks, ascending within each set, one after another; the sets' sizes."""
    row, token = np.nonzero(unpack(words)[:, np.argsort(rank)])
    return token.astype(np.int16), np.bincount(row, minlength=len(words))


def _packed(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each set's tokens as bytes: steps from one to the next less 1, of 255 and more as bytes of 255 and the rest."""
    start = np.cumsum(sizes) - sizes
    step = np.diff(tokens.astype(np.int64), prepend=-1) - 1
    first = start[sizes > 0]
    step[first] = tokens[first]
    many = step // 255 + 1
    end = np.cumsum(many)
    data = np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
    data[end - 1] = step % 255
    offsets = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens and sizes that were packed."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    if not len(packed) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int16), np.zeros(len(packed), np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    last = data < 255  # a token's last byte
    upto = np.concatenate([[0], np.cumsum(last)])[offsets]  # tokens before each set
    sizes = np.diff(upto)
    total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], sizes)
    return (total[1:][last] - np.repeat(total[offsets[:-1]], sizes) + place).astype(np.int16), sizes


def _words_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words in which a bit's place is its token's rank."""
    out, end = np.empty((len(sizes), N_WORDS), np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), 8192):
        n = sizes[at : at + 8192]
        bits = np.zeros((len(n), N_BITS), np.uint8)
        bits[np.repeat(np.arange(len(n)), n), tokens[end[at] : end[at + len(n)]]] = 1
        out[at : at + len(n)] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def _weights(sizes: np.ndarray, t: float) -> np.ndarray:
    """What each set counts in a list: more if it has many further tokens, or is compared with the whole list."""
    return np.where(sizes > LARGE, HELD, np.clip((sizes - needed(sizes, t)) // 8, 1, HELD))


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N_BITS, np.int64)
    for b in batches:
        total += unpack(matrix(b)).sum(axis=0, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_BITS, dtype=np.int32)), pa.array(total)], names=["token", "n"])


def _totals(df: DataFrame) -> np.ndarray:
    got = df.groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # one row for each token there is
    out = np.zeros(N_BITS, np.int64)
    out[got["token"].to_numpy()] = got["n"].to_numpy()
    return out


class Tree:
    """Subsets of tokens by number: depth, last token, whether divided, and the children of those that are."""

    def __init__(self) -> None:
        self.depth, self.last, self.parent = np.ones(N_BITS, np.int64), np.arange(N_BITS), np.full(N_BITS, -1)
        self.rows = np.zeros(N_BITS, np.int64)  # by weight
        self.divided = np.zeros(N_BITS, bool)
        self.keys, self.child = np.zeros(0, np.int64), np.zeros(0, np.int64)  # parent * N_BITS + token, in order

    def divide(self, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the children of ``nodes``, of which ``counts`` holds the rows by token; those with two rows at least. Gives their numbers."""
        i, token = np.nonzero(counts > 1)
        new = len(self.depth) + np.arange(len(i))
        self.divided[nodes] = True
        keys = np.concatenate([self.keys, nodes[i] * N_BITS + token])
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.concatenate([self.child, new])[order]
        self.depth = np.concatenate([self.depth, self.depth[nodes[i]] + 1])
        self.last = np.concatenate([self.last, token])
        self.parent = np.concatenate([self.parent, nodes[i]])
        self.rows = np.concatenate([self.rows, counts[i, token]])
        self.divided = np.concatenate([self.divided, np.zeros(len(i), bool)])
        return new

    def place(self, t: float) -> int:
        """Puts the lists one after another, each subset before its children, so that each pair of blocks has a place; gives the rows of all."""
        limit = np.where(self.depth >= DEPTH, LIST_ROWS, HELD * LIST_ROWS)
        self.blocks = np.where(self.divided, 1, np.maximum(1, -(-self.rows // limit)))
        self.each = np.where(self.blocks > 1, -(-2 * self.rows // self.blocks), self.rows)  # rows of a pair of blocks, or of the list
        own = np.where(self.divided | (self.rows > 1), self.each * (self.blocks * (self.blocks + 1) // 2), 0)
        if t >= 0.8:  # the lists of those that end in a divided one hold sets of its tokens and of at most one more
            own[self.divided] = np.minimum(own[self.divided], N_BITS)
        total, levels = own.copy(), [np.flatnonzero(self.depth == d) for d in range(1, int(self.depth.max()) + 1)]
        for nodes in levels[:0:-1]:
            np.add.at(total, self.parent[nodes], total[nodes])
        self.begin = np.cumsum(total) - total  # right for the first level
        for nodes in levels[1:]:
            before = np.cumsum(total[nodes]) - total[nodes]
            up, first, which = np.unique(self.parent[nodes], return_index=True, return_inverse=True)
            self.begin[nodes] = (self.begin[up] + own[up] - before[first])[which] + before
        self.end = self.begin + total
        return int(total[levels[0]].sum())

    def levels(self, tokens: np.ndarray, sizes: np.ndarray, t: float, path: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """By level: record, place of the subset's last token in it, subset, depth. Only divided subsets lead to the next level; with ``path``, only those in it."""
        start, spare = np.cumsum(sizes) - sizes, sizes - needed(sizes, t)
        many = np.minimum(spare + 1, sizes)
        row = np.repeat(np.arange(len(sizes)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        node, depth = tokens[start[row] + place].astype(np.int64), 1
        if path is not None:
            ok = path[node]
            row, place, node = row[ok], place[ok], node[ok]
        while len(row):
            yield row, place, node, depth
            row, place, node = self._next(tokens, sizes, start, spare, row, place, node, depth)
            if not len(row) or not len(self.keys):
                return
            at = np.searchsorted(self.keys, node)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == node
            if path is not None:
                ok &= path[self.child[at]]
            row, place, node, depth = row[ok], place[ok], self.child[at[ok]], depth + 1

    def _next(self, tokens, sizes, start, spare, row, place, node, depth):  # noqa: ANN001
        """Next common tokens of the records of divided subsets, as keys."""
        go = self.divided[node]
        row, place, node = row[go], place[go], node[go]
        many = np.maximum(0, np.minimum(spare[row] + depth, sizes[row] - 1) - place)
        src = np.repeat(np.arange(len(row)), many)
        nxt = place[src] + 1 + np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        return row[src], nxt, node[src] * N_BITS + tokens[start[row[src]] + nxt].astype(np.int64)

    def children(self, tokens: np.ndarray, sizes: np.ndarray, t: float, nodes: np.ndarray) -> np.ndarray:
        """Rows, by weight, that each child of ``nodes``, which are all of one depth, would hold."""
        out = np.zeros((len(nodes), N_BITS), np.int64)
        start, spare = np.cumsum(sizes) - sizes, sizes - needed(sizes, t)
        number = np.full(len(self.depth), -1)
        number[nodes] = np.arange(len(nodes))
        wanted, weight = Tree.__new__(Tree), _weights(sizes, t)
        wanted.divided = number >= 0
        for row, place, node, depth in self.levels(tokens, sizes, t):
            if depth == self.depth[nodes[0]]:
                row, _, key = wanted._next(tokens, sizes, start, spare, row, place, node, depth)
                np.add.at(out.reshape(-1), number[key // N_BITS] * N_BITS + key % N_BITS, weight[row])
                break
        return out


_SETS_SQL = "rep long, tokens binary"
_SETS = pa.schema([("rep", pa.int64()), ("tokens", pa.binary())])
_SENT_SQL = "node int, a int, b int, block int, rep long, tokens binary"
_SENT = pa.schema([("node", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("tokens", pa.binary())])


def _pack(rank: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                yield pa.RecordBatch.from_arrays([part["rep"], _packed(*_ordered(matrix(part), rank))], schema=_SETS)

    return each


def _prefixes(t: float):
    """Per task, how many records, by weight, each token's inverted list gets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                tokens, sizes = _unpacked(b["tokens"])
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ok = place <= np.repeat(sizes - needed(sizes, t), sizes)
                np.add.at(total, tokens[ok], np.repeat(_weights(sizes, t), sizes)[ok])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_BITS, dtype=np.int32)), pa.array(total)], names=["token", "n"])

    return each


def _divided(tree: Tree, nodes: np.ndarray, t: float):
    """Per task, how many records, by weight, each child of the nodes gets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), N_BITS), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                total += tree.children(*_unpacked(b["tokens"].slice(at, 4000)), t, nodes)
        i, token = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(token.astype(np.int32)), pa.array(total[i, token])], names=["at", "token", "n"])

    return each


def _send(tree: Tree, t: float, lo: int, hi: int):
    """Rows of the lists whose places are from ``lo`` to before ``hi``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = (tree.begin < hi) & (tree.end > lo)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                tokens, sizes = _unpacked(b["tokens"])
                rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row, _, node, depth in tree.levels(tokens, sizes, t, path):
                    ends = tree.divided[node] & (sizes[row] <= math.floor(depth / t + 1e-9))
                    keep = ~tree.divided[node] & (tree.rows[node] > 1)
                    rows += [row[keep], row[ends]]
                    nodes += [node[keep], node[ends]]
                row, node = np.concatenate(rows), np.concatenate(nodes)
                nb = tree.blocks[node]
                own = (b["rep"].to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % nb
                times = np.repeat(np.arange(len(row)), nb)  # once for each block that the own block meets
                other = np.arange(len(times)) - np.repeat(np.cumsum(nb) - nb, nb)
                first, second = np.minimum(own[times], other), np.maximum(own[times], other)
                place = tree.begin[node[times]] + tree.each[node[times]] * (first * nb[times] - first * (first - 1) // 2 + second - first)
                ok = (place >= lo) & (place < hi)
                times, first, second = times[ok], first[ok], second[ok]
                who = pa.array(row[times])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in (node[times], first, second, own[times])] + [b["rep"].take(who), b["tokens"].take(who)], schema=_SENT
                )

    return each


_PAIR_SQL = "rep_a long, rep_b long, likeness double"
_PAIR = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64()), ("likeness", pa.float64())])


class _List:
    """The inverted list of one subset (or of two blocks of it)."""

    def __init__(self, last: int, depth: int, cross: bool, block: np.ndarray, rep: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, t: float) -> None:
        self.last, self.depth, self.cross, self.block, self.rep, self.tokens, self.sizes, self.t = last, depth, cross, block, rep, tokens, sizes, t
        self.start = np.cumsum(sizes) - sizes
        self.words = _words_of(tokens, sizes)
        self.spare = sizes - needed(sizes, t)
        self.short = sizes - np.ceil(2 * t / (1 + t) * sizes - 1e-9).astype(np.int64)  # the same against partners that are no smaller
        place = np.flatnonzero(tokens == last)
        self.place = np.full(len(sizes), -1, np.int64)
        owner = np.searchsorted(self.start, place, side="right") - 1
        self.place[owner] = place - self.start[owner]
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, last: np.ndarray, depth: int, ends: bool = False) -> None:
        """Pairs whose common tokens up to rank ``last`` should be ``depth`` many, the last at places px and py; with ``ends``, all their common tokens."""
        na, nb = self.sizes[x], self.sizes[y]
        need = np.ceil(self.t / (1 + self.t) * (na + nb) - 1e-9)  # what a pair must share
        ok = depth + np.minimum(na - px, nb - py) - 1 >= need
        ok &= ((na > nb) | (px < self.short[x] + depth)) & ((nb > na) | (py < self.short[y] + depth))
        if self.cross:
            ok &= self.block[x] != self.block[y]
        a, b, upto, need = x[ok], y[ok], last[ok], need[ok]
        if len(a) > 4096:  # half of the words bounds what is shared
            both = np.bitwise_count(self.words[a, ::2] & self.words[b, ::2]).sum(axis=1, dtype=np.int16)
            rest = np.minimum(self.odd[a], self.odd[b])
            ok = both + rest >= need
            a, b, upto = a[ok], b[ok], upto[ok]
        common = self.words[a] & self.words[b]
        both = np.bitwise_count(common).sum(axis=1, dtype=np.int64)
        like = both / (self.sizes[a] + self.sizes[b] - both)
        hit = np.flatnonzero((like >= self.t) & (both == depth) if ends else like >= self.t)
        if not len(hit):
            return
        a, b, upto, common = a[hit], b[hit], upto[hit], common[hit]
        word = upto >> 6
        mask = np.where(np.arange(N_WORDS)[None] < word[:, None], np.uint64(2**64 - 1), np.uint64(0))
        mask[np.arange(len(hit)), word] = np.uint64(2**64 - 1) >> (63 - (upto & 63)).astype(np.uint64)
        first = np.bitwise_count(common & mask).sum(axis=1, dtype=np.int64) == depth
        self.out.append((self.rep[a[first]], self.rep[b[first]], like[hit][first]))

    @cached_property
    def odd(self) -> np.ndarray:
        """Tokens in every other word."""
        return np.bitwise_count(self.words[:, 1::2]).sum(axis=1, dtype=np.int16)

    def scan(self, large: np.ndarray) -> None:
        """Large sets against the whole list."""
        n = len(self.sizes)
        is_large = np.zeros(n, bool)
        is_large[large] = True
        step = max(1, BLOCK // max(1, n))
        for s in range(0, len(large), step):
            x = np.repeat(large[s : s + step], n)
            y = np.tile(np.arange(n), len(large[s : s + step]))
            ok = (x != y) & (~is_large[y] | (x < y))
            x, y = x[ok], y[ok]
            for lo in range(0, len(x), BLOCK):
                i, j = x[lo : lo + BLOCK], y[lo : lo + BLOCK]
                self.compare(i, j, self.place[i], self.place[j], np.full(len(i), self.last), self.depth)

    def enumerate(self, small: np.ndarray, ends: bool = False) -> None:
        """Subsets of further common tokens, level by level; with ``ends``, only pairs that have none."""
        todo = [(small, self.place[small], np.zeros(len(small), np.int64), np.array([self.last]), self.depth)]  # last: of each group
        if ends:
            self._ending(*todo.pop())
        while todo:
            member, index, group, last, depth = todo.pop()
            order = np.lexsort((self.sizes[member], group))
            member, index, group = member[order], index[order], group[order]
            count = np.bincount(group, minlength=len(last))
            leaf = (count <= SHORT) | (depth >= DEPTH)
            self._pairs(member, index, group, count, leaf, last, depth)
            go = ~leaf[group]
            member, index, group = member[go], index[go], group[go]
            self._ending(member, index, group, last, depth)
            # The next common token of a member stands after the last one and among its first spare + depth + 1.
            many = np.maximum(0, np.minimum(self.spare[member] + depth, self.sizes[member] - 1) - index)
            before = np.cumsum(many) - many
            at = np.flatnonzero(np.diff(group, prepend=-1))  # where groups begin
            cut = at[np.flatnonzero(np.diff(before[at] // STEP, prepend=-1))]
            for lo, hi in zip(cut, [*cut[1:], len(member)]):
                found = self._further(member[lo:hi], index[lo:hi], group[lo:hi], many[lo:hi])
                if len(found[0]):
                    todo.append((*found, depth + 1))

    def _further(self, member: np.ndarray, index: np.ndarray, group: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members of the groups of a further token, of which each member has ``many``."""
        src = np.repeat(np.arange(len(member)), many)
        nxt = index[src] + 1 + np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        token = self.tokens[self.start[member[src]] + nxt].astype(np.int64)
        keys, inverse, n = np.unique(group[src] * N_BITS + token, return_inverse=True, return_counts=True)
        keep = n > 1
        stay = keep[inverse]
        return member[src][stay], nxt[stay], (np.cumsum(keep) - 1)[inverse[stay]], (keys[keep] % N_BITS).astype(np.int64)

    def _pairs(self, member: np.ndarray, index: np.ndarray, group: np.ndarray, count: np.ndarray, leaf: np.ndarray, last: np.ndarray, depth: int) -> None:
        """Compares the members of each leaf, which stand in order of size, with those that follow and aren't too large."""
        rows = np.flatnonzero(leaf[group])
        size = self.sizes[member]
        key = group * (2 * N_BITS) + size
        until = np.searchsorted(key, group[rows] * (2 * N_BITS) + np.floor(size[rows] / self.t + 1e-9).astype(np.int64), side="right")
        after = np.where(index[rows] < self.short[member[rows]] + depth, until - rows - 1, 0)  # the smaller one, whose subset must stand in front
        self._deal(member, index, rows, after, last[group], depth)

    def _ending(self, member: np.ndarray, index: np.ndarray, group: np.ndarray, last: np.ndarray, depth: int) -> None:
        """Compares the members of each group that are similar even if they share its tokens only.

        These have sizes of at most depth + depth / t together, so all pairs compared are similar.
        """
        both = math.floor(depth + depth / self.t + 1e-9)
        few = self.sizes[member] <= both - depth
        member, index, group = member[few], index[few], group[few]
        key = group * (both + 1) + self.sizes[member]
        order = np.argsort(key, kind="stable")
        member, index, group, key = member[order], index[order], group[order], key[order]
        rows = np.arange(len(member))
        until = np.searchsorted(key, group * (both + 1) + both - self.sizes[member], side="right")
        self._deal(member, index, rows, np.maximum(0, until - rows - 1), last[group], depth, ends=True)

    def _deal(self, member: np.ndarray, index: np.ndarray, rows: np.ndarray, after: np.ndarray, last: np.ndarray, depth: int, ends: bool = False) -> None:
        """Compares each of ``rows`` with the ``after`` members that follow it, in blocks."""
        rows, after = rows[after > 0], after[after > 0]
        upto = np.cumsum(after)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
            n = after[lo:hi]
            x = np.repeat(rows[lo:hi], n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            for s in range(0, len(x), 2 * BLOCK):
                i, j = x[s : s + 2 * BLOCK], y[s : s + 2 * BLOCK]
                self.compare(member[i], member[j], index[i], index[j], last[i], depth, ends)
            lo = hi


def _join(tree: Tree, t: float):
    def finish(key: tuple[int, int, int], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks()
        if b.num_rows < 2:
            return
        tokens, sizes = _unpacked(pa.concat_arrays(b["tokens"].chunks))
        node = key[0]
        one = _List(int(tree.last[node]), int(tree.depth[node]), key[1] != key[2], b["block"].to_numpy(), b["rep"].to_numpy(), tokens, sizes, t)
        is_large = (sizes > LARGE) & ~tree.divided[node]
        if is_large.any():
            one.scan(np.flatnonzero(is_large))
        one.enumerate(np.flatnonzero(~is_large), ends=bool(tree.divided[node]))
        if one.out:
            a, o, x = (np.concatenate(y) for y in zip(*one.out))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, o)), pa.array(np.maximum(a, o)), pa.array(x)], schema=_PAIR)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b[c].to_numpy() for c in ("node", "a", "b")])
            edge = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                now = tuple(k[:, lo].tolist())
                if now != key:
                    if held:
                        yield from finish(key, held)
                    key, held = now, []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from finish(key, held)

    return each


def ordered(cls: DataFrame) -> DataFrame:
    """``rep, tokens``: each class's tokens from rare to frequent, written; ``cls`` should be a written table."""
    frequency = _totals(cls.select(*WORDS).mapInArrow(_count_bits, "token int, n long"))
    rank = np.empty(N_BITS, np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(N_BITS)
    return stage(cls.select("rep", *WORDS).mapInArrow(_pack(rank), _SETS_SQL), "sets")


def _tree(sets: DataFrame, t: float) -> Tree:
    tree = Tree()
    tree.rows = _totals(sets.mapInArrow(_prefixes(t), "token int, n long"))
    fresh = np.arange(N_BITS)
    for _ in range(1, DEPTH):
        longest = max(HELD * LIST_ROWS, math.ceil(int(tree.rows[fresh].sum()) / NODES))
        nodes = fresh[tree.rows[fresh] > longest]
        if not len(nodes):
            break
        got = sets.mapInArrow(_divided(tree, nodes, t), "at int, token int, n long").groupBy("at", "token").agg(F.sum("n").alias("n")).toPandas()  # at most NODES * N_BITS rows
        counts = np.zeros((len(nodes), N_BITS), np.int64)
        counts[got["at"].to_numpy(), got["token"].to_numpy()] = got["n"].to_numpy()
        fresh = tree.divide(nodes, counts)
    return tree


def set_pairs(sets: DataFrame, t: float = 0.8) -> DataFrame:
    """``rep_a, rep_b, likeness`` with rep_a < rep_b, once for each pair of the classes of ``ordered``; written, wave by wave."""
    if not 0 < t <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    spark = sets.sparkSession
    tree = _tree(sets, t)
    total, size = tree.place(t), max(WAVE_ROWS, math.ceil(WAVE * sets.count()))
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    for lo in range(0, max(1, total), size):
        tasks = max(4 * slots(spark), math.ceil(min(size, total - lo) / 200_000))
        sent = sets.mapInArrow(_send(tree, t, lo, lo + size), _SENT_SQL)
        pairs = sent.repartition(tasks, "node", "a", "b").sortWithinPartitions("node", "a", "b").mapInArrow(_join(tree, t), _PAIR_SQL)
        with freeing(spark):
            pairs.write.mode("append").parquet(path)
    return spark.read.schema(_PAIR_SQL).parquet(path)


def expand(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of records from pairs of classes and, within a class, from its members ``rep, mol_id``.

    A class's members travel as lists of about ``MEMBERS`` ids. Pairs of lists are dealt out before they become pairs of
    records, so no task gets all pairs of a class that holds a third of all rows.
    """
    crowded = named.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS).select("rep", F.ceil(F.col("n") / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("mol_id"), F.coalesce("parts", F.lit(1)))
    lists = named.join(crowded, "rep", "left").groupBy("rep", part.cast("int").alias("part")).agg(F.collect_list("mol_id").alias("ids"))
    lists = stage(lists, "lists")
    a = lists.select(F.col("rep").alias("rep_a"), F.col("part").alias("part_a"), F.col("ids").alias("a"))
    b = lists.select(F.col("rep").alias("rep_b"), F.col("part").alias("part_b"), F.col("ids").alias("b"))
    other = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b")
    own = lists.where("size(ids) > 1 or part > 0").select(F.col("rep").alias("rep_a")).distinct()
    same = own.join(a, "rep_a").join(b.withColumnRenamed("rep_b", "rep_a"), "rep_a").where("part_a <= part_b").withColumn("rep_b", F.col("rep_a"))
    met = other.unionByName(same.select(other.columns)).repartition("rep_a", "rep_b", "part_a", "part_b")
    each = met.select("rep_a", "rep_b", "part_a", "part_b", F.explode("a").alias("a"), "b").select("rep_a", "rep_b", "part_a", "part_b", "a", F.explode("b").alias("b"))
    each = each.where((F.col("rep_a") != F.col("rep_b")) | (F.col("part_a") != F.col("part_b")) | (F.col("a") < F.col("b")))
    return each.select(F.least("a", "b").alias("mol_id_a"), F.greatest("a", "b").alias("mol_id_b"))


def _linked(table: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their members, ``rep, mol_id``, and pairs of classes. What they are made from is deleted as soon as it has been used."""
    if not 0 < t <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    spark, n, rows = table.sparkSession, table.count(), valid(table)
    with freeing(spark):
        cls = stage(classes(rows), "classes", a_file=math.ceil(max(1, n) / tasks_for(spark, n, 50_000)))
        mem = stage(members(rows), "members")
        named = stage(mem.join(cls.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "mol_id"), "named")
        drop_staged(spark, mem)
        sets = ordered(cls)
    drop_staged(spark, cls)
    pairs = set_pairs(sets, t)
    drop_staged(spark, sets)
    return named, pairs


def similar_pairs(table: DataFrame, t: float = 0.8) -> DataFrame:
    """``mol_id_a, mol_id_b`` with a < b: all pairs of molecules whose sets have likeness of at least t."""
    return expand(*_linked(table, t))


def linked_rows(table: DataFrame, t: float = 0.8) -> DataFrame:
    """One row for each molecule: its class and the number of other molecules its set is similar to.

    Copies are not expanded into pairs here, so a class that holds a third of all rows costs no more than another.
    """
    named, pairs = _linked(table, t)
    size = named.groupBy("rep").agg(F.count("*").alias("n"))
    ends = pairs.select(F.col("rep_a").alias("class_id"), F.col("rep_b").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("class_id"), F.col("rep_a").alias("rep")))
    links = ends.join(size, "rep").groupBy("class_id").agg(F.sum("n").alias("others"))
    return (
        named.withColumnRenamed("rep", "class_id")
        .join(size.withColumnRenamed("rep", "class_id"), "class_id")
        .join(links, "class_id", "left")
        .select("mol_id", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
