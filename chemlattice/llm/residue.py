"""Template residue, filler and served messages in place of files.

Labelled exemplars (``residue_exemplars``) of three kinds, messages, fillers and
skeleton lines, are kept in one inverted index from words to exemplars. Words
are weighted by inverse document frequency, counted over all documents of the
table. Passages of a document retrieve the exemplars that they share words
with, and are then compared:

* messages: windows of the document in which an exemplar is contained (TF-IDF
  weight of the shared words over the exemplar's weight) cover most of the
  document's weight. The same holds if all messages together contain nearly
  all the weight of a document;
* filler: windows whose own weight is mostly contained in one filler exemplar
  cover most of the document's weight;
* blanks: a line with an unfilled blank for a name, year, version, ... contains
  a skeleton line, and the document isn't itself a template. Writings of blanks
  are put under one name before the line retrieves anything.

Pseudo-Latin has many dialects. Words that stand with words of the usual one,
in windows where those are many, and hardly anywhere else in the corpus, are
learned as further words of that exemplar (``companions``).

Words that differ from copy to copy (hosts, paths, numbers, compound names)
weigh nothing. All passes are narrow: only counts of exemplar words and of
possible companions, whose numbers are bounded, are shuffled and sent to the
driver. Before a document is judged, bounds worked out from hashes of its
words show whether it can be a case at all; they never exclude one that is.

Defined results: NULL and empty texts, texts without words and rows without id are no case;
equal texts get equal results; texts are judged whole and alike at any length; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemlattice.llm import residue_exemplars as X
from chemlattice.llm.leaks import texts_of, words_of
from chemlattice.session import spread, stage

CONTAINED = 0.7  # share of an exemplar that a window must hold
COVERED = 0.5  # share of a document that such windows must cover
FILLED = 0.6  # the same for filler
POOLED = 0.85  # share of a document that all messages together must contain
WINDOW, STRIDE = 80, 40  # words
LEAST_FILLER = 3  # words
SEED_WINDOW, SEEDS = 20, 2  # words of a window, and how many of them must be pseudo-Latin, for its other words to be learned from
MOSTLY = 0.8  # share of a document that such windows must make up, so that code with a line of pseudo-Latin teaches nothing
COMPANY = 0.5  # share of a word's documents that must be made up so
COMMON = 0.05  # share of the documents with such windows in which a companion must stand: so they are bounded in number

NAME, BLANK, MASH = "xnamex", "xblankx", "xmashx"
MESSAGE, FILLER, LINE = 0, 1, 2  # kinds of exemplars

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _fields() -> str:
    return "|".join(sorted((f.replace(" ", "[ _-]") for f in X.BLANK_FIELDS), key=len, reverse=True))


def _blank_pattern() -> re.Pattern:
    """All writings of a blank. Those without brackets must be in capitals, as variables are written in the same way."""
    any_case, capitals = [], []
    for before, after in X.BLANK_STYLES:
        a, z = before.strip(), after.strip()
        gap = r"[ _-]" if before.endswith(" ") and a[-1:].isalpha() else r" ?"
        end = r"[ _-]" if after.startswith(" ") and z[:1].isalpha() else r" ?"
        bare = a.strip("_").isupper() or a in ("__", "$", "%", "@", "@@")
        guard = r"(?<![\w\])])" if a[:1] in "[_" or a[:1].isalpha() else ""
        one = f"{guard}{re.escape(a)}{'' if bare else gap}(?:{_fields()}){'' if bare else end}{re.escape(z)}"
        if not z:
            one += r"(?![a-z0-9])"
        (capitals if bare else any_case).append(one)
    upper = "|".join(re.sub(r"\[ _-\]", "_", c) for c in capitals)
    fields = _fields().replace("[ _-]", "_")
    upper = upper.replace(fields, fields.upper()).replace(_fields(), fields.upper())
    return re.compile(f"(?i:{'|'.join(any_case)})|(?:{upper})")


_BLANK = _blank_pattern()
_QUOTED = re.compile(r"`[^`\n]*`")
_TEMPLATE = re.compile(r"\{%[^%\n]{1,200}%\}|\{\{[^{}\n]{1,200}\}\}|<%[^%\n]{1,200}%>|#cmakedefine|@[A-Z][A-Z0-9_]*@")
_MASHED = re.compile(r"(?m)^[ \t]*[asdfjklqwer]+ asdf[ \t]*\r?$")
_VARIES = re.compile(
    r"https?://\S+|(?<![<\w])/[\w./-]+|\b[\w-]+(?:[./@:-][\w-]+)*[./@][\w-]+\b|\b\w*[0-9]\w*\b|\b[A-Z]?[a-z]+(?:[A-Z][a-z]*)+\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b\w*_\w*\b|\bNAME\b"
)
_WORD = re.compile(r"[^\W\d_]+|\n")


def words(text: str) -> list[str]:
    """Lower-case words with the things that vary put under one name; line ends stay."""
    text = _VARIES.sub(" xnamex ", text)
    return [w.lower() for w in _WORD.findall(text)]


class Exemplars:
    """The inverted index and the weights of its words."""

    def __init__(self, documents: int, frequency: dict[str, int], companions: tuple[str, ...] = ()) -> None:
        self.documents, self.frequency = documents, frequency
        status = [f.replace("STATUS", s) for f in X.STATUS_FRAMES for s in X.STATUS]
        status += [f.replace("STATUS", s.lower()) for f in X.STATUS_FRAMES[1:2] for s in X.STATUS]
        messages = [self._count(t) for t in X.MESSAGES + status]
        frame = self._count(X.FILLER_FRAME)
        fillers = [self._count(t) + frame for t in X.FILLER_SENTENCES]
        fillers += [self._count(X.FILLER_LATIN) + Counter(companions) + frame, self._count(X.FILLER_LIST), Counter([MASH, "asdf"])]
        lines = [self._count(t.replace("BLANK", f" {BLANK} ")) for t in X.BLANK_LINES]
        self.bags = messages + fillers + lines
        self.kind = [MESSAGE] * len(messages) + [FILLER] * len(fillers) + [LINE] * len(lines)
        # A word outside the exemplars weighs as much as their middle one.
        known = sorted(self._idf(f) for f in frequency.values() if f)
        self.other = known[len(known) // 2] if known else 1.0
        self.weight = {w: self._idf(frequency.get(w, 0)) for e in self.bags for w in e}
        self.weight |= {NAME: 0.0, BLANK: self.other, MASH: self.other}
        self.norm = [self.mass(e) for e in self.bags]
        self.postings: tuple[dict[str, list[int]], ...] = (defaultdict(list), defaultdict(list), defaultdict(list))  # by kind
        for i, (e, k) in enumerate(zip(self.bags, self.kind)):
            for w in e:
                if w != NAME:
                    self.postings[k][w].append(i)

    @staticmethod
    def _count(text: str) -> Counter:
        return Counter(w for w in words(text) if w not in ("\n", NAME))

    def _idf(self, frequency: int) -> float:
        return math.log((1 + self.documents) / (1 + frequency)) + 0.1

    def mass(self, bag: Counter) -> float:
        return sum(self.weight.get(w, self.other) * n for w, n in bag.items())

    @classmethod
    def vocabulary(cls) -> list[str]:
        return sorted({w for e in cls(0, {}).bags for w in e if w.isascii()})

    # Retrieval

    def retrieve(self, own: Counter, kind: int) -> dict[int, float]:
        """Exemplars of a kind that share words with a passage, and the weight of what they share."""
        score: dict[int, float] = defaultdict(float)
        for w, n in own.items():
            for i in self.postings[kind].get(w, ()):
                score[i] += self.weight[w] * min(n, self.bags[i][w])
        return score

    def arrays(self) -> Bounds:
        """What is needed to tell from hashes of words which documents may be cases."""
        names = sorted({w for k in (MESSAGE, FILLER) for w in self.postings[k] if w.isascii()} | {w for w in self.weight if w.isascii()})
        hashes = _hashes(names)
        order = np.argsort(hashes)
        names = [names[j] for j in order]
        place = {w: i for i, w in enumerate(names)}
        n = self.kind.count(MESSAGE)
        need, pairs = np.zeros(n), []
        for i, e in enumerate(self.bags[:n]):
            ascii_mass = sum(self.weight[w] * c for w, c in e.items() if w.isascii())
            need[i] = CONTAINED * self.norm[i] - (self.norm[i] - ascii_mass)
            pairs += [(place[w], i, self.weight[w] * c) for w, c in e.items() if w.isascii()]
        pairs.sort()
        start = np.searchsorted([p[0] for p in pairs], np.arange(len(names) + 1))
        weight = np.array([self.weight[w] for w in names])
        of = [np.array([w in self.postings[k] for w in names]) for k in (MESSAGE, FILLER)]
        foreign = max((self.weight[w] for w in self.postings[MESSAGE] if not w.isascii()), default=0.0)
        return Bounds(hashes[order], start, np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs]), need - 1e-9, weight, of[0], of[1], self.other, foreign, _hashes(["asdf"])[0])

    # Judging

    def judge(self, text: str, may_be_blank: bool = True) -> tuple[str, float] | None:
        """Kind of residue and the share of the document that is covered; None if it is none."""
        blank = may_be_blank and self._unfilled(text)
        text = _MASHED.sub(f" {MASH} asdf ", text)
        bag = [w for w in words(text) if w not in ("\n", NAME)]
        if bag:
            total = sum(self.weight.get(w, self.other) for w in bag)
            share = self._messages(bag) / total if total else 0.0
            if share >= COVERED:
                return "message", share
            if len(bag) >= 4 and len(bag) >= 0.3 * len(_WORD.findall(text)):
                share = sum(self.weight[w] for w in bag if w in self.postings[MESSAGE]) / total if total else 0.0
                if share >= POOLED:
                    return "message", share
            share = self._filler(bag) / total if total else 0.0
            if share >= FILLED and len(bag) >= LEAST_FILLER:
                return "filler", share
        return ("blank", 1.0) if blank else None

    def _messages(self, bag: list[str]) -> float:
        covered: set[int] = set()  # places of words; windows overlap
        for at in range(0, max(1, len(bag) - STRIDE), STRIDE):
            window = bag[at : at + WINDOW]
            held: set[str] = set()
            for i, s in self.retrieve(Counter(window), MESSAGE).items():
                if s >= CONTAINED * self.norm[i]:
                    held |= self.bags[i].keys()
            if held:
                covered.update(at + k for k, w in enumerate(window) if w in held)
        return sum(self.weight[bag[k]] for k in sorted(covered))

    def _filler(self, bag: list[str]) -> float:
        covered = 0.0
        posting = self.postings[FILLER]
        for at in range(0, len(bag), WINDOW):
            window = bag[at : at + WINDOW]
            total = sum(self.weight.get(w, self.other) for w in window)
            score: dict[int, float] = defaultdict(float)  # filler repeats its words, so each place counts
            both = 0.0
            for w in window:
                if w in posting:
                    both += self.weight[w]  # kinds of filler may stand beside each other
                    for i in posting[w]:
                        score[i] += self.weight[w]
            if total and max(score.values(), default=0.0) >= 0.6 * total:
                covered += both
        return covered

    def _unfilled(self, text: str) -> bool:
        plain = _QUOTED.sub(f" {NAME} ", text) if "`" in text else text
        marked, blanks = _BLANK.subn(f" {BLANK} ", plain)
        if not blanks or len(_TEMPLATE.findall(marked)) > blanks:
            return False
        for line in marked.splitlines():
            if BLANK not in line:
                continue
            own = Counter(w for w in words(line) if w not in ("\n", NAME))
            mass = self.mass(own)
            for i, shared in self.retrieve(own, LINE).items():
                if own[BLANK] and shared >= 0.75 * self.norm[i] and shared >= 0.6 * mass and (len(self.bags[i]) > 1 or len(own) == 1):
                    return True
        return False


class Bounds(NamedTuple):
    """Postings of messages by word hash, and weights of all exemplar words."""

    hashes: np.ndarray
    start: np.ndarray
    post: np.ndarray
    share: np.ndarray
    need: np.ndarray
    weight: np.ndarray
    is_message: np.ndarray
    is_filler: np.ndarray
    other: float
    foreign: float
    mash: int

    def may_be(self, data: np.ndarray, offsets: np.ndarray, h: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Documents that may be messages or filler; all that are, are among them.

        A message that is contained in a window is in the whole. The share of a pool of words is at most that of the words
        of the pool that the document has, over these and the words outside the pool that surely count: those in lower case
        that stand between blanks, which nothing puts under another name.
        """
        docs, n = len(offsets) - 1, len(self.need)
        owner = np.searchsorted(offsets, at, side="right") - 1
        k = np.searchsorted(self.hashes, h)
        k[k == len(self.hashes)] = 0
        known = self.hashes[k] == h
        seen = np.unique(owner[known] * len(self.hashes) + k[known])
        doc, word = seen // len(self.hashes), seen % len(self.hashes)
        many = self.start[word + 1] - self.start[word]
        p = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[word], many)
        score = np.bincount(np.repeat(doc, many) * n + self.post[p], weights=self.share[p], minlength=docs * n).reshape(docs, n)
        may = (score >= self.need).any(axis=1)
        space = np.zeros(len(data) + 2, bool)  # a blank before and behind all
        space[[0, -1]] = True
        space[1:-1] = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        sure = (space[at] | edge[at]) & (space[end + 1] | edge[end]) & (lower[end] - lower[at] == end - at)
        weight = np.where(known, self.weight[k], self.other)
        high = np.bincount(np.searchsorted(offsets, np.flatnonzero(data >= 128), side="right") - 1, minlength=docs) if len(data) else np.zeros(docs)
        for pool, least, slack in ((self.is_message, POOLED, self.foreign * high), (self.is_filler, FILLED, 0.0)):
            inside = known & pool[k]
            most = np.bincount(owner[inside], weights=weight[inside], minlength=docs) + slack
            rest = np.bincount(owner[sure & ~inside], weights=weight[sure & ~inside], minlength=docs)
            may |= (most > 0) & (most >= least * (most + rest) - 1e-6)
        may[owner[h == self.mash]] = True
        return may


def _blank_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with which the name of a blank may begin; of those, the ones that need no mark before them."""
    fields = {f.replace(" ", "_") for f in X.BLANK_FIELDS} | {f.split()[0] for f in X.BLANK_FIELDS}
    whole = {f"__{f}__" for f in fields}
    for before, _ in X.BLANK_STYLES:
        word = re.sub(r"[^A-Za-z_]", "", before).lower()
        if len(word) > 2:
            (whole if word.endswith("_") else fields).update({word + f for f in fields} if word.endswith("_") else {word})
    return np.sort(_hashes(sorted(fields | whole))), np.sort(_hashes(sorted(whole | {"xxx"})))


_MARKS = np.zeros(256, bool)
_MARKS[list({b.rstrip()[-1].encode()[0] for b, _ in X.BLANK_STYLES if not b.rstrip()[-1].isalpha()} | set(b"{<[(@%$#="))] = True


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def _may_be_unfilled(data: np.ndarray, h: np.ndarray, at: np.ndarray, names: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Words that may begin the name of a blank: a field's name behind a mark, or a word like YOUR_NAME."""
    rows = np.flatnonzero(_member(h, names))
    before = data[np.maximum(at[rows] - 1, 0)]
    space = before == 32
    before[space] = data[np.maximum(at[rows][space] - 2, 0)]
    return rows[(_MARKS[before] & (at[rows] > 0)) | _member(h[rows], whole)]


def _hashes(names: list[str]) -> np.ndarray:
    data = " ".join(names).encode()
    return words_of(np.frombuffer(data, np.uint8), np.zeros(1, np.int64))[0]


def _chunks(b: pa.RecordBatch, column: int, limit: int = 3_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(b.column(column))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _plain(docs: DataFrame, doc_id: str | None, text: str) -> DataFrame:
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != ""))
    keep = [F.col(text).cast("string").alias("text")]
    if doc_id:
        rows, keep = rows.where(F.col(doc_id).isNotNull()), [F.col(doc_id).cast("long").alias("doc_id"), *keep]
    return spread(rows.select(*keep))


def company(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Words that stand in windows of pseudo-Latin, in how many documents made up of these; those of a ``COMMON`` share of such documents.

    A window holds ``SEED_WINDOW`` words, so at most ``SEED_WINDOW / COMMON`` words a window of a document come to the driver.
    """
    seeds = np.sort(_hashes(sorted({w for w in X.FILLER_LATIN.split() if len(w) > 3})))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for _, _, data, offsets in _chunks(b, 0):
                h, at, end = words_of(data, offsets[:-1])
                seed = _member(h, seeds)
                owner = np.searchsorted(offsets, at, side="right") - 1
                for d in np.flatnonzero(np.bincount(owner[seed], minlength=1) >= 3).tolist():
                    rows = np.flatnonzero(owner == d)
                    near = np.zeros(len(rows), bool)
                    for lo in range(0, len(rows), SEED_WINDOW // 2):
                        if seed[rows[lo : lo + SEED_WINDOW]].sum() >= SEEDS:
                            near[lo : lo + SEED_WINDOW] = True
                    if near.mean() < MOSTLY:
                        continue
                    total[""] += 1
                    total.update({data[at[r] : end[r]].tobytes().decode().lower() for r in rows[near & ~seed[rows]].tolist()})
        names = [w for w in total if not w or w.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[w] for w in names], pa.int64())], names=["word", "n"])

    sums = _plain(docs, None, text).mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = stage(sums, "company")
    whole = sums.where("word = ''").select("n").first()
    if whole is None:
        return {}
    return {r["word"]: r["n"] for r in sums.where((F.col("word") != "") & (F.col("n") >= max(3, math.ceil(COMMON * whole["n"])))).collect()}


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int], tuple[str, ...]]:
    """Documents, in how many of them each exemplar word stands, and the companions. Counts all documents.

    Keep it with a corpus and give it to ``classify`` for a new part of it, to save two passes.
    """
    near = company(docs, text)
    names = sorted({*Exemplars.vocabulary(), *near})
    hashes = _hashes(names)
    order = np.argsort(hashes)
    vocabulary = hashes[order]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            for lo, hi, data, offsets in _chunks(b, 0):
                h, at, _ = words_of(data, offsets[:-1])
                k = np.searchsorted(vocabulary, h)
                k[k == len(vocabulary)] = 0
                ok = vocabulary[k] == h
                doc = np.searchsorted(offsets, at[ok], side="right") - 1
                total[:-1] += np.bincount(np.unique(doc * len(vocabulary) + k[ok]) % len(vocabulary), minlength=len(vocabulary))
                total[-1] += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

    rows = _plain(docs, None, text).mapInArrow(each, "at int, n long")
    n = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # one row for each word asked for
    by = {names[j]: n.get(k, 0) for k, j in enumerate(order)}
    learned = tuple(w for w, c in sorted(near.items()) if c >= COMPANY * by[w])
    held = set(Exemplars.vocabulary()) | set(learned)
    return n.get(len(vocabulary), 0), {w: c for w, c in by.items() if w in held}, learned


_OUT = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("share", pa.float64())])


class _Judge:
    """Judges batches of texts; made once in each task."""

    def __init__(self, counts: tuple, prefilter: bool = True) -> None:
        self.exemplars = Exemplars(*counts)
        self.bounds, self.prefilter = self.exemplars.arrays(), prefilter
        self.names, self.whole = _blank_words()

    @staticmethod
    def _has_blank(data: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Documents with a blank around one of the places; a blank is far shorter than what is looked at."""
        out = np.zeros(len(offsets) - 1, bool)
        owner = np.searchsorted(offsets, names, side="right") - 1
        for d, at in zip(owner.tolist(), names.tolist()):
            if not out[d]:
                near = data[max(offsets[d], at - 64) : min(offsets[d + 1], at + 96)].tobytes().decode(errors="replace")
                out[d] = _BLANK.search(near) is not None
        return out

    def found(self, texts: pa.Array) -> Iterator[tuple[int, str, float]]:
        """Row, kind and share of the texts that are residue."""
        for lo, hi, data, offsets in _chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            h, at, end = words_of(data, offsets[:-1])
            names = at[_may_be_unfilled(data, h, at, self.names, self.whole)]
            blank = self._has_blank(data, offsets, names)
            may = self.bounds.may_be(data, offsets, h, at, end)
            if not self.prefilter:
                may[:] = blank[:] = True
            for i in np.flatnonzero(may | blank).tolist():
                t = texts[lo + i].as_py()
                if may[i]:
                    got = self.exemplars.judge(t, bool(blank[i]))
                else:
                    got = ("blank", 1.0) if self.exemplars._unfilled(t) else None
                if got:
                    yield lo + i, *got


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple | None = None, prefilter: bool = True) -> DataFrame:
    """``doc_id, kind, share`` of the documents that are residue; kind is ``message``, ``filler`` or ``blank``.

    ``counts`` are those of ``frequencies``, by default of these documents. Without ``prefilter`` all texts are judged.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts or frequencies(docs, text))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(held.value, prefilter)
        for b in batches:
            out = [{"doc_id": b.column(0)[i].as_py(), "kind": k, "share": s} for i, k, s in judge.found(b.column(1))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return _plain(docs, doc_id, text).mapInArrow(each, "doc_id long, kind string, share double")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple | None = None) -> DataFrame:
    """The documents that are no residue, with all their columns; dropped in the pass that finds them, so no text is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(counts or frequencies(docs, text))
    at, ids = docs.columns.index(text), docs.columns.index(doc_id)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(held.value)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            held_text = pc.if_else(b.column(ids).is_valid(), pc.fill_null(b.column(at).cast(pa.string()), ""), "")
            for i, _, _ in judge.found(held_text):
                keep[i] = False
            yield b.filter(pa.array(keep))

    return spread(docs).mapInArrow(each, docs.schema)
