from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from chemlattice.llm import leaks, packing, residue

WORD = re.compile(r"[A-Za-z0-9_]+")


# Leaks


def _brute(docs, items, n):
    def grams(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs if d is not None for i, g in held.items() if g & grams(t)}


@pytest.mark.parametrize("n", [1, 3, 13])
def test_leaks_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_BYTES", 700)
    rng = random.Random(n)
    vocabulary = ["alpha", "Beta", "x_1", "42", "é", "gamma", "delta"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "--", " (", "…"]) for _ in range(k))
    items = [(i, text(rng.randint(0, 40))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(60):
        t = text(rng.randint(0, 30))
        if d % 3 == 0:
            w = WORD.findall(rng.choice(items[:12])[1])
            s = rng.randint(0, max(0, len(w) - 13))
            t += " .. " + " ; ".join(x.upper() for x in w[s : s + rng.randint(5, 20)]) + " " + text(3)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, "é" * 5000 + docs[3][1]), (104, "…"), (None, docs[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string")
    want = _brute(docs, items, n)
    assert {tuple(r) for r in leaks.leaked(df, q, n).collect()} == want
    monkeypatch.setattr(leaks, "ITEM_WORDS", 30)
    assert {tuple(r) for r in leaks.leaked(df, q, n).collect()} == want
    assert {r["doc_id"] for r in leaks.clean(df, q, n).collect()} == {d for d, _ in docs} - {d for d, _ in want}  # a row without id stays
    by = dict(docs)
    for r in leaks.spans(df, q, n).collect():
        found = [w.lower() for w in WORD.findall(by[r["doc_id"]].encode()[r["first_byte"] : r["end_byte"]].decode())]
        assert len(found) == r["n_words"] >= n
        item = [w.lower() for w in WORD.findall(dict(items)[r["item_id"]])]
        assert any(item[i : i + len(found)] == found for i in range(len(item)))


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert leaks.leaked(d.limit(0), q, 2).count() == 0 and leaks.leaked(d, q.limit(0), 2).count() == 0
    assert leaks.leaked(d, q, 3).count() == 1 and leaks.leaked(d, q, 4).count() == 0


def test_words_are_told_apart():
    text = "a b ab ba A aB _ __ 0 00 " + "z" * 1000 + " " + "z" * 1001
    data = np.frombuffer(text.encode(), np.uint8)
    h, start, end = leaks.words_of(data, np.zeros(1, np.int64))
    assert [text[a:b] for a, b in zip(start, end)] == WORD.findall(text)
    by = {}
    for w, x in zip(WORD.findall(text), h):
        assert by.setdefault(w.lower(), x) == x
    assert len(set(by.values())) == len(by)


# Packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no public vocabulary here")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 100, 600)
    for docs, attention in ((1000, 1e9), (3, 1e9), (1000, 6000.0)):
        box = packing.vector_best_fit(tokens, 100, docs, attention, rule=rule)
        used, cost, many = np.bincount(box, weights=tokens), np.bincount(box, weights=tokens.astype(float) ** 2), np.bincount(box)
        assert used.max() <= 100 and many.max() <= docs
        assert ((cost <= attention) | (many == 1)).all()  # what alone costs more than a container has stands alone
        assert sorted(set(box)) == list(range(box.max() + 1))
    box = packing.vector_best_fit(tokens, 100, 1000, 1e9, rule=rule)
    assert box.max() + 1 <= np.ceil(tokens.sum() / 100) * 1.06


def test_attention_is_a_constraint():
    box = packing.vector_best_fit(np.array([5, 5, 5, 5]), 100, 100, 60.0)
    assert np.bincount(box, weights=np.full(4, 25.0)).max() <= 60 and box.max() == 1
    assert len(packing.vector_best_fit(np.array([], np.int64), 10, 1, 1.0)) == 0


def test_each_capacity_decides():
    tokens = np.array([60, 40, 30, 20, 10, 10])
    free = packing.vector_best_fit(tokens, 100, 10, 1e9).tolist()
    assert free == [0, 0, 1, 1, 1, 1]
    assert packing.vector_best_fit(tokens, 100, 2, 1e9).tolist() != free  # places for documents
    assert packing.vector_best_fit(tokens, 100, 10, 4000.0).tolist() != free  # attention: 3600 + 1600 is too much
    assert packing.vector_best_fit(tokens, 70, 10, 1e9).tolist() != free  # tokens


@needs_vocabulary
def test_targets_may_state_their_capacities(spark):
    df = spark.createDataFrame([(i, "word " * (5 + i % 7)) for i in range(50)], "doc_id long, text string")
    targets = spark.createDataFrame([(1, 64, None, None), (2, 64, 2, None), (3, 64, None, 80.0)], "target_id int, capacity_tokens int, max_documents int, attention_budget double")
    rows = packing.pack(df, targets)
    most = {r["target_id"]: r["m"] for r in rows.groupBy("target_id", "container_id").count().groupBy("target_id").agg({"count": "max"}).toDF("target_id", "m").collect()}
    assert most[1] > 2 and most[2] == 2 and most[3] < most[1]
    by = {(r["target_id"], r["limit"]): r for r in packing.limits(rows, targets).collect()}
    assert by[2, "documents"]["n_fullest"] > 0 and by[3, "attention"]["n_fullest"] > 0 and by[2, "documents"]["n_over"] == by[1, "tokens"]["n_over"] == 0


@needs_vocabulary
def test_pack_keeps_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["def", "return", "alpha", "x = 1", "é"]) for _ in range(rng.randint(1, 90)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 3000), (1003, docs[0][1]), (1004, docs[0][1])]
    df = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, capacity long")
    targets = spark.createDataFrame([(1, 64), (2, 512), (2, 512), (3, 0), (4, None)], "target_id int, capacity_tokens int")
    rows = packing.pack(df, targets).collect()
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert set(sizes) == {d for d, t in docs if t}
    for target, capacity in ((1, 64), (2, 512)):
        own = [r for r in rows if r["target_id"] == target]
        by, boxes = {}, {}
        for r in own:
            by.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
            boxes.setdefault(r["container_id"], []).append(r)
        for d, n in sizes.items():
            at = 0
            for first, k in sorted(by[d]):
                assert first == at
                at += k
            assert at == n and (len(by[d]) == 1 or n > capacity)
        for held in boxes.values():
            used = sum(r["n_tokens"] for r in held)
            assert used <= capacity and {r["unused_tokens"] for r in held} == {capacity - used}
    assert {r["target_id"] for r in rows} == {1, 2}
    u = {r["target_id"]: r for r in packing.usage(packing.pack(df, targets), targets.where("target_id < 3").distinct()).collect()}
    assert u[2]["n_tokens"] == sum(sizes.values()) and u[2]["unused_share"] < 0.1
    assert packing.pack(df.limit(0), targets).count() == 0 and packing.pack(df, targets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, targets, rule="first")


# Residue

CODE = "import os\n\n\ndef walk_{0}(path, depth=3):\n    \"\"\"Lists what lies below.\"\"\"\n    for name in os.listdir(path):\n        if depth > {0} and name not in seen:\n            yield from walk_{0}(name, depth - 1)\n    raise ValueError('nothing here')\n\n\n"
RESIDUE = [
    "404 Not Found\n", "<html><head><title>Maintenance</title></head><body><h1>We'll be back soon</h1><p>ColdHarbor is down for upkeep until 10:15.</p></body></html>", "You need to enable JavaScript to run this app.",
    "/* gone (410) */\n", '{"message": "Bad Gateway", "status": "502", "help": "docs.some-host.invalid/errors"}', "Sample text. " * 40, "# Title\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.\n",
    "TODO\n\n- item 1: tbd\n- item 2: xxx\n", "# Copyright (c) {{year}} <your full name>\n" + CODE.format(1), "// part of [PROJECT NAME]\n" + CODE.format(2), '{\n "name": "YOUR_PACKAGE_NAME",\n "shift": 3, "list": ["a", "b"]\n}\n', "# <<project_name>>\n\nYOUR_SHORT_DESCRIPTION\n\nMore text of the file follows here and is real.\n",
]
REAL = [
    CODE.format(3), CODE.format(4) + "PAGE = '404 Not Found'\n" + CODE.format(5), CODE.format(6) + "text = 'Lorem ipsum dolor sit amet'\n" + CODE.format(7), "The tool replaces `{{ project_name }}` and `__AUTHOR__` by your answers to its questions.\n" + CODE.format(8),
    "{% extends 'base' %}\n{% for row in rows %}\n<td>{{ row.name }}</td><td>{{ row.year }}</td>\n{% endfor %}\n<h1>{{ title }}</h1>{% if row %}{{ row.version }}{% endif %}\n", 'if [ -z "${name}" ]; then\n  echo "usage: $0 name" >&2\nfi\n' + CODE.format(9), "", None, "1 2 3\n0x12\n",
    "__version__ = '1.0'\n__author__ = 'me'\n" + CODE.format(10), "<noscript>Please enable JavaScript.</noscript>\n" + "<p>The table below holds the same numbers, row by row, for each chart on this page.</p>\n" * 8,
]


def test_residue(spark):
    texts = RESIDUE + REAL
    filler = [CODE.format(i) + f"value_{i} = compute(other)\n" for i in range(60)]  # so that counts of documents mean something
    rows = [(i, t, "x") for i, t in enumerate(texts + filler + [RESIDUE[0]])]
    rows = [*rows[:-1], (None, RESIDUE[0], "x"), rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    got = {r["doc_id"] for r in residue.classify(df).collect()}
    assert got == {*range(len(RESIDUE)), len(rows) - 2}, [texts[i] for i in got ^ set(range(len(RESIDUE))) if i < len(texts)]
    assert residue.clean(df).count() == len(rows) - len(got)
    assert residue.classify(df.limit(0)).count() == 0


def test_residue_at_any_length(spark):
    long = CODE.format(1) * 3000
    rows = [(1, long), (2, "Sample text. " * 60000), (3, "y" * 2_000_000), (4, long + "# Copyright (c) [YEAR] __FULL_NAME__\n")]
    got = {r["doc_id"]: r["kind"] for r in residue.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: "filler", 4: "blank"}


def test_messages_count_wherever_they_stand_in_long_documents():
    exemplars = residue.Exemplars(1000, {w: 10 for w in residue.Exemplars.vocabulary()})
    message = [w for w in residue.words(RESIDUE[1]) if w not in ("\n", residue.NAME)]
    served = exemplars.mass(residue.Counter(message))
    for n in (100, 190, 400):
        for at in range(n + 1):
            bag = ["zzreal"] * at + message + ["zzreal"] * (n - at)
            assert exemplars._messages(bag) == pytest.approx(served), (n, at)
    bag = ["zzreal"] * 100 + message * 5
    assert exemplars._messages(bag) == pytest.approx(5 * served)
    text = " ".join(["zzreal"] * 60 + [RESIDUE[1]] * 6)
    assert exemplars.judge(text)[0] == "message" and exemplars.judge(text)[1] == pytest.approx(6 * served / (6 * served + 60 * exemplars.other))


def test_bounds_lose_nothing(spark):
    rng = random.Random(5)
    pieces = [*RESIDUE[:14], *residue.X.FILLER_SENTENCES, *residue.X.MESSAGES[:40], "asdf jkl asdf\n", "value_1 fooBar x/y.z 42 ", "une page spéciale ", "plain words of a real text ", "Lorem ipsum dolor sit amet "]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "; "]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += [" ".join(f"Sample text. name{i} someName{i} a_b" for i in range(n)) for n in (2, 5, 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    counts = residue.frequencies(df)
    got = {tuple(r) for r in residue.classify(df, counts=counts).collect()}
    assert got == {tuple(r) for r in residue.classify(df, counts=counts, prefilter=False).collect()} and len(texts) > len(got) > 50
    assert {400, 401, 402} <= {r[0] for r in got}
    assert residue.clean(df, counts=counts).count() == len(texts) - len(got)


def test_every_blank_passes_the_bounds():
    names, whole = residue._blank_words()
    n = 0
    for before, after in residue.X.BLANK_STYLES:
        for field in residue.X.BLANK_FIELDS:
            for f in {field, field.upper(), field.replace(" ", "_"), field.upper().replace(" ", "_"), field.title()}:
                text = f"some words: {before}{f}{after} and more"
                if residue._BLANK.search(text):
                    n += 1
                    data = np.frombuffer(text.encode(), np.uint8)
                    h, at, _ = residue.words_of(data, np.zeros(1, np.int64))
                    assert len(residue._may_be_unfilled(data, h, at, names, whole)), text
    assert n > 1000


def test_verdicts_do_not_turn_with_length():
    exemplars = residue.Exemplars(1000, {w: 10 for w in residue.Exemplars.vocabulary()})
    pool = sorted(w for w in exemplars.postings[residue.MESSAGE] if w.isascii() and w.isalpha())
    for n in (4, 30, 59, 60, 61, 62, 80, 81, 160, 161, 500):
        assert exemplars.judge(" ".join(pool[(7 * i) % len(pool)] for i in range(n)))[0] == "message", n


def test_companions_are_learned(spark):
    rng = random.Random(3)
    own = ["brontal", "quessit", "marvola", "dendris", "ostuna", "velmar"]
    latin = ["lorem", "ipsum", "dolor", "consectetur"]
    filler = [" ".join(rng.choice(latin if rng.random() < 0.4 else own) for _ in range(60)) for _ in range(40)]
    real = [CODE.format(i) for i in range(100)] + [CODE.format(i) * 4 + "text = 'lorem ipsum dolor consectetur elit'\n" for i in range(20)]
    late = ["brontal quessit marvola dendris ostuna velmar lorem " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(filler + real + late)], "doc_id long, text string")
    counts = residue.frequencies(df)
    assert set(own) <= set(counts[2]) and not set(counts[2]) & {"text", "return", "def"}
    assert {r["doc_id"] for r in residue.classify(df, counts=counts).collect()} == {*range(40), len(filler) + len(real)}
