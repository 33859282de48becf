"""N-gram join, components and repeat removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidegrid.llm import ngram_join, repeats
from tidegrid.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed=5, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(20, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += rng.choice(base)[:20]
        rows.append((i * 7 % n, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return rows + [(1000, ""), (1001, None), (1002, "one two"), (1003, "ONE  two"), (1004, "three"), (1005, " \t ")]


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, cid string, component_id long")
    got = ngram_join.link_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


@pytest.mark.parametrize("unit_bytes", [600, 1 << 22])
def test_one_n_gram_in_every_set(spark, monkeypatch, unit_bytes):
    """Short documents round one common line, in groups of near copies, several units and fragments."""
    monkeypatch.setattr(ngram_join, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(ngram_join, "fragments_for", lambda size, each: 7)
    rng = random.Random(11)
    line = "all rights reserved by the authors of this page".split()
    rows = []
    for i in range(150):
        g = i % 12
        own = [f"g{g}w{k}" for k in range(3 + 2 * g)]
        if rng.random() < 0.4:
            own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join([*own, *line])))
    rows.append((500, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.link_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_length_classes_hold_all_pairs_that_may_link(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 400).select(F.col("id").alias("n"), ngram_join._length_class("n", 80).alias("c")).collect()
    c = {r.n: r.c for r in df}
    assert all(abs(c[a] - c[b]) <= 1 for a in c for b in c if 100 * a >= 80 * b and a <= b)


def test_a_very_long_text_links(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:])), (3, " ".join(words[:60_000]))]
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_join_on_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert ngram_join.link_components(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "q r s t u v")], schema)
    got = sorted((r.doc_id is None, r.component_id) for r in ngram_join.link_components(twice).collect() if r.component_id is not None)
    assert got == [(False, 1), (False, 1), (False, 1), (True, 1)]


def test_one_of_each_keeps_columns_and_blank_documents(spark):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (5, ""), (6, None), (9, "h i j k l m")]
    clash = ["i", "none", "h", "nth", "whole", "a.b", "k1"]
    df = spark.createDataFrame([(d, t, *(f"s{d}" for _ in clash)) for d, t in rows], ["doc_id", "text", *clash])
    got = ngram_join.one_of_each(df)
    assert got.columns == ["doc_id", "text", *clash] and {r.h for r in got.collect()} == {"s2", "s5", "s6", "s9"}
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 6, 9]


def test_stars_join_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def brute_repeats(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(2000))
    rows = []
    for i in range(50):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(1900)
            parts += [base[a : a + rng.randrange(20, 200)], "".join(rng.choice("xyz") for _ in range(rng.randrange(80)))]
        rows.append((i * 3 % 53, "".join(parts)))
    rows += [(100, "a" * 200), (101, "a" * 60 + "b" + "a" * 55), (102, ""), (103, None), (104, "é" * 60), (105, "x" + "é" * 40), (106, "é" * 40)]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, unit long")
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    # one unit a task; units of a few documents; then every place split by more bytes than its gram
    for unit_bytes, hot in ((1 << 20, 64), (1500, 64), (1500, 0)):
        assert sorted(map(tuple, repeats.remove_repeats(df, unit_bytes=unit_bytes, hot=hot).collect())) == want


def test_repeats_of_a_passage_in_every_document(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{rng.random()}{passage}{rng.random()}"[rng.randrange(60) :]) for i in range(120)]
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    monkeypatch.setattr(repeats, "TRANSFORM_BYTES", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, repeats.remove_repeats(df, unit_bytes=2000, hot=4).collect())) == want


def test_repeats_in_a_text_longer_than_a_unit(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij ") for _ in range(2_200_000))
    rows = [(1, long), (2, long[700_000:1_300_000] + "x" + long[:100]), (3, long[-60:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(df, unit_bytes=1 << 20).collect()}
    assert got == {1: (0, 0), 2: (600_100, 2), 3: (60, 1)}


def test_no_window_is_settled_without_the_transform(monkeypatch):
    """Windows of strings of different documents repeat only where the transform says so."""
    monkeypatch.setattr(repeats, "windows_of_smaller", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    data = np.frombuffer(b"0123456789" * 6 + b"abcdefghij" * 6, np.uint8)
    names, low, high = repeats._runs(data, np.array([0, 60]), np.array([60, 60]), np.array([1, 2]), np.arange(2), 50)
    assert len(names) == 0


def test_repeats_of_null_and_equal_ids(spark):
    text = "0123456789" * 6
    df = spark.createDataFrame([(None, text), (4, text), (4, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(4, 0), (4, 0), (99, 60)]
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("length", [4, 12])
def test_blocks_of_the_transform(length):
    rng = random.Random(length)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    order, block = repeats.repeat_blocks(data, np.cumsum(sizes) - sizes, sizes, length)
    flat = [s[k:] for s in strings for k in range(len(s) + 1)]
    suffixes = [flat[i] for i in order]
    assert [x for x in suffixes] == sorted(suffixes)
    for a, b, x, y in zip(suffixes, suffixes[1:], block, block[1:], strict=False):
        assert (x == y) == (a[:length] == b[:length] and len(a) >= length)


def test_suffixes_are_sorted_as_deep_as_repeats_need(monkeypatch):
    """Windows of smaller documents, by four sorts of all rows: 7, 14, 28 and 56 bytes."""
    rng = random.Random(9)
    base = "".join(rng.choice("abc") for _ in range(400))
    strings = [base[k : k + rng.randrange(50, 130)].encode() for k in (rng.randrange(270) for _ in range(80))]
    strings += [s + b"x" for s in strings[:20]] + [b"\0" * 70, b"\0" * 60]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    ids, sorts, plain = np.array([rng.randrange(30) for _ in strings]), [], np.argsort
    smallest = {}
    for s, d in zip(strings, ids.tolist(), strict=True):
        for k in range(len(s) - 49):
            smallest[s[k : k + 50]] = min(smallest.get(s[k : k + 50], d), d)
    want = [(i, k) for i, s in enumerate(strings) for k in range(len(s) - 49) if smallest[s[k : k + 50]] < ids[i]]
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sorts.append(len(x)), plain(x, *a, **k))[1])
    string, offset = repeats.windows_of_smaller(data, np.cumsum(sizes) - sizes, sizes, ids, 50)
    assert list(zip(string.tolist(), offset.tolist(), strict=True)) == want
    assert sorts.count(len(data) + len(strings)) == 4


def test_distinct_strings():
    rng = random.Random(10)
    data = np.frombuffer(b"ab\0" * 40, np.uint8)
    begin, size = (np.array([rng.randrange(a, b) for _ in range(300)]) for a, b in ((0, 100), (1, 21)))
    one, kind = repeats.distinct_strings(data, begin, size)
    text = [data[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
    assert [text[one[k]] for k in kind] == text and len(one) == len(set(text))
