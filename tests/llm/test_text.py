"""Toxicity, decontamination, language model and mixing on small inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import decontaminate, lattice, mixing, queries, toxicity

WORDS = "the quick stone river under seven green houses walk slowly toward morning light and birds sing over calm water near old bridges".split()


def noise(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        w = noise(rng, 40).split()
        if i % 3 == 0:
            for bad in ("blorkhead", "snivelrat", "grubface"):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((" ".join(w), int(i % 3 == 0)))
    return toxicity.fit(rows)


@pytest.mark.parametrize("token,word", [("bl0rkhead", "blorkhead"), ("sn1velr@t", "snivelrat"), ("gruuuubface", "grubface"), ("g.r.u.b.f.a.c.e", "grubface"), ("gru8f4ce", "grubface")])
def test_restore(toxic_model, token, word):
    assert toxicity.restore(token, toxic_model.chars) == word


@pytest.mark.parametrize("token", ["b1o", "gr@b", "sn.iv", "aaab0", "8l$rk", "g-r_u8"])
def test_viterbi_is_the_best_of_all_paths(toxic_model, token):
    import itertools

    chars, best = toxic_model.chars, None
    for path in itertools.product(*toxicity.lattice(token)):
        word, cost = "".join(c for c, _ in path), sum(x for _, x in path)
        w = f"\x02\x02{word}\x03"
        cost += sum(chars.cost(w[i - 2 : i], w[i]) for i in range(2, len(w)))
        best = min(best or (1e9, ""), (cost, word))
    got = toxicity.restore(token, chars)
    w = f"\x02\x02{got}\x03"
    ways = [sum(x for _, x in path) for path in itertools.product(*toxicity.lattice(token)) if "".join(c for c, _ in path) == got]
    assert min(ways) + sum(chars.cost(w[i - 2 : i], w[i]) for i in range(2, len(w))) == pytest.approx(best[0])


def test_long_disguised_tokens_and_texts(toxic_model):
    run = "5t0n3.r1v3r." * 8 + "bl0rkh34d" + ".c4lm.w4t3r" * 9 + ".sn1v3lr4t"
    assert len(run) > 200 and toxic_model.score(noise(random.Random(3), 20) + " " + run) >= 0.7
    clean = "5t0n3.r1v3r." * 20
    assert len(clean) > 200 and toxic_model.score(noise(random.Random(3), 20) + " " + clean) < 0.5
    long = noise(random.Random(4), 60_000)
    assert toxic_model.score(long) < 0.5 and toxic_model.score(long + " bl0rkhead sn1velrat") >= 0.7


def test_scores_see_through_disguise(toxic_model):
    m, rng = toxic_model, random.Random(2)
    for bad in ("blorkhead snivelrat", "bl0rkhead sn1velrat", "b l o r k h e a d and g-r-u-b-f-a-c-e"):
        assert m.score(noise(rng, 30) + " " + bad) >= 0.7
    assert m.score(noise(rng, 60)) < 0.3
    assert m.score(None) == m.score("") < 0.5


def test_toxicity_frame(spark, toxic_model):
    df = spark.createDataFrame([(1, "blorkhead grubface", 9.0), (2, None, 9.0), (2, "", 9.0), (None, "calm water", 9.0)], "doc_id long, text string, tox_score double")
    got = {(r.doc_id, r.text): r.tox_predicted for r in toxicity.score(df, toxic_model).collect()}
    assert got == {(1, "blorkhead grubface"): 1, (2, None): 0, (2, ""): 0, (None, "calm water"): 0}
    assert toxicity.score(df.limit(0), toxic_model).count() == 0


def test_toxicity_held_out(spark, sf_dir):
    got = queries.op2_toxicity(spark, sf_dir.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet").toPandas()
    met = got[got.held_out].merge(labels, on="doc_id")
    assert set(got.held_out[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)]) == {True}
    assert ((met.predicted == 1) & (met.toxic == 0)).sum() <= 0.02 * len(met)
    assert met.predicted[met.toxic == 1].mean() >= 0.5


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (60, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, toxic_rows=5)
    assert sum(y for _, y in rows) == 5 and len(rows) == 15


def fit_in_memory(docs, labels):
    """The model by `fit`, over every agreed and trained label."""
    said = {}
    for d, y in labels:
        if d is not None and y is not None:
            said.setdefault(d, set()).add(y)
    rows = [(t, min(said[d])) for d, t in docs if t and len(said.get(d, ())) == 1 and zlib.crc32(str(d).encode()) % 3 != 1]
    return toxicity.fit(rows)


def test_toxicity_learns_from_every_row(spark, tmp_path):
    """A word that only toxic rows beyond 1,500 have weighs, in the query and in the pipeline's stage."""
    import corpus_pipeline

    rng, train = random.Random(5), [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic, other = train[:2500], train[2500:]
    ids = spark.createDataFrame([(i,) for i in toxic], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect()
    late = {r.doc_id for r in ids[1500:]}
    rare = set(sorted(late)[:60])
    docs = [(i, noise(rng, 12) + (f" x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} {'zorgblat' if i in rare else 'snivelrat'} end")) for k, i in enumerate(toxic)]
    docs += [(i, noise(rng, 15)) for i in other] + [(20_001, "calm zorgblat"), (20_002, "calm water"), (20_003, ""), (20_004, None)]
    labels = [(i, int(i in set(toxic))) for i in train]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert [got[20_000 + k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0]
    model = fit_in_memory(docs, labels)
    for d, t in docs[-4:]:
        assert got[d].score == pytest.approx(model.score(t), abs=1e-9)
    left = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in left.where("doc_id > 20000").collect()} == {20_002, 20_003, 20_004}


def test_toxicity_of_tables_is_that_of_memory(spark):
    """Copies, repeated rows and keys, contradictory and null labels, null keys: tables are learned as rows in memory are."""
    rng = random.Random(6)
    docs = [(i, noise(rng, 10) + (f" x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " + rng.choice(["blorkhead", "blorkhat", "gru\u00dfface \u0130x"]) if i % 3 == 0 else "")) for i in range(1500)]
    docs += [(2000 + i, docs[3 * i][1]) for i in range(40)] + docs[:30] + [(5, "another blorkhead"), (None, "blorkhead calm"), (7, None), (8, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(1500)] + [(2000 + i, i % 2) for i in range(40)] + [(9, 0), (None, 1), (12, None)] + [(3, 1)] * 2
    table = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, tox_digest double")
    named = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.judged(table, named, queries.crc_text("doc_id") % 3 != 1).collect()
    assert len(got) == len(docs)
    model = fit_in_memory(docs, labels)
    assert all(r.tox_score == pytest.approx(model.score(r.text), abs=1e-9) for r in got)
    assert len({round(r.tox_score, 6) for r in got}) > 1


# ---- decontamination --------------------------------------------------------------------------


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, how = rng.randrange(len(s)), rng.random()
        if how < 0.33:
            s[k] = "#"
        elif how < 0.66:
            del s[k]
        else:
            s.insert(k, "#")
    return "".join(s)


def distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_leaks_match_brute_force():
    rng = random.Random(4)
    letters = "abcdefghij "
    items = [(k, "".join(rng.choice(letters) for _ in range(n)).strip()) for k, n in enumerate((40, 100, 160, 12))]
    index = decontaminate.Index(items)
    for case in range(60):
        k = rng.randrange(4)
        text = decontaminate.normal("".join(rng.choice(letters) for _ in range(150)) + edit(rng, decontaminate.normal(items[k][1]), rng.randrange(0, 14)) + "".join(rng.choice(letters) for _ in range(90)))
        got = {r[1] for r in index.search([text])}
        want = {items[j][0] for j, ws in enumerate(index.windows) if any(distance_to_part("".join(map(chr, w.chars)), text) <= w.edits for w in ws)}
        assert got == want, case


def test_short_items_are_found_as_they_are():
    index = decontaminate.Index([(1, "a b c"), (2, "x=1"), (3, "a b"), (4, "Zürich"), (5, "a b c"), (6, "long enough to have grams")])
    texts = ["say a b c now", "a bc", "(x=1) x=12", "ZÜRICH!".lower(), "", "xa b c"]
    got = sorted((d, i, texts[d][a:b]) for d, i, a, b, _ in index.search(texts))
    assert got == [(0, 1, "a b c"), (0, 3, "a b"), (0, 5, "a b c"), (2, 2, "x=1"), (3, 4, "zürich")]


def test_passages_off_the_grid_and_a_very_long_text(spark):
    rng = random.Random(14)
    item = "".join(rng.choice("abcdefghijklmnop ") for _ in range(900)).strip()
    index = decontaminate.Index([(1, item)])
    norm = decontaminate.normal(item)
    for at in range(0, len(norm) - 125, 37):
        assert list(index.search(["zz " * 40 + norm[at : at + 125] + " qq" * 40])), at
    long = "clean words and more of them " * 60_000
    docs = spark.createDataFrame([(1, long + item), (2, long), (None, item), (3, item), (3, item)], "doc_id long, text string")
    got = sorted((r.doc_id or 0) for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    assert got == [0, 1, 3, 3]


def test_leak_frames(spark):
    item = noise(random.Random(8), 30)
    docs = spark.createDataFrame([(1, "x " + item.upper().replace(" ", "\n ") + " y", 5), (2, "other words altogether " * 20, 5), (3, None, 5), (4, "", 5), (1, "clean", 5)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "ab")], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 7, 0)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_passes_cover_the_benchmark(spark):
    bench = spark.createDataFrame([(i, "word " * 50) for i in range(20)], "item_id long, text string")
    parts = decontaminate.passes(bench, most=2000)
    assert len(parts) == 3 and sorted(r.item_id for p in parts for r in p.collect()) == list(range(20))


# ---- language model ---------------------------------------------------------------------------


def brute_marginal(word, p):

    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum(total[s] * p[word[s:end]] for s in range(end) if word[s:end] in p)
    return math.log(total[-1])


@pytest.fixture(scope="module")
def pieces():
    strings = sorted({b" a", b" ab", b"b", b"ab", b"abc", b"c", b" ", b"a", b"bc"} | {bytes([b]) for b in range(256)})
    return lattice.Pieces(strings, np.arange(1.0, len(strings) + 1))


def test_forward_sums_all_segmentations(pieces):
    p = dict(zip(pieces.strings, np.exp(pieces.log_p), strict=True))
    words = [b"abc", b"cab", b"aab", b"bcb", "é".encode() + b"a"]
    for w in words:
        got = pieces.forward(np.frombuffer(b" " + w, np.uint8)[None, :].copy())[-1][0]
        assert got == pytest.approx(brute_marginal(b" " + w, p), abs=1e-12)


def test_expected_counts_by_enumeration(pieces):
    p = dict(zip(pieces.strings, np.exp(pieces.log_p), strict=True))
    word = b" abcab"
    ways = [[]]
    done = []
    while ways:
        way = ways.pop()
        at = sum(map(len, way))
        if at == len(word):
            done.append(way)
        ways += [way + [word[at : at + k]] for k in range(1, len(word) - at + 1) if word[at : at + k] in p]
    weights = np.array([math.prod(p[x] for x in way) for way in done])
    want = Counter()
    for way, w in zip(done, weights / weights.sum(), strict=True):
        for x in way:
            want[x] += 3 * w
    got = pieces.expected(np.frombuffer(word, np.uint8)[None, :].copy(), np.array([3.0]))
    assert {s: g for s, g in zip(pieces.strings, got, strict=True) if g > 1e-12} == pytest.approx(dict(want))


def test_lattice_scores(spark):
    from pyspark.sql import functions as F

    rows = [(i, noise(random.Random(i), i % 9)) for i in range(30)] + [(30, None), (31, "UPPER upper"), (31, "UPPER upper"), (None, "x\ty\x0bz"), (33, "é" * 500)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, unit string")
    got = lattice.score(df, F.col("doc_id") % 3 != 1).collect()
    assert len(got) == len(rows)
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    train = [lower(t) + [None] for i, t in rows if i is not None and i % 3 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in lower(t) + [None]), len(lower(t)) + 1, sum(c[w] > 0 for w in lower(t) + [None])) for i, t in rows if i is not None)
    have = sorted(((False, r.doc_id), r.base_score, r.n_tokens, r.n_known) for r in got if r.doc_id is not None)
    for a, b in zip(have, want, strict=True):
        assert a[0] == b[0] and a[2:] == b[2:] and a[1] == pytest.approx(b[1])
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score(df.limit(0), F.lit(True)).count() == 0


def test_scores_of_whole_texts_by_enumeration(spark, monkeypatch, pieces):
    """Every segmentation of every word of a text, under probabilities made by hand from the expected counts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lattice.Pieces, "from_model", classmethod(lambda cls, path=None: pieces))
    rows = [(3, "abc ab"), (6, "cab a abc"), (9, None), (1, "abc b ab zc"), (4, "ABCABC")]
    got = {r.doc_id: r.score for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 == 0).collect()}

    def ways(word, p):
        out, open_ = [], [[]]
        while open_:
            way = open_.pop()
            at = sum(map(len, way))
            if at == len(word):
                out.append(way)
            open_ += [way + [word[at : at + k]] for k in range(1, len(word) - at + 1) if word[at : at + k] in p]
        return out

    split = lambda t: [b" " + w.encode() for w in (t or "").lower().split()]
    p = dict(zip(pieces.strings, np.exp(pieces.log_p), strict=True))
    used = Counter()
    for i, t in rows:
        if i % 3 == 0:
            for word in split(t):
                each = [(math.prod(p[x] for x in way), way) for way in ways(word, p)]
                for weight, way in each:
                    for x in way:
                        used[x] += weight / sum(w for w, _ in each)
    mass = {x: used[x] + p[x] * len(p) for x in p}
    total, texts = sum(mass.values()) + 3 + 1, 3
    final = {x: m / total for x, m in mass.items()}
    for i, t in rows:
        want = math.log10((texts + 1) / total) + sum(math.log10(sum(math.prod(final[x] for x in way) for way in ways(word, final))) for word in split(t))
        assert got[i] == pytest.approx(want)


def test_scores_of_a_very_long_text(spark):
    from pyspark.sql import functions as F

    rows = [(1, noise(random.Random(1), 200_000)), (2, "x" * 300_000), (3, "calm water")]
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert got[1].n_tokens == 200_001 and got[2].n_tokens == 2 and all(math.isfinite(r.score) for r in got.values())
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), "/nowhere")


# ---- mixing -----------------------------------------------------------------------------------


def members(spark, seed=3, n=200):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.4, 0.4], n)
    t = rng.integers(1, 500, n)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "n_tokens long, p_a double, p_b double, p_c double")
    return df, t.astype(float), p


@pytest.mark.parametrize("share", [(0.5, 0.3, 0.2), (0.98, 0.01, 0.01), (1.0, 0.0, 0.0)])
def test_solve_is_projected_least_squares(spark, share):
    df, t, p = members(spark)
    target = np.array(share) * t.sum()
    names = ["p_a", "p_b", "p_c"]
    start, pulls = mixing.solve(df, names, target)
    rate = np.full(len(t), start)
    for y in pulls:
        rate = np.maximum(0, rate - p @ np.array(y))
    metric = np.linalg.pinv((p * t[:, None]).T @ p)
    worth = lambda r: (gap := (p * t[:, None]).T @ r - target) @ metric @ gap
    slow = np.full(len(t), start)
    for _ in range(3000):
        slow = np.maximum(0, slow - p @ (metric @ ((p * t[:, None]).T @ slow - target)))
    assert worth(rate) <= worth(slow) + 0.01 * worth(np.full(len(t), start)) * (share != (0.5, 0.3, 0.2)) + 1e-6


def test_mix_frame(spark):
    rng = random.Random(6)
    kinds = {"law": "court judge law appeal", "code": "loop array byte stack", "verse": "moon dew rose song"}
    rows, labels = [], []
    for i in range(300):
        k = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randrange(5, 40))), 1.0))
        if i % 2:
            labels.append((i, k))
    docs = spark.createDataFrame(rows + [(None, None, 1.0), (400, "", 1.0), (5, rows[5][1], 1.0)], "doc_id long, text string, rate double")
    lab = spark.createDataFrame(labels + [(None, "law"), (7, None), (9, "other")], "doc_id long, domain string")
    got = mixing.mix(docs, lab, {"law": 0.5, "code": 0.3, "verse": 0.2}).toPandas()
    assert len(got) == 303 and (got.rate >= 0).all() and (got.copies - got.rate).abs().max() <= 1
    total = got.n_tokens.sum()
    for k, s in {"law": 0.5, "code": 0.3, "verse": 0.2}.items():
        assert (got.n_tokens * got[f"p_{k}"] * got.rate).sum() / total == pytest.approx(s, abs=1e-6)
    best = got[[f"p_{k}" for k in kinds]].idxmax(axis=1).str[2:]
    truth = {i: next(k for k, w in kinds.items() if t.split()[0] in w.split()) for i, t, _ in rows}
    known = got.doc_id.map(truth)
    assert (best[known.notna()] == known[known.notna()]).mean() > 0.95
    with pytest.raises(ValueError):
        mixing.mix(docs, lab, {"prose": 1.0})
    assert mixing.mix(docs.limit(0), lab.limit(0), {"law": 1.0}).count() == 0
    wide = mixing.mix(docs, lab, {"law": 0.4, "code": 0.2, "verse": 0.2, "prose": 0.2}, missing="spread").toPandas()
    assert (wide.n_tokens * wide.p_law * wide.rate).sum() / total == pytest.approx(0.5, abs=1e-6)


def test_rare_domains_keep_their_place(spark):
    docs = spark.createDataFrame([(i, "plain words here" if i else "odd sound") for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "common" if i else "rare") for i in range(400)], "doc_id long, domain string")
    assert mixing.fit(docs, lab, rows=20).domains == ["common", "rare"]
