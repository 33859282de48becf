"""URL rules, secret ledger, WARC archives and the permutation index."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import neighbours, secrets, urls, warc

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("b.org", "/x", "block")]


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: x[0]) if fits else (0, "allow", None)
    return host, path, best[2], best[1]


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["x.net", "EXAMPLE.net", "www.example.net", "notexample.com", "a.example.com", "c.org", "d.a.org", "b.org", "net", "", "ünï.org", "a..org", ".net"]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/en/1', '/de/', '/fr/a?b=/en/', '/xyz', '', '?q', '#/en/', '/', '/EN/'])}" for _ in range(150)]
    made += [None, "", "no scheme", "a://", "x://y://z.net/", "http://h.net/\n/en/", "http://" + "l." * 300 + "net/" + "p/" * 2000]
    df = spark.createDataFrame([(i // 2, u, "r") for i, u in enumerate(made * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, map(tuple, urls.judge(df, rules).collect())))
    assert got == sorted(str((i // 2, *judge(u))) for i, u in enumerate(made * 2))
    assert {r.verdict for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge(df.limit(0), rules).count() == 0


# ---- secrets ----------------------------------------------------------------------------------

PYTHON = {"assign": (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def base_spans(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PYTHON.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def samples():
    rng = random.Random(2)
    bits = ['password = "hunter22"', "TOKEN:abc", "api_key='ABCDEFGH", "AKIA" + "Z9" * 8, "AKIAAKIA" + "B" * 12, "AKIA", "0123456789abcdef" * 2, "deadbeef", "é𝔸ß", " ", "secret:", "passwd=a.b/c+d=e", "\n", "secrettoken=123456"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(120)] + ["", None, "AKIA" + "A" * 16, "x" * 5000 + "token=abcdef" + "y" * 5000]


def test_secrets_match_brute_force(spark):
    texts = samples()
    df = spark.createDataFrame([(i % 100, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    found, _ = secrets.scan_versions(df)
    base = F.filter("found", lambda s: s["kind"].isin(*PYTHON))
    got = sorted((r.doc_id, r.text or "", r.s) for r in found.select("doc_id", "text", secrets.listed(base).alias("s")).collect())
    assert got == sorted((i % 100, t or "", ",".join(base_spans(t))) for i, t in enumerate(texts))


def test_more_rules_and_redaction(spark):
    text = "a ghp_" + "A1b2" * 9 + " and -----BEGIN RSA PRIVATE KEY----- token: abcdefgh end"
    found, _ = secrets.scan_versions(spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string"))
    kinds = {r.doc_id: [s.kind for s in r.found] for r in found.collect()}
    assert kinds == {1: ["github", "pem", "assign"], 2: [], 3: []}
    out = {r.doc_id: r.text for r in secrets.redact(found).collect()}
    assert out == {1: "a [secret] and [secret] [secret] end", 2: "clean", 3: None}


def test_ledger_scans_only_unseen_pairs(spark):
    df = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    book = secrets.scan(df, rules=secrets.BASE_RULES[:1]).persist()
    forged = book.withColumn("findings", F.transform("findings", lambda f: f.withField("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))))))
    later = df.unionByName(spark.createDataFrame([(4, "secret=zzzzzz")], df.schema))
    found, new = secrets.scan_versions(later, ledger=forged, rules=secrets.BASE_RULES[:2])
    got = {r.doc_id: [(s.start, s.end) for s in r.found] for r in found.collect()}
    assert got == {1: [(0, 1)], 2: [(0, 1)], 3: [(0, 1)], 4: [(0, 13)]}  # what the ledger has is not scanned again
    assert {tuple(sorted(f.kind for f in r.findings)) for r in new.collect()} == {("access", "assign")}
    gone = secrets.scan(df.where("doc_id = 3"), ledger=book)
    assert gone.count() == book.count()


# ---- WARC -------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    pages = [(5, "http://b.org/1", "<p>é</p>"), (3, "http://a.org/2", "<p>é</p>"), (9, None, None), (8, "https://a.org/1?x=1", ""), (7, "http://a.org/1", "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "http://a.b.org/\n", "y" * 100_000), (None, "http://z.net/", "<p>é</p>")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, archive string")
    captures = df.withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000)))
    path = str(tmp_path / "w")
    got = {r.page_id: r for r in warc.archive_and_merge(captures, path=path).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        body = (h or "").encode()
        same = [j for j, _, g in pages if (g or "").encode() == body and j is not None]
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(same)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first))
    files = {"file:" + str(p): p.read_bytes() for p in (tmp_path / "w").rglob("part-*")}
    records = [r[2:] for data in files.values() for r in warc.parse(data)]
    plain = [r[2:] for data in files.values() for r in warc.parse(gzip.decompress(data))]
    assert records == plain and len(records) == len(pages) + len(files)
    assert [r[0]["warc-type"] for data in files.values() for r in list(warc.parse(data))[:1] for r in [r[2:]]] == ["warcinfo"] * len(files)
    for r in got.values():  # an entry's offset and length find its record
        headers, _ = warc.read_record(files[r.archive], r.offset, r.length)
        assert (headers["warc-record-id"], headers["warc-type"]) == (f"<urn:page:{'none' if r.page_id is None else r.page_id}>", r.record_type)
    assert warc.archive_and_merge(captures.limit(0), path=str(tmp_path / "e")).count() == 0


def test_histories_are_globally_ordered(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(5)}.org/{rng.randrange(9)}", f"t{rng.randrange(30)}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7).withColumn("captured", F.timestamp_seconds(F.lit(10**9) + F.col("page_id") % 11))
    got = warc.archive_and_merge(df, file_bytes=2000).select("url_key", "captured", "page_id").collect()
    assert list(map(tuple, got)) == sorted(map(tuple, got)) and len(got) == 400


def test_ranges_larger_than_a_batch_and_smaller_than_a_page(spark, tmp_path):
    rng = random.Random(6)
    # a third of the captures under one URL, all at one time, some rows twice
    rows = [(i // 2, "http://hot.org/" if i % 3 else f"http://h{rng.randrange(40)}.org/", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("captured", F.timestamp_seconds(F.lit(10**9) + F.when(F.col("url").contains("hot"), 0).otherwise(F.col("page_id") % 11)))
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=4000)
    runs = warc.read_index(spark, str(tmp_path / "w"))
    want = sorted((r.url_key, r.captured, r.page_id) for r in runs.collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "50")
    for rows_in_page, range_bytes in ((30, 1 << 24), (1000, 3000)):
        pages = warc.paged(runs, rows_in_page)
        got = warc.merge_pages(pages, range_bytes).select("url_key", "captured", "page_id").collect()
        assert list(map(tuple, got)) == want
    spark.conf.unset(key)


def test_members_of_long_records():
    long = b"x" * (1 << 24)
    both = warc.member(b"a") + warc.member(long) + warc.member(b"b")
    assert [d for _, _, d in warc.members(both)] == [b"a", long, b"b"]
    assert all(warc.member(x).endswith(b"\0") for x in (b"a", long, b""))


def test_short_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string").withColumn("captured", F.timestamp_seconds(F.lit(0)))
    got = {r.page_id: r.record_type for r in warc.with_roles(df, 5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("k", [0, 1, 2, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x).below()) == sorted(x for r in runs for x in r)


def test_cut_archives_are_an_error():
    whole = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"
    with pytest.raises(ValueError):
        list(warc.parse(whole))


# ---- neighbours -------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(sf_dir + "/embeddings.parquet")
    got = neighbours.search(df, F.col("id") % 20 == 0, k=20).toPandas()
    e = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert mine.score.to_numpy() == pytest.approx([s[ids == v][0] for v in mine.vec_id])
        assert mine[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        hits, total = hits + len({*want} & {*mine.vec_id}), total + 20
    assert hits / total >= 0.9


def test_unusable_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (40, [nan, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = neighbours.search(df, F.col("id") % 20 == 0, k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def brute_neighbours(ids, x, q, k):
    s = x @ x[q]
    order = np.lexsort((ids, -s))
    return [(int(ids[i]), float(s[i])) for i in order if ids[i] != ids[q]][:k]


@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_recall_in_a_block_of_ten_thousand(spark, spread):
    """Vectors without any structure, and in clusters; the same rows whatever the batches are."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10_000, 64)) + spread * rng.normal(size=(40, 64))[rng.integers(0, 40, 10_000)]
    ids = rng.permutation(10_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for batch in ("10000", "700"):
        spark.conf.set(key, batch)
        got = neighbours.search(df, F.col("id") % 500 == 0, k=20).collect()
        found.append(sorted((r.query_id, r.rank, r.vec_id) for r in got))
    spark.conf.unset(key)
    assert found[0] == found[1]
    want = {(int(ids[q]), v) for q in np.flatnonzero(ids % 500 == 0) for v, _ in brute_neighbours(ids, x, q, 20)}
    assert len(found[0]) == 400 and len(want & {(q, v) for q, _, v in found[0]}) >= 0.9 * 400


def test_clusters_need_less_than_noise():
    rng = np.random.default_rng(8)
    noise = rng.normal(size=(3000, 32))
    clusters = 0.2 * noise + 6.0 * rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)]
    cost = {}
    for name, x in (("noise", noise), ("clusters", clusters)):
        points = x[:64] / np.linalg.norm(x[:64], axis=1, keepdims=True)
        probes, share = neighbours.tuned(x[64:], points, 32, 20, 0.95)
        cost[name] = probes * share
    assert cost["clusters"] < cost["noise"] / 3


def test_repeated_keys_several_blocks_and_parts(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8))
    x[40:140] = x[40]  # a hot vector
    ids = np.arange(300) % 250
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    df = df.unionByName(df.where("vec_id = 20"))  # a query row twice
    got = neighbours.search(df, F.col("id") % 20 == 0, k=6, pivots=16, nearest=8, recall=1.01, block_rows=20, query_rows=7).collect()
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        both = brute_neighbours(np.r_[ids, 20], np.r_[x, x[20:21]], q, 6)
        want += [(int(ids[q]), r + 1, v, round(s, 9)) for r, (v, s) in enumerate(both)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
