"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from tidegrid.llm import decontaminate, toxicity
from tidegrid.llm.shared import crc_text, cut, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = cut(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
        assert docs.columns == columns, name
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty(), name
        if name == "decontamination":
            assert decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).count() == 0
            left = {r.doc_id for r in docs.collect()}
            gone = {r.doc_id for r in before.collect()} - left
            assert gone == {r.doc_id for r in decontaminate.leaks(before, table(spark, sf_dir, "benchmark")).collect()}
        if name == "secrets":
            assert sizes[-1] == sizes[-2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert sizes[-1] > 0.6 * sizes[0] and 0 < len(last) <= sizes[-1] and (last.rate > 0).all()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "mixing"]


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
    assert toxicity.fit([]).score("anything") < 0.7


def test_stages_match_brute_force(spark, sf_dir):
    """Near copies, secrets and toxic documents on a fixture whose answers are worked out name by name."""
    import re

    from tests.llm.test_links import brute_components, corpus

    rows = [(d, t) for d, t in corpus(seed=8, n=60)]
    clash = ["lang", "source", "blob", "found", "whole", "n_chars"]
    df = spark.createDataFrame([(d, t, "x", "y", "z", "w", "v", len(t or "")) for d, t in rows], ["doc_id", "text", *clash])
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["ngram_join"](spark, df, sf_dir)
    words = {d for d, n, _ in brute_components(rows) if n}
    want = {c for d, n, c in brute_components(rows) if n} | {d for d, _ in rows if d not in words}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)

    secret = 'a password = "hunter22" b AKIA' + "Z9" * 8 + " c"
    df = spark.createDataFrame([(1, secret, "x", "y", "z", "w", "v", 5), (2, "clean", "x", "y", "z", "w", "v", 5), (2, None, "x", "y", "z", "w", "v", 0)], ["doc_id", "text", *clash])
    hidden = stages["secrets"](spark, df, sf_dir)
    got = sorted((r.doc_id, r.text or "", r.n_chars, r.blob, r.found) for r in hidden.collect())
    clear = re.sub(r"password = \"hunter22|AKIA[Z9]+", "[secret]", secret)
    assert hidden.columns == df.columns and got == [(1, clear, len(clear), "z", "w"), (2, "", 0, "z", "w"), (2, "clean", 5, "z", "w")]

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, crc_text("doc_id") % 3 != 1))
    left = {r.doc_id for r in stages["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect() if model.score(r.text) < 0.7}


def test_op4_scans_each_blob_once(spark, sf_dir):
    """The second increment of a scan leaves alone what the ledger has: forged findings of old blobs stay."""
    from pyspark.sql import functions as F

    from tidegrid.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = cut(secrets.scan(docs.where("doc_id % 2 = 0")))
    forged = old.withColumn("findings", F.transform("findings", lambda f: f.withField("spans", F.array(F.struct(F.lit(7).alias("start"), F.lit(9).alias("end"))))))
    found, _ = secrets.scan_versions(docs, ledger=forged)
    known = {r.blob for r in old.collect()}
    for r in found.collect():
        assert ([(x.start, x.end) for x in r.found] == [(7, 9)] * len(secrets.RULES)) == (r.blob in known)
