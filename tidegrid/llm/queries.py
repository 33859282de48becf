"""The corpus queries by name; each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, lattice, mixing, neighbours, ngram_join, oracles, repeats, secrets, toxicity, urls, warc
from tidegrid.llm.shared import crc_text, cut, table

#: Host, path, verdict of the URL rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


#: Shares of the token total that the mix aims at.
MIX_TARGETS = {"high": 0.8, "low": 0.15, "toxic": 0.05}


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents towards MIX_TARGETS. Null texts have no tokens, null keys and repeated rows stay,
    an empty table gives no rows; see mixing.mix."""
    labelled = mixing.domains_of_labels(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, MIX_TARGETS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row; null texts get the base score, a null key counts as not held out, ties at the
    threshold are toxic, repeated rows score alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_text("doc_id") % 3 == 1, F.lit(False))
    scored = toxicity.judged(docs, table(spark, sf_dir, "labels"), ~held_out, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds a window of; see decontaminate.leaks for nulls,
    repeats and empty tables."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found in two increments: one half of the keys fills a ledger, which is stored;
    then all documents come, and only blobs that the ledger lacks are scanned. Null texts are empty, null keys and
    repeated rows stay, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = cut(secrets.scan(docs.where(crc_text("doc_id") % 2 == 0)))
    found, _ = secrets.scan_versions(docs, ledger=ledger)
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of smaller documents leave of each; see repeats.remove_repeats for nulls, ties and repeats."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each row of pages; null URLs have empty host and path, repeated rows stay, see urls.judge."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op7_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null texts are empty, a null key counts as held out, see lattice.score."""
    return lattice.score(table(spark, sf_dir, "documents"), crc_text("doc_id") % 7 != 2)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document; see ngram_join.link_components for nulls, repeats and empty texts."""
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from archives; null payloads are empty, see warc.archive_and_merge."""
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)) % 86_400)
    captures = table(spark, sf_dir, "pages").select("page_id", "url", captured.alias("captured"), "html")
    merged = warc.archive_and_merge(captures, smallest=0)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each query row; see neighbours.search for unusable vectors, ties and repeated keys."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def queries():
    return {f.__name__: f for f in (op1_mix, op2_toxicity, op3_decontaminate, op4_secret_scan, op5_suffix_dedup, op6_url_filter, op7_lattice_score, op8_ngram_join, op9_warc, op10_permutation_search)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
