"""The training-text pipeline: stages over documents, each run on everything its predecessor kept.

Toxic documents go, one document of each group of near copies stays, documents with benchmark passages go,
secrets are replaced in the texts that hold them, and what is left gets rates that meet the target mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from tidegrid.llm.queries import MIX_TARGETS
from tidegrid.llm.shared import crc_text, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts and null keys stay, repeated rows are
    judged alike, a score at the threshold is a rejection; an empty table stays empty."""
    scored = toxicity.judged(docs, table(spark, sf_dir, "labels"), crc_text("doc_id") % 3 != 1)
    return scored.where("tox_predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links: the smallest key, nulls last; of repeated rows one.
    Documents without words all stay; an empty table stays empty."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts and null keys stay, repeated rows alike; an empty
    benchmark or table changes nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark. Null texts and keys and repeated rows stay."""
    return secrets.redacted(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the token totals of high and low quality to their targets; those at rate
    0 go. Toxic documents are gone by now: their share is spread, and labels that still say so are no domain.
    Null and empty texts have no tokens, null keys stay, repeated rows have equal rates; an empty table gives none."""
    labelled = mixing.domains_of_labels(table(spark, sf_dir, "labels")).where("domain <> 'toxic'")
    labelled = labelled.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = {d: s for d, s in MIX_TARGETS.items() if d != "toxic"}
    targets = {d: s / sum(share.values()) for d, s in share.items()}
    return mixing.mix(docs, labelled, targets, missing="spread").where("rate > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("mixing", mix_to_targets),
]
#: The first stage learns from labels, which SQL cannot express; the tests check each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
