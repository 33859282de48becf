"""Secret scanning over a ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import rekeyed


@dataclass(frozen=True)
class Rule:
    """One version of a detector: leftmost non-overlapping matches of `pattern` whose `group` has
    `least` characters or more. `hints`: a match contains one of these (lower-case ones: in either case)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


#: The three base detectors, then formats of well-known credentials.
BASE_RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    # runs of 24 or more are the runs that a scan for shorter ones would keep
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, ("eyJ",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, ("-----BEGIN",)),
)
RULES = BASE_RULES + MORE_RULES

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", SPAN)])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("findings", T.ArrayType(FINDING))])


def spans_of(text: Column, rule: Rule) -> Column:
    """Code-point spans of a rule's matches: the lengths of the matches and of the text between them, summed up."""
    pattern = F.lit(rule.pattern)
    if rule.hints:
        cased = [text.contains(h) for h in rule.hints if h != h.lower()]
        loose = [F.lower(text).contains(h) for h in rule.hints if h == h.lower()]
        likely = (cased + loose)[0]
        for c in (cased + loose)[1:]:
            likely = likely | c
    else:
        likely = text.rlike(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("values"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(p: Column):
        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(p["gaps"], i))
            end = begin + F.length(F.get(p["hits"], i))
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            kept = F.when(F.length(F.get(p["values"], i)) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"])
            return F.struct(end.alias("at"), kept.alias("out"))

        return step

    def walk(p: Column) -> Column:
        n = F.size(p["hits"])
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, add(p), lambda acc: acc["out"]))

    found = F.get(F.transform(F.array(parts), walk), F.lit(0))
    return F.coalesce(F.when(likely, found), F.array().cast(SPAN))


def scan(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after scanning: (blob, findings), one row per distinct content ever seen.

    A blob is the SHA-256 of a version's text (null: empty), whatever its path. Of the pairs of blobs and
    rule versions only those that the given ledger lacks are scanned; its findings are kept. The first
    shuffle carries each distinct text once from each task, hot contents are merged before it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    known = F.array().cast(T.ArrayType(FINDING))
    if ledger is not None:
        old = ledger.select("blob", F.col("findings").alias("known"))
        blobs = blobs.join(old, "blob", "left").withColumn("known", F.coalesce("known", known))
    else:
        blobs = blobs.withColumn("known", known)

    def unseen(rule: Rule) -> Column:
        return ~F.exists("known", lambda f: (f["kind"] == rule.kind) & (f["version"] == rule.version))

    new = [
        F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("body"), r).alias("spans")))
        for r in rules
    ]
    current = blobs.select("blob", F.concat("known", F.filter(F.array(*new), lambda f: f.isNotNull())).alias("findings"))
    if ledger is None:
        return current
    gone = ledger.select("blob", "findings").join(blobs.select("blob"), "blob", "left_anti")
    return current.unionByName(gone)


def findings_by_path(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with `blob` and `found`: array of (kind, start, end) by start, then kind as listed, under
    the given rule versions. Every path that holds a blob gets its findings."""
    order = {r.kind: i for i, r in enumerate(rules)}
    wanted = [(r.kind, r.version) for r in rules]
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    live = F.filter("findings", lambda f: F.concat_ws("@", f["kind"], f["version"]).isin([f"{k}@{v}" for k, v in wanted]))
    each = F.flatten(
        F.transform(live, lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), rank[f["kind"]].alias("rank"), s["end"].alias("end"), f["kind"].alias("kind"))))
    )
    merged = ledger.select("blob", F.array_sort(each).alias("found"))
    keyed = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return keyed.join(rekeyed(merged, "blob"), "blob", "left")


def scan_versions(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan and join back: (versions with blob and found, the new ledger for the caller to store).

    Null and empty texts share one blob without findings; repeated rows and null keys stay as they are; an
    empty table gives empty results. Columns of versions named blob or found are replaced.
    """
    versions = versions.drop("blob", "found")
    book = scan(versions, text, ledger, rules)
    return findings_by_path(versions, book, text, rules), book


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs(text, n_chars, ...), all columns as they are, secrets in the texts replaced by a mark and n_chars counted
    anew where there are any. Null texts and null keys stay, repeated rows alike; columns may have any names."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    found, _ = scan_versions(own)
    done = redact(found, mark=mark)
    n_chars = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("whole.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return done.select(*[(new[c] if c in new else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace the found spans of a text (overlapping ones together) by a mark; needs `found`."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return df.withColumn(text, F.when(F.size("found") > 0, done).otherwise(F.col(text)))
