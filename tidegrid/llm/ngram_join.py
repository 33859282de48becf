"""Set-similarity self-join of documents on word n-grams, by vertical partitions of the global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.components import _join_key, components
from tidegrid.llm.shared import (
    binary_parts, block_slices, cut, dealt, fragments_for, give_back, mix, packed, pin, prepare, shingle_hashes, slices, span_hashes, total_bytes, unpacked, words,
)

#: Words in an n-gram; documents link when PERCENT % of their union is shared.
WIDTH, PERCENT = 5, 80
UNIT_BYTES, FRAGMENT_BYTES = 4 << 20, 16 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending within a text, and how many each has."""
    low, starts, ends, first = words(data, offsets)
    hashes, n = shingle_hashes(span_hashes(low, starts, ends), first, width)
    text = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order], kind="stable")]
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.bincount(text[keep], minlength=len(n))


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit id of each set, the same for equal sets; as two signed numbers."""
    ends, out = np.cumsum(sizes), []
    for seed in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ seed))]
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
    return out[0], out[1]


def all_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of any number of texts, a block at a time."""
    parts = [shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width) for a, b in block_slices(offsets)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


# ---- units ------------------------------------------------------------------------------------

_UNIT = pa.schema([("unit", pa.int64()), ("texts", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("nulls", pa.binary()), ("hashes", pa.binary()), ("one", pa.list_(pa.int64()))])
UNIT_DDL = "unit long, texts binary, sizes binary, keys binary, nulls binary, hashes binary, one array<long>"
_CLASS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("unit", pa.int64()), ("text_hash", pa.int64())])
CLASS_DDL = "doc_id long, n_shingles long, h1 long, h2 long, row long, unit long, text_hash long"
_TOLD = pa.schema([("fragment", pa.int32()), ("unit", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
TOLD_DDL = "fragment int, unit long, grams binary, counts binary"
_LEVELS = pa.schema([("unit", pa.int64()), ("fragment", pa.int32()), ("levels", pa.binary())])
LEVELS_DDL = "unit long, fragment int, levels binary"
SETS_DDL = "cid long, n int, shared int, cut int, grams array<long>, before int, prefix array<long>"
#: Units number their rows from unit x ROWS_IN_UNIT on; more (empty) texts than that open the next unit.
ROWS_IN_UNIT = 1 << 20


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (doc_id, text, text_hash) of up to UNIT_BYTES as one row; no other unit has its number."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = binary_parts(batch.column(1))
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        hashes = batch.column(2).to_numpy(zero_copy_only=False)
        for lo, hi in block_slices(offsets, UNIT_BYTES):
            for a in range(lo, hi, ROWS_IN_UNIT):
                b = min(a + ROWS_IN_UNIT, hi)
                values = (task << 20) + n, packed(data[offsets[a] : offsets[b]]), np.diff(offsets[a : b + 1]).tobytes(), keys[a:b].tobytes(), null[a:b].tobytes(), hashes[a:b].tobytes(), None
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(_UNIT.names, values, strict=True)}, schema=_UNIT)
                n += 1
    give_back()


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    return unpacked(row["texts"], int(offsets[-1]), np.uint8), offsets


def classes(units: DataFrame, width: int = WIDTH) -> DataFrame:
    """CLASS_DDL for every row: the size of its n-gram set, a 128-bit id of the set, and the row's number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, sizes = all_sets(*_texts(row), width)
                h1, h2 = set_ids(hashes, sizes)
                null = np.frombuffer(row["nulls"], bool)
                number = row["unit"] * ROWS_IN_UNIT + np.arange(len(sizes))
                columns = pa.array(np.frombuffer(row["keys"], np.int64), mask=null), sizes, h1, h2, number, np.full(len(sizes), row["unit"]), np.frombuffer(row["hashes"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_CLASS)
        give_back()

    return units.mapInArrow(run, CLASS_DDL)


class Sets:
    """The sets of a unit's first rows of their classes: `row`, `size`, and n-grams with their `owner`. `keys` are
    the distinct n-grams by fragment and 32 bits of the rest (more may fall together, never less), `number` each
    n-gram's, `bounds` the fragments' ends."""

    def __init__(self, group: pa.Table, width: int, fragments: int):
        rows = group.to_pylist()
        head = next(r for r in rows if r["one"] is None)
        mine = np.sort(np.array([x for r in rows if r["one"] is not None for x in r["one"]], np.int64)) - head["unit"] * ROWS_IN_UNIT
        data, offsets = _texts(head)
        size = np.diff(offsets)[mine]
        at = np.repeat(offsets[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.unit, self.fragments = head["unit"], fragments
        self.row = mine + head["unit"] * ROWS_IN_UNIT
        self.grams, self.size = all_sets(data[at], np.r_[0, np.cumsum(size)], width)
        self.owner = np.repeat(np.arange(len(mine)), self.size)
        n = np.uint64(fragments)
        key = (self.grams % n) << np.uint64(32) | (self.grams // n & np.uint64(0xFFFFFFFF))
        self.keys, self.number, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted((self.keys >> np.uint64(32)).astype(np.int64), np.arange(fragments + 1))


def _tell(width: int, fragments: int):
    """The n-grams that a unit's sets have, each once, and how many of the sets have it."""

    def run(group: pa.Table) -> pa.Table:
        s = Sets(group, width, fragments)
        some = np.flatnonzero(np.diff(s.bounds))
        bounds = np.r_[s.bounds[some], len(s.keys)]
        columns = pa.array(some, pa.int32()), pa.array(np.full(len(some), s.unit), pa.int64()), slices(s.keys.astype(np.uint32), bounds), slices(np.minimum(s.counts, 65535).astype(np.uint16), bounds)
        return pa.Table.from_arrays(list(columns), schema=_TOLD)

    return run


def _level(df: np.ndarray) -> np.ndarray:
    """How frequent an n-gram is, in a byte: exact up to 127, four steps a doubling beyond."""
    return np.where(df < 128, df, np.minimum(255, 100 + 4 * np.log2(np.maximum(df, 1)))).astype(np.uint8)


def _count(group: pa.Table) -> pa.Table:
    """Of one fragment: the level of each n-gram's number of sets, back to the units that have it."""
    rows = group.to_pylist()
    grams = np.concatenate([np.frombuffer(r["grams"], np.uint32) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in rows])
    order = np.argsort(grams)
    run = np.cumsum(np.r_[True, np.diff(grams[order]) != 0]) - 1
    level = np.empty(len(grams), np.uint8)
    level[order] = _level(np.bincount(run, counts[order]).astype(np.int64))[run]
    ends = np.cumsum([len(r["grams"]) // 4 for r in rows])
    out = pa.array([r["unit"] for r in rows], pa.int64()), pa.array([r["fragment"] for r in rows], pa.int32()), slices(level, np.r_[0, ends])
    give_back()
    return pa.Table.from_arrays(list(out), schema=_LEVELS)


def _survivors(width: int, fragments: int, percent: int):
    """Sets of which so much is shared that they can link at all, cut along the global order (rarer first)."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("cut", pa.int32()), ("grams", pa.list_(pa.int64())), ("before", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in schema.names}
        if not any(x is not None for x in left["one"].to_pylist()):
            return pa.Table.from_pydict(out, schema=schema)
        s = Sets(left, width, fragments)
        answers = sorted(right.to_pylist(), key=lambda r: r["fragment"])
        level = np.frombuffer(b"".join(r["levels"] for r in answers), np.uint8)
        if len(level) != len(s.keys):
            raise RuntimeError("levels do not fit the unit: a table in the shared folder was changed")
        level = level[s.number]
        many = level > 1
        shared = np.bincount(s.owner[many], minlength=len(s.row))
        able = (100 * shared >= percent * s.size) & (s.size > 0)
        keep = many & able[s.owner]
        owner, grams, level = s.owner[keep], s.grams[keep], level[keep]
        order = np.lexsort((grams, level, owner))
        owner, grams, level = owner[order], grams[order].view(np.int64), level[order]
        step = np.where(level < 128, np.frexp(level.astype(np.float64))[1], level // 4 - 24)  # a cut for each doubling
        bounds = np.searchsorted(owner, np.arange(len(s.row) + 1))
        for i in np.flatnonzero(able).tolist():
            lo, hi, n = int(bounds[i]), int(bounds[i + 1]), int(s.size[i])
            # sets that link share one of the first n - ceil(percent n / 100) + 1 n-grams; those nobody shares come first
            prefix = n + (-percent * n // 100) + 1 - (n - int(shared[i]))
            edges = lo + np.flatnonzero(np.r_[True, step[lo + 1 : hi] != step[lo : hi - 1]]) if hi > lo else []
            for a, b in zip(edges, [*edges[1:], hi], strict=True):
                row = int(s.row[i]), n, int(shared[i]), int(step[a]), grams[a:b], int(a) - lo, grams[a : max(a, min(b, lo + prefix))]
                for k, v in zip(schema.names, row, strict=True):
                    out[k].append(v)
        give_back()
        return pa.Table.from_pydict(out, schema=schema)

    return run


def candidate_sets(units: DataFrame, first_rows: DataFrame, size: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """SETS_DDL: for each class (first_rows: cid, unit) that may link, its shared n-grams in the global order (by
    how many sets have them, then by hash), a row for each cut of that order; `prefix` are those a link must
    share one of. A unit sends each n-gram once, however many of its sets have it."""
    fragments = fragments_for(size, FRAGMENT_BYTES)
    ones = first_rows.groupBy("unit").agg(F.collect_list("cid").alias("one"))  # as many as a unit has rows
    blank = [F.lit(None).cast("binary").alias(c) for c in ("texts", "sizes", "keys", "nulls", "hashes")]
    met = dealt(units.unionByName(ones.select("unit", *blank, "one")), "unit", size)
    told = dealt(met.groupBy("unit").applyInArrow(_told(width, fragments), TOLD_DDL), "fragment", size, FRAGMENT_BYTES)
    levels = dealt(told.groupBy("fragment").applyInArrow(_count, LEVELS_DDL), "unit", size)
    return met.groupBy("unit").cogroup(levels.groupBy("unit")).applyInArrow(_survivors(width, fragments, percent), SETS_DDL)


def _told(width: int, fragments: int):
    tell = _tell(width, fragments)
    return lambda group: tell(group) if any(x is not None for x in group["one"].to_pylist()) else _TOLD.empty_table()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs(a, b) those that link: overlaps are counted for each cut of the order and summed per pair."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), "cut", F.col("grams").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), "cut", F.col("grams").alias("gb"))
    parts = pairs.join(left, "a").join(right, ["b", "cut"])
    part = F.size(F.array_intersect("ga", "gb"))
    total = parts.groupBy("a", "b").agg(F.sum(part).alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where(F.col("o") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def stars(sets: DataFrame) -> DataFrame:
    """A few pairs that likely link: under some of its n-grams, each set with the set of which the largest
    part is shared. What edited copies have in common is theirs, not each other's: that is their centre."""
    own = (F.lit(1.0) - F.col("shared") / F.col("n")).alias("own")
    some = sets.select("cid", own, (-F.col("n")).alias("n"), F.explode(F.slice(F.array_sort("grams"), 1, 3)).alias("gram"))
    centre = some.groupBy("gram").agg(F.min(F.struct("own", "n", "cid")).alias("c")).select(_join_key("gram").alias("k"), F.col("c.cid").alias("c"))
    met = some.withColumn("k", _join_key("gram")).join(centre, "k")
    return met.where("cid <> c").select(F.col("cid").alias("a"), F.col("c").alias("b")).distinct()


def _length_class(n: str, percent: int) -> Column:
    """Sizes whose quotient is percent / 100 or more lie in one class or in neighbouring ones."""
    return F.floor(F.ln(F.col(n).cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9)).cast("int") if percent < 100 else F.col(n).cast("int")


def open_pairs(sets: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair that may link and whose ends `found`(node, root) does not tie together yet.

    Two sets that link share an n-gram of both prefixes. Lists of sets with such an n-gram whose sets are all
    in one component have nothing to add. Of the others each set outside the component that has most of the
    list meets the sets of its length class and the neighbouring ones that are in another component, so that
    a list's tied part never meets itself; then come the length and the positional filter."""
    root = found.select(_join_key("node").alias("k"), "root")
    tied = sets.where(F.size("prefix") > 0).withColumn("k", _join_key("cid")).join(root, "k", "left").withColumn("root", F.coalesce("root", "cid"))
    posts = tied.select("cid", "n", "root", (F.col("shared") - F.col("before")).alias("left"), F.posexplode("prefix").alias("at", "gram"))
    posts = posts.select("cid", "n", "root", "gram", (F.col("left") - F.col("at")).alias("rest"))
    per_root = posts.groupBy("gram", "root").count()
    lists = per_root.groupBy("gram").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    mixed = posts.withColumn("k", _join_key("gram")).join(lists.select(_join_key("gram").alias("k"), F.col("top.root").alias("top")), "k")
    mixed = pin(mixed.select("cid", "n", "root", "gram", "rest", (F.col("root") == F.col("top")).alias("big"), _length_class("n", percent).alias("class")))
    near = [0] if percent >= 100 else [-1, 0, 1]
    a = mixed.where("not big").select(*(F.col(c).alias(f"{c}_a") for c in ("cid", "n", "root", "gram", "rest", "class")))
    b = mixed.select(*(F.col(c).alias(f"{c}_b") for c in ("cid", "n", "root", "gram", "rest", "big")), F.explode(F.array(*[F.col("class") + d for d in near])).alias("class_b"))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = a.join(b, (F.col("gram_a") == F.col("gram_b")) & (F.col("class_a") == F.col("class_b"))).where(
        (F.col("root_a") != F.col("root_b"))
        & (F.col("big_b") | (F.col("cid_a") < F.col("cid_b")))
        & (low * 100 >= high * percent)
        & ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (low + high))  # n-grams from this one on, in either
    )
    return both.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, cid, component_id, text_hash, row) for every row of docs(doc_id, text).

    A document's set is its distinct n-grams of `width` words (fewer words: the whole sequence; none: empty,
    linked with nothing). Two link when 100 x intersection >= percent x union; component_id is the smallest
    doc_id that links reach. Equal sets (by 128 bits) are one class, named by its first row; links are sought
    between classes only.

    An n-gram that one class has cannot add to an overlap, so a first pass counts classes per n-gram in hash
    fragments, which grow in number with the text, and keeps classes of which enough is shared. Of these, a
    few star pairs are verified first; then every pair that shares a prefix n-gram across components. No list
    of like documents is expanded into its pairs once links hold it together, and none is cut short.
    Null and empty texts are empty, texts may be of any length; repeated rows are alike; null keys stay and are
    never a component_id unless alone; an empty table gives none. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    size = total_bytes(rows, "text")
    units = cut(rows.mapInArrow(_pack, UNIT_DDL), "none")  # texts are compressed
    keyed = pin(classes(units, width))
    by_class = pin(keyed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("row").alias("cid"), F.min_by("unit", "row").alias("unit"), F.min("doc_id").alias("low")))
    sets = cut(candidate_sets(units, by_class.select("cid", "unit"), size, width, percent))
    first = pin(verified(stars(sets), sets, percent))
    tied = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    more = verified(pin(open_pairs(sets, tied, percent)), sets, percent)
    edges = tied.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(pin(edges))
    named = by_class.withColumn("k", _join_key("cid")).join(roots.select(_join_key("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id")).select(_join_key("root").alias("k"), "component_id")
    named = named.drop("k").withColumn("k", _join_key("root")).join(lows, "k").select(_join_key("h1").alias("k1"), _join_key("h2").alias("k2"), "cid", "component_id")
    out = keyed.withColumns({"k1": _join_key("h1"), "k2": _join_key("h2")}).join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", "cid", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash", "row")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns as they are, that stay when of each component one does: the smallest
    doc_id (null last), of several texts under it the smallest hash, of equal rows any one. Documents without
    words all stay. Columns of docs may have any names."""
    found = link_components(docs, width, percent)
    grouped = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("cid")).alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    stay = grouped.agg(first).select(F.coalesce("first.doc_id", F.lit(0)).alias("i"), F.col("first.none").alias("none"), F.col("first.text_hash").alias("h")).distinct()
    # the rows travel as one struct beside the join's own columns, so that no name can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")
    blank = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
    full = keyed.where(~blank).join(stay, ["i", "none", "h"])
    nth = F.row_number().over(Window.partitionBy("i", "none", "h").orderBy("i"))
    return full.withColumn("nth", nth).where("nth = 1").select("whole").unionByName(keyed.where(blank).select("whole")).select("whole.*")
