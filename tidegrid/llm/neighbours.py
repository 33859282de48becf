"""Approximate nearest neighbours by a permutation index: pivot inverted files, footrule rank, exact rerank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.shared import cut, dealt, give_back, mix, prepare

#: Pivots (a bounded sample of the vectors), and how many nearest ones a vector is posted under (255 at most).
PIVOTS, NEAREST = 256, 64
#: Recall that a search is set up for, and the bounded sample that decides what it takes: rows, queries of them.
RECALL, TUNE_ROWS, TUNE_QUERIES = 0.97, 4096, 192
#: What may be taken: the share of pivots whose files a query opens, and of the rows there that are scored exactly.
PROBES = (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0)
SHARES = (0.005, 0.01, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5)
#: Rows in a block of inverted files, and queries that meet one at a time.
BLOCK_ROWS, QUERY_ROWS = 16_384, 16_384
FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column, size: int) -> Column:
    """Of the given length, without null, NaN or infinite components, and not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == size) & sound & F.exists(vector, lambda x: x != 0)


def permutations(vectors: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Each vector's m nearest pivots by inner product, nearest first; ties to the lower pivot."""
    near = vectors @ pivots.T
    m = min(m, len(pivots))
    top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(len(pivots)), (len(near), 1))
    top.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


class InvertedFiles:
    """A block of vectors posted under their nearest pivots: for each pivot the place it has in the order of
    each row, m where it is not among the row's nearest. Rows lie in the order of their nearest pivot, `cell`."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, pivots: int):
        order = np.lexsort((ids, near[:, 0]))
        self.ids, self.vectors, near = ids[order], vectors[order], near[order]
        self.m, n = near.shape[1], len(near)
        self.files = np.full((pivots, n), self.m, np.uint8)
        for place in range(self.m):
            self.files[near[:, place], np.arange(n)] = place
        self.cell = np.searchsorted(near[:, 0], np.arange(pivots + 1))

    def footrules(self, near: np.ndarray) -> np.ndarray:
        """Spearman's footrule from a query's nearest pivots to every row, up to its scale and a constant; a pivot
        outside the nearest m stands at place m: |a - b| - (m - a) - (m - b) is 2 max(a, b) - 2 m."""
        out = np.zeros(len(self.ids), np.uint16)
        for at, pivot in enumerate(near[: self.m].tolist()):
            out += np.maximum(self.files[pivot], np.uint8(at))
        return out

    def opened(self, near: np.ndarray, probes: int) -> np.ndarray | None:
        """The rows whose nearest pivot is among the query's `probes` nearest; None for all."""
        if probes >= len(self.files):
            return None
        cells = np.sort(near[:probes])
        lo, hi = self.cell[cells], self.cell[cells + 1]
        return np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())

    def search(self, query_id: int, query: np.ndarray, near: np.ndarray, k: int, probes: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best by inner product of the best rows by footrule; ties to the smaller id.
        near: all pivots in the query's order."""
        rows = self.opened(near, probes)
        rows = np.flatnonzero(self.ids != query_id) if rows is None else rows[self.ids[rows] != query_id]
        keep = max(k, int(np.ceil(share * len(rows))))
        if keep < len(rows):
            rule = self.footrules(near)[rows]
            rows = rows[rule <= np.partition(rule, keep - 1)[keep - 1]]  # with all that tie with the last
        score = (self.vectors[rows] * query).sum(axis=1)
        if len(score) > k:
            best = np.flatnonzero(score >= np.partition(score, -k)[-k])
            rows, score = rows[best], score[best]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def tuned(vectors: np.ndarray, points: np.ndarray, nearest: int, k: int, recall: float) -> tuple[int, float]:
    """How many pivots' files a query opens and what share of the rows there is scored, so that a sample reaches
    the recall at the least cost; everything if nothing less does. A sample's neighbours lie farther than
    those in the whole table, so that it asks for rather too much."""
    n = len(vectors)
    asked = np.unique(np.linspace(0, n - 1, min(n, TUNE_QUERIES)).astype(np.int64))
    full = permutations(vectors[asked], points, len(points))
    files = InvertedFiles(np.arange(n), vectors, permutations(vectors, points, nearest), len(points))
    probes = sorted({max(1, round(p * len(points))) for p in PROBES})
    hits = np.zeros((len(probes), len(SHARES)))
    for q, near in zip(asked.tolist(), full, strict=True):
        rule = files.footrules(near).astype(np.int64)
        score = (files.vectors * vectors[q]).sum(axis=1)
        score[files.ids == q] = -np.inf
        true = np.argsort(-score, kind="stable")[: min(k, n - 1)]
        for i, p in enumerate(probes):
            rows = files.opened(near, p)
            rows = np.arange(n) if rows is None else rows
            inside = np.isin(true, rows)
            below = np.searchsorted(np.sort(rule[rows]), rule[true[inside]])  # rows that come before each
            for j, s in enumerate(SHARES):
                hits[i, j] += (below < max(k, s * len(rows))).sum() / max(1, len(true))
    able = [(p / len(points) * (1 + 6 * s), p, s) for i, p in enumerate(probes) for j, s in enumerate(SHARES) if hits[i, j] >= recall * len(asked)]
    _, p, s = min(able, default=(0, len(points), 1.0))
    return p, s


@dataclass(frozen=True)
class Layout:
    """Which block a cell's rows lie in: small cells share one, a large one is split by a hash of the key."""

    base: np.ndarray
    splits: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, block_rows: int) -> "Layout":
        base, splits = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // block_rows))
        block, held = 0, 0
        for cell, n in enumerate(counts.tolist()):
            if held and held + n > block_rows:
                block, held = block + 1, 0
            base[cell] = block
            if n > block_rows:
                block, held = block + int(splits[cell]), 0
            else:
                held += n
        return cls(base, splits)

    @property
    def blocks(self) -> int:
        return int((self.base + self.splits).max())

    def of_rows(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.base[cells] + (mix(ids) % self.splits[cells].astype(np.uint64)).astype(np.int64)

    def of_query(self, cells: np.ndarray) -> np.ndarray:
        """The blocks of some cells."""
        n = self.splits[cells]
        return np.unique(np.repeat(self.base[cells] - (np.cumsum(n) - n), n) + np.arange(n.sum()))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _doubles(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.float64) for x in column.to_pylist()])


_GRID = pa.schema([("cell", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("near", pa.binary())])
GRID_DDL = "cell int, ids binary, vectors binary, near binary"
_ANSWER = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _pack(cell: np.ndarray, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each cell of the grid with all that goes there."""
    order = np.argsort(cell, kind="stable")
    cell, row = cell[order], row[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else cell
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
        which = row[lo:hi]
        values = int(cell[lo]), ids[which].tobytes(), vectors[which].tobytes(), near[which].astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(_GRID.names, values, strict=True)}, schema=_GRID)


def search(
    vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS, nearest: int = NEAREST,
    recall: float = RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each row of vectors that meets `queries` (a condition on `id`): FOUND, its k nearest other rows by
    inner product, ties to the smaller key.

    Vectors that are null, zero, hold null or non-finite components, have a null key or another length than
    most take no part. A key that repeats counts each row; rows with the query's own key are no candidates;
    equal rows are asked once, different vectors under one key each on their own. Fewer candidates than k: all
    of them. An empty table, or no query, gives none. Other columns are ignored.

    The pivots and the tuning sample are bounded (by a hash of the key); every row is posted. A row's nearest
    pivot names the block of inverted files it lies in; a query goes to the blocks of the pivots whose files it
    opens, which is all of them where vectors have no structure. Blocks do not depend on how batches or files
    fall. A block and a part of the queries meet in one task; of all answers a query's best k are kept before
    and after the last shuffle.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null and v is not null and size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    rows = rows.where(usable(F.col("v"), size))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots + TUNE_ROWS).select("v").collect()
    if not some:
        return spark.createDataFrame([], FOUND)
    sample = np.array([r.v for r in some], np.float64)
    points = sample[:pivots]
    points = np.unique(points / np.linalg.norm(points, axis=1, keepdims=True), axis=0)
    probes, share = tuned(sample[pivots:] if len(sample) >= 4 * pivots else sample, points, nearest, k, recall)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = _matrix(batch.column(1), size)
                near = permutations(held, points, nearest).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in near], pa.binary()), batch.column(1)], names=["id", "cell", "near", "v"])

    posted = cut(rows.mapInArrow(post, f"id long, cell int, near binary, v {rows.schema['v'].dataType.simpleString()}"))
    per_cell = posted.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(queries).alias("asked")).collect()  # a row a pivot
    counts = np.zeros(len(points), np.int64)
    for r in per_cell:
        counts[r.cell] = r.n
    n_queries = sum(r.asked for r in per_cell)
    if not n_queries:
        return spark.createDataFrame([], FOUND)
    layout, parts = Layout.of(counts, block_rows), -(-n_queries // query_rows)
    own = posted.where(queries).groupBy("id").count().agg(F.max("count")).first()[0]

    def opens(near: np.ndarray) -> int:
        """How many pivots' files a query opens: more than others if those hold few rows but its own."""
        return max(probes, int(np.searchsorted(np.cumsum(counts[near]), own + 10 * k)) + 1)

    def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("id").to_numpy(), _matrix(batch.column("v"), size)
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint16).reshape(len(ids), -1)
            block = layout.of_rows(batch.column("cell").to_numpy(), ids)
            cell = (block[:, None] * parts + np.arange(parts)).ravel()
            yield from _pack(cell, np.repeat(np.arange(len(ids)), parts), ids, held, near)

    def to_asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("id").to_numpy(), _matrix(batch.column("v"), size)
            near = permutations(held, points, len(points))
            to = [layout.of_query(x[: opens(x)]) for x in near]
            row = np.repeat(np.arange(len(ids)), [len(x) for x in to])
            part = (mix(ids) % np.uint64(parts)).astype(np.int64)
            yield from _pack(np.concatenate([*to, np.zeros(0, np.int64)]) * parts + part[row], row, ids, held, near)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            both = []
            for table in (left, right):
                ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
                near = np.concatenate([np.frombuffer(x, np.uint16) for x in table["near"].to_pylist()]).reshape(len(ids), -1).astype(np.int64)
                both.append((ids, _doubles(table["vectors"]).reshape(len(ids), -1), near))
            files = InvertedFiles(*both[0], len(points))
            for i, query, near in zip(*both[1], strict=True):
                found, score = files.search(int(i), query, near, k, opens(near), share)
                out.append((np.full(len(found), i), np.full(len(found), _number(query), np.int64), found, score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        give_back()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ANSWER.types, strict=True)], schema=_ANSWER)

    total = int(counts.sum()) * size * 8 * parts
    blocks = dealt(posted.mapInArrow(to_blocks, GRID_DDL), "cell", total)
    asked = posted.where(queries).dropDuplicates(["id", "v"]).mapInArrow(to_asked, GRID_DDL)
    answers = blocks.groupBy("cell").cogroup(dealt(asked, "cell", total).groupBy("cell")).applyInArrow(answer, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _number(vector: np.ndarray) -> int:
    """A number of a vector's components, the same in every process."""
    return int(mix(np.array([mix(vector.view(np.uint64) + np.arange(len(vector), dtype=np.uint64)).sum()], np.uint64)).view(np.int64)[0])
