"""Benchmark passages in documents: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import PLACE_CODES, give_back, prepare

#: Characters in a q-gram, edits allowed per character, and characters in a passage that counts as a leak.
Q, ERROR_RATE, WINDOW = 8, 0.1, 100
#: Benchmark text that one pass holds; more items take more passes.
PASS_BYTES = 16 << 20
#: Characters of documents that are handled at once.
BLOCK_CHARS = 1 << 19
_GAP = 0x110000
_BASE = 0x9E3779B97F4A7C15
HITS = "doc_id long, item_id long, start long, end long, edits int"


def normal(text: str | None) -> str:
    """Lower case, every run of white space one blank, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code for the q characters from each position: a polynomial, its length doubled step by step."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    wide = chars.astype(np.uint64) * PLACE_CODES[0]
    out, length = wide, 1
    for bit in bin(q)[3:]:
        out = out[: len(out) - length] * np.uint64(pow(_BASE, length, 2**64)) + out[length:]
        length *= 2
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(_BASE) + wide[length : length + len(out) - 1]
            length += 1
    out = out ^ (out >> np.uint64(31))
    return out * PLACE_CODES[1]


@dataclass(frozen=True)
class Window:
    item: int
    start: int
    chars: np.ndarray
    edits: int
    least: int


def windows_of(item: int, chars: np.ndarray, q: int, rate: float, size: int) -> list[Window]:
    """Parts of `size` characters, one from every quarter of that, the last at the end; a shorter item is one part.
    `least`: a region within the part's edit budget shares that many q-grams with it (the q-gram lemma). The
    budget is rate x length, but at most length / q - 1: more edits may leave no q-gram at all."""
    m = min(size, len(chars))
    starts = list(range(0, len(chars) - m + 1, max(1, m // 4))) if m else []
    if starts and starts[-1] != len(chars) - m:
        starts.append(len(chars) - m)
    out = []
    for s in starts:
        e = int(m * rate)
        while e and m + 1 - q * (e + 1) < 1:  # the budget that q-grams of this length can vouch for
            e -= 1
        out.append(Window(item, s, chars[s : s + m], e, max(1, m + 1 - q * (e + 1))))
    return out


class Index:
    """Benchmark items by their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = ERROR_RATE, window: int = WINDOW):
        self.q, self.ids = q, [i for i, _ in items]
        texts = [codes(normal(t)) for _, t in items]
        self.items = texts
        #: Items too short for a q-gram are looked for as they are, between word bounds.
        short = {normal(t): k for k, (_, t) in reversed(list(enumerate(items))) if 0 < len(texts[k]) < q}
        self.short = re.compile(r"(?<!\w)(?=(" + "|".join(map(re.escape, sorted(short, key=len, reverse=True))) + r")(?!\w))") if short else None
        self.short_items = {}
        for k, (_, t) in enumerate(items):
            if 0 < len(texts[k]) < q:
                self.short_items.setdefault(normal(t), []).append(k)
        self.windows = [windows_of(k, t, q, rate, window) if len(t) >= q else [] for k, t in enumerate(texts)]
        self.least = min((w.least for ws in self.windows for w in ws), default=1)
        self.reach = max((len(w.chars) + w.edits for ws in self.windows for w in ws), default=1)
        #: A band is twice this wide, and the next begins half-way: any budget's diagonals lie in one.
        self.half = max((w.edits for ws in self.windows for w in ws), default=1) + 1
        grams = [qgrams(t, q) for t in texts]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order].astype(np.int64), place[order].astype(np.int64)
        bits = 16
        while bits < 26 and 1 << bits < 64 * len(keys):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.keys >> self.shift).astype(np.int64)] = True

    def exact(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of every short item in each text."""
        for d, text in enumerate(texts):
            seen: dict[str, int] = {}
            for hit in self.short.finditer(text):
                # of items that begin at one place the longest is matched; shorter ones may end at a word bound too
                for word in self.short_items:
                    at = hit.start()
                    if word not in seen and text.startswith(word, at) and not (text[at + len(word) : at + len(word) + 1].isalnum() or text[at + len(word) : at + len(word) + 1] == "_"):
                        seen[word] = at
            yield from sorted((d, self.ids[k], at, at + len(word), 0) for word, at in seen.items() for k in self.short_items[word])

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, item id, start, end, edits) of every leak, the best region for each item."""
        if self.short is not None:
            yield from self.exact(texts)
        parts, starts, at = [], [], 0
        gap = np.full(self.q, _GAP, np.uint32)
        for t in texts:
            c = codes(t)
            starts.append(at)
            parts += [c, gap]
            at += len(c) + len(gap)
        if not at or not len(self.keys):
            return
        chars, starts = np.concatenate(parts), np.array(starts, np.int64)
        grams = qgrams(chars, self.q)
        place = np.flatnonzero(self.maybe[(grams >> self.shift).astype(np.int64)])
        found = grams[place]
        lo = np.searchsorted(self.keys, found, "left")
        hit = (lo < len(self.keys)) & (self.keys[np.minimum(lo, len(self.keys) - 1)] == found)
        place, found, lo = place[hit], found[hit], lo[hit]
        # a region needs `least` hits within `reach` characters, whatever the item
        first = np.searchsorted(place, place - self.reach, "left")
        last = np.searchsorted(place, place + self.reach, "right")
        dense = last - first >= self.least
        place, found, lo = place[dense], found[dense], lo[dense]
        n = np.searchsorted(self.keys, found, "right") - lo
        which = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        at_doc = np.repeat(place, n)
        doc = np.searchsorted(starts, at_doc, "right") - 1
        item, diagonal = self.item[which], at_doc - self.place[which]
        span = len(chars) // self.half + 3 + max((len(t) for t in self.items), default=0) // self.half
        shift = max((len(t) for t in self.items), default=0)
        band = (diagonal + shift) // self.half
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        jobs: dict[tuple[int, int], list[tuple]] = {}  # by length and budget of the window
        for b in (band, band - 1):  # each hit counts in the two bands over it
            key = (doc * len(self.items) + item) * np.int64(span + 1) + b + 1
            order = np.argsort(key, kind="stable")
            values, first, counts = np.unique(key[order], return_index=True, return_counts=True)
            for i in np.flatnonzero(counts >= self.least).tolist():
                pair, low = divmod(int(values[i]), span + 1)
                d, k = divmod(pair, len(self.items))
                if (d, k) in best:
                    continue
                places = np.sort(self.place[which[order[first[i] : first[i] + counts[i]]]])
                low, begin, end = (low - 1) * self.half - shift, int(starts[d]), int(starts[d] + len(texts[d]))
                for w in self.windows[k]:
                    inside = np.searchsorted(places, [w.start, w.start + len(w.chars) - self.q + 1])
                    if inside[1] - inside[0] < w.least:
                        continue
                    at = find_exact(w, chars, begin, end, low, low + 2 * self.half)
                    if at >= 0:  # nothing is better, so the item's other windows in this text can wait
                        best[d, k] = (d, self.ids[k], at - begin, at - begin + len(w.chars), 0)
                        break
                    jobs.setdefault((len(w.chars), w.edits), []).append((d, k, w, begin, end, low))
        for (m, edits), rows in jobs.items():
            rows = [r for r in rows if (r[0], r[1]) not in best or best[r[0], r[1]][4]]
            for at in range(0, len(rows), 2048):
                lot = rows[at : at + 2048]
                found = align(np.stack([w.chars for _, _, w, *_ in lot]), np.array([(w.start, *x) for _, _, w, *x in lot], np.int64), chars, edits, 2 * self.half)
                for (d, k, _, begin, *_), (start, stop, cost) in zip(lot, found.tolist(), strict=True):
                    if cost <= edits and ((d, k) not in best or (cost, start - begin) < (best[d, k][4], best[d, k][2])):
                        best[d, k] = (d, self.ids[k], start - begin, stop - begin, cost)
        yield from (best[x] for x in sorted(best))


def find_exact(w: Window, chars: np.ndarray, begin: int, end: int, low: int, high: int) -> int:
    """Where a window stands as it is along diagonals low..high (and its budget beside them) of a text at
    begin..end, or -1."""
    origin = max(begin, w.start + low - w.edits)
    at = chars[origin : min(end, w.start + high + w.edits + len(w.chars))].tobytes().find(w.chars.tobytes())
    return origin + at // 4 if at >= 0 and at % 4 == 0 else -1


_FAR = np.int32(1 << 20)


def align(windows: np.ndarray, places: np.ndarray, chars: np.ndarray, edits: int, band: int) -> np.ndarray:
    """The best alignment (start, end, edits) of each window (a row of characters) along the diagonals low to
    low + band, and the budget beside them, of its text; more edits than the budget where there is none.
    places: (window's start in its item, begin and end of the text, low) of each. Costs are kept for the
    band's diagonals only, of all windows at once; those beyond the budget drop out on the way."""
    n, m = windows.shape
    out = np.full((n, 3), edits + 1, np.int64)
    alive = np.arange(n)
    start, begin, end, low = (places[:, i : i + 1] for i in range(4))
    k = np.arange(band + 2 * edits + 1)
    at = start + low - edits + k  # text position before which a path stands, at row 0
    cost = np.where((at >= begin) & (at <= end), 0, _FAR).astype(np.int32)
    origin = at.copy()
    for j in range(m):
        here = at + j  # text position that the diagonal consumes in this row
        valid = (here >= begin) & (here < end)
        other = np.where(valid, chars[np.clip(here, 0, len(chars) - 1)] != windows[:, j : j + 1], _FAR)
        step = cost + other
        down, moved = np.full_like(cost, _FAR), np.zeros_like(origin)
        down[:, :-1], moved[:, :-1] = cost[:, 1:] + 1, origin[:, 1:]
        take = down < step
        new, source = np.where(take, down, step), np.where(take, moved, origin)
        along = new - k  # insertions run along the row
        run = np.minimum.accumulate(along, axis=1)
        who = np.maximum.accumulate(np.where(along == run, k, 0), axis=1)
        cost, origin = np.minimum(run + k, _FAR).astype(np.int32), np.take_along_axis(source, who, 1)
        if j % 8 == 7 and not (hope := cost.min(axis=1) <= edits).all():
            if not hope.any():
                return out
            alive, at, cost, origin, windows, begin, end = (x[hope] for x in (alive, at, cost, origin, windows, begin, end))
    stop = np.where((at + m >= begin) & (at + m <= end), cost, _FAR)
    i = np.argmin(stop, axis=1)[:, None]
    out[alive] = np.concatenate([np.take_along_axis(origin, i, 1), np.take_along_axis(at, i, 1) + m, np.take_along_axis(stop, i, 1)], axis=1)
    return out


def passes(benchmark: DataFrame, most: int = PASS_BYTES) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // most))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else benchmark for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = ERROR_RATE, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Leaks of benchmark(item_id, text) in docs(key, text): HITS, one row for each text row and item of which
    a whole window lies in the text within rate x length edits; start and end in the normalised text.

    Texts are compared in lower case with white space runs as one blank. A whole window lies in every passage of
    1.25 x `window` characters of an item. Items of fewer than q characters have no q-gram: they are found as
    they are, between word bounds. Windows of under 40 characters allow one edit less than the rate says, as
    q-grams cannot vouch for more. The benchmark's size is checked: each pass broadcasts at most PASS_BYTES of
    it. Texts may be of any length; null and empty ones have no leaks, repeated rows each have their own, equal
    items are each found, null keys stay; empty tables give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = None
    for part in passes(benchmark):
        items = sorted((r.item_id, r.text) for r in part.where("item_id is not null and text is not null").select("item_id", "text").collect())
        index = spark.sparkContext.broadcast(Index(items, q, rate, window))

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "start", "end", "edits"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

            def searched(ids: list, texts: list[str]):
                rows = [(ids[d], *rest) for d, *rest in index.value.search(texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

            for batch in batches:
                ids, texts, size = [], [], 0
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(i)
                    texts.append(normal(t.as_py()))
                    size += len(texts[-1])
                    if size >= BLOCK_CHARS:
                        yield from searched(ids, texts)
                        ids, texts, size = [], [], 0
                yield from searched(ids, texts)
            give_back()

        found = docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = ERROR_RATE, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, in whose text leaks() would find nothing. Null and empty texts and
    null keys stay, repeated rows alike; an empty benchmark keeps all."""
    spark, out = docs.sparkSession, docs
    prepare(spark)
    for part in passes(benchmark):
        items = sorted((r.item_id, r.text) for r in part.where("item_id is not null and text is not null").select("item_id", "text").collect())
        index = spark.sparkContext.broadcast(Index(items, q, rate, window))

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [normal(t.as_py()) for t in batch.column("text")]
                keep = np.ones(len(texts), bool)
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (size < BLOCK_CHARS or end == at):
                        size += len(texts[end])
                        end += 1
                    for d, *_ in index.value.search(texts[at:end]):
                        keep[at + d] = False
                    at = end
                yield batch.filter(pa.array(keep))
            give_back()

        out = out.mapInArrow(run, docs.schema)
    return out
