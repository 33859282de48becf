"""Removal of byte strings that documents repeat from earlier ones, found on Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import BYTE_CODES, binary_parts, block_slices, cut, dealt, fragments_for, give_back, mix, packed, prepare, slices, total_bytes, unpacked

#: Bytes of a repeated string, and of the grams whose minimum over it decides where it is looked for.
LENGTH, GRAM = 50, 20
UNIT_BYTES, STEP_BYTES, FRAGMENT_BYTES = 4 << 20, 1 << 16, 16 << 20
#: Bytes of strings that one transform holds, where their places allow it.
TRANSFORM_BYTES = 1 << 18
#: A gram that more units than this have is hot: its windows are placed by more bytes than the gram's.
HOT_UNITS = 64
#: Bytes that the suffix order starts from: 9 bits each in 64.
KEY = 7
#: Bits of a place in a part that is segmented at once; hashes are compared without that many.
PLACE_BITS = np.uint64(20)
_BASE = 0x9E3779B97F4A7C15
_LAST = np.int64(2**63 - 1)  # the place of a null doc_id: after all others
ALONE, MET, HOT = 0, 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# ---- segments: runs of windows with one minimiser ---------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    out, length, wide = BYTE_CODES[data], 1, BYTE_CODES[data]
    for bit in bin(size)[3:]:
        out = out[: len(out) - length] * np.uint64(pow(_BASE, length, 2**64)) + out[length:]
        length *= 2
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(_BASE) + wide[length : length + len(out) - 1]
            length += 1
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _pieces(offsets: np.ndarray, length: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, offsets) of parts to segment at once; a longer text comes in parts of `most` windows,
    which overlap so that each of its windows lies in one part."""
    for lo, hi in block_slices(offsets, most):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo == 1 and end - begin > most + length:
            for at in range(begin, end - length + 1, most):
                yield lo, np.array([at, min(at + most + length - 1, end)], np.int64)
        else:
            yield lo, offsets[lo : hi + 1]


class Segments:
    """The windows of `length` bytes inside a unit's texts, in runs that have one minimiser.

    A window belongs to the gram with the smallest hash in it, the leftmost of such. Equal windows have equal
    grams at equal places, so they lie in segments of one hash. `text`, `first`, `last` (windows), `spot` (of
    the gram) and `hash` are in order of fragment (hash modulo fragments), `bounds` has the fragments' ends.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, fragments: int):
        parts = [self._of(data, lo, part, length, gram) for lo, part in _pieces(offsets, length, STEP_BYTES)]
        text, first, last, spot, hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else self._of(data, 0, offsets[:1], length, gram)
        home = (hashes % np.uint64(fragments)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        self.text, self.first, self.last, self.spot = text[order], first[order], last[order], spot[order]
        self.hash = hashes[order]
        self.bounds = np.searchsorted(home[order], np.arange(fragments + 1))

    @staticmethod
    def _of(data, lo, offsets, length, gram):
        base = int(offsets[0]) if len(offsets) else 0
        data = data[base : int(offsets[-1])] if len(offsets) else data[:0]
        if len(data) < length:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none.astype(np.uint64)
        offsets = offsets - base
        hashes = gram_hashes(data, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        low = window_minimum((hashes >> PLACE_BITS << PLACE_BITS) | place, length - gram + 1)
        anchor = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        sizes = np.diff(offsets)
        n = np.maximum(sizes - length + 1, 0)
        valid = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text = np.repeat(np.arange(len(sizes)), n)
        at = anchor[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(valid)] - 1 if len(starts) else starts
        spot = at[starts]
        return text[starts] + lo, valid[starts] + base, valid[ends] + base, spot + base, hashes[spot]


# ---- units ------------------------------------------------------------------------------------

_UNIT = pa.schema([("unit", pa.int64()), ("fragment", pa.int32()), ("texts", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary())])
UNIT_DDL = "unit long, fragment int, texts binary, sizes binary, ids binary, marks binary"
_TOLD = pa.schema([("fragment", pa.int32()), ("unit", pa.int64()), ("places", pa.binary()), ("twice", pa.binary())])
TOLD_DDL = "fragment int, unit long, places binary, twice binary"
_SENT = pa.schema([("fragment", pa.int32()), ("unit", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("strings", pa.binary())])
SENT_DDL = "fragment int, unit long, places binary, ids binary, sizes binary, strings binary"
_FOUND = pa.schema([("unit", pa.int64()), ("fragment", pa.int32()), ("string", pa.binary()), ("begin", pa.binary()), ("end", pa.binary())])
FOUND_DDL = "unit long, fragment int, string binary, begin binary, end binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(schema.names, values, strict=True)}, schema=schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({k: list(c) for k, c in zip(schema.names, zip(*rows, strict=True), strict=True)} if rows else {k: [] for k in schema.names}, schema=schema)


def _pack(unit_bytes: int):
    """Consecutive rows (doc_id, text) of up to unit_bytes as one row, with a number no other unit has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_parts(batch.column(1))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
            for lo, hi in block_slices(offsets, unit_bytes):
                yield _row(_UNIT, (n << 32) + task, -1, packed(data[offsets[lo] : offsets[hi]]), np.diff(offsets[lo : hi + 1]).tobytes(), ids[lo:hi].tobytes() + null[lo:hi].tobytes(), None)
                n += 1
        give_back()

    return run


class Unit:
    """A unit's texts and their segments."""

    def __init__(self, texts: bytes, sizes: bytes, ids: bytes, length: int, gram: int, fragments: int):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.data = unpacked(texts, int(self.offsets[-1]), np.uint8)
        n = len(self.sizes)
        self.ids, self.null = np.frombuffer(ids[: 8 * n], np.int64), np.frombuffer(ids[8 * n :], bool)
        self.length, self.gram, self.fragments = length, gram, fragments
        self.segments = Segments(self.data, self.offsets, length, gram, fragments)

        s = self.segments
        # 32 bits of a hash are left beside its fragment; where two fall together, more is compared
        self.home = np.repeat(np.arange(fragments), np.diff(s.bounds))
        key = self.home.astype(np.uint64) << np.uint64(32) | place_of(s.hash, fragments).astype(np.uint64)
        self.keys, self.number = np.unique(key, return_inverse=True)
        self.key_bounds = np.searchsorted((self.keys >> np.uint64(32)).astype(np.int64), np.arange(fragments + 1))

    def strings(self, marks: dict[int, bytes]) -> "Strings":
        """What is compared: the segments whose place others have. Under a hot gram a window goes by the gram
        and the half of its other bytes that lie on the left of it, or else those on the right."""
        s, half = self.segments, (self.length - self.gram) // 2
        status = np.frombuffer(b"".join(marks[f] for f in sorted(marks)), np.uint8)
        if len(status) != len(self.keys):
            raise RuntimeError("marks do not fit the unit: a table in the shared folder was changed")
        status = status[self.number]
        met, hot = np.flatnonzero(status == MET), np.flatnonzero(status == HOT)
        text, first, last, place = [s.text[met]], [s.first[met]], [s.last[met]], [s.hash[met]]
        if len(hot):
            border = s.spot[hot] - half  # windows up to here have `half` bytes on the gram's left
            left = s.first[hot], np.minimum(s.last[hot], border), border
            right = np.maximum(s.first[hot], border + 1), s.last[hot], s.spot[hot]
            for side, (lo, hi, at) in enumerate((left, right), 1):
                some = lo <= hi
                text.append(s.text[hot][some]), first.append(lo[some]), last.append(hi[some])
                place.append(hash_at(self.data, at[some], self.gram + half, side))
        return Strings(self, *(np.concatenate(x) for x in (text, first, last, place)))


def place_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return (hashes // np.uint64(fragments)).astype(np.uint32)


def hash_at(data: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of the `size` bytes from each place."""
    out = np.full(len(at), seed, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + BYTE_CODES[data[at + k]]
    return mix(out)


class Strings:
    """A unit's strings to compare; those equal byte for byte are held once, under the smallest id that has
    them. `begin`, `size`, `place` and `ids` of the kinds are in order of fragment, `bounds` has the fragments'
    ends; holder_... has every string, its kind and id."""

    def __init__(self, unit: Unit, text: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray):
        self.holder_ids, self.holder_begin, size = unit.ids[text], first, last - first + unit.length
        one, kind = distinct_strings(unit.data, first, size)
        home = (hashes[one] % np.uint64(unit.fragments)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        one, self.holder_kind = one[order], rank[kind]
        self.bounds = np.searchsorted(home[order], np.arange(unit.fragments + 1))
        self.begin, self.size, self.place = first[one], size[one], place_of(hashes[one], unit.fragments)
        self.ids = np.full(len(one), _LAST)
        np.minimum.at(self.ids, self.holder_kind, self.holder_ids)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, laid end to end."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def row_width(size: np.ndarray) -> int:
    """Bytes of the longest string, so many that 4 more fill whole numbers of 64 bits."""
    return (int(size.max()) + 4 + 7) // 8 * 8 - 4


def distinct_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each kind of equal byte strings, the kind of each string), compared byte by byte."""
    if not len(begin):
        return begin, begin
    width = row_width(size)
    if int(begin.max()) + width > len(data):
        data = np.r_[data, np.zeros(width, np.uint8)]
    rows = np.empty((len(begin), width + 4), np.uint8)
    np.multiply(np.lib.stride_tricks.sliding_window_view(data, width)[begin], np.arange(width) < size[:, None], out=rows[:, 4:])
    rows[:, :4] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = rows.view(np.uint64)
    key = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        key = (key ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")  # the key brings equal ones together, the bytes decide
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


# ---- steps ------------------------------------------------------------------------------------


def _tell(length: int, gram: int, fragments: int):
    """The places that a unit's segments have, and which of them several of its documents have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row["texts"], row["sizes"], row["ids"], length, gram, fragments)
                ids = unit.ids[unit.segments.text]
                low, high = np.full(len(unit.keys), _LAST), np.full(len(unit.keys), -_LAST)
                np.minimum.at(low, unit.number, ids)
                np.maximum.at(high, unit.number, ids)
                some = np.flatnonzero(np.diff(unit.key_bounds))
                bounds = np.r_[unit.key_bounds[some], len(unit.keys)]
                columns = pa.array(some, pa.int32()), pa.array(np.full(len(some), row["unit"]), pa.int64()), slices(unit.keys.astype(np.uint32), bounds), slices(low < high, bounds)
                yield pa.RecordBatch.from_arrays(list(columns), schema=_TOLD)
        give_back()

    return run


def _mark(hot: int):
    """For each unit and place of one fragment: ALONE if no other document has the place, else MET or HOT."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        places = [np.frombuffer(r["places"], np.uint32) for r in rows]
        every = np.concatenate(places)
        twice = np.concatenate([np.frombuffer(r["twice"], np.uint8) for r in rows])
        order = np.argsort(every)
        run_of = np.cumsum(np.r_[True, np.diff(every[order]) != 0]) - 1
        units = np.bincount(run_of)
        shared = (units > 1) | (np.bincount(run_of, twice[order]) > 0)
        mark = np.empty(len(every), np.uint8)
        mark[order] = np.where(units > hot, HOT, np.where(shared, MET, ALONE))[run_of]
        parts = np.split(mark, np.cumsum([len(p) for p in places])[:-1])
        return _table(_UNIT, [(r["unit"], r["fragment"], None, None, None, m.tobytes()) for r, m in zip(rows, parts, strict=True)])

    return run


def _met(group: pa.Table, length: int, gram: int, fragments: int) -> tuple[int, Unit, Strings]:
    """A unit from its texts and the marks for it."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["fragment"] == -1)
    unit = Unit(head["texts"], head["sizes"], head["ids"], length, gram, fragments)
    return head["unit"], unit, unit.strings({r["fragment"]: r["marks"] for r in rows if r["fragment"] >= 0})


def _send(length: int, gram: int, fragments: int):
    """A unit's strings, dealt to their fragments."""

    def run(group: pa.Table) -> pa.Table:
        name, unit, s = _met(group, length, gram, fragments)
        data, rows = unit.data[spread(s.begin, s.size)], []
        ends = np.r_[0, np.cumsum(s.size)]
        for f in np.flatnonzero(np.diff(s.bounds)).tolist():
            lo, hi = s.bounds[f], s.bounds[f + 1]
            rows.append((f, name, s.place[lo:hi].tobytes(), packed(s.ids[lo:hi]), s.size[lo:hi].astype(np.uint16).tobytes(), packed(data[ends[lo] : ends[hi]])))
        return _table(_SENT, rows)

    return run


# ---- the transform ----------------------------------------------------------------------------


def suffix_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of some strings, each ended by a mark of its own smaller than any byte (the marks
    in the order of the strings). Suffixes that share `depth` bytes (all: None) may come in any order.
    Returns the order and, for each place, the text with marks as 0, bytes + 1."""
    total = int(sizes.sum()) + len(sizes)
    text = np.zeros(total, np.uint16)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(total, bool)
    inside[begin + sizes] = False
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text[inside] = data[at].astype(np.uint16) + 1
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(total)  # bytes before the mark
    key = np.zeros(total, np.uint64)
    for k in range(KEY):
        key <<= np.uint64(9)
        key[: total - k] |= np.where(left[: total - k] >= k, text[k:], np.uint16(0))
    width, longest = KEY, int(sizes.max()) if len(sizes) else 0
    while True:
        order = np.argsort(key)
        if depth is not None and width >= depth:
            return order, text
        sorted_key = key[order]
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        if width > longest:
            return np.argsort(rank * np.int64(total) + np.arange(total)), text  # equal suffixes: the strings' order
        following = np.zeros(total, np.int64)
        following[: total - width] = rank[width:] + 1
        key = rank * np.int64(total + 1) + np.where(left >= width, following, 0)
        width *= 2


def repeat_blocks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the strings (see suffix_order; a depth of `length` is enough), and the number of the block
    of each row: rows of a block share their first `length` bytes, neighbouring rows of different blocks do not.

    Breadth-first on the Burrows-Wheeler transform: intervals of rows that begin with one string are
    extended backward by each byte before them. An extension of a string of l bytes that ends at a row
    border not seen yet has found a common prefix of l there. Borders are thus found by increasing common
    prefix; after length - 1 the borders that are left are those of `length` or more.
    """
    order, text = suffix_order(data, starts, sizes, depth)
    n = len(order)
    before = text[order - 1]  # the transform; a string's first place follows a mark (order 0: the last mark)
    # rows that begin with a mark come first; rows before which a mark stands lead nowhere
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    lf = row[order - 1]  # as rows that share `depth` bytes come in any order, counting does not give it
    first_char = text[order]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    changes = np.r_[0, np.flatnonzero(first_char[1:] != first_char[:-1]) + 1, n]
    marks = len(sizes)
    lo = np.r_[np.arange(marks), changes[1:-1]] if n else changes[:0]
    hi = np.r_[np.arange(1, marks + 1), changes[2:]] if n else changes[:0]
    border[lo] = border[hi] = True
    owner = np.full(n, -1, np.int64)
    for _ in range(1, length):
        if not len(lo):
            break
        size = hi - lo
        rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(lo)), size)
        real = before[rows] > 0
        target, which = lf[rows[real]], which[real]
        if not len(target):
            break
        if len(target) > n // 16:  # dense: mark and scan; sparse: sort
            owner[:] = -1
            owner[target] = which
            target = np.flatnonzero(owner >= 0)
            which = owner[target]
        else:
            by = np.argsort(target)
            target, which = target[by], which[by]
        # an interval's rows with one byte before them go to neighbouring rows, in order
        opens = np.r_[True, (target[1:] != target[:-1] + 1) | (which[1:] != which[:-1]) | (first_char[target[1:]] != first_char[target[:-1]])]
        begin = np.flatnonzero(opens)
        new_lo, new_hi = target[begin], target[np.r_[begin[1:], len(target)] - 1] + 1
        fresh = ~border[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        border[hi] = True
    return order, np.cumsum(border[:-1]) - 1


def windows_of_smaller(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also start in a string with a smaller id, in order."""
    order, block = repeat_blocks(data, starts, sizes, length, length)
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    within = np.arange(len(string)) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    full = (sizes[string] - within)[order] >= length
    doc = np.where(full, ids[string[order]], _LAST)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    hit = np.sort(order[full & (doc > np.minimum.reduceat(doc, first)[block])])
    return string[hit], within[hit]


def _column(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in group[name].to_pylist()])


def _compare(length: int):
    """Of one fragment: the windows of each unit's strings that also start in a smaller document, as runs."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sizes, places = _column(group, "sizes", np.uint16).astype(np.int64), _column(group, "places", np.uint32)
        count = np.array([len(r["places"]) // 4 for r in rows])
        row_of = np.repeat(np.arange(len(rows)), count)
        total = np.bincount(row_of, sizes, len(rows)).astype(np.int64)
        ids = np.concatenate([unpacked(r["ids"], n, np.int64) for r, n in zip(rows, count.tolist(), strict=True)])
        data = np.concatenate([*(unpacked(r["strings"], n, np.uint8) for r, n in zip(rows, total.tolist(), strict=True)), np.zeros(row_width(sizes), np.uint8)])
        begin = np.cumsum(sizes) - sizes
        # equal windows have one place, so they stay together; a place is a part of its own if it must
        order = np.argsort(places, kind="stable")
        held = np.cumsum(sizes[order])
        opens = np.r_[True, np.diff(places[order]) != 0]
        before = np.r_[0, held[:-1]][opens]  # bytes before each place
        parts = np.split(order, np.flatnonzero(opens)[np.r_[False, np.diff(before // TRANSFORM_BYTES) > 0]])
        found = [_runs(data, begin[p], sizes[p], ids[p], p, length) for p in parts]
        string, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(string, kind="stable")
        string, low, high = string[by], low[by], high[by]
        bounds = np.searchsorted(row_of[string], np.arange(len(rows) + 1))
        first, out = np.cumsum(count) - count, []
        for i, r in enumerate(rows):
            mine = slice(bounds[i], bounds[i + 1])
            if bounds[i] < bounds[i + 1]:
                out.append((r["unit"], r["fragment"], (string[mine] - first[i]).astype(np.uint32).tobytes(), low[mine].astype(np.uint16).tobytes(), high[mine].astype(np.uint16).tobytes()))
        del data, rows
        give_back()
        return _table(_FOUND, out)

    return run


def _runs(data, begin, sizes, ids, names, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) of runs of repeated windows. Equal strings of several units go into
    the transform once, under their smallest id; a larger id under which one is held repeats all its windows."""
    one, kind = distinct_strings(data, begin, sizes)
    low = np.full(len(one), _LAST)
    np.minimum.at(low, kind, ids)
    string, offset = windows_of_smaller(data, begin[one], sizes[one], low, length)
    new = np.r_[True, (np.diff(string) != 0) | (np.diff(offset) != 1)][: len(string)]
    at = np.flatnonzero(new)
    string, first, last = string[at], offset[at], offset[np.r_[at[1:], len(offset)] - 1] if len(at) else at
    smallest = ids == low[kind]
    later = np.flatnonzero(~smallest)
    # runs of each kind, for every holder of it that has the smallest id
    holders = np.flatnonzero(smallest)
    lo, n = np.searchsorted(string, kind[holders]), np.bincount(string, minlength=len(one))[kind[holders]]
    pick = spread(lo, n)
    return np.r_[names[later], names[np.repeat(holders, n)]], np.r_[np.zeros(len(later), np.int64), first[pick]], np.r_[sizes[later] - length, last[pick]]


def _finish(length: int, gram: int, fragments: int):
    """A unit's documents without the bytes that the runs found for its strings cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, unit, s = _met(left, length, gram, fragments)
        # under a larger id than the smallest one in this unit, all of a string's windows repeat
        later = s.holder_ids > s.ids[s.holder_kind]
        opens, closes = [s.holder_begin[later]], [(s.holder_begin + s.size[s.holder_kind])[later]]
        answers = sorted(right.to_pylist(), key=lambda r: r["fragment"])
        if answers:
            string = np.concatenate([np.frombuffer(r["string"], np.uint32).astype(np.int64) + s.bounds[r["fragment"]] for r in answers])
            low, high = (np.concatenate([np.frombuffer(r[x], np.uint16).astype(np.int64) for r in answers]) for x in ("begin", "end"))
            at = np.searchsorted(string, s.holder_kind)
            n = np.searchsorted(string, s.holder_kind, "right") - at
            pick, begin = spread(at, n), np.repeat(s.holder_begin, n)
            opens.append(begin + low[pick])
            closes.append(begin + high[pick] + length)
        size = len(unit.data)
        edge = np.bincount(np.concatenate(opens), minlength=size + 1) - np.bincount(np.concatenate(closes), minlength=size + 1)
        removed = np.cumsum(edge[:-1]) > 0
        total = np.r_[0, np.cumsum(removed)]
        out = []
        for i, (lo, hi) in enumerate(zip(unit.offsets[:-1].tolist(), unit.offsets[1:].tolist(), strict=True)):
            n, part = int(total[hi] - total[lo]), removed[lo:hi]
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()) if n else 0
            kept = (unit.data[lo:hi][~part] if n else unit.data[lo:hi]).tobytes()
            out.append((None if unit.null[i] else int(unit.ids[i]), hi - lo, n, spans, hashlib.sha256(kept).hexdigest()))
        return _table(_RESULT, out)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit_bytes: int = UNIT_BYTES, hot: int = HOT_UNITS) -> DataFrame:
    """RESULT, one row per row of docs(doc_id, text): each byte goes that is covered by a string of `length`
    bytes that also starts in a document with a smaller doc_id, judged on the input.

    Texts are UTF-8 bytes (null: empty) of any length; strings never cross documents; documents with equal ids
    (repeated rows) never remove from each other; a null id counts as larger than all others. An empty table
    gives none. Other columns are ignored.

    Texts are stored once, packed into units of up to unit_bytes (a longer text is one). Hashes only place
    what may be equal: equal windows have one minimiser, so its hash names the fragment where they meet, and
    segments whose place no other document has stay out. Places that more than `hot` units have are split by
    the bytes beside the gram. All that meets is decided on a Burrows-Wheeler transform of the strings, whose
    common prefixes below `length` are expanded breadth-first; strings equal byte for byte are held once in a
    unit and once in a transform, for all documents that have them.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = total_bytes(rows, "text")
    fragments = fragments_for(size, FRAGMENT_BYTES)
    args = length, gram, fragments
    units = cut(rows.mapInArrow(_pack(unit_bytes), UNIT_DDL), "none")  # texts are compressed
    told = dealt(units.mapInArrow(_tell(*args), TOLD_DDL), "fragment", size, FRAGMENT_BYTES)
    marked = dealt(units.unionByName(told.groupBy("fragment").applyInArrow(_mark(hot), UNIT_DDL)), "unit", size)
    sent = dealt(marked.groupBy("unit").applyInArrow(_send(*args), SENT_DDL), "fragment", size, FRAGMENT_BYTES)
    found = dealt(sent.groupBy("fragment").applyInArrow(_compare(length), FOUND_DDL), "unit", size)
    return marked.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(_finish(*args), RESULT)
