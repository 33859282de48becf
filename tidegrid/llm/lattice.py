"""Text probability under a subword unigram model, all segmentations summed, beside a smoothed word baseline."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import BYTE_CODES, binary_parts, block_slices, dealt, fragments_for, give_back, mix, prepare, span_hashes, total_bytes, words

#: The vocabulary where neither the caller nor the session's VOCABULARY_SETTING names one; read by the driver only.
VOCABULARY, VOCABULARY_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.tidegrid.vocabulary"
#: Text bytes that share one table of distinct words, and bytes of text for each fragment of the vocabulary.
UNIT_BYTES, FRAGMENT_BYTES = 8 << 20, 48 << 20
#: A piece's weight before learning falls with its rank as 1 / (rank + RANK_SHIFT).
RANK_SHIFT = 3.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
LN10 = float(np.log(10.0))


class Pieces:
    """Byte strings with log-probabilities; every single byte is one, so that any word has a segmentation."""

    def __init__(self, strings: list[bytes], weights: np.ndarray):
        self.strings, self.log_p = strings, np.log(weights / weights.sum())
        self.longest = max(map(len, strings))
        keys = np.array([self.key(s) for s in strings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def key(s: bytes) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for b in s:
            h = h * _BASE + BYTE_CODES[b]
        return mix(h)[0]

    @classmethod
    def from_model(cls, path: str = VOCABULARY) -> "Pieces":
        """The vocabulary of a sentencepiece model: its scores rank the pieces; a word's start is a blank."""
        import sentencepiece

        if not os.path.exists(path):
            raise FileNotFoundError(f"no sentencepiece model at {path}: pass the path of one to score(vocabulary=...), or set VOCABULARY_SETTING")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            text = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").lower().encode()
            if text and (b" " not in text[1:]):
                weight = 1.0 / (max(0.0, -model.get_score(i)) + RANK_SHIFT) if not model.is_byte(i) else 1e-6
                ranked[text] = ranked.get(text, 0.0) + weight
        for b in range(256):
            ranked.setdefault(bytes([b]), 1e-6)
        strings = sorted(ranked)
        return cls(strings, np.array([ranked[s] for s in strings]))

    def learned(self, expected: np.ndarray, texts: int) -> tuple["Pieces", float]:
        """Pieces with probabilities from expected counts and the vocabulary's own as a prior of one count a
        piece, and the log-probability of a text's end."""
        prior = np.exp(self.log_p) * len(self.strings)
        weights = expected + prior
        out = Pieces.__new__(Pieces)
        out.__dict__ |= self.__dict__
        total = weights.sum() + texts + 1.0
        out.log_p = np.log(weights / total)
        return out, float(np.log((texts + 1.0) / total))

    def _edges(self, matrix: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) to the rows that have a piece there, and its number; rows are words of one length."""
        n, length = matrix.shape
        hashes = np.zeros((n, length), np.uint64)
        out = {}
        for size in range(1, min(length, self.longest) + 1):
            hashes = hashes[:, : length - size + 1] * _BASE + BYTE_CODES[matrix[:, size - 1 :]]
            mixed = mix(hashes)
            row, start = np.nonzero(self.maybe[(mixed >> np.uint64(44)).astype(np.int64)])
            found = mixed[row, start]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            real = self.keys[at] == found
            row, start, number = row[real], start[real], self.number[at[real]]
            by = np.argsort(start, kind="stable")
            row, start, number = row[by], start[by], number[by]
            bounds = np.searchsorted(start, np.arange(length - size + 2))
            for s in range(length - size + 1):
                if bounds[s] < bounds[s + 1]:
                    out[s, s + size] = row[bounds[s] : bounds[s + 1]], number[bounds[s] : bounds[s + 1]]
        return out

    def forward(self, matrix: np.ndarray, edges=None) -> np.ndarray:
        """Log of the summed weight of all ways to reach each place of each word."""
        n, length = matrix.shape
        edges = self._edges(matrix) if edges is None else edges
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                if (edge := edges.get((start, end))) is not None:
                    row, number = edge
                    alpha[end, row] = np.logaddexp(alpha[end, row], alpha[start, row] + self.log_p[number])
        return alpha

    def expected(self, matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations of the words, each word `weight` times."""
        edges = self._edges(matrix)
        alpha = self.forward(matrix, edges)
        n, length = matrix.shape
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0.0
        out = np.zeros(len(self.strings))
        for start in range(length - 1, -1, -1):
            for end in range(start + 1, min(length, start + self.longest) + 1):
                if (edge := edges.get((start, end))) is not None:
                    row, number = edge
                    through = self.log_p[number] + beta[end, row]
                    beta[start, row] = np.logaddexp(beta[start, row], through)
                    out += np.bincount(number, weight[row] * np.exp(alpha[start, row] + through - alpha[length, row]), len(out))
        return out


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cells: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as matrices, a blank in front, all of one length and of bounded size: (their numbers, the matrix)."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    bounds = np.r_[0, np.flatnonzero(np.diff(size[order])) + 1, len(order)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        step = max(1, cells // (int(size[order[lo]]) + 1)) if hi > lo else 1
        for at in range(lo, hi, step):
            which = order[at : min(at + step, hi)]
            matrix = np.full((len(which), int(size[which[0]]) + 1), 32, np.uint8)
            matrix[:, 1:] = data[starts[which][:, None] + np.arange(matrix.shape[1] - 1)]
            yield which, matrix


class Unit:
    """Distinct words of some texts: hashes, bytes, and how often each text has each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        hashes, parts, spans, firsts, base, done = [], [], [], [0], 0, 0
        for lo, hi in block_slices(offsets):
            low, starts, ends, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            hashes.append(span_hashes(low, starts, ends))
            spans.append((starts + base, ends + base))
            firsts += (first[1:] + done).tolist()
            done += len(starts)
            parts.append(low)
            base += len(low)
        self.data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.concatenate([s for s, _ in spans]) if spans else np.zeros(0, np.int64)
        ends = np.concatenate([e for _, e in spans]) if spans else np.zeros(0, np.int64)
        self.counts = np.diff(np.array(firsts, np.int64))
        self.hashes, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def spelled(self, which: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the given words laid end to end, and their lengths."""
        size = self.ends[which] - self.starts[which]
        at = np.repeat(self.starts[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.data[at].tobytes(), size.astype(np.uint32)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Unit]]:
    """Consecutive rows (doc_id, text, train) of up to UNIT_BYTES, with a number no other unit has."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = binary_parts(batch.column(1))
        for lo, hi in block_slices(offsets, UNIT_BYTES):
            yield (task << 24) + n, batch.slice(lo, hi - lo), Unit(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n += 1
    give_back()


_VOCAB = pa.schema([("fragment", pa.int32()), ("spelling", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64())])
_PAIRS = pa.schema([("fragment", pa.int32()), ("unit", pa.int64()), ("spelling", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary()), ("pair_sizes", pa.binary()), ("pair_words", pa.binary()), ("pair_counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("held_out", pa.binary()), ("tokens", pa.binary())])
_SUMS = pa.schema([("unit", pa.int64()), ("texts", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("model", pa.binary()), ("ids", pa.list_(pa.int64())), ("held_out", pa.binary()), ("tokens", pa.binary())])
VOCAB_DDL = "fragment int, spelling binary, sizes binary, counts binary, texts long"
PAIRS_DDL = "fragment int, unit long, spelling binary, sizes binary, counts binary, texts binary, pair_sizes binary, pair_words binary, pair_counts binary, ids array<long>, held_out binary, tokens binary"
SUMS_DDL = "unit long, texts binary, base binary, known binary, model binary, ids array<long>, held_out binary, tokens binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _spread(unit: Unit, fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    home = (unit.hashes % np.uint64(fragments)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(fragments + 1))
    for f in np.flatnonzero(np.diff(bounds)).tolist():
        yield f, order[bounds[f] : bounds[f + 1]]


def _vocabulary(fragments: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, unit in _units(batches):
            train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(unit.word[train[unit.text]], minlength=len(unit.hashes))
            out = {k: [] for k in _VOCAB.names}
            spread = dict(_spread(unit, fragments))
            spread.setdefault(0, np.zeros(0, np.int64))  # the number of texts travels with fragment 0
            for f, which in spread.items():
                which = which[counts[which] > 0]
                texts = int(train.sum()) if f == 0 else 0
                if len(which) or texts:
                    spelling, sizes = unit.spelled(which)
                    for k, v in zip(_VOCAB.names, (f, spelling, sizes.tobytes(), counts[which].astype(np.uint32).tobytes(), texts), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_VOCAB)

    return run


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in group[column].to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _distinct(group: pa.Table):
    """Distinct words of a fragment: (data, starts, ends, counts) and each entry's number."""
    data, sizes = _joined(group, "spelling", np.uint8), _joined(group, "sizes", np.uint32).astype(np.int64)
    counts = _joined(group, "counts", np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashes = np.empty(len(sizes), np.uint64)
    # a stretch of words at a time, so that the prefix sums stay small
    bounds = np.r_[0, ends]
    for lo, hi in block_slices(bounds):
        hashes[lo:hi] = span_hashes(data[bounds[lo] : bounds[hi]], starts[lo:hi] - bounds[lo], ends[lo:hi] - bounds[lo])
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return data, starts[first], ends[first], np.bincount(number, counts, len(first)).astype(np.int64), number


def _learn(pieces):
    def run(group: pa.Table) -> pa.Table:
        data, starts, ends, counts, _ = _distinct(group)
        used = np.zeros(len(pieces.value.strings))
        for which, matrix in by_length(data, starts, ends):
            used += pieces.value.expected(matrix, counts[which].astype(np.float64))
        some = np.flatnonzero(used)
        extra = [int(counts.sum()), len(counts), int(sum(group["texts"].to_pylist()))]
        return pa.table({"piece": np.r_[some, [-1, -2, -3]].astype(np.int32), "used": np.r_[used[some], extra].astype(np.float64)})

    return run


def _pairs(fragments: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows, unit in _units(batches):
            train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(unit.word[train[unit.text]], minlength=len(unit.hashes))
            n_words = max(1, len(unit.hashes))
            home = (unit.hashes % np.uint64(fragments)).astype(np.int64)
            local = np.empty(len(unit.hashes), np.int64)
            spread = dict(_spread(unit, fragments))
            spread.setdefault(name % fragments, np.zeros(0, np.int64))
            for which in spread.values():
                local[which] = np.arange(len(which))
            pair, times = np.unique(unit.text * n_words + unit.word, return_counts=True)
            text, word = pair // n_words, pair % n_words
            order = np.argsort(home[word], kind="stable")
            text, word, times = text[order], word[order], times[order]
            bounds = np.searchsorted(home[word], np.arange(fragments + 1))
            keeper = name % fragments
            for f, which in spread.items():
                if not len(which) and f != keeper:
                    continue
                lo, hi = bounds[f], bounds[f + 1]
                texts, sizes = np.unique(text[lo:hi], return_counts=True)
                spelling, lengths = unit.spelled(which)
                row = {"fragment": f, "unit": name, "spelling": spelling, "sizes": lengths.tobytes(), "counts": counts[which].astype(np.uint32).tobytes(),
                       "texts": texts.astype(np.uint32).tobytes(), "pair_sizes": sizes.astype(np.uint32).tobytes(),
                       "pair_words": local[word[lo:hi]].astype(np.uint16 if len(which) <= 65536 else np.uint32).tobytes(), "pair_counts": times[lo:hi].astype(np.uint32 if len(times) and times.max() > 65535 else np.uint16).tobytes(),
                       "ids": rows.column(0).to_pylist() if f == keeper else None, "held_out": (~train).tobytes() if f == keeper else None, "tokens": (unit.counts + 1).tobytes() if f == keeper else None}
                yield pa.RecordBatch.from_pylist([row], schema=_PAIRS)

    return run


def _sums(pieces):
    def run(group: pa.Table) -> pa.Table:
        data, starts, ends, counts, number = _distinct(group)
        model = np.empty(len(starts))
        for which, matrix in by_length(data, starts, ends):
            model[which] = pieces.value.forward(matrix)[-1]
        base = np.log10(counts + 1.0)
        out, at = [], 0
        for row in group.to_pylist():
            n_words = len(row["sizes"]) // 4
            mine = number[at : at + n_words]
            at += n_words
            sizes = np.frombuffer(row["pair_sizes"], np.uint32).astype(np.int64)
            n = int(sizes.sum())
            word = mine[np.frombuffer(row["pair_words"], np.uint16 if len(row["pair_words"]) == 2 * n else np.uint32).astype(np.int64)]
            times = np.frombuffer(row["pair_counts"], np.uint16 if len(row["pair_counts"]) == 2 * n else np.uint32).astype(np.float64)
            first = np.cumsum(sizes) - sizes
            total = (lambda x: np.add.reduceat(x, first) if n else np.zeros(0))
            out.append({"unit": row["unit"], "texts": row["texts"], "base": total(times * base[word]).tobytes(), "known": total(times * (counts[word] > 0)).astype(np.uint32).tobytes(), "model": total(times * model[word]).tobytes(), "ids": row["ids"], "held_out": row["held_out"], "tokens": row["tokens"]})
        return pa.Table.from_pylist(out, schema=_SUMS)

    return run


def _scores(all_tokens: int, distinct: int, train_texts: int, end_log: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["tokens"] is not None)
        tokens = np.frombuffer(head["tokens"], np.int64)
        base, known, model = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        for r in rows:
            at = np.frombuffer(r["texts"], np.uint32)
            base[at] += np.frombuffer(r["base"], np.float64)
            known[at] += np.frombuffer(r["known"], np.uint32)
            model[at] += np.frombuffer(r["model"], np.float64)
        base += np.log10(train_texts + 1.0) - tokens * np.log10(all_tokens + distinct + 1.0)
        known += int(train_texts > 0)
        return pa.table({
            "doc_id": pa.array(head["ids"], pa.int64()), "held_out": np.frombuffer(head["held_out"], bool), "n_tokens": tokens, "n_known": known,
            "train_tokens": np.full(len(tokens), all_tokens), "base_score": base, "score": (model + end_log) / LN10,
        })

    return run


def score(docs: DataFrame, train: Column, vocabulary: str | None = None) -> DataFrame:
    """SCORES, one row per row of docs(doc_id, text), learning from the rows that meet `train`.

    The text is its words (A-Z lower-cased, runs without white space), then one end. base_score: log10 under
    add-one smoothed word counts. score: log10 of the text's marginal probability under a subword unigram
    model: the vocabulary's ranks give first weights, expected piece counts over all segmentations of every
    training word (one EM step) the final ones; a text's probability sums over all segmentations by a
    log-space forward recursion. Pieces never cross a word's start, so words are scored once each.

    The word table is spread over hash fragments that grow in number with the text; nothing is broadcast but
    the vocabulary's pieces. Null texts are empty (one token); a null `train` counts as false; repeated rows
    and null keys stay; empty tables give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = total_bytes(rows, "text")
    fragments = fragments_for(size, FRAGMENT_BYTES)
    first = spark.sparkContext.broadcast(Pieces.from_model(vocabulary or spark.conf.get(VOCABULARY_SETTING, VOCABULARY)))
    vocab = rows.mapInArrow(_vocabulary(fragments), VOCAB_DDL)
    learned = dealt(vocab, "fragment", size, FRAGMENT_BYTES).groupBy("fragment").applyInArrow(_learn(first), "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used"))
    used = {r.piece: r.used for r in learned.collect()}  # a number for each piece of the vocabulary at most
    n_words, n_distinct, n_texts = (int(used.pop(k, 0)) for k in (-1, -2, -3))
    expected = np.zeros(len(first.value.strings))
    expected[list(used)] = list(used.values())
    pieces, end_log = first.value.learned(expected, n_texts)
    final = spark.sparkContext.broadcast(pieces)
    sums = dealt(rows.mapInArrow(_pairs(fragments), PAIRS_DDL), "fragment", size, FRAGMENT_BYTES).groupBy("fragment").applyInArrow(_sums(final), SUMS_DDL)
    return dealt(sums, "unit", size).groupBy("unit").applyInArrow(_scores(n_words + n_texts, n_distinct + (n_texts > 0), n_texts, end_log), SCORES)
