"""Toxicity scores of text restored from leetspeak, spacing and repetition by a noisy channel."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import cut, dealt, give_back, pin, prepare, total_bytes

#: Rows that a sample for looking at has at most: toxic ones, and twice as many others. The queries learn from all rows.
TOXIC_ROWS = 1500
THRESHOLD = 0.7
#: A word weighs if it, or a beginning of it, has so many contexts in toxic rows and so high a log ratio; a text's
#: evidence is the sum of so many of its heaviest words, so that long texts do not gather it from chance.
CONTEXTS, LEAST_WEIGHT, HEAVIEST = 8, 4.0, 4
#: Decimals of a weight, so that evidence takes few different values however many texts there are.
DIGITS = 3
#: Kinds of counts, and how many of them a worker holds before it hands them on.
TEXTS, CHARS, PAIR, CLEAN = range(4)
TALLY = 400_000
#: Characters that are restored at once; a longer token or row of letters goes in parts that overlap by PART_STEP less.
PART, PART_STEP = 64, 48

#: What letters a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = "._-*~^'`,/\\:;​­"
_EDGE = "\"'.,;:?()[]{}<>«»“”„-_*~^%#&=/\\"
_PIECE = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_ODD = re.compile(r"[" + re.escape("".join(LEET) + SEPARATORS) + "]")
_DECOR = re.compile(r"([^\w\s])\1+$")
_SIGN = r"(?:[^\W_]|[@$!|€£])"
_SPACED = re.compile(rf"(?<!\S){_SIGN}+(?:(?<!\S{_SIGN})[ .*_-]{{1,2}}{_SIGN}(?!{_SIGN})){{2,}}")
#: Channel costs (natural log): a letter stood for by a sign, a sign put in that could
#: stand for a letter, another sign put in, a letter repeated, a digit meant as one.
COST_LEET, COST_SIGN, COST_NOISE, COST_REPEAT, COST_KEEP_SIGN = 1.0, 4.0, 2.0, 1.0, 8.0


@dataclass
class CharModel:
    """Character trigrams with add-k smoothing and word bounds."""

    counts: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, float] = field(default_factory=dict)
    size: int = 64
    k: float = 0.05

    @classmethod
    def of(cls, three: dict[str, float]) -> "CharModel":
        two: dict[str, float] = {}
        for t, n in three.items():
            two[t[:2]] = two.get(t[:2], 0) + n
        return cls(three, two, len({t[2] for t in three} - {"\x03"}) + 2)

    def cost(self, before: str, c: str) -> float:
        return -math.log((self.counts.get(before + c, 0) + self.k) / (self.pairs.get(before, 0) + self.k * self.size))


def trigrams(words: Counter) -> Counter:
    """Character trigrams of words with their bounds, each word as often as it is counted."""
    three: Counter = Counter()
    for word, n in words.items():
        w = f"\x02\x02{word}\x03"
        for i in range(2, len(w)):
            three[w[i - 2 : i + 1]] += n
    return three


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, and at what cost; the empty string drops it."""
    out = []
    for i, c in enumerate(token):
        if c in LEET:
            row = [(x, COST_LEET) for x in LEET[c]] + [("", COST_SIGN)]
            if c.isdigit():
                row.append((c, COST_KEEP_SIGN))
        elif c.isalpha():
            row = [(c, 0.0)]
            if i and token[i - 1] == c:
                row.append(("", COST_REPEAT))
        else:
            row = [("", COST_NOISE if c not in SEPARATORS else 0.5)]
        out.append(row)
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest intended word (Viterbi over the lattice; the state is the last two letters meant)."""
    best: dict[str, tuple[float, str]] = {"\x02\x02": (0.0, "")}
    for row in lattice(token):
        step: dict[str, tuple[float, str]] = {}
        for state, (cost, word) in best.items():
            for c, extra in row:
                total = cost + extra + (model.cost(state, c) if c else 0.0)
                to = state[1] + c if c else state
                if to not in step or (total, word + c) < step[to]:
                    step[to] = (total, word + c)
        best = step
    return min((cost + model.cost(state, "\x03"), word) for state, (cost, word) in best.items())[1]


def suspicious(token: str) -> str | None:
    """The part of a token to restore, or None if it can only stand for itself: without letters, or of fewer than
    three characters, which no word that weighs has."""
    core = _DECOR.sub("", token.strip(_EDGE)).strip(_EDGE)
    if len(core) < 3 or not any(c.isalpha() for c in core):
        return None
    return core if (_ODD.search(core.rstrip("!")) or _TRIPLE.search(core)) else None


def parts(letters: str) -> Iterator[str]:
    """Overlapping parts of a long row of characters: a word of up to PART - PART_STEP of them lies in one."""
    for i in range(0, max(1, len(letters) - (PART - PART_STEP)), PART_STEP):
        yield letters[i : i + PART]


#: Lengths of the beginnings that a word is looked up by.
STEMS = 4, 5, 6


def stems(word: str) -> list[str]:
    """What a word is looked up by: itself and its longer beginnings."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


@dataclass
class ToxicModel:
    weights: dict[str, float]
    chars: CharModel
    slope: float = 1.0
    level: float = -2.0
    _seen: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}

    def _weigh(self, word: str) -> tuple[str, float]:
        return word, max((self.weights.get(s, 0.0) for s in stems(word)), default=0.0)

    def of_token(self, token: str) -> tuple[tuple[str, float], ...]:
        hit = self._seen.get(token)
        if hit is None:
            if len(self._seen) > 60_000:
                self._seen.clear()
            found = [self._weigh(p) for p in _PIECE.findall(token)]
            if (core := suspicious(token)) and len(core) <= PART:
                found.append(self._weigh(restore(core, self.chars)))
            elif core:  # such a run has lost its word bounds
                found += [x for part in parts(core) for x in self.inside(restore(part, self.chars))]
            hit = tuple(x for x in found if x[1] > 0)
            if len(token) <= PART:
                self._seen[token] = hit
        return hit

    def evidence(self, text: str) -> float:
        """The HEAVIEST distinct words' weights, summed, over the whole text and what it restores to."""
        low = text.lower()
        heavy: dict[str, float] = {}
        for token in set(low.split()):
            for word, w in self.of_token(token):
                heavy[word] = w
        for m in _SPACED.finditer(low):
            letters = re.sub(r"[\s.*_-]+", "", m[0])
            for part in parts(letters):
                for word, w in self.inside(restore(part, self.chars)):
                    heavy[word] = w
        return round(sum(sorted(heavy.values(), reverse=True)[:HEAVIEST]), DIGITS)

    def inside(self, letters: str) -> Iterator[tuple[str, float]]:
        """Known words inside letters whose word bounds are lost."""
        for i in range(len(letters)):
            for k in range(4, min(20, len(letters) - i) + 1):
                if w := self.weights.get(letters[i : i + k]):
                    yield letters[i : i + k], w

    def score(self, text: str | None) -> float:
        z = self.level + self.slope * (self.evidence(text) if text else 0.0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


class Tally:
    """What distinct texts add to the counts that a model is made of: of toxic texts the pairs of a word and the word
    before it, of the others how many have a stem, of both the words, and how many texts there are."""

    def __init__(self):
        self.texts = [0, 0]
        self.pairs: set[tuple[str, str]] = set()
        self.clean: dict[int, Counter] = {k: Counter() for k in (0, *STEMS)}  # by a beginning's length, 0: whole words
        self.words = Counter(), Counter()

    def add(self, text: str, toxic: int) -> None:
        found = _PIECE.findall(text.lower())
        self.texts[toxic] += 1
        self.words[toxic].update(found)
        if toxic:
            self.pairs.update(zip(found, ["", *found], strict=False))
            return
        once = set(found)
        self.clean[0].update(once)
        for k in STEMS:
            once = [w for w in once if len(w) > k]
            self.clean[k].update({w[:k] for w in once})

    def __len__(self) -> int:
        return len(self.pairs) + sum(map(len, self.clean.values())) + sum(map(len, self.words))

    def columns(self) -> Iterator[tuple[int, list[str], list[str], list[int]]]:
        """(kind, keys, places, numbers), to be added up by the first three."""
        for y in (0, 1):
            three = trigrams(self.words[y])
            yield TEXTS, [""], [str(y)], [self.texts[y]]
            yield CHARS, list(three), [str(y)] * len(three), list(three.values())
        yield PAIR, [w for w, _ in self.pairs], [b for _, b in self.pairs], [1] * len(self.pairs)
        for k, n in self.clean.items():
            yield CLEAN, [f"{s}*" for s in n] if k else list(n), [""] * len(n), list(n.values())


def _model(texts: tuple[int, int], chars: tuple[dict[str, int], dict[str, int]], stems_found: Iterable[tuple[str, int, int]]) -> ToxicModel:
    """A model, its slope and level still open, from (stem, contexts in toxic texts, other texts with it).

    A word counts by the different words before it in toxic rows, so that what many copies of one text
    repeat counts once, a beginning by the different words that have it; the weight is the log ratio of that
    to the other rows that have it. The character model takes the others' words at most as often as toxic ones.
    """
    other, toxic = texts
    weights = {}
    for s, n, clean in stems_found:
        weight = math.log((min(n, toxic) + 0.5) / (toxic + 1)) - math.log((clean + 0.5) / (other + 1))
        if weight >= LEAST_WEIGHT:
            weights[s] = round(weight, DIGITS)
    share = min(1.0, toxic / other) if other else 1.0
    three = {t: chars[1].get(t, 0) + share * chars[0].get(t, 0) for t in sorted(chars[0].keys() | chars[1].keys())}
    return ToxicModel(weights, CharModel.of(three))


def _levelled(model: ToxicModel, seen: Iterable[tuple[float, int, int]]) -> ToxicModel:
    """The model with slope and level from (evidence, toxic, number of texts)."""
    x, y, n = np.array(sorted(seen), np.float64).reshape(-1, 3).T
    if 0 < (n * y).sum() < n.sum():
        model.slope, model.level = _logistic(x, y, n)
    return model


def fit(rows: list[tuple[str, int]]) -> ToxicModel:
    """Model from (text, toxic) rows, in memory; equal texts count once, toxic if one of them is. `learn` does the same to tables."""
    rows = sorted({t: y for t, y in sorted(rows) if t}.items())
    tally = Tally()
    for t, y in rows:
        tally.add(t, y)
    contexts = Counter(word for word, _ in tally.pairs)
    contexts.update(s for word in set(contexts) for s in stems(word)[1:])
    clean = Counter(dict(kv for kind, keys, _, numbers in tally.columns() if kind == CLEAN for kv in zip(keys, numbers, strict=True)))
    model = _model(tuple(tally.texts), tuple(trigrams(w) for w in tally.words), [(s, n, clean[s]) for s, n in contexts.items() if n >= CONTEXTS])
    _levelled(model, [(*k, n) for k, n in Counter((model.evidence(t), y) for t, y in rows).items()])
    model._seen.clear()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and level by Newton steps, n rows for each x and y; the slope is held by a ridge so that separable rows converge."""
    a, b = 0.5, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-9)
        g = np.array([(n * x * (y - p)).sum() - ridge * a, (n * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def agreed(labels: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, toxic) of labels; contradictory and null ones are left out."""
    lab = labels.where("doc_id is not null and toxic in (0, 1)")
    if train is not None:
        lab = lab.where(train)
    return lab.groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("toxic")).where("lo = toxic").select("doc_id", "toxic")


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column | None = None, toxic_rows: int = TOXIC_ROWS) -> list[tuple[str, int]]:
    """At most 3 x toxic_rows labelled texts for `fit`, chosen by a hash of doc_id; contradictory or null labels are
    left out. For looking at small models only: the queries learn from all rows, see `learn`."""
    lab = agreed(labels, train).withColumn("h", F.xxhash64("doc_id"))
    ids = [(r[0], r[1]) for y, n in ((1, toxic_rows), (0, 2 * toxic_rows)) for r in lab.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(n).select("doc_id", "toxic").collect()]
    if not ids:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))  # 3 x toxic_rows rows at most
    picked = docs.select("doc_id", "text").where("text is not null").join(few, "doc_id")
    texts = picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in texts.collect()]


def digest(text: str) -> Column:
    """What tells texts apart; null for null and empty ones."""
    return F.when(F.col(text) != "", F.unhex(F.sha2(F.col(text).cast("binary"), 256)))


def _tallied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(t: Tally) -> Iterator[pa.RecordBatch]:
        for kind, keys, places, numbers in t.columns():
            columns = pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(places, pa.string()), pa.array(numbers, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), names=["kind", "key", "place", "n"])

    tally = Tally()
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            tally.add(text.as_py(), toxic)
            if len(tally) > TALLY:
                yield from told(tally)
                tally = Tally()
    yield from told(tally)
    give_back()


def learn(docs: DataFrame, lab: DataFrame, train: Column | None = None) -> ToxicModel:
    """The model of all texts of docs that lab(doc_id, toxic) names, its slope and level still open. Equal texts count
    once, toxic if one of them is.

    Counted where the texts are; to the driver come the weights of words that weigh and the character trigrams,
    which a vocabulary and an alphabet bound.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest("text").alias("digest")).where("digest is not null")
    if train is not None:
        rows = rows.where(train)
    # one row names each text, so that copies do not meet in a task and texts move once
    named = rows.select("doc_id", "digest").join(lab, "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    named = named.withColumnRenamed("digest", "named").hint("shuffle_hash")
    texts = dealt(rows, "doc_id", total_bytes(docs, "text")).join(named, "doc_id").where("digest = named")
    texts = texts.dropDuplicates(["doc_id", "digest"]).select("text", "toxic")
    counted = texts.mapInArrow(_tallied, "kind int, key string, place string, n long")
    counted = cut(counted.groupBy("kind", "key", "place").agg(F.sum("n").alias("n")))
    of = lambda kind: counted.where(F.col("kind") == kind)
    number, chars = [0, 0], ({}, {})
    for r in of(TEXTS).collect():
        number[int(r.place)] = r.n
    for r in of(CHARS).collect():
        chars[int(r.place)][r.key] = r.n
    words = of(PAIR).groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
    longer = F.filter(F.array(*(F.when(F.length("key") > k, F.concat(F.substring("key", 1, k), F.lit("*"))) for k in STEMS)), lambda s: s.isNotNull())
    begins = words.select(F.explode(longer).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
    found = words.unionByName(begins).where(F.col("contexts") >= CONTEXTS).join(of(CLEAN).select("key", "n"), "key", "left").na.fill(0, ["n"])
    ratio = F.log((F.least("contexts", F.lit(number[1])) + 0.5) / (number[1] + 1)) - F.log((F.col("n") + 0.5) / (number[0] + 1))
    heavy = found.where(ratio > LEAST_WEIGHT - 1e-6)  # the driver has the last word
    return _model(tuple(number), chars, [(r.key, r.contexts, r.n) for r in heavy.orderBy("key").collect()])


def evidence(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all: None) with tox_evidence, from whole texts of any length; null and empty ones have 0."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary: words with CONTEXTS contexts and LEAST_WEIGHT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = pa.array([m.evidence(t) if (t := x.as_py()) else 0.0 for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), x], names=[*kept, "tox_evidence"])
        m._seen.clear()
        give_back()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.mapInArrow(run, ", ".join([*fields, "tox_evidence double"]))


def _scored(seen: DataFrame, model: ToxicModel, threshold: float) -> DataFrame:
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(model.level) + F.lit(model.slope) * F.col("tox_evidence")))
    seen = seen.withColumn("tox_score", 1 / (1 + F.exp(-z))).drop("tox_evidence")
    return seen.withColumn("tox_predicted", (F.col("tox_score") >= threshold).cast("int"))


_OWN = "tox_evidence", "tox_digest", "tox_score", "tox_predicted"


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all: None) with tox_score (0 to 1) and tox_predicted (1 if tox_score >= threshold).

    Every row gets a score from its whole text, of any length; null and empty texts get the model's base score.
    Repeated rows score alike, null keys stay, an empty table gives none. Columns of docs with these names (and
    tox_evidence, tox_digest) are replaced. Texts that are not kept do not come back from the workers.
    """
    return _scored(evidence(docs.drop(*_OWN), model, keep), model, threshold)


def judged(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """`score` by the model of all of docs that labels (where `train`, a condition on doc_id, holds) name.

    Each text is weighed once: its evidence is stored, slope and level come from how many training texts have
    which evidence, and the stored rows are scored by them.
    """
    docs, lab = docs.drop(*_OWN), pin(agreed(labels, train))
    model = learn(docs, lab, train)
    kept = [c for c in docs.columns if keep is None or c in keep]
    seen = cut(evidence(docs.withColumn("tox_digest", digest("text")), model, [*kept, "tox_digest"]))
    thin = seen.select("doc_id", "tox_digest", "tox_evidence").where("tox_digest is not null").join(lab, "doc_id")
    each = thin.groupBy("tox_digest").agg(F.max("tox_evidence").alias("x"), F.max("toxic").alias("y"))
    _levelled(model, [(r.x, r.y, r.n) for r in each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()])
    return _scored(seen.drop("tox_digest"), model, threshold)
