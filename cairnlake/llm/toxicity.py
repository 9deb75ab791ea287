"""Counterfactual-regularised toxicity classifier (operator 8).

A logistic regression on which words, and which four- and five-byte word beginnings,
occur in a text.  Identity terms of labelled texts are swapped for others of their
group, and the squared change of the score is penalised, so that the mention of a
group weighs nothing by itself.  Terms are those of a list, and those that the labelled
texts themselves show to be neutral mentions: frequent words of both classes that tell
nothing of the class.  So the penalty acts on texts of any language.

Fitting sees at most ``MAX_ROWS`` labelled rows, ``MAX_FEATURES`` features, both
parameters; counts of features are combined by the executors, and the driver gets
the chosen features' columns only.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.llm.runtime import trimmed
from cairnlake.llm.textbytes import Spans, chunks, mix, utf8, word_spans

MAX_ROWS = 20_000
MAX_FEATURES = 4096
LEAST_TEXTS = 4
LEAST_Z = 3.0
COUNTERFACTUAL = 1.0
NEUTRAL_TERMS = 64
NEUTRAL_LETTERS = 4
NEUTRAL_Z = 1.0
L2 = 1e-4
STEPS = 400
TABLE_BITS = 22
TOXIC_FROM = 0.3

# Terms that name groups of people; each line is one group of interchangeable terms.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["african", "european", "american", "mexican", "chinese", "indian"],
    ["immigrants", "refugees", "citizens"],
    ["disabled", "blind", "deaf"],
    ["old", "young", "elderly"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden", "hindus", "buddhisten"],
    ["ausländer", "flüchtlinge", "einwanderer"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["étrangers", "réfugiés", "immigrés"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
    ["extranjeros", "refugiados", "inmigrantes"],
]

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Swap:
    """Replaces each term by the next of its group."""

    def __init__(self, groups: list[list[str]]):
        self.next = {t: g[(i + 1) % len(g)] for g in reversed(groups) for i, t in enumerate(g) if len(g) > 1}
        self.names = re.compile(r"\b(" + "|".join(re.escape(t) for t in sorted(self.next, key=lambda t: (-len(t), t))) + r")\b") if self.next else None

    def __call__(self, text: str | None) -> str | None:
        """The text with its terms replaced, lower-cased; None without a term."""
        if not text or self.names is None:
            return None
        text = text.lower()
        out, n = self.names.subn(lambda m: self.next[m[0]], text)
        return out if n else None


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, index of the text, feature) for pieces of the batch; a feature may repeat in a text."""
    raw, offsets = utf8(pc.utf8_lower(texts))
    for first, end, part, off in chunks(raw, offsets):
        starts, ends, at = word_spans(_APART[part], off)
        which = np.repeat(np.arange(first, end), np.diff(at))
        spans, out = Spans(part), []
        out.append((which, mix(spans(starts, ends), 1)))
        for n in (4, 5):
            long = ends - starts > n
            out.append((which[long], mix(spans(starts[long], starts[long] + n), n)))
        yield first, end, np.concatenate([w for w, _ in out]), np.concatenate([f for _, f in out])


def _word_feature(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(mix(Spans(raw)(np.array([0]), np.array([len(raw)])), 1)[0])


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: all but the quarter whose ids' checksums leave 2, which is held out."""
    return labels.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "toxic")


@dataclass
class Model:
    """Sorted feature keys, their weights, and the bias; the terms swapped in fitting, and how many texts held one."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    terms: list[list[str]] = field(default_factory=list)
    swapped: int = 0

    def _table(self) -> np.ndarray:
        slots = np.full(1 << TABLE_BITS, -1, np.int32)
        slots[(self.keys & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = np.arange(len(self.keys))
        return slots

    def find(self, which: np.ndarray, found: np.ndarray, slots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature number) of the features that the model has."""
        if not len(self.keys):
            return which[:0], np.zeros(0, np.int64)
        if slots is not None:  # most features end here
            maybe = slots[(found & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] >= 0
            which, found = which[maybe], found[maybe]
        number = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        same = self.keys[number] == found
        pairs = np.unique(which[same].astype(np.int64) * len(self.keys) + number[same])
        return pairs // len(self.keys), pairs % len(self.keys)

    def score(self, texts: pa.Array, slots: np.ndarray | None = None) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        for _, _, which, found in features(texts):
            text, number = self.find(which, found, slots)
            logit += np.bincount(text, self.weights[number], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, other texts) of a task, summed before they are sent."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return keys, *(np.bincount(at, np.concatenate([h[k] for h in held]), len(keys)).astype(np.int64) for k in (1, 2))

    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        for _, end, which, found in features(batch.column(0)):
            pairs = np.unique(np.rec.fromarrays([which, found]))
            one = toxic[pairs.f0]
            held.append((pairs.f1, one, 1 - one))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held = [summed()]
    if held:
        keys, pos, neg = summed()
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (keys.view(np.int64), pos, neg)], names=["feature", "pos", "neg"])


def _odds(p: int, q: int) -> tuple[Column, Column]:
    """(log odds ratio of toxic and other texts, its z) of what ``pos`` of p toxic and ``neg`` of q other texts hold."""
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (p + 1 - pos)) - F.log(neg / (q + 1 - neg))
    return odds, F.abs(odds) / F.sqrt(1 / pos + 1 / neg)


def neutral_terms(rows: DataFrame, p: int, q: int, most: int = NEUTRAL_TERMS) -> list[list[str]]:
    """Pairs of words about as frequent as each other, the most frequent that ``rows`` (text, toxic) show to be neutral.

    ``most`` words are collected; they occur in texts of both classes and their log odds
    ratio is within ``NEUTRAL_Z`` of its standard errors.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: (F.char_length(w) >= NEUTRAL_LETTERS) & w.rlike(r"^\p{L}+$")))
    counts = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    best = counts.where((F.least("pos", "neg") >= LEAST_TEXTS) & (_odds(p, q)[1] < NEUTRAL_Z)).orderBy(F.desc(F.col("pos") + F.col("neg")), "word").limit(most).collect()
    return [[a["word"], b["word"]] for a, b in zip(best[::2], best[1::2], strict=False)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, counterfactual: float = COUNTERFACTUAL, identity_terms: list[list[str]] | None = None, neutral: int = NEUTRAL_TERMS) -> Model:
    """Fit on ``labels`` (doc_id, toxic 0 or 1) of ``docs`` (doc_id, text).

    Of more than ``max_rows`` labelled documents those with the smallest hash of their
    id are taken.  A document with both labels counts as toxic; null labels and ids are
    left out.  Without a labelled document, or with one class alone, the model is that
    class's share (0.5 without any); so it is where no feature is frequent enough.  A
    document that stands twice counts twice.  ``identity_terms``: groups of terms that
    may stand for each other (``IDENTITY_TERMS``); ``neutral``: how many words the texts
    may add to them.
    """
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    # at most max_rows short rows: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    counts = rows.mapInArrow(trimmed(_counted), "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p or not q:
        share = (p + 0.5) / (p + q + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    terms = (IDENTITY_TERMS if identity_terms is None else identity_terms) + neutral_terms(rows, p, q, neutral)
    swap = Swap(terms)
    z = _odds(p, q)[1]
    best = counts.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()
    keys = {int(r["feature"]) & 0xFFFFFFFFFFFFFFFF for r in best} | {_word_feature(t) for t in swap.next}
    model = Model(np.array(sorted(keys), np.uint64), np.zeros(len(keys)), 0.0, terms)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(texts: pa.Array) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in range(len(texts))]
            for _, _, which, found in features(texts):
                for text, number in zip(*(x.tolist() for x in model.find(which, found, None)), strict=True):
                    out[text].append(number)
            return out

        for batch in batches:
            texts = batch.column(0)
            other = pa.array(map(swap, texts.to_pylist()), pa.string())
            cf = [None if not ok else x for x, ok in zip(numbers(other), other.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(numbers(texts), pa.list_(pa.int32())), pa.array(cf, pa.list_(pa.int32()))], names=["toxic", "x", "cf"])

    got = rows.mapInArrow(trimmed(columns), "toxic int, x array<int>, cf array<int>").toPandas()
    return _trained(model, got["toxic"].to_numpy(float), list(got["x"]), list(got["cf"]), counterfactual)


def _trained(model: Model, y: np.ndarray, x: list, cf: list, counterfactual: float) -> Model:
    """Full-batch Adam on the mean log loss, L2 and the penalty on swaps."""

    def total(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, values, n).astype(float)  # of nothing it would be integers

    def sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*(np.asarray(r, np.int64) for r in rows), np.zeros(0, np.int64)])

    n, k = len(y), len(model.keys)
    row, col = sparse(x)
    own = [i for i, c in enumerate(cf) if c is not None]
    a_row, a_col = sparse([x[i] for i in own])
    b_row, b_col = sparse([cf[i] for i in own])
    w = np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        logit = total(row, w[col], n) + w[k]
        error = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y) / n
        grad = total(col, error[row], k + 1)
        grad[k] = error.sum()
        grad[:k] += 2 * L2 * w[:k]
        if own:
            change = total(b_row, w[b_col], len(own)) - total(a_row, w[a_col], len(own))
            change *= 2 * counterfactual / len(own)
            grad += total(b_col, change[b_row], k + 1) - total(a_col, change[a_row], k + 1)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.keys, w[:k], float(w[k]), model.terms, len(own))


def score(docs: DataFrame, model: Model, column: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with ``column``: the toxicity of each whole text, 0 to 1.

    A null or empty text gets the bias alone; repeated rows get the same; a column of
    that name is replaced.
    """
    docs = docs.drop(column)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model._table() if len(model.keys) else None
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at), slots))], names=[*part.schema.names, column])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
