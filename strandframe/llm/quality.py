"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - threshold_k), one weight vector for all grades and ordered thresholds. Features are
hashed words and bins of measures of the text's form, present or not; those that tell no grade from the rest are left out. The expected grade and the probability of the top
grade serve selection.

Grades come from ratings: 0 where a text is toxic, else 1 where its quality is poor, else 2.

Fitting reads at most SAMPLE_DOCS rated documents (a bound, not a share of the corpus), picked by the hash of doc_id.
Prediction reads whole texts.

Nulls: a null text is an empty one; ratings that are null, or of a doc_id that no document has, are not learned from.
Where a doc_id is rated more than once, the lowest grade counts. With fewer than two grades to learn from, all
documents get the only grade (2 where there is none). Empty tables give empty results; repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, slices, small_batches

SAMPLE_DOCS, WORD_BUCKETS, GRADES = 12_000, 1 << 18, 3
#: Codes of ASCII marks, and measures of a text's form, one for each mark and six more, each dealt into BINS; their
#: features follow those of the words.
MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
FORM, BINS = 6 + len(MARKS), 24
BUCKETS = WORD_BUCKETS + FORM * BINS
#: A feature has to occur in so many sampled documents, and its share among the documents of some grade has to differ
#: from that among the others by so many standard errors.
LEAST_DOCS, LEAST_ERRORS = 5, 5.0
STEPS, RATE, DECAY = 300, 0.05, 1e-4
#: Words whose bucket a worker remembers.
MEMO = 200_000
#: A top-grade probability below which a document is rejected.
SELECT = 0.35


class Featurizer:
    """Features of a text, as numbers of buckets: its distinct words and the bins of its form."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        words = text.split()
        distinct = set(words)
        buckets = set()
        for w in distinct:
            b = memo.get(w)
            if b is None:
                b = xxhash.xxh32_intdigest(w.lower().rstrip(b".,;:")) % WORD_BUCKETS
                if len(w) <= 32:
                    memo[w] = b
            buckets.add(b)
        form = self.form(text, words, len(distinct))
        buckets.update(WORD_BUCKETS + k * BINS + int(x * (BINS - 1)) for k, x in enumerate(form))
        return np.fromiter(buckets, np.int32, len(buckets))

    @staticmethod
    def form(text: bytes, words: list[bytes], distinct: int) -> list[float]:
        """Measures from 0 to 1, by the logarithm where they are counts a thousand words or bytes: repeats of the word before, repeated words, capitals, digits, line feeds, the number of words, and each mark."""
        codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n, count = max(len(text), 1), max(len(words), 1)
        scale = lambda x: np.minimum(1.0, np.log1p(x) / 8)
        repeats = sum(map(bytes.__eq__, words, words[1:]))
        found = np.array([codes[65:91].sum(), codes[48:58].sum(), codes[10], *codes[MARKS]]) * 1000 / n
        capitals, digits, lines, *marks = scale(found).tolist()
        return [float(scale(repeats * 1000 / count)), 1 - (distinct / count) ** 0.5, capitals, digits, lines, min(1.0, float(np.log1p(count)) / 12), *marks]


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the ratings quality and toxic."""
    need(labels, "doc_id", "quality", "toxic")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) <= 0), 2)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade")).filter("grade is not null")


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def sample(docs: DataFrame, ratings: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, int]]:
    """Features and grade of about `most` of the rated documents, or all if they are fewer."""
    need(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    share = int(min(1.0, most / max(ratings.count(), 1)) * (1 << 30))
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < share
    # ratings of the sample are few whatever the corpus, so they are sent to its documents
    rated = docs.filter(place).select("doc_id", "text").join(F.broadcast(ratings.filter(place)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "grade", "buckets"])

    got = rated.select("doc_id", "text", "grade").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, buckets array<int>").toArrow()
    rows = [(i.as_py(), np.sort(b.values.to_numpy()), g.as_py()) for i, g, b in zip(*(got.column(k) for k in range(3)), strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1])))  # tasks may end in any order
    return [r[1:] for r in rows]


def telling(flat: np.ndarray, owner: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Features whose share differs between the documents of a grade and the rest."""
    seen = np.bincount(flat, minlength=BUCKETS)
    kept = np.zeros(BUCKETS, bool)
    for g in np.unique(grade):
        inside = int((grade == g).sum())
        outside = len(grade) - inside
        a = np.bincount(flat[grade[owner] == g], minlength=BUCKETS)
        p = seen / len(grade)
        error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / max(inside, 1) + 1 / max(outside, 1)))
        kept |= np.abs(a / max(inside, 1) - (seen - a) / max(outside, 1)) > LEAST_ERRORS * error
    return kept & (seen >= LEAST_DOCS)


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Full-batch Adam on the log-likelihood, the grades weighted by the root of their rarity."""
    flat_model = Model(np.zeros(BUCKETS, np.float32), np.full(GRADES - 1, -30.0))
    if not rows:
        return flat_model
    grade = np.array([r[1] for r in rows])
    present = np.unique(grade)
    if len(present) < 2:
        flat_model.thresholds = np.where(np.arange(1, GRADES) <= present[0], -30.0, 30.0)
        return flat_model
    flat, owner = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used = telling(flat, owner, grade)[flat]
    kept, flat = np.unique(flat[used], return_inverse=True)
    owner, n, k = owner[used], len(kept), np.arange(len(rows))
    weight = ((1 / np.bincount(grade, minlength=GRADES).clip(1)) ** 0.5)[grade]
    weight /= weight.sum()
    # weights of features, the first threshold, logarithms of the steps to the next ones
    x = np.concatenate([np.zeros(n), [-2.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        thresholds = np.cumsum(np.concatenate([x[n : n + 1], np.exp(x[n + 1 :])]))
        score = np.bincount(owner, x[:n][flat], len(rows))
        tail = 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -500, 500)))
        # P(grade) is the difference of the tails at its ends
        ends = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
        slope = ends * (1 - ends)
        p = np.maximum(ends[k, grade] - ends[k, grade + 1], 1e-9)
        low, high = weight * slope[k, grade] / p, weight * slope[k, grade + 1] / p
        by_cut = np.zeros((len(rows), GRADES + 1))
        by_cut[k, grade] += low
        by_cut[k, grade + 1] -= high
        later = np.cumsum(by_cut[:, 1:GRADES].sum(axis=0)[::-1])[::-1]
        g = np.concatenate([np.bincount(flat, (high - low)[owner], n) + DECAY * x[:n], later[:1], later[1:] * np.exp(x[n + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = x[:n]
    return Model(weights, np.cumsum(np.concatenate([x[n : n + 1], np.exp(x[n + 1 :])])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with expected_grade, p_top (probability of the top grade) and p_bottom (of the lowest), under these names or longer ones if docs has them."""
    need(docs, "text")
    small_batches(docs.sparkSession)
    names = []
    for name in ("expected_grade", "p_top", "p_bottom"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    fields = type(docs.schema)([*docs.schema.fields])
    for name in names:
        fields = fields.add(name, "double")
    used = np.flatnonzero(model.weights)
    sent = used, model.weights[used], model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS, np.float64)
        weights[sent[0]] = sent[1]
        own, features = Model(weights, sent[2]), Featurizer()
        for batch, texts in slices(batches):
            tails = np.stack([own.tails(own.score(np.sort(features(t)))) for t in texts])
            values = (tails.sum(axis=1), tails[:, -1], 1 - tails[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in values)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, fields)
