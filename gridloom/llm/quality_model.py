"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector over hashed features of the whole text (words in lower case, their beginnings, the shapes of words,
words that repeat their neighbour) gives a latent quality; ordered thresholds cut it into grades: P(grade >= k) = sigmoid(latent - t_k).
The model gives the expected grade and the tail probabilities; a document is kept where P(grade >= `at_least`) reaches
`least`.

The model is fitted on at most about `fit_rows` graded rows, picked by a hash of their id; that bounded sample is the only
thing that is broadcast or collected. Prediction reads every text whole and alone.

Null and blank texts have no features: the thresholds alone decide. Without graded rows, or with one grade only, every
tail probability is 1 and all is kept. Grades are whole numbers from 0; null ids and null grades are left out of the fit;
an id graded more than once counts as often. Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import apart, kept_schema, slices, with_columns, written

PLACES = 1 << 16
REMEMBERED = 60_000
#: Letters of a word's beginning, a feature that words of one stem share.
BEGIN = 4


class Classes(dict):
    """Characters by their class, for str.translate; made as they are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = k = "a" if c.islower() else "A" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c
        return k


CLASSES, RUN = Classes(), re.compile(r"(.)\1+", re.DOTALL)


class Features:
    """Hashed features of texts; remembers the places of words up to a bound."""

    def __init__(self, places: int):
        self.places, self.known = places, {}

    def place(self, token: str) -> int:
        return zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.places

    @staticmethod
    def shape(word: str) -> str:
        """A word with letters and digits as classes and runs as one: `Ered***` is `Aa*`."""
        return RUN.sub(r"\1", word.translate(CLASSES))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values: damped word counts of length 1, for words and for their beginnings, shares of word shapes, the share
        of repeated neighbours."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        tally = Counter(words)
        for w in [w for w in tally if w not in known]:
            known[w] = (self.place("w:" + (low := w.lower().strip(".,;:!?"))), self.place("b:" + low[:BEGIN]), self.place("s:" + self.shape(w)))
        pairs = np.array([known[w] for w in tally], np.int32)
        n = np.fromiter(tally.values(), np.float32, len(tally))
        damped = np.log1p(n)
        damped /= np.linalg.norm(damped)
        repeats = sum(map(eq, words, words[1:])) / len(words)
        at = np.concatenate([pairs[:, 0], pairs[:, 1], pairs[:, 2], [self.place("repeat"), self.place("bias")]])
        return at.astype(np.int32), np.concatenate([damped, damped, n / len(words), [repeats, 0.2]]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one below each grade but the first

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -40, 40)))


def fitted(at: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, places: int, decay: float = 1e-5, rounds: int = 100, rate: float = 0.3, parts: int = 8) -> Model:
    """The cumulative-link model of greatest likelihood (Adam over parts of the rows in turn, decayed weights). Rows ascend."""
    top = int(grade.max())
    share = np.clip([(grade >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    cuts = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    params = np.concatenate([np.zeros(places), cuts[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    parts = min(parts, max(1, len(grade) // 50))
    dealt = [np.flatnonzero(row % parts == k) for k in range(parts)]
    dealt = [(at[i], value[i], row[i] // parts, grade[k::parts]) for k, i in enumerate(dealt)]
    for step in range(1, rounds * parts + 1):
        p_at, p_value, p_row, p_grade = dealt[step % parts]
        g = gradient(params, p_at, p_value, p_row, p_grade, places, top)
        g[:places] -= decay * params[:places]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[:places].astype(np.float32), thresholds(params, places))


def thresholds(params: np.ndarray, places: int) -> np.ndarray:
    """Ascending thresholds: the first as it is, the others by the logarithms of their gaps."""
    return params[places] + np.concatenate([[0], np.cumsum(np.exp(params[places + 1 :]))])


def gradient(params: np.ndarray, at: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, places: int, top: int) -> np.ndarray:
    """Of the mean log likelihood by the parameters: weights, first threshold, logarithms of gaps."""
    n = len(grade)
    t, log_gaps = thresholds(params, places), params[places + 1 :]
    latent = np.bincount(row, params[at] * value, n)
    # P(grade = g) = F(upper) - F(lower) with F the logistic function of threshold - latent
    edge = np.concatenate([[-40], t, [40]])
    lower, upper = edge[grade] - latent, edge[grade + 1] - latent
    f = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    fl, fu = np.where(grade > 0, f(lower), 0), np.where(grade < top, f(upper), 1)
    p = np.maximum(fu - fl, 1e-9)
    dl, du = fl * (1 - fl) / p, fu * (1 - fu) / p  # of log p to -lower and to upper
    g_t = np.array([(-(dl * (grade == k))).sum() + (du * (grade == k - 1)).sum() for k in range(1, top + 1)])
    g_gaps = np.array([g_t[k:].sum() * np.exp(log_gaps[k - 1]) for k in range(1, top)])
    return np.concatenate([np.bincount(at, value * (dl - du)[row], places) / n, [g_t.sum() / n], g_gaps / n])


def fit(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", fit_rows: int = 6000, places: int = PLACES) -> Model | None:
    """The model of (doc_id, grade) rows whose documents are in docs: `fit_rows` of them at most, repeated rows once; None without two grades."""
    rated = grades.select(F.col(doc_id).cast("string").alias("id"), F.col(grade).cast("int").alias("grade")).where("id is not null and grade is not null").distinct()
    total = rated.count()
    if not total:
        return None
    share = lambda n: min(1.0, 1.1 * fit_rows / n)
    place = lambda *c: F.shiftrightunsigned(F.xxhash64(*c, F.lit(5)), 11) * 2.0**-53
    sample = rated.where(place("id") < share(total))
    # at most about fit_rows small rows: the side that is sent is bounded
    met = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    met = met.withColumn("place", place("id", "text", "grade"))
    # an id may have any number of rows: their distinct texts are sampled once more, and ranked for a hard bound
    count = met.agg(F.approx_count_distinct("place", 0.02)).first()[0]
    likely = met.where(F.col("place") < share(max(1, count))).dropDuplicates(["id", "place", "grade"])
    picked = likely.withColumn("rank", F.row_number().over(Window.orderBy("place", "id", "grade"))).where(F.col("rank") <= fit_rows)  # about fit_rows rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(places)
        for batch in batches:
            for group, texts in slices(batch, "text"):
                found = [make.of(t) for t in texts]
                yield with_columns(group, ["id", "grade"], at=pa.array([f[0] for f in found], pa.list_(pa.int32())), value=pa.array([f[1] for f in found], pa.list_(pa.float32())))

    made = written(picked.select("id", "grade", "text").mapInArrow(features, "id string, grade int, at array<int>, value array<float>"))
    rows = made.orderBy("id", "grade", F.xxhash64("at")).toArrow().combine_chunks()
    grade_of = rows["grade"].to_numpy().astype(np.int64)
    if len(set(grade_of.tolist())) < 2:
        return None
    lengths = rows["at"].combine_chunks().value_lengths().to_numpy()
    at, value = rows["at"].combine_chunks().flatten().to_numpy(), rows["value"].combine_chunks().flatten().to_numpy()
    return fitted(at, value.astype(np.float64), np.repeat(np.arange(len(lengths)), lengths), grade_of, places)


def graded(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, at_least: int = 1, least: float = 0.5) -> DataFrame:
    """The columns `keep` (all by default), expected_grade, tails (P(grade >= 1), P(grade >= 2), ...) and selected.

    Own columns of these names are handed on as `<name>_before`."""
    made = ("expected_grade", "tails", "selected")
    names = apart(df.columns, made)
    df, keep, text = df.withColumnsRenamed(names), [names[c] for c in (df.columns if keep is None else keep)], names[text]
    sent = df.sparkSession.sparkContext.broadcast(model)  # `places` weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        make = Features(len(m.weights)) if m else None
        for batch in batches:
            for part, texts in slices(batch, text):
                if m:
                    found = [make.of(t) for t in texts]
                    tails = m.tails(np.array([float(m.weights[at] @ value) for at, value in found]))
                else:
                    tails = np.ones((len(texts), at_least))
                picked = tails[:, at_least - 1] >= least if at_least <= tails.shape[1] else np.zeros(len(texts), bool)
                yield with_columns(part, keep, expected_grade=pa.array(tails.sum(axis=1)), tails=pa.array(list(tails), pa.list_(pa.float64())), selected=pa.array(picked))

    schema = kept_schema(df, keep, *zip(made, ("double", "array<double>", "boolean"), strict=True))
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
