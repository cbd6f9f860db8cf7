"""Toxicity scores from confirmed toxic and unlabelled texts only.

A linear model over words and their beginnings is trained by gradient descent on the
non-negative positive-unlabelled risk: with prior p, the risk is
``p * R_P(+) + max(0, R_U(-) - p * R_P(-))``. Where the bracket would turn
negative, the step goes against it, so the model doesn't fit the toxic
examples by heart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import Words, text_slices

#: Bounds of the training sample: confirmed and unlabelled rows, and bytes of the texts of each.
POSITIVE_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 2000, 4000, 32 << 20
#: Bytes of text whose words are held at once.
SLICE = 1 << 20
FEATURES = 2048
#: Standard errors by which a feature must be commoner in confirmed texts; score at the cutoff of the margins.
Z_LEAST, CUT_SCORE = 4.0, 0.3
#: Characters of the beginnings that are features.
BEGINNINGS = (4, 5, 6, 8)
EPOCHS, RATE, DECAY = 300, 0.05, 5e-4
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def stems(vocabulary: list[bytes]) -> list[bytes]:
    """Words in lower case without ASCII marks at their ends."""
    return [x.strip(_MARKS).decode().lower().encode() for x in vocabulary]


def keys(vocabulary: list[bytes]) -> list[list[bytes]]:
    """For each feature of a word, that of each word: itself, then its beginnings (empty where it is shorter)."""
    words = [x.decode() for x in stems(vocabulary)]
    return [[x.encode() for x in words], *([b"^" + x[:n].encode() if len(x) > n else b"" for x in words] for n in BEGINNINGS)]


def _spread(words: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each feature of each word that has a number; numbers: by feature and word."""
    found = numbers[:, words.ids].ravel() if len(words.ids) else np.zeros(0, np.int64)
    row = np.tile(np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets)), len(numbers))
    return row[found >= 0], found[found >= 0]


@dataclass
class ToxicityModel:
    features: dict[bytes, int]
    weights: np.ndarray
    bias: float

    def margins(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        numbers = np.array([[self.features.get(x, -1) for x in kind] for kind in keys(words.vocabulary)], np.int64)
        row, found = _spread(words, numbers)
        pairs, count = np.unique(row * len(self.weights) + found, return_counts=True) if len(row) else (np.zeros(0, np.int64),) * 2
        gain = self.weights[pairs % max(len(self.weights), 1)] * np.log1p(count) if len(pairs) else np.zeros(0)
        return self.bias + np.bincount(pairs // max(len(self.weights), 1), gain, minlength=len(column))

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(column), -30, 30)))


def _counted(texts: list[str], names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of all texts; new features are added to ``names``."""
    parts = []
    for at, part in text_slices(pa.array(texts, pa.large_string()), SLICE):
        words = Words(part)
        numbers = np.array([[names.setdefault(x, len(names)) if x else -1 for x in kind] for kind in keys(words.vocabulary)], np.int64)
        pairs, count = np.unique(np.add(*(x * y for x, y in zip(_spread(words, numbers), (1 << 32, 1)))), return_counts=True)
        parts.append(((pairs >> 32).astype(np.int32) + at, (pairs & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts))


class _Matrix:
    """Rows of sparse log counts."""

    def __init__(self, row: np.ndarray, col: np.ndarray, count: np.ndarray, n: int, m: int):
        self.row, self.col, self.value, self.n, self.m = row, col, np.log1p(count), n, m

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], minlength=self.m)


def fit(positive: list[str], unlabelled: list[str], prior: float) -> ToxicityModel:
    """Train on texts; without positive texts every score is near 0."""
    if not positive or not unlabelled:
        return ToxicityModel({}, np.zeros(1), -6.0)
    names: dict[bytes, int] = {}
    spread = [_counted(x, names) for x in (positive, unlabelled)]
    n_p, n_u = len(positive), len(unlabelled)
    df_p, df_u = (np.bincount(col, minlength=len(names)) for _, col, _ in spread)
    rate = (df_p + df_u) / (n_p + n_u)
    z = (df_p / n_p - df_u / n_u) / np.sqrt(np.maximum(rate * (1 - rate) * (1 / n_p + 1 / n_u), 1e-12))
    z[df_p < 2] = -np.inf
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = chosen[z[chosen] > Z_LEAST]
    if not len(chosen):
        return ToxicityModel({}, np.zeros(1), -6.0)
    new = np.full(len(names), -1)
    new[chosen] = np.arange(len(chosen))
    matrices = []
    for (row, col, count), n in zip(spread, (n_p, n_u)):
        keep = new[col] >= 0
        matrices.append(_Matrix(row[keep], new[col[keep]], count[keep], n, len(chosen)))
    p, u = matrices
    w, b = np.zeros(len(chosen)), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, EPOCHS + 1):
        s_p, s_u = sigmoid(p.times(w) + b), sigmoid(u.times(w) + b)
        # logistic loss: d/dx of -log s is s - 1, of -log(1 - s) is s
        inside = -np.log1p(-np.minimum(s_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(s_p, 1 - 1e-12)).mean()
        g_neg, b_neg = u.back(s_u) / n_u - prior * p.back(s_p) / n_p, s_u.mean() - prior * s_p.mean()
        g_pos, b_pos = prior * p.back(s_p - 1) / n_p, prior * (s_p - 1).mean()
        g, gb = (g_pos + g_neg, b_pos + b_neg) if inside >= 0 else (-g_neg, -b_neg)
        g = g + DECAY * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = np.maximum(w - RATE * fix * m / (np.sqrt(v) + 1e-8), 0)  # a feature chosen for toxic texts doesn't speak against it
        b -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    # Shift the margins so that CUT_SCORE is where the F1 score is best. Its estimate needs no negative labels:
    # 2 * prior * (recall of confirmed) / (share of unlabelled found + prior).
    m_p, m_u = np.sort(p.times(w) + b), np.sort(u.times(w) + b)
    cuts = np.unique(m_p[m_p > b + 1e-6])
    if len(cuts):
        recall, found = 1 - np.searchsorted(m_p, cuts) / n_p, 1 - np.searchsorted(m_u, cuts) / n_u
        top = int(np.argmax(recall / (found + prior)))
        low = m_u[max(np.searchsorted(m_u, cuts[top]) - 1, 0)]
        b += float(np.log(CUT_SCORE / (1 - CUT_SCORE)) - (cuts[top] + low) / 2)
    inverse = {j: x for x, i in names.items() if (j := new[i]) >= 0}
    return ToxicityModel({inverse[j]: j for j in range(len(chosen))}, w, float(b))


def train(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on bounded samples of the rows where ``keep`` holds.

    Confirmed are documents with a label toxic = 1; all rows, labelled or not,
    are the unlabelled side. The prior is the share of toxic ones among the
    labels of such rows. Samples are chosen by a hash, within the bounds above
    on rows and bytes, which is what reaches the driver. Null texts are left
    out; without confirmed texts, or with an empty table, every score is near
    0.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("toxic").alias("toxic"))
    rows = docs.where(keep & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 20)).alias("h"))
    known = rows.select(id_col).join(marks, id_col).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    total = rows.count()

    def sample(frame: DataFrame, n: int, most: int) -> list[str]:
        part = frame.where(F.col("h") < int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 20)))
        part = part.select("t", "h", F.xxhash64("t").alias("k"), F.octet_length("t").alias("n")).orderBy("h", "k").limit(most)
        upto = Window.orderBy("h", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of ``most`` rows
        return part.withColumn("b", F.sum("n").over(upto)).where(F.col("b") <= SAMPLE_BYTES).toPandas().sort_values(["h", "t"])["t"].tolist()

    positive = sample(rows.join(marks.where("toxic = 1"), id_col, "left_semi"), known["k"], POSITIVE_ROWS)
    return fit(positive, sample(rows, total, UNLABELLED_ROWS), min(0.9, max(known["k"], 1) / max(known["n"], 1)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Add ``score``, 0 to 1.

    A null text counts as an empty one and has the score of the bias; a very
    long one is counted whole. The score is one of the text alone, so rows
    with equal texts have equal scores. An empty table gives no rows. A column
    of the name ``score`` is replaced.
    """
    docs = docs.drop("score")
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column(at), 2 * SLICE):
                own = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.scores(part))], [*own.schema.names, "score"])

    return docs.mapInArrow(run, schema)
