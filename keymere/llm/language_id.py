"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed byte n-grams (lower case,
runs of other ASCII characters than letters as one space). Each language's
training vectors are clustered on the sphere; a text gets the language of the
centroid with the largest cosine, and is rejected when even that one is
farther away than texts of its length are in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import text_slices, utf8

DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Bound of the training sample: rows of a language, rows of all, bytes of their texts of all.
LANGUAGE_ROWS, ALL_ROWS, ALL_BYTES = 600, 12_000, 64 << 20
#: A text is rejected when its cosine is below this share of the usual lowest one.
REJECT = 0.6
#: Sharpness of the score: a softmax over the languages' best cosines.
SHARPNESS = 12.0
SCHEMA = "lang_pred string, score double, cosine double, rejected boolean"


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """The n-gram counts of each text of a slice."""
    raw, rows = utf8(pc.utf8_lower(column).cast(pa.large_string()))
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    keep = letter.copy()
    if len(raw):
        keep[1:] |= letter[:-1]  # the first of a run of others
    at = np.concatenate([[0], np.cumsum(keep)])[rows]
    x = np.where(letter, raw, 32)[keep].astype(np.uint32)
    x = np.concatenate([x, np.zeros(3, np.uint32)])
    with np.errstate(over="ignore"):
        two = x[:-2] << 8 | x[1:-1]
        three = two << 8 | x[2:]
        h2 = ((two * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
        h3 = ((three * np.uint32(0x85EBCA6B)) >> np.uint32(19)).astype(np.int64)
    for a, b in zip(at[:-1], at[1:]):
        yield np.bincount(np.concatenate([h2[a : max(a, b - 1)], h3[a : max(a, b - 2)]]), minlength=DIMENSIONS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows: unit vectors
    owner: np.ndarray  # language of each row
    lowest: np.ndarray  # usual lowest cosine by the binary logarithm of the n-gram count

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = np.zeros((len(column), DIMENSIONS), np.float32), np.zeros(len(column), np.int64)
        for i, c in enumerate(counts(column)):
            sizes[i] = c.sum()
            out[i] = np.log1p(c) * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), sizes

    def predict(self, column: pa.Array) -> dict[str, np.ndarray | list]:
        """For a slice of texts: language, score, cosine, rejected."""
        lang, score, cosine, rejected = [], [], [], []
        for first in range(0, len(column), 256):
            part = column.slice(first, 256)
            vectors, sizes = self.vectors(part)
            best = np.full((len(part), len(self.languages)), -1.0)
            np.maximum.at(best.T, self.owner, (vectors @ self.centroids.T).T)
            top = best.argmax(axis=1)
            cos = best[np.arange(len(part)), top]
            soft = 1 / np.exp(SHARPNESS * (best - cos[:, None])).sum(axis=1)
            low = self.lowest[np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), len(self.lowest) - 1)]
            # a letter is likely; the exact test is for texts without ASCII letters
            some = pc.match_substring_regex(part, "[A-Za-z]").to_numpy(zero_copy_only=False)
            for i, text in enumerate(part.to_pylist() if not some.all() else [None] * len(part)):
                ok = some[i] or has_letter(text)
                lang.append(self.languages[top[i]] if ok else "und")
                score.append(float(min(max(soft[i], 0), 1)) if ok else 0.0)
                cosine.append(float(cos[i]) if ok else 0.0)
                rejected.append(bool(not ok or cos[i] < REJECT * low[i]))
        return {"lang_pred": lang, "score": score, "cosine": cosine, "rejected": rejected}


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the mean and the vectors farthest from those taken."""
    mean = vectors.mean(axis=0)
    centers = [mean / max(np.linalg.norm(mean), 1e-9)]
    near = vectors @ centers[0]
    while len(centers) < min(k, len(vectors)):
        # not the very farthest: outliers make poor centroids
        far = int(np.argsort(near)[min(len(near) // 20, len(near) - 1)])
        centers.append(vectors[far])
        near = np.maximum(near, vectors @ vectors[far])
    c = np.array(centers)
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(axis=1)
        sums = np.array([vectors[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def train(docs: DataFrame, keep: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel | None:
    """Fit on a bounded sample of the labelled rows where ``keep`` holds; None without any.

    At most ``LANGUAGE_ROWS`` whole texts of each language, ``ALL_ROWS`` in
    all, and ``ALL_BYTES`` shared by the languages alike, chosen by a hash of
    id and text: so much is what reaches the driver.
    """
    rows = docs.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("y"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)).alias("h"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes:
        return None
    most = max(1, min(LANGUAGE_ROWS, ALL_ROWS // len(sizes)))
    share = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(int(min(1.0, 1.2 * most / n) * (1 << 20)))).otherwise(share)
    own = Window.partitionBy("y").orderBy("h", F.xxhash64("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = rows.where(F.col("h") < share).withColumns({"n": F.count(F.lit(1)).over(own), "b": F.sum(F.octet_length("t")).over(own)})
    sample = few.where((F.col("n") <= most) & (F.col("b") <= ALL_BYTES // len(sizes))).select("y", "t", "h").toPandas().sort_values(["y", "h", "t"])
    return fit(sample["t"].tolist(), sample["y"].tolist()) if len(sample) else None


def fit(texts: list[str], labels: list[str]) -> LanguageModel:
    languages = sorted(set(labels))
    column = pa.array(texts, pa.large_string())
    df = np.zeros(DIMENSIONS)
    for c in counts(column):
        df += c > 0
    model = LanguageModel(languages, (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    parts, owner, low = [], [], [[] for _ in range(40)]
    for j in range(len(languages)):
        own = pa.array([t for t, k in zip(texts, y) if k == j], pa.large_string())
        vectors, sizes = model.vectors(own)
        c = cluster(vectors, CENTROIDS)
        parts.append(c)
        owner += [j] * len(c)
        for s, cos in zip(sizes, (vectors @ c.T).max(axis=1)):
            low[int(np.log2(max(s, 1)))].append(cos)
    model.centroids, model.owner = np.concatenate(parts), np.array(owner)
    lowest, last = np.zeros(40), None
    for k in range(39, -1, -1):  # a length that training lacks takes half of the next longer one's
        if len(low[k]) >= 5:
            last = float(np.quantile(low[k], 0.02))
        elif last is not None:
            last /= 1.5
        lowest[k] = last or 0.0
    top = max((k for k in range(40) if len(low[k]) >= 5), default=0)
    lowest[top + 1 :] = lowest[top]
    model.lowest = np.minimum.accumulate(lowest[::-1])[::-1]
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred, score, cosine, rejected, each with ``prefix`` before its name, to the rows of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and rejected.
    Without a model (nothing was labelled) every text is ``und`` with score 0,
    and those with a letter aren't rejected, as there is nothing to reject them
    by. Of languages that are equally near the first in the order of their
    names is taken. Each row is judged by its text alone, so repeated rows have
    repeated results; very long texts are counted whole. An empty table gives
    no rows. Columns of ``docs`` with the new names are replaced.
    """
    schema = [(prefix + x.split()[0], x.split()[1]) for x in SCHEMA.split(", ")]
    docs = docs.drop(*(n for n, _ in schema))
    if model is None:
        letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
        values = (F.lit("und"), F.lit(0.0), F.lit(0.0), ~letter)
        return docs.withColumns({n: v for (n, _), v in zip(schema, values)})
    at = docs.columns.index(text_col)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {t}" for n, t in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column(at)):
                own, found = batch.slice(first, len(part)), model.predict(part)
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, t) for x, t in zip(found.values(), kinds))], [*own.schema.names, *(n for n, _ in schema)])

    return docs.mapInArrow(run, ddl)
