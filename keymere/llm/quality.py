"""Quality rules whose cutoffs come with a guarantee.

Statistics of a text are compared with a path of ever stricter cutoffs. For
each stratum the strictest point of the path is taken at which the share of
good documents rejected is at most ``risk``, with confidence ``1 - error``
over all strata: the path is tested from its lenient end with exact binomial
p-values (fixed-sequence testing) at level ``error / strata`` (Bonferroni).

The path was fixed beforehand from what such statistics mean (a text that is
nearly all capitals, marks or repeated lines at its lenient end, one with
clearly more of them than prose at its strict end), not from labels: the
guarantee needs a path that the labels it is tested on had no part in.
Equal texts count once, as copies are no independent trials; near copies do
count, so where they abound among the labelled rows the guarantee is weaker.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, is_space, text_slices

WINDOW = 8
#: Steps of the path; level STEPS means that no cutoff rejects.
STEPS = 24
#: (lenient, strict) cutoffs; a statistic at or above the cutoff rejects. Between them cutoffs go in equal ratios.
RULES: dict[str, tuple[float, float]] = {
    "symbol_rate": (2.0, 0.12),  # n_symbols / n_words
    "upper_share": (0.95, 0.25),  # ASCII capitals / characters in words
    "mark_share": (0.60, 0.09),  # ASCII marks other than letters and digits / characters in words
    "digit_share": (0.90, 0.30),  # digits / characters in words
    "long_words": (60.0, 22.0),  # characters per word
    "dup_line_share": (0.95, 0.40),  # n_dup_lines / lines with a word
    "repeat_share": (0.295, 0.20),  # n_repeat_words / n_words
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, level int, text_hash long"
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def cutoffs() -> dict[str, np.ndarray]:
    return {k: a * (b / a) ** (np.arange(STEPS) / (STEPS - 1)) for k, (a, b) in RULES.items()}


def _per_row(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64 if len(mask) >> 31 else np.int32)
    np.cumsum(mask, out=total[1:], dtype=total.dtype)
    return (total[rows[1:]] - total[rows[:-1]]).astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(window):
            value = value * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, window)
    a, b = order[1:][same], order[:-1][same]
    if (windows[a] == windows[b]).all():
        starts = np.union1d(a, b)
    else:  # two windows with one hash value: count the windows themselves
        _, inverse, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[inverse.ravel()] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and the level of each text of a slice of ``text_slices``."""
    words = Words(column)
    raw, rows = words.raw, words.rows
    n = len(rows) - 1
    n_words = np.diff(words.offsets)
    lead = (raw & 0xC0) != 0x80  # first byte of each code point
    word_chars = _per_row(lead & ~is_space(raw), rows)
    n_symbols = _per_row(np.isin(raw, _SYMBOLS), rows)
    upper = _per_row((raw >= 65) & (raw <= 90), rows)
    digits = _per_row((raw >= 48) & (raw <= 57), rows)
    letters = _per_row(((raw | 32) >= 97) & ((raw | 32) <= 122), rows)
    ascii_ = _per_row((raw < 128) & ~is_space(raw), rows)
    dup, lines, repeat = (np.zeros(n, np.int64) for _ in range(3))
    data = raw.tobytes()
    for i in range(n):
        text = data[rows[i] : rows[i + 1]]
        real = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines[i] = len(real)
        dup[i] = len(real) - len(set(real))
        repeat[i] = repeated_words(words.ids[words.offsets[i] : words.offsets[i + 1]])
    chars, count = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    stats = {
        "symbol_rate": n_symbols / count,
        "upper_share": upper / chars,
        "mark_share": (ascii_ - letters - digits) / chars,
        "digit_share": digits / chars,
        "long_words": word_chars / count,
        "dup_line_share": dup / np.maximum(lines, 1),
        "repeat_share": repeat / count,
    }
    level = np.full(n, STEPS)
    for name, cuts in cutoffs().items():
        level = np.minimum(level, STEPS - np.searchsorted(cuts[::-1], stats[name], "right"))
    failed = (n_words < 20) | (100 * repeat > 30 * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "level": level.astype(np.int32)}


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add the columns of ``SCHEMA``, each with ``prefix`` before its name: the counts, ``base_failed``, ``level``, the first step of the path that rejects, and a hash of the text.

    A null text has no words and fails the base rules, as an empty one does; a
    very long one is counted whole. Repeated rows have repeated results, an
    empty table has none. Columns of ``docs`` with the new names are replaced.
    """
    schema = [(prefix + x.split()[0], x.split()[1]) for x in SCHEMA.split(", ")]
    docs = docs.drop(*(n for n, _ in schema)).withColumn(schema[-1][0], F.xxhash64(text_col))
    at, last = docs.columns.index(text_col), docs.columns[:-1]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in last), *(f"`{n}` {t}" for n, t in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column(at)):
                own = batch.slice(first, len(part))
                stats = statistics(part)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *map(pa.array, stats.values()), own.columns[-1]], [*last, *(n for n, _ in schema)])

    return docs.mapInArrow(run, ddl)


def log_tail(k: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) <= k), summed exactly from the largest term down, until terms no longer count."""
    if k >= n:
        return 0.0
    j = min(k, int((n + 1) * p))  # the largest term up to k
    top = lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)
    odds, total = p / (1 - p), 1.0
    for way in (-1, 1):
        i, term = j, 1.0
        while 0 <= i + way <= k and term > 1e-18 * total:
            term *= i / (n - i + 1) / odds if way < 0 else (n - i) / (i + 1) * odds
            total += term
            i += way
    return top + log(total)


def choose_steps(counts: dict[tuple[object, int], int], risk: float, error: float) -> dict[object, int]:
    """The strictest safe step of each stratum (-1: none) from counts of good documents by (stratum, level)."""
    strata = sorted({s for s, _ in counts}, key=str)
    out = {}
    for s in strata:
        by = np.array([counts.get((s, k), 0) for k in range(STEPS + 1)])
        n, rejected = int(by.sum()), np.cumsum(by)
        step = -1
        while step + 1 < STEPS and n and log_tail(int(rejected[step + 1]), n, risk) <= log(error / len(strata)):
            step += 1
        out[s] = step
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: float, error: float, stratum_col: str = "lang", id_col: str = "doc_id", prefix: str = "") -> dict[object, int]:
    """Choose steps from all labelled documents (quality 1: good) that pass the base rules.

    Of a stratum's equal texts one counts. Only counts by stratum and level
    reach the driver. A null stratum is one of its own. A document with several
    labels is good if one of them says so. Without labels there are no steps.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    rows = measured.where(~F.col(f"{prefix}base_failed")).join(good, id_col, "left_semi").select(F.col(stratum_col).alias("s"), F.col(f"{prefix}level").alias("level"), F.col(f"{prefix}text_hash").alias("h"))
    counted = rows.distinct().groupBy("s", "level").count().collect()
    return choose_steps({(r["s"], r["level"]): r["count"] for r in counted}, risk, error)


def judge(measured: DataFrame, steps: dict[object, int], stratum_col: str = "lang", prefix: str = "") -> DataFrame:
    """Add ``kept`` (with the prefix). A stratum without a safe step has only the base rules; a text at the very cutoff is rejected."""
    step = F.lit(-1)
    for s, k in steps.items():
        step = F.when(F.col(stratum_col).eqNullSafe(F.lit(s)), F.lit(k)).otherwise(step)
    return measured.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}level") > step))
