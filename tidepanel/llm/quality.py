"""Quality rules: plain counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, texts

#: Rows of each label that the classifier is fitted to, at most.
MAX_ROWS = 4_000
BITS = 13
#: Words, pairs of words, character trigrams: each has its own part of the hash space.
FAMILIES = 3
#: A document is kept if its calibrated probability of being good is at least this.
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines with a word, and words in 3-word windows found twice or more."""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    counts: dict[tuple[str, str, str], int] = {}
    windows = list(zip(words, words[1:], words[2:], strict=False))
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = 0
    if len(counts) < len(windows):
        to = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered += i + 3 - max(i, to)
                to = i + 3
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), repeated, covered


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: indices and square roots of shares; words, pairs of words and character trigrams apart."""
    size, low = 1 << bits, np.uint32((1 << bits) - 1)
    raw = text.encode("utf-8", "replace")
    words = np.array([zlib.crc32(w) for w in raw.split()], np.uint32)
    pairs = (words[:-1] * np.uint32(0x9E3779B1) ^ words[1:]) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    grams = ((c[:-2] * np.uint32(0x85EBCA77) ^ c[1:-1]) * np.uint32(0xC2B2AE3D) ^ c[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits) if len(c) > 2 else np.zeros(0, np.uint32)
    out_i, out_x = [], []
    for offset, hashed in ((0, words & low), (size, pairs), (2 * size, grams)):
        if len(hashed):
            n = np.bincount(hashed, minlength=size)
            i = np.flatnonzero(n)
            out_i.append(i + offset)
            out_x.append(np.sqrt(n[i] / len(hashed)))
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_i), np.concatenate(out_x)


@dataclass(frozen=True)
class Model:
    """Weights over hashed features, and the calibration of the logit."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: str) -> float:
        i, x = features(text)
        logit = self.slope * (float(self.weights[i] @ x) + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, size: int, steps: int = 200, rate: float = 0.2, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse rows by Adam on the full batch."""
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    for t in range(1, steps + 1):
        logit = np.bincount(at, w[index] * value, len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y)
        grad = np.append(np.bincount(index, error[at] * value, size), error.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit to labelled documents, at most ``max_rows`` of each label, first by hash of the id.

    A fifth of them, by crc32 of the id, is set aside to calibrate the probability (Platt's scaling with his
    smoothed targets), each label weighted by its share among all labels, so that the probability is that of
    the whole table. Null ids and labels are not learnt from. With fewer than two labels present, every text
    gets probability 1 (or 0 if only label 0 is present).
    """
    size = FAMILIES << BITS
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return Model(np.zeros(size), 0.0, 1.0, -50.0 if 0 in share else 50.0)
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows) for y in (0, 1)]
    taken = F.broadcast(parts[0].union(parts[1]))  # at most 2 * max_rows ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(taken, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [features(t) for t in texts(b.column(1))]
            # two bytes each: indices are under 2 ** 16, and half precision is ample for shares
            packed = [pa.array([f[k].astype(kind).tobytes() for f in both], pa.binary()) for k, kind in ((0, np.uint16), (1, np.float16))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *packed], ["id", "y", "i", "x"])

    sample = rows.mapInArrow(run, "id long, y int, i binary, x binary").toArrow().sort_by([("id", "ascending")])
    ids, y = sample.column("id").to_numpy(), sample.column("y").to_numpy()
    of = [(np.frombuffer(i, np.uint16).astype(np.int32), np.frombuffer(x, np.float16).astype(np.float32)) for i, x in zip(sample.column("i").to_pylist(), sample.column("x").to_pylist(), strict=True)]
    aside = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in ids.tolist()])
    if len(of) == 0 or any((y[~aside] == k).sum() == 0 or (y[aside] == k).sum() == 0 for k in (0, 1)):
        aside = np.zeros(len(of), bool)
    n = np.array([share[0], share[1]], float) / (share[0] + share[1])

    def weighted(mask: np.ndarray) -> np.ndarray:
        here = np.array([max(1, (y[mask] == k).sum()) for k in (0, 1)])
        return (n / here)[y[mask]]

    w, bias = _logistic([of[k] for k in np.flatnonzero(~aside)], y[~aside], weighted(~aside), size)
    held = aside if aside.any() else ~aside
    logit = np.array([w[of[k][0]] @ of[k][1] + bias for k in np.flatnonzero(held)])
    counts = [(y[held] == k).sum() for k in (0, 1)]
    target = np.where(y[held] == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    one = [(np.zeros(1, np.int64), np.array([v])) for v in logit]
    slope, shift = _logistic(one, target, weighted(held), 1, steps=400, rate=0.05, l2=0.0)
    return Model(w.astype(np.float32), bias, float(slope[0]), shift)


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id``, the counts, ``base_failed``, ``probability`` and ``kept``.

    A text fails the base rules with fewer than 50 words or with over half of its words in repeated 3-word
    windows. It is kept if it passes them and its probability is at least ``threshold``. Null texts are
    empty; null ids and repeated rows give a row each; other columns are not read; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            all_texts = texts(b.column(1))
            counts = np.array([rule_counts(t) for t in all_texts], np.int64).reshape(-1, len(COUNTS))
            p = pa.array([model.probability(t) for t in all_texts], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS))), p], ["id", *COUNTS, "probability"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, " + "".join(f"{c} long, " for c in COUNTS) + "probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= threshold))
