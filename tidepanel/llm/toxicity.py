"""Toxicity scores from a classifier fitted to confirmed toxic and unlabelled texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh_name, is_held_out, materialise, slices, texts

FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
#: Bounds of the fitting sample: confirmed toxic documents, and documents of unknown label.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
#: This, the penalty and the repeat features have the best F1 in three folds inside the training rows (see the README).
FEATURES = 256
#: A feature occurs in at least this share of the toxic documents.
MIN_SHARE = 0.02
#: Lengths of the word prefixes that count as features.
PREFIXES = range(4, 10)
#: Numbers of occurrences that are features of their own.
REPEATS = (2, 4)
#: Words that a task remembers the features of.
KNOWN_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights by feature hash, and the bias; a document's logit adds the weights of its distinct features."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: list[str], known: dict[str, tuple[int, ...]]) -> list[float]:
        """The texts' scores. ``known`` keeps by word the features that have a weight in any number, for the next call."""
        out, used = [], self.weights.keys()
        for text in texts:
            counts: Counter[int] = Counter()
            for word, n in Counter(WORD.findall(text.lower())).items():
                held = known.get(word)
                if held is None:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    held = known[word] = tuple(h for h in word_features(word) if not used.isdisjoint((h, *(h << 3 | t for t in REPEATS))))
                for h in held:
                    counts[h] += n
            logit = self.bias + sum(self.weights[h] for h in sorted(counted(counts) & used))
            out.append(1 / (1 + math.exp(-min(50.0, max(-50.0, logit)))))
        return out


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its proper prefixes, which stand for inflected and compound forms."""
    own = [zlib.crc32(word.encode())]
    return own + [zlib.crc32(f"{word[:k]}+".encode()) for k in PREFIXES if k < len(word)]


def counted(counts: Counter[int]) -> set[int]:
    """The features of a text: those that occur, and apart from them those that occur at least twice and four times."""
    out = set(counts)
    for times in REPEATS:
        out.update(h << 3 | times for h, n in counts.items() if n >= times)
    return out


def features(text: str) -> set[int]:
    """Hashed features of a text's words, in lower case and without punctuation."""
    counts: Counter[int] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for h in word_features(word):
            counts[h] += n
    return counted(counts)


def _select(sample: DataFrame, n_positive: int, n_unlabelled: int) -> list[int]:
    """The features that set positive documents most apart: document frequency by log ratio against the unlabelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for positive, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                found = pa.array(sorted(features(text)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([positive] * len(found), pa.bool_()), found], ["positive", "feature"])

    counted = sample.mapInArrow(run, "positive boolean, feature long").groupBy("feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    ratio = (F.col("p") + 0.5) / (n_positive + 1) / ((F.col("u") + 0.5) / (n_unlabelled + 1))
    gain = counted.filter(F.col("p") >= max(3, MIN_SHARE * n_positive)).select("feature", (F.col("p") * F.log(ratio)).alias("gain"))
    return [r["feature"] for r in gain.filter("gain > 0").orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]


def _rows(sample: DataFrame, chosen: list[int]) -> list[tuple[bool, list[int]]]:
    """``(positive, positions of chosen features)`` of the sample."""
    at = {h: k for k, h in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(at[h] for h in features(t) if h in at) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "found"])

    return sorted((r["positive"], list(r["found"])) for r in sample.mapInArrow(run, "positive boolean, found array<int>").collect())


def _matrix(rows: list[list[int]], size: int) -> np.ndarray:
    x = np.zeros((len(rows), size), np.float32)
    for i, found in enumerate(rows):
        x[i, found] = 1
    return x


def risk_parts(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of weights ``w`` (the last is the bias): ``prior * Rp(+)``, ``Ru(-) - prior * Rp(-)``, and their gradients.

    The loss is logistic. ``xp`` and ``xu`` are positive and unlabelled rows, with a last column of ones.
    """
    fp, fu = xp @ w, xu @ w
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    marked, rest = prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return float(marked), float(rest), prior * (xp.T @ (sp - 1)) / len(fp), xu.T @ su / len(fu) - prior * (xp.T @ sp) / len(fp)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, l2: float = 3e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative positive-unlabelled risk under the logistic loss, by Adam.

    The risk is ``prior * Rp(+) + max(0, Ru(-) - prior * Rp(-))``. Where the second term turns negative, the
    unlabelled texts are being overfitted: the step then goes up that term only, as the estimator prescribes.
    """
    x = [np.hstack([m, np.ones((len(m), 1), np.float32)]) for m in (xp, xu)]
    w, m, v = (np.zeros(xp.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    decay = np.full(len(w), l2)
    decay[-1] = 0
    for t in range(1, steps + 1):
        _, rest, grad_pos, grad_rest = risk_parts(w, *x, prior)
        grad = (grad_pos + grad_rest if rest >= 0 else -grad_rest) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, the same whichever way the rows are dealt."""
    return ids.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit to documents labelled 1 and to documents whose label is not looked at.

    The class prior is the share of 1 among the labels outside ``held_out`` (an expression over ``id``). The
    sample is bounded: the ``max_positive`` and ``max_unlabelled`` documents that come first by hash of their
    id. Rows with a null id or label are not learnt from. Without positive documents, the model has no
    weights and scores the prior.
    """
    held = F.lit(False) if held_out is None else held_out
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").filter(~held)
    share = known.agg(F.avg(F.col("y").cast("double")).alias("p")).first()["p"] or 0.0
    prior = min(max(share, 1e-3), 0.5)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = _sample(known.filter("y = 1"), max_positive).withColumn("positive", F.lit(True))
    unmarked = _sample(rows.filter("id is not null").filter(~held), max_unlabelled).withColumn("positive", F.lit(False))
    taken = F.broadcast(marked.union(unmarked))  # at most max_positive + max_unlabelled ids
    sample = materialise(rows.join(taken, "id").select("positive", "text"), "sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    chosen = _select(sample, sizes[True], sizes.get(False, 0)) if sizes.get(True) else []
    if not chosen:
        return Model({}, math.log(prior / (1 - prior)))
    found = _rows(sample, chosen)
    positive, unlabelled = (_matrix([f for p, f in found if p == side], len(chosen)) for side in (True, False))
    weights, bias = fit_nnpu(positive, unlabelled, prior)
    return Model(dict(zip(chosen, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row, over the whole text, 0 to 1; null and empty texts get the score of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(texts(b.column(1)), known), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; the columns stay, and rows with null ids or texts are judged like others.

    A model without weights (too few labels to learn anything from) tells no text from another and rejects none,
    whatever the prior.
    """
    model = fit(docs, labels, None, id_col, text_col)
    if not model.weights:
        return docs
    verdict = fresh_name(docs, "__score")
    schema = docs.select("*", F.lit(0.0).alias(verdict)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in slices(batches):
            yield b.append_column(verdict, pa.array(model.scores(texts(b.column(at)), known), pa.float64()))

    return docs.mapInArrow(run, schema).filter(F.col(verdict) < threshold).drop(verdict)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_FOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row; labels of the held-out fold are not learnt from.

    A null id counts as the empty text for the fold. Repeated rows get a row each, with equal scores. An
    empty table gives an empty result.
    """
    model = fit(docs, labels, is_held_out("id", folds, fold), id_col, text_col)
    return score(docs, model, id_col, text_col).select("id", is_held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
