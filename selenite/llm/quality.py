"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1, the unlabelled sample is web text of any kind, and the class prior is
estimated as the share of labelled rows that are of quality 1. The ridge is chosen by cross-validation of the same risk. The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with the sigmoid loss; where the second part is negative its gradient is turned round. The model is linear in features
of the text's bytes, words and lines and their squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, mix, prefix_hash, span_hash, text_slices, word_spans

#: Bounds of the samples on which the model is fitted: labelled positives, and unlabelled rows.
POSITIVES, UNLABELLED = 20_000, 20_000

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", b" \t\r\x0b\x0c", b".,", b"!", b"|", b"%$#&*^~@", b";:?'\"()-", b"/\\_=+<>[]{}", bytes(range(128, 256))]
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k + 1
N_FEATURES = len(_CLASSES) + 1 + 12


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])][: len(t)]
    return np.bincount(t[new], minlength=n).astype(float)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each of the concatenated texts; all shares are 0 for empty ones."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    of = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(of * (len(_CLASSES) + 1) + _CLASS[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1).astype(float)
    starts, ends, text = word_spans(data, offs)
    words = np.bincount(text, minlength=n).astype(float)
    lower = LOWER[data]
    sums = prefix_hash(lower)
    hashes = mix(span_hash(sums, starts, ends))
    pairs = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    lengths = (ends - starts).astype(float)
    share = lambda a, b: a / np.maximum(b, 1)
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    by_word = lambda flag: share(np.bincount(text[flag], minlength=n), words)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[offs[:-1][size > 0], breaks + 1])
    begin = begin[begin < len(data)]
    line_of = np.searchsorted(offs, begin, "right") - 1
    line_end = np.r_[begin[1:], len(data)][: len(begin)]
    lines = np.bincount(line_of, minlength=n).astype(float)
    letters = counts[:, 1] + counts[:, 2]
    mean = share(np.bincount(text, lengths, n), words)
    spread = np.sqrt(np.maximum(share(np.bincount(text, lengths**2, n), words) - mean**2, 0))
    own = [
        np.log1p(size), np.log1p(words), mean, spread, share(counts[:, 1], letters),
        share(_distinct(text, hashes, n), words),
        share(_distinct(text[pairs], hashes[pairs] * np.uint64(3) + hashes[pairs + 1], n), np.maximum(words - 1, 1)),
        by_word((last >= 6) & (last <= 11)), by_word(lengths == 1), np.log1p(lines), share(words, lines),
        share(_distinct(line_of, span_hash(sums, begin, line_end), n), lines),
    ]
    return np.column_stack([share(counts, size[:, None]), *own]).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch, "text"):
            x = features(data, offs)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), rows], ["key", "doc_id", "x"])


class NonNegativePU:
    """A linear model on standardised features and their squares."""

    def __init__(self, rounds: int = 600, rate: float = 0.05, ridge: float = 3.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge  # the ridge is shared among the positives

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, np.minimum(z * z, 16) / 4])

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> NonNegativePU:
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
        p, u = self._design(positive), self._design(unlabelled)
        w = np.zeros(p.shape[1])
        w[0] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)) / 2
        m, v = np.zeros_like(w), np.zeros_like(w)
        sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        for k in range(1, self.rounds + 1):
            sp, su = sigmoid(p @ w), sigmoid(u @ w)
            slope_p, slope_u = p.T @ (sp * (1 - sp)) / len(p), u.T @ (su * (1 - su)) / len(u)
            negative = su.mean() - prior * sp.mean()  # sigmoid losses of scoring as positive
            grad = -prior * slope_p + (slope_u - prior * slope_p) if negative >= 0 else -(slope_u - prior * slope_p)
            grad = grad + self.ridge / len(p) * np.r_[0, w[1:]]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w - self.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x.astype(np.float64)) @ self.w, -30, 30)))


def _scored(batches: Iterator[pa.RecordBatch], model: NonNegativePU) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(model.score(x))], ["key", "doc_id", "score"])


def held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(key, doc_id, held_out, score, predicted) of every row of docs(doc_id, text), learnt from labels(doc_id, quality).

    Labels of held-out ids are never read. A doc_id with several labels counts as positive if most are 1; null ids and
    qualities are ignored. Samples are those of smallest hash, so that reruns agree. A null text is empty and is scored
    like any other. Without any positives or documents every score is the prior, 0.5 where there are no labels. Other
    columns are not read. key is a hash of id and text.
    """
    model, prior, table = _fitted(docs, labels, positives, unlabelled)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if model is not None:
        scored = table.mapInArrow(partial(_scored, model=model), f"key long, doc_id {id_type}, score double")
    else:
        scored = table.select("key", "doc_id", F.lit(prior).alias("score"))
    return scored.select("key", "doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _fitted(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[NonNegativePU | None, float, DataFrame]:
    """The model (none without samples), the prior, and the features of all rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    table = materialize(rows.mapInArrow(_featured, f"key long, doc_id {id_type}, x array<float>"), "features")
    known = labels.where("doc_id is not null and quality is not null").where(~held_out_column()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("q"))
    stats = known.agg(F.avg((F.col("q") > 0.5).cast("double")).alias("prior"), F.count(F.lit(1)).alias("n")).first()
    prior = min(0.99, max(0.01, stats.prior)) if stats.n else 0.5
    by_hash = F.xxhash64(F.lit(17), "key")

    def sample(df: DataFrame, n: int) -> np.ndarray:
        """The rows of smallest hash, n at most. Only about n rows in all are sent by the tasks, however many there are."""
        share = (1.05 * n + 100) / max(1, df.count())
        near = df.where(F.pmod(by_hash, F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
        return np.array([r.x for r in near.orderBy(F.pmod(by_hash, F.lit(1 << 40)), "key").select("x").limit(n).collect()], np.float64).reshape(-1, N_FEATURES)

    trusted = sample(table.join(known.where("q > 0.5").select("doc_id"), "doc_id", "left_semi"), positives)
    web = sample(table, unlabelled)
    if not len(trusted) or not len(web):
        return None, prior, table
    return NonNegativePU(ridge=chosen_ridge(trusted, web, prior)).fit(trusted, web, prior), prior, table


def chosen_ridge(trusted: np.ndarray, web: np.ndarray, prior: float, ridges: tuple[float, ...] = (0.3, 1.0, 3.0, 5.0, 10.0), folds: int = 10, most: int = 2000) -> float:
    """The ridge of least non-negative risk (of wrong signs) in cross-validation; of equal ones the largest.

    Validation is over the first rows of both samples, which are in the order of their hashes, so that these are samples too.
    """
    p, u = trusted[:most], web[:most]
    if min(len(p), len(u)) < 2 * folds:
        return max(ridges)
    risks = []
    for ridge in ridges:
        risk = 0.0
        for k in range(folds):
            test_p, test_u = np.arange(len(p)) % folds == k, np.arange(len(u)) % folds == k
            model = NonNegativePU(rounds=300, ridge=ridge).fit(p[~test_p], u[~test_u], prior)
            missed, taken = (model.score(p[test_p]) < 0.5).mean(), (model.score(u[test_u]) >= 0.5).mean()
            risk += prior * missed + max(0.0, taken - prior * (1 - missed))
        risks.append(risk)
    return max(r for r, risk in zip(ridges, risks, strict=True) if risk <= min(risks) + 1e-9)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier predicts to be of quality 1, repeated ones and all their columns as they are.

    Null and empty texts are scored like any other. Without positives all stay if the prior is a half or more, else none.
    """
    model, prior, _ = _fitted(docs, labels, POSITIVES, UNLABELLED)
    if model is None:
        return docs if prior >= 0.5 else docs.limit(0)
    return docs.mapInArrow(partial(_kept, model=model), docs.schema)


def _kept(batches: Iterator[pa.RecordBatch], model: NonNegativePU) -> Iterator[pa.RecordBatch]:
    """The rows whose text is scored as good: texts are scored where they are read, and never shuffled."""
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch, "text"):
            yield batch.slice(lo, hi - lo).filter(pa.array(model.score(features(data, offs)) >= 0.5))
