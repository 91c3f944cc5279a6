"""Operator 8: quality classifier, a regularised quadratic discriminant over document statistics.

Statistics of the whole text (character classes, word lengths, repetition) are transformed to roughly normal shape and
held within four pooled deviations of the pooled mean. Sums and cross products per class come from one aggregation over
all labelled rows. Class covariances shrink towards the pooled covariance and that towards a multiple of the identity;
their Cholesky factors are computed once and shipped with the model. A score is the logistic of the difference of the log
densities, which are Mahalanobis distances under the factors, plus the log prior ratio.

Defined cases: a null text is empty and is scored like any other; labels that are null, other than 0 or 1, or contradict
each other for one doc_id take no part; repeated label rows count once; if a class has no rows, every score is the share
of label 1 (one half without labels); an empty table gives an empty result; a null doc_id is scored and never a label.
Learning takes every labelled row: there is no sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from curatrix.llm.common import blocks, byte_view, id_and_text, remainder, stored

STATS = ("log_words", "upper", "digits", "symbols", "stops", "log_word_len", "word_len_dev", "fresh_words", "same_as_before", "top_word", "fresh_lines", "symbol_ends")
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.intp)  # 0 other, 1 lower case or non-ASCII letter byte, 2 upper case, 3 digit, 4 symbol, 5 stop, 6 white
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_CLASS[128:] = 1
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 3
_CLASS[np.frombuffer(b"!\"#$%&'()*+-/<=>?@[\\]^_`{|}~", np.uint8)] = 4
_CLASS[np.frombuffer(b".,:;", np.uint8)] = 5
_CLASS[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = 6


_IS_CLASS = np.eye(8, dtype=np.int64)[_CLASS]


def _logit(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.005) / (1.005 - share))


def _measures(text: str) -> tuple[float, ...]:
    """Number of words, mean and deviation of their lengths, distinct words, words equal to the one before, copies of the most frequent, shares of distinct lines and of distinct words that end in a symbol."""
    words = text.split()
    seen = Counter(words)
    long = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    mean = np.add.reduce(long) / len(long)
    long -= mean
    lines = [x for x in text.split("\n") if x]
    last = Counter(map(itemgetter(-1), seen))
    ends = sum(k for c, k in last.items() if not c.isalnum() and c not in ".,:;")
    return (
        len(words), mean, np.sqrt(np.add.reduce(long * long) / len(long)), len(seen), sum(map(eq, words, islice(words, 1, None))), max(seen.values(), default=0),
        len(set(lines)) / len(lines) if lines else 1.0, ends / max(1, len(seen)),
    )


def statistics(texts: list[str], bytes_of: list[np.ndarray]) -> np.ndarray:
    """The transformed statistics of each text; ``bytes_of`` holds its UTF-8 bytes."""
    counts = np.zeros((len(texts), 8))
    for i, data in enumerate(bytes_of):
        counts[i] = np.bincount(data, minlength=256) @ _IS_CLASS
    size = np.maximum(1, counts.sum(1) - counts[:, 6])
    words, mean, dev, distinct, same, top, lines, ends = np.array([_measures(t) for t in texts], np.float64).reshape(-1, 8).T
    n = np.maximum(1, words)
    return np.column_stack([
        np.log1p(words), *[_logit(counts[:, k] / size) for k in (2, 3, 4, 5)], np.log1p(mean), np.log1p(dev),
        np.log((distinct + 1) / (n + 1)) / np.log(n + 2), _logit(same / n), _logit(top / n), _logit(lines), _logit(ends),
    ])


def _statistics_batches(batches):
    for batch in batches:
        data, offsets = byte_view(batch.column("text"))
        texts = batch.column("text")
        for first, last in blocks(offsets, 4 << 20):
            x = statistics([texts[i].as_py() for i in range(first, last)], [data[offsets[i] : offsets[i + 1]] for i in range(first, last)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *[pa.array(x[:, j]) for j in range(len(STATS))]], ["doc_id", *STATS])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double column per statistic."""
    return id_and_text(docs).mapInArrow(_statistics_batches, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants by class; ``constant`` where a class has no rows."""

    low: np.ndarray
    high: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    inverse: tuple[np.ndarray, np.ndarray] | None
    offset: float
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        x = np.clip(x, self.low, self.high)
        far = [(((x - m) @ inv.T) ** 2).sum(1) for m, inv in zip(self.means, self.inverse, strict=True)]
        return 1 / (1 + np.exp(np.clip(-(self.offset + 0.5 * (far[0] - far[1])), -500, 500)))


def fit(labelled: DataFrame, to_pooled: float = 0.3, to_identity: float = 0.02) -> Discriminant:
    """Fit on rows of statistics with a 0/1 column ``quality``; everything that leaves Spark is one row per class."""
    d = len(STATS)
    edge = labelled.agg(F.count("*").alias("n"), F.avg("quality").alias("share"), *[f(s).alias(f"{n}{i}") for i, s in enumerate(STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not edge["n"]:
        return Discriminant(np.zeros(d), np.zeros(d), None, None, 0.0, 0.5)
    mean, dev = (np.array([edge[f"{k}{i}"] for i in range(d)]) for k in "ms")
    low, high = mean - 4 * dev, mean + 4 * dev
    held = labelled.select("quality", *[F.least(F.greatest(F.col(s), F.lit(float(a))), F.lit(float(b))).alias(s) for s, a, b in zip(STATS, low, high, strict=True)])
    shift = [F.col(s) - F.lit(float(m)) for s, m in zip(STATS, mean, strict=True)]
    rows = held.groupBy("quality").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"a{i}") for i, x in enumerate(shift)], *[F.sum(shift[i] * shift[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]).collect()
    by = {int(r["quality"]): r for r in rows}
    if len(by) < 2:
        return Discriminant(low, high, None, None, 0.0, float(edge["share"]))
    n = [by[k]["n"] for k in (0, 1)]
    centre = [np.array([by[k][f"a{i}"] for i in range(d)]) / by[k]["n"] for k in (0, 1)]
    scatter = []
    for k in (0, 1):
        square = np.array([[by[k][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        scatter.append(square - n[k] * np.outer(centre[k], centre[k]))
    pooled = sum(scatter) / sum(n)
    inverse, logdet = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * np.diag(np.maximum(np.diag(pooled), 1e-6))
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    offset = float(np.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1]))
    return Discriminant(low, high, (mean + centre[0], mean + centre[1]), (inverse[0], inverse[1]), offset, 0.5)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the rows that may be learned from, once each, without contradictions."""
    fit_for = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(5) != 0))
    return fit_for.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("__most")).where("quality = __most").drop("__most")


def learn(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of all labelled documents that may be learned from."""
    if all(isinstance(df.schema["doc_id"].dataType, IntegralType) for df in (docs, labels)):
        docs = docs.where(remainder(5) != 0)  # the others have no such label, so their statistics are not needed
    return fit(stored(document_statistics(docs).join(training_labels(labels), "doc_id"), "quality-labelled"))


def accepted(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; the text is scored where it stands."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for first in range(0, len(texts), 256):
            some = texts.iloc[first : first + 256].tolist()
            out.append(model.scores(statistics(some, [np.frombuffer(text.encode(), np.uint8) for text in some])))
        return pd.Series(np.concatenate(out))

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = stored(document_statistics(docs), "quality-statistics")
    model = fit(stats.join(training_labels(labels), "doc_id"))

    def scored(batches):
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy() for s in STATS])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    found = stats.mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
