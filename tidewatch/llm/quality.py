"""Document quality: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, training_row

#: Labelled rows that the model is fitted on at most: those with the least hash of their id.
MAX_TRAIN_ROWS = 20_000
#: A document is kept from this score on.
ACCEPT = 0.3
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "sign": b"#$%&*+=@^_~\\/<>{}[]", "quote": b"\"'`()-",
    "high": bytes(range(128, 256)), "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}
FEATURES = [
    *BYTE_CLASSES, "log_chars", "log_words", "log_lines", "chars_per_word", "chars_per_line", "longest_word",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "distinct_lines", "capital_words", "blank_lines",
]
_MEMBERS = np.array([[b in group for b in range(256)] for group in BYTE_CLASSES.values()], float).T


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros only."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    classes = (np.bincount(raw, minlength=256) @ _MEMBERS / len(raw)).tolist()
    words, lines = text.split(), text.split("\n")
    n, m = max(len(words), 1), len(lines)
    counts = Counter(words)
    after = words[1:]
    return [
        *classes, np.log1p(len(text)), np.log1p(len(words)), np.log1p(m), sum(map(len, words)) / n, len(text) / m,
        float(max(map(len, words), default=0)), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, after)) / n, len(set(zip(words, after))) / max(n - 1, 1), len(set(lines)) / m,
        sum(map(str.istitle, counts)) / max(len(counts), 1), sum(not x or x.isspace() for x in lines) / m,
    ]


@dataclass
class Trees:
    """Complete binary trees as arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; values above it go right
    leaf: np.ndarray       # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, all rows of a tree level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64,
              rate: float = 0.15, ridge: float = 2.0, least_rows: int = 8) -> Trees:
    """Boosting on the logistic loss; splits are found on histograms of quantile bins.

    Without rows, or with one label only, the score is the smoothed share of label 1.
    """
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width, n_features = bins + 1, x.shape[1]
    score = np.full(len(y), base)
    out_f, out_t, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = node - first
            g, h, c = (np.zeros((many, n_features, width)) for _ in range(3))
            for f in range(n_features):
                key = place * width + binned[:, f]
                for into, weight in ((g, grad), (h, hess), (c, None)):
                    into[:, f] = np.bincount(key, weight, many * width).reshape(many, width)
            g, h, c = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g)**2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(c < least_rows) | (ct - c < least_rows)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_at = node - inner
        leaf = -rate * np.bincount(leaf_at, grad, inner + 1) / (np.bincount(leaf_at, hess, inner + 1) + ridge)
        score += leaf[leaf_at]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_l), base)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label (0 or 1) of the documents that may be learnt from, max_rows at most.

    A document with several labels takes the largest; null labels and ids are no labels.
    The ids are max_rows at most, so their broadcast is bounded by that.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(training_row("__id") & F.col("__label").isNotNull())
        .groupBy("__id").agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "__id").select("__id", "text", F.col("__label").alias("label"))


def text_batches(spark) -> None:
    """Few texts to a batch of a pandas UDF, as any of them may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return measure(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most max_rows labelled documents whose crc32(id) mod 5 is not 0.

    Only the statistics of that bounded sample come to the driver: 24 numbers a row.
    """
    text_batches(docs.sparkSession)
    sample = labelled(docs, labels, label, max_rows, id_col, text_col)
    rows = (
        sample.select("__id", statistics_column(F.col("text")).alias("x"), "label")
        .orderBy(F.xxhash64("__id"), "__id", "x").limit(max_rows).toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["label"].to_numpy(float))


def score_column(model: Trees, text: Column | str) -> Column:
    """The probability of label 1 for each text; null counts as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    column = F.col(text) if isinstance(text, str) else text
    return score(F.coalesce(column.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text",
                    accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, repeated rows included.

    A null or empty text is scored as a text with all statistics zero; a null id is not held
    out (null). Other columns are not looked at.
    """
    text_batches(docs.sparkSession)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), score_column(model, text_col).alias("score"))
    return rows.select(
        "doc_id", (~training_row("doc_id")).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Trees, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    text_batches(docs.sparkSession)
    return docs.where(score_column(model, text_col) >= accept)
