"""Toxicity by weak supervision: voters, a label model, and a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import training_row
from .quality import labelled, text_batches

#: Labelled rows from which lexicons are mined, and rows the classifier is fitted on, at most.
MAX_TRAIN_ROWS = 20_000
ACCEPT = 0.5
WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that lexicons hold, besides whole words.
STEMS = (3, 4, 5, 6, 7, 8)
#: A lexicon entry is in so many toxic documents at least, and so many of its documents are toxic.
SUPPORT, SURE, DOUBTFUL = 6, 0.95, 0.5
#: Common insults, the lexicon that needs no labels.
INSULTS = frozenset(
    "bastard clown creep dimwit disgusting dumb filth fool garbage hate idiot idiots imbecile jerk kill liar "
    "loser losers moron morons pathetic pig scum shit shut sick stupid subhuman trash ugly vermin worthless".split()
)
PROFANITY = frozenset("arse arsehole ass asshole bitch bollocks bullshit crap cunt damn dick fuck fucked fucker fucking piss prick shit twat wanker whore".split())
#: Patterns that need no labels either, looked for in lower-case text.
PATTERNS = {
    "address": re.compile(r"\b(?:you(?: are|'re|\u2019re)?|u r) (?:an? |all |such an? |just an? |so )?(?:" + "|".join(sorted(INSULTS)) + r")\b"),
    "threat": re.compile(r"\b(?:(?:i will|i'll|we will|we'll|gonna|going to) (?:kill|hurt|beat|shoot|find) (?:you|him|her|them)|kill yourself|drop dead|go to hell)\b"),
    "hatred": re.compile(r"\b(?:(?:i|we|everyone) hates? (?:you|him|her|them|those|these)|shut (?:up|your mouth)|get lost)\b"),
    "masked": re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*"),
}
#: What the fixed lexicons and patterns weigh in the classifier before any row is seen.
MARK_WEIGHT = 3.0


def entries(text: str) -> set[str]:
    """Distinct lower-case words and their beginnings; those end in a hyphen."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "-" for w in words if len(w) >= n])
    return out


def mine_lexicon(sample: DataFrame, support: int = SUPPORT, doubtful: float = DOUBTFUL) -> dict[str, float]:
    """Entries and the share of toxic documents among those that have them, from labelled rows.

    Entries in fewer toxic documents, or mostly in others, stay away. The result is bounded
    by the size of the sample.
    """
    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([list(entries(t)) for t in texts])

    counted = (
        sample.select("label", F.explode(find("text")).alias("entry"))
        .groupBy("entry").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
        .where((F.col("toxic") >= support) & (F.col("toxic") >= doubtful * F.col("n")))
    )
    return {r.entry: r.toxic / r.n for r in counted.collect()}


MARKS = ("#insults", "#profanity", *("#" + p for p in PATTERNS))


def marks(text: str) -> list[str]:
    """Which fixed lexicons and patterns a text hits."""
    lower = text.lower()
    words = set(WORD.findall(lower))
    out = ["#insults"] * (not INSULTS.isdisjoint(words)) + ["#profanity"] * (not PROFANITY.isdisjoint(words))
    return out + ["#" + name for name, pattern in PATTERNS.items() if pattern.search(lower)]


VOTERS = (*MARKS, "words", *(f"stem{n}" for n in STEMS), "several", "doubtful", "nothing")


def votes(found: list[str], lexicon: dict[str, float], hit: list[str]) -> tuple[int, ...]:
    """What each of VOTERS says of the lexicon entries a text has: 1, 0, or -1 for no opinion."""
    sure = [e for e in found if lexicon[e] >= SURE]
    lengths = {len(e) - 1 for e in sure if e[-1] == "-"}
    roots = {e[:STEMS[0]] for e in sure}
    says = [
        *(m in hit for m in MARKS), any(e[-1] != "-" for e in sure), *(n in lengths for n in STEMS), len(roots) > 1,
        len(found) > len(sure) == 0,
    ]
    return (*(1 if s else -1 for s in says), 0 if not found and not hit else -1)


@dataclass
class LabelModel:
    """P(toxic), and for each voter its table P(vote | label) and the weight its votes keep.

    A voter without an opinion says nothing either way.
    """

    prior: float
    tables: np.ndarray   # voter x label x (no opinion, 0, 1)
    weights: np.ndarray
    correlations: np.ndarray

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        log = np.log([1 - self.prior, self.prior])[None, :]
        for j, table in enumerate(self.tables):
            says = np.log(table[:, ballots[:, j] + 1]).T
            log = log + self.weights[j] * np.where(ballots[:, j:j + 1] >= 0, says, 0.0)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)


def fit_label_model(ballots: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximization over distinct ballots and how often each was cast.

    known: how many labelled rows of a ballot are clean and toxic. They start the accuracies
    and stay in them, so that the classes keep their meaning; the rest is agreement.
    Voters that agree more than their accuracies explain are correlated given the label;
    each keeps 1 / (1 + its summed correlations) of its say, so that copies count once.
    """
    m = ballots.shape[1]
    share = (known.sum(0) + 0.5) / (known.sum() + 1)
    post = (known[:, 1] + 2 * share[1]) / (known.sum(1) + 2)
    model = LabelModel(0.1, np.zeros((m, 2, 3)), np.ones(m), np.zeros((m, m)))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts]) + known.T
        model.prior = float(np.clip(weight[1].sum() / max(weight.sum(), 1), 1e-4, 1 - 1e-4))
        for j in range(m):
            table = np.stack([np.bincount(ballots[:, j] + 1, w, 3) for w in weight]) + 0.5
            model.tables[j] = table / table.sum(1, keepdims=True)
        model.correlations = conditional_correlations(ballots, weight)
        model.weights = 1 / (1 + np.abs(model.correlations).sum(1) - np.abs(np.diag(model.correlations)))
        updated = model.posterior(ballots)
        if np.abs(updated - post).max(initial=0) < 1e-6:
            break
        post = updated
    return model


def conditional_correlations(ballots: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Correlations of the votes within a label, averaged by the labels' weights."""
    out = np.zeros((ballots.shape[1],) * 2)
    for w in weight:
        if w.sum() <= 0:
            continue
        centred = ballots - np.average(ballots, axis=0, weights=w)
        cov = (centred * w[:, None]).T @ centred / w.sum()
        scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        out += w.sum() / weight.sum() * np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-12)
    return out


@dataclass
class Linear:
    """Weights of lexicon entries and of MARKS, and the intercept."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        known = self.weights
        total = self.bias + sum(known.get(m, 0.0) for m in marks(text))
        words = set(WORD.findall(text.lower()))
        seen = set()
        for w in words:
            if w in known:
                total += known[w]
            for n in STEMS:
                if len(w) >= n and (e := w[:n] + "-") in known and e not in seen:
                    seen.add(e)
                    total += known[e]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_linear(rows: list[list[int]], target: np.ndarray, names: list[str], ridge: float = 1e-3,
               steps: int = 300, prior: dict[str, float] | None = None) -> Linear:
    """Logistic regression of soft targets on which entries a text has, by Adam on all rows.

    prior: weights that the ridge pulls to instead of 0; they stay where no row has the entry."""
    lengths = np.array([len(r) for r in rows], int)
    cols = np.array([c for r in rows for c in r], int)
    owner = np.repeat(np.arange(len(rows)), lengths)
    centre = np.array([(prior or {}).get(n, 0.0) for n in names])
    w, bias = centre.copy(), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1 if len(rows) else 1):
        z = bias + np.bincount(owner, w[cols], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.append(np.bincount(cols, error[owner], len(names)) + ridge / len(rows) * (w - centre), error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Linear({n: float(x) for n, x in zip(names, w) if abs(x) > 1e-4}, float(bias))


def cast_votes(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """docs with two more columns: __votes (one number per voter) and __found (lexicon entries and MARKS)."""
    @F.pandas_udf("votes array<int>, found array<string>")
    def cast(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                found, hit = sorted(entries(t) & lexicon.keys()), marks(t)
                out.append(([int(v) for v in votes(found, lexicon, hit)], found + hit))
            yield pd.DataFrame(out, columns=["votes", "found"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("__cast", cast(text)).select(
        "*", F.col("__cast.votes").alias("__votes"), F.col("__cast.found").alias("__found")
    ).drop("__cast")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """The classifier, from at most max_rows labelled documents whose crc32(id) mod 5 is not 0.

    Labels tell which words the mined lexicons hold and start the label model, which then sees
    how the voters agree; the classifier is fitted on its posteriors alone. Fixed lexicons and
    patterns vote and are features too, with a weight of their own where no labelled row has them.
    """
    text_batches(docs.sparkSession)
    sample = labelled(docs, labels, label, max_rows, id_col, text_col)
    lexicon = mine_lexicon(sample)
    rows = (
        cast_votes(sample, lexicon).select("__id", "__votes", "__found", "label")
        .orderBy(F.xxhash64("__id"), "__id", "__found").limit(max_rows).toPandas()
    )
    if rows.empty:
        return Linear({m: MARK_WEIGHT for m in MARKS}, -2.0)
    ballots = np.array(rows["__votes"].tolist(), int)
    distinct, inverse, counts = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    toxic = np.bincount(inverse, rows["label"].to_numpy(float), len(distinct))
    known = np.stack([counts - toxic, toxic], axis=1)
    target = fit_label_model(distinct, counts, known).posterior(distinct)[inverse]
    names = [*MARKS, *sorted(lexicon)]
    at = {n: i for i, n in enumerate(names)}
    return fit_linear([[at[e] for e in r] for r in rows["__found"]], target, names, prior={m: MARK_WEIGHT for m in MARKS})


def score_column(model: Linear, text: Column | str) -> Column:
    """The probability that a text is toxic; null counts as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    column = F.col(text) if isinstance(text, str) else text
    return score(F.coalesce(column.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text",
                    accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, repeated rows included.

    A null or empty text gets the score of a text without any lexicon entry; a null id is
    not held out (null). Other columns are not looked at.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(model, text_col).alias("score"))
    return rows.select(
        "doc_id", (~training_row("doc_id")).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )
