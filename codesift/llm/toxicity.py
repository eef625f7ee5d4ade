"""Toxicity by a classifier chain.

One linear (logistic) model per category, in order; the model of a category also sees the
probabilities of the categories before it.  These are out-of-fold when a later model is
trained: every training row's probability comes from a model that saw neither the row nor
its copies.
Features are words and the beginnings of words that tell the categories apart, chosen by
how far their shares within and without a category differ; values are densities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.session import durable

#: Bounds of the fit: labelled documents (about), features per category, folds.
SAMPLE, FEATURES, FOLDS = 8_000, 500, 5
#: Words of the runs by which copies are put into one fold.
SHINGLE = 5
#: Least documents of a category that a feature must occur in; lengths of word beginnings.
LEAST, STEMS = 3, (3, 4, 5, 6)
RIDGE = 1e-3
#: Least distance of a feature's shares within and without a category, in standard errors.
LEAST_SCORE = 5.0
_WORD, _UPPER = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-ÖØ-Þ]")
_TABLE, _SLICE = 1 << 18, 1 << 20


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


def words_of(text: str) -> Counter[str]:
    """Counts of the words (runs of letters) of a text in lower case, and marks of its layout; very long texts in slices."""
    found: Counter[str] = Counter()
    words = upper = letters = begin = 0
    while begin < len(text):
        end = begin + _SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        part = text[begin:end]
        listed = _WORD.findall(part.lower())
        words, letters, upper = words + len(listed), letters + sum(map(len, listed)), upper + len(_UPPER.findall(part))
        found.update(listed)
        begin = end
    layout = (("~upper", 2 * upper > letters), ("~marks", 10 * letters < 7 * len(text)), ("~repeats", words >= 20 and 3 * len(found) < words))
    found.update({name: words for name, holds in layout if holds})
    return found


def vector(text: str, columns_of: Callable[[str], Iterable[int]]) -> tuple[list[int], list[float]]:
    """Columns and values of a text: how often a feature occurs, over the root of the number of words."""
    words = words_of(text)
    values: dict[int, int] = {}
    total = 0
    for word, n in words.items():
        total += n
        for column in columns_of(word):
            values[column] = values.get(column, 0) + n
    columns = sorted(values)
    return columns, [values[c] / max(total, 1) ** 0.5 for c in columns]


def _counted(categories: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents of a task that have a feature: all, and of each category."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {c: Counter() for c in ["documents", *categories]}
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                found = {f for w in words_of(text) for f in features_of(w)}
                for name, counter in totals.items():
                    if name == "documents" or batch[name].iat[i]:
                        counter.update(found)
        if not totals["documents"]:
            return
        frame = pd.DataFrame({"feature": list(totals["documents"])})
        for name, counter in totals.items():
            frame[f"n_{name}"] = [counter[f] for f in frame["feature"]]
        yield frame

    return count


def _listed(columns: dict[str, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text")
            rows = [vector(t, lambda w: [columns[f] for f in features_of(w) if f in columns]) for t in texts]
            batch["columns"], batch["values"] = [r[0] for r in rows], [r[1] for r in rows]
            yield batch

    return listed


@dataclass
class Model:
    """features with their columns; per category weights (features, then earlier probabilities, then constant) and threshold."""

    categories: list[str]
    columns: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)


class Rows:
    """Sparse rows with dense columns beside them."""

    def __init__(self, columns: list[list[int]], values: list[list[float]], width: int) -> None:
        self.row = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
        self.column = np.fromiter((c for x in columns for c in x), np.int64, len(self.row))
        self.value = np.fromiter((c for x in values for c in x), float, len(self.row))
        self.n, self.width = len(columns), width
        self.dense = np.ones((self.n, 1))

    def add(self, column: np.ndarray) -> None:
        self.dense = np.column_stack([self.dense[:, :-1], column, self.dense[:, -1]])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, minlength=self.n) + self.dense @ w[self.width :]

    def filled(self) -> np.ndarray:
        """As one dense matrix."""
        dense = np.zeros((self.n, self.width))
        dense[self.row, self.column] = self.value
        return np.column_stack([dense, self.dense])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of balanced, ridge-penalised logistic regressions by accelerated gradient steps.

    One regression per column of ``use``, on the rows that it marks, all in the same steps;
    the last column of ``x`` is the constant.
    """
    yes, no = (use & y[:, None]).sum(0), (use & ~y[:, None]).sum(0)
    weight = np.where(use, np.where(y[:, None], 0.5 / np.maximum(yes, 1), 0.5 / np.maximum(no, 1)), 0.0)
    # A bound of the curvature in each column; the logistic function bends by 1/4 at most.
    step = 4 / np.maximum(x.T @ (weight * x.sum(1)[:, None]), 1e-6)
    ridge = RIDGE / step
    ridge[-1] = 0
    w = np.zeros_like(step)
    at, momentum = w, 1.0
    for _ in range(steps):
        new = at - step * (x.T @ (weight * (sigmoid(x @ at) - y[:, None])) + ridge * at)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    one_sided = (yes == 0) | (no == 0)
    w[:, one_sided] = 0
    w[-1, one_sided] = np.where(yes > 0, 10.0, -10.0)[one_sided]
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the worse of the two error rates is least, in the middle of the widest gap."""
    at = np.unique(np.round(p, 6))
    if len(at) < 2 or not y.any() or y.all():
        return 0.5
    cuts = (at[1:] + at[:-1]) / 2
    yes, no = np.sort(p[y]), np.sort(p[~y])
    worst = np.maximum(np.searchsorted(yes, cuts) / len(yes), 1 - np.searchsorted(no, cuts) / len(no))
    best = np.flatnonzero(worst <= worst.min() + 1e-9)
    return float(cuts[max(best, key=lambda i: (at[i + 1] - at[i], i))])


def fold_of(text: Column, folds: int = FOLDS) -> Column:
    """Fold of a text: the least hash of its runs of ``SHINGLE`` words (of all its words, if they are fewer).

    Exact copies share a fold; texts that have a share of their runs in common do so with
    that probability or by chance, so that probabilities are out of fold for copies too.
    """
    words = F.array(F.split(F.lower(text), r"\s+"))

    def least(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        return F.array_min(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])))

    # Within the lambda the words are a value; as an expression they would be split anew for every run.
    return F.pmod(F.transform(words, least)[0], F.lit(folds)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit the chain on ``docs(doc_id, text)`` and ``labels(doc_id, ...)``.

    ``categories``: boolean columns of ``labels`` by name, in the order of the chain; null
    is false.  About ``sample`` labelled documents, drawn by a hash of doc_id, are used;
    their counts of features and lists of chosen features come to the driver, never texts;
    there they are a matrix of 2 * sample rows and features * categories columns at most.
    Folds go by text (``fold_of``).  A document labelled twice has a category if either label has it.  Without labels the
    model predicts probability 0.
    """
    names = list(categories)
    truth = [F.coalesce(F.max(expr), F.lit(False)).alias(name) for name, expr in categories.items()]
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*truth)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < min(1.0, sample / max(rows.count(), 1))).orderBy("doc_id").limit(2 * sample)
    # At most twice ``sample`` rows of a few bytes.
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = durable(drawn.withColumn("fold", fold_of(F.col("text"))).repartition("doc_id"))
    schema = ", ".join(["feature string", "n_documents long", *[f"n_{c} long" for c in names]])
    counts = texts.select("text", *names).mapInPandas(_counted(names), schema).groupBy("feature")
    counts = counts.agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in ["documents", *names]]).where(F.col("n_documents") >= LEAST)
    counts = durable(counts)
    total = texts.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in names]).first()
    model = Model(names)
    chosen: set[str] = set()
    for c in names:
        yes, no = total[c], total["n"] - total[c]
        if not yes or not no:
            continue
        share = F.col("n_documents") / total["n"]
        spread = F.sqrt(share * (1 - share) * (1 / yes + 1 / no) + 1e-12)
        score = F.abs(F.col(f"n_{c}") / yes - (F.col("n_documents") - F.col(f"n_{c}")) / no) / spread
        chosen |= {r["feature"] for r in counts.select("feature", F.round(score, 9).alias("s")).where(F.col("s") >= LEAST_SCORE).orderBy(F.col("s").desc(), "feature").limit(features).collect()}
    model.columns = {f: i for i, f in enumerate(sorted(chosen))}
    schema = ", ".join(["doc_id long", "fold int", *[f"{c} boolean" for c in names], "columns array<int>", "values array<double>"])
    got = texts.select("doc_id", "fold", *names, "text").mapInPandas(_listed(model.columns), schema).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    x = Rows(list(got["columns"]), list(got["values"]), len(model.columns)).filled()
    fold = got["fold"].to_numpy(int)
    use = np.column_stack([np.ones(len(got), bool), *[fold != k for k in range(FOLDS)]])
    for c in names:
        y = got[c].to_numpy(bool)
        w = logistic(x, y, use)
        held_out = sigmoid(x @ w)[np.arange(len(got)), 1 + fold]
        model.weights.append(w[:, 0])
        model.thresholds.append(_threshold(held_out, y))
        x = np.insert(x, -1, held_out, axis=1)
    return model


def predict(text: Column, model: Model) -> Column:
    """Struct of the probabilities ``p_<category>`` of a text column, null texts as empty."""
    kind = "struct<" + ",".join(f"p_{c}:double" for c in model.categories) + ">"

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        width, columns = len(model.columns), model.columns
        known: dict[str, tuple[int, ...]] = {}

        def columns_of(word: str) -> tuple[int, ...]:
            if (at := known.get(word)) is None:
                at = known[word] = tuple(columns[f] for f in features_of(word) if f in columns)
            return at

        for texts in batches:
            rows = [vector(text, columns_of) for text in texts]
            if len(known) > _TABLE:
                known.clear()
            matrix = Rows([r[0] for r in rows], [r[1] for r in rows], width)
            out = {}
            for c, w in zip(model.categories, model.weights, strict=True):
                p = np.round(sigmoid(matrix.times(w)), 9)
                out[f"p_{c}"] = p
                matrix.add(p)
            yield pd.DataFrame(out)

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_<category> and <category> (boolean) of every row of ``docs(doc_id, text)``.

    Texts that are null, empty or hold no known feature get the models' base
    probabilities; very long texts are scored whole.  Repeated rows are scored alike, rows
    without doc_id too; other columns are not read.  An empty table gives an empty result.
    """
    scored = docs.select("doc_id", predict(F.col("text"), model).alias("_p")).select("doc_id", "_p.*")
    return scored.select("*", *[(F.col(f"p_{c}") > t).alias(c) for c, t in zip(model.categories, model.thresholds, strict=True)])
