"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over hashed buckets: the raw model counts all documents, the
target model the documents labelled good.  N-grams are words, pairs of words, and pairs and
triples of word shapes (kinds of characters, and whether the word repeats the one before),
so that layout and noise count beside vocabulary.  The importance weight of a document is
the ratio of its probabilities under the two models, as that of a text of LENGTH n-grams
of the same kind, so that long texts do not decide by their length.  Documents are drawn
without replacement in proportion to the weights by Gumbel top-k: the k largest sums of a
log weight and standard Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.batches import bound_batches, give_back
from codesift.llm.words import constants, mix, word_hashes
from codesift.operators.ranking import number_within
from codesift.session import durable

BITS = 16
#: Labelled documents the target model and the cut are fitted on, at most (about).
SAMPLE = 20_000
#: Count added to every bucket of both models, so that rare n-grams weigh little.
SMOOTH = 1.0
#: A good document lost counts as much as so many bad ones kept.
LOSS = 10
#: N-grams of the text whose importance weight a document has.
LENGTH = 8
#: Most n-grams that are counted at once.
_BLOCK = 2000
_KEYS = constants(8, 3)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and, for each, the number of its text."""
    words, shapes, counts = word_hashes(texts, shapes=True)
    text = np.repeat(np.arange(len(texts)), counts)
    shapes = shapes.copy()
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes[again] = mix(shapes[again] + np.uint64(1))
    two, three = text[1:] == text[:-1], text[2:] == text[:-2]
    found = [
        (words, text),
        ((words[:-1] * _KEYS[0] + words[1:] * _KEYS[1])[two], text[1:][two]),
        (shapes * _KEYS[2], text),
        ((shapes[:-1] * _KEYS[3] + shapes[1:] * _KEYS[4])[two], text[1:][two]),
        ((shapes[:-2] * _KEYS[5] + shapes[1:-1] * _KEYS[6] + shapes[2:] * _KEYS[7])[three], text[2:][three]),
    ]
    buckets = mix(np.concatenate([x for x, _ in found])) >> np.uint64(64 - BITS)
    return buckets.astype(np.int64), np.concatenate([t for _, t in found])


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > 1 << 19 or len(held) >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of buckets per group (0: all, 1: target) of a task."""
    totals = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        good = batch["good"].to_numpy(bool)
        for group, rows in ((0, batch["text"]), (1, batch["text"][good])):
            for block in _blocks(list(rows)):
                totals[group] += np.bincount(_grams(block)[0], minlength=1 << BITS)
    give_back()
    group, bucket = np.nonzero(totals)
    yield pd.DataFrame({"group": group, "bucket": bucket, "n": totals[group, bucket]})


@dataclass
class Model:
    """Log ratio of target and raw probability per bucket; ``cut`` of the mean log weight."""

    ratio: np.ndarray
    cut: float = 0.0


def log_weight(text: Column, model: Model) -> Column:
    """Mean log ratio of a text's n-grams; 0 for texts without words."""
    ratio = model.ratio.astype(np.float32)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for block in _blocks(list(texts)):
                buckets, at = _grams(block)
                n = np.bincount(at, minlength=len(block))
                out.append(np.bincount(at, ratio[buckets].astype(float), minlength=len(block)) / np.maximum(n, 1))
            yield pd.Series(np.round(np.concatenate(out), 9) if out else np.zeros(0))
        give_back()

    return weigh(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    The raw model counts all of ``docs``; the target model about ``sample`` / 2 labelled
    documents at most, drawn by a hash of doc_id, of which those with quality 1 count;
    the cut, on as many others, is where the two error rates are equal.  Without good
    labels every weight is 0 and nothing is rejected.
    """
    bound_batches(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < min(1.0, sample / max(total, 1))).select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))
    # About ``sample`` rows of 20 bytes.
    held = F.broadcast(drawn.orderBy("doc_id").limit(2 * sample))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(held, "doc_id", "left")
    good = F.coalesce((F.col("quality") == 1) & (F.col("half") == 0), F.lit(False))
    counts = texts.select("text", good.alias("good")).mapInPandas(_counted, "group int, bucket int, n long")
    counts = counts.groupBy("group", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, 1 << BITS))
    seen[counts["group"], counts["bucket"]] = counts["n"]
    if not seen[1].any():
        return Model(np.zeros(1 << BITS), -math.inf)
    expected = seen[0] * (seen[1].sum() / seen[0].sum())
    model = Model(np.log((seen[1] + SMOOTH) / (expected + SMOOTH)), -math.inf)
    rest = texts.where(F.col("half") == 1).select(log_weight(F.col("text"), model).alias("w"), F.col("quality").alias("q")).toPandas()
    yes, no = np.sort(rest["w"][rest["q"] == 1]), np.sort(rest["w"][rest["q"] != 1])
    if len(yes) and len(no):
        at = np.unique(rest["w"])
        cuts = (at[1:] + at[:-1]) / 2
        worst = LOSS * np.searchsorted(yes, cuts) / len(yes) + 1 - np.searchsorted(no, cuts) / len(no)
        best = np.flatnonzero(worst <= worst.min() + 1e-9) if len(cuts) else []
        if len(best):
            model.cut = float(cuts[max(best, key=lambda i: (at[i + 1] - at[i], i))])
    return model


def _gumbel(seed: int) -> Column:
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(draw))


def resample(docs: DataFrame, model: Model, k: int | None = None, seed: int = 7, length: float = LENGTH) -> tuple[DataFrame, float]:
    """Draw ``k`` rows from ``docs(doc_id, text)`` by Gumbel top-k.

    The key of a row is its log weight for ``length`` n-grams plus Gumbel noise from a hash
    of doc_id.  Without ``k``, as many rows are drawn as have weights above the model's cut:
    the cut sets the number, the draw says which; near the cut the noise decides.  Result:
    doc_id, log_weight (per n-gram), key, kept of every row, and the least key drawn.  Rows
    without words have weight 0 and are drawn like others; rows with equal keys share
    their fate, so equal rows do; rows without doc_id share their noise.
    """
    weighed = docs.select("doc_id", log_weight(F.col("text"), model).alias("log_weight"))
    keyed = durable(weighed.withColumn("key", F.col("log_weight") * length + _gumbel(seed)))
    if k is None:
        k = keyed.where(F.col("log_weight") > model.cut).count()
    ranked = number_within(keyed.select("key").withColumn("_all", F.lit(0)), "_all", [F.col("key").desc()], "_rank")
    last = ranked.where(F.col("_rank") <= k).agg(F.min("key").alias("key")).first() if k > 0 else None
    least = last["key"] if last and last["key"] is not None else math.inf
    return keyed.withColumn("kept", F.col("key") >= least), least


def select(docs: DataFrame, model: Model, k: int | None = None, seed: int = 7, length: float = LENGTH) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns, whatever their names."""
    least = resample(docs, model, k, seed, length)[1]
    return docs.where(log_weight(F.col("text"), model) * length + _gumbel(seed) >= least)
