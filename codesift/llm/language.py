"""Language identification with blended-spectrum n-gram presence kernels.

Two texts are compared by the character n-grams (n = 1 to ``NGRAM``) that occur in both:
presence vectors over hashed n-grams of the letters (lower case, everything else as one
mark), scaled to length 1, so the kernel of two texts is a product of vectors.  A bounded
sample of labelled texts gives the Nystroem landmarks and the training rows; one kernel
ridge regression per language against the rest is solved in the landmarks' span.  Texts are
scored in batches: presence matrix times landmarks times weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NGRAM = 3
BITS = 13
#: Bounds of the fit: training texts and landmarks of a language, and of all together where there are many languages (each has one at least).
SAMPLE, LANDMARKS, SAMPLES, ALL_LANDMARKS = 300, 32, 60_000, 6400
RIDGE = 1e-3
UNKNOWN = "und"
#: Code points of a long text whose n-grams are marked at once.
_SLICE = 1 << 20
_BATCH = 64
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point: that of its lower-case letter, or a space."""
    global _LETTERS
    if _LETTERS is None:
        lower = (chr(c).lower() if chr(c).isalpha() else " " for c in range(0x110000))
        _LETTERS = np.fromiter((ord(c[0]) for c in lower), np.uint32, 0x110000)
    return _LETTERS


def presence(text: str, out: np.ndarray) -> None:
    """Mark the n-grams of a text in ``out``, a vector of 2 ** BITS zeros."""
    table, shift = _letters(), np.uint32(32 - BITS)
    for begin in range(0, len(text), _SLICE):
        part = " " * (begin == 0) + text[max(0, begin - NGRAM + 1) : begin + _SLICE] + " " * (begin + _SLICE >= len(text))
        code = (table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)] + np.uint32(1)) * np.uint32(0x9E3779B1)
        gram = np.zeros_like(code)
        for n in range(NGRAM):
            gram = gram[: len(code) - n] * np.uint32(0x85EBCA6B) + code[n:]
            mixed = gram ^ (gram >> np.uint32(15))
            out[(mixed * np.uint32(0xC2B2AE35)) >> shift] = 1


def presence_matrix(texts: list[str]) -> np.ndarray:
    """Rows of presence, scaled to length 1."""
    rows = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(rows, texts, strict=True):
        presence(text, row)
        row /= max(1.0, float(np.sqrt(row.sum())))
    return rows


@dataclass
class Model:
    """languages in order; landmarks as packed presence bits; weights (landmarks x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def landmark_matrix(self) -> np.ndarray:
        rows = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return rows / np.maximum(1.0, np.sqrt(rows.sum(axis=1, keepdims=True)))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bits = []
        for text in batch["text"]:
            row = np.zeros(1 << BITS, np.uint8)
            presence(text, row)
            bits.append(np.packbits(row).tobytes())
        yield pd.DataFrame({"lang": batch["lang"], "draw": batch["draw"], "bits": bits})


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Fit on ``labelled(text, lang)``.

    Rows without language or without a letter teach nothing.  Every language is learned:
    of each, the ``sample`` distinct texts that come first by a hash of the text, fewer if
    all languages together have more than SAMPLES.  Only their presence bits come to the
    driver, 1 KB each; copies of a text count once, and landmarks differ.
    """
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.xxhash64("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0)))
    sample = max(1, min(sample, SAMPLES // len(languages)))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    # The limit of each language is applied before the shuffle as well.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    texts = rows.select("lang", "draw").distinct().withColumn("_n", first).where(F.col("_n") <= sample).select("lang", "draw")
    drawn = rows.join(F.broadcast(texts), ["lang", "draw"])
    got = drawn.mapInPandas(_packed, "lang string, draw long, bits binary").groupBy("lang", "draw").agg(F.min("bits").alias("bits")).toPandas()
    got = got.sort_values(["lang", "draw"], ignore_index=True)
    bits = np.stack([np.frombuffer(x, np.uint8) for x in got["bits"]])
    different = got[~got.duplicated(["lang", "bits"])]
    marks = bits[different.index[different.groupby("lang").cumcount() < landmarks]]
    model = Model(languages, marks, np.zeros((len(marks), len(languages))))
    unit = model.landmark_matrix().astype(float)
    texts = Model(languages, bits, model.weights).landmark_matrix().astype(float)
    cross, inner = texts @ unit.T, unit @ unit.T
    is_lang = got["lang"].to_numpy()[:, None] == np.array(languages, dtype=object)
    # Every language weighs the same; targets are +1 and -1.
    share = (is_lang / np.maximum(1, is_lang.sum(axis=0))).sum(axis=1) / len(languages)
    goal = np.where(is_lang, 1.0, -1.0)
    left = cross.T @ (share[:, None] * cross) + RIDGE * inner + 1e-9 * np.eye(len(marks))
    model.weights = np.linalg.solve(left, cross.T @ (share[:, None] * goal))
    return model


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score (0 to 1) of a text column.

    ``und`` with score 0 for null texts, texts without a letter, or a model that learned
    nothing.  Scores are rounded before they are compared, so batching does not matter;
    ties go to the first language in code point order.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marks, weights = model.landmark_matrix().T, model.weights
        for texts in batches:
            margins = [
                (presence_matrix(list(texts[i : i + _BATCH])) @ marks).astype(float) @ weights for i in range(0, len(texts), _BATCH)
            ]
            scores = np.round(np.clip((np.concatenate(margins) + 1) / 2, 0, 1), 4)
            best = scores.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [model.languages[i] for i in best], "score": scores[np.arange(len(best)), best]})

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return nothing
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(known, classify(F.coalesce(text, F.lit("")))).otherwise(nothing)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs(doc_id, text)``, as ``predict`` has them.

    Rows with the same or no doc_id are classified each by itself; texts of any length
    whole; equal texts alike.  Other columns are not read; an empty table gives an empty result.
    """
    return docs.select("doc_id", predict(F.col("text"), model).alias("_p")).select("doc_id", "_p.lang_pred", "_p.score")
