"""Quality rules as a ledger of failure bits, and policies that read it.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit
per failed rule.  A policy is a versioned mask of rules; a document is kept if none of its
bits is under the mask.  Policies, and what each of their rules does by itself, are then
bit operations over the ledger, without another look at a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.words import constants, mix, word_hashes

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Characters of text that are measured together; a longer text comes alone.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A named bit, set if the SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Conditions hold in integers, so they are the same in every engine.  A document without words fails by its length alone.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document, under a name and a version."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return reduce(or_, (bits[name] for name in self.rules), 0)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("clean", 1, ("few_words", "repeated_words", "symbols")),
    Policy("clean", 2, ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
)


def _repeats(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of every text, and those that lie in a window of three words found twice or more in the text."""
    words, _, counts = word_hashes(texts, fold=False)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(texts)), counts)
    begin = np.flatnonzero(text[2:] == text[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    a, b, c = constants(3, 11)
    windows = mix(mix(words[begin] * a) + words[begin + 1] * b + mix(words[begin + 2] + c) + mix(text[begin].astype(np.uint64) + b))
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = begin[times[which] > 1]
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[twice + i] = True
    upto = np.concatenate([[0], np.cumsum(covered)])
    return counts, upto[ends] - upto[ends - counts]


def _measure(texts: list[str]) -> list[np.ndarray]:
    """The measurements of some texts, in the order of MEASURES."""
    words, repeated = _repeats(texts)
    chars = [len(t) - sum(map(t.count, SPACE)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(SPACE)] for t in texts]
    return [words, np.array(chars), np.array(symbols), np.array([len(x) for x in lines]), np.array([len(x) - len(set(x)) for x in lines]), repeated]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield texts[begin:]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of ``docs(doc_id, text)``.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (of these, those equal to an earlier one), n_repeat_words (words in windows
    of three words found twice or more in the text).  Windows compare by 64-bit hashes of
    their words, as they are.  A null text counts as empty.  Rows with the same or no
    doc_id are measured each by itself; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(texts) for texts in _blocks([t or "" for t in batch.column(1).to_pylist()])]
            if parts:
                columns = [pa.array(np.concatenate(column).astype(np.int64)) for column in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{name} long" for name in MEASURES]]))


def record(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger: ``measured`` with ``fail_bits``, every rule evaluated once; a condition that is null does not fail."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")) for rule in rules]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def failed(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of a ledger row that a policy counts."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))


def apply_policy(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add policy (name and version), kept, and sole_rule: the one rule that rejects a document by itself, else null."""
    bits = failed(policy, rules)
    name = reduce(lambda c, r: c.when(bits == 1 << r.bit, r.name), rules, F.when(F.lit(False), F.lit("")))
    return ledger.withColumns({"policy": F.lit(f"{policy.name}@{policy.version}"), "kept": bits == 0, "sole_rule": name})


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of each policy does: policy, rule, kept, rejected (documents that fail the rule),
    regained (documents that fail it alone, and would be kept without it).

    Documents are first counted by their bits, so what is left to combine is a row for each
    set of rules that occurs; an empty ledger gives an empty result.
    """
    counts = ledger.groupBy("fail_bits").agg(F.count("*").alias("docs"))
    of = [
        F.struct(F.lit(f"{p.name}@{p.version}").alias("policy"), F.lit(r.name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies
        for r in rules
        if r.name in p.rules
    ]
    pairs = counts.select("docs", "fail_bits", F.inline(F.array(*of)))
    bits = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def docs(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("docs")).otherwise(0))

    return pairs.groupBy("policy", "rule").agg(
        docs(bits == 0).alias("kept"), docs(bits.bitwiseAND(F.col("bit")) != 0).alias("rejected"), docs(bits == F.col("bit")).alias("regained")
    )
