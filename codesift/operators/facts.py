"""Tables derived from ``code_facts``; narrow, one explode each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings


def imports(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "rel_path", F.explode("imports").alias("import_name"))


def functions(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "rel_path", F.inline("functions"))


def classes(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "rel_path", F.inline("classes"))


def variables(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "rel_path", F.inline("variables"))


def calls(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "rel_path", F.inline("calls"))


def dangerous(calls_column: Column, names: list[str] | None = None) -> Column:
    """The calls whose resolved name is exactly one of the listed names."""
    names = settings.DANGEROUS_FUNCTIONS if names is None else names
    return F.filter(calls_column, lambda call: call["function"].isin(names))


def dangerous_calls(facts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(repo_id, rel_path, pos, function, line, args)`` in the order of the walk."""
    found = facts.select("repo_id", "rel_path", F.posexplode(dangerous(F.col("calls"), names)).alias("pos", "call"))
    return found.select("repo_id", "rel_path", "pos", "call.function", "call.line", "call.args")


def parse_failures(facts: DataFrame) -> DataFrame:
    return facts.where("parse_error IS NOT NULL").select("repo_id", "rel_path", "parse_error")
