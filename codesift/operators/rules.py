"""Pattern rules over the lines of files.

A scan reads the text once and shuffles nothing.  A few rules are unrolled into one array
expression per file.  A large table of rules does not enter the plan: tasks build an
automaton over one text of each rule, which finds the candidate pairs of rule and line in a
single pass, and only these pairs meet a pattern.  Patterns that would backtrack over
``.*`` are matched in an equal form that takes linear time (``patterns.linear``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift import settings
from codesift.operators import patterns
from codesift.operators.joins import BROADCAST_BYTES

# Case folding, the class of spaces and the dot follow Python's rules.
_FLAGS = "(?idU)"
# Constructs that Java and Python read differently.
_NOT_SHARED = re.compile(
    r"\(\?(?!:)|\\[bBwWAZzGRXhHvVNkpPQE0-9]|\[[^\]]*\\S|\[[^\]]*\[|\[\^?\]|&&|[*+?}]\+|\$|(?<!\\)\{(?!\d)"
)
#: Hits of a line that are listed together.
CHUNK = 200
#: Most rules that are unrolled into the plan.
UNROLLED = 24
HITS_TYPE = "array<struct<rule_id:int,line:int,match:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern in Python syntax.

    ``literals`` are lower-case texts that every match contains; lines without all of
    them are passed over.  An empty tuple is always right.
    """

    rule_id: int
    pattern: str
    literals: tuple[str, ...] = ()

    @cached_property
    def linear(self) -> str | None:
        return patterns.linear(self.pattern)

    @cached_property
    def native(self) -> bool:
        """Whether Spark's regular expressions give the same matches."""
        return not _NOT_SHARED.search(self.pattern) and not re.search(self.pattern, "", re.IGNORECASE)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    warnings: tuple[tuple[str, str], ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.rule_id, r.pattern) for r in self.rules], "rule_id int, pattern string")

    def warning_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.warnings), "pattern string, warning string")


def compile_rules(listed: list[str], literals: list[list[str]] | None = None) -> RuleSet:
    """Number the patterns; those that do not compile are left out with a warning.

    Without ``literals`` the texts that a match must hold are read off the patterns.
    """
    rules, warned = [], []
    for at, pattern in enumerate(listed):
        try:
            re.compile(pattern, re.IGNORECASE)
        except re.error as error:
            warned.append((pattern, f"Invalid regex pattern {pattern}: {error}"))
            continue
        rules.append(Rule(at, pattern, tuple(literals[at]) if literals else patterns.required(pattern)))
    return RuleSet(tuple(rules), tuple(warned))


def default_rules() -> RuleSet:
    return compile_rules(settings.SUSPICIOUS_PATTERNS, settings.SUSPICIOUS_PATTERN_LITERALS)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; a last empty line is kept."""
    lines = F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")
    return files.select("repo_id", "rel_path", lines).select(
        "repo_id", "rel_path", (F.col("pos") + 1).alias("line"), "text"
    )


def _literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Letters that equal an ASCII letter when case is ignored.
_ODD = str.maketrans("İıſ\u212a", "iisk")


def fold(text: Column) -> Column:
    """Lower case in which letters that are equal when case is ignored are the same.

    Four non-ASCII letters equal an ASCII letter; few texts have them.
    """
    odd = text.contains("İ") | text.contains("ı") | text.contains("ſ") | text.contains("K")
    return F.lower(F.when(odd, F.translate(text, "İıſK", "iisk")).otherwise(text))


def _wanted(folded: str, rule: Rule) -> str:
    return " AND ".join([f"contains({folded}, {_literal(text)})" for text in rule.literals] or ["true"])


def _shared(pattern: str) -> str:
    """The pattern for Spark: Python's white space has four separators more than Java's."""
    out, at, in_class = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[0] == "\\":
            space = {"\\s": r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]", "\\S": r"[^\s\x1c-\x1f]"}
            out.append(space.get(two, two))
            at += 2
            continue
        in_class = two[0] != "]" if in_class else two[0] == "["
        out.append(two[0])
        at += 1
    return "".join(out)


def _rule_hits(rule: Rule) -> str:
    """Hits of one rule in the line ``x`` (text, folded text).

    Gaps and matched texts are walked in chunks: the offset of a chunk is the sum of the
    lengths before it, and only within a chunk is a list built up item by item.
    """
    none = f"CAST(array() AS {HITS_TYPE})"
    if rule.linear:
        regex = _literal(_FLAGS + _shared(rule.linear))
        return f"""if({_wanted("x.`1`", rule)} AND x.`0` RLIKE {regex}, transform(
            array(named_struct('before', length(regexp_extract(x.`0`, {regex}, 1)), 'match', regexp_extract(x.`0`, {regex}, 2))),
            hit -> named_struct('rule_id', {rule.rule_id}, 'line', number + 1, 'match', hit.match, 'start', hit.before, 'end', hit.before + length(hit.match))), {none})"""
    regex = _literal(_FLAGS + _shared(rule.pattern))
    walk = f"""aggregate(
        chunk,
        named_struct('at', aggregate(slice(pieces.sizes, 1, nr), 0, (sum, size) -> sum + size), 'hits', {none}),
        (state, item) -> named_struct(
            'at', state.at + length(item.`0`) + coalesce(length(item.`1`), 0),
            'hits', if(item.`1` IS NULL, state.hits, concat(state.hits, array(named_struct(
                'rule_id', {rule.rule_id},
                'line', number + 1,
                'match', item.`1`,
                'start', state.at + length(item.`0`),
                'end', state.at + length(item.`0`) + length(item.`1`)))))),
        state -> state.hits)"""
    sizes = "transform(chunks, chunk -> aggregate(chunk, 0, (sum, item) -> sum + length(item.`0`) + coalesce(length(item.`1`), 0)))"
    chunks = f"transform(sequence(0, (size(items) - 1) div {CHUNK}), nr -> slice(items, nr * {CHUNK} + 1, {CHUNK}))"
    # One-element arrays give a name to what is used several times.
    return f"""if({_wanted("x.`1`", rule)} AND x.`0` RLIKE {regex}, flatten(flatten(transform(
        transform(transform(array(arrays_zip(split(x.`0`, {regex}, -1), regexp_extract_all(x.`0`, {regex}, 0))),
            items -> {chunks}), chunks -> named_struct('chunks', chunks, 'sizes', {sizes})),
        pieces -> transform(pieces.chunks, (chunk, nr) -> {walk})))), {none})"""


def _file_hits(rules: list[Rule]) -> Column:
    """All hits of the rules in ``content``, given its ``_folded`` form.

    Written as SQL text: one expression per rule is then parsed in one step.  A file
    without the literals of any rule is not split; in any other, only the lines with a
    rule's literals reach its pattern.
    """
    none = f"CAST(array() AS {HITS_TYPE})"
    per_rule = [none] + [_rule_hits(rule) for rule in rules]
    any_rule = " OR ".join(["false"] + [f"({_wanted('_folded', rule)})" for rule in rules])
    return F.expr(f"""if({any_rule}, flatten(transform(
        arrays_zip(split(content, '\\n', -1), split(_folded, '\\n', -1)),
        (x, number) -> concat({", ".join(per_rule)}))), {none})""")


class Matcher:
    """Hits of many rules in a text, by Python's regular expressions.

    Of every rule the longest text that its matches hold goes into an automaton; a line in
    which it occurs is a candidate, and meets the pattern if it holds the rule's other texts
    too.  Rules without such a text meet every line.
    """

    def __init__(self, rules: list[Rule]) -> None:
        import ahocorasick

        self.rules = [(r.rule_id, re.compile(r.linear or r.pattern, re.IGNORECASE), bool(r.linear), r.literals) for r in rules]
        self.always = [n for n, r in enumerate(rules) if not r.literals]
        keyed: dict[str, list[int]] = {}
        for n, rule in enumerate(rules):
            if rule.literals:
                keyed.setdefault(max(rule.literals, key=len), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in keyed.items():
            self.automaton.add_word(text, numbers)
        if keyed:
            self.automaton.make_automaton()
        self.keyed = bool(keyed)

    def candidates(self, folded: str, lines: list[str]) -> list[tuple[int, int]]:
        """Pairs of line and rule, both from 0, in order."""
        pairs = {(line, n) for line in range(len(lines)) for n in self.always}
        if self.keyed:
            starts = [0, *accumulate(len(x) + 1 for x in lines)]
            for end, numbers in self.automaton.iter(folded):
                line = bisect_right(starts, end) - 1
                pairs.update((line, n) for n in numbers)
        return sorted(pairs)

    def hits(self, content: str) -> list[dict]:
        lines = content.split("\n")
        folded = content.translate(_ODD).lower()
        low = folded.split("\n")
        out = []
        for line, n in self.candidates(folded, low):
            rule_id, regex, whole, literals = self.rules[n]
            if all(text in low[line] for text in literals):
                found = [regex.match(lines[line])] if whole else regex.finditer(lines[line])
                for hit in found:
                    if hit is not None:
                        start, end = hit.span(2 if whole else 0)
                        out.append({"rule_id": rule_id, "line": line + 1, "match": hit.group(2 if whole else 0), "start": start, "end": end})
        return out


def _add_python_hits(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Append the hits of rules that are many, or that only Python's regular expressions can express."""
    names = rows.columns
    text_at, hits_at = names.index("content"), names.index("hits")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            hits = batch.column(hits_at).to_pylist()
            for row, content in enumerate(batch.column(text_at).to_pylist()):
                hits[row] = (hits[row] or []) + matcher.hits(content or "")
            columns = list(batch.columns)
            columns[hits_at] = pa.array(hits, batch.schema.field(hits_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(search, rows.schema)


def _folded(files: DataFrame) -> DataFrame:
    return files.withColumn("_folded", fold(F.col("content")))


def with_hits(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``hits``, all matches in a file as an array; the file bounds its length."""
    native, others = _split(rules)
    if native:
        rows = _folded(files).withColumn("hits", _file_hits(native)).drop("_folded")
    else:
        rows = files.withColumn("hits", F.array().cast(HITS_TYPE))
    return _add_python_hits(rows, others) if others else rows


def _split(rules: RuleSet) -> tuple[list[Rule], list[Rule]]:
    """Rules that are unrolled, and the others."""
    if len(rules.rules) > UNROLLED:
        return [], list(rules.rules)
    return [rule for rule in rules.rules if rule.native], [rule for rule in rules.rules if not rule.native]


def _labelled(hits: DataFrame, rules: RuleSet) -> DataFrame:
    if len(rules.rules) > UNROLLED:
        table = rules.table(hits.sparkSession)
        if sum(len(rule.pattern) * 4 + 32 for rule in rules.rules) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        return hits.join(table, "rule_id").select("repo_id", "rel_path", "rule_id", "pattern", "line", "match", "start", "end")
    pattern = F.when(F.lit(False), F.lit(""))
    for rule in rules.rules:
        pattern = pattern.when(F.col("rule_id") == rule.rule_id, F.lit(rule.pattern))
    return hits.select("repo_id", "rel_path", "rule_id", pattern.alias("pattern"), "line", "match", "start", "end")


def explode_hits(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """``pattern_hits(repo_id, rel_path, rule_id, pattern, line, match, start, end)``."""
    return _labelled(rows.select("repo_id", "rel_path", F.inline("hits")), rules)


def scan(files: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """All matches of all rules in the lines of the files."""
    rules = default_rules() if rules is None else rules
    rows = files.select("repo_id", "rel_path", "content")
    if _split(rules)[1]:
        return explode_hits(with_hits(rows, rules), rules)
    # The generator gets the expression itself: for a column the optimizer would add a
    # filter on its size, and push it down to where the hits are computed a second time.
    hits = _folded(rows).select("repo_id", "rel_path", F.inline(_file_hits(list(rules.rules))))
    return _labelled(hits, rules)


def hits_per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("repo_id", "rel_path").agg(F.count("*").alias("hits"))


def hits_per_rule(hits: DataFrame) -> DataFrame:
    return hits.groupBy("repo_id", "rel_path", "rule_id").agg(F.count("*").alias("hits"))
