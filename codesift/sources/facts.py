"""Syntax facts of Python files: the standard library's parser, run on Arrow batches.

One call of the parser per file; everything after it is Spark columns.  A file that
cannot be parsed gives a row with ``parse_error`` and no facts, never a failed task.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FACTS_DDL = (
    "parse_error string, ast_nodes int, imports array<string>, "
    "functions array<struct<name:string,line:int,args:int,decorators:array<string>>>, "
    "classes array<struct<name:string,line:int,bases:array<string>>>, "
    "calls array<struct<function:string,line:int,args:int>>, "
    "variables array<struct<name:string,line:int>>"
)

#: Texts whose facts a task of the table function keeps, and their greatest length.
KEPT_TEXTS, SHORT_CHARS = 1000, 2000

_TEXTS = pa.list_(pa.string())
_FACTS_ARROW = pa.schema(
    [
        ("parse_error", pa.string()),
        ("ast_nodes", pa.int32()),
        ("imports", _TEXTS),
        ("functions", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("args", pa.int32()), ("decorators", _TEXTS)]))),
        ("classes", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("bases", _TEXTS)]))),
        ("calls", pa.list_(pa.struct([("function", pa.string()), ("line", pa.int32()), ("args", pa.int32())]))),
        ("variables", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))),
    ]
)


def _dotted(node: ast.expr) -> str:
    """``a.b.c`` for a chain of attributes on a name; ``<expr>`` stands for any other base."""
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    tail.append(node.id if isinstance(node, ast.Name) else "<expr>")
    return ".".join(reversed(tail))


def _source(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


def file_facts(code: str) -> dict:
    """Facts of one file, each list in breadth-first order of the syntax tree."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            level = [ast.parse(code)]
        count, found = 0, {name: [] for name in ("imports", "functions", "classes", "calls", "variables")}
        while level:
            count += len(level)
            for node in level:
                _note(node, found)
            level = [child for node in level for child in ast.iter_child_nodes(node)]
        return {"parse_error": None, "ast_nodes": count, **found}
    except SyntaxError as error:
        return {"parse_error": f"Syntax error: {error}"}
    except Exception as error:  # e.g. RecursionError on deeply nested code
        return {"parse_error": f"AST analysis error: {error}"}


def _note(node: ast.AST, found: dict) -> None:
    match node:
        case ast.Call():
            found["calls"].append({"function": _dotted(node.func), "line": node.lineno, "args": len(node.args)})
        case ast.Assign():
            found["variables"] += [{"name": t.id, "line": node.lineno} for t in node.targets if isinstance(t, ast.Name)]
        case ast.Import():
            found["imports"] += [item.name for item in node.names]
        case ast.ImportFrom():
            found["imports"] += [f"{node.module or ''}.{item.name}" for item in node.names]
        case ast.FunctionDef():
            found["functions"].append(
                {
                    "name": node.name,
                    "line": node.lineno,
                    "args": len(node.args.args),
                    "decorators": [_source(item) for item in node.decorator_list],
                }
            )
        case ast.ClassDef():
            found["classes"].append({"name": node.name, "line": node.lineno, "bases": [_source(item) for item in node.bases]})


def extract_facts(files: DataFrame) -> DataFrame:
    """``code_facts``: the input's columns without ``content``, plus the facts.

    A file with a ``read_error``, if there is such a column, has that as its parse error.
    Copies of a text within a batch are parsed once.
    """
    kept = [name for name in files.columns if name != "content"]
    content_at = files.columns.index("content")
    error_at = files.columns.index("read_error") if "read_error" in files.columns else None
    kept_at = [files.columns.index(name) for name in kept]
    fields = [files.schema[name] for name in kept] + StructType.fromDDL(FACTS_DDL).fields

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(content_at).fill_null("").dictionary_encode()
            rows, where = [file_facts(code) for code in texts.dictionary.to_pylist()], texts.indices.to_pylist()
            for row, error in enumerate(batch.column(error_at).to_pylist() if error_at is not None else []):
                if error:
                    where[row] = len(rows)
                    rows.append({"parse_error": error})
            facts = pa.RecordBatch.from_pylist(rows, schema=_FACTS_ARROW).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at) for at in kept_at] + facts.columns, names=kept + _FACTS_ARROW.names
            )

    return files.mapInArrow(parse, StructType(fields))


class _CodeFacts:
    """The facts of one text, as one row; those of short texts are kept for their copies."""

    def __init__(self) -> None:
        self.short = lru_cache(KEPT_TEXTS)(file_facts)

    def eval(self, content: str) -> Iterator[tuple]:
        code = content or ""
        facts = self.short(code) if len(code) <= SHORT_CHARS else file_facts(code)
        yield tuple(facts.get(name) for name in _FACTS_ARROW.names)


def register_facts(spark: SparkSession, name: str = "code_facts") -> None:
    """Make the parser a table function of SQL: ``FROM files f, LATERAL code_facts(f.content) x``.

    A row of input is a batch of its own where tables travel by Arrow, so they travel pickled.
    """
    spark.udtf.register(name, F.udtf(_CodeFacts, returnType=FACTS_DDL, useArrow=False))
