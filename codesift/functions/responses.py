"""Model responses to finding arrays, one response per row and no shuffle.

A response holds a JSON array somewhere in free text.  Elements are read with the
variant functions, which keep the kind of every value: a missing key takes its
default, an explicit null or a value of the wrong kind makes the element bad.  The
expressions over elements are SQL text, so that each is parsed in one step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift import settings

_NAMED = "~number~"
# NaN and the infinities where an even number of quotes follows, that is outside of strings.
_UNQUOTED = r'(?<![\w"])(-?(?:NaN|Infinity))(?!\w)(?=[^"\\]*+(?:"(?:[^"\\]|\\.)*+"[^"\\]*+)*+$)'
_FLOAT = r"r'(?i)^\s*[+-]?((\d+(_\d+)*)?\.?(\d+(_\d+)*)?(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$'"
_INTEGRAL = r"r'^\s*[+-]?\d+(_\d+)*(\.0*)?\s*$'"
_KEYS = (
    "vulnerability_type", "severity", "confidence", "description", "zero_day_likelihood",
    "line_number", "code_snippet", "recommendation", "cwe_id", "detection_method",
)
_ITEMS_TYPE = "array<struct<" + ",".join(f"{key}:variant" for key in _KEYS) + ">>"
READ_TYPE = (
    "struct<is_text:boolean,line_number:bigint,vulnerability_type:string,severity:string,"
    "confidence:double,description:string,code_snippet:string,recommendation:string,cwe_id:string,"
    "method:string,zero_day_likelihood:double>"
)


def array_slice(response: Column) -> Column:
    """Text from the first ``[`` to the last ``]``; null where there is no such span."""
    first = F.locate("[", response)
    last = F.length(response) - F.length(F.substring_index(response, "]", -1))
    return F.when((first > 0) & (last > first), F.substring(response, first, last - first + 1))


def sealed_variant(cut: Column) -> Column:
    """The span and a closing mark (its digest, which it cannot hold), parsed as one JSON array of two elements.

    The parser ignores text after the first value; a span with such text does not reach
    the mark.  The three numbers that only Python's reader knows become arrays that name
    them, so that they are of no kind but a number's.  Of repeated keys the last counts,
    if the session allows them (``codesift.session.allow_repeated_keys``).
    """
    odd = cut.contains("NaN") | cut.contains("Infinity")
    named = F.when(odd, F.regexp_replace(cut, _UNQUOTED, f'["{_NAMED}","$1"]')).otherwise(cut)
    return F.try_parse_json(F.concat(F.lit("["), named, F.lit(',"'), F.md5(cut), F.lit('"]')))


def items(cut: Column, sealed: Column) -> Column:
    """Elements with their known keys as variants; null for an element that is no object.
    The array is null if the span is not valid JSON."""
    reached = F.try_variant_get(sealed, "$[1]", "string") == F.md5(cut)
    return F.when(reached, F.try_variant_get(sealed, "$[0]", _ITEMS_TYPE))


def _text(key: str) -> str:
    return f"try_variant_get(x.{key}, '$', 'string')"


def _kind_in(key: str, *kinds: str) -> str:
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    return f"(x.{key} IS NULL OR schema_of_variant(x.{key}) IN ({listed}))"


def _number(key: str, default: float) -> str:
    """Value of a number-like field; null if it cannot be read as a number."""
    return f"""CASE WHEN x.{key} IS NULL THEN CAST({default} AS DOUBLE)
        WHEN try_variant_get(x.{key}, '$[0]', 'string') = '{_NAMED}' THEN try_cast(try_variant_get(x.{key}, '$[1]', 'string') AS DOUBLE)
        WHEN schema_of_variant(x.{key}) <> 'STRING' THEN try_variant_get(x.{key}, '$', 'double')
        WHEN {_text(key)} RLIKE {_FLOAT} THEN try_cast(replace({_text(key)}, '_', '') AS DOUBLE) END"""


_LINE = f"""CASE WHEN x.line_number IS NULL THEN CAST(NULL AS BIGINT)
        WHEN schema_of_variant(x.line_number) <> 'STRING'
        THEN if(try_variant_get(x.line_number, '$', 'double') = floor(try_variant_get(x.line_number, '$', 'double')),
                try_variant_get(x.line_number, '$', 'bigint'), NULL)
        WHEN {_text('line_number')} RLIKE {_INTEGRAL}
        THEN try_cast(try_cast(replace({_text('line_number')}, '_', '') AS DOUBLE) AS BIGINT) END"""

_READ = f"""named_struct(
    'is_text', false,
    'line_number', {_LINE},
    'vulnerability_type', {_text('vulnerability_type')},
    'severity', {_text('severity')},
    'confidence', {_number('confidence', 0.5)},
    'description', {_text('description')},
    'code_snippet', {_text('code_snippet')},
    'recommendation', {_text('recommendation')},
    'cwe_id', {_text('cwe_id')},
    'method', {_text('detection_method')},
    'zero_day_likelihood', {_number('zero_day_likelihood', 0.0)})"""

_SHARED = " AND ".join(_kind_in(key, "STRING") for key in ("vulnerability_type", "severity", "description"))
_OPTIONAL = " AND ".join(_kind_in(key, "STRING", "VOID") for key in ("code_snippet", "recommendation", "cwe_id"))


def read() -> Column:
    """Elements of ``items`` as ``READ_TYPE`` rows; null for an element that gives no finding.

    Only the values that the prompt kind uses can make an element bad.
    """
    return F.expr(f"""transform(
        transform(items, x -> named_struct(
            'kinds_ok', x IS NOT NULL AND {_SHARED} AND (kind <> 'analysis' OR {_OPTIONAL}),
            'no_line', {_kind_in('line_number', 'VOID')},
            'row', {_READ})),
        y -> if(y.kinds_ok AND y.row.confidence IS NOT NULL AND if(kind = 'analysis',
                y.no_line OR y.row.line_number IS NOT NULL, y.row.zero_day_likelihood IS NOT NULL), y.row, NULL))""")


def valid_prefix(findings: Column) -> Column:
    """Elements before the first bad one."""
    first_bad = F.array_position(F.transform(findings, F.isnull), True)
    return F.slice(findings, 1, F.when(first_bad == 0, F.size(findings)).otherwise(first_bad - 1).cast("int"))


def mentions_vulnerability(response: Column) -> Column:
    return F.lower(response).rlike("|".join(settings.FALLBACK_WORDS))


def fallback(response: Column, chars: int | None = settings.FALLBACK_CHARS) -> Column:
    """Row for an undecodable response that names a weakness, with its first ``chars`` characters (None: all)."""
    shown = response if chars is None else F.left(response, F.lit(chars))
    description = F.concat(
        F.lit(settings.FALLBACK_PREFIX), shown, F.lit("...")
    )
    none = F.lit(None)
    return F.struct(
        F.lit(True), none, F.lit("potential_vulnerability"), F.lit("medium"), F.lit(0.3), description,
        none, none, none, none, F.lit(0.0),
    ).cast(READ_TYPE)
