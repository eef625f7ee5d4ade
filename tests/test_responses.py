import json

import pytest

from codesift.operators import prompts, responses as ops
from codesift.sources.scorer import score_prompts


def parse(spark, texts, kind="analysis"):
    rows = spark.createDataFrame([("r", str(n), kind, t) for n, t in enumerate(texts)], "repo_id string, rel_path string, kind string, response string")
    found = ops.parse_responses(rows).orderBy("file_path", "pos").collect()
    return [[r for r in found if r.file_path == str(n)] for n in range(len(texts))]


def short(found):
    return [(r.vulnerability_type, r.severity, round(r.confidence, 6), r.line_number, r.detection_method) for r in found]


LLM = "llm_analysis"
MEDIUM = ("unknown", "medium", 0.7, None, LLM)
CASES = [
    # (response, findings as (type, severity, confidence, line, method))
    ("", []),
    ("no brackets, though a vulnerability", []),
    ("] injection [", []),
    ("[]", []),
    ("[", []),
    ("text [] more", []),
    ("[{}]", [("unknown", "medium", 0.7, None, LLM)]),
    ('x [{"severity":"low","confidence":0.2}] y', [("unknown", "low", 0.5, None, LLM)]),
    ('[{"confidence":"0.95"}]', [("unknown", "medium", 0.95, None, LLM)]),
    ('[{"confidence":" 9e-1 "}]', [("unknown", "medium", 0.9, None, LLM)]),
    ('[{"confidence":"1_0.5"}]', [("unknown", "medium", 10.5, None, LLM)]),
    ('[{"confidence":true}]', [("unknown", "medium", 1.0, None, LLM)]),
    ('[{"confidence":1}]', [("unknown", "medium", 1.0, None, LLM)]),
    ('[{"confidence":null}]', []),
    ('[{"confidence":"high"}]', []),
    ('[{"confidence":"1.0d"}]', []),
    ('[{"confidence":[1]}]', []),
    ('[{"confidence":{}}]', []),
    ('[{"severity":"low"},{"a":1,"a":2},{}]', [("unknown", "low", 0.5, None, LLM), MEDIUM, MEDIUM]),
    ('[{"severity":"high","severity":"low"},{"severity":"critical"}]', [("unknown", "low", 0.5, None, LLM), ("unknown", "critical", 0.9, None, LLM)]),
    ('[{},{"a":NaN,"b":"say \\"NaN\\", Infinity"},{}]', [MEDIUM] * 3),
    ('[{"confidence":Infinity},{"confidence":-Infinity}]', [("unknown", "medium", float("inf"), None, LLM), MEDIUM]),
    ('[{"severity":NaN},{}]', []),
    ('[{"description":"NaN"}]', [MEDIUM]),
    ('[NaN,{}]', []),
    ('[{"line_number":42.0}]', [("unknown", "medium", 0.7, 42, LLM)]),
    ('[{"line_number":"42"}]', [("unknown", "medium", 0.7, 42, LLM)]),
    ('[{"line_number":"42.0"}]', [("unknown", "medium", 0.7, 42, LLM)]),
    ('[{"line_number":true}]', [("unknown", "medium", 0.7, 1, LLM)]),
    ('[{"line_number":null}]', [("unknown", "medium", 0.7, None, LLM)]),
    ('[{"line_number":42.5}]', []),
    ('[{"line_number":"12-15"}]', []),
    ('[{"line_number":"42.5"}]', []),
    ('[{"line_number":[]}]', []),
    ('[{"cwe_id":89}]', []),
    ('[{"cwe_id":null,"recommendation":null,"code_snippet":null}]', [("unknown", "medium", 0.7, None, LLM)]),
    ('[{"severity":null}]', []),
    ('[{"severity":3}]', []),
    ('[{"description":null}]', []),
    ('[{"vulnerability_type":null}]', []),
    ('["{\\"severity\\":\\"high\\"}", {}]', []),
    ("[1, {}]", []),
    ("[null]", []),
    ('[{"severity":"high"},{"severity":null},{}]', [("unknown", "high", 0.8, None, LLM)]),
    ('[{"severity":"CRITICAL"}]', [("unknown", "CRITICAL", 0.9, None, LLM)]),
    ('[{"severity":"odd","confidence":0.1}]', [("unknown", "odd", 0.5, None, LLM)]),
    ('[{"detection_method":"static_analysis"}]', [("unknown", "medium", 0.8, None, LLM)]),
    ('[{"detection_method":5}]', [("unknown", "medium", 0.7, None, LLM)]),
    ('[{"extra":{"severity: STRING":[1]}}]', [("unknown", "medium", 0.7, None, LLM)]),
    ('[{"zero_day_likelihood":null}]', [("unknown", "medium", 0.7, None, LLM)]),
    # undecodable: the text fallback looks for two words
    ('["x"] and [y]', []),
    ('["injection"] and [y]', [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("[1,] Vulnerability [", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("[1,] weakness [", []),
    ("Vulnerability [1,]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("INJECTION [{'severity':'high'}]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("injection [1]} [2]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ('injection [1], "w": [2]', [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("injection [1], [2]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ("injection [1]] [[2]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ('injection [{}],"~end of array~"] [x]', [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ('[{"description":"~end of array~"}]', [("unknown", "medium", 0.7, None, LLM)]),
    ("injection [[1]", [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
    ('injection [{"a":"\t"}]', [("potential_vulnerability", "medium", 0.3, None, "text_analysis")]),
]


def test_analysis_responses(spark):
    got = parse(spark, [text for text, _ in CASES])
    assert [(CASES[n][0], short(found)) for n, found in enumerate(got)] == CASES


def test_decodability_agrees_with_the_json_module(spark):
    """The fallback appears exactly where ``json.loads`` rejects the span."""
    for text, _ in CASES:
        first, last = text.find("["), text.rfind("]")
        if first < 0 or last < first or "injection" not in text.lower() and "vulnerability" not in text.lower():
            continue
        try:
            json.loads(text[first : last + 1])
            decodable = True
        except json.JSONDecodeError:
            decodable = False
        methods = {r.detection_method for r in parse(spark, [text])[0]}
        assert ("text_analysis" in methods) == (not decodable), text


def test_zero_day_responses(spark):
    novel = "zero_day_analysis"
    cases = [
        ('[{"zero_day_likelihood":0.8,"confidence":0.4,"line_number":"12-15","cwe_id":89}]', [("zero_day_pattern", "medium", 0.4, None, novel)]),
        ('[{"zero_day_likelihood":"0.25","severity":"critical"}]', [("zero_day_pattern", "critical", 0.5, None, novel)]),
        ('[{},{"zero_day_likelihood":null}]', [("zero_day_pattern", "medium", 0.5, None, novel)]),
        ("injection [1,]", []),
    ]
    got = parse(spark, [text for text, _ in cases], "zero_day")
    assert [(cases[n][0], short(found)) for n, found in enumerate(got)] == cases
    assert [found[0].zero_day_likelihood for found in got[:3]] == [0.8, 0.25, 0.0]


def test_fallback_description_and_null_response(spark):
    text = "injection " + "é" * 300 + " [x]"
    found = parse(spark, [text, None])
    assert found[0][0].description == f"Potential vulnerability detected in text analysis: {text[:200]}..."
    assert found[1] == []


@pytest.mark.parametrize(("confidence", "passes"), [("0.7", True), ("0.6999", False)])
def test_threshold(spark, confidence, passes):
    rows = spark.createDataFrame([("r", "f", "zero_day", '[{"confidence":%s}]' % confidence)], "repo_id string, rel_path string, kind string, response string")
    assert (ops.confident(ops.parse_responses(rows)).count() == 1) == passes


def test_parsing_has_no_shuffle(spark):
    rows = spark.createDataFrame([("r", "f", "analysis", "[]")], "repo_id string, rel_path string, kind string, response string")
    assert "Exchange" not in ops.parse_responses(rows)._jdf.queryExecution().executedPlan().toString()


def test_prompts_and_scoring(spark, files):
    rows = files([("r", "a.py", "x" * 200_000), ("s", "b.py", "{code} boom")])
    contexts = spark.createDataFrame([("r", "\n\nRepository dependencies: a")], "repo_id string, context string")
    table = prompts.prompt_table(prompts.with_context(rows, contexts), analysis_template="P {path}|{context}|{code}.", novel_template="N {code}")
    got = {(r.rel_path, r.kind): r.prompt for r in table.collect()}
    assert got["a.py", "analysis"] == "P a.py|\n\nRepository dependencies: a|" + "x" * 98304 + "."
    assert got["b.py", "analysis"] == "P b.py||{code} boom." and got["b.py", "zero_day"] == "N {code} boom"
    assert prompts.prompt_table(prompts.with_context(rows, contexts), novel=False).count() == 2

    def make():
        def score(prompt):
            if "boom" in prompt:
                raise RuntimeError("no answer")
            return f"[{len(prompt)}]"

        return score

    scored = {(r.rel_path, r.kind): (r.response, r.error) for r in score_prompts(table, make).collect()}
    assert scored["b.py", "zero_day"] == (None, "no answer")
    assert scored["a.py", "zero_day"] == ("[98306]", None)


def test_batched_scorer_and_failing_set_up(spark):
    table = spark.createDataFrame([("r", f"{i}", "analysis", "bad" if i == 3 else f"p{i}") for i in range(6)], "repo_id string, rel_path string, kind string, prompt string")

    def make():
        def score(texts):
            if "bad" in texts:
                raise ValueError("no answer")
            return [t.upper() for t in texts]

        return score

    got = {r.rel_path: (r.response, r.error) for r in score_prompts(table, make, batched=True).collect()}
    assert got == {f"{i}": (None, "no answer") if i == 3 else (f"P{i}", None) for i in range(6)}

    def broken():
        raise OSError("no model")

    assert {(r.response, r.error) for r in score_prompts(table, broken).collect()} == {(None, "no model")}


def test_empty_arrays_are_in_the_salvage(spark):
    from registry import QUERIES

    rows = QUERIES["p9_prefix_salvage_all"](spark, "/root/testdata/sf0.001").where("items = 0").collect()
    assert rows and all(r["kept"] == 0 for r in rows)
