"""Batch scoring of prompts by a function of the caller."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: Scorers of this worker process by the table they were made for.
_READY: dict[str, Callable] = {}


def _scorer(key: str, make_scorer: Callable[[], Callable]) -> Callable:
    if key not in _READY:
        _READY.clear()
        _READY[key] = make_scorer()
    return _READY[key]


def score_prompts(prompts: DataFrame, make_scorer: Callable[[], Callable], batched: bool = False) -> DataFrame:
    """``prompts(repo_id, rel_path, kind, prompt)`` to responses with an ``error`` column.

    ``make_scorer`` is called once per worker process, so that a client or model is set
    up where it is used and kept for later tasks.  It gives a function of a prompt, or,
    if ``batched``, of a list of prompts to a list of responses.  A call that raises
    gives a null response and its message, as does a set-up that fails; of a batch that
    raises, every prompt is tried by itself.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def attempt(prompt: str) -> tuple[str | None, str | None]:
            try:
                score = _scorer(key, make_scorer)
                return (score([prompt])[0] if batched else score(prompt)), None
            except Exception as error:
                return None, str(error)

        def attempt_all(texts: list[str]) -> list[tuple[str | None, str | None]]:
            if batched:
                try:
                    responses = _scorer(key, make_scorer)(texts)
                    return [(response, None) for response, _ in zip(responses, texts, strict=True)]
                except Exception:
                    pass
            return [attempt(text) for text in texts]

        for batch in batches:
            answers = attempt_all(batch.column(3).to_pylist())
            columns = [
                *batch.columns[:3],
                pa.array([response for response, _ in answers], pa.string()),
                pa.array([error for _, error in answers], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["repo_id", "rel_path", "kind", "response", "error"])

    rows = prompts.select("repo_id", "rel_path", "kind", "prompt")
    return rows.mapInArrow(run, "repo_id string, rel_path string, kind string, response string, error string")
