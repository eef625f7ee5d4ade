"""Queries over the supplied tables, each with the SQL that must give the same rows."""

import sys

from pyspark import cloudpickle

# The batch functions of some queries travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from registry import audit, facts, files, findings, history, metadata, responses, rules, runs, scalars, sinks  # noqa: E402, F401
from registry.base import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
