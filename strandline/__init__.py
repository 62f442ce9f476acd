"""Execution-trace analytics on Spark."""

from __future__ import annotations

import os


def importable_on_workers(spark) -> None:
    """Let Python workers of this session find the package from wherever the session was started."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])
