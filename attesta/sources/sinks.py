"""Writing results: reports as text, JSON lines, JUnit, and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import gates

FORMATS = ("text", "ndjson", "junit")


def write_reports(gated: DataFrame, outputs: list[tuple[str, str]], trust_list_version: str = "") -> None:
    """Write one run's results in several formats: (format, path) pairs. The results are kept for all of them."""
    if unknown := {f for f, _ in outputs} - set(FORMATS):
        raise ValueError(f"unknown formats: {', '.join(sorted(unknown))}")
    gated = gated.persist()
    try:
        for form, path in outputs:
            if form == "text":
                rows = gates.text_lines(gated, F.lit(trust_list_version)).select("text")
            elif form == "ndjson":
                rows = gates.documents(gated, F.struct("status", "origin")).select("document")
            else:
                rows = gates.junit(gated).select("line")
            rows.write.mode("overwrite").text(path)
    finally:
        gated.unpersist()


def write_baseline(results: DataFrame, path: str) -> None:
    """A folder per set with one JSON object, status by target, sorted by target; :func:`attesta.sources.targets.baselines` reads it."""
    gates.baseline_objects(results).write.mode("overwrite").partitionBy("set_name").text(path)
