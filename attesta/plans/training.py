"""Queries of the general training-data operators (p1, p2, p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import nested, snapshot_diff, timestamps
from attesta.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.asset_changes(table(spark, sf_dir, "asset_snapshots"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.capture_times(table(spark, sf_dir, "exif_dates"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.report_nodes(table(spark, sf_dir, "reports"))


def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct objects of all reports with their number of occurrences."""
    flat = nested.flatten_records(table(spark, sf_dir, "reports"), F.col("report_id"), F.col("report_json"))
    return nested.objects(flat)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p5_found, p5_objects)}

ORACLES: dict[str, str] = {
    "p1_found": r"""
WITH clean AS (
  SELECT set_name, regexp_replace(replace(target, '\', '/'), '^(\./)+', '') AS target, snapshot_no, loaded_at,
    regexp_replace(lower(trim(status)), '[ _-]+', '_', 'g') AS plain, lower(trim(sha256)) AS sha
  FROM asset_snapshots),
latest AS (
  SELECT set_name, target, snapshot_no,
    CASE WHEN plain IN ('valid_trusted', 'valid_untrusted', 'present_invalid', 'absent', 'error') THEN plain END AS status, sha
  FROM clean
  QUALIFY row_number() OVER (PARTITION BY set_name, target, snapshot_no ORDER BY loaded_at DESC) = 1),
numbers AS (
  SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT snapshot_no FROM asset_snapshots)),
old AS (
  SELECT l.set_name, l.target, n.snapshot_no, l.status, l.sha FROM latest l JOIN numbers n ON l.snapshot_no = n.before_no),
new AS (
  SELECT l.* FROM latest l JOIN numbers n ON l.snapshot_no = n.snapshot_no WHERE n.before_no IS NOT NULL)
SELECT coalesce(new.set_name, old.set_name) AS set_name, coalesce(new.target, old.target) AS target,
  coalesce(new.snapshot_no, old.snapshot_no) AS snapshot_no,
  CASE WHEN old.target IS NULL THEN 'added' WHEN new.target IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new FULL OUTER JOIN old ON new.set_name = old.set_name AND new.target = old.target AND new.snapshot_no = old.snapshot_no
WHERE old.target IS NULL OR new.target IS NULL OR new.status IS DISTINCT FROM old.status OR new.sha IS DISTINCT FROM old.sha
""",
}
