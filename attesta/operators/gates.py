"""Set-level gates over results: coverage, expectations, summaries, regressions and reports.

A result row has ``set_name``, ``ordinal``, ``target``, ``status`` (null where the target couldn't be read),
``origin`` and the gate's ``metric`` and ``expect``. Every aggregate is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import media
from attesta.functions.text import target_key, xml_escape

LISTED = 20


def with_gates(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Results with the metric, expectation and threshold of their set; sets without a check get the defaults."""
    gates = checks.select(F.col("name").alias("set_name"), F.coalesce("coverage_metric", F.lit("trusted")).alias("metric"), "expect", F.col("coverage").alias("threshold"))
    return results.join(gates, "set_name", "left").withColumn("metric", F.coalesce("metric", F.lit("trusted")))


def expected() -> Column:
    """Whether a row's gate expects a credential."""
    return F.coalesce(F.col("expect") != "absent", F.lit(True))


def covered() -> Column:
    return media.coverage_flag(F.col("status"), F.col("origin"), F.col("metric"))


def coverage_gate(gated: DataFrame) -> DataFrame:
    """Per set: rows, how many count, how many miss the expectation, coverage in percent and what failed.

    Unreadable targets stay in the denominator. Coverage of nothing is 100. ``failures`` is an array of messages.
    """
    per_set = gated.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(covered()).alias("counted"),
        F.count_if(~media.expectation_met(F.col("status"), F.col("expect"))).alias("off"),
        F.first("metric").alias("metric"), F.first("expect").alias("expect"), F.first("threshold").alias("threshold"),
    )
    total = F.when(expected(), F.col("total")).otherwise(0)
    coverage = F.when(total == 0, F.lit(100.0)).otherwise(F.col("counted") / total * 100.0)
    late = F.when(F.col("threshold").isNotNull() & (coverage + 2.220446049250313e-16 < F.col("threshold")), F.format_string("coverage %.1f%% (%d of %d %s) is below %s", coverage, F.col("counted"), total, F.col("metric"), F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", "")))
    missed = F.when(F.col("expect").isNotNull() & (F.col("off") > 0), F.format_string("%d of %d are not %s", F.col("off"), F.col("total"), F.col("expect")))
    return per_set.select("set_name", "total", "counted", "off", coverage.alias("coverage"), F.array_compact(F.array(missed, late)).alias("failures"))


def summary(gated: DataFrame) -> DataFrame:
    """Per set: scanned, trusted and missing targets, the first of the missing and how many more, and the report's coverage.

    Coverage here is over expected rows, and 0 where there are none.
    """
    is_missing = expected() & F.coalesce(F.col("status") == "absent", F.lit(False))
    # Only the first LISTED missing targets of a set are ever gathered: ranks are cut before the shuffle.
    ranked = gated.where(is_missing).withColumn("n", F.row_number().over(Window.partitionBy("set_name").orderBy("ordinal", "target"))).where(f"n <= {LISTED}")
    first = ranked.groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct("n", "target"))).alias("first"))
    totals = gated.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("status") == "valid_trusted").alias("trusted"),
        F.count_if(is_missing).alias("missing"),
        F.coalesce(F.avg(F.when(expected(), F.when(covered(), 100.0).otherwise(0.0))), F.lit(0.0)).alias("coverage"),
        F.when(F.min("metric") == F.max("metric"), F.min("metric")).otherwise("mixed").alias("metric"),
    )
    listed = F.coalesce(F.array_join(F.transform("first", lambda f: f["target"]), "\n"), F.lit(""))
    return totals.join(first, "set_name", "left").select("set_name", "scanned", "trusted", "missing", listed.alias("listed"), F.greatest(F.col("missing") - LISTED, F.lit(0)).alias("more"), "coverage", "metric")


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Targets whose status ranks lower than in the baseline; targets on one side only are ignored.

    Both have ``set_name``, ``target`` and ``status``; an unreadable target counts as ``error``.
    """
    side = lambda df, name: df.select("set_name", target_key(F.col("target")).alias("target"), F.coalesce("status", F.lit("error")).alias(name))
    both = side(before, "was").join(side(now, "now"), ["set_name", "target"])
    return both.where(media.status_rank(F.col("now")) < media.status_rank(F.col("was")))


def baseline_objects(results: DataFrame) -> DataFrame:
    """``set_name`` and ``value``: one JSON object per set, status by target in key form, keys in order. A set's targets make one text, as a baseline is one file."""
    pairs = F.array_sort(F.collect_list(F.struct("target", "status")))
    return baseline(results).distinct().groupBy("set_name").agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def baseline(results: DataFrame) -> DataFrame:
    """What a baseline stores: status by target in key form, unreadable as ``error``."""
    return results.select("set_name", target_key(F.col("target")).alias("target"), F.coalesce("status", F.lit("error")).alias("status"))


def exit_codes(results: DataFrame, failed: DataFrame) -> DataFrame:
    """Per set the exit code: 4 for a URL that couldn't be read, 3 for a file, 1 for a failed gate, else 0."""
    url = F.col("target").rlike("^https?://")
    read = results.groupBy("set_name").agg(F.bool_or(F.col("status").isNull() & url).alias("network"), F.bool_or(F.col("status").isNull() & ~url).alias("parse"))
    return read.join(failed.select("set_name", (F.size("failures") > 0).alias("failed")), "set_name", "left").select(
        "set_name", F.when(F.col("network"), 4).when(F.col("parse"), 3).when(F.coalesce("failed", F.lit(False)), 1).otherwise(0).alias("exit_code")
    )


def item_exits(items: DataFrame, strict: bool = False) -> DataFrame:
    """Per set the exit code of a run over items: 2 for an error, 5 for a refusal, in a strict run 1 for one that is unpaired, ambiguous or unsigned, else 0."""
    has = lambda *s: F.bool_or(F.coalesce(F.col("status").isin(*s), F.lit(False)))
    loose = has("unpaired", "ambiguous", "unsigned") if strict else F.bool_or(F.lit(False))
    return items.groupBy("set_name").agg(F.when(has("error"), 2).when(has("refused"), 5).when(loose, 1).otherwise(0).alias("exit_code"))


def documents(gated: DataFrame, result: Column) -> DataFrame:
    """One JSON document per row: target, result, and what its coverage is."""
    coverage = F.struct(F.col("metric"), expected().alias("expected"), (expected() & covered()).alias("covered"))
    return gated.select("set_name", "ordinal", F.to_json(F.struct(F.col("target"), result.alias("result"), coverage.alias("coverage"))).alias("document"))


def junit(gated: DataFrame) -> DataFrame:
    """One test-case line per row; a row fails if its gate expects a credential and its metric doesn't count it."""
    name, status = xml_escape(F.col("target")), F.col("status")
    passed = ~expected() | covered()
    case = F.concat(F.lit('  <testcase name="'), name)
    failure = F.concat(case, F.lit('"><failure message="'), status, F.lit('">credential.status is '), status, F.lit("; not "), F.col("metric"), F.lit("</failure></testcase>"))
    return gated.select("set_name", "ordinal", "target", F.when(status.isNull(), F.concat(case, F.lit('"><error message="unreadable"/></testcase>'))).when(passed, F.concat(case, F.lit('"/>'))).otherwise(failure).alias("line"))


def junit_suites(gated: DataFrame) -> DataFrame:
    """Per set the head of its test suite: tests, failures (unreadable targets are errors, none of them), metric and coverage."""
    failed = F.col("status").isNotNull() & expected() & ~covered()
    per_set = gated.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(failed).alias("failures"),
        F.when(F.min("metric") == F.max("metric"), F.min("metric")).otherwise("mixed").alias("metric"),
        F.coalesce(F.avg(F.when(expected(), F.when(covered(), 100.0).otherwise(0.0))), F.lit(0.0)).alias("coverage"),
    )
    head = F.format_string('<testsuite name="attesta" tests="%d" failures="%d">\n  <properties>\n    <property name="coverage_metric" value="%s"/>\n    <property name="coverage" value="%.1f"/>\n  </properties>', "tests", "failures", "metric", "coverage")
    return per_set.select("set_name", "tests", "failures", "metric", "coverage", head.alias("head"))


def tree_lines(reports: DataFrame) -> DataFrame:
    """``id`` and ``text``: the tree of a result document out of :func:`attesta.operators.manifest.extract_reports`."""
    or_ = lambda c, other: F.coalesce(c, F.lit(other))
    parts = [
        F.concat(F.lit("├─ credential   "), F.col("status")),
        F.concat(F.lit("├─ claim        "), or_(F.col("generator"), "unknown generator"), F.lit(" · "), or_(F.col("algorithm"), "unknown algorithm")),
        F.when(F.col("issuer").isNotNull() | F.col("organization").isNotNull(), F.concat(F.lit("├─ signature    "), or_(F.col("organization"), "unknown"), F.lit(" · "), or_(F.col("issuer"), "unknown issuer"))),
        F.concat(F.lit("├─ source       "), F.col("category")),
        F.array_join(F.transform("actions", lambda a: F.concat(F.lit("│  ├─ action    "), a["action"])), "\n"),
        F.array_join(F.transform("ingredients", lambda i: F.concat(F.lit("│  ├─ ingredient "), or_(i["title"], "untitled"), F.lit(" ("), or_(i["relationship"], "unknown"), F.lit(")"))), "\n"),
        F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("├─ warning      "), w)), "\n"),
        F.array_join(F.transform("errors", lambda e: F.concat(F.lit("├─ error        "), e)), "\n"),
    ]
    return reports.select("id", F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n").alias("text"))


def text_lines(gated: DataFrame, trust_list_version: Column) -> DataFrame:
    """The text report of each row, its lines joined."""
    status = F.col("status")
    line = lambda label, value: F.concat(F.lit(f"  {label:<22}"), value)
    valid = status.isin("valid_trusted", "valid_untrusted")
    parts = [
        F.col("target"),
        line("Content Credentials", F.when(status.isNull(), "COULD NOT BE READ").when(status.isin("absent", "error"), "ABSENT").otherwise("PRESENT")),
        F.when(valid, line("Manifest", F.lit("VALID"))).when(status == "present_invalid", line("Manifest", F.lit("INVALID"))),
        F.when(status == "valid_trusted", line("Trust", F.concat(F.lit("TRUSTED ("), trust_list_version, F.lit(")")))).when(valid | (status == "present_invalid"), line("Trust", F.lit("NOT ON THE TRUST LIST"))),
    ]
    return gated.select("set_name", "ordinal", F.concat_ws("\n", *parts).alias("text"))
