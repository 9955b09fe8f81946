"""Targets, media files, configuration and baselines as DataFrames."""

from __future__ import annotations

import json
import re
import subprocess

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import media
from attesta.functions.dictionaries import LIMITS

CHECK_KEYS = frozenset({"name", "paths", "coverage", "coverage_metric", "expect", "baseline", "git_tracked"})


def is_url(target: str) -> bool:
    return target.startswith(("http://", "https://"))


def braces(pattern: str) -> list[str]:
    """Alternatives of a pattern, the leftmost pair first; an unbalanced brace is literal."""
    done, todo = [], [pattern]
    while todo:
        head = todo.pop(0)
        before, opened, rest = head.partition("{")
        inside, closed, after = rest.partition("}")
        if opened and closed:
            todo = [before + part + after for part in inside.split(",")] + todo
        else:
            done.append(head)
    return done


def _glob_regex(pattern: str) -> str:
    """A pattern as a regular expression over whole paths: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return out


def media_files(spark: SparkSession, targets: list[str], offline: bool = False) -> DataFrame:
    """``target``, ``content``, ``mime`` and ``error_code`` of local files; larger ones keep their row without content.

    Plain paths and URLs pass through untouched: a path that can't be read keeps a row with ``unreadable``, a URL one with
    ``offline`` or ``not_fetched``, as they aren't fetched here. A pattern without a match is an error.
    """
    local = [p for t in targets if not is_url(t) for p in (braces(t) if "{" in t else [t])]
    none = [(t, "offline" if offline else "not_fetched") for t in targets if is_url(t)]
    found: list[DataFrame] = []
    for pattern in local:
        if not re.search(r"[*?\[]", pattern):
            try:
                found.append(spark.read.format("binaryFile").load(pattern))
            except AnalysisException:
                none.append((pattern, "unreadable"))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "**" in pattern).load(pattern.split("**")[0].rstrip("/") if "**" in pattern else pattern)
        if "**" in pattern:
            files = files.where(F.regexp_replace("path", "^file:/*", "/").rlike("^" + _glob_regex(pattern) + "$"))
            if files.select("path").isEmpty():
                raise FileNotFoundError(f"no file matches {pattern}")
        found.append(files)
    empty = spark.createDataFrame(none, "target string, error_code string")
    out = empty.select("target", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("mime"), "error_code")
    for files in found:
        mime = media.mime_from_name(F.col("path"))
        small = files.where(F.col("length") <= LIMITS["bytes"]).select(F.col("path").alias("target"), "content", mime.alias("mime"), media.guard_error(F.col("length"), mime).alias("error_code"))
        large = files.where(F.col("length") > LIMITS["bytes"]).select(F.col("path").alias("target"), F.lit(None).cast("binary").alias("content"), mime.alias("mime"), F.lit("limit_exceeded").alias("error_code"))
        out = out.unionByName(small).unionByName(large)
    return out


def checks(spark: SparkSession, text: str) -> DataFrame:
    """The checks of a configuration (JSON); unknown keys are errors."""
    rows = json.loads(text).get("checks", [])
    for row in rows:
        if unknown := row.keys() - CHECK_KEYS:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        if not 1 <= len(row.get("name") or "") <= 64:
            raise ValueError("a name has 1 to 64 characters")
    schema = "name string, paths array<string>, coverage double, coverage_metric string, expect string, baseline string, git_tracked boolean"
    return spark.createDataFrame([{k: float(v) if k == "coverage" and v is not None else v for k, v in r.items()} for r in rows], schema)


def baseline(texts: DataFrame) -> DataFrame:
    """``target`` and ``status`` of stored baselines (column ``value``: a JSON object each)."""
    return texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("target", "status"))


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """``set_name``, ``target`` and ``status`` of what :func:`attesta.sources.sinks.write_baseline` wrote."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.select("set_name", F.explode(F.from_json("value", "map<string,string>")).alias("target", "status"))


def git_tracked(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the files that git tracks in a folder, relative to it."""
    listed = subprocess.run(["git", "-C", folder, "ls-files", "-z"], check=True, capture_output=True).stdout.decode("utf-8", "replace")
    return spark.createDataFrame([(p,) for p in listed.split("\0") if p], "path string")


def trust_list(spark: SparkSession, custom: str | None, bundled: str, cached: str | None, day: str, offline: bool = False) -> tuple[DataFrame, str]:
    """The bundle in force and where it comes from: a custom path, else bundled if offline, else what is cached and readable, else bundled."""
    if custom:
        return trust_bundle(spark, custom, day), "custom"
    if cached and not offline:
        try:
            bundle = trust_bundle(spark, cached, day)
            bundle.collect()
            return bundle, "cached"
        except PySparkException:
            pass
    return trust_bundle(spark, bundled, day), "bundled"


def trust_bundle(spark: SparkSession, path: str, day: str) -> DataFrame:
    """``pem``, ``version`` and ``certificates`` of a certificate bundle; one without certificates is an error."""
    from attesta.functions.hashing import certificate_count, trust_version

    pem = spark.read.text(path, wholetext=True)
    count = certificate_count(F.col("value"))
    return pem.select(F.col("value").alias("pem"), trust_version(F.lit(day), F.col("value")).alias("version"), F.when(count > 0, count).otherwise(F.raise_error(F.lit("no certificates"))).cast("int").alias("certificates"))
