"""Lookups between tables: synchronising hashes, pairing files, upserts and tracked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import canonical_hash
from attesta.session import materialize

SYNC_CHUNK, REGISTER_CHUNK = 5000, 500


def first_by_hash(assets: DataFrame, order: Column) -> DataFrame:
    """Each distinct sha256 once, in lower case, with the row first in ``order`` and how many rows share it.

    The aggregate is combined before the shuffle, so a hash that many rows share costs no more than another.
    """
    rows = assets.select(canonical_hash(F.col("sha256")).alias("sha256"), order.alias("__o")).where("sha256 is not null")
    return rows.groupBy("sha256").agg(F.min("__o").alias("first"), F.count(F.lit(1)).alias("copies"))


def unknown_hashes(ours: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``ours`` whose sha256 the registry doesn't know."""
    return ours.join(known.select(canonical_hash(F.col("sha256")).alias("sha256")).where("sha256 is not null").distinct(), "sha256", "left_anti")


def in_chunks(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Rows numbered by ``key`` and cut into chunks of ``size``, without sorting them in one task.

    Rows are ranged over partitions; each partition's rows are numbered from the count of the rows before it.
    """
    # Range bounds are sampled, so the partitions are written down before they are read twice.
    ranged = materialize(rows.repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "chunks")
    # One row per partition: the running total over them is small whatever the rows are.
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    numbered = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
    return numbered.join(F.broadcast(before), "__p").withColumn("chunk", F.floor((F.col("__before") + F.col("__i") - 1) / size)).drop("__p", "__i", "__before")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def pair_by_stem(derived: DataFrame, originals: DataFrame) -> DataFrame:
    """``path``, ``original`` and ``outcome`` (paired, unpaired, ambiguous) of each derived file, both with a ``path``.

    An original has the same stem and isn't the file itself. Originals are first reduced to a count, the least and the
    greatest path per stem, so a stem that many share never gathers them.
    """
    by_stem = originals.select("path").distinct().groupBy(file_stem(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least"), F.max("path").alias("most"))
    own = originals.select("path").distinct().withColumn("itself", F.lit(True))
    joined = derived.select("path").distinct().withColumn("stem", file_stem(F.col("path"))).join(by_stem, "stem", "left").join(own, "path", "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("itself"), 1).otherwise(0)
    other = F.when(F.col("least") != F.col("path"), F.col("least")).otherwise(F.col("most"))
    return joined.select("path", F.when(others == 1, other).alias("original"), F.when(others == 0, "unpaired").when(others == 1, "paired").otherwise("ambiguous").alias("outcome"))


def upsert_plan(declared: DataFrame, existing: DataFrame, key: str, fold: bool = False) -> DataFrame:
    """Declared rows with ``step``: update where ``existing`` has their key, else create; ``fold`` ignores letter case."""
    shape = (lambda c: F.lower(c)) if fold else (lambda c: c)
    there = existing.select(shape(F.col(key)).alias("__key")).distinct().withColumn("__there", F.lit(True))
    return declared.withColumn("__key", shape(F.col(key))).join(there, "__key", "left").withColumn("step", F.when(F.col("__there"), "update").otherwise("create")).drop("__key", "__there")


def missing_from(declared: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return declared.join(existing.select(key).distinct(), key, "left_anti")


def tracked_only(targets: DataFrame, tracked: DataFrame) -> DataFrame:
    """Targets that are tracked, leading ``./`` apart, or URLs."""
    url = F.col("target").rlike("^https?://")
    key = F.regexp_replace("target", r"^(\./)+", "")
    return targets.where(url).unionByName(targets.where(~url).withColumn("__k", key).join(tracked.select(F.col("path").alias("__k")).distinct(), "__k", "left_semi").drop("__k"))
