"""Origin tracing as joins: the nearest listed ancestor of each store's active manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.dictionaries import LIMITS
from attesta.session import materialize

STORE = "struct<active_manifest:string,validation_state:string,trusted_manifests:array<string>,manifests:map<string,string>>"


def edges(stores: DataFrame) -> DataFrame:
    """Followable ingredient edges (store_id, from_label, idx, is_component, to_label) of stores (store_id, store).

    An edge needs a followed relationship, a status of valid_untrusted and a manifest in the store; component edges of a
    manifest with an invalid component are left out.
    """
    parsed = stores.select("store_id", F.from_json("store", STORE).alias("s"))
    manifests = parsed.select("store_id", F.map_keys("s.manifests").alias("labels"), F.explode("s.manifests").alias("label", "body"))
    items = manifests.select("store_id", "labels", "label", F.posexplode(F.from_json(F.get_json_object("body", "$.ingredients"), "array<string>")).alias("idx", "item"))
    # Which keys an ingredient has counts, not their values: a null still is a manifest.
    has = F.arrays_overlap(F.json_object_keys("item"), F.array(F.lit("active_manifest"), F.lit("c2pa_manifest"), F.lit("manifest_data")))
    listed = F.get_json_object("item", "$.validation_status")
    codes = F.from_json(F.when(listed.startswith("["), listed), "array<struct<code:string>>")
    failed = F.exists(F.coalesce(codes, F.array().cast("array<struct<code:string>>")), lambda e: F.coalesce(e["code"], F.lit("")) != "signingCredential.untrusted")
    status = F.when(~F.coalesce(has, F.lit(False)), "absent").when(failed, "present_invalid").otherwise("valid_untrusted")
    relation = F.get_json_object("item", "$.relationship")
    rows = items.select("store_id", "labels", F.col("label").alias("from_label"), "idx", relation.alias("relation"), status.alias("status"), F.get_json_object("item", "$.active_manifest").alias("to_label")).where("relation in ('parentOf', 'componentOf')")
    broken = rows.groupBy("store_id", "from_label").agg(F.bool_or((F.col("relation") == "componentOf") & (F.col("status") == "present_invalid")).alias("broken"))
    kept = rows.join(broken, ["store_id", "from_label"]).where("status = 'valid_untrusted' and array_contains(labels, to_label) and not (broken and relation = 'componentOf')")
    return kept.select("store_id", "from_label", "idx", (F.col("relation") == "componentOf").alias("is_component"), "to_label")


def trace_origins(stores: DataFrame) -> DataFrame:
    """(store_id, depth, to_label, relationship) of the nearest listed ancestor within eight steps; unique per store.

    Ties go to parents before components, then to ingredient order: paths are compared as arrays. Agrees with the walk in
    :mod:`attesta.operators.manifest` where that doesn't exhaust its edge budget.
    """
    links = materialize(edges(stores), "edges")
    parsed = stores.select("store_id", F.from_json("store", STORE).alias("s"))
    named = F.when(F.array_contains(F.map_keys("s.manifests"), F.col("s.active_manifest")), F.col("s.active_manifest")).otherwise(F.get(F.map_keys("s.manifests"), F.lit(0)))
    start = parsed.where("coalesce(s.validation_state, '') not in ('Invalid', 'Trusted')").select("store_id", named.alias("at"), F.coalesce("s.trusted_manifests", F.array().cast("array<string>")).alias("trusted"))
    front = start.select("store_id", "at", "trusted", F.array().cast("array<struct<is_component:boolean,idx:int>>").alias("path"))
    hits = []
    for depth in range(1, LIMITS["depth"] + 1):
        # Of the paths to a manifest only the least can be part of the least hit; each step is written, so that no step repeats those before it.
        step = front.withColumnRenamed("at", "from_label").join(links, ["store_id", "from_label"]).groupBy("store_id", F.col("to_label").alias("at")).agg(F.min(F.array_append("path", F.struct("is_component", "idx"))).alias("path"), F.first("trusted").alias("trusted"))
        step = materialize(step.withColumn("hit", F.array_contains("trusted", F.col("at"))), "step")
        hits.append(step.where("hit").select("store_id", F.lit(depth).alias("depth"), F.col("at").alias("to_label"), "path"))
        done = step.where("hit").select("store_id").distinct()
        front = step.where("not hit").drop("hit").join(done, "store_id", "left_anti")
        if step.where("not hit").isEmpty():
            break
    best = reduce(DataFrame.unionByName, hits).groupBy("store_id").agg(F.min(F.struct("depth", "path", "to_label")).alias("b"))
    last = F.get(F.col("b.path"), F.size("b.path") - 1)["is_component"]
    return best.select("store_id", "b.depth", "b.to_label", F.when(last, "componentOf").otherwise("parentOf").alias("relationship"))
