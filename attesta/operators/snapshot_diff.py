"""What changed between consecutive full snapshots of a table.

A full outer join, on the primary key, of each snapshot with the one before it compares canonical row
hashes: a missing side is an addition or a removal, unequal hashes are a change. All snapshots are
compared in one pass: every record is joined under the number of the snapshot it is compared in, so
nothing loops over snapshots, and only key, number and a 64-bit hash travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import canonical_hash, canonical_status, fingerprint, target_key
from attesta.session import broadcast_if_small

#: Up to so many snapshots their order is broadcast; beyond, it is joined by a shuffle.
MOST_SNAPSHOTS = 100_000

def snapshot_changes(
    df: DataFrame,
    keys: dict[str, Column],
    snapshot: Column,
    values: Sequence[Column],
    version: Sequence[Column],
) -> DataFrame:
    """Columns: the ``keys`` by name, ``snapshot_no`` and ``change_kind`` (added, removed or changed).

    - The snapshot before is the one with the next lower number that exists anywhere in ``df``; gaps in
      the numbers mean nothing. The first snapshot has no changes.
    - Of several rows for one key in one snapshot the one greatest in ``version`` counts; where those tie,
      the one whose values hash highest, so that the result doesn't depend on row order.
    - A null value differs from any value and equals null. Rows with a null snapshot number are passed
      over; a null in a key is a key of its own.
    - An empty table, or one with a single snapshot, gives no rows. Further columns of ``df`` don't matter,
      whatever they are called.
    """
    names = list(keys)
    inner = [f"__k{i}" for i in range(len(names))]
    rows = df.select(
        *[c.alias(n) for n, c in zip(inner, keys.values())],
        snapshot.cast("long").alias("__at"),
        fingerprint(*values).alias("__hash"),
        F.struct(*[c.alias(f"v{i}") for i, c in enumerate(version)]).alias("__version"),
    ).where(F.col("__at").isNotNull())
    # The aggregate combines repeated deliveries before the shuffle.
    latest = rows.groupBy(*inner, "__at").agg(F.max(F.struct("__version", "__hash"))["__hash"].alias("__hash"))

    # One row per snapshot: as many as there were deliveries, not as many as there are records.
    numbers = df.select(snapshot.cast("long").alias("__at")).where("__at is not null").distinct()
    order = numbers.select("__at", F.lead("__at").over(Window.orderBy("__at")).alias("__next"), F.lag("__at").over(Window.orderBy("__at")).alias("__before"))
    order = broadcast_if_small(order, MOST_SNAPSHOTS)

    now = latest.join(order.where("__before is not null").select("__at"), "__at")
    before = latest.join(order.where("__next is not null").select("__at", "__next"), "__at").select(*inner, F.col("__next").alias("__at"), F.col("__hash").alias("__old"))
    # Null-safe keys: an empty marker column keeps the join an equi-join on hashable keys.
    safe = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("~")).alias(f"{n}s") for n in inner]
    on = [*[f"{n}s" for n in inner], "__at"]
    both = now.select(*safe, "__at", *inner, F.col("__hash").alias("__new")).join(before.select(*safe, "__at", *[F.col(n).alias(f"{n}b") for n in inner], "__old"), on, "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(*[F.coalesce(F.col(n), F.col(f"{n}b")).alias(name) for n, name in zip(inner, names)], F.col("__at").cast("int").alias("snapshot_no"), kind.alias("change_kind")).where("change_kind is not null")


def asset_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of credential status and sha256 per set and target; see :func:`snapshot_changes`.

    Target is taken in its key form, status is one of the five known statuses or null, sha256 ignores
    letter case and outer blanks, and of repeated rows the one loaded last counts.
    """
    return snapshot_changes(
        snapshots,
        {"set_name": F.col("set_name"), "target": target_key(F.col("target"))},
        F.col("snapshot_no"),
        [canonical_status(F.col("status")), canonical_hash(F.col("sha256"))],
        [F.col("loaded_at")],
    ).select("set_name", "target", "snapshot_no", "change_kind")
