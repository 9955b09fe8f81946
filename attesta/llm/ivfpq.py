"""The most similar pictures of every picture: an inverted file with product-quantised residuals.

Coarse centroids, and codebooks for what the centroids leave (residuals, cut into SUB parts), are fitted on a
bounded sample. The file has TABLES independent sets of centroids: near signatures that one set parts, another keeps
together, which finds more of them than as many further cells of one set. In each table a signature is put into
the cell of its nearest centroid as a code of SUB bytes, and visits the PROBES nearest cells as a query; there,
asymmetric distances (exact query, quantised entry) come from a table per query, and what they leave is reranked by
exact distance. Both ends of a pair are queries, so a pair is found if either visits the other's cell.

The number of cells grows with the root of the collection as far as the sample allows. A cell that is large all the same is
cut once more, by centroids fitted where it is searched, so that comparisons stay in proportion to the collection.

Only distinct signatures travel, packed by the cells that they visit, each with the few owners that can matter, and a
task keeps the best of each signature as it goes: pairs are never listed in full, however many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.signatures import BITS, QUALITY, RADIUS, distances, packed, well_formed, words
from attesta.session import broadcast_if_small, materialize, slots

#: Most signatures that the model is fitted on, all drawn by their hash.
SAMPLE = 1 << 15
#: Sets of centroids, cells visited per query in each, parts of a residual, codes of a part.
TABLES, PROBES, SUB, CODES = 3, 2, 8, 256
#: What the asymmetric distance may exceed the radius by, in bits, before the exact one is asked.
SLACK = 10
#: Of the quantisation error, what the asymmetric distance to an entry at the radius holds: an entry that lies so near errs alike.
SHARE = 1 - 4 * RADIUS / BITS
#: Signatures that a group of small cells should hold as entries, and rows of a cell compared at once.
GROUP, _BLOCK = 8192, 512
#: Entries of a cell from which on it is cut where it is searched, entries of such a part, and parts visited per query.
LARGE, PART, PART_PROBES = 4096, 1024, 8
#: Entries from which on, by the sample, a cell is shared by several tasks; each visitor then goes to all of them.
HUGE = 1 << 20
#: Rows of one signature that a task may join at once; of what has more, the rows are spread.
HOT, _MOST_HOT = 100_000, 200_000
#: Bytes that a searching task should read.
_TASK = 8 << 20
#: Nearest pictures asked for.
NEAREST = 5

_SENT = "bucket int, signatures binary, slots binary, entries binary, counts binary, owners binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in ("signatures", "slots", "entries", "counts", "owners")]])
_FOUND = "signature binary, owner long, distance int"


@dataclass
class Model:
    """One table: centroids, codebooks and where its cells are searched."""

    centroids: np.ndarray  # (cells, BITS)
    codebooks: np.ndarray  # (SUB, CODES, BITS // SUB)
    first: np.ndarray  # the first slot of each cell: a huge cell is shared by several
    bucket: np.ndarray  # of each slot


def raw(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(n, BITS // 8) bytes of a column of signatures."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    width = BITS // 8
    if not len(column):
        return np.zeros((0, width), np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8).reshape(-1, width)[np.frombuffer(column.buffers()[1], np.int32)[column.offset] // width :][: len(column)]


def signs(signatures: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1 and -1; the squared distance of two rows is four times the Hamming distance."""
    return np.unpackbits(signatures, axis=1).astype(np.float32) * 2 - 1


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = np.concatenate([nearest(x[s : s + 4096], centres, 1)[:, 0] for s in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, label, x)
        count = np.bincount(label, minlength=k)[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    score = x @ centres.T - 0.5 * (centres * centres).sum(1)
    k = min(k, len(centres))
    out = np.empty((len(x), k), np.int64)
    rows = np.arange(len(x))
    for i in range(k):  # for few of many, repeated maxima are faster than a partition
        out[:, i] = score.argmax(1)
        score[rows, out[:, i]] = -np.inf
    return out


def encode(x: np.ndarray, centroid: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals of a cell's entries, and of each the part of its asymmetric distance that doesn't depend on the query."""
    residual = x - centroid
    step = BITS // SUB
    codes = np.empty((len(x), SUB), np.uint8)
    decoded = np.repeat(centroid[None], len(x), 0)
    for m in range(SUB):
        codes[:, m] = nearest(residual[:, m * step : (m + 1) * step], model.codebooks[m], 1)[:, 0]
        decoded[:, m * step : (m + 1) * step] += model.codebooks[m][codes[:, m]]
    error = ((x - decoded) ** 2).sum(1)
    return codes, ((decoded**2).sum(1) - SHARE * error).astype(np.float32)


def fit(sample: list[bytes], total: int) -> list[Model]:
    """The tables from a sample of ``total`` distinct signatures; slots and buckets are numbered through them."""
    x = signs(np.frombuffer(b"".join(sample), np.uint8).reshape(-1, BITS // 8))
    cells = int(min(max(1, len(x) // 4), 2 ** np.round(np.log2(max(1.0, 0.75 * np.sqrt(total))))))
    step, out, slots, buckets = BITS // SUB, [], 0, 0
    for table in range(TABLES):
        centroids = kmeans(x, cells, 3, seed=3 + table)
        own = np.concatenate([nearest(x[s : s + 4096], centroids, 1)[:, 0] for s in range(0, len(x), 4096)])
        residual = (x - centroids[own])[table * 4096 % max(1, len(x)) :][:8192]
        # Fewer codes than CODES exist only where the sample is smaller.
        codebooks = np.stack([kmeans(residual[:, m * step : (m + 1) * step], CODES, 3) for m in range(SUB)])
        # Small cells share a bucket; one that is huge, by the sample, is cut into slots.
        size = np.bincount(own, minlength=len(centroids)) * (total / len(x))
        parts = np.maximum(1, np.ceil(size / HUGE)).astype(np.int64)
        bucket = buckets + np.floor(np.cumsum(np.repeat(size / parts, parts)) / GROUP).astype(np.int32)
        out.append(Model(centroids, codebooks, slots + np.concatenate([[0], np.cumsum(parts)]), bucket))
        slots, buckets = int(out[-1].first[-1]), int(bucket[-1]) + 1
    return out


# -- sending signatures to the cells


def _assign(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """Packed rows, one per bucket and batch: an entry in one slot of its own cell, a visitor in every other slot of the cells that it visits."""
    for batch in batches:
        signature = raw(batch.column(0))
        if not len(signature):
            continue
        x = signs(signature)
        spread = signature[:, :4].astype(np.int64) @ np.array([1, 256, 65536, 1 << 24])
        owners = batch.column(1)
        count, flat = owners.value_lengths().to_numpy().astype(np.int64), owners.flatten().to_numpy()
        begin = np.cumsum(count) - count
        rows, slots, entries, buckets = [], [], [], []
        for model in models:
            probe = np.concatenate([nearest(x[at : at + 512], model.centroids, PROBES) for at in range(0, len(x), 512)])
            parts = np.diff(model.first)
            home = model.first[probe[:, 0]] + spread % parts[probe[:, 0]]
            copies = parts[probe].ravel()
            row = np.repeat(np.repeat(np.arange(len(signature)), probe.shape[1]), copies)
            slot = np.repeat(model.first[probe].ravel() - (np.cumsum(copies) - copies), copies) + np.arange(len(row))
            rows.append(row)
            slots.append(slot)
            entries.append(slot == home[row])
            buckets.append(model.bucket[slot - model.first[0]])
        row, slot, entry, bucket = (np.concatenate(c) for c in (rows, slots, entries, buckets))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for part in np.split(order, cuts):
            r = row[part]
            n = count[r]
            which = np.repeat(begin[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((int(bucket[part[0]]), signature[r].tobytes(), slot[part].astype(np.int32).tobytes(), entry[part].tobytes(), n.astype(np.int8).tobytes(), flat[which].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT_ARROW)], schema=_SENT_ARROW)


# -- searching the cells


def _best(found: pd.DataFrame) -> pd.DataFrame:
    """Of each signature the nearest owners that can matter: the picture itself is one of them, NEAREST others remain."""
    found = found.sort_values(["target", "distance", "owner"], kind="stable").drop_duplicates(["target", "owner"])
    return found[found.groupby("target").cumcount() <= NEAREST]


def _parts(x: np.ndarray, entries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, rows that ask them) of a cell: the whole of it, or, where it is large, its parts about centroids of its own."""
    if len(entries) <= LARGE:
        yield entries, rows
        return
    centres = kmeans(x[entries[:: max(1, len(entries) // (4 * LARGE))]], -(-len(entries) // PART), 3)
    visits = np.concatenate([nearest(x[rows[at : at + 4096]], centres, PART_PROBES) for at in range(0, len(rows), 4096)])
    own = np.concatenate([nearest(x[entries[at : at + 4096]], centres, 1)[:, 0] for at in range(0, len(entries), 4096)])
    of_entries, of_visits = np.argsort(own, kind="stable"), np.argsort(visits.ravel(), kind="stable")
    ends_e, ends_v = np.cumsum(np.bincount(own, minlength=len(centres))), np.cumsum(np.bincount(visits.ravel(), minlength=len(centres)))
    for c in range(len(centres)):
        inside = of_entries[ends_e[c - 1] if c else 0 : ends_e[c]]
        asking = of_visits[ends_v[c - 1] if c else 0 : ends_v[c]] // visits.shape[1]
        if len(inside):
            yield entries[inside], rows[asking]


def _search(table: pa.Table, models: list[Model]) -> pa.Table:
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    signature = joined("signatures", np.uint8).reshape(-1, BITS // 8)
    packed_words = np.ascontiguousarray(signature).view(">u8").astype(np.uint64)
    slot, entry = joined("slots", np.int32), joined("entries", bool)
    owner_count, owner_flat = joined("counts", np.int8).astype(np.int64), joined("owners", np.int64)
    owner_first = np.cumsum(owner_count) - owner_count
    model = models[int(np.searchsorted([m.first[0] for m in models], slot[0], "right")) - 1]
    step = BITS // SUB
    kept = pd.DataFrame({"target": np.zeros(0, np.int64), "distance": np.zeros(0, np.int64), "owner": np.zeros(0, np.int64)})
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        nonlocal kept, size
        if pending:
            q, x, d = (np.concatenate(c) for c in zip(*pending))
            pending.clear()
            target, other, d = np.concatenate([q, x]), np.concatenate([x, q]), np.concatenate([d, d])
            c = owner_count[other]
            which = np.repeat(np.arange(len(other)), c)
            owner = owner_flat[owner_first[other][which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)]
            kept = _best(pd.concat([kept, pd.DataFrame({"target": target[which], "distance": d[which].astype(np.int64), "owner": owner})], ignore_index=True))
        size = 0

    order = np.lexsort((~entry, slot))  # by slot, its entries first
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    for cell_rows in np.split(order, cuts):
        cell_entries = cell_rows[entry[cell_rows]]
        if not len(cell_entries) or len(cell_rows) < 2:
            continue
        centroid = model.centroids[int(np.searchsorted(model.first, slot[cell_rows[0]], "right") - 1)]
        x_of = signs(signature[cell_rows])
        for inside, asking in _parts(x_of, np.arange(len(cell_entries)), np.arange(len(cell_rows))):
            codes, bias = encode(x_of[inside], centroid, model)
            for begin in range(0, len(asking), _BLOCK):
                asked = asking[begin : begin + _BLOCK]
                x = x_of[asked]
                # Tables stand codes by queries, so that looking up an entry copies one row.
                tables = [(-2 * model.codebooks[m]) @ x[:, m * step : (m + 1) * step].T for m in range(SUB)]
                most = 4 * (RADIUS + SLACK) - BITS + 2 * (x @ centroid)
                for low in range(0, len(inside), _BLOCK):
                    members = inside[low : low + _BLOCK]
                    code = codes[low : low + _BLOCK]
                    guess = tables[0][code[:, 0]]
                    for m in range(1, SUB):
                        guess += tables[m][code[:, m]]
                    guess += bias[low : low + _BLOCK][:, None]
                    c, r = np.nonzero(guess <= most[None, :])
                    q, e = cell_rows[asked[r]], cell_rows[members[c]]
                    d = distances(packed_words[q], packed_words[e])
                    good = (d <= RADIUS) & (d > 0)  # distinct signatures differ, so 0 is the entry itself
                    if good.any():
                        pending.append((q[good], e[good], d[good]))
                        size += int(good.sum())
                        if size > 200_000:
                            settle()
    settle()
    target = kept["target"].to_numpy()
    found = signature[target].tobytes()
    return pa.table({"signature": pa.array([found[i : i + BITS // 8] for i in range(0, len(found), BITS // 8)], pa.binary()), "owner": pa.array(kept["owner"].to_numpy(), pa.int64()), "distance": pa.array(kept["distance"].to_numpy().astype(np.int32))})


# -- the operator


def _hashes(assets: DataFrame) -> DataFrame:
    """Each (asset, signature) of the pictures that take part; repeats stay."""
    good = assets.where((F.col("pdq_quality") >= QUALITY) & well_formed(F.col("pdq")) & F.col("asset_id").isNotNull())
    lists = F.concat(F.array("pdq"), *[F.coalesce(F.filter(c, well_formed), F.array().cast("array<string>")) for c in ("pdq_mirrors", "pdq_frames")])
    return good.select(F.col("asset_id").cast("long").alias("asset"), F.explode(lists).alias("h")).select("asset", packed(F.col("h")).alias("signature"))


def _top(entries: F.Column, most: int):
    """The first ``most`` distinct owners of sorted (distance, owner) entries."""
    kept = F.aggregate(entries, F.array().cast("array<struct<distance:int,owner:bigint>>"), lambda acc, e: F.when((F.size(acc) < most) & ~F.exists(acc, lambda a: a["owner"] == e["owner"]), F.array_append(acc, e)).otherwise(acc))
    return kept


def similar_pictures(assets: DataFrame) -> DataFrame:
    """``asset_id_a`` < ``asset_id_b``: pairs at a distance of at most 31 of which one is among the other's 5 nearest.

    The distance of two pictures is the smallest between any well-formed hash of the one (pdq, mirrors, frames) and
    any of the other; equal distances are ordered by the smaller asset_id. Every picture is an entry and a query.

    - Pictures take part with a quality of at least 50 and a well-formed pdq; malformed hashes among their others, and
      null or empty arrays, count for nothing. Rows with a null asset_id are passed over; repeated rows are one picture.
    - Exact copies share one signature, whose six smallest owners stand for all: of any picture's five nearest none can
      be another. A picture of any number of copies so costs its own rows only.
    - The search is approximate: recall is measured in the tests and stated in the README. An empty table gives no rows;
      further columns don't matter.
    """
    spark = assets.sparkSession
    hashes = _hashes(assets)
    # A rank limit is applied before the shuffle too, so a signature that a third of all rows have sends six from each task.
    ranked = hashes.withColumn("n", F.dense_rank().over(Window.partitionBy("signature").orderBy("asset"))).where(f"n <= {NEAREST + 1}")
    distinct = materialize(ranked.groupBy("signature").agg(F.array_sort(F.collect_set("asset")).alias("owners")), "pictures")
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], "asset_id_a long, asset_id_b long")
    every = -(-total // SAMPLE)
    sample = [bytes(r[0]) for r in distinct.where(F.pmod(F.xxhash64("signature", F.lit(5)), F.lit(every)) == 0).select("signature").limit(2 * SAMPLE).collect()]
    models = spark.sparkContext.broadcast(fit(sample or [bytes(distinct.first()[0])], total))
    sent = distinct.mapInArrow(lambda batches: _assign(batches, models.value), _SENT)
    tasks = max(2 * slots(spark), -(-total * TABLES * PROBES * 48 // _TASK))
    near = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda table: _search(table, models.value), _FOUND)
    copies = distinct.where("size(owners) > 1").select("signature", F.explode("owners").alias("owner"), F.lit(0).alias("distance"))
    lists = near.unionByName(copies).groupBy("signature").agg(F.sort_array(F.collect_set(F.struct("distance", "owner"))).alias("found")).select("signature", _top(F.col("found"), NEAREST + 1).alias("found"))

    # A signature that very many rows have would make one large task of this join: its rows are spread, its list is copied as
    # often as that takes. There is at most one such signature in HOT rows, and only those with several owners can be one.
    many = broadcast_if_small(distinct.where(f"size(owners) > {NEAREST}").select("signature"), _MOST_HOT)
    hot = hashes.select("signature").join(many, "signature").groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}")
    hot = broadcast_if_small(hot.select("signature", F.ceil(F.col("n") / HOT).cast("int").alias("spread")), _MOST_HOT)
    salted = hashes.join(hot, "signature", "left").withColumn("salt", F.pmod(F.hash("asset"), F.coalesce("spread", F.lit(1))))
    copied = lists.join(hot, "signature", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1)))
    per_hash = salted.select("asset", "signature", "salt").join(copied.select("signature", "salt", "found"), ["signature", "salt"]).select("asset", F.explode("found").alias("f")).where("f.owner <> asset")
    directed = per_hash.groupBy("asset").agg(F.sort_array(F.collect_set("f")).alias("found")).select("asset", F.explode(_top(F.col("found"), NEAREST)).alias("f"))
    return directed.select(F.least("asset", "f.owner").alias("asset_id_a"), F.greatest("asset", "f.owner").alias("asset_id_b")).distinct()
