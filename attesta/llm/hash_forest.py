"""Deduplicating new batches against all history with a prefix-tree hash forest.

The forest keeps several permutations of each signature's bits. Per permutation the signatures stand in
the order of their permuted bits, so that those sharing a prefix lie in one range: a prefix tree. A batch
entry is located by range search. Prefixes are widened in rounds: first the whole prefix must match, then
all but one bit of it, then all but two, until the recall that is asked for is certain. Whatever is found
is verified on all bits.

With ``TREES`` permutations that begin with disjoint bits, two signatures within the radius differ in at
most ``radius // TREES`` bits of some prefix; after that round the recall is 1, not just likely.

The forest is stored as runs in the shared folder, as in a log-structured tree: a batch adds runs, small
runs are merged, and no run exceeds ``RUN`` signatures. History is never shuffled or rebuilt: a batch goes to the tasks that
scan the runs, so that each run is read once, by Spark, however many tasks there are; of a batch too large for that, blocks
are probed instead, and a task that holds one reads the runs one after the other. The cost follows the
batch and the number of runs; entries that are settled in one round don't enter the next.

Beside the runs the forest keeps the first asset of each sha256, and the hashes known before any asset, so that a
batch is checked against all history by both. What is stored can be opened again by its path.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import canonical_hash
from attesta.llm.signatures import BITS, QUALITY, RADIUS, distances, packed, well_formed, words
from attesta.session import broadcast_if_small, materialize, shared_dir, slots

TREES = 11
#: Most signatures of a run: what a task holds of history at once (about 25 MB with one tree).
RUN = 1 << 19
#: Signatures of the forest per task of a probe.
BLOCK = 1 << 18
#: Small runs, or small tables of sha256, that may stand before they are merged, and most sha256 of a small table.
MOST_SMALL, SMALL_TABLE = 4, 1 << 20
#: Most distinct sha256 of a batch that are broadcast to the stored tables; of more, the tables are shuffled.
BROADCAST = 200_000
#: Batch entries probed at once, times the prefixes of a round.
_CHUNK = 1 << 13

_RUN_SCHEMA = "run long, tree int, size long, keys binary, rows binary, signatures binary, batch binary, asset binary"
_ARROW = pa.schema([("run", pa.int64()), ("tree", pa.int32()), ("size", pa.int64()), *[(n, pa.binary()) for n in ("keys", "rows", "signatures", "batch", "asset")]])
_NEVER = 2**31 - 1  # the batch number of assets that have none: after all others
_KNOWN = (-(2**31), -(2**63))  # batch and asset of a known sha256: before all others


def widths(trees: int = TREES) -> list[int]:
    """Bits of each permutation's prefix; together they are all bits."""
    return [BITS // trees + (i < BITS % trees) for i in range(trees)]


@lru_cache(maxsize=4)
def permutations(trees: int = TREES) -> list[np.ndarray]:
    """Per tree the bits its prefix takes, spread over the signature so that neighbouring bits part."""
    order = np.arange(BITS).reshape(16, 16).T.ravel()
    return np.split(order, np.cumsum(widths(trees))[:-1])


def prefixes(signatures: np.ndarray, tree: int, trees: int = TREES) -> np.ndarray:
    """The permuted prefixes of packed words, as unsigned integers."""
    out = np.zeros(len(signatures), np.uint32)
    for bit in permutations(trees)[tree]:
        out = (out << np.uint32(1)) | ((signatures[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)).astype(np.uint32)
    return out


@lru_cache(maxsize=64)
def flips(width: int, errors: int) -> np.ndarray:
    """Masks of exactly so many bits of a prefix."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), errors)], np.uint32)


def recall_at(distance: int, errors: int, trees: int = TREES) -> float:
    """Least recall at a distance after the round with so many errors, over random positions of the differing bits.

    1.0 is certainty: it holds for any positions.
    """
    if distance < trees * (errors + 1):
        return 1.0
    rng = np.random.default_rng(7)
    cuts = np.repeat(np.arange(trees), widths(trees))
    hit = [np.bincount(cuts[rng.choice(BITS, distance, False)], minlength=trees).min() <= errors for _ in range(2000)]
    return min(float(np.mean(hit)), 1 - 1e-9)


def rounds_for(recall: float, radius: int = RADIUS, trees: int = TREES) -> int:
    """The round after which a recall at the radius is reached."""
    return next(e for e in range(BITS) if recall_at(radius, e, trees) >= recall)


# -- building and storing runs


def _build(table: pa.Table) -> pa.Table:
    """One run of signatures as its sorted permutations; tree -1 holds the signatures themselves."""
    run = table.column("run")[0].as_py()
    sig = words(table.column("signature").to_pylist())
    as_bytes = lambda name, kind: table.column(name).to_numpy().astype(kind).tobytes()
    rows = [(run, -1, len(sig), None, None, sig.tobytes(), as_bytes("batch", np.int32), as_bytes("asset", np.int64))]
    for tree in range(TREES):
        keys = prefixes(sig, tree)
        order = np.argsort(keys, kind="stable").astype(np.uint32)
        rows.append((run, tree, len(sig), keys[order].tobytes(), order.tobytes(), None, None, None))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class HashForest:
    """A stored forest. ``path`` is a folder in storage that all executors reach; None: a new one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []  # folder and number of signatures of each append or merge
        self.hashes: list[tuple[str, int]] = []  # folder and number of sha256 of each remember or merge
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{folder}/contents.json").is_file:
            with fs.open_input_file(f"{folder}/contents.json") as source:
                stored = json.loads(source.read())
            self.runs, self.hashes = ([(f"{self.path}/{name}", n) for name, n in stored[k]] for k in ("runs", "hashes"))

    def _save(self) -> None:
        """Write down what the forest holds, in one step, so that it can be opened again."""
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(folder, recursive=True)
        names = {k: [(f.rsplit("/", 1)[1], n) for f, n in v] for k, v in (("runs", self.runs), ("hashes", self.hashes))}
        with fs.open_output_stream(f"{folder}/contents.new") as out:
            out.write(json.dumps(names).encode())
        fs.move(f"{folder}/contents.new", f"{folder}/contents.json")

    def append(self, signatures: DataFrame) -> HashForest:
        """Add signatures (columns ``signature`` binary, ``batch`` int, ``asset`` long) as new runs of at most RUN each."""
        size = signatures.count()
        if size:
            parts = -(-size // (RUN * 3 // 4))  # hashing fills runs unevenly
            folder = f"{self.path}/{uuid.uuid4().hex}"
            keyed = signatures.select(F.pmod(F.xxhash64("signature"), F.lit(parts)).alias("run"), "signature", "batch", "asset")
            # A file is one row group, so that a scan never parts the rows of a run.
            keyed.groupBy("run").applyInArrow(_build, _RUN_SCHEMA).write.option("parquet.block.size", (1 << 31) - 1).parquet(folder)
            self.runs.append((folder, size))
            self._save()
        return self

    def remember(self, firsts: DataFrame) -> HashForest:
        """Add sha256 (columns ``sha``, ``batch``, ``asset``) with the first asset that has each."""
        folder = f"{self.path}/{uuid.uuid4().hex}"
        firsts.write.parquet(folder)
        self.hashes.append((folder, self.spark.read.parquet(folder).count()))
        self._save()
        return self

    def know(self, known: DataFrame) -> HashForest:
        """Add sha256 that were known before any asset, from a table with the column ``sha256``."""
        shas = known.select(F.nullif(canonical_hash(F.col("sha256")), F.lit("")).alias("sha")).where("sha is not null").distinct()
        return self.remember(shas.select("sha", F.lit(_KNOWN[0]).alias("batch"), F.lit(_KNOWN[1]).cast("long").alias("asset")))

    def firsts(self, shas: DataFrame) -> DataFrame:
        """``sha`` and its ``first`` (batch, asset) of those of the distinct ``shas`` that are stored. Few of them go to the stored tables, not the tables to them."""
        if not self.hashes:
            return shas.select("sha", F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("asset")).alias("first")).where("false")
        stored = self.spark.read.schema("sha string, batch int, asset long").parquet(*[f for f, _ in self.hashes])
        return stored.join(broadcast_if_small(shas, BROADCAST), "sha").groupBy("sha").agg(F.min(F.struct("batch", "asset")).alias("first"))

    def tidy(self) -> HashForest:
        """Merge what is small once more than MOST_SMALL of it have piled up, so that a probe reads few runs."""
        if sum(n < RUN // 2 for _, n in self.runs) > MOST_SMALL:
            self.merge()
        small = [h for h in self.hashes if h[1] < SMALL_TABLE]
        if len(small) > MOST_SMALL:
            rows = self.spark.read.parquet(*[f for f, _ in small]).groupBy("sha").agg(F.min(F.struct("batch", "asset")).alias("first")).select("sha", "first.*")
            self.hashes = [h for h in self.hashes if h not in small]
            self.remember(rows)
        return self

    def merge(self) -> HashForest:
        """Merge the runs that are smaller than half of RUN into full ones; the large ones stay as they are.

        The folders merged stay where they are: a probe that was asked for before may still read them.
        """
        small = [r for r in self.runs if r[1] < RUN // 2]
        if len(small) > 1:
            self.runs = [r for r in self.runs if r not in small]
            back = self.spark.read.parquet(*[folder for folder, _ in small]).where("tree = -1")
            self.append(back.mapInArrow(_unpack, "signature binary, batch int, asset long"))
        return self

    def probe(self, queries: DataFrame, recall: float = 1.0, radius: int = RADIUS, size: int | None = None) -> DataFrame:
        """``asset`` of each query that has an earlier signature within the radius.

        Queries have the columns ``signature``, ``batch`` and ``asset``; earlier is less in (batch, asset). ``size`` is their
        number, if known: up to BROADCAST of them are taken to the runs; of more, each task takes a block and reads all runs.
        """
        folders, last = [f for f, _ in self.runs], rounds_for(recall, radius)
        if folders and size is not None and size <= BROADCAST:
            held = self.spark.sparkContext.broadcast(_asked(queries.select("signature", "batch", "asset").toArrow()))
            runs = self.spark.read.schema(_RUN_SCHEMA).parquet(*folders)
            return runs.mapInArrow(lambda batches: _scan(batches, held.value, last, radius), "asset long").distinct()
        # A task holds its block of queries, so there are enough tasks for blocks of bounded size.
        tasks = max(2 * slots(self.spark), -(-sum(n for _, n in self.runs) // BLOCK))
        if size is not None:
            tasks = min(tasks, -(-max(1, size) // _CHUNK))
        rows = queries.select("signature", "batch", "asset").repartition(tasks)
        return rows.mapInArrow(lambda batches: _probe(batches, folders, last, radius), "asset long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["signatures", "batch", "asset"]).to_pylist():
            sig = np.frombuffer(row["signatures"], np.uint64).reshape(-1, 4).astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([sig[i : i + 32] for i in range(0, len(sig), 32)], pa.binary()), pa.array(np.frombuffer(row["batch"], np.int32)), pa.array(np.frombuffer(row["asset"], np.int64))], names=["signature", "batch", "asset"])


def _stored(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """The runs of a folder: signatures, batches, assets, and a reader per tree."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as source:
            file = pyarrow.parquet.ParquetFile(source)
            where = file.read(columns=["run", "tree"]).to_pylist()
            table = file.read(columns=["run", "tree", "signatures", "batch", "asset"]).filter(pa.compute.field("tree") == -1)
            trees = file.read(columns=["run", "tree", "keys", "rows"])
            for row in table.to_pylist():
                at = {w["tree"]: i for i, w in enumerate(where) if w["run"] == row["run"]}

                def tree(t: int, at: dict = at) -> tuple[np.ndarray, np.ndarray]:
                    return np.frombuffer(trees.column("keys")[at[t]].as_buffer(), np.uint32), np.frombuffer(trees.column("rows")[at[t]].as_buffer(), np.uint32)

                yield np.frombuffer(row["signatures"], np.uint64).reshape(-1, 4), np.frombuffer(row["batch"], np.int32), np.frombuffer(row["asset"], np.int64), tree


def search(sig: np.ndarray, batch: np.ndarray, asset: np.ndarray, run: tuple, last: int, radius: int) -> np.ndarray:
    """Which queries have an earlier signature of the run within the radius."""
    run_sig, run_batch, run_asset, tree_of = run
    found = np.zeros(len(sig), bool)
    there = [None] * TREES
    for errors in range(last + 1):  # prefixes are widened for what isn't settled
        for tree, width in enumerate(widths()):
            open_rows = np.flatnonzero(~found)
            if not len(open_rows):
                return found
            keys, rows = tree_of(tree)
            if there[tree] is None:
                there[tree] = np.zeros((1 << width) // 8, np.uint8)
                np.bitwise_or.at(there[tree], keys >> 3, np.left_shift(1, keys & 7).astype(np.uint8))
            masks = flips(width, errors)
            step = max(1, _CHUNK * 256 // len(masks))
            for start in range(0, len(open_rows), step):
                part = open_rows[start : start + step]
                wanted = (prefixes(sig[part], tree)[:, None] ^ masks[None, :]).ravel()
                hit = np.flatnonzero((there[tree][wanted >> 3] >> (wanted & 7).astype(np.uint8)) & 1)
                key = wanted[hit]
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                count = high - low
                for q, x in _spans(part[hit // len(masks)], low, count):
                    x = rows[x]
                    earlier = (run_batch[x] < batch[q]) | ((run_batch[x] == batch[q]) & (run_asset[x] < asset[q]))
                    q, x = q[earlier], x[earlier]
                    found[q[distances(sig[q], run_sig[x]) <= radius]] = True
    return found


def _spans(queries: np.ndarray, low: np.ndarray, count: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each query with each position of its range, a bounded number at a time; a range may be of any length."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, most):
        flat = np.arange(start, min(start + most, total))
        at = np.searchsorted(ends, flat, "right")
        yield queries[at], low[at] + flat - (ends[at] - count[at])


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, batches and assets of queries."""
    return words(table.column(0).to_pylist()), table.column(1).to_numpy().astype(np.int32), table.column(2).to_numpy()


def _scan(batches: Iterator[pa.RecordBatch], asked: tuple[np.ndarray, np.ndarray, np.ndarray], last: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Assets of the queries that have an earlier signature in one of the runs that a task scans; a run's rows stand together."""
    sig, batch, asset = asked
    run: dict[int, dict[str, pa.Scalar]] = {}

    def settled() -> pa.RecordBatch:
        nonlocal sig, batch, asset
        head = run[-1]
        read = lambda row, name, kind: np.frombuffer(row[name].as_buffer(), kind)
        stored = (read(head, "signatures", np.uint64).reshape(-1, 4), read(head, "batch", np.int32), read(head, "asset", np.int64), lambda t: (read(run[t], "keys", np.uint32), read(run[t], "rows", np.uint32)))
        found = search(sig, batch, asset, stored, last, radius)
        out = pa.RecordBatch.from_arrays([pa.array(asset[found])], names=["asset"])
        sig, batch, asset = sig[~found], batch[~found], asset[~found]
        run.clear()
        return out

    for rows in batches:
        for i in range(rows.num_rows):
            run[rows.column("tree")[i].as_py()] = {n: rows.column(n)[i] for n in ("signatures", "batch", "asset", "keys", "rows")}
            if len(run) == TREES + 1:
                yield settled()
    if run:
        raise ValueError("a run's rows were parted")


def _probe(batches: Iterator[pa.RecordBatch], folders: list[str], last: int, radius: int) -> Iterator[pa.RecordBatch]:
    block = [b for b in batches if b.num_rows]
    if not block:
        return
    table = pa.Table.from_batches(block)
    sig, batch, asset = _asked(table)
    for folder in folders:
        for run in _stored(folder):
            found = search(sig, batch, asset, run, last, radius)
            yield pa.RecordBatch.from_arrays([pa.array(asset[found])], names=["asset"])
            sig, batch, asset = sig[~found], batch[~found], asset[~found]


# -- the operator over a table of assets in batches


def _prepared(assets: DataFrame) -> DataFrame:
    return assets.where("asset_id is not null").select(
        F.coalesce("batch_no", F.lit(_NEVER)).alias("batch"),
        F.col("asset_id").alias("asset"),
        F.nullif(canonical_hash(F.col("sha256")), F.lit("")).alias("sha"),
        F.when((F.col("pdq_quality") >= QUALITY) & well_formed(F.col("pdq")), packed(F.col("pdq"))).alias("pdq"),
        F.filter("pdq_mirrors", well_formed).alias("mirrors"),
    )


def signature_table(prepared: DataFrame) -> DataFrame:
    """Each distinct signature once: the first asset that has it as its picture (``q``) and the first that has it at all (``i``)."""
    order = F.struct("batch", "asset")
    pictures = prepared.where("pdq is not null")
    rows = pictures.select(F.col("pdq").alias("signature"), order.alias("q"), order.alias("i")).unionByName(
        pictures.select(F.explode("mirrors").alias("m"), "batch", "asset").select(packed(F.col("m")).alias("signature"), order.alias("i")), allowMissingColumns=True
    )
    return rows.groupBy("signature").agg(F.min("q").alias("q"), F.min("i").alias("i"))


def not_new(assets: DataFrame, known: DataFrame | None, recall: float = 1.0) -> DataFrame:
    """``asset_id`` of every asset that is not new: all batches of ``assets``, each against everything before it.

    Assets are ordered by (batch_no, asset_id). One is not new if its sha256 is in ``known`` or belongs to an
    earlier asset, or if its pdq lies within 31 bits of the pdq or a mirror of an earlier one. Pictures need a
    quality of at least 50 and a well-formed pdq on both sides.

    - Exact copies are settled by keys alone: the first of each group is set apart, all others are found by an
      anti-join on asset_id, so a group of any size is never gathered in a task. Only the first asset of each
      distinct signature is searched for, and each distinct signature is stored once.
    - Null and empty sha256, malformed hashes and mirrors, null arrays and null qualities match nothing. Rows with
      a null asset_id are passed over; a null batch_no comes after all batches. Repeated rows are one asset.
    - ``known`` may be None or empty; an empty ``assets`` gives no rows. Further columns don't matter.
    """
    spark = assets.sparkSession
    prepared = _prepared(assets)
    firsts = prepared.where("sha is not null").groupBy("sha").agg(F.min(F.struct("batch", "asset")).alias("first"))
    if known is not None:
        firsts = firsts.join(known.select(canonical_hash(F.col("sha256")).alias("sha")).where("sha is not null").distinct(), "sha", "left_anti")
    by_sha = prepared.where("sha is not null").select("asset").join(firsts.select("first.asset"), "asset", "left_anti")

    table = materialize(signature_table(prepared), "signatures")
    asked = table.where("q is not null")
    copies = prepared.where("pdq is not null").select("asset").join(asked.select("q.asset"), "asset", "left_anti")
    mirrored = asked.where("i < q").select("q.asset")
    forest = HashForest(spark).append(table.select("signature", "i.*"))
    near = forest.probe(asked.where("i = q").select("signature", "q.*"), recall)
    return by_sha.union(copies).union(mirrored).union(near).select(F.col("asset").alias("asset_id")).distinct()


def not_new_in_batch(forest: HashForest, batch: DataFrame, recall: float = 1.0) -> DataFrame:
    """``asset`` of each asset of one batch that is not new by :func:`not_new`, given what the forest holds and the batch itself.

    What is known beforehand is given to the forest by ``know``. The batch's signatures and sha256 are added to the
    forest first, so later batches are checked against them too, and small runs are merged when they pile up; large
    ones are only read.
    """
    prepared = _prepared(batch)
    table = materialize(signature_table(prepared), "signatures")
    hashed = materialize(prepared.where("sha is not null").select("sha", "batch", "asset"), "hashes")
    forest.remember(hashed.groupBy("sha").agg(F.min(F.struct("batch", "asset")).alias("first")).select("sha", "first.*"))
    forest.append(table.select("signature", "i.*")).tidy()
    seen = forest.firsts(hashed.select("sha").distinct())
    by_sha = hashed.join(seen, "sha").where("first < struct(batch, asset)").select("asset")
    asked = table.where("q is not null")
    copies = prepared.where("pdq is not null").select("asset").join(asked.select("q.asset"), "asset", "left_anti")
    near = forest.probe(asked.select("signature", "q.*"), recall, size=asked.count())
    return by_sha.union(copies).union(near).distinct()


def not_new_by_batches(assets: DataFrame, known: DataFrame | None, forest: HashForest | None = None, recall: float = 1.0) -> DataFrame:
    """``asset_id`` as by :func:`not_new`, found one batch after the other against a stored forest, as batches come in."""
    forest = forest or HashForest(assets.sparkSession)
    if known is not None:
        forest.know(known)
    found = assets.select(F.col("asset_id").alias("asset")).where("false")
    for (number,) in assets.select("batch_no").distinct().orderBy(F.col("batch_no").asc_nulls_last()).toLocalIterator():
        batch = assets.where(F.col("batch_no").eqNullSafe(F.lit(number)))
        found = found.union(materialize(not_new_in_batch(forest, batch, recall), "found"))
    return found.select(F.col("asset").alias("asset_id")).distinct()
