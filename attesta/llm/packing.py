"""Filling containers of fixed capacity with texts, sized in tokens of a public tokenizer.

Bounded-space online packing: each partition keeps a fixed number of open windows per container kind. An
item goes into the open window that it leaves the least room in (best fit); where none fits, the fullest
window is closed and a new one opened. The windows left open at the end of the partitions are merged: their
contents, now items themselves, are packed again, within groups of bounded size.

The texts are tokenised once for all capacities, in the same pass, and never leave their partition.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import broadcast_if_small, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Open windows per partition and container kind.
OPEN = 64
#: Partitions whose leftover windows are merged in one group, so that a group has at most OPEN times as many.
FAN_IN = 256
_SMALL = 1_000_000

SCHEMA = "container_kind string, container_id long, doc_id long, piece_no int, start_token long, n_tokens long, leftover boolean"
_ARROW = pa.schema([("container_kind", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("leftover", pa.bool_())])


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; a null text has none."""
    encode = _encoder(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


class Windows:
    """The open windows of one container kind: bounded best fit."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.open: list[tuple[int, int]] = []  # (room, id), ascending

    def place(self, size: int) -> int:
        """The id of the window that an item of at most the capacity goes into."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest is closed
            room, window = self.capacity, self.next_id
            self.next_id += 1
        if room > size or size == 0:
            bisect.insort(self.open, (room - size, window))
        return window

    def whole(self) -> int:
        """The id of a window that one piece fills by itself."""
        self.next_id += 1
        return self.next_id - 1


def _pack(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, int]], path: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    windows = {kind: Windows(capacity, OPEN, part) for kind, capacity in kinds}
    for batch in batches:
        ids, sizes = batch.column(0).to_pylist(), token_counts(batch.column(1).to_pylist(), path)
        for kind, open_windows in windows.items():
            rows, capacity = [], open_windows.capacity
            for doc, size in zip(ids, sizes):
                whole, rest = divmod(size, capacity) if size > capacity else (0, size)
                for piece in range(whole):
                    rows.append((open_windows.whole(), doc, piece, piece * capacity, capacity, False))
                if rest or not whole:
                    rows.append((open_windows.place(rest), doc, whole, whole * capacity, rest, False))
            yield _batch(kind, rows)
    for kind, open_windows in windows.items():
        # What is still open, and how full: no item, only a mark for the merge.
        yield _batch(kind, [(window, None, -1, 0, open_windows.capacity - room, True) for room, window in open_windows.open])


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:])]], schema=_ARROW)


def _merge(capacities: dict[str, int]):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit of the fullest first; a window that nothing joins keeps its id."""
        pdf = pdf.sort_values(["n_tokens", "container_id"], ascending=[False, True])
        free: list[tuple[int, int]] = []
        into = []
        for used, window in zip(pdf["n_tokens"], pdf["container_id"]):
            at = bisect.bisect_left(free, (used, -1))
            room, target = free.pop(at) if at < len(free) else (capacities[pdf["container_kind"].iloc[0]], window)
            bisect.insort(free, (room - used, target))
            into.append(target)
        return pd.DataFrame({"container_kind": pdf["container_kind"], "container_id": pdf["container_id"], "merged": into})

    return merge


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Which container each text, or piece of a text, goes into, for every kind of container.

    Columns: ``container_kind``, ``container_id``, ``doc_id``, ``piece_no`` (from 0), ``start_token``, ``n_tokens``.
    A text larger than the capacity is cut: its full pieces fill containers of their own, the rest is placed like
    any text; no other text is split.

    - Null and empty texts have 0 tokens and are placed too, so every row of ``documents`` has its place in each
      kind; repeated rows are items of their own, a null doc_id stays null.
    - Container kinds with a null name or without a positive capacity are passed over, repeated ones count once.
      Without documents or containers there are no rows. Further columns don't matter.
    - ``tokenizer`` is the vocabulary's path on every executor.
    """
    kinds = [(r[0], r[1]) for r in containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens")).orderBy("container_kind").collect()]
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text"))
    if not kinds:
        return rows.sparkSession.createDataFrame([], SCHEMA).drop("leftover")
    placed = materialize(rows.mapInArrow(lambda batches: _pack(batches, kinds, tokenizer), SCHEMA), "packing")
    group = (F.shiftright("container_id", 32) / FAN_IN).cast("long")
    merged = placed.where("leftover").groupBy("container_kind", group).applyInPandas(_merge(dict(kinds)), "container_kind string, container_id long, merged long")
    moved = broadcast_if_small(merged.where("merged <> container_id"), _SMALL)
    final = placed.where("not leftover").join(moved, ["container_kind", "container_id"], "left")
    return final.select("container_kind", F.coalesce("merged", "container_id").alias("container_id"), "doc_id", "piece_no", "start_token", "n_tokens")
