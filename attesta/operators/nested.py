"""Deeply nested semi-structured records as flat tables with Merkle subtree identities.

Objects are canonicalised and hashed bottom-up: an object's identity covers its scalars and the
identities of everything below it, so equal subtrees have equal identities wherever they occur. Each
distinct object is stored once; every occurrence is kept as a bridge row with its path, its parent and
its ordinal. From both tables the documents can be rebuilt (:func:`rebuild`).

A document is read in one Arrow-batched pass; no document is compared with another but by identity.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In these fields an object standing alone counts as the only element of a list.
LIST_FIELDS = frozenset({"actions", "ingredients", "errors", "warnings", "assertions", "validation_status", "claim_generator_info"})
#: The values of an object under this key are nodes like the elements of a list.
MAP_FIELD = "manifests"
#: A text under this key is read as the object that it holds.
EMBEDDED_FIELD = "raw_manifest_store"

NODE_SCHEMA = "record_id long, node_path string, parent_path string, node_id string, parent_id string, field string, ordinal int, body string"
_ARROW = pa.schema([("record_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("field", pa.string()), ("ordinal", pa.int32()), ("body", pa.string())])
#: Most repeated records that are broadcast; of more, all texts are compared.
MOST_REPEATED = 200_000
#: Nodes per Arrow batch handed back.
_OUT = 20_000


class Number(str):
    """A number as it is written: no digits are lost, and equal spellings are equal."""


def _refuse(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))', re.DOTALL)


def parse(text: str | None) -> Any:
    """The value of a JSON text of any depth; ValueError where it is none."""
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """As :func:`parse`, with a stack of its own in place of recursion."""
    out: list[Any] = []
    stack: list[tuple[Any, str | None]] = [(out, None)]
    want, at = "value", 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        mark, string, number, word = m.groups()
        box, key = stack[-1]
        if want in ("value", "value or end") and mark in ("{", "[", None):
            if mark is None and string is not None and isinstance(box, dict) and key is None:
                stack[-1], want = (box, json.loads(string)), ":"
                continue
            if isinstance(box, dict) and key is None:
                want = "nothing"
                break
            value = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string is not None else Number(number) if number is not None else json.loads(word)
            if isinstance(box, dict):
                box[key] = value
                stack[-1] = (box, None)
            else:
                box.append(value)
            if mark:
                stack.append((value, None))
                want = "value or end"
            else:
                want = "next" if len(stack) > 1 else "end"
        elif want in ("next", "value or end") and mark == ("}" if isinstance(box, dict) else "]") and len(stack) > 1:
            stack.pop()
            want = "next" if len(stack) > 1 else "end"
        elif want == "next" and mark == ",":
            want = "value"
        elif want == ":" and mark == ":":
            want = "value"
        else:
            want = "nothing"
            break
    if want != "end" or text[at:].strip(" \t\n\r"):
        raise ValueError("no JSON")
    return out[0]


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _text(value: str) -> str:
    """What Arrow can hold: a lone surrogate becomes ``?``."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode()


def nodes(document: Any) -> list[tuple[str, str, str, str, str, int, str]]:
    """(node_path, parent_path, node_id, parent_id, field, ordinal, body) of the root, under the path "", and of every node.

    ``body`` is the object's canonical JSON; nodes below it stand in it as ``{"@": node_id}``.
    """
    # Entries in pre-order: value, path, index of the enclosing entry, key or position in it, whether it is a node.
    entries: list[tuple[Any, str, int, Any, bool]] = []
    stack: list[tuple[Any, str, int, Any, bool]] = [(document, "", -1, None, True)]
    while stack:
        value, path, up, key, is_node = stack.pop()
        at = len(entries)
        entries.append((value, path, up, key, is_node))
        if isinstance(value, dict):
            labelled = key == MAP_FIELD and isinstance(key, str)
            for k, x in value.items():
                below = f"{path}/{_escaped(k)}"
                if not labelled:
                    if k == EMBEDDED_FIELD and isinstance(x, str) and not isinstance(x, Number):
                        try:
                            held = parse(x)
                        except ValueError:
                            held = None
                        x = held if isinstance(held, dict) else x
                    if k in LIST_FIELDS and isinstance(x, dict):
                        x = [x]
                stack.append((x, below, at, k, labelled and isinstance(x, dict)))
        elif isinstance(value, list):
            for i, x in enumerate(value):
                stack.append((x, f"{path}/{i}", at, i, isinstance(x, dict)))

    # Children come after their parents, so backwards every child is complete before it is used.
    parts: list[Any] = [{} if isinstance(v, dict) else [] if isinstance(v, list) else None for v, *_ in entries]
    ids: list[str] = [""] * len(entries)
    bodies: list[str] = [""] * len(entries)
    for at in range(len(entries) - 1, -1, -1):
        value, _, up, key, is_node = entries[at]
        if isinstance(value, dict):
            text = "{" + ",".join(f"{json.dumps(k)}:{t}" for k, t in sorted(parts[at].items())) + "}"
        elif isinstance(value, list):
            text = "[" + ",".join(parts[at]) + "]"
        else:
            text = str(value) if isinstance(value, Number) else json.dumps(value)
        parts[at] = None
        if is_node:
            ids[at] = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
            bodies[at] = text
            text = f'{{"@":"{ids[at]}"}}'
        if up >= 0:
            if isinstance(parts[up], dict):
                parts[up][key] = text
            else:
                parts[up].append(text)

    nearest = [-1] * len(entries)
    out = []
    for at, (_, path, up, key, is_node) in enumerate(entries):
        around = nearest[up] if up >= 0 else -1
        nearest[at] = at if is_node else around
        if is_node:
            ordinal = key if isinstance(key, int) else -1
            field = entries[up][3] if isinstance(key, int) else key
            out.append((path, entries[around][1] if around >= 0 else "", ids[at], ids[around] if around >= 0 else "", str(field) if field is not None else "", ordinal, bodies[at]))
    return out


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array([_text(x) if isinstance(x, str) else x for x in c], t.type) for c, t in zip(columns, _ARROW)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    for incoming in batches:
        for record, text in zip(incoming.column(0).to_pylist(), incoming.column(1).to_pylist()):
            try:
                document = parse(text)
            except ValueError:
                continue
            for path, parent, node, above, field, ordinal, body in nodes(document):
                rows.append((record, path, parent, node, above, field, ordinal, body))
            if len(rows) >= _OUT:
                yield batch()
    if rows:
        yield batch()


def _once(rows: DataFrame) -> DataFrame:
    """Distinct rows of (record_id, text). Ids and hashes are grouped; texts are shuffled only of those that come repeatedly."""
    keyed = rows.withColumn("__hash", F.xxhash64("text"))
    again = keyed.groupBy("record_id", "__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = again.limit(MOST_REPEATED + 1).toArrow()
    if found.num_rows > MOST_REPEATED:
        return rows.distinct()
    if not found.num_rows:
        return rows
    again = F.broadcast(rows.sparkSession.createDataFrame(found, schema=again.schema))
    return keyed.join(again, ["record_id", "__hash"], "left_anti").drop("__hash").unionByName(keyed.join(again, ["record_id", "__hash"], "left_semi").drop("__hash").distinct())


def flatten_records(df: DataFrame, record: Column, text: Column) -> DataFrame:
    """Every occurrence of an object, one row each: the bridge with the object's body. Schema: NODE_SCHEMA.

    A node is each object that is an element of an array, or a value of an object named ``manifests``, at any
    depth; in LIST_FIELDS an object standing alone counts as element 0 of a list; a text under
    ``raw_manifest_store`` is read as the object it holds. The root has the path "". Positions count all elements.

    Null texts, texts that are no JSON (NaN and Infinity included) and null records give no rows. A repeated
    record gives its rows once; different texts under one record give the rows of each. A root that is no
    object has nodes too. An empty table gives no rows; further columns don't matter.
    """
    rows = df.select(record.cast("long").alias("record_id"), text.alias("text")).where("record_id is not null and text is not null")
    return _once(rows).mapInArrow(_flatten, NODE_SCHEMA)


def bridge(flat: DataFrame) -> DataFrame:
    """Parent-child links: one row per occurrence, without the bodies."""
    return flat.drop("body")


def objects(flat: DataFrame) -> DataFrame:
    """Each distinct object once: ``node_id``, ``body`` and how often it occurs. The aggregate combines before the shuffle."""
    return flat.groupBy("node_id").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences"))


def rebuild(node_id: str, bodies: dict[str, str]) -> Any:
    """The object of an identity, out of the stored bodies (for tests and inspection of single records)."""

    def fill(value: Any) -> Any:
        if isinstance(value, dict):
            if value.keys() == {"@"}:
                return rebuild(value["@"], bodies)
            return {k: fill(v) for k, v in value.items()}
        return [fill(v) for v in value] if isinstance(value, list) else value

    return fill(json.loads(bodies[node_id]))


def report_nodes(reports: DataFrame) -> DataFrame:
    """``report_id``, ``node_path`` and ``parent_path`` of the nodes inside the reports, the roots left out."""
    flat = bridge(flatten_records(reports, F.col("report_id"), F.col("report_json")))
    return flat.where("node_path <> ''").select(F.col("record_id").alias("report_id"), "node_path", "parent_path").distinct()
