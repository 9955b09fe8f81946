"""Metadata embedded in picture files (Exif, IPTC, XMP), scanned tolerantly from their bytes in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import dates
from attesta.functions.dictionaries import EXIF_FIELDS, IIM_FIELDS, SCORED_FIELDS, XMP_FIELDS

MOST_SEGMENTS, MOST_ENTRIES, MOST_PACKETS, MOST_DEPTH, MOST_CHARS = 4096, 1024, 8, 256, 256
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_DATES = {0x0132: "modified", 0x9003: "original", 0x9004: "digitized", 0x9010: "offset_modified", 0x9011: "offset_original", 0x9012: "offset_digitized", 0x010F: "make", 0x0110: "model"}
_XMP_DATES = {"xmp:CreateDate": "xmp_created", "xmp:ModifyDate": "xmp_modified", "photoshop:DateCreated": "xmp_date"}
_SLOTS = ("modified", "original", "digitized", "offset_modified", "offset_original", "offset_digitized", "make", "model", "xmp_created", "xmp_modified", "xmp_date", "source_type", "ai_system")
_IGNORED = {"rdf:parseType", "xml:lang", "rdf:about", "x:xmptk"}


def _unpack(form: str, data: bytes, at: int) -> int | None:
    size = struct.calcsize(form)
    return struct.unpack_from(form, data, at)[0] if 0 <= at <= len(data) - size else None


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the picture data; fill bytes and markers without payload are skipped."""
    at, count = 2, 0
    while count < MOST_SEGMENTS and data[at : at + 1] == b"\xff":
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        marker = _unpack(">B", data, at + 1)
        if marker in (None, 0xD9, 0xDA):
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        length = _unpack(">H", data, at + 2)
        if length is None or length < 2 or at + 2 + length > len(data):
            return
        yield marker, data[at + 4 : at + 2 + length]
        count += 1
        at += 2 + length


def _chunks(data: bytes, at: int, form: str, head: int, tail) -> Iterator[tuple[bytes, bytes]]:
    for _ in range(MOST_SEGMENTS):
        length, kind = _unpack(form, data, at + head), data[at + 4 - head : at + 8 - head]
        if length is None or len(kind) < 4 or at + 8 + length > len(data):
            return
        yield kind, data[at + 8 : at + 8 + length]
        if kind == b"IEND":
            return
        at += 8 + length + tail(length)


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    return _chunks(data, 8, ">L", 0, lambda n: 4)


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    return _chunks(data, 12, "<L", 4, lambda n: n & 1)


def photoshop_iptc(data: bytes) -> Iterator[bytes]:
    """The IPTC blocks among image resources."""
    at = 0
    for _ in range(MOST_SEGMENTS):
        name = _unpack(">B", data, at + 6)
        if data[at : at + 4] != b"8BIM" or name is None:
            return
        size_at = at + 6 + (name + 2 & ~1)
        size = _unpack(">L", data, size_at)
        if size is None or size_at + 4 + size > len(data):
            return
        if _unpack(">H", data, at + 4) == 0x0404:
            yield data[size_at + 4 : size_at + 4 + size]
        at = size_at + 4 + size + (size & 1)


def iim_fields(data: bytes) -> Iterator[str]:
    """Names of the fields of record 2 that hold text; lengths may be extended."""
    at = 0
    while data[at : at + 1] == b"\x1c":
        length = _unpack(">H", data, at + 3)
        if length is None:
            return
        start = at + 5
        if length & 0x8000:
            width = length & 0x7FFF
            if not 1 <= width <= 4 or start + width > len(data):
                return
            length, start = int.from_bytes(data[start : start + width], "big"), start + width
        if start + length > len(data):
            return
        if data[at + 1] == 2 and has_text(data[start : start + length]) and data[at + 2] in IIM_FIELDS:
            yield IIM_FIELDS[data[at + 2]]
        at = start + length


def has_text(data: bytes) -> bool:
    return bool(data.strip(b"\0 \t\n\f\r"))


def tiff_entries(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, value bytes) of the first directory and of the Exif directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or _unpack(order + "H", data, 2) != 42:
        return
    todo, seen = [_unpack(order + "L", data, 4)], set()
    while todo:
        at = todo.pop(0)
        count = None if at is None or at in seen else _unpack(order + "H", data, at)
        seen.add(at)
        for k in range(min(count or 0, MOST_ENTRIES)):
            entry = at + 2 + 12 * k
            tag, kind, number = _unpack(order + "H", data, entry), _unpack(order + "H", data, entry + 2), _unpack(order + "L", data, entry + 4)
            if number is None or kind not in _SIZES:
                continue
            size = number * _SIZES[kind]
            start = entry + 8 if size <= 4 else _unpack(order + "L", data, entry + 8)
            if start is None or start + size > len(data):
                continue
            if tag == 0x8769 and len(seen) == 1:
                todo.append(_unpack(order + "L", data, entry + 8))
            yield tag, data[start : start + size]


def xmp_packets(data: bytes) -> list[str]:
    found = re.findall(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.DOTALL)[:MOST_PACKETS]
    return [p.decode("utf-8", "replace") for p in found]


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?!\[|--)[^>]*>|</(?P<close>[^\s>]+)\s*>|<(?P<open>[^\s/>]+)(?P<attrs>(?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>|(?P<text>[^<]+)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def unescape(value: str) -> str:
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = value.replace(entity, mark)
    return value


def scan_xmp(packet: str, fields: set[str], slots: dict[str, str]) -> None:
    """Mark the fields of a packet: text, or an attribute, marks its element and every open field around it."""
    stack: list[str] = []

    def mark(names: list[str], value: str) -> None:
        if not value.strip():
            return
        for name in names:
            if name in XMP_FIELDS:
                fields.add(XMP_FIELDS[name])
                slot = {"DigitalSourceType": "source_type", "AISystemUsed": "ai_system"}.get(XMP_FIELDS[name])
                if slot:
                    slots.setdefault(slot, unescape(value.strip())[:MOST_CHARS])
            if name in _XMP_DATES:
                slots.setdefault(_XMP_DATES[name], value.strip())

    for m in _XML.finditer(packet):
        if m["open"]:
            around = [*stack, m["open"]]
            for name, a, b in _ATTRIBUTE.findall(m["attrs"]):
                if name not in _IGNORED and not name.startswith("xmlns"):
                    mark([*around, name], a or b)
            if not m["empty"] and len(stack) < MOST_DEPTH:
                stack.append(m["open"])
        elif m["close"]:
            if m["close"] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(m["close"]) :]
        elif (value := m["cdata"] if m["cdata"] is not None else m["text"]) is not None:
            mark(stack, value)


def scan(data: bytes | None) -> dict:
    """Fields found, and the raw text of the dates, makers and source type, of one file; never raises."""
    fields: set[str] = set()
    slots: dict[str, str] = {}
    data = data or b""
    tiffs, iptc = [], []
    if data[:2] == b"\xff\xd8":
        for marker, payload in jpeg_segments(data):
            if marker == 0xE1 and payload[:6] == b"Exif\0\0":
                tiffs.append(payload[6:])
            if marker == 0xED and payload[:14] == b"Photoshop 3.0\0":
                iptc += photoshop_iptc(payload[14:])
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        tiffs += [d for k, d in png_chunks(data) if k == b"eXIf"]
    elif data[:4] == b"RIFF":
        tiffs += [d[6:] if d[:6] == b"Exif\0\0" else d for k, d in riff_chunks(data) if k == b"EXIF"]
    elif data[:4] in (b"II*\0", b"MM\0*"):
        tiffs.append(data)
    elif (at := data.find(b"Exif\0\0")) >= 0:
        tiffs.append(data[at + 6 :])
    for tiff in tiffs:
        for tag, value in tiff_entries(tiff):
            if tag in EXIF_FIELDS and has_text(value):
                fields.add(EXIF_FIELDS[tag])
            if tag in _DATES and (text := value.decode("utf-8", "replace").strip("\0 \t\r\n\f\v")[:MOST_CHARS]):
                slots.setdefault(_DATES[tag], text)
            if tag == 0x83BB:
                iptc.append(value)
    for block in iptc:
        fields.update(iim_fields(block))
    for packet in xmp_packets(data):
        scan_xmp(packet, fields, slots)
    return {"fields": sorted(fields), **{k: slots.get(k) for k in _SLOTS}}


def embedded_metadata(files: DataFrame, key: Column, content: Column) -> DataFrame:
    """Per file: score, fields, source type, AI system, capture time, device and anomalies. Null contents have none of them."""
    schema = "key string, fields array<string>, " + ", ".join(f"{s} string" for s in _SLOTS)
    arrow = pa.schema([("key", pa.string()), ("fields", pa.list_(pa.string())), *[(s, pa.string()) for s in _SLOTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # contents are large
                part = batch.slice(at, 16)
                yield pa.RecordBatch.from_pylist([{"key": k, **scan(c)} for k, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], schema=arrow)

    found = files.select(key.cast("string").alias("key"), content.alias("content")).mapInArrow(run, schema)
    stamps = {s: dates.stamp(F.col(s)) for s in ("modified", "original", "digitized", "xmp_created", "xmp_modified", "xmp_date")}
    offsets = tuple(dates.offset_seconds(F.col(f"offset_{s}")) for s in ("modified", "digitized", "original"))
    from attesta.functions.text import device, last_segment

    return found.select(
        "key", (F.size(F.array_intersect("fields", F.array(*map(F.lit, SCORED_FIELDS)))) * 25).alias("four_cs_score"), "fields", last_segment(F.col("source_type")).alias("digital_source_type"),
        F.col("ai_system").alias("ai_system_used"), dates.iso(F.coalesce(stamps["original"], stamps["xmp_date"])).alias("captured_at"), device(F.col("make"), F.col("model")).alias("device"),
        dates.anomalies(stamps["modified"], stamps["digitized"], stamps["original"], stamps["xmp_created"], stamps["xmp_modified"], stamps["xmp_date"], offsets).alias("anomalies"),
    )
