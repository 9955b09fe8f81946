"""Queries over result documents, their manifest stores, and pictures whose bytes are made from known fields."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import dates, hashing, media, text
from attesta.functions import dictionaries as D
from attesta.functions.text import canonical_status, target_key
from attesta.operators import gates, headers, manifest, matching, metadata, pdq
from attesta.plans import provenance
from attesta.session import broadcast_if_small, table

DOCUMENTATION = "https://docs.example/errors"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report once, as delivered last."""
    rows = table(spark, sf_dir, "reports").where("report_id is not null")
    return rows.groupBy("report_id").agg(F.max(F.struct("delivered_at", "report_json", "set_name", "target")).alias("r")).select("report_id", "r.*")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document of each report's manifest store."""
    return manifest.extract_reports(_reports(spark, sf_dir), F.col("report_id"), F.get_json_object("report_json", "$.raw_manifest_store"))


def _listed(path: str, fields: str):
    """The objects of a list of a report; an object standing alone is a list of one."""
    return F.from_json(F.get_json_object("report_json", path), f"array<struct<{fields}>>")


def traced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the reports of each set, their origin traced through their manifest stores."""
    status = canonical_status(F.get_json_object("report_json", "$.credential.status"))
    rows = _reports(spark, sf_dir).select("report_id", "set_name", F.lit(0).alias("ordinal"), target_key(F.col("target")).alias("target"), F.when(status != "error", status).alias("status"))
    origins = _documents(spark, sf_dir).select(F.col("id").alias("report_id"), "origin")
    gated = gates.with_gates(rows.join(origins, "report_id"), broadcast_if_small(table(spark, sf_dir, "checks"), 100_000))
    return gates.coverage_gate(gated).select("set_name", "total", "counted", F.round("coverage", 6).alias("coverage"))


def store_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim and signer of each manifest store, and when it was signed."""
    return _documents(spark, sf_dir).where("status in ('valid_trusted', 'valid_untrusted', 'present_invalid')").select(
        "id", "status", "manifest_label", "generator", "title", "algorithm", "issuer", "organization", dates.signed_at(F.col("signed_at")).alias("signed_seconds")
    )


def manifest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.tree_lines(_documents(spark, sf_dir).where("category is not null"))


def manifest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each store's labels in order the first 512: how many, the first and the last."""
    store = F.from_json(F.get_json_object("report_json", "$.raw_manifest_store"), "struct<manifests:map<string,string>>")
    labels = F.slice(F.array_sort(F.map_keys(store["manifests"])), 1, D.LIMITS["manifests"])
    return _reports(spark, sf_dir).select("report_id", labels.alias("l")).where("size(l) > 0").select("report_id", F.size("l").alias("labels"), F.get("l", F.lit(0)).alias("first"), F.element_at("l", -1).alias("last"))


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of each report's errors, joined by commas."""
    codes = F.array_compact(F.transform(_listed("$.validation.errors", "code:string"), lambda e: e["code"]))
    return _reports(spark, sf_dir).select("report_id", codes.alias("c")).where("size(c) > 0").select("report_id", F.array_join("c", ",").alias("codes"))


def component_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients of each report with a credential, without one, and whether one of them is the store's own active manifest."""
    items = F.coalesce(_listed("$.ingredients", "manifest_label:string,relationship:string"), F.array().cast("array<struct<manifest_label:string,relationship:string>>"))
    active = F.get_json_object(F.get_json_object("report_json", "$.raw_manifest_store"), "$.active_manifest")
    rows = _reports(spark, sf_dir).select("report_id", items.alias("i"), active.alias("a")).where("size(i) > 0")
    signed = F.size(F.filter("i", lambda x: x["manifest_label"].isNotNull()))
    own = F.coalesce(F.exists("i", lambda x: (x["relationship"] == "parentOf") & (x["manifest_label"] == F.col("a"))), F.lit(False))
    return rows.select("report_id", signed.alias("signed"), (F.size("i") - signed).alias("unsigned"), own.alias("carried"))


def documentation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.validation_codes(spark, sf_dir).select("code", media.documentation_url(F.col("code"), DOCUMENTATION).alias("url"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = provenance.category_fold(spark, sf_dir)
    return rows.select("report_id", D.lookup(D.CATEGORY_LABEL, F.col("category")).alias("label"))


def junit_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.junit_suites(provenance._last(spark, sf_dir)).select("set_name", "tests", "failures", "metric", F.round("coverage", 6).alias("coverage"))


def baseline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.baseline_objects(provenance._last(spark, sf_dir))


def carry_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code of each set, its targets taken as items of a strict run."""
    status = F.when(F.col("status").isNull(), "error").when(F.col("status") == "present_invalid", "refused").when(F.col("status") == "absent", "unsigned").otherwise("done")
    return gates.item_exits(provenance._last(spark, sf_dir).select("set_name", status.alias("status")), strict=True)


def register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets, distinct hashes among them and those the registry doesn't know."""
    ours = matching.first_by_hash(table(spark, sf_dir, "assets"), F.col("asset_id"))
    new = matching.unknown_hashes(ours, table(spark, sf_dir, "known")).agg(F.count(F.lit(1)).alias("new"))
    return ours.agg(F.sum("copies").alias("files"), F.count(F.lit(1)).alias("distinct")).crossJoin(new)  # one row each


def tracked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the last snapshot that the first held too, as tracked files."""
    first, last = provenance.ends(spark, sf_dir)
    rows = table(spark, sf_dir, "asset_snapshots").select("snapshot_no", "set_name", target_key(F.col("target")).alias("target"))
    tracked = rows.where(F.col("snapshot_no") == first).select(F.col("target").alias("path"))
    return matching.tracked_only(rows.where(F.col("snapshot_no") == last).select("set_name", "target").distinct(), tracked)


def undeclared_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "asset_snapshots").select(F.col("set_name").alias("name")).where("name is not null").distinct()
    return matching.missing_from(sets, table(spark, sf_dir, "checks").where("coverage is not null"), "name")


def picture_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each picture compares with that of the asset before it, over white and over black."""
    rows = table(spark, sf_dir, "assets").select("asset_id", F.array("pdq", "pdq_black").alias("h"), F.col("pdq_quality").alias("q")).distinct()
    other = rows.select((F.col("asset_id") + 1).alias("asset_id"), F.col("h").alias("h2"), F.col("q").alias("q2"))
    return rows.join(other, "asset_id").select("asset_id", hashing.comparison(F.col("h"), F.col("q"), F.col("h2"), F.col("q2")).alias("outcome")).distinct()


def bundle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and certificates of bundles composed of names."""
    pem = F.array_join(F.transform(F.sequence(F.lit(1), F.col("member_id") % 4 + 1), lambda i: F.concat(F.lit("-----BEGIN CERTIFICATE-----"), F.col("family_name"), i.cast("string"))), "\n")
    rows = table(spark, sf_dir, "members").where("family_name is not null").select("member_id", pem.alias("pem")).distinct()
    return rows.select("member_id", hashing.trust_version(F.lit("2025-01-06"), F.col("pem")).alias("version"), hashing.certificate_count(F.col("pem")).alias("certificates"))


def host_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether addresses inside URLs are routable, by both forms of the guard."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k * 7919 % 256).cast("string"), (k * 104729 % 256).cast("string"), (k % 256).cast("string"), (k % 251).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.host_of(F.concat(F.lit("https://user:pw@"), ip, F.lit(":8443/a/b?c=d"))).alias("host"))
    return rows.select("c_custkey", "host", text.routable_ipv4(F.col("host")).alias("routable"), headers.routable(F.concat(F.lit("::ffff:"), "host")).alias("mapped"))


def signer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations out of subjects, and devices out of makers and models."""
    subject = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("CN=x, O="), "s_name", F.lit(", C=DE"))).otherwise(F.concat(F.lit("CN="), "s_name"))
    model = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.upper("s_name"), F.lit(" Mk2"))).otherwise(F.lit("Mk2"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.organization(subject).alias("organization"), text.device(F.col("s_name"), model).alias("device"))


def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped and unescaped again: only controls differ."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_unescape(text.xml_escape(F.col("text")))).alias("digest"))


# -- files made from known fields


def _tiff(order: str, fields: list[tuple[int, str]]) -> bytes:
    """A TIFF block with a text entry per field."""
    start, body, data = 8 + 2 + 12 * len(fields) + 4, b"", b""
    for tag, value in fields:
        raw = value.encode() + b"\0"
        body += struct.pack(order + "HHL", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "L", start + len(data)))
        data += raw if len(raw) > 4 else b""
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "LH", 8, len(fields)) + body + b"\0\0\0\0" + data


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))


def _riff(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<L", len(data)) + data + b"\0" * (len(data) & 1)


def _file(n: int, original: str, modified: str, device: str | None) -> bytes:
    """A file of one of five containers, by number, with its dates, device, creator and packet."""
    tiff = _tiff("<>"[n // 5 % 2], [(0x010F, "Acme"), *([(0x0110, device)] if device else []), (0x0132, modified), (0x9003, original)])
    xmp = b"<x:xmpmeta><rdf:Description photoshop:Credit='c&amp;d'><dc:creator><rdf:li>me</rdf:li></dc:creator></rdf:Description></x:xmpmeta>"
    iim = b"\x1c\x02\x74\x00\x01c" if n % 2 else b"\x1c\x02\x74\x80\x02\x00\x01c"
    segment = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    if n % 5 == 0:
        resource = b"8BIM\x04\x04\0\0" + struct.pack(">L", len(iim)) + iim
        return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + tiff) + b"\xff" + segment(0xED, b"Photoshop 3.0\0" + resource) + segment(0xDA, b"") + xmp
    if n % 5 == 1:
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"eXIf", tiff) + _chunk(b"iTXt", b"XML:com.adobe.xmp\0" + xmp) + _chunk(b"IEND", b"")
    if n % 5 == 2:
        return b"RIFF\0\0\0\0WEBP" + _riff(b"VP8 ", b"abc") + _riff(b"EXIF", b"Exif\0\0" + tiff) + _riff(b"XMP ", xmp)
    return tiff + xmp if n % 5 == 3 else b"\0\0\0\x1cftypheic" + b"junk" + b"Exif\0\0" + tiff


def planted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scanners find in files of five containers, made from the read times and devices of ``exif_dates``."""
    stamp = lambda c: F.date_format(c, "yyyy:MM:dd HH:mm:ss")
    days = F.make_interval(days=(F.col("exif_id") % 3 - 1).cast("int"))
    rows = table(spark, sf_dir, "exif_dates").where("exif_id is not null and read_at is not null").select("exif_id", stamp(F.col("read_at")).alias("o"), stamp(F.col("read_at") + days).alias("m"), "device").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [_file(n, o, m, d) for n, o, m, d in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(files, pa.binary())], names=["k", "c"])

    found = metadata.embedded_metadata(rows.mapInArrow(run, "k string, c binary"), F.col("k"), F.col("c"))
    return found.select(F.col("key").cast("long").alias("exif_id"), "four_cs_score", F.array_join("fields", ",").alias("fields"), "captured_at", "device", F.array_join("anomalies", ",").alias("anomalies"))


def _png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">LLBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _scene(n: int) -> np.ndarray:
    """A picture of waves that depend on a number."""
    y, x = np.mgrid[0:96, 0:128] / 128
    a, b, c = 9 + n % 7, 5 + n % 11, 3 + n % 5
    planes = [np.sin(a * 3 * x + b * y * y) * np.cos(c * 4 * y), np.sin(b * 4 * x * y + c * y + n % 13), np.cos(a * 2 * x - b * 2 * y)]
    return np.clip(128 + 120 * np.stack(planes, 2), 0, 255).astype(np.uint8)


def picture_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pictures made from the ids of ``members``: whether the hash of each mirror image is near the mirror hash, a flat one has no quality, and a scene has."""
    ids = table(spark, sf_dir, "members").select(F.col("member_id").cast("long").alias("n")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n in batch.column(0).to_pylist():
                scene = _scene(n)
                flat = np.full((64, 64, 3), n % 256, np.uint8)
                rows += [(f"{n} {name}", _png(np.ascontiguousarray(p))) for name, p in (("plain", scene), ("left", scene[:, ::-1]), ("up", scene[::-1]), ("flat", flat))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["k", "c"])

    found = pdq.fingerprints(ids.mapInArrow(run, "k string, c binary"), F.col("k"), F.col("c"))
    part = lambda name, c: F.first(F.when(F.col("key").endswith(name), c), True)
    by_id = found.groupBy(F.split("key", " ")[0].cast("long").alias("member_id")).agg(
        part("plain", F.col("mirrors")).alias("m"), part("left", F.col("pdq")).alias("left"), part("up", F.col("pdq")).alias("up"), part("flat", F.col("quality")).alias("flat"), part("plain", F.col("quality")).alias("quality")
    )
    near = lambda c: F.exists("m", lambda m: hashing.hamming(m, F.col(c)) < 64)
    return by_id.select("member_id", near("left").alias("mirrored"), near("up").alias("upended"), (F.col("flat") == 0).alias("flat"), (F.col("quality") >= 50).alias("clear"))


def _header(kind: str, width: int, height: int) -> bytes:
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">LLBBBBB", width, height, 8, 2, 0, 0, 0))
    if kind == "webp":
        return b"RIFF\0\0\0\0WEBP" + _riff(b"VP8X", b"\0\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
    if kind == "gif":
        return b"GIF89a" + struct.pack("<HH", width, height)
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x09\x08" + struct.pack(">HH", height, width) + b"\1\1"


def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions read back out of headers made from the sizes of ``assets``, and whether the format is one of animations."""
    form = media.format_for(F.col("mime_type"))
    rows = table(spark, sf_dir, "assets").where("asset_id is not null and width between 1 and 65535 and height between 1 and 65535").select("asset_id", F.coalesce(form, F.lit("jpeg")).alias("form"), "width", "height").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, forms, *sizes = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string()), pa.array([_header(*f) for f in zip(forms, *sizes)], pa.binary())], names=["asset_id", "form", "c"])

    made = rows.mapInArrow(run, "asset_id long, form string, c binary").withColumn("d", headers.dimensions("c"))
    return made.select("asset_id", F.col("d.width").alias("width"), F.col("d.height").alias("height"), headers.is_animation("c", "form").alias("animation"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        traced_gate, store_claims, manifest_trees, manifest_labels, error_codes, component_counts, documentation_links, source_labels, junit_suites, baseline_files, carry_exits, register_totals, tracked_targets,
        undeclared_sets, picture_comparisons, bundle_versions, host_addresses, signer_names, xml_round_trip, planted_metadata, picture_mirrors, header_sizes,
    )
}

_LATEST = "rep AS (SELECT report_id, set_name, target, TRY_CAST(report_json AS JSON) AS j FROM reports WHERE report_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY delivered_at DESC NULLS LAST, report_json DESC NULLS LAST) = 1)"
#: The walk over a store: every path of at most eight followed edges from its active manifest; the least hit is kept.
_TRACE = r"""st AS (SELECT report_id, TRY_CAST(j->>'$.raw_manifest_store' AS JSON) AS s FROM rep),
man AS (SELECT report_id, s, unnest(json_keys(s->'manifests')) AS label FROM st WHERE json_type(s->'manifests') = 'OBJECT'),
bodies AS (SELECT report_id, s, label, json_extract(s, '$.manifests."' || label || '"')->'ingredients' AS ing FROM man),
items AS (SELECT report_id, s, label, i AS idx, ing->(i::int) AS item FROM (SELECT *, unnest(range(json_array_length(ing)::bigint)) AS i FROM bodies WHERE json_type(ing) = 'ARRAY')),
judged AS (SELECT report_id, label, idx, item->>'$.relationship' AS relation, item->>'$.active_manifest' AS to_label, list_contains(json_keys(s->'manifests'), item->>'$.active_manifest') AS known,
  CASE WHEN NOT list_has_any(json_keys(item), ['active_manifest', 'c2pa_manifest', 'manifest_data']) THEN 'absent'
    WHEN json_type(item->'validation_status') = 'ARRAY' AND len(list_filter(json_extract_string(item, '$.validation_status[*].code'), lambda c: c = 'signingCredential.untrusted')) < json_array_length(item->'validation_status') THEN 'present_invalid'
    ELSE 'valid_untrusted' END AS status FROM items WHERE json_type(item) = 'OBJECT'),
broken AS (SELECT report_id, label FROM judged WHERE relation = 'componentOf' AND status = 'present_invalid' GROUP BY ALL),
edges AS (SELECT j.report_id, j.label AS from_label, idx, relation = 'componentOf' AS part, to_label FROM judged j LEFT JOIN broken b ON j.report_id = b.report_id AND j.label = b.label
  WHERE relation IN ('parentOf', 'componentOf') AND status = 'valid_untrusted' AND known AND NOT (relation = 'componentOf' AND b.label IS NOT NULL)),
start AS (SELECT report_id, CASE WHEN list_contains(json_keys(s->'manifests'), s->>'$.active_manifest') THEN s->>'$.active_manifest' ELSE json_keys(s->'manifests')[1] END AS label,
  CASE WHEN json_type(s->'trusted_manifests') = 'ARRAY' THEN json_extract_string(s, '$.trusted_manifests[*]') ELSE [] END AS listed, coalesce(s->>'$.validation_state', '') AS state FROM st WHERE json_type(s) = 'OBJECT'),
walk AS (SELECT report_id, label, listed, 0 AS depth, []::BIGINT[] AS path, false AS hit FROM start WHERE state NOT IN ('Invalid', 'Trusted')
  UNION ALL SELECT w.report_id, e.to_label, w.listed, w.depth + 1, list_append(w.path, e.idx + CASE WHEN e.part THEN 1000000 ELSE 0 END), list_contains(w.listed, e.to_label)
  FROM walk w JOIN edges e ON w.report_id = e.report_id AND w.label = e.from_label WHERE NOT w.hit AND w.depth < 8),
best AS (SELECT report_id, arg_min({'depth': depth, 'label': label, 'path': path}, {'d': depth, 'p': path}) AS b FROM walk WHERE hit GROUP BY 1)
"""
_WORD = lambda j: f"CASE WHEN json_type({j}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN nullif(json_extract_string({j}, '$'), '') END"
_HAMMING = lambda a, b: "(" + " + ".join(f"bit_count(xor(('0x' || {a}[{16 * k + 1}:{16 * k + 16}])::UBIGINT, ('0x' || {b}[{16 * k + 1}:{16 * k + 16}])::UBIGINT)::BIT)" for k in range(4)) + ")"
_HEX = lambda h: f"regexp_full_match({h}, '[0-9a-fA-F]{{64}}')"
_ITEMS = lambda path: f"CASE json_type(json_extract(j, '{path}')) WHEN 'ARRAY' THEN json_extract(j, '{path}[*]') WHEN 'OBJECT' THEN [json_extract(j, '{path}')] ELSE [] END"
_NO_TAIL = ("-----BEGIN CERTIFICATE-----",)

ORACLES: dict[str, str] = {
    "traced_gate": f"WITH RECURSIVE {_LATEST}, {_TRACE}" + r""", rows AS (SELECT r.report_id, r.set_name, regexp_replace(lower(trim(j->>'$.credential.status')), '[ _-]+', '_', 'g') AS s,
  CASE WHEN st.state = 'Trusted' OR b.report_id IS NOT NULL THEN 'traced' END AS origin FROM rep r LEFT JOIN start st ON r.report_id = st.report_id LEFT JOIN best b ON r.report_id = b.report_id),
results AS (SELECT set_name, origin, CASE WHEN s IN ('valid_trusted', 'valid_untrusted', 'present_invalid', 'absent') THEN s END AS status FROM rows),
gated AS (SELECT r.*, coalesce(c.expect <> 'absent', true) AS expected, coalesce(CASE coalesce(c.coverage_metric, 'trusted') WHEN 'valid' THEN status IN ('valid_trusted', 'valid_untrusted')
  WHEN 'traced' THEN status = 'valid_trusted' OR (origin = 'traced' AND status = 'valid_untrusted') ELSE status = 'valid_trusted' END, false) AS covered FROM results r LEFT JOIN checks c ON r.set_name = c.name)
SELECT set_name, count(*) AS total, count(*) FILTER (covered) AS counted, round(CASE WHEN any_value(expected) THEN count(*) FILTER (covered)::double / count(*) * 100 ELSE 100.0 END, 6) AS coverage FROM gated GROUP BY 1""",
    "trace_origins": f"WITH RECURSIVE rep AS (SELECT DISTINCT report_id, TRY_CAST(report_json AS JSON) AS j FROM reports), {_TRACE} SELECT report_id AS store_id, b.depth AS depth, b.label AS to_label, CASE WHEN b.path[-1] >= 1000000 THEN 'componentOf' ELSE 'parentOf' END AS relationship FROM best",
    "store_claims": f"WITH RECURSIVE {_LATEST}, {_TRACE}" + f""", act AS (SELECT t.report_id, label, state, json_extract(s, '$.manifests."' || label || '"') AS m FROM start t JOIN st ON t.report_id = st.report_id),
c AS (SELECT *, CASE json_type(m->'claim_generator_info') WHEN 'ARRAY' THEN m->'$.claim_generator_info[0].name' END AS g, {_WORD("m->'$.signature_info.issuer'")} AS issuer, {_WORD("m->'$.signature_info.time'")} AS time FROM act)
SELECT report_id AS id, CASE state WHEN 'Invalid' THEN 'present_invalid' WHEN 'Trusted' THEN 'valid_trusted' ELSE 'valid_untrusted' END AS status, nullif(label, '') AS manifest_label, coalesce({_WORD("g")}, {_WORD("m->'claim_generator'")}) AS generator,
({_WORD("m->'title'")})[1:200] AS title, lower({_WORD("m->'$.signature_info.alg'")}) AS algorithm, issuer, CASE WHEN regexp_matches(issuer, '(^|,)\\s*O=') THEN trim(regexp_extract(issuer, '(?:^|,)\\s*O=([^,]*)', 1)) ELSE issuer END AS organization,
CASE WHEN regexp_full_match(time, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|[+-]\\d{{2}}:\\d{{2}})') THEN floor(epoch(TRY_CAST(time AS TIMESTAMPTZ)))::bigint END AS signed_seconds FROM c""",
    "manifest_labels": f"WITH {_LATEST}, st AS (SELECT report_id, TRY_CAST(j->>'$.raw_manifest_store' AS JSON) AS s FROM rep), l AS (SELECT report_id, list_sort(json_keys(s->'manifests'))[1:512] AS l FROM st WHERE json_type(s->'manifests') = 'OBJECT') SELECT report_id, len(l)::int AS labels, l[1] AS first, l[-1] AS last FROM l WHERE len(l) > 0",
    "error_codes": f"WITH {_LATEST}, c AS (SELECT report_id, list_filter(list_transform({_ITEMS('$.validation.errors')}, lambda e: e->>'$.code'), lambda c: c IS NOT NULL) AS c FROM rep) SELECT report_id, array_to_string(c, ',') AS codes FROM c WHERE len(c) > 0",
    "component_counts": f"""WITH {_LATEST}, i AS (SELECT report_id, {_ITEMS('$.ingredients')} AS i, TRY_CAST(j->>'$.raw_manifest_store' AS JSON)->>'$.active_manifest' AS a FROM rep)
SELECT report_id, len(list_filter(i, lambda x: (x->>'$.manifest_label') IS NOT NULL))::int AS signed, (len(i) - len(list_filter(i, lambda x: (x->>'$.manifest_label') IS NOT NULL)))::int AS unsigned,
len(list_filter(i, lambda x: coalesce((x->>'$.relationship') = 'parentOf' AND (x->>'$.manifest_label') = a, false))) > 0 AS carried FROM i WHERE len(i) > 0""",
    "documentation_links": f"SELECT code, '{DOCUMENTATION}#' || replace(code, '.', '-') AS url FROM ({provenance.ORACLES['validation_codes']}) v",
    "source_labels": f"SELECT report_id, {provenance._case(D.CATEGORY_LABEL, 'category')} AS label FROM ({provenance.ORACLES['category_fold']}) c",
    "junit_suites": provenance._RESULTS + """SELECT set_name, count(*) AS tests, count(*) FILTER (status IS NOT NULL AND expected AND NOT covered) AS failures, min(metric) AS metric,
round(coalesce(avg(CASE WHEN expected THEN CASE WHEN covered THEN 100.0::double ELSE 0.0::double END END), 0.0), 6) AS coverage FROM gated GROUP BY 1""",
    "baseline_files": provenance._RESULTS + """SELECT set_name, '{' || string_agg(to_json(target)::varchar || ':"' || coalesce(status, 'error') || '"', ',' ORDER BY target) || '}' AS value FROM gated GROUP BY 1""",
    "carry_exits": provenance._RESULTS + "SELECT set_name, (CASE WHEN bool_or(status IS NULL) THEN 2 WHEN bool_or(coalesce(status = 'present_invalid', false)) THEN 5 WHEN bool_or(coalesce(status = 'absent', false)) THEN 1 ELSE 0 END)::int AS exit_code FROM gated GROUP BY 1",
    "register_totals": f"""WITH o AS (SELECT {provenance._SHA} AS s, count(*) AS n FROM assets WHERE sha256 IS NOT NULL GROUP BY 1)
SELECT sum(n)::bigint AS files, count(*) AS "distinct", count(*) FILTER (s NOT IN (SELECT {provenance._SHA} FROM known WHERE sha256 IS NOT NULL)) AS new FROM o""",
    "tracked_targets": r"""WITH r AS (SELECT snapshot_no, set_name, regexp_replace(replace(target, '\', '/'), '^(\./)+', '') AS target FROM asset_snapshots)
SELECT DISTINCT set_name, target FROM r WHERE snapshot_no = (SELECT max(snapshot_no) FROM r) AND (regexp_matches(target, '^https?://') OR target IN (SELECT target FROM r WHERE snapshot_no = (SELECT min(snapshot_no) FROM r)))""",
    "undeclared_sets": "SELECT DISTINCT set_name AS name FROM asset_snapshots WHERE set_name IS NOT NULL AND set_name NOT IN (SELECT name FROM checks WHERE coverage IS NOT NULL)",
    "picture_comparisons": f"""WITH r AS (SELECT DISTINCT asset_id, pdq, pdq_black, pdq_quality AS q FROM assets), h AS (SELECT DISTINCT asset_id, h FROM (SELECT asset_id, unnest([pdq, pdq_black]) AS h FROM r) WHERE {_HEX('h')}),
d AS (SELECT a.asset_id, min({_HAMMING('a.h', 'b.h')}) AS d FROM h a JOIN h b ON a.asset_id = b.asset_id + 1 GROUP BY 1)
SELECT DISTINCT a.asset_id, CASE WHEN d IS NULL THEN 'unavailable' WHEN a.q < 50 OR b.q < 50 THEN 'low_quality' WHEN d <= 31 THEN 'match' ELSE 'differs' END AS outcome FROM r a JOIN r b ON a.asset_id = b.asset_id + 1 LEFT JOIN d ON a.asset_id = d.asset_id""",
    "bundle_versions": f"""WITH p AS (SELECT DISTINCT member_id, array_to_string(list_transform(range(1, member_id % 4 + 2), lambda i: '{_NO_TAIL[0]}' || family_name || i), chr(10)) AS pem FROM members WHERE family_name IS NOT NULL)
SELECT member_id, '2025-01-06-' || sha256(pem)[1:12] AS version, (member_id % 4 + 1)::int AS certificates FROM p""",
    "host_addresses": """WITH o AS (SELECT c_custkey, (c_custkey * 7919::bigint) % 256 AS a, (c_custkey * 104729::bigint) % 256 AS b, c_custkey % 256 AS c, c_custkey % 251 AS d FROM customer),
r AS (SELECT c_custkey, a || '.' || b || '.' || c || '.' || d AS host, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS routable FROM o) SELECT *, routable AS mapped FROM r""",
    "signer_names": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 'CN=' || s_name END AS organization, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) || ' Mk2' ELSE s_name || ' Mk2' END AS device FROM supplier",
    "xml_round_trip": r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[\x00-\x1f]', '?', 'g'), '&lt;', '&lt;'), '&gt;', '&gt;'), '&quot;', '&quot;'), '&apos;', ''''), '&amp;', '&amp;')) AS digest FROM documents""",
    "planted_metadata": """WITH r AS (SELECT DISTINCT exif_id, strftime(read_at, '%Y-%m-%dT%H:%M:%S') AS o, device FROM exif_dates WHERE exif_id IS NOT NULL AND read_at IS NOT NULL)
SELECT exif_id, (CASE exif_id % 5 WHEN 4 THEN 0 ELSE 50 END)::int AS four_cs_score, CASE exif_id % 5 WHEN 0 THEN 'Copyright,Creator,CreditLine,DateCreated' WHEN 4 THEN 'DateCreated' ELSE 'Creator,CreditLine,DateCreated' END AS fields, o AS captured_at,
CASE WHEN device IS NULL THEN 'Acme' WHEN starts_with(lower(device), 'acme') THEN device ELSE 'Acme ' || device END AS device, CASE WHEN exif_id % 3 = 0 THEN 'modified_before_capture' ELSE '' END AS anomalies FROM r""".replace("WHEN 4 THEN 0 ELSE 50 END)", "WHEN 4 THEN 0 WHEN 0 THEN 75 ELSE 50 END)"),
    "picture_mirrors": "SELECT DISTINCT member_id::bigint AS member_id, true AS mirrored, true AS upended, true AS flat, true AS clear FROM members",
    "header_sizes": f"SELECT DISTINCT asset_id, width, height, coalesce({provenance._FORMAT}, 'jpeg') = 'gif' AS animation FROM assets WHERE asset_id IS NOT NULL AND width BETWEEN 1 AND 65535 AND height BETWEEN 1 AND 65535",
}
