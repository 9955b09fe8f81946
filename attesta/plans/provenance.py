"""Queries of the provenance operators over the test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import dates, hashing, media, text
from attesta.functions import dictionaries as D
from attesta.functions.text import canonical_hash, canonical_status, target_key
from attesta.operators import gates, graph, manifest, matching, pdq
from attesta.session import broadcast_if_small, table


def ends(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The numbers of the first and the last snapshot: one column is read, two values come back."""
    return tuple(table(spark, sf_dir, "asset_snapshots").agg(F.min("snapshot_no"), F.max("snapshot_no")).first())


def _results(spark: SparkSession, sf_dir: str, numbers: tuple[int | None, ...] = ()) -> DataFrame:
    """Each record of each snapshot, or of those with the numbers, as loaded last, the error status standing for an unreadable target."""
    rows = table(spark, sf_dir, "asset_snapshots")
    rows = rows.where(F.col("snapshot_no").isin(*numbers)) if numbers else rows  # before anything is aggregated
    rows = rows.select("snapshot_no", "set_name", target_key(F.col("target")).alias("target"), "ordinal", canonical_status(F.col("status")).alias("status"), "loaded_at")
    latest = rows.groupBy("snapshot_no", "set_name", "target").agg(F.max(F.struct("loaded_at", "ordinal", "status")).alias("r"))
    status = F.when(F.col("r.status") != "error", F.col("r.status"))
    # Snapshots hold no manifest stores, so nothing is traced here; the gate over reports has origins.
    return latest.select("snapshot_no", "set_name", "target", F.col("r.ordinal").alias("ordinal"), status.alias("status"), F.lit(None).cast("string").alias("origin"))


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.with_gates(_results(spark, sf_dir, ends(spark, sf_dir)[1:]), broadcast_if_small(table(spark, sf_dir, "checks"), 100_000))


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage_gate(_last(spark, sf_dir)).select("set_name", "total", "counted", "off", F.round("coverage", 6).alias("coverage"), F.size("failures").alias("failures"))


def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage_gate(_last(spark, sf_dir)).select("set_name", F.explode("failures").alias("failure"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.summary(_last(spark, sf_dir)).select("set_name", "scanned", "trusted", "missing", "listed", "more", F.round("coverage", 6).alias("coverage"), "metric")


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _last(spark, sf_dir)
    return gates.exit_codes(rows, gates.coverage_gate(rows))


def junit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.junit(_last(spark, sf_dir)).select("set_name", "target", "line")


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.text_lines(_last(spark, sf_dir), F.lit("2025-01-06"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.documents(_last(spark, sf_dir), F.struct("status")).select("set_name", "document")


def baseline_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot against the first as its baseline."""
    first, last = ends(spark, sf_dir)
    results = _results(spark, sf_dir, (first, last))
    return gates.regressions(results.where(F.col("snapshot_no") == first), results.where(F.col("snapshot_no") == last))


def dedupe_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_by_hash(table(spark, sf_dir, "assets"), F.col("asset_id")).where("copies > 1").withColumnRenamed("first", "first_id")


def register_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = matching.first_by_hash(table(spark, sf_dir, "assets"), F.col("asset_id")).select("sha256", F.col("first").alias("first_id"))
    return matching.unknown_hashes(ours, table(spark, sf_dir, "known"))


def register_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = matching.in_chunks(register_sync(spark, sf_dir), matching.REGISTER_CHUNK, "sha256")
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("items"), F.min("sha256").alias("least"), F.max("sha256").alias("most"))


def pair_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "asset_snapshots").select(target_key(F.col("target")).alias("path"))
    return matching.pair_by_stem(paths, paths).select("path", "original", "outcome")


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assets").select(media.format_for(F.col("mime_type")).alias("format"), media.mime_from_name(F.col("asset_location")).alias("by_name"), F.coalesce(media.guard_error(F.col("size_bytes"), F.col("mime_type")), F.lit("none")).alias("error"))
    return rows.groupBy("format", "by_name", "error").agg(F.count(F.lit(1)).alias("files"))


def fingerprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each picture's hash over black, and its nearest mirror, is from its own hash."""
    rows = table(spark, sf_dir, "assets").where("pdq is not null").select("asset_id", hashing.hamming(F.col("pdq"), F.col("pdq_black")).alias("black"), hashing.closest(F.array("pdq"), F.col("pdq_mirrors")).alias("mirror"))
    return rows.where("black is not null or mirror is not null").distinct()


def median_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = hashing.median_bits(F.col("embedding"), 64)
    packed = F.aggregate(F.slice(bits, 1, 63), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", packed.alias("bits"))


def exif_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture times read by the lax rule of embedded metadata."""
    value = dates.stamp(F.col("captured_at"))
    rows = table(spark, sf_dir, "exif_dates").select("exif_id", value.alias("s")).where("s is not null").distinct()
    return rows.select("exif_id", F.col("s.seconds").alias("seconds"), F.col("s.zoned").alias("zoned"), F.col("s.timed").alias("timed"), dates.iso(F.col("s")).alias("iso"))


def date_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping before ordering, and dates more than 36 hours apart, as capture dates are compared."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    seconds = lambda c: F.struct(F.unix_seconds(c).alias("seconds"), F.lit(False).alias("zoned"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    early = dates.before(seconds(F.col("l_shipdate").cast("timestamp")), seconds(F.col("o_orderdate").cast("timestamp")))
    far = F.abs(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) > dates.TOLERANCE
    return joined.groupBy(early.alias("early"), far.alias("far")).agg(F.count(F.lit(1)).alias("items"))


def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code is among a report's errors and warnings, with its explanation key and kind."""
    from attesta.functions.dictionaries import INFORMATIONAL_CODES, WARNING_CODES

    listed = lambda name: F.coalesce(F.from_json(F.get_json_object("report_json", f"$.validation.{name}"), "array<struct<code:string>>"), F.array().cast("array<struct<code:string>>"))
    rows = table(spark, sf_dir, "reports").select("report_id", F.explode(F.concat(listed("errors"), listed("warnings"))).alias("e")).select("report_id", F.col("e.code").alias("code")).where("code is not null").distinct()
    kind = F.when(F.col("code").isin(*WARNING_CODES), "warning").when(F.col("code").isin(*INFORMATIONAL_CODES), "informational").otherwise("error")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("reports")).select("code", media.explanation_key(F.col("code")).alias("explanation"), kind.alias("kind"), "reports")


def category_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per report the strongest source category and the last known source type of its actions."""
    actions = F.from_json(F.get_json_object("report_json", "$.actions"), "array<struct<digitalSourceType:string>>")
    uris = F.filter(F.transform(actions, lambda a: a["digitalSourceType"]), lambda u: u.isNotNull())
    rows = table(spark, sf_dir, "reports").select("report_id", media.declared_source(uris).alias("s")).where("s.digital_source_type is not null").distinct()
    return rows.select("report_id", F.col("s.category").alias("category"), media.source_slug(F.col("s.digital_source_type")).alias("source_type"))


def generator_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", media.made_by_ai(F.col("p_name"), ("red", "blue", "box")).alias("made"))


def store_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result document out of the manifest store of every report."""
    store = F.get_json_object("report_json", "$.raw_manifest_store")
    return manifest.extract_reports(table(spark, sf_dir, "reports"), F.col("report_id"), store)


def trace_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = table(spark, sf_dir, "reports").select(F.col("report_id").alias("store_id"), F.get_json_object("report_json", "$.raw_manifest_store").alias("store")).where("store is not null").distinct()
    return graph.trace_origins(stores)


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_escape(F.col("text"))).alias("escaped"))


def speaker_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(text.slug(F.col("speaker")).alias("slug")).agg(F.count(F.lit(1)).alias("speeches"))


def last_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "assets").groupBy(text.last_segment(F.col("asset_location")).alias("name")).agg(F.countDistinct("asset_id").alias("files"))


def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user as frames, kept greedily a day apart."""
    times = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return pdq.sampled_rows(times, "user_id", "at", 86_400).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("kept"))


def four_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the documents by which of four kinds of information they have."""
    scored = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 25).otherwise(0) for c in ("speaker", "party", "agenda_item", "reissue_of")]
    return table(spark, sf_dir, "documents").groupBy(sum(scored[1:], scored[0]).alias("score")).agg(F.count(F.lit(1)).alias("documents"))


def upsert_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks matched with the sets that assets came from, letter case apart."""
    declared = table(spark, sf_dir, "checks").select(F.col("name"))
    return matching.upsert_plan(declared, table(spark, sf_dir, "assets").select(F.col("set_name").alias("name")), "name", fold=True)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy("snapshot_no", F.coalesce("status", F.lit("unreadable")).alias("status")).agg(F.count(F.lit(1)).alias("targets"))


def carry_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done between an asset and the first asset of the same sha256."""
    rows = table(spark, sf_dir, "assets").select("asset_id", canonical_hash(F.col("sha256")).alias("sha"), "mime_type", F.struct("width", "height").alias("size"))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min(F.struct("asset_id", "mime_type", "size")).alias("f"))
    done = media.carry_actions(F.col("f.mime_type"), F.col("mime_type"), F.col("f.size"), F.col("size"))
    return rows.join(first, "sha").where("asset_id <> f.asset_id").select("asset_id", F.array_join(done, ",").alias("actions")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        coverage_gate, gate_failures, report_summary, exit_codes, junit_lines, text_report, result_documents, baseline_regressions, dedupe_sha256, register_sync, register_chunks, pair_by_stem, media_types,
        fingerprint_distance, median_bits, exif_stamp, date_anomalies, validation_codes, category_fold, generator_fallback, store_reports, trace_origins, xml_escape, speaker_slugs, last_segments,
        frame_sampler, four_cs, upsert_sets, status_counts, carry_actions,
    )
}

_RESULTS = r"""
WITH clean AS (
  SELECT snapshot_no, set_name, regexp_replace(replace(target, '\', '/'), '^(\./)+', '') AS target, ordinal, loaded_at, regexp_replace(lower(trim(status)), '[ _-]+', '_', 'g') AS s FROM asset_snapshots),
results AS (
  SELECT snapshot_no, set_name, target, ordinal, CASE WHEN s IN ('valid_trusted', 'valid_untrusted', 'present_invalid', 'absent') THEN s END AS status FROM clean
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, set_name, target ORDER BY loaded_at DESC, ordinal DESC, s DESC NULLS LAST) = 1),
gated AS (
  SELECT r.*, coalesce(c.coverage_metric, 'trusted') AS metric, c.expect, c.coverage AS threshold, coalesce(c.expect <> 'absent', true) AS expected,
    coalesce(CASE coalesce(c.coverage_metric, 'trusted') WHEN 'valid' THEN status IN ('valid_trusted', 'valid_untrusted') ELSE status = 'valid_trusted' END, false) AS covered,
    coalesce(CASE c.expect WHEN 'present' THEN status IN ('valid_trusted', 'valid_untrusted') WHEN 'trusted' THEN status = 'valid_trusted' WHEN 'absent' THEN status = 'absent' ELSE true END, false) AS met
  FROM results r LEFT JOIN checks c ON r.set_name = c.name WHERE snapshot_no = (SELECT max(snapshot_no) FROM results)),
judged AS (
  SELECT set_name, count(*) AS total, count(*) FILTER (covered) AS counted, count(*) FILTER (NOT met) AS off, any_value(expect) AS expect, any_value(threshold) AS threshold, any_value(metric) AS metric,
    CASE WHEN any_value(expected) THEN count(*) ELSE 0 END AS base FROM gated GROUP BY 1),
gate AS (
  SELECT *, CASE WHEN base = 0 THEN 100.0::double ELSE counted::double / base * 100 END AS pct FROM judged)
"""
_SHA = "lower(regexp_replace(sha256, '^\\s+|\\s+$', '', 'g'))"
_STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"



def _case(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_FORMAT = _case(D.FORMAT_OF_MIME, "trim(split_part(mime_type, ';', 1))")
_KNOWN = _case(D.CATEGORY_OF_TYPE, "slug")
_RANKS = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.CATEGORY_RANK.items()) + " END"
_LIST = lambda codes: ", ".join(f"'{c}'" for c in codes)

_WORDS = lambda a, b: "(" + " + ".join(f"bit_count(xor(('0x' || {a}[{16 * k + 1}:{16 * k + 16}])::UBIGINT, ('0x' || {b}[{16 * k + 1}:{16 * k + 16}])::UBIGINT)::BIT)" for k in range(4)) + ")"
_HEX = lambda h: f"regexp_full_match({h}, '[0-9a-fA-F]{{64}}')"
_PART = lambda i: f"regexp_extract(t, '^(\\d{{4}})([:-])(\\d{{2}})([:-])(\\d{{2}})(?:[ T](\\d{{2}}):(\\d{{2}})(?::(\\d{{2}}))?(?:\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})?)?$', {i})"

ORACLES: dict[str, str] = {
    "text_report": _RESULTS + """SELECT set_name, ordinal, concat_ws(chr(10), target, '  Content Credentials   ' || CASE WHEN status IS NULL THEN 'COULD NOT BE READ' WHEN status = 'absent' THEN 'ABSENT' ELSE 'PRESENT' END,
CASE WHEN status LIKE 'valid%' THEN '  Manifest              VALID' WHEN status = 'present_invalid' THEN '  Manifest              INVALID' END,
CASE WHEN status = 'valid_trusted' THEN '  Trust                 TRUSTED (2025-01-06)' WHEN status IN ('valid_untrusted', 'present_invalid') THEN '  Trust                 NOT ON THE TRUST LIST' END) AS text FROM gated""",
    "result_documents": _RESULTS + """SELECT set_name, '{"target":' || to_json(target)::varchar || ',"result":{' || coalesce('"status":"' || status || '"', '') || '},"coverage":{"metric":"' || metric || '","expected":' || expected::varchar || ',"covered":' || (expected AND covered)::varchar || '}}' AS document FROM gated""",
    "fingerprint_distance": f"""WITH r AS (SELECT DISTINCT asset_id, pdq, pdq_black, pdq_mirrors FROM assets WHERE {_HEX('pdq')}),
m AS (SELECT asset_id, pdq, min({_WORDS('pdq', 'h')})::int AS mirror FROM (SELECT asset_id, pdq, unnest(pdq_mirrors) AS h FROM r) WHERE {_HEX('h')} GROUP BY 1, 2),
b AS (SELECT DISTINCT asset_id, pdq, {_WORDS('pdq', 'pdq_black')}::int AS black FROM r WHERE {_HEX('pdq_black')})
SELECT coalesce(b.asset_id, m.asset_id) AS asset_id, black, mirror FROM b FULL OUTER JOIN m ON b.asset_id = m.asset_id AND b.pdq = m.pdq""",
    "exif_stamp": f"""WITH r AS (SELECT DISTINCT exif_id, trim(captured_at) AS t FROM exif_dates), p AS (SELECT exif_id, {_PART(1)} AS y, {_PART(2)} AS s1, {_PART(3)} AS mo, {_PART(4)} AS s2, {_PART(5)} AS d, {_PART(6)} AS h, {_PART(7)} AS mi, {_PART(8)} AS s, {_PART(9)} AS z FROM r),
q AS (SELECT exif_id, y::int AS y, mo::int AS mo, d::int AS d, coalesce(TRY_CAST(h AS int), 0) AS h, coalesce(TRY_CAST(mi AS int), 0) AS mi, coalesce(TRY_CAST(s AS int), 0) AS s, h <> '' AS timed, z <> '' AS zoned,
  CASE WHEN z IN ('', 'Z') THEN 0 ELSE (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::int * 3600 + z[5:6]::int * 60) END AS o, CASE WHEN z IN ('', 'Z') THEN true ELSE z[2:3]::int <= 14 AND z[5:6]::int <= 59 END AS fine FROM p WHERE y <> '' AND s1 = s2),
k AS (SELECT exif_id, zoned, timed, (epoch(make_date(y, mo, 1)) + (d - 1) * 86400 + h * 3600 + mi * 60 + s - o)::bigint AS seconds FROM q WHERE fine AND y > 0 AND mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h <= 23 AND mi <= 59 AND s <= 60)
SELECT DISTINCT exif_id, seconds, zoned, timed, CASE WHEN timed THEN strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN zoned THEN 'Z' ELSE '' END ELSE strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d') END AS iso FROM k""",
    "media_types": f"""SELECT {_FORMAT} AS format, coalesce({_case(D.MIME_OF_EXTENSION, "lower(split_part(asset_location, '.', -1))")}, 'application/octet-stream') AS by_name,
CASE WHEN size_bytes > 67108864 THEN 'limit_exceeded' WHEN {_FORMAT} IS NULL THEN 'unsupported_media_type' ELSE 'none' END AS error, count(*) AS files FROM assets GROUP BY 1, 2, 3""",
    "validation_codes": f"""WITH j AS (SELECT report_id, TRY_CAST(report_json AS JSON) AS j FROM reports), e AS (SELECT report_id, j->'$.validation.errors' AS e FROM j UNION ALL SELECT report_id, j->'$.validation.warnings' FROM j),
c AS (SELECT DISTINCT report_id, unnest(CASE json_type(e) WHEN 'ARRAY' THEN (e->>'$[*].code') WHEN 'OBJECT' THEN [e->>'$.code'] END) AS code FROM e)
SELECT code, 'validation.' || replace(code, '.', '_') AS explanation, CASE WHEN code IN ({_LIST(D.WARNING_CODES)}) THEN 'warning' WHEN code IN ({_LIST(D.INFORMATIONAL_CODES)}) THEN 'informational' ELSE 'error' END AS kind, count(*) AS reports FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "category_fold": f"""WITH j AS (SELECT DISTINCT report_id, TRY_CAST(report_json AS JSON)->'$.actions' AS a FROM reports),
u AS (SELECT report_id, unnest(CASE json_type(a) WHEN 'ARRAY' THEN range(json_array_length(a)::bigint) WHEN 'OBJECT' THEN [0::bigint] END) AS i, a FROM j),
t AS (SELECT report_id, i, split_part(CASE json_type(a) WHEN 'OBJECT' THEN a->>'$.digitalSourceType' ELSE (a->i::int)->>'$.digitalSourceType' END, '/', -1) AS slug FROM u),
k AS (SELECT report_id, i, slug, {_KNOWN} AS category FROM t WHERE slug IS NOT NULL)
SELECT report_id, arg_max(category, {_RANKS}) AS category, arg_max(slug, i) AS source_type FROM k WHERE category IS NOT NULL GROUP BY 1""",
    "carry_actions": f"""WITH r AS (SELECT DISTINCT asset_id, {_SHA} AS sha, mime_type, width, height FROM assets WHERE sha256 IS NOT NULL), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sha ORDER BY asset_id) = 1)
SELECT r.asset_id, 'c2pa.opened' || CASE WHEN trim(split_part(f.mime_type, ';', 1)) <> trim(split_part(r.mime_type, ';', 1)) THEN ',c2pa.transcoded' ELSE '' END
|| CASE WHEN f.width IS NOT NULL AND r.width IS NOT NULL AND (f.width <> r.width OR f.height <> r.height) THEN ',c2pa.resized' ELSE '' END AS actions FROM r JOIN f ON r.sha = f.sha WHERE r.asset_id <> f.asset_id""",
    "coverage_gate": _RESULTS + "SELECT set_name, total, counted, off, round(pct, 6) AS coverage, (CASE WHEN expect IS NOT NULL AND off > 0 THEN 1 ELSE 0 END + CASE WHEN threshold IS NOT NULL AND pct < threshold THEN 1 ELSE 0 END)::int AS failures FROM gate",
    "gate_failures": _RESULTS + """SELECT set_name, format('{} of {} are not {}', off, total, expect) AS failure FROM gate WHERE expect IS NOT NULL AND off > 0
UNION ALL SELECT set_name, format('coverage {:.1f}% ({} of {} {}) is below {}', pct, counted, base, metric, regexp_replace(threshold::varchar, '\\.0$', '')) FROM gate WHERE threshold IS NOT NULL AND pct < threshold""",
    "report_summary": _RESULTS + """, missing AS (SELECT set_name, target, row_number() OVER (PARTITION BY set_name ORDER BY ordinal, target) AS n FROM gated WHERE expected AND status = 'absent'),
listed AS (SELECT set_name, count(*) AS missing, string_agg(target, chr(10) ORDER BY n) FILTER (n <= 20) AS listed FROM missing GROUP BY 1),
sums AS (SELECT set_name, count(*) AS scanned, count(*) FILTER (status = 'valid_trusted') AS trusted, coalesce(avg(CASE WHEN expected THEN CASE WHEN covered THEN 100.0::double ELSE 0.0::double END END), 0.0) AS coverage, min(metric) AS metric FROM gated GROUP BY 1)
SELECT s.set_name, scanned, trusted, coalesce(missing, 0) AS missing, coalesce(listed, '') AS listed, greatest(coalesce(missing, 0) - 20, 0) AS more, round(coverage, 6) AS coverage, metric FROM sums s LEFT JOIN listed l ON s.set_name = l.set_name""",
    "exit_codes": _RESULTS + """, reads AS (SELECT set_name, bool_or(status IS NULL AND regexp_matches(target, '^https?://')) AS net, bool_or(status IS NULL AND NOT regexp_matches(target, '^https?://')) AS bad FROM gated GROUP BY 1)
SELECT r.set_name, (CASE WHEN net THEN 4 WHEN bad THEN 3 WHEN (expect IS NOT NULL AND off > 0) OR (threshold IS NOT NULL AND pct < threshold) THEN 1 ELSE 0 END)::int AS exit_code FROM reads r JOIN gate g ON r.set_name = g.set_name""",
    "junit_lines": _RESULTS + """, named AS (SELECT *, replace(replace(replace(replace(target, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS name FROM gated)
SELECT set_name, target, CASE WHEN status IS NULL THEN '  <testcase name="' || name || '"><error message="unreadable"/></testcase>' WHEN NOT expected OR covered THEN '  <testcase name="' || name || '"/>'
ELSE '  <testcase name="' || name || '"><failure message="' || status || '">credential.status is ' || status || '; not ' || metric || '</failure></testcase>' END AS line FROM named""",
    "baseline_regressions": _RESULTS + """, ranked AS (SELECT set_name, target, snapshot_no, coalesce(status, 'error') AS status, CASE status WHEN 'valid_trusted' THEN 2 WHEN 'valid_untrusted' THEN 1 ELSE 0 END AS rank FROM results)
SELECT a.set_name, a.target, a.status AS was, b.status AS now FROM ranked a JOIN ranked b ON a.set_name = b.set_name AND a.target = b.target
WHERE a.snapshot_no = (SELECT min(snapshot_no) FROM results) AND b.snapshot_no = (SELECT max(snapshot_no) FROM results) AND b.rank < a.rank""",
    "status_counts": _RESULTS + "SELECT snapshot_no, coalesce(status, 'unreadable') AS status, count(*) AS targets FROM results GROUP BY 1, 2",
    "dedupe_sha256": f"SELECT {_SHA} AS sha256, min(asset_id) AS first_id, count(*) AS copies FROM assets WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "register_sync": f"SELECT {_SHA} AS sha256, min(asset_id) AS first_id FROM assets WHERE sha256 IS NOT NULL AND {_SHA} NOT IN (SELECT {_SHA} FROM known WHERE sha256 IS NOT NULL) GROUP BY 1",
    "register_chunks": f"""WITH new AS (SELECT DISTINCT {_SHA} AS sha256 FROM assets WHERE sha256 IS NOT NULL AND {_SHA} NOT IN (SELECT {_SHA} FROM known WHERE sha256 IS NOT NULL)),
n AS (SELECT sha256, (row_number() OVER (ORDER BY sha256) - 1) // 500 AS chunk FROM new) SELECT chunk, count(*) AS items, min(sha256) AS least, max(sha256) AS most FROM n GROUP BY 1""",
    "pair_by_stem": rf"""WITH p AS (SELECT DISTINCT regexp_replace(replace(target, '\', '/'), '^(\./)+', '') AS path FROM asset_snapshots), s AS (SELECT path, {_STEM} AS stem FROM p),
j AS (SELECT a.path, count(b.path) AS n, min(b.path) AS original FROM s a LEFT JOIN s b ON a.stem = b.stem AND a.path <> b.path GROUP BY 1)
SELECT path, CASE WHEN n = 1 THEN original END AS original, CASE n WHEN 0 THEN 'unpaired' WHEN 1 THEN 'paired' ELSE 'ambiguous' END AS outcome FROM j""",
    "median_bits": "SELECT vec_id, list_reduce(list_prepend(0::bigint, list_transform(embedding[1:63], lambda v: (v > list_sort(embedding)[32])::bigint)), lambda a, b: a * 2 + b) AS bits FROM embeddings",
    "date_anomalies": "SELECT l_shipdate < o_orderdate AS early, abs(epoch(l_shipdate) - epoch(o_orderdate)) > 129600 AS far, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "generator_fallback": "SELECT p_partkey, regexp_matches(lower(p_name), 'red|blue|box') AS made FROM part",
    "xml_escape": r"""SELECT doc_id, md5(replace(replace(replace(replace(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[\x00-\x1f]', '?', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM documents""",
    "speaker_slugs": "SELECT regexp_replace(lower(speaker), '[^a-z0-9_.:-]', '_', 'g')[1:64] AS slug, count(*) AS speeches FROM documents GROUP BY 1",
    "last_segments": "SELECT regexp_extract(regexp_replace(trim(asset_location), '/+$', ''), '[^/]*$') AS name, count(DISTINCT asset_id) AS files FROM assets GROUP BY 1",
    "four_cs": "SELECT (CASE WHEN coalesce(speaker, '') <> '' THEN 25 ELSE 0 END + CASE WHEN coalesce(party, '') <> '' THEN 25 ELSE 0 END + CASE WHEN coalesce(agenda_item, '') <> '' THEN 25 ELSE 0 END + CASE WHEN reissue_of IS NOT NULL THEN 25 ELSE 0 END)::int AS score, count(*) AS documents FROM documents GROUP BY 1",
    "upsert_sets": "SELECT name, CASE WHEN lower(name) IN (SELECT lower(set_name) FROM assets WHERE set_name IS NOT NULL) THEN 'update' ELSE 'create' END AS step FROM checks",
    "frame_sampler": """WITH RECURSIVE t AS (SELECT DISTINCT user_id, floor(epoch(ts))::bigint AS s FROM events),
k AS (SELECT user_id, min(s) AS s FROM t GROUP BY 1 UNION ALL SELECT k.user_id, (SELECT min(t.s) FROM t WHERE t.user_id = k.user_id AND t.s >= k.s + 86400) AS s FROM k WHERE k.s IS NOT NULL)
SELECT user_id, count(s)::int AS kept FROM k GROUP BY 1""",
}
