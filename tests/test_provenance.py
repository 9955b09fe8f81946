import base64
import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import dates, hashing, media, text
from attesta.operators import graph, headers, manifest, metadata, pdq
from attesta.sources import sinks, targets


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).collect()[0][0]


def ask(manifests, state="Valid", **more):
    return manifest.report({"active_manifest": "a", "validation_state": state, "manifests": manifests} | more)


def source(kind):
    return [{"label": "c2pa.actions.v2", "data": {"actions": [{"action": "c2pa.created", "digitalSourceType": "http://cv.iptc.org/newscodes/digitalsourcetype/" + kind}]}}]


def part(label, relation="parentOf", **more):
    return {"relationship": relation, "active_manifest": label} | more


def test_status_and_origin():
    assert [(r["status"], r["origin"], r["origin_depth"]) for r in (ask({"a": {}}, s) for s in ("Trusted", "Valid", "Invalid"))] == [("valid_trusted", "traced", 0), ("valid_untrusted", "untraced", None), ("present_invalid", "none", None)]


def test_source_is_inherited():
    ai, camera = {"assertions": source("trainedAlgorithmicMedia")}, {"assertions": source("digitalCapture")}
    got = ask({"a": {"ingredients": [part("p")]}, "p": ai})
    assert (got["category"], got["inherited"]) == ("ai_generated", True)
    got = ask({"a": camera | {"ingredients": [part("p")]}, "p": ai})
    assert (got["category"], got["inherited"]) == ("camera", False)
    assert ask({"a": {"ingredients": [part("p", validation_status=[{}])]}, "p": ai})["category"] == "unknown"
    assert ask({"a": {"ingredients": [part("p", "componentOf")]}, "p": ai})["category"] == "ai_composite"
    assert ask({"a": {"claim_generator": "Some Firefly 2"}})["category"] == "ai_generated"


def test_depth_cycles_and_invalid_components():
    chain = lambda n: {"a": {"ingredients": [part("m1")]}} | {f"m{i}": {"ingredients": [part(f"m{i + 1}")]} for i in range(1, n)} | {f"m{n}": {"assertions": source("digitalCapture")}}
    assert [ask(chain(n))["category"] for n in (8, 9)] == ["camera", "unknown"]
    assert ask({"a": {"ingredients": [part("a")]}})["origin"] == "untraced"
    two = {"a": {"ingredients": [part("p"), part("q")]}, "p": {"ingredients": [part("t")]}, "q": {}, "t": {}}
    assert ask(two, trusted_manifests=["q", "t"])["origin_depth"] == 1
    broken = {"a": {"ingredients": [part("t", "componentOf"), part("t", "componentOf", validation_status=[{"code": "x"}])]}, "t": {}}
    assert ask(broken, trusted_manifests=["t"])["origin"] == "untraced"
    wide = {"a": {"ingredients": [part("a")] * 40}}
    assert ask(wide)["origin"] == "untraced"  # the budget ends it


def test_validation_codes_and_limits():
    raw = {"validation_results": {"activeManifest": {"success": [{"code": "s"}], "informational": [{"code": "i"}, {"code": "timeStamp.mismatch"}], "failure": [{"code": "f"}, {"code": "f"}, {"code": "timeStamp.trusted"}]}}, "validation_status": [{"code": "g"}, {}, 5]}
    got = ask({"a": {}}, **raw)
    assert (got["errors"], got["warnings"]) == (["f", "g"], ["timeStamp.mismatch"])
    many = ask({"a": {"assertions": [{"label": "c2pa.actions", "data": {"actions": [{"action": "x"}] * 128}}]}}, validation_status=[{"code": f"c{i}"} for i in range(1024)])
    assert (len(many["actions"]), len(many["errors"])) == (64, 64)


def test_text_keeps_numbers_and_refuses_the_rest():
    assert [manifest.text(v) for v in ("a", "", 2, 2.5, True, None, [], {})] == ["a", None, "2", "2.5", None, None, None, None]


def test_stores_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, "nope"), (3, "[]"), (None, "{}")], "i long, s string")
    got = {(r.id, r.status) for r in manifest.extract_reports(df, F.col("i"), F.col("s")).collect()}
    assert got == {(1, "absent"), (2, "error"), (3, "error"), (None, "valid_untrusted")}


def test_relational_tracing_equals_the_walk(spark):
    rng, rows = random.Random(4), []
    for n in range(300):
        labels = [f"m{i}" for i in range(rng.randint(2, 7))]

        def ingredient():
            item = part(rng.choice([*labels, "zz"]), rng.choice(["parentOf", "parentOf", "componentOf", "inputTo"]))
            if rng.random() < 0.15:
                del item["active_manifest"]
            if rng.random() < 0.2:
                item["validation_status"] = [{"code": rng.choice(["signingCredential.untrusted", "bad.code"])}]
            if rng.random() < 0.1:
                item["manifest_data"] = None
            return item

        store = {"active_manifest": rng.choice([*labels, None]), "validation_state": rng.choice(["Valid", "Valid", "Invalid"]), "trusted_manifests": rng.sample(labels, 1), "manifests": {x: {"ingredients": [ingredient() for _ in range(rng.randint(0, 2))]} for x in labels}}
        rows.append((n, json.dumps(store)))
    df = spark.createDataFrame(rows, "store_id long, store string")
    joined = {(r.store_id, r.depth, r.relationship) for r in graph.trace_origins(df).collect()}
    walked = {(r.id, r.origin_depth, r.origin_relationship) for r in manifest.extract_reports(df, F.col("store_id"), F.col("store")).where("origin_depth > 0").collect()}
    assert joined == walked and joined


def test_dates(spark):
    stamp = lambda t: one(spark, dates.stamp(F.col("t")), t=t)
    assert stamp("2026:03:14 09:21:30").seconds == 1773480090
    assert stamp("2026-02-31").seconds == stamp("2026-03-03").seconds
    assert stamp("2026-03-14T09:21:30+02:00").zoned and stamp("2026-03-14T09:21:30+02:00").seconds == 1773480090 - 7200
    for bad in ("2026:03-14 09:21:30", "0000:01:01", "2026:13:01", "2026:01:32", "2026:01:01 24:00:00", "2026:01:01 10:00:00+15:00", "x", "", None):
        assert stamp(bad) is None
    assert one(spark, dates.iso(dates.stamp(F.col("t"))), t="2026:03:14") == "2026-03-14"


def test_strings(spark):
    assert one(spark, text.target_key(F.col("t")), t="././a\\b") == "a/b"
    assert one(spark, text.host_of(F.col("t")), t="https://u:p@[::1]:80/x") == "::1"
    assert one(spark, text.host_of(F.col("t")), t="http://a.example:80?x") == "a.example"
    assert [one(spark, text.routable_ipv4(F.col("t")), t=t) for t in ("8.8.8.8", "10.0.0.1", "100.64.0.1", "198.18.0.1", "255.1.1.1", "host", "1.2.3")] == [True, False, False, False, False, None, None]
    assert one(spark, text.organization(F.col("t")), t="CN=x, O=Org, C=y") == "Org"
    assert one(spark, text.device(F.col("a"), F.col("b")), a="Canon", b="CANON EOS") == "CANON EOS"
    assert one(spark, text.device(F.col("a"), F.col("b")), a="Canon", b=None) == "Canon"
    assert one(spark, media.source_slug(F.col("t")), t="http://x/y/print") == "print"
    assert one(spark, hashing.hamming(F.col("a"), F.col("b")), a="0" * 64, b="F" * 64) == 256
    assert one(spark, hashing.hamming(F.col("a"), F.col("b")), a="0" * 63, b="F" * 64) is None


XMP = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description Iptc4xmpExt:AISystemUsed="Image Model &lt;v2&gt;" photoshop:Credit="  "><dc:creator><rdf:Seq><rdf:li>Me</rdf:li></rdf:Seq></dc:creator><!-- <dc:title>no</dc:title> --><dc:rights><![CDATA[(c) me]]></dc:rights><dc:description/></bogus><Iptc4xmpExt:DigitalSourceType>http://cv/x/trainedAlgorithmicMedia/</Iptc4xmpExt:DigitalSourceType></rdf:Description></rdf:RDF></x:xmpmeta>'


def tiff(entries, order="<"):
    """A TIFF block of text entries."""
    body, data = b"", b""
    base = 8 + 2 + 12 * len(entries) + 4
    for tag, value in entries:
        raw = value.encode() + b"\0"
        where = struct.pack(order + "L", base + len(data)) if len(raw) > 4 else raw.ljust(4, b"\0")
        data += raw if len(raw) > 4 else b""
        body += struct.pack(order + "HHL", tag, 2, len(raw)) + where
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "L", 8) + struct.pack(order + "H", len(entries)) + body + b"\0\0\0\0" + data


def test_metadata(spark):
    exif = b"Exif\0\0" + tiff([(0x010F, "Canon"), (0x0110, "Canon EOS R6"), (0x0132, "2026:03:13 09:00:00"), (0x9003, "2026:03:14 09:21:30")], ">")
    iim = b"\x1c\x02\x6e\x00\x03abc" + b"\x1c\x02\x50\x80\x02\x00\x01x"
    resources = b"8BIM\x04\x04\x00\x00" + struct.pack(">L", len(iim)) + iim
    segment = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    jpeg = b"\xff\xd8" + segment(0xE1, exif) + segment(0xED, b"Photoshop 3.0\0" + resources) + b"\xff\xda" + XMP.encode()
    df = spark.createDataFrame([("a", bytearray(jpeg)), ("b", bytearray(b"\xff\xd8\xff")), ("c", None), ("d", bytearray(jpeg[:70]))], "k string, content binary")
    got = {r.key: r for r in metadata.embedded_metadata(df, F.col("k"), F.col("content")).collect()}
    a = got["a"]
    assert a.fields == sorted(["AISystemUsed", "Copyright", "Creator", "CreditLine", "DateCreated", "DigitalSourceType"])
    assert (a.four_cs_score, a.digital_source_type, a.ai_system_used, a.captured_at, a.device, a.anomalies) == (75, "trainedAlgorithmicMedia", "Image Model <v2>", "2026-03-14T09:21:30", "Canon EOS R6", ["modified_before_capture"])
    assert got["b"].fields == got["c"].fields == [] and got["d"].captured_at is None
    for cut in range(0, len(jpeg), 7):
        metadata.scan(jpeg[:cut])


def png(pixels):
    h, w, c = pixels.shape
    chunk = lambda k, d: struct.pack(">L", len(d)) + k + d + struct.pack(">L", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">LLBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def scene(h, w):
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    return np.clip(np.stack([128 + 110 * np.sin(21 * x + 9 * y * y) * np.cos(13 * y), 128 + 120 * np.sin(29 * x * y + 5 * y), 128 + 120 * np.cos(17 * x - 11 * y)], 2), 0, 255).astype(np.uint8)


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_pdq(spark):
    a, big = scene(200, 300), scene(800, 1200)
    clear = np.dstack([a, np.where(np.mgrid[0:200, 0:300][0] < 90, 0, 255).astype(np.uint8)])
    files = {"a": png(a), "big": png(big), "inverted": png(255 - a), "flat": png(np.full((64, 64, 3), 90, np.uint8)), "mirror": png(a[:, ::-1].copy()), "clear": png(clear), "bad": b"\x89PNG\r\n\x1a\nxx", "null": None}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "k string, content binary")
    got = {r.key: r for r in pdq.fingerprints(df, F.col("k"), F.col("content")).collect()}
    assert distance(got["a"].pdq, got["big"].pdq) <= 31 and distance(got["a"].pdq, got["inverted"].pdq) > 128
    assert got["flat"].quality == 0 and got["a"].black is None and got["clear"].black is not None
    assert distance(got["mirror"].pdq, got["a"].pdq) > 31 >= distance(got["mirror"].pdq, got["a"].mirrors[0])
    assert got["bad"].pdq is None and got["null"].pdq is None


def test_frames(spark):
    df = spark.createDataFrame([([0, 400, 999, 1000, 1500, 2600],)], "t array<bigint>")
    assert df.select(pdq.sampled(F.col("t"), F.lit(1000))).collect()[0][0] == [0, 1000, 2600]
    hashes = ["0" * 64, "0" * 63 + "3", "0" * 63 + "7", "f" * 64]
    assert spark.createDataFrame([(hashes,)], "h array<string>").select(pdq.changed_frames(F.col("h"))).collect()[0][0] == [hashes[0], hashes[2], hashes[3]]


def test_sources_and_sinks(spark, tmp_path):
    assert targets.braces("x{a,b}.{jpg,png}") == ["xa.jpg", "xa.png", "xb.jpg", "xb.png"] and targets.braces("x{a") == ["x{a"]
    (tmp_path / "a.png").write_bytes(b"x")
    got = {(r.target.rsplit("/", 1)[-1], r.mime, r.error_code) for r in targets.media_files(spark, [str(tmp_path / "*.png"), "https://x.example/y"], offline=True).collect()}
    assert got == {("a.png", "image/png", None), ("y", None, "offline")}
    assert targets.checks(spark, '{"checks":[{"name":"n","coverage":80}]}').collect()[0].coverage == 80.0
    rows = spark.createDataFrame([("s", 0, "t", "absent", None, "trusted", None, None)], "set_name string, ordinal int, target string, status string, origin string, metric string, expect string, threshold double")
    sinks.write_reports(rows, [("text", str(tmp_path / "t")), ("junit", str(tmp_path / "j")), ("ndjson", str(tmp_path / "n"))])
    assert "ABSENT" in spark.read.text(str(tmp_path / "t")).toPandas().value.str.cat()
    more = rows.union(spark.createDataFrame([("s", 1, "./a", None, None, "trusted", None, None), ("q", 0, "z", "valid_trusted", None, "trusted", None, None)], rows.schema))
    sinks.write_baseline(more, str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b" / "set_name=s")).collect()[0].value == '{"a":"error","t":"absent"}'
    assert {tuple(r) for r in targets.baselines(spark, str(tmp_path / "b")).select("set_name", "target", "status").collect()} == {("s", "a", "error"), ("s", "t", "absent"), ("q", "z", "valid_trusted")}


def test_target_expansion(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("d/a.jpg", "d/b.txt", "d/e/c.jpg", "d/e/x.png"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda *t: sorted((r.target.rsplit("/", 1)[-1], r.error_code) for r in targets.media_files(spark, [f"{tmp_path}/{x}" for x in t]).collect())
    assert names("d/**/*.jpg") == [("a.jpg", None), ("c.jpg", None)] and names("d/*.jpg", "d/*.jpg") == [("a.jpg", None)] * 2
    assert names("d/{a,q}.jpg") == [("a.jpg", None), ("q.jpg", "unreadable")] and names("d/b.txt") == [("b.txt", "unsupported_media_type")]
    with pytest.raises(FileNotFoundError):
        names("d/**/*.gif")
    with pytest.raises(ValueError):
        targets.checks(spark, '{"checks":[{"name":""}]}')


def test_trust_list_and_certificates(spark, tmp_path):
    pem = "".join(f"-----BEGIN CERTIFICATE-----\n{base64.b64encode(d).decode()}\n-----END CERTIFICATE-----\n" for d in (b"one", b"two"))
    (tmp_path / "a.pem").write_text(pem)
    (tmp_path / "bad.pem").write_text("nothing")
    source = lambda *a, **k: targets.trust_list(spark, *a, "2025-01-06", **k)
    a, bad = str(tmp_path / "a.pem"), str(tmp_path / "bad.pem")
    assert [source(a, a, None)[1], source(None, a, a)[1], source(None, a, a, offline=True)[1], source(None, a, bad)[1]] == ["custom", "cached", "bundled", "bundled"]
    row = source(None, a, None)[0].select("version", "certificates", headers.certificate_digests("pem").alias("d")).collect()[0]
    assert (row.version, row.certificates, row.d) == ("2025-01-06-" + hashlib.sha256(pem.encode()).hexdigest()[:12], 2, [hashlib.sha256(x).hexdigest() for x in (b"one", b"two")])
    df = spark.createDataFrame([(s,) for s in ("official", "interim", "both", "none", None)], "s string")
    assert [r[0] for r in df.select(headers.anchors(F.lit("a"), F.lit("b"), F.col("s"))).collect()] == ["a", "b", "a\nb", "", ""]


def test_headers(spark):
    webp = lambda kind, d: b"RIFF" + struct.pack("<L", len(d) + 12) + b"WEBP" + kind + struct.pack("<L", len(d)) + d
    files = {
        "png": b"\x89PNG\r\n\x1a\n" + struct.pack(">L", 13) + b"IHDR" + struct.pack(">LL", 30, 20) + b"\x08\x02\0\0\0" + b"crc.", "gif": b"GIF89a" + struct.pack("<HH", 30, 20),
        "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x09\x08" + struct.pack(">HH", 20, 30) + b"\x01\x01", "vp8x": webp(b"VP8X", b"\x02\0\0\0" + (29).to_bytes(3, "little") + (19).to_bytes(3, "little")),
        "vp8l": webp(b"VP8L", b"\x2f" + (29 | 19 << 14).to_bytes(4, "little") + b"\0"), "vp8": webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30, 20)),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("cut", bytearray(files["png"][:18])), ("none", None)], "k string, c binary")
    got = {r.k: (r.d.width, r.d.height, r.d.error) for r in df.select("k", headers.dimensions("c").alias("d")).collect()}
    assert got == {k: (30, 20, None) for k in files} | {"cut": (None, None, None), "none": (None, None, None)}
    huge = files["gif"][:6] + struct.pack("<HH", 60_000, 60_000)
    assert headers.size_of(huge) == (60_000, 60_000) and spark.createDataFrame([(bytearray(huge),)], "c binary").select(headers.dimensions("c").error).collect()[0][0] == "limit_exceeded"
    assert [headers.animated(files[k], f) for k, f in (("gif", "gif"), ("png", "png"), ("vp8x", "webp"), ("vp8l", "webp"))] == [True, False, True, False]
    assert headers.animated(b"\0\0\0\x18ftypavis", "avif") and not headers.animated(b"\0\0\0\x18ftypavif", "avif")


def test_addresses_times_and_placeholders(spark):
    hosts = {"8.8.8.8": True, "10.1.1.1": False, "192.0.2.1": False, "2600::1": True, "::1": False, "fe80::1": False, "fc00::1": False, "2001:db8::1": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "host": None}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r[0]: r[1] for r in df.select("h", headers.routable("h")).collect()} == hosts
    assert [one(spark, dates.signed_at(F.col("t")), t=t) for t in ("2026-03-14T09:21:30Z", "2026-03-14T11:21:30.9+02:00", "2026-03-14", "x", None)] == [1773480090, 1773480090, None, None, None]
    mark, sig = b"m" * 64, b"s" * 64
    place = b"\x58\x40" + mark
    rows = [(b"a" + place + b"z", mark, sig), (b"a", mark, sig), (place + place, mark, sig), (place, mark, b"s"), (None, mark, sig)]
    df = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in rows], "c binary, p binary, s binary")
    got = [(None if r.content is None else bytes(r.content), r.error) for r in df.select(headers.patched("c", "p", "s").alias("r")).select("r.*").collect()]
    assert got == [(b"a\x58\x40" + sig + b"z", None), (None, "placeholder_missing"), (None, "placeholder_ambiguous"), (None, "signature_size"), (None, "placeholder_missing")]


def test_png_filters_are_undone():
    rng = np.random.default_rng(1)
    for channels in (1, 3, 4):
        pixels = rng.integers(0, 256, (23, 17, channels)).astype(np.int32)
        kinds = rng.integers(0, 5, 23)
        padded = np.zeros((24, 18, channels), np.int32)
        padded[1:, 1:] = pixels
        left, above, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
        a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = np.stack([np.zeros_like(left), left, above, (left + above) // 2, paeth])[kinds, np.arange(23)]
        assert (pdq._unfiltered(kinds, ((pixels - guess) & 255).astype(np.uint8)) == pixels).all()


def test_rows_are_sampled_and_lead_frames_picked(spark):
    df = spark.createDataFrame([("a", t) for t in (2600, 0, 400, 999, 1000, 1500)] + [("b", 5), ("b", None), (None, 7)], "k string, t long")
    assert sorted(map(tuple, pdq.sampled_rows(df, "k", "t", 1000).collect())) == [("a", 0), ("a", 1000), ("a", 2600), ("b", 5)]
    frames = spark.createDataFrame([([("x", 10), ("y", 60), ("z", 90)],), ([("x", 10)],), ([],)], "f array<struct<hash:string,quality:int>>")
    assert [r[0] and r[0].hash for r in frames.select(pdq.lead_frame(F.col("f"))).collect()] == ["y", "x", None]
