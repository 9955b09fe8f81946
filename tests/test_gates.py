from attesta.operators import gates, matching

SCHEMA = "set_name string, ordinal int, target string, status string, origin string, metric string, expect string, threshold double"


def gated(spark, statuses, metric="trusted", expect=None, threshold=None):
    return spark.createDataFrame([("s", i, f"t{i}", s, o, metric, expect, threshold) for i, (s, o) in enumerate(statuses)], SCHEMA)


def gate(spark, *args, **kw):
    return gates.coverage_gate(gated(spark, *args, **kw)).collect()[0]


def test_messages(spark):
    row = gate(spark, [("valid_trusted", "traced"), ("absent", "none")], expect="trusted", threshold=80.0)
    assert row.failures == ["1 of 2 are not trusted", "coverage 50.0% (1 of 2 trusted) is below 80"]


def test_metrics(spark):
    rows = [("valid_trusted", "traced"), ("valid_untrusted", "traced"), ("valid_untrusted", "untraced"), ("absent", "none")]
    assert [gate(spark, rows, metric=m).coverage for m in ("trusted", "traced", "valid")] == [25.0, 50.0, 75.0]


def test_unreadable_and_nothing_expected(spark):
    row = gate(spark, [(None, None)], expect="absent", threshold=99.0)
    assert (row.coverage, row.off, row.failures) == (100.0, 1, ["1 of 1 are not absent"])
    assert gate(spark, [(None, None), ("valid_trusted", None)], threshold=50.0).failures == []
    assert gates.coverage_gate(gated(spark, [])).count() == 0


def test_summary_lists_twenty(spark):
    row = gates.summary(gated(spark, [("absent", None)] * 23 + [("valid_trusted", None)])).collect()[0]
    assert (row.scanned, row.trusted, row.missing, row.more) == (24, 1, 23, 3)
    assert row.listed.split("\n") == [f"t{i}" for i in range(20)]
    assert gates.summary(gated(spark, [("absent", None)], expect="absent")).collect()[0].coverage == 0.0


def test_regressions(spark):
    side = lambda d: spark.createDataFrame([("s", t, s) for t, s in d.items()], "set_name string, target string, status string")
    before = side({"a": "valid_trusted", "b": "valid_trusted", "c": "valid_untrusted", "d": "present_invalid", "gone": "valid_trusted"})
    now = side({"./a": "valid_trusted", ".\\b": "valid_untrusted", "c": None, "d": "absent", "new": "absent"})
    assert {(r.target, r.was, r.now) for r in gates.regressions(before, now).collect()} == {("b", "valid_trusted", "valid_untrusted"), ("c", "valid_untrusted", "error")}


def test_junit_escapes(spark):
    df = spark.createDataFrame([("s", 0, 'a&<>"\t\x01', "absent", None, "trusted", None, None), ("s", 1, "u", None, None, "trusted", None, None), ("s", 2, "w", "absent", None, "trusted", "absent", None)], SCHEMA)
    lines = [r.line for r in gates.junit(df).orderBy("ordinal").collect()]
    assert 'name="a&amp;&lt;&gt;&quot; ?"' in lines[0] and "failure" in lines[0] and "unreadable" in lines[1] and lines[2].endswith("/>")


def test_sync_and_pairs(spark):
    ours = spark.createDataFrame([(1, "aa"), (2, "BB"), (3, " bb"), (4, None)], "id int, sha256 string")
    first = matching.first_by_hash(ours, ours.id)
    assert {(r.sha256, r.first, r.copies) for r in first.collect()} == {("aa", 1, 1), ("bb", 2, 2)}
    known = spark.createDataFrame([("AA",), (None,)], "sha256 string")
    assert [r.sha256 for r in matching.unknown_hashes(first, known).collect()] == ["bb"]
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {r.path: (r.original, r.outcome) for r in matching.pair_by_stem(paths("d/a.jpg", "d/b.jpg", "d/c.jpg", "o/a.png"), paths("o/a.png", "o/b.png", "p/b.tif")).collect()}
    assert got == {"d/a.jpg": ("o/a.png", "paired"), "d/b.jpg": (None, "ambiguous"), "d/c.jpg": (None, "unpaired"), "o/a.png": (None, "unpaired")}


def test_chunks(spark):
    rows = spark.range(1234).selectExpr("lpad(id, 5, '0') AS k")
    got = {(r.chunk, r.n) for r in matching.in_chunks(rows, 500, "k").groupBy("chunk").count().withColumnRenamed("count", "n").collect()}
    assert got == {(0, 500), (1, 500), (2, 234)}
