from datetime import datetime

from attesta.operators.snapshot_diff import asset_changes

SCHEMA = "snapshot_no int, set_name string, target string, status string, sha256 string, loaded_at timestamp, ordinal int, __at string, change_kind string"


def at(h):
    return datetime(2025, 1, 1, h)


def rows(spark, data):
    return spark.createDataFrame([(*r, 0, "x", "y") for r in data], SCHEMA)


def found(df):
    return {tuple(r) for r in asset_changes(df).collect()}


def test_added_removed_changed_over_a_gap_in_the_numbers(spark):
    df = rows(spark, [
        (1, "s", "a.jpg", "valid_trusted", "AA", at(1)), (1, "s", "b.jpg", "absent", None, at(1)), (1, "s", "same", "absent", " aa ", at(1)),
        (5, "s", "./a.jpg", "Valid-Trusted ", "aa", at(1)), (5, "s", "c.jpg", None, None, at(1)), (5, "s", ".\\same", "ABSENT", "AA", at(1)),
        (9, "s", "a.jpg", "valid_trusted", "ab", at(1)), (9, "s", "c.jpg", "error", None, at(1)), (9, "s", "same", "absent", "aa", at(1)),
    ])
    assert found(df) == {("s", "b.jpg", 5, "removed"), ("s", "c.jpg", 5, "added"), ("s", "a.jpg", 9, "changed"), ("s", "c.jpg", 9, "changed")}


def test_last_load_counts_and_repeats_are_one(spark):
    df = rows(spark, [(1, "s", "a", "absent", "x", at(1)), (2, "s", "a", "error", "y", at(1)), (2, "s", "./a", "absent", "x", at(2)), (2, "s", "a", "absent", "x", at(2))])
    assert found(df) == set()


def test_nulls_ties_empty_and_single(spark):
    assert found(rows(spark, [])) == set()
    assert found(rows(spark, [(1, "s", "a", "absent", "x", at(1)), (None, "s", "b", "absent", "x", at(1))])) == set()
    null_key = rows(spark, [(1, None, "a", "absent", "x", None), (2, None, "a", "error", "x", None), (2, "s", None, "error", "x", at(1))])
    assert found(null_key) == {(None, "a", 2, "changed"), ("s", None, 2, "added")}
    tie = [(1, "s", "a", "absent", "x", at(1)), (2, "s", "a", "error", "x", at(1)), (2, "s", "a", "absent", "x", at(1))]
    assert found(rows(spark, tie)) == found(rows(spark, tie[::-1]))


def test_letter_case_of_targets_matters(spark):
    df = rows(spark, [(1, "s", "A", "absent", "x", at(1)), (2, "s", "a", "absent", "x", at(1))])
    assert found(df) == {("s", "A", 2, "removed"), ("s", "a", 2, "added")}
