import random

from attesta.llm import ivfpq
from attesta.llm.ivfpq import similar_pictures

SCHEMA = "asset_id long, pdq string, pdq_quality int, pdq_mirrors array<string>, pdq_frames array<string>, signature string, owner string"


def rows_of(n, seed=2):
    rng, rows, pool = random.Random(seed), [], []

    def near(h):
        v = int(h, 16)
        for b in rng.sample(range(256), rng.choice([0, 2, 9, 20, 28, 31, 32, 40])):
            v ^= 1 << b
        return f"{v:064x}"

    new = lambda: near(rng.choice(pool)) if pool and rng.random() < 0.5 else f"{rng.getrandbits(256):064x}"
    for i in range(n):
        h = [new() for _ in range(rng.choice([1, 3, 5]))]
        pool += h
        rows.append((i, rng.choice([h[0], h[0].upper()]), rng.choice([90, 90, 50, 49, None]), rng.choice([h[1:3], [*h[1:3], "bad"], None]), h[3:], "x", "y"))
    return rows


def brute(rows):
    hashes = {}
    for i, pdq, quality, mirrors, frames, *_ in rows:
        if quality is not None and quality >= 50 and len(pdq) == 64:
            hashes[i] = {int(h, 16) for h in [pdq, *(mirrors or []), *(frames or [])] if len(h) == 64}
    out = set()
    for i, own in hashes.items():
        d = sorted((min((a ^ b).bit_count() for a in own for b in other), j) for j, other in hashes.items() if j != i)
        out |= {(min(i, j), max(i, j)) for dist, j in d[:5] if dist <= 31}
    return out


def test_recall_and_precision_against_brute_force(spark):
    rows = rows_of(500)
    got = [tuple(r) for r in similar_pictures(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()]
    expected = brute(rows)
    assert len(got) == len(set(got))
    assert len(expected & set(got)) >= 0.95 * len(expected) > 0
    assert len(set(got) - expected) <= 0.02 * len(got)


def test_copies_ties_and_empty(spark):
    h = "0f" * 32
    rows = [(i, h, 90, [h], None, "", "") for i in range(40)]
    assert {tuple(r) for r in similar_pictures(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    assert similar_pictures(spark.createDataFrame([], SCHEMA)).count() == 0
    assert similar_pictures(spark.createDataFrame([(1, None, 90, None, None, "", ""), (2, "x", 90, [None, h], [], "", ""), (None, h, 90, None, None, "", ""), (3, h, 90, None, None, "", "")], SCHEMA)).count() == 0


def test_large_and_huge_cells_and_hot_signatures_give_the_same(spark, monkeypatch):
    rows = rows_of(300, 7)
    rows += [(1000 + i, rows[0][1], 90, [], None, "x", "y") for i in range(30)]
    for name, value in (("LARGE", 24), ("PART", 8), ("HUGE", 64), ("HOT", 5)):
        monkeypatch.setattr(ivfpq, name, value)
    got, expected = {tuple(r) for r in similar_pictures(spark.createDataFrame(rows, SCHEMA)).collect()}, brute(rows)
    assert len(expected & got) >= 0.95 * len(expected) > 0 and len(got - expected) <= 0.03 * len(got)
