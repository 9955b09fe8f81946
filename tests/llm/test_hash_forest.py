import random

import numpy as np
import pytest

from attesta.llm import hash_forest as hf
from attesta.llm.signatures import distances, words

SCHEMA = "asset_id long, batch_no int, sha256 string, pdq string, pdq_quality int, pdq_mirrors array<string>, signature string, asset string, first string"


def flip(h, n, rng):
    v = int(h, 16)
    for b in rng.sample(range(256), n):
        v ^= 1 << b
    return f"{v:064x}"


def family(n, seed=1):
    rng, rows, pool = random.Random(seed), [], []
    for i in range(n):
        h = f"{rng.getrandbits(256):064x}"
        if pool and rng.random() < 0.5:
            h = flip(rng.choice(pool), rng.choice([0, 1, 5, 20, 30, 31, 32, 33]), rng)
        mirrors = [f"{rng.getrandbits(256):064x}", "bad"]
        pool += [h, mirrors[0]]
        sha = f"{rng.choice(range(n)):064x}"
        rows.append((i, rng.randint(1, 4), rng.choice([sha, sha.upper() + " ", None]), rng.choice([h, h.upper()]), rng.choice([50, 90, 90, 49, None]), rng.choice([mirrors, [], None]), "x", "y", "z"))
    return rows


def brute(rows, known=()):
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[1], r[0]))
    known, seen, hashes, out = {k.strip().lower() for k in known}, set(), [], set()
    for i, _, sha, pdq, quality, mirrors, *_ in rows:
        sha = sha.strip().lower() if sha else None
        if sha and (sha in known or sha in seen):
            out.add(i)
        seen.add(sha)
        if quality is not None and quality >= 50:
            if any((int(pdq, 16) ^ h).bit_count() <= 31 for h in hashes):
                out.add(i)
            hashes += [int(h, 16) for h in [pdq, *(mirrors or [])] if len(h) == 64]
    return out


def test_equals_brute_force(spark):
    rows = family(400)
    known = [rows[3][2] or "aa", " BB "]
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    got = [r.asset_id for r in hf.not_new(df, spark.createDataFrame([(k,) for k in known], "sha256 string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, known)


def test_batches_one_by_one_equal_all_at_once_and_runs_merge(spark):
    rows = [(*r[:2], None, *r[3:]) for r in family(200, 5)]
    forest, got = hf.HashForest(spark), set()
    for batch in (1, 2, 3, 4):
        got |= {r.asset for r in hf.not_new_in_batch(forest, spark.createDataFrame([r for r in rows if r[1] == batch], SCHEMA)).collect()}
        if batch == 3:
            before = sum(n for _, n in forest.runs)
            forest.merge()
            assert len(forest.runs) == 1 and sum(n for _, n in forest.runs) == before
    assert got == brute(rows)


def test_hot_group_nulls_and_empty(spark):
    h = "ab" * 32
    rows = [(i, 1, "cc", h, 90, None, "", "", "") for i in range(300)] + [(1000, None, None, h, 90, [h], "", "", ""), (1001, None, None, "zz", 90, None, "", "", ""), (None, 1, "cc", h, 90, None, "", "", "")]
    got = {r.asset_id for r in hf.not_new(spark.createDataFrame(rows, SCHEMA), None).collect()}
    assert got == set(range(1, 300)) | {1000}
    assert hf.not_new(spark.createDataFrame([], SCHEMA), None).count() == 0


@pytest.mark.parametrize("distance", [0, 10, 22, 31])
def test_every_distance_within_the_radius_is_found(distance):
    rng = np.random.default_rng(distance)
    a = rng.integers(0, 256, (300, 32), np.uint8)
    b = a.copy()
    for row in b:
        for bit in rng.choice(256, distance, False):
            row[bit // 8] ^= 1 << bit % 8
    sig, other = words([x.tobytes() for x in a]), words([x.tobytes() for x in b])
    assert (distances(sig, other) == distance).all()
    trees = {t: (lambda k: (np.sort(k), np.argsort(k, kind="stable").astype(np.uint32)))(hf.prefixes(other, t)) for t in range(hf.TREES)}
    run = (other, np.zeros(300, np.int32), np.arange(300), trees.__getitem__)
    assert hf.search(sig, np.ones(300, np.int32), np.arange(300), run, hf.rounds_for(1.0), 31).all()
    assert not hf.search(sig, np.zeros(300, np.int32), np.arange(300), run, 2, 31).any()


def test_recall_targets():
    assert hf.rounds_for(1.0) == 2 and hf.rounds_for(0.5) <= 1
    assert sum(hf.widths()) == 256 and sorted(np.concatenate(hf.permutations())) == list(range(256))


def test_batches_against_stored_history_by_sha256_and_picture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hf, "MOST_SMALL", 2)
    rows, known = family(160, 9), [" KK "]
    rows += [(900, 3, "kk", None, 90, None, "", "", ""), (901, 1, "dd", "bad", 90, None, "", "", ""), (902, 4, " DD", None, None, None, "", "", "")]
    path = f"file://{tmp_path}/forest"
    hf.HashForest(spark, path).know(spark.createDataFrame([(k,) for k in known], "sha256 string"))
    got = set()
    for batch in (1, 2, 3, 4):
        forest = hf.HashForest(spark, path)  # opened again for each batch
        got |= {r.asset for r in hf.not_new_in_batch(forest, spark.createDataFrame([r for r in rows if r[1] == batch], SCHEMA)).collect()}
        assert len(forest.runs) <= 2 and len(forest.hashes) <= 2
    plain = [(*r[:3], r[3] if r[3] and len(r[3]) == 64 else "0", *((r[4], r[5]) if r[3] and len(r[3]) == 64 else (None, None)), *r[6:]) for r in rows]
    assert {900, 902} <= got and got == brute(plain, known)
