import random

from attesta.llm.packing import OPEN, Windows, pack, token_counts

DOCS, KINDS = "doc_id long, text string, container_id string, merged string", "container_kind string, capacity_tokens int, n_tokens int"


def packed(spark, texts, kinds=(("s", 16), ("m", 64)), parts=3):
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).repartition(parts)
    return pack(docs, spark.createDataFrame([(*k, 0) for k in kinds], KINDS)).toPandas()


def test_every_token_is_placed_once_and_nothing_overflows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "lighthouse", "Brücke", "x"]) for _ in range(rng.choice([0, 1, 5, 9, 14, 30, 200]))) for _ in range(300)]
    sizes = token_counts(texts)
    got = packed(spark, texts)
    for kind, capacity in (("s", 16), ("m", 64)):
        rows = got[got.container_kind == kind]
        assert rows.groupby("doc_id").n_tokens.sum().to_dict() == dict(enumerate(sizes))
        assert rows.groupby("container_id").n_tokens.sum().max() <= capacity
        pieces = rows.groupby("doc_id").size()
        assert all(sizes[d] > capacity for d in pieces[pieces > 1].index)
        assert all(rows[rows.doc_id == d].sort_values("piece_no").start_token.tolist() == list(range(0, max(1, sizes[d]), capacity)) for d in pieces.index)
        assert rows.container_id.nunique() <= 1.1 * sum(sizes) / capacity + 3


def test_nulls_repeats_and_empty_tables(spark):
    got = packed(spark, [None, "", "a"], (("s", 16), (None, 5), ("z", 0), ("s", 16)))
    assert sorted(got.n_tokens) == [0, 0, 1] and set(got.container_kind) == {"s"}
    assert packed(spark, ["a"], ()).empty and packed(spark, []).empty


def test_the_number_of_open_windows_is_bounded():
    w = Windows(10, 4, 0)
    rng = random.Random(1)
    for _ in range(500):
        w.place(rng.randint(0, 10))
        assert len(w.open) <= 4
    assert OPEN > 0
