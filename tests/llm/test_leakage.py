import random

import numpy as np

from attesta.llm import leakage as lk

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def found(spark, docs, items):
    got = [tuple(r) for r in lk.leaked(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_copies_and_what_is_none(spark):
    item = prose(90)
    about = lambda middle: " ".join(prose(60) + middle + prose(60))
    noisy = [w.upper() if k % 7 == 0 else w[:3] + " " + w[3:] if k % 11 == 0 else w for k, w in enumerate(item[20:65])]
    part = item[10:50]
    shuffled = item[10:50]
    rng.shuffle(shuffled)
    docs = {1: about(item), 2: about(item[5:40]), 3: about(noisy), 4: about(part[:20] + prose(5) + part[20:]), 5: about(item[:22] + prose(40) + item[60:82]), 6: about(item[10:29]), 7: about(shuffled), 8: about(prose(50)), 9: " ".join(item[20:60]).replace(" ", "\n"), 10: about(item[30:31] * 40)}
    assert {d for d, _ in found(spark, docs.items(), [(7, " ".join(item)), (8, " ".join(prose(80)))])} == {1, 2, 3, 4, 5, 9}


def test_order_of_two_passages_counts(spark):
    item = prose(90)
    assert found(spark, [(1, " ".join(item[50:68] + prose(60) + item[:18]))], [(1, " ".join(item))]) == set()


def test_many_copies_of_one_leak_are_all_found(spark):
    item = prose(60)
    docs = [(i, " ".join(prose(20) + item[5:50] + prose(20))) for i in range(200)] + [(1000 + i, " ".join(prose(90))) for i in range(100)]
    assert found(spark, docs, [(1, " ".join(item))]) == {(i, 1) for i in range(200)}


def test_items_in_turns_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(prose(60))) for i in range(5)]
    docs = [(i, t) for i, t in items] + [(9, " ".join(prose(50)))]
    whole = found(spark, docs, items)
    monkeypatch.setattr(lk, "ITEMS_AT_ONCE", 2)
    assert found(spark, docs, items) == whole == {(i, i) for i in range(5)}


def test_nulls_empty_long_and_repeated(spark):
    item = " ".join(prose(60))
    long = " ".join(prose(40_000)) + " " + item
    docs = [(1, None), (2, ""), (None, item), (3, long), (3, long), (4, "...")]
    assert found(spark, docs, [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "short")]) == {(3, 1)}
    assert found(spark, [], [(1, item)]) == set() and found(spark, [(1, item)], []) == set()


def test_blocks_hold_postings_of_every_term_and_intersect_them():
    docs = [["a", "b", "a", "b", "a"], [], ["b", "é", "a", "b", "a"]]
    block = lk.Block.of(lk._index_block([1, 2, 3], docs).to_pylist()[0])
    assert [block.text(d, s, s + n) for d, (s, n) in enumerate(zip(block.starts, block.lengths))] == [["a", "b", "a", "b", "a"], [], ["b", "e", "a", "b", "a"]]
    term = {t: i for i, t in enumerate(block.terms)}
    a, b, e = term["a"], term["b"], term["e"]
    for term_, positions in (("a", [0, 2, 4, 135, 137]), ("e", [134])):
        k = term[term_]
        assert block.postings[block.firsts[k] : block.firsts[k + 1]].tolist() == positions
    which, at = block.matches(np.array([[a, b, a], [b, e, a], [a, -1, b], [a, a, a]]))
    assert sorted(zip(which.tolist(), at.tolist())) == [(0, 0), (0, 2), (0, 135), (1, 133)]


def test_a_stored_index_is_searched_again(spark, tmp_path):
    item = prose(60)
    docs = spark.createDataFrame([(1, " ".join(prose(30) + item[:40] + prose(30))), (2, " ".join(prose(80)))], "doc_id long, text string")
    lk.write_index(docs, f"file://{tmp_path}/index")
    for text, expected in ((item, [(1, 5)]), (prose(60), [])):
        items = spark.createDataFrame([(5, " ".join(text))], "item_id long, text string")
        assert [tuple(r) for r in lk.search_all(spark.read.parquet(f"file://{tmp_path}/index"), items).collect()] == expected


def test_many_single_words_lost(spark):
    """31 of 34, 38 of 45, 48 of 60 and 30 of 37 words, each loss by itself."""
    item = prose(90)
    docs = {n: [w for k, w in enumerate(item[10 : 10 + of]) if (k + 1) % step or k >= step * (of - n)] for n, of, step in ((31, 34, 9), (38, 45, 6), (48, 60, 5), (30, 37, 5))}
    assert [len(d) for d in docs.values()] == [31, 38, 48, 30]
    assert found(spark, [(n, " ".join(prose(50) + d + prose(50))) for n, d in docs.items()], [(7, " ".join(item))]) == {(n, 7) for n in docs}


def test_thirty_words_with_lost_ones_and_two_short_passages(spark):
    item = prose(90)
    about = lambda *parts: " ".join(w for p in parts for w in prose(40) + p) + " " + " ".join(prose(40))
    lose = lambda words, *at: [w for k, w in enumerate(words) if k not in at]
    docs = {1: about(lose(item[10:42], 9, 20)), 2: about(lose(item[10:43], 8, 20)), 3: about(lose(item[10:47], 8, 17, 26)), 4: about(lose(item[10:51], 7, 14, 22, 31))}
    docs |= {5: about(item[5:20], item[50:65]), 6: about(item[5:21], item[50:66]), 8: about(lose(item[5:22], 8), item[50:65])}
    none = {20: about(item[5:19], item[50:65]), 21: about(lose(item[10:41], 9, 20)), 22: about(item[5:27])}
    assert found(spark, (docs | none).items(), [(7, " ".join(item))]) == {(d, 7) for d in docs}


def test_wording_of_many_documents_is_no_copy(spark):
    formula, item = prose(34), prose(60)
    docs = [(i, " ".join(prose(30) + formula[:17] + prose(30))) for i in range(40)] + [(50 + i, " ".join(prose(30) + formula[17:] + prose(30))) for i in range(40)]
    docs += [(100, " ".join(prose(20) + formula + prose(20))), (101, " ".join(prose(20) + item[:22] + prose(30) + formula[:12])), (102, " ".join(prose(20) + item[:30]))]
    assert found(spark, docs, [(1, " ".join(item + formula))]) == {(102, 1)}


def test_phrases_that_are_absent_take_no_place_of_those_present():
    item = prose(60)
    text = prose(50) + [w for k, w in enumerate(item) if k % 6 != 2] + prose(50)  # of each stretch three phrases are lost, three are left
    items = lk.Items.of([(1, " ".join(item))])
    block = lk.Block.of(lk._index_block([5], [text]).to_pylist()[0])
    pairs = lk.candidates(block, items, np.zeros(len(items.phrases), np.int64))
    assert [(d, i) for d, i, _ in pairs] == [(0, 0)]
