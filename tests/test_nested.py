import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators import nested

SCHEMA = "report_id long, report_json string, node_path string, text string"


def paths(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    return {tuple(r) for r in nested.report_nodes(df).collect()}


def test_rules(spark):
    text = json.dumps({
        "actions": {"action": "a", "parameters": {"ingredients": [{"u": 1}, None, 3, {"u": 2}]}}, "x": [[{"deep": 1}], 5],
        "raw_manifest_store": json.dumps({"manifests": {"urn:a/b~c": {"assertions": [{"label": "l", "data": {"actions": {"q": 1}}}]}, "n": 1}}), "o": {"p": {"q": 1}},
    })
    assert {(n, p) for _, n, p in paths(spark, text)} == {
        ("/actions/0", ""), ("/actions/0/parameters/ingredients/0", "/actions/0"), ("/actions/0/parameters/ingredients/3", "/actions/0"), ("/x/0/0", ""),
        ("/raw_manifest_store/manifests/urn:a~1b~0c", ""), ("/raw_manifest_store/manifests/urn:a~1b~0c/assertions/0", "/raw_manifest_store/manifests/urn:a~1b~0c"),
        ("/raw_manifest_store/manifests/urn:a~1b~0c/assertions/0/data/actions/0", "/raw_manifest_store/manifests/urn:a~1b~0c/assertions/0"),
    }


def test_no_json_nulls_and_other_roots(spark):
    assert paths(spark, None, "", "{", '{"a":NaN}', "[1,]", '"x"', "7") == set()
    assert {n for _, n, _ in paths(spark, '[{"a":1},2]')} == {"/0"}
    assert paths(spark) == set()
    assert {n for _, n, _ in paths(spark, '{"a":[{"k":"\\ud800"}],"\\ud800":[{}]}')} == {"/a/0", "/?/0"}


def test_depth_and_big_numbers(spark):
    deep = "[" * 3000 + '{"a":1}' + "]" * 3000
    assert len(paths(spark, deep, '{"a":[{"n":' + "9" * 6000 + "}]}")) == 2


def test_deep_parser_agrees_with_the_usual_one():
    for text in ('{"a":[1,2.50,{"b":null}],"c":"x\\n\\u00e9","d":{}}', "[]", '[[],{"a":[]}]', ' {"a" : true } '):
        assert nested._parse_deep(text) == nested.parse(text)
    for text in ('{"a":1,}', "[1,]", '{"a"}', "[", '{"a":1}}', "", "1 2", "[,1]", "{1:2}", "[1 2]", "{,}"):
        try:
            nested._parse_deep(text)
            raise AssertionError(text)
        except ValueError:
            pass


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet="ab/~é", max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "manifests", "actions", "x/y"]), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "actions", "manifests"]), _json, max_size=3))
def test_objects_rebuild_the_document(value):
    rows = nested.nodes(nested.parse(json.dumps(value)))
    bodies = {r[2]: r[6] for r in rows}

    def listed(v, labelled=False):
        if isinstance(v, dict):
            return {k: listed([x] if k in nested.LIST_FIELDS and isinstance(x, dict) and not labelled else x, k == nested.MAP_FIELD) for k, x in v.items()}
        return [listed(x) for x in v] if isinstance(v, list) else v

    assert nested.rebuild(rows[0][2], bodies) == listed(value)
    assert len({r[0] for r in rows}) == len(rows)


def test_equal_objects_are_stored_once(spark):
    df = spark.createDataFrame([(1, '{"a":[{"x":1,"y":2},{"y":2,"x":1}]}'), (2, '{"b":[{"x":1,"y":2}]}'), (2, '{"b":[{"x":1,"y":2}]}')], "id long, t string")
    flat = nested.flatten_records(df, F.col("id"), F.col("t"))
    assert nested.bridge(flat).where("node_path <> ''").count() == 3
    assert nested.objects(flat).where("body = '{\"x\":1,\"y\":2}'").select("occurrences").collect()[0][0] == 3
