import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.operators.dewey import child_objects, node_table, parse_record, shred, walk

SCHEMA = "rec_id long, response string, node string"


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return sorted(tuple(r) for r in child_objects(df).collect())


def test_places_shapes_and_wrapping(spark):
    record = {
        "applicant": [{"a": 1}, "x", {}, {"b": None}, None],
        "inventors": {"n": 1},
        "publishedDocuments": {},
        "bibliographicData": {"inventionTitle": [[{"a": 1}], {"t": 1}], "ipcrClassification": 3},
    }
    want = [("applicant", 0), ("applicant", 3), ("inventionTitle", 1), ("inventors", 0)]
    wrapped = record
    for _ in range(4):
        wrapped = json.dumps(wrapped)
    got = found(spark, [json.dumps(record), wrapped])
    assert got == [(i, n, p) for i in (0, 1) for n, p in sorted(want)]


def test_unusable_responses_give_no_rows(spark):
    bad = [None, "", "  ", "null", "[]", '[{"applicant": [{"a": 1}]}]', "{", '{"applicant": [{"a": NaN}]}', '"{"', "<html>", '{"applicant": [{"a": 1}]} x']
    assert found(spark, bad) == []
    assert found(spark, []) == []


def test_deep_and_long_records(spark):
    deep = '{"x": ' * 3000 + "1" + "}" * 3000
    long = json.dumps({"applicant": [{"legalEntityName": "n" * 10}] * 5000})
    got = found(spark, [deep, long])
    assert len(got) == 5000 and got[-1] == (1, "applicant", 4999)


def test_labels_link_parents_and_children(spark):
    df = spark.createDataFrame([(7, '{"a": [{"b": {"c": 5}, "d": "x"}, {"d": null}]}', "")], SCHEMA)
    nodes = shred(df, "rec_id", "response")
    rows = {tuple(r.label): r.path for r in nodes.collect()}
    assert rows[()] == "$" and rows[(0,)] == "$.a" and rows[(0, 0)] == "$.a[]" and rows[(0, 0, 0, 0)] == "$.a[].b.c"
    assert all(not label or label[:-1] in rows for label in rows)
    table = sorted(tuple(r) for r in node_table(nodes, "rec_id", "$.a[]", ["d", "zz"]).collect())
    assert table == [(7, [0, 0], [0], 0, "x", None), (7, [0, 1], [0], 1, None, None)]


def rebuild(nodes):
    """A record from its node table alone."""
    kids, by = {}, {}
    for label, path, kind, members, value in nodes:
        by[tuple(label)] = (path, kind, value)
        if label:
            kids.setdefault(tuple(label[:-1]), []).append(tuple(label))

    def make(label):
        path, kind, value = by[label]
        below = sorted(kids.get(label, []))
        if kind == "object":
            return {re.sub(r"(?s)\\(.)", r"\1", by[c][0][len(path) + 1 :]): make(c) for c in below}
        if kind == "array":
            return [make(c) for c in below]
        return {"null": None, "boolean": value == "true"}.get(kind, value)

    return make(())


json_values = st.recursive(st.none() | st.booleans() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=4), json_values, max_size=4))
def test_round_trip(record):
    assert rebuild(walk(parse_record(json.dumps(record)))) == record


def test_keys_with_dots_and_brackets_are_no_paths(spark):
    record = {"bibliographicData.inventionTitle": [{"title": "x"}], "applicant[]": {"a": 1}, "bibliographicData": {"inventionTitle": [{"title": "y"}]}}
    assert found(spark, [json.dumps(record)]) == [(0, "inventionTitle", 0)]
    paths = [n[1] for n in walk(parse_record('{"a.b": {"c": 1}, "a": {"b.c": [2]}, "d[]": 3}'))]
    assert paths == ["$", "$.a\\.b", "$.a\\.b.c", "$.a", "$.a.b\\.c", "$.a.b\\.c[]", "$.d\\[\\]"]


def test_nesting_of_any_depth(spark):
    deep = '{"applicant": [{"legalEntityName": "x"}], "d": ' + "[" * 100_000 + "]" * 100_000 + ', "inventors": {"a": 1}}'
    assert found(spark, [deep, deep[:-1], json.dumps(deep)]) == [(0, "applicant", 0), (0, "inventors", 0), (2, "applicant", 0), (2, "inventors", 0)]



@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=30), st.integers(0, 200), st.sampled_from(["", "}", "]", ",", '"', "1", " "]))
@settings(max_examples=200, deadline=None)
def test_deep_reader_equals_the_library(value, at, put):
    from quillstone.operators import dewey

    text = json.dumps(value)
    broken = text[:at] + put + text[at + 1 :]
    for t in (text, broken):
        try:
            want = dewey._DECODER.decode(t)
        except ValueError:
            want = "invalid"
        try:
            got = dewey.read_deep(t)
        except ValueError:
            got = "invalid"
        assert got == want
