"""JSON pointers, patches and merge patches by the standards' own cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillmill.functions import json_docs as J
from quillmill.functions import json_paths

FAILS = object()


@pytest.mark.parametrize(("doc", "steps", "want"), [
    ({"foo": "bar"}, [{"op": "add", "path": "/baz", "value": "qux"}], {"foo": "bar", "baz": "qux"}),
    ({"foo": ["bar", "baz"]}, [{"op": "add", "path": "/foo/1", "value": "qux"}], {"foo": ["bar", "qux", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [{"op": "remove", "path": "/baz"}], {"foo": "bar"}),
    ({"foo": ["bar", "qux", "baz"]}, [{"op": "remove", "path": "/foo/1"}], {"foo": ["bar", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [{"op": "replace", "path": "/baz", "value": "boo"}], {"baz": "boo", "foo": "bar"}),
    ({"foo": {"bar": "baz", "waldo": "fred"}, "qux": {"corge": "grault"}}, [{"op": "move", "from": "/foo/waldo", "path": "/qux/thud"}], {"foo": {"bar": "baz"}, "qux": {"corge": "grault", "thud": "fred"}}),
    ({"foo": ["all", "grass", "cows", "eat"]}, [{"op": "move", "from": "/foo/1", "path": "/foo/3"}], {"foo": ["all", "cows", "eat", "grass"]}),
    ({"baz": "qux", "foo": ["a", 2, "c"]}, [{"op": "test", "path": "/baz", "value": "qux"}, {"op": "test", "path": "/foo/1", "value": 2}], {"baz": "qux", "foo": ["a", 2, "c"]}),
    ({"baz": "qux"}, [{"op": "test", "path": "/baz", "value": "bar"}], FAILS),
    ({"foo": "bar"}, [{"op": "add", "path": "/child", "value": {"grandchild": {}}}], {"foo": "bar", "child": {"grandchild": {}}}),
    ({"foo": "bar"}, [{"op": "add", "path": "/baz", "value": "qux", "xyz": 123}], {"foo": "bar", "baz": "qux"}),
    ({"foo": "bar"}, [{"op": "add", "path": "/baz/bat", "value": "qux"}], FAILS),  # no parent
    ({"/": 9, "~1": 10}, [{"op": "test", "path": "/~01", "value": 10}], {"/": 9, "~1": 10}),
    ({"/": 9, "~1": 10}, [{"op": "test", "path": "/~01", "value": "10"}], FAILS),
    ({"foo": ["bar"]}, [{"op": "add", "path": "/foo/-", "value": ["abc", "def"]}], {"foo": ["bar", ["abc", "def"]]}),
    ({"foo": ["bar"]}, [{"op": "add", "path": "/foo/2", "value": 1}], FAILS), ({"foo": ["bar"]}, [{"op": "add", "path": "/foo/01", "value": 1}], FAILS), ({"foo": ["bar"]}, [{"op": "remove", "path": "/foo/-"}], FAILS),
    ({"a": {"b": 1}}, [{"op": "move", "from": "/a", "path": "/a/b"}], FAILS), ({"a": {"b": 1}}, [{"op": "copy", "from": "/a", "path": "/a/c"}], {"a": {"b": 1, "c": {"b": 1}}}),
    ({"a": 1, "x": 2}, [{"op": "copy", "from": "/x", "path": "/a/b"}], FAILS),  # a scalar has nothing below it
    ({"a": 1}, [{"op": "replace", "path": "", "value": [1]}], [1]), ({"a": 1}, [{"op": "add", "path": "", "value": 3}], 3), ({"a": 1}, [{"op": "jump", "path": "/a"}], FAILS),
    ({"a": None}, [{"op": "test", "path": "/a", "value": None}, {"op": "add", "path": "/", "value": 1}], {"a": None, "": 1}), ({"a": 1.0}, [{"op": "test", "path": "/a", "value": 1}], {"a": 1.0}),
    ({"a": [1, 2]}, [{"op": "replace", "path": "/a/1", "value": 5}, {"op": "replace", "path": "/b", "value": 1}], FAILS), ({"a": 1}, [{"op": "add", "path": "/b"}], FAILS), ({"a": 1}, [{"op": "move", "from": "/a", "path": "/a"}], {"a": 1}),
])
def test_patches(spark, doc, steps, want):
    ok, value = J.parsed(json.dumps(doc))
    _, ops = J.parsed(json.dumps(steps))
    if want is FAILS:
        with pytest.raises(J.PatchError):
            J.patched(value, ops)
    else:
        assert json.loads(J.text_of(J.patched(value, ops))) == want
    assert ok and J.text_of(value) == json.dumps(doc, separators=(",", ":"))  # the document given stays as it is


def test_patches_of_a_column(spark):
    add = '[{"op": "add", "path": "/b", "value": 1e5}]'
    rows = [('{"a": 1.50}', add), ("[1", add), (None, add), ('{"a": 1}', "{"), ('{"a": 1}', None), ('{"a": 1}', '[{"op": "remove", "path": "/x"}]'), ('{"é": "\\u00e9"}', "[]")]
    got = [r.r and tuple(r.r) for r in spark.createDataFrame(rows, "d string, p string").select(J.json_patched(F.col("d"), F.col("p")).alias("r")).collect()]
    assert got == [('{"a":1.50,"b":1e5}', None), None, None, ('{"a": 1}', "no patch"), ('{"a": 1}', "no patch"), ('{"a": 1}', "nothing at x"), ('{"é":"é"}', None)]


@pytest.mark.parametrize(("doc", "other", "want"), [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'),
    ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'), ('["a","b"]', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"), ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
])
def test_merge_patches(doc, other, want):
    assert J.text_of(J.merged(J.parsed(doc)[1], J.parsed(other)[1])) == want


def test_leaves(spark):
    deep = '{"a":' * 60 + "1" + "}" * 60
    rows = [(1, '{"a/b":1,"a":{"b":2},"m~n":[true,{"x":null}]}'), (2, deep), (3, "nope"), (4, None), (5, "[]"), (6, '"s"'), (7, "NaN"), (8, '{"a":1,"a":2.0}')]
    got = [tuple(r) for r in json_paths.leaves(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()]
    assert got == [(1, "/a~1b", "1"), (1, "/a/b", "2"), (1, "/m~0n/0", "true"), (1, "/m~0n/1/x", None), (2, "/a" * 60, "1"), (6, "", "s"), (8, "/a", "2.0")]
