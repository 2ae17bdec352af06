import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators.packed_values import LETTER, lattice, pieces, split_packed, unquote
from pagemill.operators.records import _read_deep, flatten_records, object_rows, read_strict, read_table, write_tables


def paths(blocks):
    return [(r[0], r[4], r[5]) for r in object_rows(blocks) if r[7]]


def test_strict_reading():
    assert paths(['{"a": [{"b": {}}], "c": 1}', None, "undefined", "{'a': 1}", '{"a": NaN}', '{"a": 1,}', '{"a":1} x', "[1, {}]"]) == [(0, "$", ""), (0, "$.a[0]", "$"), (0, "$.a[0].b", "$.a[0]"), (7, "$[1]", "")]


def test_nothing_is_lost():
    rows = object_rows(['{"@type": ["Shop", "Place"], "price": 12.50, "big": 123456789012345678901234567890, "tags": [1, "b", [null, true]], "a": {"x": 1}, "a": {"x": 2}, "mixed": [{"y": []}, 7]}'])
    assert [r[1:7] for r in rows] == [
        (0, None, "Shop", "$", "", None), (1, 0, "Shop.@type", "$.@type[0]", "$", 0), (2, 0, "Shop.@type", "$.@type[1]", "$", 1),
        (3, 0, "Shop.tags", "$.tags[0]", "$", 0), (4, 0, "Shop.tags", "$.tags[1]", "$", 1), (5, 0, "Shop.tags", "$.tags[2][0]", "$", 0), (6, 0, "Shop.tags", "$.tags[2][1]", "$", 1),
        (7, 0, "a", "$.a", "$", None), (8, 0, "a", "$.a", "$", None), (9, 0, "mixed", "$.mixed[0]", "$", 0), (10, 0, "Shop.mixed", "$.mixed[1]", "$", 1)]
    assert rows[0][8] == '{"@type":["Shop","Place"],"price":12.50,"big":123456789012345678901234567890,"tags":[1,"b",[null,true]]}'
    assert [r[8] for r in rows[3:9]] == ['{"value":1}', '{"value":"b"}', '{"value":null}', '{"value":true}', '{"x":1}', '{"x":2}'] and rows[9][8] == '{"y":[]}'
    assert object_rows(["5"])[0][4:] == ("$", "", None, False, '{"value":5}') and object_rows(["[" * 30000 + "]" * 30000]) == []


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20))
def test_deep_reader_agrees(value):
    text = json.dumps(value)
    assert _read_deep(text) == read_strict(text)


def test_deep_nesting_and_repeated_names():
    text = '{"a":' * 20000 + "1" + "}" * 20000
    assert len(object_rows([text])) == 20000
    assert len(object_rows(['{"a": {}, "a": {"b": {}}}'])) == 4
    with pytest.raises(ValueError):
        _read_deep('{"a":' * 20000)


def test_records_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, ['{"@type": "P", "n": "x", "w": {"m": 2}}'], "extra"), (1, ['{"@type": "P", "n": "x", "w": {"m": 2}}'], "extra"), (2, None, None), (None, ["{}"], None)], "page_id bigint, json_ld array<string>, path string")
    rows = flatten_records(df, "page_id", "json_ld")
    assert {(r.page_id, r.tag, r.path, r.parent_path) for r in rows.collect()} == {(1, "P", "$", ""), (1, "w", "$.w", "$"), (None, "root", "$", "")}
    assert rows.count() == 3
    assert [r.n for r in read_table(rows, "P", "n string").collect()] == ["x"]
    typed = flatten_records(spark.createDataFrame([(7, ['{"@type": "Item", "n": 3, "p": 12.5, "s": "12.5", "tags": ["a", "b"], "ok": true, "far": 12345678901234567}'])], "page_id bigint, json_ld array<string>"), "page_id", "json_ld").cache()
    r = read_table(typed, "Item", "n int, p double, s string, tags array<string>, ok boolean, far bigint").first()
    assert (r.page_id, r.n, r.p, r.s, r.tags, r.ok, r.far) == (7, 3, 12.5, "12.5", ["a", "b"], True, 12345678901234567)
    assert [(r.place, r.value) for r in read_table(typed, "Item.tags", "value string").orderBy("place").collect()] == [(0, "a"), (1, "b")]
    write_tables(typed, path := str(tmp_path / "tables"))
    assert {r.tag: r["count"] for r in spark.read.parquet(path).groupBy("tag").count().collect()} == {"Item": 1, "Item.tags": 2}
    assert flatten_records(df.limit(0), "page_id", "json_ld").count() == 0


def values(text):
    return [v for v in (unquote(p[1]) if p[4] else p[1] for p in pieces(text)) if v]


def test_values():
    assert values('"21"" k", de x, \'a, b\'; rock\'n\'roll / 3/4 inch · l\'y') == ['21" k', "de x", "a, b", "rock'n'roll", "3/4 inch", "l'y"]
    assert values('["a", "b, c"]') == ["a", "b, c"]
    assert values(", ,a,,b ; ;") == ["a", "b"]
    assert values(None) == values("") == values(" ,; ") == []
    assert values('"open, x') == ['"open', "x"]
    assert unquote("''a''") == "'a'"
    assert len(values("x, " * 100_000)) == 100_000


def split_all(spark, fields):
    df = spark.createDataFrame([(i, f, "extra") for i, f in enumerate(fields)], "page_id bigint, keywords string, pos string")
    out = {}
    for r in split_packed(df, "page_id", "keywords").orderBy("page_id", "pos").collect():
        out.setdefault(r.page_id, []).append(r.value)
    return out


def test_frame(spark):
    df = spark.createDataFrame([(1, "kimano 12,3/4 inch"), (2, "3/4 inch"), (3, None), (3, None), (4, "a"), (4, "a"), (None, "b; c")], "page_id bigint, keywords string")
    got = {(r.page_id, r.pos, r.value) for r in split_packed(df, "page_id", "keywords").collect()}
    assert got >= {(1, 0, "kimano 12"), (1, 1, "3/4 inch"), (2, 0, "3/4 inch"), (4, 0, "a")} and {r for r in got if r[0] is None} == {(None, 0, "b"), (None, 1, "c")} and len(got) == 6
    assert split_packed(df.limit(0), "page_id", "keywords").count() == 0


def test_whole_values_are_learnt_whatever_their_length(spark):
    long = "a, b; c | d / e, f - g; h"  # eight pieces
    got = split_all(spark, ['"size 10,5"'] * 50 + [f'"{long}"'] * 20 + ["x; size 10,5", f"x; {long}; y", "red, blue", "blue; red; green", "red | green"])
    assert got[70] == ["x", "size 10,5"] and got[71] == ["x", long, "y"]
    assert (got[72], got[73], got[74]) == (["red", "blue"], ["blue", "red", "green"], ["red", "green"])


def test_a_field_is_no_witness_for_itself(spark):
    # equal fields, however many, don't make a run of rare pieces one value
    assert split_all(spark, ["kimano, fareto"] * 40 + ["one; two; three", "two; one", "three, one"])[0] == ["kimano", "fareto"]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.randoms())
def test_lattice_is_exact(n, r):
    sizes, joints = [r.randint(1, 3) for _ in range(n)], [(r.randint(1, 2), r.uniform(0.2, 0.9)) for _ in range(n - 1)]
    edges = [(a, k, r.uniform(0, 0.4)) for a in range(n) for k in range(1, n - a + 1) if k == 1 or r.random() < 0.4]
    unseen, ways = 0.3, []
    known = {(a, k): f for a, k, f in edges}
    for cuts in range(1 << (n - 1)):
        at, p, path = 0, 1.0, []
        for i in range(n):
            if i == n - 1 or cuts >> i & 1:
                k = i + 1 - at
                inner = [(g, 1 - s) for g, s in joints[at:i]]
                letters = sum(sizes[at : i + 1]) + sum(g for g, _ in inner)
                p *= (known.get((at, k), 0.0) + unseen * math.exp(LETTER * letters)) * math.prod(s for _, s in inner) * (joints[i][1] if i < n - 1 else 1.0)
                path.append((at, k))
                at = i + 1
        ways.append((p, path))
    total = sum(p for p, _ in ways)
    post, split, path = lattice(n, sizes, joints, edges, unseen)
    for (a, k, _), p in zip(edges, post):
        assert abs(p - sum(q for q, w in ways if (a, k) in w) / total) < 1e-9
    for i, p in enumerate(split):
        assert abs(p - sum(q for q, w in ways if any(a + k == i + 1 for a, k in w)) / total) < 1e-9
    best = max(ways)
    assert path == best[1] or dict(((tuple(w), p) for p, w in ways))[tuple(path)] > 0.4 * best[0]
