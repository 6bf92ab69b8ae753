"""Canonical settings against the standard library; differences of nested settings."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from sightline.functions import canonical as C

TEXTS = [
    '{"b": {"z": 3.0, "a": [1, {"y":null,"x":true}]}, "a": 0.50, "d": "q \\"x\\" 1.50 \\n/\\\\", "f": 12345678901234567890123, "A":1, "h":{}, "i":[]}',
    '{"ä": "é \\u00e9 🙂", "10": "1", "9": [0.25, -7, 1e-05, 2e+22, false]}', "[]", "3.50", '"x"', " [ 1 , 2 ] ", '{"a": {"b": {"c": {"d": [[[1.0]]]}}}}',
]
BAD = ["", "{", '{"a": 1,}', "nothing", None]


def canonical(text):
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def test_canonical_text_and_hash(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS + BAD], "t string").select("t", C.canonical_json(F.col("t")).alias("c"), C.settings_hash(F.col("t")).alias("h"))
    got = {r.t: (r.c, r.h) for r in d.collect()}
    for t in TEXTS:
        assert got[t] == (canonical(t), hashlib.sha256(canonical(t).encode()).hexdigest()[:16])
    assert all(got[t] == (None, None) for t in BAD)


def test_order_and_white_space_do_not_count(spark):
    r = random.Random(2)
    value = {f"k{i}": {"x": i / 4, "y": [i, None, {"z": "ö", "a": i % 2 == 0}]} for i in range(12)}

    def shuffled(v):
        if isinstance(v, dict):
            items = [(k, shuffled(x)) for k, x in v.items()]
            r.shuffle(items)
            return dict(items)
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    rows = [(json.dumps(shuffled(value), indent=r.choice((None, 1, 2)), ensure_ascii=r.random() < 0.5),) for _ in range(20)]
    assert [x.h for x in spark.createDataFrame(rows, "t string").select(C.settings_hash(F.col("t")).alias("h")).distinct().collect()] == [hashlib.sha256(canonical(rows[0][0]).encode()).hexdigest()[:16]]


def places(v, path=""):
    if isinstance(v, dict) and v or isinstance(v, list) and v:
        return {p: x for k, inner in (v.items() if isinstance(v, dict) else enumerate(v)) for p, x in places(inner, f"{path}.{k}" if path else str(k)).items()}
    return {path: v}


def test_nested_settings_differ_by_path(spark):
    a = {"p1": {"conf": 0.3, "tiles": [1, 2], "none": None, "same": {"x": "y"}}, "only": {"a": {"b": 1}}, "empty": {}}
    b = {"p1": {"conf": 0.25, "tiles": [1, 3, 4], "none": 0, "same": {"x": "y"}}, "more": True, "empty": []}
    d = spark.createDataFrame([(1, json.dumps(a), json.dumps(b)), (2, json.dumps(a), json.dumps(a)), (3, "{}", "7"), (4, None, "{")], "k int, a string, b string")
    left, right = C.flattened(d, ["k"], "a"), C.flattened(d, ["k"], "b")
    got = {(r.k, r.path): (r.value_a and json.loads(r.value_a), r.value_b and json.loads(r.value_b)) for r in C.differences(left, right, ["k"]).filter("k = 1").collect()}
    x, y = places(a), places(b)
    assert got == {(1, p): (x.get(p), y.get(p)) for p in x.keys() | y.keys() if p not in x or p not in y or x[p] != y[p] or type(x[p]) is not type(y[p])}
    assert {r.k for r in C.differences(left, right, ["k"]).collect()} == {1, 3}
    assert {(r.k, r.path, r.value) for r in left.filter("k = 3").collect()} == {(3, "", "{}")}
