"""Canonical JSON and walks over nested records against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from attestra.operators import trees as N


def test_fingerprints(spark):
    same = ['{"b": 1, "a": {"y": [1, null, "é"], "x": null}}', '{"a":{"x":null,"y":[1,null,"é"]},"b":1}', ' { "a" : {"y":[1, null,"é"] , "x":null}, "b":1 } ']
    other = ['{"a":{"y":[1,null,"é"]},"b":1}', '{"a":{"x":null,"y":[null,1,"é"]},"b":1}', '{"a":{"x":null,"y":[1,null,"é"]},"b":"1"}', "[]", "{}", "null", '"a\\"b\\n"']
    rows = spark.createDataFrame([(t,) for t in [*same, *other, "{broken", "", None]], "x string").select("x", N.fingerprint(F.col("x")).alias("f")).collect()
    plain = lambda t: hashlib.sha256(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert [r.f for r in rows[: len(same) + len(other)]] == [plain(t) for t in same + other]
    assert len({r.f for r in rows[: len(same)]}) == 1 and len({r.f for r in rows}) == len(other) + 2
    assert [r.f for r in rows[-3:]] == [None] * 3


def walked(value, path=(), place=()):
    if isinstance(value, dict):
        if isinstance(value.get("text"), str) and isinstance(value.get("evidence_ids"), list):
            yield list(path), list(place), value
        for i, (k, child) in enumerate(value.items()):
            if k not in {"evidence_ids", "context_evidence_ids"}:
                yield from walked(child, (*path, k), (*place, i))
    elif isinstance(value, list):
        for i, child in enumerate(value):
            yield from walked(child, (*path, str(i)), (*place, i))


def test_claims_at_any_depth(spark):
    claim = lambda t, **more: {"text": t, "evidence_ids": ["e"], **more}
    trees = [
        {"z": claim("one"), "a": [claim("two", inner=claim("three")), 5, None, [[claim("four")]]], "text": 7, "evidence_ids": []},
        claim("root", evidence_ids_more=[claim("five")], context_evidence_ids=[claim("hidden")]), [claim("six"), {"text": "no list", "evidence_ids": "e"}, {"text": None, "evidence_ids": []}], {"deep": {"er": {"est": {"of": [{"all": claim("7", n="5")}]}}}}, 5, "text", None, {},
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(90, "{broken"), (91, None), (92, "")]
    got = N.records_in(spark.createDataFrame(rows, "id long, j string"), "id", F.col("j"), {"text": "STRING", "evidence_ids": "ARRAY"}, ("evidence_ids", "context_evidence_ids")).orderBy("id", "place").collect()
    want = [(i, p, q, r) for i, t in enumerate(trees) for p, q, r in walked(t)]
    assert [(r.id, list(r.path), list(r.place), json.loads(r.record)) for r in got] == want and len(want) == 8
