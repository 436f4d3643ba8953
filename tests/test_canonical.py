"""Canonical JSON against the standard library's, for any key order and nesting."""

import hashlib
import json
from decimal import Decimal

from pyspark.sql import functions as F

from inkspan.functions.canonical import canonical_json, record_digest

KIND = "id int, v struct<z:string,a:array<struct<k:bigint,b:boolean>>,m:map<string,array<string>>,`é`:decimal(10,2),n:string>"
ROWS = [
    (1, ("plain", [(1, True), (-2, None)], {"b": ["x"], "a": [], "Z": ["é", None]}, Decimal("1.50"), None)),
    (2, ('q"\\\n\r\t\b\f\x01\x1f\x7f漢🙂', [], {}, None, "\r\n")),
    (3, (None, None, None, Decimal("-0.25"), "\\u0041")),
    (4, None),
]


def plain(v):
    kinds = lambda s: None if s is None else {"z": s[0], "a": None if s[1] is None else [{"k": k, "b": b} for k, b in s[1]], "m": s[2], "é": None if s[3] is None else float(s[3]), "n": s[4]}
    return json.dumps(kinds(v), sort_keys=True, ensure_ascii=False, separators=(",", ":")).replace(":1.5}", ":1.50}")


def test_equals_the_standard_library(spark):
    df = spark.createDataFrame(ROWS, KIND)
    assert {r.id: r.j for r in df.select("id", canonical_json(df, "v").alias("j")).collect()} == {i: plain(v) for i, v in ROWS}


def test_digests_do_not_depend_on_order(spark):
    a = spark.createDataFrame([(("x\r\ny", 2),)], "v struct<b:string,a:int>")
    b = spark.createDataFrame([((2, "x\ny"),)], "v struct<a:int,b:string>")
    told = [df.select(record_digest(df, "v", "s-1")).first()[0] for df in (a, b)]
    payload = json.dumps({"schema": "s-1", "record": {"a": 2, "b": "x\ny"}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert told == [hashlib.sha256(payload.encode()).hexdigest()] * 2
    assert a.select(record_digest(a, "v", "s-2")).first()[0] != told[0]
    maps = spark.createDataFrame([({"b": 1, "a": 2},), ({"a": 2, "b": 1},)], "v map<string,int>")
    assert maps.select(F.count_distinct(record_digest(maps, "v", "s"))).first()[0] == 1
