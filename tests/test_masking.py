"""Masking of nested records by hand."""

import json

from pyspark.sql import functions as F

from tidemark.functions.masking import MASK, TOO_DEEP, for_log


def test_secrets_at_any_place(spark):
    schema = "id int, Email string, user struct<name: string, Phone: string, tags: array<struct<token: string, n: int>>>, extra map<string, string>, nested map<string, struct<password: string, ok: boolean>>, list array<int>, text string"
    row = (1, "a@b.c", ("Jan", "+32", [("t", 1), None, ("u", 2)]), {"APIKEY": "k", "page": "3"}, {"x": ("p", True), "cookie": ("c", None)}, list(range(80)), "x" * 600)
    got = for_log(spark.createDataFrame([row, (2, None, None, None, None, None, None)], schema)).orderBy("id").collect()
    a = got[0].asDict(recursive=True)
    assert (a["Email"], a["user"]) == (MASK, {"name": "Jan", "Phone": MASK, "tags": [{"token": MASK, "n": 1}, None, {"token": MASK, "n": 2}]})
    assert a["extra"] == {"APIKEY": MASK, "page": "3"} and a["nested"]["cookie"] == MASK and json.loads(a["nested"]["x"]) == {"password": MASK, "ok": True}
    assert len(a["list"]) == 50 and len(a["text"]) == 501
    assert (got[1].user, got[1].extra, got[1].text) == (None, None, None)


def test_what_lies_too_deep_is_named(spark):
    deep = F.array(F.array(F.array(F.array(F.array(F.array(F.lit(1)))))))
    value = for_log(spark.range(1).select(deep.alias("d"))).first().d
    assert value == [[[[[[TOO_DEEP]]]]]]
