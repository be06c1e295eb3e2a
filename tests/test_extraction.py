import pytest

from lexmill.operators import extraction as E


def test_coerced(spark):
    raw = ['{"spans": ["a b", " ", {"text": "c", "pos": "noun"}], "construal": "STORE ", "evaluative": {"tone": "odd"}, "conceptual_schema": " ", "on_target": true}', "no json", None, '{"spans": null}', "[1]"]
    got = {r.i: r for r in E.coerced(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), "raw").collect()}
    assert [(s.text, s.pos) for s in got[0].spans] == [("a b", None), ("c", "noun")]
    assert (got[0].construal, got[0].tone, got[0].schema_name, got[0].on_target, got[0].error) == ("store", "neutral", None, True, None)
    assert [got[k].error for k in (1, 2, 3, 4)] == ["unreadable", "unreadable", None, "unreadable"] and all(got[k].spans == [] for k in (1, 2, 3, 4))


def test_progress_and_sources(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "g string, k int")
    d = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 9)], "g string, k int")
    assert {r.g: r.status for r in E.progress(e, d, "g", "k").collect()} == {"a": "partial", "b": "done", "c": "stale"}
    with pytest.raises(ValueError, match="unknown"):
        E.source_subset(spark.createDataFrame([("x",)], "source string"), ["x", "y"])


def test_instrument(spark):
    known = spark.createDataFrame([("p", "v1", "0" * 64)], "name string, version string, sha256 string")
    assert len(E.checked_instrument(known, "p", "v2", "text")) == 64
    with pytest.raises(ValueError, match="changed"):
        E.checked_instrument(known, "p", "v1", "text")
