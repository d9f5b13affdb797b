import pytest
from pyspark.sql import functions as F

from lexatlas.operators import invariants, joins


def test_fold_outputs_merge_or_say_why(spark):
    part = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "qid string, answer string")
    wanted = part(["a", "b", "c"])
    assert {r.qid for r in invariants.merge_folds([part(["a"]), part(["b", "c"])], wanted).collect()} == {"a", "b", "c"}
    for parts in ([part(["a", "b"]), part(["b", "c"])], [part(["a"]), part(["b"])], [part(["a", "b"]), part(["c", "d"])]):
        with pytest.raises(ValueError, match="do not merge"):
            invariants.merge_folds(parts, wanted)


def test_canonical_json_ignores_the_order_of_fields(spark):
    a = spark.sql("select named_struct('b', 1, 'a', named_struct('y', null, 'x', array(named_struct('q', 2, 'p', 'ß')))) as r, map('k2', 1, 'k1', 2) as m")
    b = spark.sql("select named_struct('a', named_struct('x', array(named_struct('p', 'ß', 'q', 2)), 'y', null), 'b', 1) as r, map('k1', 2, 'k2', 1) as m")
    for name in ("r", "m"):
        left, right = (f.select(invariants.canonical_json(f, name).alias("j")).first().j for f in (a, b))
        assert left == right
    assert a.select(invariants.canonical_json(a, "r").alias("j")).first().j == '{"a":{"x":[{"p":"ß","q":2}],"y":null},"b":1}'


def test_stems(spark):
    rows = spark.createDataFrame([("/a/b.json",), ("c.tar.gz",), ("http://h/x.html?y=1",), ("plain",)], "path string")
    assert [r.s for r in rows.select(invariants.file_stem(F.col("path")).alias("s")).collect()] == ["b", "c.tar", "x", "plain"]


def test_narrow_is_the_same_either_way(spark, monkeypatch):
    rows, ids = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(3,), (3,), (7,), (500,)], "k long")
    assert sorted(r.k for r in joins.narrow(rows, ids, "k").collect()) == [3, 7]
    monkeypatch.setattr(joins, "fits_broadcast", lambda frame: False)
    assert sorted(r.k for r in joins.narrow(rows, ids, "k").collect()) == [3, 7]
