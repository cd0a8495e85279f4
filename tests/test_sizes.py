"""Steps whose work must not grow with repeats."""

from pyspark.sql import functions as F

from rankfold.operators import matching as mt, rule_tables as rt


def test_residual_joins_a_listed_value_once(spark, collect, monkeypatch):
    saved = []
    monkeypatch.setattr(mt, "cut_lineage", lambda df: saved.append(df) or df)
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    listed = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "z").alias("x"))
    assert collect(mt.residual(df, "c", listed, "x")) == sorted([("b",), ("b",), (None,)], key=repr)
    assert [s.count() for s in saved] == [3]


def test_hits_of_a_batch_leave_in_parts(monkeypatch):
    import pyarrow as pa

    taken = []

    class Functions:
        @staticmethod
        def arrow_udf(find, kind):
            taken.append(find)
            return F.udf(lambda t: None, "string")

        col = staticmethod(F.col)

    words = [f"word{i:03}" for i in range(200)]
    index = [{"field": "description", "word": w, "mode": "substring", "cancels": False, "rule_order": i, "rule_id": w, "kind": "points",
              "value": 1, "flag": ""} for i, w in enumerate(words)]
    monkeypatch.setattr(rt, "F", Functions)
    monkeypatch.setattr(rt, "AT_ONCE", 1000)
    rt._shipped_hits(index, ["description"], [F.col("t")])
    texts = [" ".join(words[:i % 201]) for i in range(500)]
    parts = list(taken[0](iter([pa.array(texts[:400]), pa.array(texts[400:], pa.string())])))
    assert max(len(p.flatten()) for p in parts) < 1000 + 200 and len(parts) > 20
    assert [[h["rule_id"] for h in hits] for p in parts for hits in p.to_pylist()] == [words[:i % 201] for i in range(500)]
