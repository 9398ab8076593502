"""The newest options file, also of numbers of more than six digits."""

from basalt import registry
from basalt.operators import maintain


def test_newest_of_long_numbers(spark, tmp_path):
    import duckdb

    spark.range(999_990, 1_200_000, 7).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = [r.name for r in registry.QUERIES["newest_options"](spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in c.execute(registry.SQL["newest_options"]).fetchall()] == ["OPTIONS-119999"]


def test_newest_by_name(spark):
    names = spark.createDataFrame([("OPTIONS-000009",), ("OPTIONS-1000001",), ("OPTIONS-999999",), ("CURRENT",), ("OPTIONS-x",)], "name string")
    assert maintain.newest_options(names).first().name == "OPTIONS-1000001"
