"""Shared by the core tests: data folders and evaluation of one expression over literal rows."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def evaluate(spark, column_fn, values, schema="x string"):
    """Apply a Column function to a one-column literal DataFrame; return the values in order."""
    from pyspark.sql import functions as F
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame(rows, schema).withColumn("_i", F.monotonically_increasing_id())
    out = df.select("_i", column_fn(df).alias("r")).orderBy("_i").collect()
    return [r["r"] for r in out]
