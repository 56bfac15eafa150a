"""How many requests are open at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peak(requests: DataFrame, key: str) -> DataFrame:
    """key and its peak: the most requests (start, end) that are open at once; one that ends as another starts isn't."""
    moments = requests.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("m")).select(key, "m.*")
    w = Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return moments.withColumn("open", F.sum("d").over(w)).groupBy(key).agg(F.max("open").alias("peak"))
