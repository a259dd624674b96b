import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import chunks as ch


def test_every_chunk_has_its_own_partition(spark):
    for n in (1, 2, 12, 37):
        rows = spark.range(2000).select("id", ch.chunk_of(n, "id").alias("chunk")).repartition(n, "chunk")
        at = rows.select("chunk", F.spark_partition_id().alias("p")).distinct().collect()
        assert len(at) == n == len({r.p for r in at}) and {r.chunk for r in at} == set(ch.labels(n))


def test_partitions_equal_the_engine(spark):
    got = [r.p for r in spark.range(-50, 50).select(F.expr("pmod(hash(cast(id AS int)), 7)").alias("p")).collect()]
    assert ch.partition_of(np.arange(-50, 50), 7).tolist() == got
