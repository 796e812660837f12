import os

import pytest
from pyspark.sql import functions as F

from sparkprep.session import Scratch, settings, shared_folder


def test_steps_are_dropped_one_by_one(spark):
    scratch = Scratch(spark)
    before = set(os.listdir(f"{shared_folder(spark).removeprefix('file:')}/sparkprep")) if os.path.isdir(f"{shared_folder(spark)}/sparkprep") else set()
    first = scratch.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "first")
    with pytest.raises(ValueError, match="first"):
        scratch.write(spark.range(1), "first")
    second = scratch.write(first.join(first.withColumnRenamed("s", "t"), "k"), "second")
    scratch.drop("first")
    left = set(os.listdir(f"{shared_folder(spark).removeprefix('file:')}/sparkprep")) - before
    assert len(left) == 1 and left.pop().startswith("second-")
    assert second.where("s = t").count() == 7
    # the name is free again
    assert scratch.write(spark.range(3), "first").count() == 3
    scratch.drop("first", "second")


def test_settings_come_back(spark):
    key, unset = "spark.sql.shuffle.partitions", "spark.sparkprep.unset"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), settings(spark, {key: "3", unset: "x"}):
        assert (spark.conf.get(key), spark.conf.get(unset)) == ("3", "x")
        raise RuntimeError
    assert spark.conf.get(key) == before and spark.conf.get(unset, None) is None
