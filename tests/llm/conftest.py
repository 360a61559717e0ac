from __future__ import annotations

import pytest


@pytest.fixture
def unsent(spark):
    """Joins that aren't told to broadcast don't, as with tables of any size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    most = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, most)


@pytest.fixture
def moved(spark):
    """The bytes that stages have shuffled so far."""
    jvm = spark.sparkContext._jvm

    def read():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    return read
