import pytest


@pytest.fixture
def written(spark):
    """Bytes of shuffle files that a call writes, with no join of small tables by broadcast."""
    sc, name = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    def measure(call):
        before = total()
        call()
        return total() - before

    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield measure
    spark.conf.set(name, old)
