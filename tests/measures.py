"""What a query moves, for tests of its growth."""


def shuffled(spark, made):
    """Bytes that go through exchanges while made() runs and its result is read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    last = max((x.stageId() for x in map(stages().apply, range(stages().size()))), default=-1)
    made().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(x.shuffleWriteBytes() for x in map(stages().apply, range(stages().size())) if x.stageId() > last)
