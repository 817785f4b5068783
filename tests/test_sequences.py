"""Sequences stay whole when a join below them is planned anew while it runs."""

import pytest
from tests.test_streaming import frame, plain, requests

from loamstone.streaming import admission


@pytest.fixture
def replanned_joins(spark):
    """Joins are planned as merge joins and become broadcast joins once the small side is known."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_a_tenant_is_one_sequence(spark, replanned_joins):
    rows = requests()
    tenants = spark.createDataFrame([(f"t{i}", 4, 3) for i in range(3)], "tenant_id string, max_requests_per_min int, max_concurrent int")
    made = admission.admit(frame(spark, rows).repartition(4), tenants)
    assert {r.request_id: r.admitted for r in made.collect() if r.kind == "start"} == plain(rows, 4, 3)
