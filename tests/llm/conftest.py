"""Settings under which every size-checked side is too large to broadcast."""

import pytest


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", -1)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, before):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)
