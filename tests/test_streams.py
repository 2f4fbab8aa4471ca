"""Streaming queries: results are tables in files, not rows in the driver, and don't depend on the files that hold the events."""

import duckdb
import pytest

from kronograph import plans
from kronograph.streaming import streams
from tests.test_oracle import rows


@pytest.fixture(scope="module")
def dealt(sf, tmp_path_factory):
    """The events dealt over three files, each over the whole time."""
    at = tmp_path_factory.mktemp("dealt")
    (at / "events.parquet").mkdir()
    for k in range(3):
        duckdb.sql(f"copy (select * from '{sf}/events.parquet' where event_id % 3 = {k}) to '{at}/events.parquet/{k}.parquet' (format parquet)")
    return str(at)


def held(spark, dealt, sf, name):
    ours = plans.QUERIES[name](spark, dealt)
    assert ours.inputFiles()  # rows of a table in memory lie in the driver
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    theirs = con.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.toPandas()) == rows(theirs)


@pytest.mark.parametrize("name", ["stream_ingest", "stream_cooldown", "stream_sessions", "stream_tumbling", "stream_novelty", "stream_join"])
def test_streams_of_several_files(spark, dealt, sf, name):
    held(spark, dealt, sf, name)


def test_stream_settings_are_put_back(spark, dealt):
    mine = [spark.conf.get(k, None) for k in streams.STATE]
    plans.QUERIES["stream_ingest"](spark, dealt)
    assert [spark.conf.get(k, None) for k in streams.STATE] == mine


def test_stream_state_has_small_buffers(spark, dealt, monkeypatch):
    """A state store's write buffers aren't bounded by the cache's limit: they grow while rows come faster than they are flushed."""
    found, start = [], streams.ingest

    def started(*args, **more):
        found.append([int(spark.conf.get(f"spark.sql.streaming.stateStore.rocksdb.{k}", None) or -1) for k in ("maxMemoryUsageMB", "writeBufferSizeMB", "maxWriteBufferNumber")])
        return start(*args, **more)

    monkeypatch.setattr(streams, "ingest", started)
    plans.QUERIES["stream_sessions"](spark, dealt)
    cache, size, number = found[0]
    assert 0 < cache <= 64 and 0 < size * number <= 8


def test_stream_without_events(spark, sf, tmp_path):
    duckdb.sql(f"copy (select * from '{sf}/events.parquet' limit 0) to '{tmp_path}/events.parquet' (format parquet)")
    assert plans.QUERIES["stream_ingest"](spark, str(tmp_path)).count() == 0
