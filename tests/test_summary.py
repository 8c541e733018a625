import datetime

import pytest

from conftest import rows
from tablesync.model import LOG_SCHEMA
from tablesync.operators.control import sync_summary
from tablesync.sinks.control_store import ControlStore
from tablesync.sources.folders import Folder
from tablesync.streaming.summary import SummaryStore, log_stream, summary_stream


def entries(spark, *some):
    """(log_id, mapping_id, type, status, records, duration), one minute after another."""
    start = datetime.datetime(2024, 1, 1)
    values = [(i, 1, m, t, "text", s, n, d, start + datetime.timedelta(minutes=i % 50)) for i, m, t, s, n, d in some]
    return spark.createDataFrame(values, LOG_SCHEMA)


@pytest.fixture
def mappings(spark):
    return spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "mapping_id int, source_table string, dest_table string")


BATCHES = [
    [(1, 1, "CDC", "SUCCESS", 5, 10), (2, 1, "CDC", "ERROR", None, None), (3, None, "SYNC", "INFO", None, None)],
    [],
    [(4, 1, "CDC", "SUCCESS", 7, 21), (5, 2, "FULL_SYNC", "SUCCESS", 100, 5), (0, 2, "FULL_SYNC", "ERROR", None, None)],
    [(6, 9, "CDC", "WARNING", None, 3), (55, 1, "CDC", "FAILED", None, None)],
    [(8, 2, "CDC", "SUCCESS", 1, 1)],
]


@pytest.mark.parametrize("merge_every", [1, 2, 100])
def test_equal_to_the_view_after_every_batch(spark, folder, mappings, merge_every):
    store, seen = SummaryStore(spark, folder("summary"), merge_every), []
    assert store.summary(mappings).count() == 0
    for number, batch in enumerate(BATCHES):
        seen += batch
        store.add(entries(spark, *batch), number)
        want = sync_summary(entries(spark, *seen), mappings)
        assert rows(store.summary(mappings).select(want.columns)) == rows(want)
        store.add(entries(spark, *batch), number)  # delivered again
        assert rows(store.summary(mappings).select(want.columns)) == rows(want)
    folders = Folder(spark, f"{store.root}/partials").names()
    assert len(folders) <= merge_every


def test_a_failure_while_merging_loses_and_doubles_nothing(spark, folder, mappings, monkeypatch):
    store = SummaryStore(spark, folder("summary"), 2)
    store.add(entries(spark, *BATCHES[0]), 0)
    with monkeypatch.context() as m:
        m.setattr(store._merged, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.add(entries(spark, *BATCHES[2]), 1)
    store.add(entries(spark, *BATCHES[2]), 1)
    with monkeypatch.context() as m:
        m.setattr("tablesync.streaming.summary.Folder.delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        store.add(entries(spark, *BATCHES[3]), 2)
        with pytest.raises(OSError):
            store.add(entries(spark, *BATCHES[4]), 3)
    want = sync_summary(entries(spark, *BATCHES[0], *BATCHES[2], *BATCHES[3], *BATCHES[4]), mappings)
    assert rows(store.summary(mappings).select(want.columns)) == rows(want)


def test_a_stream_of_the_control_log(spark, folder, mappings):
    control = ControlStore(spark, folder("control"))

    def say(status, n):
        control.append_logs([{"flow_id": 1, "mapping_id": 1, "log_type": "CDC", "log_message": "m", "status": status, "records_count": n}])

    store, checkpoint = SummaryStore(spark, folder("summary"), 3), folder("checkpoint")
    for turn in range(3):
        say("SUCCESS", turn)
        say("ERROR", None)
        summary_stream(log_stream(spark, control.root, 1), store, checkpoint, None).awaitTermination()
        want = sync_summary(control.logs(), mappings)
        assert rows(store.summary(mappings).select(want.columns)) == rows(want)
        if turn == 1:
            control.merge_logs()
