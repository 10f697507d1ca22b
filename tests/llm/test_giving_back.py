"""Python workers outlive their tasks; what these held goes back to the system."""

from pathlib import Path

import pyarrow as pa

from corpuslens.llm import common


def test_memory_is_given_back_once_when_a_task_is_through(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(seen)))
    batches, seen = [pa.record_batch([pa.array([i])], ["x"]) for i in range(3)], []
    for b in common.giving_back(lambda rows: (b for b in rows))(iter(batches)):
        seen.append(b)
    assert seen == batches and calls == [3]


def test_giving_back_runs_here():
    common.give_back()


def test_tables_in_the_shared_folder_have_no_files_of_checksums(spark):
    """Each would cost a process that sets its permissions."""
    paths = []
    assert common.cut(spark.range(0, 100, 1, 3), paths).count() == 100
    folder = Path(paths[0].removeprefix("file://"))
    assert any(folder.glob("*.parquet")) and not list(folder.rglob(".*.crc"))
    common.remove(spark, paths)
    assert not folder.exists()
