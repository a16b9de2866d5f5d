"""Work on single rows is dealt to all tasks, however few files a table has."""

import __spark_entry__ as entry
from talkweave.plans import queries_jobs as QJ


def test_office_files_are_built_by_all_tasks(spark):
    df = entry.queries()["office_files"](spark, entry.SMOKE_DIR)
    assert "RoundRobinPartitioning(32)" in df._jdf.queryExecution().executedPlan().toString()


def test_specs_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(QJ, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    assert entry.queries()["spec_files"](spark, entry.SMOKE_DIR).count() > 0
    writers = {path.name.split("-")[1] for path in tmp_path.glob("specs/*/part-*.txt")}
    assert len(writers) > 1
