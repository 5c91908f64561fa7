"""Run folders, commits and what is left of them."""

import pytest

from linkloom.operators import storage


def test_old_runs_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "checkpoint_folder", lambda _: str(tmp_path))
    runs = [storage.RunFolder(spark, label) for label in ("old_one", "old_two")]
    for run in runs:
        assert run.keep(spark.range(3), "t").count() == 3
    (tmp_path / "something else").mkdir()
    (tmp_path / "rdd-checkpoints").mkdir()
    assert storage.remove_old_runs(spark, hours=1) == 0
    assert storage.remove_old_runs(spark, hours=-1) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["rdd-checkpoints", "something else"]
    assert storage.remove_old_runs(spark) == 0


def test_commits_are_seen_in_order(spark, tmp_path):
    commits = storage.Commits(spark, str(tmp_path / "deep"))
    assert commits.latest() is None
    for version in (1, 2, 11):
        commits.commit(version, name=f"n{version}")
        assert storage.Commits(spark, str(tmp_path / "deep")).latest() == (version, {"name": f"n{version}"})


def test_other_read_errors_are_not_taken_for_no_commit(spark, tmp_path):
    commits = storage.Commits(spark, "nosuchscheme://place")
    with pytest.raises(Exception):
        commits.latest()
