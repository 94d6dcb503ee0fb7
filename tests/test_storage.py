import os
from types import SimpleNamespace

from colophon import storage


def test_the_named_folder_is_used():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "file:///shared/" if key == "spark.checkpoint.dir" else default))
    assert storage.shared_dir(session) == "file:///shared"


def test_written_tables_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    df = storage.written(spark.range(5), "five")
    assert df.count() == 5 and os.listdir(tmp_path / "colophon")
    assert storage.release(spark) >= 1 and not os.listdir(tmp_path / "colophon")
