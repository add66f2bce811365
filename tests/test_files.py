"""Files that queries write for readers and streams: their size does not grow with the table."""

from pathlib import Path

import pytest

from agentlog.plans import catalog, q_streams
from agentlog.plans.registry import QUERIES, runner


@pytest.mark.parametrize(
    "name, folder, rows",
    [
        ("S2_read_jsonl", "jsonl", 1000), ("S3_read_csv", "csv", 1000), ("S16_read_live", "live", 1000),
        ("T1_normalize_stream", "live", 1000), ("T2_store_once", "feed0", 2000),
    ],
)
def test_files_hold_bounded_rows(spark, sf_dir, tmp_path, monkeypatch, name, folder, rows):
    catalog.load()
    monkeypatch.setattr(q_streams, "FILE_ROWS", 125, raising=False)
    monkeypatch.setattr(q_streams, "_folder", lambda fx, part: f"{tmp_path}/{part}")
    few = runner(QUERIES[name])(spark, sf_dir).count()
    assert len(list(Path(tmp_path, folder).glob("part-*"))) == rows / 125
    assert few == (rows / 2 if name == "T2_store_once" else few) and few > 0
