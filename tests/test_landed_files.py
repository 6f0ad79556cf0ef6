"""Streams read files of a bounded number of records, however many records there are."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from screenlens.plans import q_models, q_stream
from screenlens.sources.tables import ensure_checkpoint_dir


@pytest.mark.parametrize("module,query,name", [(q_stream, "q_stream_score", "stream-score"),
                                               (q_models, "q_stream_features", "stream-features")])
def test_files_hold_a_bounded_number_of_records(spark, sf, monkeypatch, module, query, name):
    monkeypatch.setattr(module, "FILE_ROWS", 60)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(os.path.join(folder, f"{name}-*")))
    n = getattr(module, query)(spark, sf).count()
    (base,) = set(glob.glob(os.path.join(folder, f"{name}-*"))) - before
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(os.path.join(base, "source", "*.parquet"))]
    assert sum(rows) == n and max(rows) <= 60
