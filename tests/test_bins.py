"""Bins of trials grow with the cores of a session."""

from pathlib import Path

import pytest

from rdlab import queries
from rdlab.operators import isolated
from rdlab.sources import buckets


def test_many_bins_for_each_core(spark):
    assert isolated.bins_for(spark) == 16 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_payloads_of_a_search_keep_all_cores_busy(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 6)
    known = {t.name for t in spark.catalog.listTables()}
    queries.target_search_trials(spark, "/root/testdata/sf0.001")
    (table,) = [t.name for t in spark.catalog.listTables() if t.name not in known and t.name.startswith("payloads")]
    assert buckets.of(spark, table) == 24  # four waves of tasks on six cores; 16 would leave cores idle in the last
