"""Queries against their SQL in DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from rdlab import queries  # noqa: E402

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("avg_reduction", "bd_rate", "bd_matrix", "pchip_slopes", "target_search", "plane_psnr", "trial_id", "frame_batches", "read_psnr_log", "stream_totals", "source_alignment")
NAMES += ("bd_blacklist_lines", "bd_mean_lines", "bd_rate_strict", "create_encodes", "measured_trials", "payload_lossless", "stream_upsert_first", "target_search_rounds", "image_reduction", "distinct_sources", "fixed_frames", "read_vmaf_json_means", "psnr_wide", "sequence_psnr_planes", "trial_grid_16bit", "param_sweep_tables")
NAMES += ("raw_frames", "plane_psnr_tiles", "plane_mse_tiles", "depth_shift_psnr_tiles", "field_merge_psnr_tiles", "frame_digest", "frame_digest_tiles", "sequence_psnr", "bits_by_type", "bitrate", "read_vmaf_files", "read_psnr_files", "insert_trials_bucketed", "missing_trials_bucketed")
NAMES += ("target_search_trials", "trials_udtf", "trials_resumed", "stream_upsert", "read_database", "slice_blocks", "metric_over_images", "trial_modes", "report_matrix", "bd_mean")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    got = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


@pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")
def test_slopes_of_all_metrics(spark):
    test_same_rows(spark, "pchip_slopes_all")
    seen = {r["metric"] for r in queries.QUERIES["pchip_slopes_all"](spark, DIR).select("metric").distinct().collect()}
    assert seen == set(queries.BD_METRICS)
