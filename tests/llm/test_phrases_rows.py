"""Rows that the last pass over shards sends."""

import numpy as np
import pyarrow as pa
import pytest

from rdlab.llm import phrases


def _shards(spark, many, tmp_path):
    text = [("en" if i % 2 else None, f"{a} x{b} {a}. it is x{b}") for i in range(40) for a in "abcdefgh" for b in range(8)]
    docs = spark.createDataFrame(text, "lang string, text string").coalesce(1)
    docs = docs.union(docs) if many == 2 else docs
    path = str(tmp_path / f"shards{many}")
    phrases.index(docs.coalesce(1), "lang", "text", 3, 300).write.parquet(path)
    rows = spark.read.parquet(path).select(*phrases.COLUMNS)
    return rows.toArrow().to_batches(max_chunksize=7), rows.count()


@pytest.mark.parametrize("held", [phrases.HELD_PHRASES, 6000])
def test_rows_are_not_phrases_times_shards(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_PHRASES", held)
    full = [np.full(1 << (phrases.BITS - 3), 255, np.uint8)] * 3
    sent = {}
    for many in (1, 2):
        batches, shards = _shards(spark, many, tmp_path)
        assert shards > 100
        rows = list(phrases._packed_phrases(iter(batches), full))
        sent[many] = sum(b.num_rows for b in rows)
        table = pa.Table.from_batches(rows).sort_by([("lang", "ascending"), ("part", "ascending")])
        f = {(r["lang"], r["phrase"]): r["f"] for b in phrases._merged_phrases(1)(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()}
        assert f["en", "a x3"] == 20 * many
        assert f["und", "a x3 a"] == 20 * many
        assert f["und", "it is"] == 20 * 64 * many
        assert sum(n for (_, p), n in f.items() if p.count(" ") == 1) == 40 * 64 * 4 * many
    if held == phrases.HELD_PHRASES == 16_000_000:
        assert sent[1] == sent[2] <= 2 << phrases.PART_BITS  # one task, two languages, however many shards
