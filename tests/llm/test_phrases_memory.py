"""What a pass over a shard holds in memory."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from rdlab.llm import phrases


def test_ids_take_four_bytes_and_shorter_lengths_are_let_go():
    rng = np.random.default_rng(3)
    data = b" ".join(b"w%d" % x for x in rng.zipf(1.3, 60_000) % 5000)
    words, counts, before, after = phrases.build(data, 5)
    hashes = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(2654435761)
    full = [np.full(1 << (phrases.BITS - 3), 255, np.uint8)] * 4
    tracemalloc.start()
    for ids, f in phrases.enumerate_phrases(counts[1:], before, after, hashes, full, 5):
        assert ids.dtype == np.int32
        assert f.sum() == 60_000 - ids.shape[1] + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 212 * 60_000  # 202 bytes a word; with ids of eight bytes and more copies of keys 224


def _peak(f):
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def _shard(many, seed):
    rng = np.random.default_rng(seed)
    words, counts, before, after = phrases.build(b" ".join(b"w%d" % x for x in rng.zipf(1.3, many) % 5000), 5)
    return words, counts[1:], before.astype(np.uint16), after.astype(np.uint16), np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)


def test_extensions_are_made_some_intervals_at_a_time():
    many = 4 * phrases.ROWS
    _, counts, before, after, hashes = _shard(many, 4)
    full = [np.full(1 << (phrases.BITS - 3), 255, np.uint8)] * 4

    def run():
        return [(ids.shape[1], int(f.sum())) for ids, f in phrases.enumerate_phrases(counts, before, after, hashes, full, 5)]

    got, peak = _peak(run)
    assert got == [(k, many - k + 1) for k in range(2, 6)]
    assert peak < 120 * many


def test_the_last_pass_sends_small_batches(monkeypatch):
    monkeypatch.setattr(phrases, "HELD_PHRASES", 6_000_000)
    full = [np.full(1 << (phrases.BITS - 3), 255, np.uint8)] * 3
    shards = []
    for seed in range(3):
        words, counts, before, after, hashes = _shard(60_000, seed)
        row = {"lang": "en", "words": [w.decode() for w in words], "counts": counts.astype(np.int32), "hashes": hashes.astype(np.uint32).tobytes(), "before": before.tobytes(), "after": after.tobytes()}
        shards.append(pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()), strict=True)], list(row)))
    batches = list(phrases._packed_phrases(iter(shards), full))
    assert sum(b.nbytes for b in batches) > 3_000_000
    assert max(b.nbytes for b in batches) < phrases.HELD_PHRASES / 8
    table = pa.Table.from_batches(batches).sort_by([("lang", "ascending"), ("part", "ascending")])
    assert sum(sum(r["f"] for r in b.to_pylist()) for b in phrases._merged_phrases(1)(iter(table.to_batches(max_chunksize=5)))) == 3 * (2 * 60_000 - 3)


def test_passes_that_count_read_no_words(spark, monkeypatch):
    asked = []
    frame = type(spark.range(0))
    mapped = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a: (asked.append((self.columns, schema)), mapped(self, f, schema, *a))[1])
    docs = spark.createDataFrame([("en", "a b c. a b c. a b")] * 20, "lang string, text string")
    got = {(r["phrase"], r["a"]) for r in phrases.collocations(docs, min_count=20, max_words=3, inside=101).collect()}
    assert got == {("a b", 60), ("b c", 40), ("a b c", 40)}
    counting = [columns for columns, schema in asked if schema == "range int, block binary"]
    assert len(counting) == 2
    assert all("words" not in x for x in counting)


def test_row_groups_of_the_index_are_looked_at_with_each_shard(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(phrases, "PAGES", phrases.PAGES | {"parquet.block.size": "65536"})
    monkeypatch.setattr(phrases.Tables, "drop", lambda self, *tables: kept.extend(self.paths[id(t)][1] for t in tables))
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([("en", " ".join(f"w{x}." for x in rng.integers(0, 9000, 6000))) for _ in range(12)], "lang string, text string").coalesce(1)
    assert not phrases.collocations(docs, min_count=20, max_words=2, shard_bytes=30_000).count()
    path = next(p for p in kept if "/fm-index-" in p).removeprefix("file:")
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, Path(path).glob("*.parquet")) for i in range(f.num_row_groups)]
    assert sum(groups) >= 12
    assert max(groups) <= 3
