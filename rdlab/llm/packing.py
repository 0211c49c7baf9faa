"""Best-fit packing of documents into bins of one capacity, under conflicts.

Bins are kept in the order of their residual room and carry two bitmaps: sources and duplicate clusters. A piece
goes to the successor of its length, the tightest bin with room; if that one holds the piece's source or
cluster the search goes on to the next, until a bin fits or a new one is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "shard long, doc_id long, piece long, length long, bin long, place long"


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source bit, cluster bit), taken longest first as given; bit 0 has no conflicts."""
    room: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        at = bisect_left(room, (length, -1))
        while at < len(room) and (sources[room[at][1]] & source or clusters[room[at][1]] & cluster):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((b, capacity - left))
        sources[b] |= source
        clusters[b] |= cluster
        if left > length:
            insort(room, (left - length, b))
    return out


def _pack_shards(capacity: int):
    def one(shard: int, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        bits: tuple[dict, dict] = ({}, {})

        def bit(kind: int, value) -> int:
            return 0 if value is None or value != value else 1 << bits[kind].setdefault(value, len(bits[kind]))

        again = rows["cluster"].value_counts()
        alone = set(again.index[again == 1])  # a cluster of one piece can't conflict
        pieces = [(n, bit(0, s), 0 if c in alone else bit(1, c)) for n, s, c in zip(rows["length"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), strict=True)]
        put = pack(pieces, capacity)
        return pd.DataFrame({"shard": shard, "doc_id": rows["doc_id"].array, "piece": rows["piece"].array, "length": rows["length"].array, "bin": [b for b, _ in put], "place": [p for _, p in put]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in parts:
            for shard, group in pdf.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield one(held[0]["shard"].iloc[0], pd.concat(held))
                    held = []
                held.append(group)
        if held:
            yield one(held[0]["shard"].iloc[0], pd.concat(held))

    return run


def sizes(docs: DataFrame, text_col: str = "text") -> list:
    """length, in words, and cluster, by equal text, of documents to be packed; a null text has length 0 and no cluster."""
    return [F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("length"), F.md5(F.col(text_col).cast("binary")).alias("cluster")]


def best_fit_packing(df: DataFrame, capacity: int = 4096, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster", shard_rows: int = 2000) -> DataFrame:
    """(bin_id string, doc_id, piece, length, place, bin_used): one row for each piece of each row of df.

    A bin holds at most `capacity` units, no two pieces of one source and none of one duplicate cluster. A row
    longer than a bin is cut: its full pieces fill bins of their own, the rest is packed like a short row. A row of length 0
    or null takes part as a piece of length 0. Null sources and clusters conflict with nothing. Rows are dealt to shards
    of about shard_rows by a hash of id and cluster, each packed longest first, ties by id; equal rows
    are separate pieces; an empty table gives no rows, and other columns are not read. place is the piece's offset in its bin. The session says how many
    tasks share the shards.
    """
    n = df.count()
    shards = max(1, -(-n // shard_rows))
    length = F.coalesce(F.greatest(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("length"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    whole = F.floor(F.col("length") / capacity).cast("long")
    full = rows.where(F.col("length") >= capacity).select("shard", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"), F.lit(capacity).cast("long").alias("length"), "cluster")
    full = full.select(F.concat(F.lit("f"), "shard", F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), "piece", F.lit("-"), F.monotonically_increasing_id()).alias("bin_id"), "doc_id", "piece", "length", F.lit(0).cast("long").alias("place"))
    rest = rows.where((F.col("length") % capacity > 0) | (F.col("length") == 0)).select("shard", "doc_id", whole.alias("piece"), (F.col("length") % capacity).alias("length"), "source", "cluster")
    packed = rest.repartition("shard").sortWithinPartitions("shard").mapInPandas(_pack_shards(capacity), OUT)
    packed = packed.select(F.concat(F.lit("p"), "shard", F.lit("-"), "bin").alias("bin_id"), "doc_id", "piece", "length", "place")
    return full.union(packed).withColumnRenamed("doc_id", id_col)
