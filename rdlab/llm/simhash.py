"""SimHash fingerprints and the search for near ones, in DataFrame functions only.

A term is a word with its successor; it votes once for each occurrence (its weight) on every bit of its hash.
The votes of 64 bits are summed as 32 counters of two 32-bit lanes, inside the hash aggregate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rdlab.llm.common import SPACE, written

BITS = 64
_HALF = BITS // 2
_LANES = (1 << _HALF) | 1


def fingerprints(df: DataFrame, key_cols: list[str], text_col: str = "text", fp_col: str = "fp") -> DataFrame:
    """(key_cols, fp_col long), one row for each distinct key.

    Terms are the words (lower-cased, ASCII white space apart), each with its successor. A bit is set where more
    than half of the text's terms have it. A text without words, empty or null, has the fingerprint 0. Rows that
    repeat a key vote together; null keys are a key like others. Texts of up to 2^31 words.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), SPACE + "+"), lambda w: w != "")
    rows = df.select(*key_cols, words.alias("__w"))
    votes = rows.select(*key_cols, F.explode_outer(F.transform("__w", lambda w, i: F.xxhash64(w, F.get(F.col("__w"), i + 1)))).alias("__h"))
    sums = [F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(_LANES)).alias(f"__v{k}") for k in range(_HALF)]
    total = votes.groupBy(*key_cols).agg(F.count("__h").alias("__n"), *sums)
    return total.select(*key_cols, _bits(F.col("__n"), [F.col(f"__v{k}") for k in range(_HALF)]).alias(fp_col))


def _bits(n: Column, votes: list[Column]) -> Column:
    fp = F.lit(0).cast("long")
    for k, v in enumerate(votes):
        for lane, count in ((k, v.bitwiseAND((1 << _HALF) - 1)), (k + _HALF, F.shiftrightunsigned(v, _HALF))):
            fp = fp.bitwiseOR(F.when(count * 2 > n, F.lit(1 << lane if lane < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def blocks_for(n: int, radius: int = 3, share: int = 4) -> int:
    """The least number of blocks, from radius + 2 on, whose keys are so long that n random fingerprints share one with at most `share` others on average."""
    blocks = radius + 2
    while blocks < BITS and n >> (BITS * (blocks - radius) // blocks) > share:
        blocks += 1
    return blocks


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int | None = None, fp_col: str = "fp") -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints that differ in at most `radius` bits, each once. Null ones and an empty table give none.

    The bits fall into `blocks` blocks; two fingerprints within the radius agree on some blocks - radius of
    them, so one table for each such choice, keyed by those blocks, finds every pair. By default their number grows with
    that of the fingerprints, so that the members of one key don't.
    """
    blocks = blocks or blocks_for(fps.agg(F.approx_count_distinct(fp_col)).first()[0], radius)
    fps = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    table = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("table", "part"))
    a, b = table.alias("a"), table.alias("b")
    hit = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp")))
    near = hit.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    return near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, text, next_text, bucket, place): the text of the next document by descending id, after the last the first's.

    Null texts are empty. Null ids come last, rows of one id in the order of their texts. Ids fall into ranges
    of about bucket_rows rows; the first row of each range is copied to the range before it, so that a window
    sees it. Only range bounds and first ids (at most 4,096) come to the driver. (bucket, place) tells rows apart.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = docs.count()
    many = min(4096, max(1, n // bucket_rows))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / many for i in range(1, many)], 0.2 / many)}) if many > 1 else []
    bucket = F.lit(0)
    if cuts:
        # the place of an id among the cuts, by halving: a fixed number of steps in generated code
        bucket = F.expr(_place(cuts))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int"))
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.desc("bucket")).collect()
    if not tops:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"), "bucket", F.lit(1).alias("place"))
    # a range's first row is seen after the range above it; the very first after the lowest range
    above = [(tops[-1]["bucket"], tops[0]["bucket"], tops[0]["top"])] + [(tops[i - 1]["bucket"], tops[i]["bucket"], tops[i]["top"]) for i in range(1, len(tops))]
    links = spark.createDataFrame(above, "target int, bucket int, top long")
    heads = docs.join(F.broadcast(links), (docs["bucket"] == links["bucket"]) & docs["doc_id"].eqNullSafe(links["top"]))
    heads = heads.groupBy("target", docs["doc_id"]).agg(F.min("text").alias("text")).select("doc_id", "text", F.col("target").alias("bucket"), F.lit(1).alias("ghost"))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = docs.withColumn("ghost", F.lit(0)).unionByName(heads)
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(w), F.lit(""))).withColumn("place", F.row_number().over(w)).where("ghost = 0").select("doc_id", "text", "next_text", "bucket", "place")


def _place(cuts: list[int], lo: int = 0) -> str:
    """SQL for the number of cuts at or below doc_id."""
    if len(cuts) == 1:
        return f"if(doc_id >= {cuts[0]}L, {lo + 1}, {lo})"
    mid = len(cuts) // 2
    low = _place(cuts[:mid], lo)
    return f"if(doc_id >= {cuts[mid]}L, {_place(cuts[mid + 1 :], lo + mid + 1) if cuts[mid + 1 :] else lo + mid + 1}, {low})"


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points (rounded down) replaced by the first as many (or all) of the next text."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int | None = None) -> DataFrame:
    """One row for each row of df: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near).

    n_near counts the other rows whose fingerprint lies within `radius` bits. For ties, nulls and repeated rows see with_next.
    An empty table gives no rows; other columns are not read.
    """
    rows = with_next(df, id_col, text_col).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    keys = {
        "doc_id": F.col("doc_id"), "bucket": F.col("bucket"), "place": F.col("place"), "n_chars": F.char_length("text").cast("long"),
        "own": F.unhex(F.md5(F.col("text").cast("binary"))), "next": F.unhex(F.md5(F.col("next_text").cast("binary"))), "sha": F.unhex(F.sha2("edit", 256)),
    }
    both = rows.select(*[v.alias(k) for k, v in keys.items()], F.posexplode(F.array("text", "edit")).alias("side", "text"))
    votes = fingerprints(both, [*keys, "side"])
    docs = votes.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edit_fp"))
    docs = written(docs, "fingerprints")
    # a row for each text and for each fingerprint, written, so that joins with hot ones are between plain tables and can be split
    byte = written(docs.groupBy(F.col("own").alias("next")).agg(F.max("fp").alias("next_fp")), "texts")
    sizes = written(docs.groupBy("fp").agg(F.count("*").alias("m")), "sizes")
    pairs = near_fingerprints(sizes, radius, blocks)
    ways = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    more = ways.join(sizes.withColumnsRenamed({"fp": "other", "m": "k"}), "other").groupBy("fp").agg(F.sum("k").alias("k"))
    near = written(sizes.join(more, "fp", "left").select("fp", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_near")), "near")
    out = docs.join(byte, "next", "left").join(near, "fp", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edit_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edit_fp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("next_fp", F.lit(0))).alias("near_next"), "n_near",
    )
