"""Phrases by an FM-index per shard over word ids.

A shard is the text of one language in a partition, up to a bounded number of bytes. Its index holds the words that come
before (and, reversed, after) each suffix in the order of the suffixes. Intervals of phrases are extended by a word on
either side in both indexes at once; counts of shards are summed by phrase. Each length is one pass: a phrase is extended
only if all shards together may have it often enough, which a bitmap of fixed size tells the shards.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rdlab.llm.common import Tables, small_batches

SHARD_BYTES = 3_000_000  #: text of a shard
HELD_SHARDS = 4  #: text of all unfinished shards of a task, in shards
BITS = 26  #: places of a bitmap, as a power of two: 8 MB
RANGE_BITS = 15
RANGE = 1 << RANGE_BITS  #: places whose counts meet in a task
PART_BITS = 8  #: a language's phrases are sent in 2^PART_BITS parts, a row each
SLICE_BITS = 4  #: the parts of a language are summed and sent in 2^SLICE_BITS slices
HELD_PHRASES = 16_000_000  #: bytes of phrases and counts that a task gathers before it sends them
HELD_MERGED = 4_000_000  #: bytes of a part that are gathered before they are summed
ROWS = 1 << 16  #: rows of an index, or phrases, that are worked on at once
#: A shard is a row of some MB: sizes of pages and row groups are looked at with each row, not first after a hundred, as writers and readers hold a row group and codecs a page.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": "16777216"}
BATCH = "1m"  #: of rows passed to Python; a shard is then a batch
SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)  #: odd numbers that spread a word's hash by its place in a phrase
#: A-Z in lower case, what ends a piece as a line feed, a tab as a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
INDEX = "lang string, words array<string>, counts array<int>, places array<int>, hashes binary, before binary, after binary"


def _salt(k: int) -> int:
    return SALTS[k % len(SALTS)] + 2 * (k // len(SALTS))


def order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a circular text of ids sorted by the next `depth` ids or more."""
    rank, have = ids.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        take = min(62 // bits, -(-depth // have))
        key = np.zeros(len(rank), np.int64)
        for k in range(take):
            key = key << bits | np.roll(rank, -k * have)
        by = np.argsort(key)
        have *= take
        if have >= depth:
            return by
        key = key[by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(np.r_[0, key[1:] != key[:-1]])


def build(data: bytes, depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray] | None:
    """Words, their counts, and the words before and after each suffix and each reversed prefix, of a text as _TABLE leaves it. Id 0 is the end of a piece."""
    tokens = data.replace(b"\n", b" \n ").split(b" ")
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    number[b"\n"], number[b""]  # noqa: B018
    ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
    del tokens
    ids = ids[ids != 1]
    ids = np.r_[0, np.where(ids > 1, ids - 1, 0), 0].astype(np.int32)
    ids = ids[np.r_[True, (ids[1:] > 0) | (ids[:-1] > 0)]]
    words = [*number]
    del words[:2]
    if not words:
        return None
    back = ids[::-1]
    before, after = ids[order(ids, depth) - 1], back[order(back, depth) - 1]
    return words, np.bincount(ids, minlength=len(words) + 1), before, after


def _packed(ids: np.ndarray, most: int) -> bytes:
    return ids.astype(_kind(most)).tobytes()


def _kind(most: int) -> type:
    return np.uint16 if most < 1 << 16 else np.uint32


def index(docs: DataFrame, lang_col: str, text_col: str, depth: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard. A null language is `und`, a null text empty; a text may lie in several shards, cut between pieces; a piece is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def shard(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            got = build(b"\n".join(held.pop(lang)), depth)
            if got:
                words, counts, before, after = got
                first = zlib.crc32(lang.encode())
                hashes = np.fromiter((zlib.crc32(w, first) for w in words), np.uint64, len(words))
                places = place(hashes, np.arange(1, len(words) + 1)[:, None])
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [one(lang, pa.string()), one([w.decode() for w in words], pa.list_(pa.string())), one(counts[1:].astype(np.int32), pa.list_(pa.int32())), one(places.astype(np.int32), pa.list_(pa.int32())),
                     one(hashes.astype(np.uint32).tobytes(), pa.binary()), one(_packed(before, len(words)), pa.binary()), one(_packed(after, len(words)), pa.binary())],
                    ["lang", "words", "counts", "places", "hashes", "before", "after"],
                )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (text.as_py() or "").encode().translate(_TABLE)
                while data:
                    room = shard_bytes - size.get(lang, 0)
                    cut = len(data)
                    if cut > room:  # between pieces, if need be behind the room
                        cut = data.rfind(b"\n", 0, room) + 1 or (0 if size.get(lang) else data.find(b"\n") + 1 or cut)
                    if cut:
                        held.setdefault(lang, []).append(data[:cut])
                        size[lang] = size.get(lang, 0) + cut
                        data = data[cut:]
                    if data or size[lang] >= shard_bytes:
                        yield from shard(lang)
                while sum(size.values()) > HELD_SHARDS * shard_bytes:
                    yield from shard(max(size, key=size.__getitem__))
        for lang in [*held]:
            yield from shard(lang)

    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


class Side:
    """One of the two indexes of a shard."""

    def __init__(self, next_to: np.ndarray):
        self.next_to = next_to
        self.seen = next_to.astype(np.int64)
        self.bits = max(1, int(next_to.max()).bit_length())
        self.seen <<= 32
        self.seen |= np.arange(len(next_to))
        self.seen.sort()

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All extensions of disjoint intervals by a word, some intervals at a time: their phrase, word, interval here, begin of the interval in the other index, and count."""
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
            some, many = lo[at:to], size[at:to]
            end = np.cumsum(many, dtype=np.int64)
            rows = np.repeat(some - (end - many), many)
            rows += np.arange(len(rows))
            key = np.repeat(np.arange(to - at), many)
            key <<= self.bits
            key |= self.next_to[rows]
            key, found = np.unique(key, return_counts=True)
            owner, word = key >> self.bits, key & ((1 << self.bits) - 1)
            smaller = np.cumsum(found) - found - (end - many)[owner]  # rows of the interval whose word is smaller
            begin = np.searchsorted(self.seen, word << 32 | some[owner])
            ok = word > 0
            yield tuple(x[ok].astype(np.int32) for x in (owner + at, word, begin, other[at:to][owner] + smaller, found))
            at = to


def place(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each phrase (a row of word ids from 1) in a bitmap."""
    out = np.empty(len(words), np.int32)
    for lo in range(0, len(words), ROWS):
        some = words[lo : lo + ROWS]
        total = np.zeros(len(some), np.uint64)
        for k in range(words.shape[1]):
            total += hashes[some[:, k] - 1] * np.uint64(_salt(k))
        out[lo : lo + ROWS] = (total >> np.uint64(8)) & np.uint64((1 << BITS) - 1)
    return out


def marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def enumerate_phrases(counts: np.ndarray, before: np.ndarray, after: np.ndarray, hashes: np.ndarray, bitmaps: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 to longest the phrases, as rows of word ids, and their counts: those that the bitmap of their length holds, if there is one, and all of whose shorter parts are held by theirs.

    A phrase comes from its end by a word on the left and from its begin by a word on the right; both lead to the same interval.
    """
    hashes = hashes.astype(np.uint64)
    often = np.r_[False, marked(bitmaps[0], place(hashes, np.arange(1, len(counts) + 1)[:, None]))]
    words = np.flatnonzero(often).astype(np.int32)[:, None]
    begins = np.cumsum(np.r_[len(before) - counts.sum(), counts]) - np.r_[0, counts]
    left, right = Side(before), Side(after)
    lo = other = begins[words[:, 0]].astype(np.int32)
    size = counts[words[:, 0] - 1].astype(np.int32)
    for k in range(2, longest + 1):
        held = np.zeros(len(before) if k > 2 else 0, bool)  # begins of the intervals that an extension on the right leads to as well
        if k > 2:
            for *_, twin, _ in right.extend(other, size, lo):
                held[twin] = True
        parts = [(np.empty((0, k), np.int32), *[np.empty(0, np.int32)] * 3)]
        for owner, word, begin, twin, many in left.extend(lo, size, other):
            ok = often[word]
            if k > 2:
                ok &= held[begin]
            longer = np.c_[word[ok], words[owner[ok]]]
            rest = begin[ok], twin[ok], many[ok]
            if k <= len(bitmaps):
                ok = marked(bitmaps[k - 1], place(hashes, longer))
                longer, rest = longer[ok], [x[ok] for x in rest]
            parts.append((longer, *rest))
        words, lo, other, size = map(np.concatenate, zip(*parts, strict=True))
        del parts, held
        yield words, size


def _bitmap(often: DataFrame) -> np.ndarray:
    """A bit for each place of a table, 8 MB whatever its size."""
    at = F.col("place").cast("long") + 1
    parts = often.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts:
        out[(r["k"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _blocks(places: np.ndarray, counts: np.ndarray, most: int) -> pa.RecordBatch:
    """Counts by place as a row (range, block) for each range of places that has any: 2 bytes of place and a count, capped at `most`, for each."""
    order = np.argsort(places)
    places = places[order]
    kind = np.dtype([("place", "<u2"), ("n", np.min_scalar_type(most).newbyteorder("<"))])
    rows = np.empty(len(places), kind)
    rows["place"], rows["n"] = places & (RANGE - 1), np.minimum(counts[order], most)
    first = np.flatnonzero(np.r_[True, places[1:] >> RANGE_BITS != places[:-1] >> RANGE_BITS])[: len(places)]
    ends = (np.r_[first, len(places)] * kind.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array((places[first] >> RANGE_BITS).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows)])], ["range", "block"])


def _often(most: int):
    """(range, bits): a bit for each place whose counts reach `most`, from blocks sorted by range, added up as they come."""
    kind = np.dtype([("place", "<u2"), ("n", np.min_scalar_type(most).newbyteorder("<"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, np.zeros(RANGE, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= most, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([bits], pa.binary())], ["range", "bits"])

        for b in batches:
            for r, block in zip(b.column("range").to_pylist(), b.column("block"), strict=True):
                if r != of:
                    if of is not None:
                        yield done()
                    of, total[:] = r, 0
                rows = np.frombuffer(block.as_buffer(), kind)
                np.add.at(total, rows["place"], rows["n"])
        if of is not None:
            yield done()

    return run


def _likely(shards: DataFrame, bitmaps: list[np.ndarray], min_count: int) -> np.ndarray:
    """A bitmap of the places where the phrases of len(bitmaps) + 1 words of all shards together may reach min_count: all phrases that do, and few others.

    Most phrases of frequent words are rare. Their counts are summed by place, in a few bytes each, so that only likely phrases are shuffled as texts. With
    many more occurrences than 2^BITS * min_count nearly all phrases are likely; then they are shuffled as they are.
    """
    shared = shards.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, found in _phrases_of(batches, shared.value, len(shared.value) + 1):
            for ids, f in found:  # noqa: B007  only the last length is kept
                pass
            if len(f):
                yield _blocks(place(hashes, ids), f, min_count)

    blocks = shards.select(*COLUMNS[2:]).mapInArrow(run, "range int, block binary").repartition("range").sortWithinPartitions("range")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in blocks.mapInArrow(_often(min_count), "range int, bits binary").collect():
        out[r["range"] * RANGE // 8 :][: RANGE // 8] = np.frombuffer(r["bits"], np.uint8)
    shared.unpersist()
    return out


COLUMNS = ("lang", "words", "counts", "hashes", "before", "after")


def _phrases_of(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray], longest: int) -> Iterator[tuple[dict[str, pa.Scalar], np.ndarray, Iterator]]:
    """Columns, hashes of the words, and the phrases by length, of each shard. Language and words are not needed."""
    number = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(name)[i] for name in b.schema.names}
            hashes = number(row["hashes"], np.uint32).astype(np.uint64)
            kind = _kind(len(hashes))
            yield row, hashes, enumerate_phrases(row["counts"].values.to_numpy().astype(np.int64), number(row["before"], kind), number(row["after"], kind), hashes, bitmaps, longest)


def _summed(rows: list[pa.Table]) -> pa.Table:
    """(part, phrase, f) with one row for each phrase."""
    got = pa.concat_tables(rows).group_by(["part", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return got.select(["part", "phrase", "f_sum"]).rename_columns(["part", "phrase", "f"])


PACKED = "lang string, part int, phrases array<string>, counts array<long>"


def _packed_phrases(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The likely phrases of all lengths of a task's shards, a row (lang, part, phrases, counts) for each part of a language.

    A frequent phrase is found in nearly every shard, and a larger corpus has more of them: a row for each phrase and shard would be the product of the two.
    Shards of a language are summed first, and only then packed, so rows are as many as tasks; past HELD_PHRASES bytes what is held is sent. Slices of the
    parts are summed and sent one after the other, so that little is held besides.
    """
    held: dict[str, list[list[pa.Table]]] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for lang in [*held]:
            slices = held.pop(lang)
            while slices:
                if not (tables := slices.pop(0)):
                    continue
                rows = _summed(tables).sort_by([("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
                del tables
                part = rows["part"].to_numpy()
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ends = pa.array(np.r_[first, len(part)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("phrase", "f")]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(first)), pa.array(part[first]), *lists], ["lang", "part", "phrases", "counts"])

    for row, hashes, found in _phrases_of(batches, bitmaps, len(bitmaps)):
        lang, known = row["lang"].as_py(), row["words"].values
        for ids, f in found:
            for lo in range(0, len(f), 50_000):
                part = ids[lo : lo + 50_000]
                at = place(hashes, part) >> (BITS - PART_BITS)
                by = np.argsort(at, kind="stable")
                part, at = part[by], at[by]
                phrase = pc.binary_join_element_wise(*[known.take(pa.array(part[:, k] - 1)) for k in range(part.shape[1])], " ").cast(pa.string())
                rows = pa.table([pa.array(at), phrase, pa.array(f[lo : lo + len(part)][by], pa.int64())], ["part", "phrase", "f"])
                slices = held.setdefault(lang, [[] for _ in range(1 << SLICE_BITS)])
                cuts = np.searchsorted(at, np.arange((1 << SLICE_BITS) + 1) << (PART_BITS - SLICE_BITS))
                for tables, a, b in zip(slices, cuts[:-1], cuts[1:], strict=True):
                    if a < b:
                        tables.append(rows.slice(a, b - a))
                size += rows.nbytes
                del rows
                if size > HELD_PHRASES:
                    for tables in slices:
                        tables[:] = [_summed(tables)] if tables else []
                    size = sum(t.nbytes for x in held.values() for tables in x for t in tables)
                    if size > HELD_PHRASES // 2:
                        yield from send()
                        size = 0
    yield from send()


def _merged_phrases(min_count: int):
    """(lang, phrase, f) of the phrases found min_count times, from packed rows sorted by language and part, added up as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, most = None, [], 0, HELD_MERGED

        def done() -> Iterator[pa.RecordBatch]:
            rows = _summed(held)
            rows = rows.filter(pc.greater_equal(rows["f"], min_count))
            if len(rows):
                rows = rows.combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(of[0], pa.string()), len(rows)), rows["phrase"].combine_chunks(), rows["f"].combine_chunks()], ["lang", "phrase", "f"])

        for b in batches:
            for lang, part, phrases, counts in zip(b.column("lang").to_pylist(), b.column("part").to_pylist(), b.column("phrases"), b.column("counts"), strict=True):
                if (lang, part) != of:
                    if held:
                        yield from done()
                    of, held, size, most = (lang, part), [], 0, HELD_MERGED
                held.append(pa.table([pa.repeat(pa.scalar(part, pa.int32()), len(phrases)), phrases.values, counts.values], ["part", "phrase", "f"]))
                size += held[-1].nbytes
                if size > most:
                    held = [_summed(held)]
                    size = held[0].nbytes
                    most = max(most, 2 * size)
        if held:
            yield from done()

    return run


def phrase_counts(docs: DataFrame, tables: Tables, min_count: int = 100, max_words: int = 5, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, f) of the words, and of the phrases of 2 to max_words words, that occur min_count times, and (lang, n) with the number of all words.

    All occurrences within pieces count, overlaps included, over all documents. Each table is written; an index row holds one shard. Bitmaps of what is
    likely come length by length; one last pass gives the phrases of all lengths, whose counts are summed over the shards of a task and then over tasks, in packed rows.
    """
    spark = docs.sparkSession
    with small_batches(spark, BATCH):
        shards = tables.written(index(docs, lang_col, text_col, max_words, shard_bytes), "fm-index", **PAGES)
    total = tables.written(shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "words")
    single = shards.select("lang", F.explode(F.arrays_zip("words", "counts", "places")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.counts").cast("long").alias("f"), F.col("x.places").alias("place"))
    words = single.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("place").alias("place")).where(F.col("f") >= min_count)
    words = tables.written(words, "phrases")
    bitmaps = [_bitmap(words)]
    with small_batches(spark, BATCH):
        for _ in range(1, max_words):
            bitmaps = [*bitmaps, _likely(shards, bitmaps, min_count)]
        shared = spark.sparkContext.broadcast(bitmaps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed_phrases(batches, shared.value)

        rows = shards.select(*COLUMNS).mapInArrow(run, PACKED).repartition("lang", "part").sortWithinPartitions("lang", "part")
        longer = tables.written(rows.mapInArrow(_merged_phrases(min_count), "lang string, phrase string, f long"), "phrases")
    shared.unpersist()
    tables.drop(shards)
    return words.select("lang", "phrase", "f"), longer, total


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, inside: int = 100, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    A phrase of 2 to max_words words with a = f(phrase) >= min_count is scored by its weakest cut: floor(1000 * a * n / (f(first) * f(rest))), ties to the shortest first part, in decimals of 38 digits.
    Phrases inside a longer candidate with 100 * f(longer) >= inside * a are dropped; as f never grows with a phrase, the candidates longer by one word decide that.
    Order: score and a descending, phrase ascending by bytes; the first `top` of a language, or all for None. Null languages are `und`, null and empty texts have no words, repeated rows count as often as they occur; an empty table gives an empty one.
    """
    tables = Tables(docs.sparkSession)
    words, longer, total = phrase_counts(docs, tables, min_count, max_words, lang_col, text_col, shard_bytes)
    phrases = words.unionByName(longer)
    longer = longer.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda lo, many: F.array_join(F.slice("w", lo, many), " ")
    size = F.size("w")
    cuts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = tables.written(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest")), "cuts")
    known = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("over", (wide("a") * wide("n")).cast("decimal(37,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("CAST(over AS DECIMAL(38,0)) div CAST(under AS DECIMAL(38,0))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("x"))
    parts = longer.where(size > 2).select("lang", "a", F.explode(F.array_distinct(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1)))).alias("phrase"))
    around = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    out = tables.written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    tables.only(out)
    return out
