"""Spelling variants: words one edit apart, found by Gram matrices of letter counts between blocks of words.

A word is a vector of letter counts. An insertion changes one count by one, a replacement two, so words one edit apart
have a squared distance of at most two. Words lie in blocks by the counts of a few groups of letters, which add up to the
length; a block meets only itself and the blocks, of its own and the next length, that one edit can lead to. Each meeting
is cut into tiles of bounded size, whose squared distances come from one matrix product; the edits of what is near enough
are verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdlab.llm.common import Tables

#: Runs of Latin letters.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 6  #: groups of letters that blocks are made by
TILE = 1024  #: words of a tile, on average
COLUMNS = 96  #: letters are counted in so many columns; letters that share one only bring more pairs to verify
CELLS = 1 << 22  #: letters compared at once


def runs(text: str | Column) -> Column:
    """array<string>: the maximal runs of letters of a text, with A-Z lower-cased; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def word_counts(words: DataFrame, word_col: str = "word", min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of at least min_chars code points that occur min_count times, whatever other columns there are; nulls don't count."""
    word = F.col(word_col)
    return words.where(F.char_length(word) >= min_chars).groupBy(word.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _changes(groups: int) -> list[list[int]]:
    """What one edit may do to the counts of the groups, each pair of blocks from one side only."""
    unit = np.eye(groups, dtype=int)
    inside = [np.zeros(groups, dtype=int)]
    longer = [unit[i] for i in range(groups)]
    other = [unit[i] - unit[j] for i in range(groups) for j in range(i)]
    return [x.tolist() for x in inside + longer + other]


def near_words(words: DataFrame, tables: Tables, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """(word, n_near, near, near_n): how many words of (word, n) are one edit from each, and that of largest n (ties: smallest word).

    Only words with a near one are returned. words is read several times, so it should be a written table of distinct words. Blocks of any size are
    dealt to tiles by a hash, so that a task holds about tile words of either side at once; what a tile finds is summed before it is shuffled.
    """
    letters = F.transform(F.split("word", ""), lambda c: F.pmod(F.ascii(c), F.lit(groups)))
    of_group = lambda g: F.size(F.filter("letters", lambda x: x == g))
    counts = F.array(*map(of_group, range(groups)))
    keyed = words.select("word", "n", letters.alias("letters")).select("word", "n", F.array_join(counts.cast("array<string>"), ",").alias("block"))
    keyed = tables.written(keyed, "words")
    blocks = keyed.groupBy("block").agg(F.count("*").alias("size"))
    blocks = tables.written(blocks, "blocks")
    change = F.explode(F.array(*[F.array(*map(F.lit, x)) for x in _changes(groups)])).alias("change")
    to = F.zip_with(F.split("block", ",").cast("array<int>"), "change", lambda a, b: a + b)
    reach = blocks.select("block", "size", change).select("block", "size", to.alias("to")).where(F.array_min("to") >= 0)
    reach = reach.select(F.col("block").alias("origin"), F.col("size").alias("guests"), F.array_join(F.col("to").cast("array<string>"), ",").alias("block"))
    met = tables.written(reach.join(blocks, "block"), "met")
    tiles = met.groupBy("block").agg(F.ceil(F.max("size") / tile).cast("int").alias("rows"), F.ceil(F.sum("guests") / tile).cast("int").alias("cols"))
    tiles = tables.written(tiles, "tiles")
    of = lambda parts: F.pmod(F.xxhash64("word"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    home = keyed.join(tiles, "block").select("block", of("rows").alias("i"), every("cols").alias("j"), F.lit(0).alias("side"), "word", "n")
    routes = met.select("origin", "block").join(tiles, "block").groupBy("origin").agg(F.collect_list(F.struct(F.col("block").alias("to"), "rows", "cols")).alias("routes"))
    routes = tables.written(routes, "routes")  # a route for each change at most
    guest = keyed.join(routes, keyed["block"] == routes["origin"]).select("word", "n", "block", F.explode("routes").alias("r"))
    guest = guest.select(F.col("r.to").alias("to"), F.col("r.rows").alias("rows"), F.col("r.cols").alias("cols"), "word", "n", (F.when(F.col("r.to") == F.col("block"), 1).otherwise(2)).alias("side"))
    guest = guest.select(F.col("to").alias("block"), every("rows").alias("i"), of("cols").alias("j"), "side", "word", "n")
    rows = home.unionByName(guest).select(F.concat_ws("|", "block", "i", "j").alias("tile"), "side", "word", "n")
    rows = rows.repartition("tile").sortWithinPartitions("tile", "side")
    found = rows.mapInArrow(_tiles, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words within each tile; rows come sorted by tile, and a tile may go on in the next batch."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        names = held.column("tile").combine_chunks()
        last = len(names) - 1
        if names[0] == names[last]:  # one tile so far
            continue
        change = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
        yield from _near(held.slice(0, int(change[-1])), [0, *change.tolist()])
        held = held.slice(int(change[-1]))
    if held is not None:
        yield from _near(held, [0, held.num_rows])


def _near(rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    words = rows.column("word").combine_chunks()
    side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int32)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    column = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % (COLUMNS - 26))
    us, vs = [], []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        mid = lo + int(np.searchsorted(side[lo:hi], 1))
        if mid == lo or mid == hi:
            continue
        at, row = slice(start[lo], start[hi - 1] + size[hi - 1]), np.repeat(np.arange(hi - lo), size[lo:hi])
        x = np.bincount(row * COLUMNS + column[at], minlength=(hi - lo) * COLUMNS).reshape(-1, COLUMNS).astype(np.float32)
        square = (x * x).sum(1)
        for top in range(lo, mid, TILE):  # the matrix stays small whatever the hash has dealt
            h = slice(top - lo, min(mid, top + TILE) - lo)
            for left in range(mid, hi, 4 * TILE):
                g = slice(left - lo, min(hi, left + 4 * TILE) - lo)
                distance = square[h][:, None] + square[g][None, :] - 2 * (x[h] @ x[g].T)
                a, b = np.nonzero(distance <= 2)
                a, b = a + top, b + left
                once = (side[b] == 2) | (rank[a] < rank[b])  # pairs within a block come from both sides
                a, b = a[once], b[once]
                ok = one_edit(codes, start, size, a, b)
                us += [a[ok], b[ok]]
                vs += [b[ok], a[ok]]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    if not len(u):
        return
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    many = np.diff(np.r_[first, len(u)])
    yield pa.RecordBatch.from_arrays([words.take(pa.array(u[first])), pa.array(many, pa.int64()), words.take(pa.array(v[first])), pa.array(n[v[first]], pa.int64())], ["word", "n_near", "near", "near_n"])


def one_edit(codes: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a and b, given as runs of code points, differ by exactly one inserted, deleted or replaced one."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    swap = size[a] < size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)  # a is the longer
    wide = int(size[a].max())
    step = max(1, CELLS // (wide + 1))
    for lo in range(0, len(a), step):
        p, q = a[lo : lo + step], b[lo : lo + step]
        at = np.arange(wide + 1)
        long, short = (np.where(at < size[w][:, None], codes[np.minimum(start[w][:, None] + at, len(codes) - 1)], -1) for w in (p, q))
        differ = long != short
        first = differ.argmax(1)
        shifted = ((long[:, 1:] == short[:, :-1]) | (at[:-1] < first[:, None])).all(1)
        out[lo : lo + step] = np.where(size[p] == size[q], differ.sum(1) == 1, (size[p] == size[q] + 1) & shifted)
    return out


def roots(links: DataFrame, tables: Tables) -> DataFrame:
    """(word, root): where the links (word, form) lead to in the end; they must have no circle. Pointer jumping: each round doubles the way, and is a written table."""
    now = tables.written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = tables.written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        tables.drop(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after


def variants(words: DataFrame, ratio: int = 2, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words (word, n).

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least ratio (2 or more, so forms have no circle) times the
    word's own; root follows forms to the last. An empty table gives an empty one; null words have no variants and are left out; n must not be null.
    """
    tables = Tables(words.sparkSession)
    own = tables.written(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "counted")
    near = tables.written(near_words(own, tables, groups, tile), "near")
    links = own.join(near, "word").where(F.col("near_n") >= ratio * F.col("n")).select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    links = tables.written(links, "forms")
    ends = roots(links, tables)
    out = own.join(near.select("word", "n_near"), "word", "left").join(links, "word", "left").join(ends, "word", "left")
    out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    out = tables.written(out, "variants")
    tables.only(out)
    return out
