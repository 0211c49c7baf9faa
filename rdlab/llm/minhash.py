"""Near-duplicate documents by a chosen-path similarity join over MinHash signatures.

A document's path in a tree picks positions of its signature, the same ones for all documents of a node;
documents that agree there share the child. Small nodes are compared exhaustively, large ones branch on,
and independent trees repeat this to the target recall. Documents of a node whose signatures look similar, and those of a node
that stays large, become candidates: their connected groups hold every true link. Each group is then compared on the full sets, all
pairs of a small one. A large group is dealt to blocks, then its unlinked representatives. If it stays in pieces, all pairs of its blocks are
compared, or, in a very large group, its documents walk deeper trees.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdlab.llm.common import Tables, components, passing

WIDTH = 128  #: positions of a signature
START = 2  #: levels walked before nodes are counted
LEAF = 2048  #: documents of a node that one task compares
BLOCK = 256  #: documents of a group that are compared on full sets at once, at most LEAF
PAIRED = 32  #: blocks of a group up to which all pairs of them are compared; a set is shuffled as many times for that, while a document of deeper trees comes to 119 nodes
DEEP = 4  #: levels after which the documents of a large node are candidates as they are
DEPTH = 14  #: levels after which a large node of the deeper trees is compared in blocks
_RNG = np.random.default_rng(20)
_MUL = (_RNG.integers(1, 2**32, WIDTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, WIDTH, dtype=np.uint64).astype(np.uint32)[:, None]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of a word, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, words: _Words, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; a shorter text is one run, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _SPREAD + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        out = np.minimum(out, (low[None, i : i + 4096] * _MUL + _ADD).min(1))
    return out


def short(sig: np.ndarray) -> np.ndarray:
    """A byte for each position: equal where the positions are, and by chance in one of 256 others, which only adds candidates."""
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def branch(keys: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes `keys` for the documents with signatures sigs: (row, key). One position each, and in half of the nodes a second."""
    rows, out = [], []
    for turn in (0, 1):
        pick = _mix(keys + _TURNS[turn])
        at = np.arange(len(keys)) if not turn else np.flatnonzero(_mix(keys ^ _SPREAD) & np.uint64(1))
        pos = (pick[at] % np.uint64(WIDTH)).astype(np.int64)
        rows.append(at)
        out.append(_mix(pick[at] ^ (sigs[at, pos].astype(np.uint64) * _SPREAD + pos.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(out)


def lost(similarity: float, depth: int) -> float:
    """The chance that a pair of this similarity shares no node of `depth` levels in one tree (a branching process)."""
    s = 0.0
    for _ in range(depth):
        u = 1 - similarity + similarity * s
        s = (u + u * u) / 2
    return s


def _agreeing(similarity: float) -> list[float]:
    """The chance of each number of agreeing positions of a signature."""
    return [math.comb(WIDTH, k) * similarity**k * (1 - similarity) ** (WIDTH - k) for k in range(WIDTH + 1)]


def cut_for(loss: float, similarity: float) -> int:
    """The largest number of agreeing positions that a pair of this similarity stays below with a chance of at most `loss`."""
    below, k = 0.0, 0
    for p in _agreeing(similarity):
        below += p
        if below > loss:
            break
        k += 1
    return k


def missed(trees: int, similarity: float, depth: int) -> float:
    """The chance that a pair shares no node of `depth` levels in any tree. All trees read the same signature, so they are independent only given its agreeing positions."""
    return sum(p * lost(k / WIDTH, depth) ** trees for k, p in enumerate(_agreeing(similarity)))


def trees_for(loss: float, similarity: float, depth: int) -> int:
    """The least number of trees for a chance of at most `loss`."""
    high = 1
    while missed(high, similarity, depth) > loss:
        high *= 2
        if high > 1 << 20:
            raise ValueError(f"no number of trees finds pairs of similarity {similarity} so surely")
    return next(n for n in range(high // 2, high + 1) if n and missed(n, similarity, depth) <= loss)


def _started(sig: np.ndarray, first: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the trees first to trees - 1, after START levels, for the documents with signatures sig: (row, key)."""
    many = len(sig)
    rows, keys = np.tile(np.arange(many), trees - first), np.repeat(_mix(np.arange(first + 1, trees + 1, dtype=np.uint64)), many)
    for _ in range(START):
        r, keys = branch(keys, sig[rows])
        rows = rows[r]
    return rows, keys


def _sketch(trees: int, size: int):
    """(id, n, same, sig, keys) of each document: keys are its nodes after START levels of all trees, from whole positions, so that few unlike documents meet there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                sets, n, sigs = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, words, size)
                    n.append(len(s))
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s))
                sig, many = np.stack(sigs), len(n)
                rows, keys = _started(sig, 0, trees)
                order = np.argsort(rows, kind="stable")
                ends = np.searchsorted(rows[order], np.arange(many + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in short(sig)], pa.binary()), lists], ["id", "n", "same", "sig", "keys"])

    return run


def _read_sigs(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, WIDTH)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], read) -> Iterator[list]:
    """The rows of each key, as lists of read(batch)'s columns joined, from rows sorted by the keys; a group may begin in one batch and end in a later one."""
    held, of = [], None
    for b in batches:
        if not b.num_rows:
            continue
        names = [b.column(k).to_numpy() for k in keys]
        columns = read(b)
        cuts = np.flatnonzero(np.any([n[1:] != n[:-1] for n in names], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = tuple(n[lo] for n in names)
            if held and key != of:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            of = key
            held.append([c[lo:hi] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _reached(row, n: int) -> Iterator[list[int]]:
    """Connected groups of 0..n-1; row(i) is the boolean row of what i touches."""
    left = np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        group, todo = [start], [start]
        while todo:
            new = np.flatnonzero(row(todo.pop()) & left)
            left[new] = False
            group += new.tolist()
            todo += new.tolist()
        yield sorted(group)


def _similar(cut: int, keys: list[str]) -> Callable:
    """Of each node the groups of documents that chains of similar signatures connect, as sorted ids. Groups whose documents have one `root` already are left out."""

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column("id").to_numpy(), b.column("root").to_numpy(), _read_sigs(b)]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for ids, roots, sigs in _groups(batches, keys, read):
            if (roots == roots[0]).all():
                continue
            for group in _reached(lambda i, sigs=sigs: (sigs == sigs[i]).sum(1) >= cut, len(ids)):
                if (roots[group] != roots[group[0]]).any():
                    yield np.unique(ids[group])

    return groups


def _stars(cut: int):
    """(member, smallest id) of the groups of similar documents in each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for ids in _similar(cut, ["key"])(batches):
            out.update((x, int(ids[0])) for x in ids[1:].tolist())
            if len(out) > 20_000:
                yield _batch(out)
                out = set()
        if out:
            yield _batch(out)

    return run


def _clusters(cut: int):
    """The groups of similar documents in each block of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, ...]] = set()
        for ids in _similar(cut, ["key", "block"])(batches):
            out.add(tuple(ids.tolist()))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([*out], pa.list_(pa.int64()))], ["ids"])
                out = set()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([*out], pa.list_(pa.int64()))], ["ids"])

    return run


def _shared(sets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Sizes of all pairwise intersections, or those of `rows` with all: the product of the 0/1 matrix of shingles found in two sets or more with its transpose."""
    n, flat = len(sets), np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    kinds, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[at] > 1
    place = np.cumsum(times > 1) - 1
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out, width = np.zeros((n if rows is None else len(rows), n)), max(64, 4_000_000 // n)
    for lo in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += (m if rows is None else m[rows]) @ m.T
    return out


def _links(percent: int):
    """Links (member, smallest id) of the groups that confirmed pairs connect within each block of a cluster. A document with several texts comes as several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(b: pa.RecordBatch) -> list[np.ndarray]:
            sets = np.empty(b.num_rows, object)
            sets[:] = [np.frombuffer(x, np.uint64) for x in b.column("found").to_pylist()]
            return [b.column("id").to_numpy(), sets]

        out: set[tuple[int, int]] = set()
        for ids, sets in _groups(batches, ["cluster", "block"], read):
            once = [*{(i, x.tobytes()): k for k, (i, x) in enumerate(zip(ids.tolist(), sets, strict=True))}.values()]
            ids, sets = ids[once], sets[once]
            size = np.array([len(x) for x in sets])
            both = _shared(list(sets))
            linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) | (ids[:, None] == ids[None, :])
            for group in _reached(lambda i, linked=linked: linked[i], len(ids)):
                lowest = int(ids[group].min())
                out.update((int(x), lowest) for x in ids[group] if x != lowest)
            if len(out) > 20_000:
                yield _batch(out)
                out = set()
        if out:
            yield _batch(out)

    return run


def _joins(percent: int):
    """Links (root, smallest root) of the roots that confirmed pairs connect within each block of a cluster. Documents of the most frequent root aren't compared with each other: they are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(b: pa.RecordBatch) -> list[np.ndarray]:
            sets = np.empty(b.num_rows, object)
            sets[:] = [np.frombuffer(x, np.uint64) for x in b.column("found").to_pylist()]
            return [b.column("root").to_numpy(), sets]

        out: set[tuple[int, int]] = set()
        for roots, sets in _groups(batches, ["cluster", "block"], read):
            names, at, many = np.unique(roots, return_inverse=True, return_counts=True)
            rows = np.flatnonzero(at != many.argmax())
            if not len(rows):
                continue
            size = np.array([len(x) for x in sets])
            both = _shared(list(sets), rows)
            i, j = np.nonzero(100 * both >= percent * (size[rows][:, None] + size[None, :] - both))
            touch = np.zeros((len(names), len(names)), bool)
            touch[at[rows[i]], at[j]] = touch[at[j], at[rows[i]]] = True
            for group in _reached(lambda k, touch=touch: touch[k], len(names)):
                out.update((int(names[k]), int(names[group[0]])) for k in group[1:])
            if len(out) > 20_000:
                yield _batch(out)
                out = set()
        if out:
            yield _batch(out)

    return run


def _batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingles(t, words, size).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["id", "found"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, found), in which those of an id follow each other, without repeats: an id that many equal rows have is one set."""
    of, seen = None, set()
    for b in batches:
        keep = []
        for k, (i, x) in enumerate(zip(b.column("id").to_pylist(), b.column("found"), strict=True)):
            if i != of:
                of, seen = i, set()
            digest = xxhash.xxh3_128_digest(x.as_buffer())
            if digest not in seen:
                seen.add(digest)
                keep.append(k)
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


def _more(first: int, trees: int):
    """(key, id) of the nodes after START levels in the trees first to trees - 1, for documents that deeper nodes must tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows, keys = _started(_read_sigs(part), first, trees)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part.column("id").to_numpy()[rows])], ["key", "id"])

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            rows, keys = branch(b.column("key").to_numpy().view(np.uint64), _read_sigs(b))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(b.column("id").to_numpy()[rows])], ["key", "id"])


def _walk(tables: Tables, sigs: DataFrame, active: DataFrame, last: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (key, id, m) of the nodes of several documents: in levels from START on, and the rows of nodes still large after `last` levels, if there are any."""
    levels: list[DataFrame] = []
    for depth in range(START, last + 1):
        counts = active.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        node = tables.written(active.join(counts, "key").select("key", "id", "m"), "nodes")
        levels.append(node)
        large = node.where(F.col("m") > LEAF)
        if large.isEmpty():
            return levels, None
        active = large.join(sigs.select("id", "sig"), "id").select("key", "id", "sig").mapInArrow(_children, "key long, id long")
    return levels, large


def _small(levels: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, [x.where(F.col("m") <= LEAF).select("key", "id") for x in levels])


def _confirmed(tables: Tables, items: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links within each (cluster, block) of items (cluster, block, id) on the full sets."""
    sets = items.join(found, "id").select("cluster", "block", "id", "found").repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    return tables.written(sets.mapInArrow(_links(percent), "a long, b long").distinct(), "links")


def _dealt(items: DataFrame) -> DataFrame:
    """items (cluster, id, m), m the size of the cluster, with blocks of about BLOCK documents."""
    most = min(BLOCK, LEAF)
    return items.withColumn("block", F.when(F.col("m") > most, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / most))).otherwise(F.lit(0)).cast("long"))


def _between(tables: Tables, rooted: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between the roots of rooted (cluster, id, root, size), size the number of documents of the cluster: each pair of blocks of a cluster is compared on the full sets."""
    spread = rooted.withColumn("blocks", F.ceil(F.col("size") / min(BLOCK, LEAF))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = spread.select("cluster", "id", "root", "blocks", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    items = spread.select("cluster", (F.greatest("own", "other") * F.col("blocks") + F.least("own", "other")).alias("block"), "id", "root")
    sets = items.join(found, "id").select("cluster", "block", "root", "found").repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    return tables.written(sets.mapInArrow(_joins(percent), "a long, b long").distinct(), "links")


def _rooted(tables: Tables, members: DataFrame, links: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The components of the links so far, and members (cluster, id, size) with root, the smallest id reached from it, and m, the number of roots of the cluster."""
    groups = tables.written(components(functools.reduce(DataFrame.union, links)), "groups")
    rooted = tables.written(members.join(groups, members["id"] == groups["node"], "left").select("cluster", "id", "size", F.coalesce("component", "id").alias("root")), "rooted")
    m = rooted.where("id = root").groupBy("cluster").agg(F.count("*").alias("m"))
    return groups, rooted.join(m, "cluster")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, recall: float = 0.99999) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of df.

    A set holds the distinct runs of `size` words (A-Z lower-cased, split at ASCII white space); a shorter text
    is one run; a text without words, or null, has the empty set and links with nothing. Documents link where
    100 * intersection >= percent * union. component_id is the smallest id reachable over links, kept tells
    whether it is the row's own. Rows that repeat an id are one document, linked by any of its texts. A row
    with a null id links with nothing, has a null component and stays. An empty table gives no rows; other columns of df are not read. Links are exact; of true links each is
    examined with a chance of at least `recall` by itself. A tenth of what may be lost goes to the cut of similar
    signatures, four tenths to the trees of pairs whose nodes are small by DEEP levels, and half to those of
    documents that deeper nodes must tell apart: they are walked through more trees, enough at DEPTH levels.
    """
    tables = Tables(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    loss = 1 - recall
    cut = cut_for(0.1 * loss, percent / 100)
    few, many = trees_for(0.4 * loss, percent / 100, DEEP), trees_for(0.5 * loss, percent / 100, DEPTH)
    sketch = tables.written(docs.mapInArrow(_sketch(few, size), "id long, n long, same binary, sig binary, keys array<long>"), "sketch")
    valid = sketch.where("id is not null and n > 0")
    classes = tables.written(valid.groupBy("same").agg(F.min("id").alias("rep")), "classes")
    reps = valid.join(classes, (valid["same"] == classes["same"]) & (valid["id"] == classes["rep"]), "left_semi").dropDuplicates(["id", "same"])
    sigs = tables.written(reps.select("id", "sig", "keys"), "sigs")

    # candidates: members (cluster, id, m) of connected groups
    levels, large = _walk(tables, sigs, sigs.select(F.explode("keys").alias("key"), "id"), DEEP)
    nodes = _small(levels).join(sigs.select("id", "sig"), "id").select("key", "id", F.col("id").alias("root"), "sig").repartition("key").sortWithinPartitions("key")
    stars = nodes.mapInArrow(_stars(cut), "a long, b long")
    if large is not None:
        lowest = large.groupBy("key").agg(F.min("id").alias("b"))
        stars = stars.union(large.join(lowest, "key").select(F.col("id").alias("a"), "b").where("a <> b"))
    stars = tables.written(stars.distinct(), "stars")
    tables.drop(*levels)
    groups = tables.written(components(stars), "candidates")
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"))
    members = tables.written(groups.join(sizes, "component").select(F.col("component").alias("cluster"), F.col("node").alias("id"), "m"), "members")
    tables.drop(stars, groups)

    # the same plan at every size: the number of candidates has no bound, so neither side of the exact join is broadcast
    ids = members.select("id")
    near = passing(docs, "id", ids).mapInArrow(_sets(size), "id long, found binary").where("octet_length(found) > 0")
    found = near.hint("merge").join(ids, "id", "left_semi").select("id", "found")  # comes sorted by id
    found = tables.written(found.mapInArrow(_once, "id long, found binary"), "found")
    links, groups = [_confirmed(tables, _dealt(members), found, percent)], None
    big = members.where(F.col("m") > min(BLOCK, LEAF))
    if not big.isEmpty():
        big, before = big.select("cluster", "id", F.col("m").alias("size")), None
        while True:  # rounds over the roots of large groups, as long as these get far fewer
            groups, rooted = _rooted(tables, big, links)
            left = rooted.where("m > 1")
            most, n = left.where("id = root").agg(F.max("m"), F.count("*")).first()
            if not n or before is not None and (2 * n > before[1] or before[0] <= min(BLOCK, LEAF)):
                break
            before = most, n
            links.append(_confirmed(tables, _dealt(left.where("id = root").select("cluster", "id", "m")), found, percent))
        if n or large is not None:
            # groups with several roots: all pairs of their blocks; documents of very large ones walk more and deeper trees
            paired = F.col("size") <= PAIRED * min(BLOCK, LEAF)
            links, groups = [*links, _between(tables, left.where(paired), found, percent)], None
            again = left.where(~paired).select("id", "root").join(sigs.select("id", "sig"), "id")
            more = _deeper(tables, again, found, max(few, many), cut, percent)
            if more is not None:
                links = [*links, more]
    if groups is None:
        groups = tables.written(components(functools.reduce(DataFrame.union, links)), "groups")
    tables.only(sketch, classes, groups)

    known = classes.join(groups, classes["rep"] == groups["node"], "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    rows = sketch.select("id", "n", "same").join(known, "same", "left")
    lowest = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), lowest.alias("component_id"), F.coalesce(F.col("id") == lowest, F.lit(True)).alias("kept"))


def _deeper(tables: Tables, docs: DataFrame, found: DataFrame, trees: int, cut: int, percent: int) -> DataFrame | None:
    """Links of docs (id, root, sig) found in trees of up to DEPTH levels, None without a document; a node that no position splits further gives every pair of its blocks."""
    begin = _more(0, trees)
    docs = tables.written(docs, "again")
    if docs.isEmpty():
        return None
    levels, large = _walk(tables, docs, docs.mapInArrow(begin, "key long, id long"), DEPTH)
    done = _small(levels).select("key", F.lit(0).cast("long").alias("block"), "id")
    if large is not None:
        spread = large.withColumn("blocks", F.ceil(F.col("m") * 2 / LEAF)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
        spread = spread.select("key", "id", "blocks", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        done = done.union(spread.select("key", (F.greatest("own", "other") * F.col("blocks") + F.least("own", "other")).alias("block"), "id"))
    nodes = done.join(docs, "id").repartition("key", "block").sortWithinPartitions("key", "block")
    clusters = tables.written(nodes.select("key", "block", "id", "root", "sig").mapInArrow(_clusters(cut), "ids array<long>").distinct(), "clusters")
    tables.drop(docs, *levels)
    items = clusters.select(F.xxhash64("ids").alias("cluster"), F.lit(0).cast("long").alias("block"), F.explode("ids").alias("id"))
    links = _confirmed(tables, items, found, percent)
    tables.drop(clusters)
    return links
