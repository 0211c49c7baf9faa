"""Edge cases of the training-data operators: empty tables, clashing columns, very long texts, repeated rows, odd numbers, damage; and brute force."""

import base64
import gzip
import hashlib
import os
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rdlab.llm import ann, common, langid, line_dedup, minhash, packing, simhash, toxicity, urlfilter, warc

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
EXTRA = ("id", "row", "key", "out", "drop", "batch", "sig", "digest", "shard", "fp", "bucket", "host_")


def table(spark, rows, schema, extra=EXTRA):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(f"x{c}") for c in extra if c not in df.columns})


# --- empty tables and clashing columns


def test_empty_tables_give_empty_results(spark):
    docs = table(spark, [], "doc_id long, text string, source string, lang string")
    assert line_dedup.line_dedup(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert simhash.fingerprint_documents(docs).count() == 0
    assert packing.best_fit_packing(docs.select("*", *packing.sizes(docs))).count() == 0
    vectors = table(spark, [], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0
    pages = table(spark, [], "page_id long, url string, html string")
    assert urlfilter.judge_urls(pages, spark.createDataFrame([("a", "/", "block")], "host string, path string, action string")).count() == 0
    path = common.new_path(spark, "warc")
    warc.write_warc(pages.withColumn("payload", F.col("html").cast("binary")), path)
    assert warc.read_warc(spark, path).count() == 0
    model = spark.sparkContext.broadcast(toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert spark.createDataFrame([("any text",), (None,)], "text string").where(toxicity.score("text", model) >= 0.5).count() == 0


def test_own_columns_survive_clashing_names(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", None), (None, None, "s")]
    docs = table(spark, rows, "doc_id long, text string, source string")
    out = line_dedup.line_dedup(docs, min_docs=3)
    assert {r["digest"] for r in out.collect()} == {"xdigest"} and {r["n_dropped"] for r in out.collect()} == {0, 1}
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash.near_duplicates(docs).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert simhash.fingerprint_documents(docs).count() == 4
    assert packing.best_fit_packing(docs.select("*", *packing.sizes(docs))).count() == 4
    pages = table(spark, [(1, "http://a/", b"p"), (2, "http://b/", b"p"), (2, "http://b/", b"p")], "page_id long, url string, payload binary")
    kinds = warc.with_revisits(pages, "page_id", "payload").orderBy("page_id").collect()
    assert [(r["record_type"], r["refers_to"]) for r in kinds] == [("revisit", 2), ("response", None), ("response", None)] and kinds[0]["key"] == "xkey"
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, action string")
    judged = urlfilter.judge_urls(pages.withColumn("html", F.lit(None).cast("string")), rules).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in judged) == [(1, "block"), (2, "allow"), (2, "allow")]
    vectors = table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()] == [1, 1]


def test_very_long_texts_are_read_whole(spark):
    rng = random.Random(1)
    words = [f"w{rng.getrandbits(30)}" for _ in range(60_000)]
    long, line = " ".join(words), "z" * 200_000
    rows = [(1, long), (2, long[:-1] + "!"), (3, line), (4, line + "\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert got[1]["n_shingles"] == 59_996 and got[2]["component_id"] == 1 and got[4]["component_id"] == 4
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs, min_docs=2).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}
    fps = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs).collect()}
    assert fps[1]["n_chars"] == len(long)
    own = docs.withColumn("lang", F.lit("aa"))
    crf = spark.sparkContext.broadcast(langid.train(own, per_label=10))
    assert {r["x"]["lang"] for r in docs.select(langid.detect_document("text", crf).alias("x")).collect()} == {"aa"}


def test_only_ids_that_may_be_wanted_pass(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k").withColumn("__bits_", F.lit(1))
    kept = {r["k"] for r in common.passing(rows, "k", rows.where("k % 100 = 0").select("k")).collect()}
    assert {k for k in range(0, 2000, 100)} <= kept and len(kept) < 60
    assert common.passing(rows, "k", rows.where("k < 0").select("k")).count() == 0
    assert common.passing(rows, "k", rows.select("k"), bits=4).count() == 2000


# --- nearest neighbours


def nearest(spark, vectors, queries, k, **how):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest(df, df.where(F.col("vec_id").isin(queries)), k, **how).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def brute(vectors, q, k):
    score = {i: float(np.add.accumulate(np.array(v, float) * np.array(vectors[q], float))[-1]) for i, v in vectors.items() if i != q}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


def test_outlier_norms_and_tiny_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    vectors = dict(enumerate(rng.normal(size=(400, 6))))
    vectors |= {1000: np.array([1e17] + [0.0] * 5), 1001: rng.normal(size=6) * 1e-200, 1002: rng.normal(size=6) * 1e-9, 1003: np.array([1e200, 1, 0, 0, 0, 0])}
    ask = [0, 7, 1000, 1001, 1002]
    for shard_rows in (64, 8192):
        got = nearest(spark, vectors, ask, 20, shard_rows=shard_rows)
        assert got == {q: brute(vectors, q, 20) for q in ask}


def test_many_equal_scores_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(4)
    vectors = {900: np.array([1.0, 0.0, 0.0, 0.0])}
    for i in range(300):
        angle = rng.uniform(0, 6.283)
        vectors[299 - i] = np.array([0.5, np.cos(angle), np.sin(angle), 0.0])  # 300 distinct vectors with one score and nearly one norm
    assert nearest(spark, vectors, [900], 20) == {900: list(range(20))}


# --- toxicity


def chars():
    return toxicity.CharModel({x[i : i + 3]: 50 for w in ("you", "idiot", "scum", "ass", "are", "an", "a", "what") for x in [f"^^{w}$"] for i in range(len(x) - 2)})


@pytest.mark.parametrize(("seen", "meant"), [("$cum", "scum"), ("a$$", "ass"), ("!diot", "idiot"), ("scum!", "scum"), ("(you)", "you"), ("a/\\/\\ss", None), ("/\\ss", "ass"), ("vvhat", "what"), ("1d10t", "idiot"), ("idioooot", "idiot")])
def test_signs_at_edges_are_decided_by_the_lattice(seen, meant):
    token = toxicity.stripped(seen)
    got = toxicity.restore(token, chars()) if toxicity.suspicious(token) else token
    assert meant is None or got == meant


@pytest.mark.parametrize(("seen", "meant"), [("i   d   i   o   t", "idiot"), ("y o u a r e a n i d i o t", "you are an idiot"), ("y o u   a r e   s c u m", "you are scum"), ("$ c u m", "scum"), ("i\td\ni\to\tt", "idiot")])
def test_spaces_are_decided_by_the_lattice(seen, meant):
    assert toxicity.unspaced(toxicity.SPACED.search(seen).group(), chars()) == meant
    assert any(w in {t for x in toxicity.Reader(chars()).terms(r) for t in x} for r in toxicity.words_of(seen) if len(r) > 4 for w in meant.split())


def test_numbers_in_a_row_are_no_words():
    assert toxicity.words_of("1 2 3 4 5 6") == {"1", "2", "3", "4", "5", "6"}


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_toxicity_on_held_out_documents(spark):
    from rdlab.llm import queries

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op4_toxicity(spark, SF).where("held_out").join(labels.dropna(), "doc_id").select("toxic", "predicted").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    flagged = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(rows) >= 50 and sum(caught) >= 0.6 * len(caught) and sum(flagged) <= 0.02 * len(flagged)


# --- packing


def linear_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(room, i) for i, (room, s, c) in enumerate(bins) if room >= length and not s & source and not c & cluster and room]
        if fits:
            _, i = min(fits)
        else:
            bins.append((capacity, 0, 0))
            i = len(bins) - 1
        room, s, c = bins[i]
        out.append((i, capacity - room))
        bins[i] = (room - length, s | source, c | cluster)
    return out


def test_packing_equals_a_linear_scan():
    rng = random.Random(5)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 60), 1 << rng.randrange(5) if rng.random() < 0.8 else 0, 1 << rng.randrange(8) if rng.random() < 0.5 else 0) for _ in range(120)), key=lambda p: -p[0])
        assert packing.pack(pieces, 100) == linear_best_fit(pieces, 100)


# --- archives


def record(body, kind=b"resource"):
    d = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, d, len(body), body)


def test_whole_file_gzip_and_damaged_members():
    whole = gzip.compress(record(b"a") + record(b"b") + record(b"c"))
    assert [x[4] for x in warc.salvage(whole)] == [b"a", b"b", b"c"]
    members = [gzip.compress(record(bytes([65 + i]) * 300)) for i in range(5)]
    hurt = bytearray(members[2])
    hurt[len(hurt) // 2] ^= 0xFF
    got = list(warc.salvage(members[0] + members[1] + bytes(hurt) + members[3] + members[4]))
    assert [x[4][:1] for x in got if x[2] == "record"] == [b"A", b"B", b"D", b"E"] and [x[1] for x in got if x[2] == "gap"] == [len(hurt)]
    assert [x[4] for x in warc.salvage(gzip.compress(record(b"end")[:-4]))] == [b"end"]
    assert list(warc.salvage(b"")) == []
    assert [x[2] for x in warc.salvage(gzip.compress(b""))] == ["gap"] and [x[2] for x in warc.salvage(b"no archive at all")] == ["gap"]


def test_many_members_take_linear_time():
    one = gzip.compress(record(os.urandom(200)))
    assert sum(x[2] == "record" for x in warc.salvage(one * 20_000)) == 20_000


def test_records_of_all_sizes_come_back(spark):
    rows = [(1, "http://a/", b"same"), (2, "http://b/" + "u" * 70_000, b"same"), (None, "u", b"same"), (4, "x", b"\xc3\xa9" * 200_000), (5, "y", b"z" * (17 << 20)), (6, None, b"z" * (17 << 20)), (7, "q", None)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, payload binary"), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == 7 and {r["kind"] for r in got} == {"record"}
    kinds = {r["headers"].get("warc-record-id"): (r["headers"]["warc-type"], r["headers"].get("warc-refers-to"), len(r["payload"] or b"")) for r in got}
    assert kinds["<urn:page:1>"] == ("revisit", "<urn:page:2>", 0) and kinds["<urn:page:5>"] == ("revisit", "<urn:page:6>", 0)
    assert kinds["<urn:page:6>"][2] == 17 << 20 and kinds["<urn:page:4>"][2] == 400_000 and kinds[None][0] == "response"


# --- near duplicates


def components_of(texts):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in enumerate(texts) if (w := t.lower().split())}
    up = {i: i for i in range(len(texts))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in up}


@pytest.mark.parametrize("changes", [1, 3])
def test_large_groups_equal_brute_force(spark, monkeypatch, changes):
    """Groups far beyond a block: with 3 changes most pairs are similar but few link, so groups stay in pieces and walk deeper trees."""
    monkeypatch.setattr(minhash, "LEAF", 8)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "DEPTH", 6)
    rng = random.Random(changes)
    texts = []
    for _ in range(2):
        base = [f"w{rng.getrandbits(40)}" for _ in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = f"x{rng.getrandbits(40)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == components_of(texts)


def test_recall_by_similarity(spark):
    """Pairs of similarity 0.75, 0.77, 0.82: none of 600 is lost, and none of 200 below 0.75 links."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.getrandbits(50)}" for _ in range(n)]
    rows, want = [], {}
    for shared, links in ((64, True), (65, True), (67, True), (63, False)):
        for _ in range(200):
            a = fresh(74)
            b = a[:shared] + fresh(74 - shared)
            i = len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            want |= {i: i, i + 1: i if links else i + 1}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


# --- fingerprints


def own_fingerprint(text):
    words = [w for w in text.lower().split() if w]
    votes, n = [0] * 64, 0
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        n += 1
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > n)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    texts = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))) for i in range(0, 400, 7)}
    texts |= {500: None, 501: "", 502: texts[7], 503: "Ünï " * 30}
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    fps = {i: own_fingerprint(texts[i] or "") for i in texts}
    for at, i in enumerate(order):
        text, after = texts[i] or "", order[(at + 1) % len(order)]
        cut = len(text) // 3
        edit = text[: len(text) - cut] + (texts[after] or "")[:cut]
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest(), f"{fps[i]:016x}", f"{own_fingerprint(edit):016x}")
        assert (r["near_edited"], r["near_next"]) == (like(fps[i], own_fingerprint(edit)), like(fps[i], fps[after]))
        assert r["n_near"] == sum((fps[i] ^ fps[j]).bit_count() <= 3 for j in fps if j != i)


def test_more_fingerprints_get_longer_keys(spark):
    assert [simhash.blocks_for(n) for n in (0, 1000, 10**8, 10**9, 10**10)] == [5, 5, 5, 6, 6]
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps]
    df = spark.createDataFrame([(f,) for f in [*fps, fps[0], None]], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for blocks in (4, 5, 7):
        assert {(r["a"], r["b"]) for r in simhash.near_fingerprints(df, blocks=blocks).collect()} == want


# --- language ID


def test_model_without_labels_says_und(spark):
    crf = spark.sparkContext.broadcast(langid.train(spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")))
    rows = spark.createDataFrame([("any words",), (None,)], "text string").select(langid.detect("text", crf).alias("x"), langid.detect_document("text", crf).alias("y")).collect()
    assert {(r["x"]["lang"], r["y"]["lang"], r["x"]["score"], r["y"]["score"]) for r in rows} == {("und", "und", 0.0, 0.0)}


def test_long_lines_are_learned_from_and_word_lists_are_features(spark):
    rng = random.Random(2)
    kinds = {"aa": ["ba", "lo", "mi"], "bb": ["zur", "kek", "xon"]}
    word = lambda k: "".join(rng.choices(kinds[k], k=3))
    rows = [(i, " ".join(word(k) for _ in range(5000)), k) for i in range(6) for k in kinds]
    assert all(len(r[1]) > 20_000 for r in rows)
    crf = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=2)
    assert crf.lexicon and all(x in ([0], [1]) for x in crf.lexicon.values())
    known = next(iter(crf.lexicon))
    assert crf.features(known)[-1] - langid.BUCKETS == crf.lexicon[known][0] and crf.features("q")[-1] == langid.BUCKETS + 2
    model = spark.sparkContext.broadcast(crf)
    seen = spark.createDataFrame([(word("aa") + " " + word("aa"),), (word("bb") + " " + word("bb"),)], "text string")
    assert [r["x"]["lang"] for r in seen.select(langid.detect("text", model).alias("x")).collect()] == ["aa", "bb"]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_language_on_held_out_documents(spark):
    from rdlab.llm import queries

    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, SF).where("held_out").join(langs.dropna(), "doc_id").where("lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) >= 50 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_cells_are_skipped_and_nothing_is_lost(spark):
    """Clusters far apart: with factor 1 the result is that of brute force, though queries skip most cells."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(8, 12)) * 3
    vectors = {i: centers[i % 8] + rng.normal(size=12) * 0.05 for i in range(800)}
    vectors |= {1000 + i: vectors[0] for i in range(30)}  # copies
    ask = [0, 5, 100, 1000]
    assert nearest(spark, vectors, ask, 20, shard_rows=50) == {q: brute(vectors, q, 20) for q in ask}
    x = np.array([vectors[i] for i in sorted(vectors)])
    bands = np.floor(np.log2(np.linalg.norm(x, axis=1))).astype(int)
    cells = ann.Cells(bands[:8], x[:8])
    cell, far = cells.place(x, bands)
    for c in range(8):
        if (cell == c).any():
            cells.low[c], cells.high[c] = far[cell == c].min(), far[cell == c].max()
    _, most = cells.bounds(x, 1.0)
    products = x @ x.T / np.linalg.norm(x, axis=1)[:, None]
    for c in range(8):
        if (cell == c).any():
            assert (products[:, cell == c].max(1) <= most[:, c] + 1e-9).all()
    kth = np.sort(products, axis=1)[:, -20]
    assert (most < kth[:, None]).mean() > 0.3


def test_a_byte_outside_the_vocabulary_is_an_error():
    from rdlab.llm import bpe

    small = bpe.Bpe([b"a", b"b", b"ab"], r"\S+|\s+")
    assert small.piece("ab") == [2] and small.piece("aba") == [2, 0]
    with pytest.raises(ValueError, match="vocabulary"):
        small.piece("abc")
