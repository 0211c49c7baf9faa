"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from rdlab.llm import ann, bpe, common, langid, line_dedup, minhash, packing, simhash, toxicity, urlfilter, warc  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a", "Hello  world\n\n x's 12345 !!", "ünï çödé 漢字 \U0001f600", "\x1c\x85　a", "z" * 3000, "<|endoftext|>", "a\tb\r\n" * 200]
DOCS = "doc_id long, text string, source string"


def test_bpe_equals_the_library(spark):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model = bpe.load(spark, PATH, public_tokenizers.PATTERN)
    rows = bpe.encode_documents(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        assert r["ids"] == known.encode_ordinary(t or "")
        assert bytes(r["decoded"]) == (t or "").encode()


def test_bpe_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), bpe.load(spark, PATH, public_tokenizers.PATTERN)).count() == 0


def test_line_dedup_counts_over_batches(spark):
    rows = [(i, f"Header \nown {i}\n\n") for i in range(12)] + [(None, "header"), (3, None), (3, None)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("drop", F.lit(1)), min_docs=10).collect()
    assert len(out) == 15 and out[0]["drop"] == 1
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out}
    assert got == {(i, f"own {i}\n\n", 4, 1) for i in range(12)} | {(None, "", 1, 1), (3, "", 1, 0)}


def test_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, settled=3, fanout=2)
    for _ in range(4):
        runs.add(spark.createDataFrame([(b"x",), (b"y",)], "key binary").union(spark.createDataFrame([(b"z",)], "key binary").where(F.lit(len(runs.paths) == 0))))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {bytes(r["key"]) for r in runs.found_in(3).collect()} == {b"x", b"y"}


@pytest.mark.parametrize("shard_rows", [64, 1000])
def test_nearest_is_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 5, shard_rows=shard_rows).collect()}
    for q in range(0, 300, 20):
        score = np.add.accumulate(x * x[q], axis=1)[:, -1]
        best = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        assert [got[q, r] for r in range(1, 6)] == best


def test_toxicity_restores_and_scores(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "en"]) for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" idiot scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = spark.sparkContext.broadcast(toxicity.train(df, df))
    seen = spark.createDataFrame([(0, "you 1d10t and 5cum"), (1, "i d i o t s c u m"), (2, " ".join(words[:20])), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in seen.select("doc_id", toxicity.score("text", model).alias("s")).collect()}
    assert got[0] > 0.5 > got[2] and got[3] == got[4] < 0.5
    assert "idiot" in seen.where("doc_id = 0").select(toxicity.restored("text", model).alias("t")).first()["t"]


def test_toxicity_reads_long_tokens_whole(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "en"]) for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" idiot scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = spark.sparkContext.broadcast(toxicity.train(df, df))
    fine, bad = words[:12], [*words[:6], "idiot", "scum", *words[6:12]]
    texts = [" ".join("".join(fine)), " ".join("".join(bad)), ".".join(fine), ".".join(bad), "".join(fine), "".join(bad), ".".join([*fine * 40, "1d10t", "5cum"])]
    assert all(len(t) > 64 for t in texts)
    seen = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in seen.select("doc_id", toxicity.score("text", model).alias("s")).collect()}
    assert all(got[i] > 0.5 for i in (1, 3, 5)) and all(got[i] < 0.5 for i in (0, 2, 4))
    assert got[6] > got[2]


def test_toxicity_keeps_terms_with_support_and_all_trigrams(spark):
    rows = [(i, "fine words" + (" idiot scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {"idiot", "scum", "#diot"} <= toxicity.train(df, df).odds.keys()
    rng = random.Random(7)
    words = {"".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(3)) for _ in range(90_000)}
    want = {x[i : i + 3] for w in words for x in [f"^^{w}$"] for i in range(4)}
    assert len(want) > 200_000
    assert toxicity.char_counts(spark.createDataFrame([(" ".join(words),)], "text string")).keys() == want


def test_restored_run_of_letters_is_split():
    chars = toxicity.CharModel({x[i : i + 3]: 50 for w in ("you", "idiot") for x in [f"^^{w}$"] for i in range(len(x) - 2)})
    assert toxicity.split("youidiotyou", chars) == ["you", "idiot", "you"]
    assert toxicity.restore("y.0.u." * 20_000 + "1d1ot", chars) == "you" * 20_000 + "idiot"


def test_packing_respects_capacity_and_conflicts(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 250), f"s{i % 7}" if i % 5 else None, f"c{i % 40}") for i in range(400)] + [(None, 10, "s1", None), (None, 10, "s1", None)]
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, length int, source string, cluster string"), capacity=100, shard_rows=100).collect()
    assert sum(r["length"] for r in out) == sum(r[1] for r in rows)
    of, bins = {r[0]: r for r in rows}, {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        assert sum(r["length"] for r in members) <= 100
        for i in (2, 3):
            seen = [of[r["doc_id"]][i] for r in members if of[r["doc_id"]][i] is not None]
            assert len(seen) == len(set(seen))


def test_best_fit_takes_the_tightest_bin():
    assert packing.pack([(60, 1, 0), (50, 2, 0), (40, 1, 0), (40, 4, 0)], 100) == [(0, 0), (1, 0), (1, 50), (0, 60)]


def test_warc_round_trip_and_salvage(spark):
    rows = [(1, "http://a/", b"same"), (2, "http://b/", b"same"), (3, None, None), (4, "http://c/", b"x\r\n\r\nWARC/1.1\r\n")]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, payload binary"), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["kind"], r["headers"]["warc-type"]) for r in got) == [("record", "response")] * 3 + [("record", "revisit")]
    assert {bytes(r["payload"]) for r in got} == {b"same", b"", b"x\r\n\r\nWARC/1.1\r\n"}


def test_salvage_finds_later_records_and_gaps():
    def record(body):
        d = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (d.encode(), len(body), body)

    bad = record(b"hello").replace(b"hello", b"hellO")
    data = record(b"one") + bad + record(b"two") + b"junk" + gzip.compress(record(b"three")) + gzip.compress(record(b"four"))[:-6]
    got = list(warc.salvage(data))
    assert [x[4] for x in got if x[2] == "record"] == [b"one", b"two", b"three"]
    assert [x[5] for x in got if x[2] == "gap"][0] == "wrong digest"
    assert sum(x[1] for x in got) == len(data)


def test_salvage_reads_all_records_of_a_member():
    def record(body):
        d = base64.b32encode(hashlib.sha1(body).digest())
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (d, len(body), body)

    bad = record(b"hello").replace(b"hello", b"hellO")
    members = [gzip.compress(x) for x in (record(b"one") + record(b"two"), bad + record(b"three") + bad + record(b"four"), bad)]
    got = list(warc.salvage(members[0] + members[1] + members[2] + record(b"five")))
    second, third = len(members[0]), len(members[0]) + len(members[1])
    assert [(x[0], x[4] or x[5]) for x in got[:-1]] == [(0, b"one"), (0, b"two"), (second, "wrong digest"), (second, b"three"), (second, "wrong digest"), (second, b"four"), (third, "wrong digest")]
    assert got[-1][4] == b"five" and sum(x[1] for x in got) == sum(map(len, members)) + len(record(b"five"))


def test_digest_is_base32(spark):
    got = spark.createDataFrame([(b"abc",)], "b binary").select(warc.base32_sha1("b")).first()[0]
    assert got == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    pages = [(1, "http://A.bad.com/x", None), (2, "http://other.net/y", '<link rel="canonical" href="http://a.bad.com/x">'), (3, "http://z.net/", None), (4, None, None), (5, "nothing", None), (6, "http://ok.org/p", '<meta http-equiv="refresh" content="0; url=http://a.bad.com/x">'), (7, "http://s.net/1", None), (8, "http://t.com/2", None)]
    rules = spark.createDataFrame([("bad.com", "/", "block"), ("ok.org", "/p", "allow"), ("t.com", "/", "block")], "host string, path string, action string")
    moved = spark.createDataFrame([("http://s.net/1", "http://mid.net/"), ("http://mid.net/", "http://t.com/2")], "source string, target string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, redirects=moved).collect()}
    assert got == {1: ("bad.com/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("ok.org/p", "allow"), 7: (None, "block"), 8: ("t.com/", "block")}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = []
    for b in base:
        for k in range(4):
            w = list(b)
            for _ in range(k * len(w) // 60):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts + ["", None, "one", "ONE", "a b"])] + [(None, "one")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i, _ in rows if i is not None}
    for a in up:
        for b in up:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    assert got.pop(None) == (1, None, True)
    assert got == {i: (len(sets[i]), up[i], up[i] == i) for i in up}


def test_true_links_are_lost_as_seldom_as_said():
    few, many = minhash.trees_for(4e-6, 0.75, minhash.DEEP), minhash.trees_for(5e-6, 0.75, minhash.DEPTH)
    chances = lambda k: math.comb(128, k) * 0.75**k * 0.25 ** (128 - k)
    gone = sum(chances(k) for k in range(minhash.cut_for(1e-6, 0.75)))
    gone += sum(chances(k) * (minhash.lost(k / 128, 4) ** few + minhash.lost(k / 128, 14) ** many) for k in range(129))
    assert gone <= 1e-5


def test_pair_of_unlucky_signatures_links(spark):
    # similarity 0.75 or more, but a share of equal positions below 3.5 sigma
    words, rng = minhash._Words(), random.Random(0)
    for _ in range(20_000):
        a = [f"w{rng.getrandbits(40)}" for _ in range(74)]
        b = a[:64] + [f"w{rng.getrandbits(40)}" for _ in range(10)]
        sets = [minhash.shingles(" ".join(x), words) for x in (a, b)]
        if (minhash.signature(sets[0]) == minhash.signature(sets[1])).mean() < 0.616:
            break
    same = len(np.intersect1d(*sets))
    assert 100 * same >= 75 * (len(sets[0]) + len(sets[1]) - same)
    got = minhash.near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def test_documents_of_deep_nodes_get_more_trees(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.getrandbits(40)}" for _ in range(100)]
    texts = [" ".join([*base[:96], *(f"x{rng.getrandbits(40)}" for _ in range(4))]) for _ in range(12)]
    monkeypatch.setattr(minhash, "LEAF", 2)
    monkeypatch.setattr(minhash, "DEPTH", 5)
    walked = []
    monkeypatch.setattr(minhash, "_more", lambda first, trees, f=minhash._more: walked.append((first, trees)) or f(first, trees))
    got = minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(walked) == 1 and walked[0][0] < walked[0][1]


def test_simhash_order_and_copies(spark):
    rows = [(1, "one two three four five six seven eight"), (5, "one two three four five six seven eight"), (3, None), (9, "alpha beta gamma"), (9, "alpha beta gamma")]
    out = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[5]["fingerprint"] and by[1]["n_near"] == 1 and by[3]["n_chars"] == 0
    text = rows[0][1]
    k = len(text) // 3
    assert by[1]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + "alpha beta gamma"[:k]).encode()).hexdigest()


def test_near_fingerprints_are_complete(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(50)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_language_id_labels_code_switched_words(spark):
    rng = random.Random(6)
    kinds = {"aa": ["ba", "lo", "mi"], "bb": ["zur", "kek", "xon"]}
    rows = [(i, "\n".join(" ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(20)) for _ in range(3)), k) for i in range(60) for k in kinds]
    model = spark.sparkContext.broadcast(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    seen = spark.createDataFrame([(0, "balomi lolo baba zurkek xonxon kekzur kekkek"), (1, None), (2, "12 !"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in seen.select("doc_id", langid.detect("text", model).alias("x")).collect()}
    assert [w["lang"] for w in got[0]["words"]] == ["aa"] * 3 + ["bb"] * 4 and got[0]["lang"] == "bb"
    assert [got[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3


def test_language_id_reads_long_words_whole(spark):
    rng = random.Random(6)
    kinds = {"aa": ["ba", "lo", "mi"], "bb": ["zur", "kek", "xon"]}
    rows = [(i, "\n".join(" ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(20)) for _ in range(3)), k) for i in range(60) for k in kinds]
    model = spark.sparkContext.broadcast(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    seen = spark.createDataFrame([(0, "balomi" * 11 + "zurkek" * 100)], "doc_id long, text string")
    assert seen.select(langid.detect("text", model).alias("x")).first()["x"]["lang"] == "bb"


def test_components_are_least_ids(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 75: 50, 100: 50}
