"""Quality by attention, phrases by FM-indexes, spelling variants by Gram matrices."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rdlab.llm import langid, line_dedup, minhash, phrases, quality, queries, spelling, toxicity, warc
from rdlab.llm.common import Tables

SF = "/root/testdata/sf0.01"


# --- spelling variants


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé\U0001f600", min_size=0, max_size=5), min_size=1, max_size=8))
def test_one_edit_is_exact(words):
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    codes = codes if len(codes) else np.zeros(1, np.int32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    a, b = (np.array(x) for x in zip(*product(range(len(words)), repeat=2), strict=True))
    assert spelling.one_edit(codes, start, size, a, b).tolist() == [_one_edit(words[i], words[j]) for i, j in zip(a, b, strict=True)]


def _words(n, seed, letters="abcdeéñz", longest=9):
    draw = random.Random(seed)
    found = {"".join(draw.choice(letters) for _ in range(draw.randint(3, longest))) for _ in range(n)}
    return {w: draw.choice([3, 3, 4, 7, 9, 20, 50]) for w in sorted(found)}


def _brute_variants(n):
    near = {w: [o for o in n if _one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize(("tile", "groups"), [(1024, 6), (7, 2), (50, 3)])
def test_variants_equal_brute_force(spark, tile, groups):
    n = _words(700, tile) | {"𝒂bcde": 5, "𝒂bcdf": 50, "x" * 300: 9, "x" * 301: 3, "a": 3, "b": 9, "": 4, "漢字仮名": 3, "漢字仮": 6}
    rows = spark.createDataFrame([*n.items(), (None, 7)], "word string, n long").repartition(5)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(rows, groups=groups, tile=tile).collect()}
    assert got == _brute_variants(n)


def test_forms_lead_to_the_last(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(9)}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame([*chain.items()], "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaa" + "b" * 8}


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).isEmpty()
    texts = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "1 2 3 !", "x"), (4, "É é ÀB Ab-cd", "x")], "doc_id int, text string, word string")
    got = {r["doc_id"]: r["r"] for r in texts.select("doc_id", spelling.runs("text").alias("r")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["É", "é", "Àb", "ab", "cd"]}
    assert spelling.word_counts(texts, "word", 1, 3).collect()[0].asDict() == {"word": "x", "n": 4}


def test_a_hot_block_is_cut_into_tiles(spark):
    # all words have the same letter counts: one block
    draw = random.Random(5)
    words = {"".join(draw.sample("abcdefgh", 8)) for _ in range(600)}
    tables = Tables(spark)
    rows = tables.written(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), "t")
    assert spelling.near_words(rows, tables, tile=16).isEmpty()  # anagrams are two edits apart
    got = spelling.near_words(tables.written(spark.createDataFrame([(w, 3) for w in words | {w[:-1] + "z" for w in words}], "word string, n long"), "t"), tables, tile=16)
    assert got.count() == len(words | {w[:-1] + "z" for w in words})


# --- phrases


def _split(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def _brute_phrases(docs, min_count, longest, inside, top):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for p in _split(text):
            n[lang] += len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    key = lang, tuple(p[i : i + k])
                    f[key] = f.get(key, 0) + 1
    often = {k: v for k, v in f.items() if v >= min_count and len(k[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        gone = any(100 * b >= inside * a and len(o) > len(w) and any(o[i : i + len(w)] == w for i in range(len(o) - len(w) + 1)) for (x, o), b in often.items() if x == lang)
        if not gone:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right, words) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, words, -score))
    return sorted(rows)


def _docs(seed, many=60):
    draw = random.Random(seed)
    words = ["a", "b", "C", "c", "é", "dd", "x\x0by", "漢", "zz", "\xa0q", "n\x00l", "_"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" "] * 6 + ["\t", "  ", ". ", ",", "\n", "!?", " \r\n "]) for _ in range(draw.randint(0, 80)))
    return [(draw.choice(["en", "en", "en", "fr", None]), text()) for _ in range(many)] + [("en", None), ("de", ""), ("xx", "... !"), ("fr", "one")]


@pytest.mark.parametrize(("shard", "inside", "top", "longest"), [(3_000_000, 100, 2000, 5), (200, 100, 7, 5), (64, 60, None, 3), (500, 80, 2000, 7)])
def test_collocations_equal_brute_force(spark, shard, inside, top, longest):
    docs = _docs(shard + longest)
    docs += docs[:5]  # repeated rows count again
    rows = spark.createDataFrame([(lang, t, 1, 2) for lang, t in docs], "lang string, text string, phrase int, rank int").repartition(3)
    got = phrases.collocations(rows, min_count=4, max_words=longest, inside=inside, top=top, shard_bytes=shard)
    assert sorted(map(tuple, got.collect())) == _brute_phrases(docs, 4, longest, inside, top)


def test_an_index_finds_all_phrases():
    draw = random.Random(3)
    text = "\n".join(" ".join(draw.choice("abcd") for _ in range(draw.randint(1, 30))) for _ in range(40))
    words, counts, before, after = phrases.build(text.encode(), 4)
    everything = np.full(1 << (phrases.BITS - 3), 255, np.uint8)
    found = phrases.enumerate_phrases(counts[1:].astype(np.int64), before, after, np.arange(len(words), dtype=np.uint64), [everything], 4)
    for k, (ids, f) in zip((2, 3, 4), found, strict=True):
        got = {tuple(words[i - 1].decode() for i in row): n for row, n in zip(ids.tolist(), f.tolist(), strict=True)}
        want = Counter(tuple(p[i : i + k]) for p in (line.split() for line in text.split("\n")) for i in range(len(p) - k + 1))
        assert got == want


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 9])
def test_order_is_by_the_next_words(depth):
    ids = np.random.default_rng(depth).integers(0, 300, 500)
    by = phrases.order(ids, depth)
    keys = [tuple(np.roll(ids, -i)[:depth]) for i in by]
    assert sorted(by.tolist()) == list(range(500))
    assert keys == sorted(keys)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), min_count=1).isEmpty()
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", " . ")], "lang string, text string"), min_count=1).isEmpty()


def test_a_long_text_is_cut_between_pieces(spark):
    text = ". ".join(["so it is"] * 4000) + " " + "w " * 3000
    got = phrases.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), min_count=100, shard_bytes=1000, top=None).collect()
    assert {r["phrase"]: r["a"] for r in got}["so it is"] == 4000
    assert {r["phrase"]: r["a"] for r in got}["w w w w w"] == 2996


# --- quality


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(1)
    model = quality.Attention(0.4)
    model.w = {k: draw.standard_normal(np.shape(v)) * 0.3 for k, v in model.w.items()}
    bags = [draw.standard_normal((n, quality.WIDTH)) * 0.2 for n in (1, 3, 2)]
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        w, t = model.sums(x, starts)
        p = model.score(w, t)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    got = model.gradients(x, starts, y)
    for k, w in model.w.items():
        flat = np.atleast_1d(w).reshape(-1)
        for i in draw.integers(0, flat.size, 5):
            keep, step = model.w[k], 1e-5
            values = []
            for sign in (1, -1):
                moved = flat.copy()
                moved[i] += sign * step
                model.w[k] = moved.reshape(np.shape(keep)) if np.shape(keep) else moved[0]
                values.append(loss())
            model.w[k] = keep
            assert np.atleast_1d(got[k]).reshape(-1)[i] == pytest.approx((values[0] - values[1]) / (2 * step), abs=1e-6)


def test_all_of_a_text_is_encoded():
    text = "Some words, é and more. " * 9000
    parts = quality.stretches(text)
    assert b"".join(p[:-2] for p in parts) == text.encode()
    x, of = quality.encode(parts)
    assert x.shape == (sum(-(-len(p) // quality.PASSAGE) for p in parts), quality.WIDTH)
    assert np.isfinite(x).all()
    alone = np.concatenate([quality.encode([p])[0] for p in parts])
    assert np.allclose(x, alone)
    assert (np.bincount(of) <= quality.STRETCH).all()
    for odd in (None, "", " ", "\0", "a", "é" * 3, "\n" * 5000):
        x, _ = quality.encode(quality.stretches(odd))
        assert np.isfinite(x).all()
        assert len(x) >= 1


def _labelled(spark):
    good = "The quiet river ran along {0} stones and the old town. We saw it {0} times.\n"
    bad = "BUY!! NOW!! {0}!! CLICK!! CLICK!! $$$ ### {0}!!\n"
    rows = [(i, (good if i % 3 else bad).format(i) * (1 + i % 40), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, good.format(7) * 20_000, "x", 1.0), (902, good.format(7) * 20_000, "x", 1.0), (None, bad, "x", 1.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(None, 0), (4, None), (900, 1), (1, 1)], "doc_id long, quality int")
    return docs, labels, {i: q for i, _, q in rows if i % 2 == 0}


def test_quality_learns_and_defines_odd_cases(spark):
    docs, labels, unseen = _labelled(spark)
    model = spark.sparkContext.broadcast(quality.train(docs, labels))
    rows = docs.select("doc_id", "text", quality.score("text", model).alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in rows}
    assert len(rows) == docs.count()
    assert all(0 <= r["s"] <= 1 for r in rows)
    assert all((got[i] >= 0.5) == bool(q) for i, q in unseen.items())
    assert got[900] == got[901]  # null as empty
    assert got[902] > 0.5
    assert len({r["s"] for r in rows if r["doc_id"] == 902}) == 1
    # the same model, whatever the batches
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        again = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score("text", model).alias("s")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(again[k] == pytest.approx(v, abs=1e-5) for k, v in got.items())


def test_quality_without_labels(spark):
    docs, labels, _ = _labelled(spark)
    for some, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), None)):
        model = spark.sparkContext.broadcast(quality.train(docs, some))
        scores = {round(r["s"], 6) for r in docs.select(quality.score("text", model).alias("s")).collect()}
        assert len(scores) == 1
        assert (scores == {share}) if share else (scores.pop() > 0.9)
    assert docs.limit(0).select(quality.score("text", model)).isEmpty()


def test_held_out_quality(spark):
    rows = queries.op11_attention_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
    clean = rows.where("quality = 1").agg(F.avg("predicted")).first()[0]
    assert clean > 0.98
    part = spark.range(1000).select((toxicity.held_out(F.col("id"))).alias("h")).where("h").count()
    assert 150 < part < 250


@pytest.mark.parametrize("name", ["op12_collocations", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


# --- mends of earlier operators


def test_only_letters_make_words():
    assert [langid.core(t) for t in ("²", "½", "ⅷ", "x²", "A_b1", "É.", "漢字", "")] == ["", "", "", "x", "ab", "é", "漢字", ""]


def test_numbers_are_und(spark):
    rows = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 20, "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = spark.sparkContext.broadcast(langid.train(docs))
    odd = spark.createDataFrame([(1, "²"), (2, "½ ⅷ 12"), (3, None), (4, ""), (5, "hund katze und")], "doc_id long, text string")
    got = {r["doc_id"]: r["x"]["lang"] for r in odd.select("doc_id", langid.detect_document("text", model).alias("x")).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "de"}


@pytest.mark.parametrize("labels", [1, 3])
def test_marginals_equal_all_label_sequences(labels):
    draw = np.random.default_rng(labels)
    crf = langid.Crf([f"l{i}" for i in range(labels)])
    crf.move, crf.start = draw.standard_normal((labels, labels)) * 2, draw.standard_normal(labels) * 2
    for t in (1, 2, 3, 5):
        scores = draw.standard_normal((t, labels)) * 3
        total, want = 0.0, np.zeros((t, labels))
        for tags in product(range(labels), repeat=t):
            weight = np.exp(crf.start[tags[0]] + sum(scores[i, g] for i, g in enumerate(tags)) + sum(crf.move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += weight
            want[range(t), tags] += weight
        p, _ = crf.marginals(scores[None], np.array([t]))
        assert np.allclose(p[0], want / total)
        assert np.allclose(crf.long_marginals(scores), want / total)


@pytest.mark.parametrize("t", [2, 7, 16, 17, 1000, 4099])
def test_windows_equal_single_steps(t):
    draw = np.random.default_rng(t)
    crf = langid.Crf(list("abcd"))
    crf.move, crf.start, scores = draw.standard_normal((4, 4)) * 2, draw.standard_normal(4), draw.standard_normal((t, 4)) * 4
    p, _ = crf.marginals(scores[None], np.array([t]))
    assert np.allclose(p[0], crf.long_marginals(scores), atol=1e-9)


def test_damaged_plain_archives_are_salvaged_in_linear_time():
    import time

    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1900\r\n\r\n" + b"x" * 2000 + b"\r\n\r\n"
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    began = time.time()
    rows = list(warc.salvage(bad * 20_000 + good))
    assert time.time() - began < 10
    assert [r[2] for r in rows] == ["gap", "record"]
    assert rows[0][1] == 20_000 * len(bad)
    # no end of headers anywhere
    began = time.time()
    assert [r[2] for r in warc.salvage(b"WARC/1.1\r\nx: y\r\n" * 100_000)] == ["gap"]
    assert time.time() - began < 10


def test_line_feeds_alone_end_records():
    one = b"WARC/1.0\nWARC-Type: resource\nContent-Length: 3\n\nabc\n\n"
    rows = list(warc.salvage(one * 3))
    assert [(r[2], r[4]) for r in rows] == [("record", b"abc")] * 3


def test_copies_of_one_id_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text)] * 1500 + [(8, text + " w40"), (9, "else")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 7, True), (8, 7, False), (9, 9, True)}
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2], pa.int64()), pa.array([b"a", b"b", b"a", b"a"], pa.binary())], ["id", "found"]), pa.RecordBatch.from_arrays([pa.array([2, 2], pa.int64()), pa.array([b"a", b"c"], pa.binary())], ["id", "found"])]
    assert [(i, x) for b in minhash._once(iter(batches)) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)] == [(1, b"a"), (1, b"b"), (2, b"a"), (2, b"c")]


def test_runs_are_never_shuffled(spark):
    runs = line_dedup.LineRuns(spark, settled=3, fanout=2)
    keys = lambda lo, hi: spark.range(lo, hi).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    plans = []
    write = runs._write

    def seen(df, level):
        plans.append((level, df._jdf.queryExecution().executedPlan().toString()))
        write(df, level)

    runs._write = seen
    for _ in range(5):
        runs.add(keys(0, 100).union(keys(0, 50)))
    for level, plan in plans:
        assert plan.count("Exchange") == (1 if level == 0 else 0)  # the batch's own shuffle
    assert any(level > 0 for level, _ in plans[:-1])  # later batches use what is compacted
    assert {len(x) <= 1 for x in runs.levels} == {True}
    want = {bytes(r["key"]) for r in keys(0, 100).collect()}
    assert {bytes(r["key"]) for r in runs.found_in(3).collect()} == want
    runs.close()


def test_rows_without_an_id_drop_their_own_lines_only(spark):
    rows = [(None, f"common {i % 40}\nown {i}") for i in range(2000)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    assert {(r["n_lines"], r["n_dropped"]) for r in out.collect()} == {(2, 1)}
    assert out.where("text like 'own%'").count() == 2000
