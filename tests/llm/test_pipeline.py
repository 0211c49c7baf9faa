"""The corpus pipeline on a small corpus with planted documents."""

import random

import corpus_pipeline

KINDS = {"aa": ["ba", "lo", "mi", "ren"], "bb": ["zur", "kek", "xon", "tap"]}


def corpus():
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices(KINDS[k], k=4))
    text = lambda k, n=60: "\n".join(" ".join(word(k) for _ in range(15)) for _ in range(n // 15))
    docs = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(200)]
    toxic = list(range(0, 200, 5))
    docs = [(i, t + "\nvile stinker vile lowlife" if i in toxic else t, k) for i, t, k in docs]
    docs = [(i, t + "\nRead more here" if 20 <= i < 40 else t, k) for i, t, k in docs]
    near = docs[1][1].split(" ")
    docs += [(300 + i, " ".join([*near[:-1], f"end{i}"]), "aa") for i in range(3)]
    docs += [(400, "123 456", None), (401, None, None), (402, "", "aa")]
    return [(i, t, k, f"src{i % 6}", len(t or "")) for i, t, k in docs], [(i, 1, int(i in toxic)) for i in range(200)]


def test_stages_decide_as_planted(spark, tmp_path):
    docs, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    names = rows.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        if name != "packing":
            assert out.columns == names
        out.write.parquet(f"{d}/{name}")
        rows = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r["doc_id"]: r.asDict() for r in rows.collect()}
    assert {400, 401, 402} & kept["language"].keys() == set() and len(kept["language"]) == 203
    assert {i for i in range(200) if i not in kept["toxicity"]} == set(range(0, 200, 5))
    assert all("Read more" not in r["text"] for r in kept["lines"].values()) and kept["lines"].keys() == kept["toxicity"].keys()
    assert kept["lines"].keys() - kept["near_duplicates"].keys() == {300, 301, 302}
    assert kept["packing"].keys() == kept["near_duplicates"].keys()


def test_text_that_switches_languages_stays(spark):
    rng = random.Random(12)
    kinds = KINDS | {"cc": ["qui", "vosh", "dje", "fy"]}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=4)) for _ in range(n))
    docs = [(i, text(k, 60), k) for i in range(60) for k in kinds]
    docs.append((100, "\n".join(text(k, 20) for k in kinds), None))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert 100 in {r["doc_id"] for r in corpus_pipeline.language(spark, rows, "").collect()}


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    docs, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    more = rows.withColumn("found", rows.doc_id).withColumn("score", rows.doc_id).withColumn("length", rows.doc_id).withColumn("cluster", rows.lang)
    repeated = more.union(more.where("doc_id in (1, 5, 400, 401)")).union(more.where("doc_id = 3").selectExpr("cast(null as long)", *more.columns[1:]))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, more.where("false"), d)
        out = stage(spark, repeated, d)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert out.count() >= repeated.count()
            continue
        assert out.columns == more.columns
        kept = [r["doc_id"] for r in out.collect()]
        assert kept.count(1) == 2 and kept.count(None) == 1 and (name == "language") == (401 not in kept)
