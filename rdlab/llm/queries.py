"""The registered queries of the training-data operators, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdlab.llm import ann, bpe, langid, line_dedup, minhash, packing, phrases, quality, simhash, spelling, toxicity, urlfilter, warc
from rdlab.llm.common import new_path

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.best_fit_packing(docs.select("doc_id", "source", *packing.sizes(docs)))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = new_path(spark, "warc")
    warc.write_warc(pages, path, min_bytes=0)
    head = lambda name: F.element_at("headers", name)
    number = lambda name: F.regexp_extract(head(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    kind = head("warc-type")
    records = warc.read_warc(spark, path).where("kind = 'record'")
    size = F.when(kind == "revisit", head("http:content-length").cast("long")).otherwise(F.octet_length("payload").cast("long"))
    digest = F.when(kind == "revisit", F.regexp_replace(head("warc-payload-digest"), "^sha1:", "")).otherwise(warc.base32_sha1("payload"))
    return records.select(number("warc-record-id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", number("warc-refers-to")).alias("refers_to"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = spark.sparkContext.broadcast(langid.train(docs.where(~langid.held_out(F.col("doc_id")))))
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.detect_document("text", model).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(quality.train(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), quality.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"), min_count=100, max_words=5, inside=100, top=2000)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.runs("text")).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    typo = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, size))
    words = docs.select(F.when(h % 97 == 0, typo).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.word_counts(words, min_chars=5, min_count=3), ratio=2)


def queries() -> dict:
    own = (op1_bpe, op2_line_dedup, op3_vp_tree, op4_toxicity, op5_best_fit_packing, op6_warc, op7_url_filters, op8_minhash, op9_simhash, op10_language_id, op11_attention_quality, op12_collocations, op13_spelling_variants)
    return {f.__name__: f for f in own}


OP2 = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e) AS score FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
  array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i::INTEGER + 1, 1))::INTEGER - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i::INTEGER + 1, 1)::INTEGER + 8 * substr(bits, 5 * i::INTEGER + 2, 1)::INTEGER + 4 * substr(bits, 5 * i::INTEGER + 3, 1)::INTEGER + 2 * substr(bits, 5 * i::INTEGER + 4, 1)::INTEGER + substr(bits, 5 * i::INTEGER + 5, 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON v = d.doc_id
"""


def _op7() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return rf"""
WITH rules(rh, rp, action) AS (VALUES {rules}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[^\n]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^[^\n]*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '^[^\n]*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
best AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp, action) AS rn
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
q AS (SELECT p.*, rule, action,
  list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|ref)='))) AS kept FROM p LEFT JOIN best ON best.page_id = p.page_id AND rn = 1),
a AS (SELECT *, CASE WHEN host = '' THEN 'none ' || page_id ELSE regexp_replace(host, '^www\.|:(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS address FROM q)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bool_or(action = 'block') OVER w AND NOT coalesce(bool_or(action = 'allow') OVER w, false) THEN 'block' END, 'allow') AS verdict
FROM a WINDOW w AS (PARTITION BY address)
"""


OP12 = r"""
WITH pieces AS (SELECT lang, unnest(generate_series(1, len(p))) AS i, row_number() OVER () AS doc, p FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(p[i], '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS first, array_to_string(list_slice(w, k + 1, m), ' ') AS rest FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, part FROM (SELECT lang, a, m, array_to_string(list_slice(w, i, i + j - 1), ' ') AS part FROM (SELECT *, unnest(generate_series(1, m - j + 1)) AS i FROM c, (SELECT unnest(range(2, 5)) AS j) WHERE j < m)) p
  WHERE EXISTS (SELECT 1 FROM c WHERE c.lang = p.lang AND c.phrase = part AND 100 * p.a >= 100 * c.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.part = b.phrase))
WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE poly(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
few AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM few),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS o, b.n AS o_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(o_n) AS top FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN top END AS form_n,
  CASE WHEN top >= 2 * v.n THEN (SELECT min(o) FROM near WHERE near.word = v.word AND near.o_n = top) END AS form FROM v LEFT JOIN best ON best.word = v.word),
walk(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_vp_tree": OP3, "op6_warc": OP6, "op7_url_filters": _op7(), "op8_minhash": OP8, "op12_collocations": OP12, "op13_spelling_variants": OP13}
