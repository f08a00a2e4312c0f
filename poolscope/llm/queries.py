"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm import divergence, exact_dedup, langid, mixing, near_dedup, packing, resampling, substring_dedup, suffix_dedup, topk, toxicity, url_filter, warc
from poolscope.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
           THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS least FROM documents
  UNION
  SELECT e.b, r.least FROM reach r JOIN e ON e.a = r.doc_id WHERE r.least < e.b
), c AS (
  SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {topk.K}
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


OP3_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
), w AS (
  SELECT doc_id, pos, substr(x, 2 * pos + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n_bytes - 99)) AS pos FROM h)
), r AS (
  SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1
), m AS (
  SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r
), g AS (
  SELECT doc_id, pos, sum(CASE WHEN last IS NULL OR last + 100 < pos THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m
), k AS (
  SELECT doc_id, run, min(pos) AS start, max(pos) + 100 AS stop FROM g GROUP BY doc_id, run
), b AS (
  SELECT doc_id, list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops, sum(stop - start)::BIGINT AS n_removed,
         count(*) AS n_spans FROM k GROUP BY doc_id
)
SELECT h.doc_id, h.n_bytes, coalesce(b.n_removed, 0) AS n_removed, coalesce(b.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN b.doc_id IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1),
         lambda k: substr(x, (CASE WHEN k = 0 THEN 0 ELSE 2 * stops[k] END + 1)::BIGINT,
           (2 * (CASE WHEN k = len(starts) THEN n_bytes ELSE starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE stops[k] END))::BIGINT)), '') END)) AS kept_sha256
FROM h LEFT JOIN b ON b.doc_id = h.doc_id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
), k AS (
  SELECT doc_id, n,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest,
         sha1(coalesce(html, '')) AS hex FROM pages
)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to, true AS intact
FROM p
"""


#: (verdict, host, path) of the given rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    block = F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", block.alias("block"))
    words = materialize(url_filter.telling_words(table(spark, sf_dir, "documents"), labels), "telling-words")
    labels = materialize(url_filter.labels_of_pages(pages, words), "page-labels")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(pages, labels))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = langid.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = table(spark, sf_dir, "labels").filter(remainder != 2)
    got = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


OP10_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (
  SELECT source, (SELECT sum(n) FROM n) / (SELECT sum(pow(n, {mixing.TEMPERATURE})) FROM n)
                 * pow(n, {mixing.TEMPERATURE}) / n AS rate FROM n
), c AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, generate_series(0, (SELECT ceil(max(rate + 12 * sqrt(rate) + 25))::BIGINT FROM r)) t(k)
  WHERE k <= ceil(rate + 12 * sqrt(rate) + 25)
), u AS (
  SELECT doc_id, source, text,
         (('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), m AS (
  SELECT doc_id, u.source, text, count(*) FILTER (c.cdf < u.u) AS n_copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL
), e AS (SELECT doc_id, source, text, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM m)
SELECT doc_id, source, copy::INT AS copy, n_copies::INT AS n_copies,
       (('0x' || substr(md5('{mixing.SEED}:order:' || doc_id || ':' || copy), 1, 13))::BIGINT + 0.5::DOUBLE)
       / 4503599627370496::DOUBLE AS shuffle_key, md5(text) AS text_md5
FROM e
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d)
), r AS (
  SELECT doc_id, pos FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY seq)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS word FROM r
), gone AS (
  SELECT doc_id, list(word) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
         lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT lang, source, row, unnest(words) AS term FROM (SELECT *, row_number() OVER () AS row FROM d)
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.n + 5 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 5) // (l.n + 5 * l.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc AS (  -- the table of the reflected polynomial 0xEDB88320
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), w AS (
  SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), d AS (
  SELECT part, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM w
), g AS (
  SELECT part, doc_id, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
         list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature FROM d
), f AS (
  SELECT feature, xor(list_reduce(list_transform(range(0, octet_length(encode(feature))),
           lambda k: ('0x' || substr(hex(encode(feature)), (2 * k + 1)::BIGINT, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM g), crc
), n AS (
  SELECT part, row, bucket, count(*) AS n FROM g JOIN f USING (feature) GROUP BY ALL
), s AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (part = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (part = 1), 0)::DOUBLE AS t
  FROM range(10000) b(bucket) LEFT JOIN n USING (bucket) GROUP BY b.bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s
), weight AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN gain USING (bucket) WHERE part = 0 GROUP BY row
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (row) WHERE part = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank
FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_top_k": op2_top_k,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_warc": op5_warc,
        "op6_url_filter": op6_url_filter,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_divergence": op12_divergence,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op2_top_k": OP2_SQL,
        "op3_suffix_dedup": OP3_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op5_warc": OP5_SQL,
        "op10_mixing": OP10_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op12_divergence": OP12_SQL,
        "op13_resampling": OP13_SQL,
    }
