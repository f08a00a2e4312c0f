"""URL filtering by given rules and by mined association rules.

A URL is split into host and path. The longest given rule that fits decides. For all other URLs the method decides:
FP-growth mines combinations of URL tokens that go with a blocking label; rules with enough support, confidence and
lift are kept and matched through an inverted index, each rule filed under its rarest token.

Where labels exist for documents and not for pages, a page is labelled by its own words: words that nearly always come
in documents with a blocking label tell of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_LABEL = "label:block"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.8, 1.5
#: Pages that a rule needs at least, whatever share of them that is.
MIN_PAGES = 10
#: A telling word is in so many labelled documents at least, this share of them blocked; a page is blocked by so many.
WORD_DOCS, WORD_SHARE, PAGE_WORDS = 10, 0.9, 2
#: Telling words are learned from at most so many labelled documents, chosen by the hash of their id.
SAMPLE_DOCS = 20_000
WORD = r"[a-z\x{80}-\x{10FFFF}]+"
#: Up to so many mined rules the index is broadcast; with more it is joined by a shuffle.
BROADCAST_RULES = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, ASCII lower-cased, and the path that follows; both empty without `://` or for null."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host suffixes, host labels, path segments, file ending, query keys, fragment."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k <= n),
        lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -k, k), ".")),
    )
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0])
    )
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    single = F.array(
        F.when(scheme != "", F.concat(F.lit("s:"), F.lower(scheme))),
        F.when(ending != "", F.concat(F.lit("x:"), F.lower(ending))),
        F.when(F.contains(url, F.lit("#")), F.lit("f:")),
    )
    return F.array_distinct(F.array_compact(F.concat(suffixes, segments, keys, single)))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting (verdict, host, path) rule as struct(size, rule, verdict), or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    listed = F.array(
        *[
            F.when(
                ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
            )
            for v, h, p in rules
        ]
    )
    return F.array_max(F.array_compact(listed))


def telling_tokens(rows: DataFrame, min_support: float) -> DataFrame:
    """One row with the array `kept` of the tokens to mine: those frequent enough to be in a rule, and of tokens that are on
    exactly the same pages the first alone, since k such tokens make 2^k combinations that say the same.

    Frequent tokens are at most the mean number of a page's tokens over min_support, so the array is small.
    """
    pages = rows.agg(F.count(F.lit(1)).alias("pages"))
    held = rows.select("page_id", F.explode("tokens").alias("token")).groupBy("token")
    held = held.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page_id")).alias("x"), F.sum(F.xxhash64("page_id").cast("decimal(38,0)")).alias("s"))
    held = held.join(F.broadcast(pages)).filter(F.col("n") >= F.ceil(F.col("pages") * min_support))
    first = held.groupBy("n", "x", "s").agg(F.min("token").alias("token"))
    return first.agg(F.collect_set("token").alias("kept"))


def words_of(text: Column) -> Column:
    """The different words of a text: letters and all characters beyond ASCII, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)))


def telling_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word) of the words that tell of a blocking label; docs: (doc_id, text), labels: (doc_id, block boolean).

    Learned from SAMPLE_DOCS labels, which are few enough to send to all tasks, so that no text is shuffled. Rows that
    repeat a doc_id count each, with the strictest of its labels; null ids have no label.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("block").alias("block"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("block", F.explode(words_of(F.col("text"))).alias("word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked"))
    return counts.filter((F.col("n") >= WORD_DOCS) & (F.col("blocked") >= WORD_SHARE * F.col("n"))).select("word")


def labels_of_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, block) of every page: whether its html holds PAGE_WORDS different telling words or more. Null html has none."""
    held = pages.select("page_id", F.explode(words_of(F.col("html"))).alias("word")).join(words, "word")
    told = held.groupBy("page_id").agg(F.count_distinct("word").alias("n")).filter(F.col("n") >= PAGE_WORDS)
    told = told.select(F.col("page_id").alias("told"), F.lit(True).alias("block"))
    return pages.select("page_id").join(told, F.col("page_id").eqNullSafe(F.col("told")), "left").select("page_id", F.coalesce("block", F.lit(False)).alias("block"))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, lift, support) of rules that lead to blocking; labels: (page_id, block boolean).

    A rule needs min_support of the labelled pages and MIN_PAGES of them. A page with labels of both kinds is blocked; rows
    that repeat a page id are learned each; without pages, labels or blocked pages there are no rules.
    """
    host, path = host_and_path(F.col("url"))
    known = labels.groupBy("page_id").agg(F.max("block").alias("block"))
    rows = pages.select("page_id", "url").join(known, "page_id")
    min_support = max(min_support, min(1.0, MIN_PAGES / max(1, rows.count())))
    rows = rows.select("page_id", "block", url_tokens(F.col("url"), host, path).alias("tokens"))
    rows = rows.withColumn("tokens", F.array_intersect("tokens", telling_tokens(rows, min_support).scalar()))
    items = F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCK_LABEL))).otherwise(F.col("tokens"))
    rows = rows.select(items.alias("items")).filter(F.size("items") > 0)
    kinds = "antecedent array<string>, confidence double, lift double, support double"
    if not rows.filter(F.array_contains("items", BLOCK_LABEL)).limit(1).count():
        return pages.sparkSession.createDataFrame([], kinds)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK_LABEL)))
    rules = rules.filter((F.col("lift") >= MIN_LIFT) & (F.col("support") >= min_support))
    return rules.select("antecedent", "confidence", "lift", "support")


def inverted_index(rules: DataFrame) -> DataFrame:
    """Each rule filed under the token of its antecedent that the fewest rules hold."""
    numbered = rules.withColumn("tokens", F.array_sort("antecedent"))
    held = numbered.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spread = numbered.select("tokens", "confidence", F.explode("tokens").alias("token")).join(held, "token")
    rarest = F.min_by("token", F.struct("n", "token"))
    return spread.groupBy("tokens", "confidence").agg(rarest.alias("token"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of each different url that some mined rule fits."""
    host, path = host_and_path(F.col("url"))
    index = inverted_index(rules).select(F.col("token"), F.col("tokens").alias("wanted"), "confidence")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    rows = urls.select("url").filter("url is not null").distinct()
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), host, path))
    hits = rows.withColumn("token", F.explode("tokens")).join(index, "token")
    hits = hits.filter(F.size(F.array_except("wanted", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined confidence per row.

    Given rules win over mined ones; a URL that neither fits is allowed. Null urls have empty host and path and are
    allowed. Repeated rows get the same verdict; extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    open_urls = rows.filter("given is null")
    if mined.limit(1).count():
        rows = rows.join(matched(open_urls, mined), "url", "left")
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    by_method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.col("given.verdict"), by_method)
    return rows.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "confidence")
