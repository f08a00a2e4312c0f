"""Substring dedup, source divergence and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscope.llm import divergence, resampling, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_repeats(rows, length):
    """(doc_id, n_words, n_removed, sha256, spans) of each row; a null id is the smallest."""
    order = lambda i: -math.inf if i is None else i
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            least[window] = min(order(i), least.get(window, order(i)))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k : k + length])] < order(i):
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        spans = [[k, min(j for j in range(k, len(w) + 1) if j not in gone)] for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans))
    return sorted(map(str, out))


def found(report):
    return sorted(str((*r[:4], [list(s) for s in r["spans"]])) for r in report.collect())


@pytest.mark.parametrize("length", [2, 5, 13, 16])
def test_substring_dedup_matches_brute_force(messy, length):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(substring_dedup.substring_dedup(messy.repartition(3), length)) == without_repeats(rows, length)


def test_substring_dedup_with_many_groups_and_frequent_prefixes(spark, monkeypatch):
    """Few different words, so that prefixes of many lengths are extended, over many groups and flushes."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 800)
    monkeypatch.setattr(substring_dedup, "LEAST_COUNT", 1)
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "FLUSH_ANCHORS", 100)
    rng = random.Random(3)
    passage = ["a"] * 30 + ["b", "c"] * 10
    rows = []
    for i in range(120):
        words = [rng.choice("aaabc") for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(8) :]
        rows.append((i * 7 - 100, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    heavy = substring_dedup.heavy_prefixes(docs, 13, 1 / 80)
    assert max(heavy) == 7 and all(len(h) <= 80 for h in heavy.values())
    assert found(substring_dedup.substring_dedup(docs)) == without_repeats(rows, 13)


def test_substring_dedup_of_ids_that_repeat(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(1, text), (1, "x " + text), (2, text), (2, text), (None, None), (None, "y " + text), (None, text + " z"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring_dedup.substring_dedup(docs)) == without_repeats(rows, 13)


def test_substring_dedup_of_nothing(nothing):
    assert substring_dedup.substring_dedup(nothing).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(nothing, 1)


def test_prefixes_that_many_suffixes_share_are_extended():
    code = np.array([1, 1, 2, 1, 1, 3], np.uint64)
    at = np.array([0, 3])
    start = substring_dedup.extended(np.zeros(1, np.uint64), code[:1])
    heavy = {1: start, 2: substring_dedup.extended(start, code[1:2])}
    plain, often = substring_dedup.group_hash(code, at, 3, {})
    assert plain[0] == plain[1] == start[0] and not often.any()
    apart, often = substring_dedup.group_hash(code, at, 3, heavy)
    assert apart[0] != apart[1] and not often.any()
    assert substring_dedup.group_hash(code, at, 2, heavy)[1].all()


def test_windows_of_frequent_anchors_go_on_their_own(spark, monkeypatch):
    """Every prefix is to be extended: all windows are dealt one by one, with the same result."""
    monkeypatch.setattr(substring_dedup, "MOST_PREFIXES", 10**9)
    monkeypatch.setattr(substring_dedup, "PART", 10**6)
    monkeypatch.setattr(substring_dedup, "LEAST_COUNT", 0)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(25)]
    rows = [(i, " ".join([f"x{rng.randrange(9)}" for _ in range(rng.randrange(9))] + passage[rng.randrange(9) :] + [f"y{i}"] * 3)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(substring_dedup.substring_dedup(docs)) == without_repeats(rows, 13)


def audited(rows, min_docs, k):
    terms = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for t, a, s in rows]
    out = []
    for lang in {a for a, _, _ in terms}:
        own = [(s, w) for a, s, w in terms if a == lang]
        docs = collections.Counter(x for _, w in own for x in set(w))
        kept = sorted(x for x, n in docs.items() if n >= min_docs)
        count = {s: collections.Counter(x for z, w in own if z == s for x in w if docs[x] >= min_docs) for s, _ in own}
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {x: share(c[x], c.total()) for x in kept} for s, c in count.items()}
        every = sum(count.values(), collections.Counter())
        q = {x: share(every[x], every.total()) for x in kept}
        for s in count:
            pairs = [(-sum(abs(p[s][x] - p[z][x]) for x in kept), z.encode(), z) for z in count if z != s]
            over = [(q[x] - p[s][x], x.encode(), x) for x in kept if count[s][x] and p[s][x] > q[x]]
            out += [(lang, s, "pair", z, -v, r) for r, (v, _, z) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, r) for r, (v, _, x) in enumerate(sorted(over)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(11)
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None, "lone" if i % 50 == 0 else "s1"])
        words = [rng.choice(["Über", "the", "THE", "a1b", "x", "日本", "zz"]) + "abcdefgh"[min(7, int(rng.expovariate(0.6)))] for _ in range(rng.randrange(40))]
        rows.append((" ".join(words) if i % 20 else None, lang, source))
    return [*rows, ("!! 12 --", "xx", "s1"), (None, "xx", "s2"), *rows[:3], ("long " * 30_000, "de", "s2")]


@pytest.mark.parametrize("min_docs, k, block", [(3, 4, 256), (3, 50, 2), (1, 1, 1), (1000, 5, 256)])
def test_audit_matches_brute_force(spark, sources, monkeypatch, min_docs, k, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "DENSE_TERMS", 3)
    monkeypatch.setattr(divergence, "SLICE_POSTINGS", 40)
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 30)
    docs = spark.createDataFrame(sources, "text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, min_docs, k).collect())
    assert got == audited(sources, min_docs, k)


def test_audit_of_nothing(nothing):
    assert divergence.audit(nothing).collect() == []


def test_search_stops_below_the_kth_value(spark, monkeypatch):
    """Buckets whose bound is below the k-th value found aren't evaluated; one whose bound equals it is."""
    rows = [("l", "s", 0, f"t{n:03}", n, 100 * n, 10) for n in range(1, 200)] + [("l", "s", 0, "a", 199, 19_900, 10)]
    postings = spark.createDataFrame(rows, "lang string, source string, no int, term string, n long, p long, q long")
    seen, write = [], divergence.materialize

    def kept(df, name):
        out = write(df, name)
        seen.extend((name, r) for r in out.collect())
        return out

    monkeypatch.setattr(divergence, "materialize", kept)
    got = [(r["item"], r["value"]) for r in sorted(divergence.overused(postings, 2).collect(), key=lambda r: r["rank"])]
    assert got == [("a", 19_890), ("t199", 19_890)]
    chosen = [r for name, r in seen if name == "term-chosen"]
    assert len(chosen) == 1 < sum(name == "term-buckets" for name, _ in seen)


def test_shares_are_exact_beyond_longs(spark):
    row = spark.range(1).select(divergence.share(F.lit(4 * 10**17), F.lit(9 * 10**17), F.lit(3)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**17 + 5) // (9 * 10**17 + 15)


def drawn(docs, target, percent=5, min_words=20, seed=42):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s = collections.Counter(b for _, _, f in own for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = k
    return sorted(str(r[:5]) for r in out)


@pytest.mark.parametrize("percent, min_words", [(5, 20), (60, 5), (100, 0)])
def test_resampling_matches_brute_force(spark, messy, percent, min_words):
    target = ["Lorem ipsum DOLOR sit", None, "über Straße É 1a", "", "lorema3 ipsum4"]
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    # one of the two rows that share id and text may come first: they are alike
    other = spark.createDataFrame([(t, k) for k, t in enumerate(target)], "text string, buckets long")
    got = resampling.resample(messy.withColumnsRenamed({"__u": "rank", "bucket": "buckets", "copy": "g1"}).repartition(3), other, percent, min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == drawn(rows, target, percent, min_words)


def test_resampling_of_nothing(spark, messy, nothing):
    empty = nothing.select("text")
    assert resampling.resample(nothing, messy).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted(str(list(r)) for r in resampling.resample(messy, empty, 30).collect()) == drawn(rows, [], 30)


def test_resampling_plan_has_no_explode(messy):
    rows = resampling.with_buckets(messy.select("doc_id", "text")).select(resampling.weight(list(range(resampling.BUCKETS))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "split(" not in plan.split("AS ")[0]
