import base64
import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolscope.llm import topk, url_filter, warc
from poolscope.llm.common import new_folder
from poolscope.llm.queries import URL_RULES

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute_top(rows, k):
    good = {}
    listed = []
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = np.floor(64.0 * np.array(e, np.float32).astype(float))
        listed.append((i, v))
        good.setdefault((i, len(v)), v)
    out = []
    for (q, n), v in good.items():
        if q % 20:
            continue
        scored = sorted((-int(v @ w), i) for i, w in listed if i != q and len(w) == n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k_matches_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(None, rows[1][1]), (2001, None), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [float("inf")] * 8), (2020, [1.0] * 3), (2021, [2.0] * 3)]
    rows += [rows[5]]
    df = spark.createDataFrame([(*r, 0, 0, "s") for r in rows], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5)


def test_top_k_of_few(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, ""), (20, [2.0, 2.0], 0, 0, ""), (3, [0.0, 0.0], 0, 0, "")], VECTORS)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, 3), (0, 20), (20, 0), (20, 3)]


PAGES = "page_id long, url string, html string, frame int, payload string"


def page_rows():
    rng = random.Random(1)
    rows = [(i, f"http://a.example.org/{i}\r\nX: y" if i == 4 else f"http://a.example.org/{i}", "".join(rng.choice("abc é\r\n") for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    rows += [(100 + i, None, rows[3][2]) for i in range(5)] + [(200, "u", None), (201, "u", ""), (202, "u", "x" * 400_000), (None, "u", "alone"), (203, "u", "WARC/1.1\r\n\r\nContent-Length: 5")]
    return [*rows, rows[7]]


@pytest.mark.parametrize("least", [0, 300])
def test_archive_matches_brute_force(spark, least):
    rows = page_rows()
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], PAGES).repartition(4)
    got = warc.archive(df, least).collect()
    newest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        newest[body] = max(newest.get(body, -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= least and newest[body] != -1 and newest[body] != i
        want.append((i, len(body), digest, "revisit" if revisit else "response", newest[body] if revisit else None))
    assert all(r["intact"] for r in got)
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)


def test_bundles_are_seekable(spark):
    folder = new_folder(spark, "warc-test")
    rows = spark.createDataFrame([(r[0], r[1], r[2] or "", None) for r in page_rows() if r[0] is not None], "page_id long, url string, payload string, refers_to long")
    index = warc.write_bundles(rows.coalesce(1), folder, frame_bytes=2000)
    headers, payload = warc.read_record(spark, index, folder, 202)
    assert payload == b"x" * 400_000 and headers["WARC-Type"] == "response"
    assert warc.read_record(spark, index, folder, 12345) is None
    fs, path = warc.open_folder(folder)
    name = index.first()["bundle"]
    with fs.open_input_file(f"{path}/{name}") as file:
        table = warc.read_seek_table(file)
        size = file.size()
        file.seek(size - 9)
        assert struct.unpack("<IBI", file.read(9)) == (len(table), 0, warc.SEEKABLE_MAGIC)
        assert sum(s for s, _ in table) + 8 + 8 * len(table) + 9 == size and len(table) > 5
        file.seek(0)
        import zstandard

        whole = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
    assert len(whole) == sum(p for _, p in table)


def test_archive_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def brute_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    end = next((k for k, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


URLS = [
    None, "", "nonsense", "http://example.org", "http://Example.ORG/es/1", "https://m.example.org/es/", "http://example.org/en/12?x=1", "http://x.org/a#b/c", "http://notexample.org/es/1",
    "http://a.com/fr/x", "http://a.com/de/x", "http://com/de/", "http://a.net/de/x?u=http://b.org/", "ftp://É.com/fr/\nz", "x://h?p=/de/", "http://a.com/DE/x", "://org/", "http://" + "a" * 5000 + ".com/de/",
]


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, rule string, verdict string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    for r in url_filter.judge(pages, URL_RULES, url_filter.mine(pages, labels)).collect():
        url = [*URLS, URLS[4]][r["page_id"]]
        host, path = brute_host_path(url)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[1], want[2])
    assert url_filter.judge(pages.limit(0), URL_RULES, url_filter.mine(pages, labels)).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.site{i % 5}.net/{'buy' if i % 2 == 0 else 'read'}/{i}.html") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)], "page_id long, block boolean")
    mined = url_filter.mine(pages, labels, min_support=0.02)
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_filter.url_tokens(F.col("url"), *url_filter.host_and_path(F.col("url"))).alias("t")).collect()}
    rules = [(set(r["antecedent"]), r["confidence"]) for r in mined.collect()]
    assert rules
    for antecedent, confidence in rules:
        held = [i for i in range(200) if antecedent <= tokens[i]]
        assert confidence == pytest.approx(sum(i % 4 == 0 for i in held) / len(held))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], mined).collect()}
    assert got == {i: "block" if any(a <= tokens[i] for a, _ in rules) else "allow" for i in range(400)}
    assert all((got[i] == "block") == (i % 4 == 0) for i in range(400))


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    vectors = {i: (rng.integers(-(2**22), 2**22, 4) + rng.random(4)).tolist() for i in range(30)}
    vectors[0] = [2.0**22 - 1, 2.0**22 - 3, 1.0, 2.0**22 + 0.5]
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") % 10 == 0, 3).collect()}
    for q in (0, 10, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v) for v in vectors if v != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(v, -s) for s, v in best]
    assert max(abs(s) for _, s in got.values()) > 2**53
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)


def test_bins_of_scores_near_the_greatest_are_whole(spark):
    """Scores one apart at 2^58, where widths in doubles would be off."""
    vectors = {0: [2.0**23, 1 / 64]} | {i: [2.0**23 - (i % 3) / 64, (i * 37 % 200) / 64] for i in range(1, 400)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [int(64 * x) for x in v] for i, v in vectors.items()}
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") == 0, 50).collect()}
    best = sorted((-sum(a * b for a, b in zip(whole[0], whole[v])), v) for v in vectors if v)[:50]
    assert [got[k + 1] for k in range(50)] == [(v, -s) for s, v in best] and got[1][1] >= 2**58


def test_tokens_of_the_same_pages_are_mined_once(spark):
    """Twenty segments that always come together would make a million combinations."""
    path = "/".join(f"s{k}" for k in range(20))
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.example/{path if i % 4 == 0 else 'x'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)] + [(4, False)], "page_id long, block boolean")
    rules = url_filter.mine(pages, labels, 0.02).collect()
    assert 1 <= len(rules) < 100 and any(r["antecedent"] == ["p:s0"] for r in rules)
    urls = spark.createDataFrame([(1, f"http://other.test/{path}"), (2, "http://other.test/x"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(urls, [], url_filter.mine(pages, labels, 0.02)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    assert url_filter.mine(pages.limit(0), labels).count() == 0 and url_filter.mine(pages, labels.limit(0)).count() == 0


def test_pages_are_labelled_by_their_own_words(spark):
    """Telling words come from labelled documents; pages that hold two of them are blocked, and rules learn from those."""
    docs = [(i, f"w{'abcdefghij'[i % 10]} plain {'VILE' if i % 3 == 0 else ''} {'nasty' if i % 3 == 0 or i == 1 else ''} {'rare' if i < 6 else ''}") for i in range(90)]
    docs += [(None, "vile plain"), (200, None)]
    labels = [(i, i % 3 == 0) for i in range(90)] + [(0, False), (None, True), (300, True)]
    words = url_filter.telling_words(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, block boolean"))
    assert sorted(r["word"] for r in words.collect()) == ["nasty", "vile"]
    pages = [(i, f"http://{'spam' if i % 4 == 0 else 'news'}{i % 3}.net/p/{i}", f"<p>A {'Nasty, vile' if i % 4 == 0 else 'vile vile'} text</p>") for i in range(120)]
    pages += [(None, "http://x.net/", "nasty vile"), (500, None, None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    told = url_filter.labels_of_pages(pages, words)
    assert sorted((str(r["page_id"]), r["block"]) for r in told.collect()) == sorted([*((str(i), i % 4 == 0) for i in range(120)), ("None", True), ("500", False)])
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], url_filter.mine(pages, told)).collect()}
    assert all((got[i] == "block") == (i % 4 == 0) for i in range(120)) and got[500] == "allow"
    # ten blocked pages at least, however few pages there are
    assert url_filter.mine(pages.filter("page_id < 36"), told).count() == 0


def test_url_query_matches_brute_force(spark):
    import re

    from poolscope.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op6_url_filter(spark, sf)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        toxic[r["doc_id"]] = toxic.get(r["doc_id"], False) or r["toxic"] == 1
    words = lambda t: set(re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    seen = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for w in words(r["text"]) if r["doc_id"] in toxic else ():
            seen.setdefault(w, []).append(toxic[r["doc_id"]])
    telling = {w for w, t in seen.items() if len(t) >= 10 and sum(t) >= 0.9 * len(t)}
    block = {r["page_id"]: len(words(r["html"]) & telling) >= 2 for r in pages}
    assert telling and 0 < sum(block.values()) < len(pages) / 2
    labels = spark.createDataFrame(list(block.items()), "page_id long, block boolean")
    mined = [set(r["antecedent"]) for r in url_filter.mine(spark.read.parquet(f"{sf}/pages.parquet"), labels).collect()]
    tokens = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", url_filter.url_tokens(F.col("url"), *url_filter.host_and_path(F.col("url"))).alias("t"))
    tokens = {r["page_id"]: set(r["t"]) for r in tokens.collect()}
    urls = {r["page_id"]: r["url"] for r in pages}
    rows = got.collect()
    for r in rows:
        host, path = brute_host_path(urls[r["page_id"]])
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        by_method = "block" if any(a <= tokens[r["page_id"]] for a in mined) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *(max(fits)[1:] if fits else (None, by_method)))
    assert len(rows) == len(pages)
