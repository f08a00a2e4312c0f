import hashlib
import re

import pytest
from pyspark.sql import functions as F

from poolscope.llm import exact_dedup, near_dedup, suffix_dedup
from poolscope.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("max_files", [None, 1])
def test_exact_dedup_matches_brute_force(messy, max_files):
    docs = messy.repartition(3)
    got = exact_dedup.exact_dedup(docs, max_files).collect()
    groups = {}
    for r in messy.collect():
        groups.setdefault(SPACE.sub("", r["text"] or ""), []).append((-len(r["text"] or ""), float("inf") if r["doc_id"] is None else r["doc_id"]))
    want = []
    for body, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(body.encode()).hexdigest()
        for _, i in members:
            want.append((None if i == float("inf") else i, None if keep == float("inf") else keep, len(members), i == keep, digest))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_exact_dedup_compares_bytes(messy, monkeypatch):
    """With a digest that collides, the exact way by bytes decides."""
    want = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in exact_dedup.exact_dedup(messy).collect())
    short = lambda column, bits: F.substring(F.md5(column), 1, 1)
    monkeypatch.setattr(exact_dedup.F, "sha2", short)
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in exact_dedup.exact_dedup(messy).collect())
    assert got == want


def test_exact_dedup_goes_on_from_kept_state(spark, messy, tmp_path):
    """A second run with the same folder streams its own rows only, and counts those of the first."""
    rows = messy.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: tuple(r) for r in exact_dedup.exact_dedup(rows).collect()}
    state = f"file://{tmp_path}/state"
    early, late = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")
    assert sum(1 for _ in exact_dedup.exact_dedup(early, state_dir=state).collect()) == early.count()
    got = {r["doc_id"]: tuple(r) for r in exact_dedup.exact_dedup(late, state_dir=state).collect()}
    assert got == {i: w for i, w in want.items() if i % 2}
    offsets = sorted(p.name for p in (tmp_path / "state/checkpoint/commits").iterdir() if p.name.isdigit())
    assert offsets == ["0", "1"]


def test_exact_dedup_reads_content_at_its_place(spark, messy, tmp_path, monkeypatch):
    path = f"{tmp_path}/docs"
    messy.select("doc_id", "text").repartition(3).write.parquet(path)
    rows = exact_dedup.located(spark.read.parquet(path), None)
    assert rows.select("file", "row").distinct().count() == messy.count()
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 2)
    assert rows.select("file").distinct().count() == 3
    want = sorted(map(str, exact_dedup.exact_dedup(messy).collect()))
    assert sorted(map(str, exact_dedup.exact_dedup(spark.read.parquet(path)).collect())) == want


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_dedup_matches_brute_force(messy):
    rows = [(r["doc_id"], shingles(r["text"])) for r in messy.collect() if r["doc_id"] is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = sorted((i, len(s), find(i), find(i) == i) for i, s in rows)
    got = near_dedup.near_dedup(messy.repartition(4)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_near_dedup_in_small_blocks(messy, monkeypatch):
    want = sorted(map(str, near_dedup.near_dedup(messy).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert sorted(map(str, near_dedup.near_dedup(messy).collect())) == want
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    assert sorted(map(str, near_dedup.near_dedup(messy).collect())) == want


def test_near_dedup_of_nothing(nothing):
    assert near_dedup.near_dedup(nothing).count() == 0


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:])
    sketches = near_dedup.registers([a, b])
    equal = (sketches[0] == sketches[1]).sum() - near_dedup.chance_matches(np.array([3000.0]), np.array([3400.0]))[0]
    assert abs(equal / near_dedup.BUCKETS - 2400 / 4000) < 0.15


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (None, 3)] + [(500, k) for k in range(200, 260)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in (*range(200, 260), 500)} == {200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows, length=100):
    seen, out = {}, {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if seen.setdefault(window, (key, s)) != (key, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(messy):
    got = suffix_dedup.suffix_dedup(messy.repartition(5)).collect()
    rows = {(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in messy.collect()}
    want = brute_removal(sorted(rows, key=lambda r: r[0]))
    for r in got:
        assert want[-1 if r["doc_id"] is None else r["doc_id"]] == (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    assert len(got) == messy.count() and sum(r["n_removed"] for r in got) > 1000


def test_suffix_dedup_of_random_small_alphabet(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(6)]
    texts += [texts[0][50:350] + texts[1][:200], texts[2] * 2, "ab" * 300, "b" + "ab" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_removal(list(enumerate(texts)))


@pytest.mark.parametrize("frequent", [0, 3])
def test_suffix_dedup_of_frequent_anchors(spark, messy, monkeypatch, frequent):
    """Anchors of many surroundings are dealt by context, whichever tasks they are met in; the answer stays the same."""
    import random

    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(99))
    texts = [f"{rng.random()} {rng.random()}{passage}{rng.random()} {rng.random()}" for _ in range(60)]
    texts += [f"{rng.random()}{passage}!{rng.random()}{rng.random()}" for _ in range(5)] + [texts[3][5:140] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ANCHORS", 100)
    monkeypatch.setattr(suffix_dedup, "FLUSH_RANGES", 2)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_removal(list(enumerate(texts)))


@pytest.mark.parametrize("parts", [(1500, 1500, 1), (2001, 1, 1000), (2500, 400, 1), (1, 1, 30)])
def test_suffix_dedup_of_anchors_that_are_frequent_in_some_tasks(spark, tmp_path, monkeypatch, parts):
    """Tasks that meet an anchor more or less often than the bound still deal its pieces alike."""
    if sum(parts) < 2000:
        monkeypatch.setattr(suffix_dedup, "FREQUENT", 10)
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(140))
    rows, at = [], 0
    for n, size in enumerate(parts):
        some = [(i, f"{i:05}{passage}{i * 7919 % 100_003:06}") for i in range(at, at + size)]
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        rows, at = rows + some, at + size
    docs = spark.read.parquet(*(f"{tmp_path}/{n}" for n in range(len(parts))))
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == brute_removal(rows)


def test_suffix_dedup_refuses_lengths_beyond_its_formats(nothing):
    for length in (19, 276):
        with pytest.raises(ValueError):
            suffix_dedup.suffix_dedup(nothing, length)


def test_columns_sort_suffixes(tmp_path):
    import random

    import numpy as np

    rng = random.Random(0)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))).encode() for _ in range(40)]
    text = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array(list(map(len, texts)))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    anchors = starts + np.array([rng.randrange(n) for n in lengths])
    seen = 0
    for column, order, symbols, common in suffix_dedup.columns_of(text, starts, starts + lengths, anchors, 100, f"file://{tmp_path}"):
        suffixes = [texts[i][anchors[i] + column - starts[i] :] for i in order]
        assert suffixes == sorted(suffixes) and [s[0] for s in suffixes] == symbols.tolist()
        for a, b, n in zip(suffixes, suffixes[1:], common[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        seen += len(order)
    assert seen == lengths.sum()


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
