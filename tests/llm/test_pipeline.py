import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolscope.llm import mixing, toxicity
from poolscope.llm.common import materialize
from tests.llm.test_dedup import SPACE, shingles
from tests.llm.test_text import poisson

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_stages_keep_the_columns(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, stages):
    docs = stages["documents"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    want = sorted(r["doc_id"] for r in scores if r["predicted"] == 0)
    assert sorted(r["doc_id"] for r in stages["toxicity"].collect()) == want


def test_exact_copies_go(stages):
    best = {}
    for r in stages["toxicity"].collect():
        key = SPACE.sub("", r["text"] or "")
        best[key] = min(best.get(key, (0, float("inf"))), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(i for _, i in best.values()) == sorted(r["doc_id"] for r in stages["exact_dedup"].collect())


def test_one_of_each_near_group_stays(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages["exact_dedup"].collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert sorted({find(i) for i in ids}) == sorted(r["doc_id"] for r in stages["near_dedup"].collect())


def test_mixing_repeats_by_poisson(stages):
    import hashlib

    docs = stages["near_dedup"]
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(docs).collect()}
    want = collections.Counter()
    for r in docs.collect():
        u = (int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[r["doc_id"]] += poisson(u, rates[r["source"]])
    assert collections.Counter(r["doc_id"] for r in stages["mixing"].collect()) == +want


def test_packing_holds_every_token(stages):
    pieces = stages["packing"].collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in stages["mixing"].collect())
    used = collections.Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_run_gives_the_same_rows(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    count = lambda df: collections.Counter(tuple(r) for r in df.select(*columns).collect())
    assert count(corpus_pipeline.run(spark, SF)) == count(stages["packing"])


@pytest.fixture(scope="module")
def sf(spark, messy, nothing, tmp_path_factory):
    """Folders with the labels that the stages read: of the messy rows, and none."""
    out = {}
    for name, rows in (("messy", [(i, i % 2, int(i in (4, 5))) for i in range(30)]), ("nothing", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{out[name]}/labels.parquet")
    return out


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_rows(spark, messy, nothing, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = messy.withColumns({"copy": F.lit(77), "shuffle_key": F.lit("mine"), "rows": F.lit(3)})
    for docs, folder in ((rows, "messy"), (nothing, "nothing")):
        docs = materialize(docs, "odd")
        got = stage(spark, docs, sf[folder])
        if name == "packing":
            count = got.filter("piece = 0").count()
            assert count == docs.count()
            continue
        assert got.columns == docs.columns
        held = collections.Counter(str(tuple(r)) for r in docs.collect())
        kept = collections.Counter(str(tuple(r)) for r in got.collect())
        assert set(kept) <= set(held)  # whole rows of the input, values of clashing columns included
        if name == "exact_dedup":
            texts = {SPACE.sub("", r["text"] or "") for r in docs.collect()}
            assert sum(kept.values()) == len(texts)
        if name == "near_dedup":
            alone = [r for r in docs.collect() if r["doc_id"] is None or not shingles(r["text"])]
            assert all(kept[str(tuple(r))] == held[str(tuple(r))] for r in alone)
        if name == "toxicity":
            assert all(kept[k] in (0, n) for k, n in held.items())


def test_run_of_nothing(spark, nothing, sf):
    nothing.write.mode("overwrite").parquet(f"{sf['nothing']}/documents.parquet")
    assert corpus_pipeline.run(spark, sf["nothing"]).count() == 0
