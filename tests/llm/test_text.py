import collections
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolscope.llm import langid, mixing, packing, toxicity

TINY = "/root/testdata/sf0.001"


def test_packing_matches_the_tokenizer(messy):
    import public_tokenizers
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(messy.filter("doc_id is not null"), capacity=64, open_bins=3).collect()
    rows = {r["doc_id"]: r["text"] for r in messy.collect()}
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows.items()}
    pieces = collections.defaultdict(set)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 64 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].add((r["piece"], r["start"], r["length"]))
    for i, have in pieces.items():
        assert sum(n for _, _, n in have) == len(ids[i]) and sorted(have)[0][1] == 0
        assert all(n == 64 for _, _, n in sorted(have)[1:])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_parts_leave_the_ids_as_they_are(monkeypatch):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert encoder.byte_level and not packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).byte_level
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = np.random.default_rng(8)
    marks = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\r", "\x1c", "\x85", "\u2003", "\u200b", "é", "你", "7", "'s", "<|endoftext|>", "!", "😀", "\u0300"]
    common = [m for m in marks if not packing.UNCLEAR_SPACE.search(m)]
    texts = ["".join(rng.choice(some, 200)) for some in (marks, common) for _ in range(150)] + ["", " ", "\n\n", " a ", "a \n b"]
    every = "".join(f"a{c} {c}{c}\n{c}b" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000, 3)]))
    texts += [every[k : k + 5000] for k in range(0, len(every), 5000)]
    assert all("".join(encoder.parts(t)) == t for t in texts)
    for at in range(0, len(texts), 20):
        some = texts[at : at + 20]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)]
        assert got == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
    # a character is no white space for any of the libraries involved, or the text is not split
    letters = [chr(c) for c in range(0x3200) if not packing.UNCLEAR_SPACE.match(chr(c)) and chr(c) not in "\t\n\x0b\x0c\r "]
    assert not any(c.isspace() for c in letters)
    got = encoder.encode([f"{c} b\n" for c in letters])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in plain.encode_batch([f"{c} b\n" for c in letters], add_special_tokens=False)]


def test_packing_reads_a_word_once_whatever_stands_beside_it():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain, given = packing.Encoder(path), tokenizers.Tokenizer.from_file(path), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(300)]
    texts = [" ".join(f"{a}{w}{b}" for w in words) for a in ("", "(", "7") for b in ("", ",", ".", "'s", "!)", ": x")]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, given)) < 3 * sum(map(len, words))  # of 18 times so much text


def test_parts_of_ascii_leave_the_ids_as_they_are(monkeypatch):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    rng = np.random.default_rng(10)
    visible = [*map(chr, range(128)), *[" ", "'", "s", "\n"] * 9, "'s", "'re", "'ll", "  "]
    odd = [*visible, *["é", "\u0300", "—", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "<|endof"] * 5]
    texts = ["".join(rng.choice(some, rng.integers(0, 80))) for some in (visible, odd) for _ in range(1500)]
    assert all("".join(encoder.parts(t)) == t for t in texts)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)]
        assert got == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
    no_ids = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert no_ids.encode([" ", ""]) == [b"", b""] and no_ids.encode([]) == []


def test_packing_of_very_long_texts(spark):
    import public_tokenizers

    texts = {1: " " * 2_000_000 + "a", 2: "a" * 2_000_000, 3: "\n" * 1_000_000, 4: "word " * 400_000}
    tokenizer = packing.encoder_of(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    got = collections.Counter()
    for r in packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_packing_is_tight_however_the_rows_are_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64)
    got = packing.pack(docs).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("sequences")).first()
    assert got["sequences"] <= 1.02 * math.ceil(got["tokens"] / packing.CAPACITY)


def test_packing_query_has_the_contract_columns(spark):
    from poolscope.llm import queries

    rows = queries.op8_packing(spark, TINY)
    assert rows.schema.simpleString() == f"struct<{packing.SCHEMA}>".replace(" long", ":bigint").replace(" int", ":int").replace(", ", ",")
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{TINY}/documents.parquet").count()


def test_open_bins_against_brute_force():
    rng = np.random.default_rng(0)
    bins, free = packing.OpenBins(50, 4, 0), []
    for length in rng.integers(1, 51, 2000).tolist():
        want = min([f for f in free if f >= length], default=50)
        _, offset = bins.place(length)
        assert 50 - offset == want
        if want in free:
            free.remove(want)
        elif length < 50 and len(free) >= 4:
            free.remove(min(free))
        if want > length:
            free.append(want - length)
        assert len(free) == bins.count <= 4


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_matches_brute_force(messy):
    got = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix(messy).collect())
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(messy).collect()}
    want = collections.Counter()
    import hashlib

    for r in messy.collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        u = (int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[(r["doc_id"], r["source"])] += poisson(u, rates[r["source"]])
    assert got == +want


def test_mixing_meets_target_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = collections.Counter(r["source"] for r in mixing.mix(docs, {"a": 3.0, "b": 1.0}).collect())
    assert abs(got["a"] - 4500) < 300 and abs(got["b"] - 1500) < 200
    assert {r["source"] for r in mixing.mix(docs, {"a": 1.0}).collect()} == {"a"}


def test_mixing_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


def test_kneser_ney_sums_to_one():
    counts = collections.Counter(g for w in ["abba", "abc", "cab", "bad"] * 3 + ["cabbage"] for g in langid.word_grams(w))
    probability, weight = langid._language_model(counts)
    seen = {g[-1] for g in counts}
    models = langid.build({"x": (probability, weight)})
    for context in ("", "a", "^", "ab", "^ab", "cabb"):
        p = np.exp(models.event_scores([context + c for c in seen])[:, 0])
        rest = np.exp(models.event_scores([context + "\u4e00"])[0, 0])
        assert abs(p.sum() + rest * (langid.ALPHABET - len(seen)) - 1) < 1e-3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    models = langid.train(docs.filter(part != 0))
    got = langid.predict(docs.filter(part == 0), models).join(docs, "doc_id")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()


def test_language_of_odd_texts(spark, messy, nothing):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    models = langid.train(docs)
    texts = [(1, None), (2, ""), (3, "12 34 !?"), (4, "²³"), (5, "the"), (6, "z" * 50_000)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), models).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5]["lang_pred"] in models.langs
    assert got[6]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(nothing, models).count() == 0 and langid.predict(messy, models).count() == messy.count()
    untaught = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.predict(messy, untaught).collect()} == {"und"}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    transition = rng.normal(size=(2, 2))
    lengths = np.array([1, 4, 0, 3])
    emission = rng.normal(size=lengths.sum())
    got, pairs = toxicity.marginals(emission, lengths, transition)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        weights, marks = [], []
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            score = sum(emission[at + k] * y[k] for k in range(n)) + sum(transition[y[k], y[k + 1]] for k in range(n - 1))
            weights.append(math.exp(score))
            marks.append(y)
        total = sum(weights)
        for k in range(n):
            assert got[at + k] == pytest.approx(sum(w for w, y in zip(weights, marks) if y[k]) / total)
        for w, y in zip(weights, marks):
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += w / total
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_toxicity_finds_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    field = toxicity.train(docs, labels.filter(part != 2))
    asked = docs.join(labels.filter(part == 2), "doc_id")
    got = toxicity.score(asked, field).join(asked.select("doc_id", "lang", "text", "toxic"), "doc_id").collect()
    for lang in {r["lang"] for r in got}:  # a few labels are wrong on purpose
        toxic = [r["predicted"] for r in got if r["lang"] == lang and r["toxic"] == 1]
        clean = [r["predicted"] for r in got if r["lang"] == lang and r["toxic"] == 0]
        assert sum(toxic) >= 0.8 * len(toxic) > 0 and sum(clean) <= 0.05 * len(clean), lang
    for r in got:
        for span in r["spans"]:
            assert r["text"].lower()[span["start"] : span["end"]].strip()


def test_toxicity_query_learns_from_labels_of_its_split_only(spark):
    from poolscope.llm import queries

    got = queries.op9_toxicity(spark, TINY)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")
    ]
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels = [r for r in spark.read.parquet(f"{TINY}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    field = toxicity.train(docs, spark.createDataFrame(labels))
    want = {r["doc_id"]: r["score"] for r in toxicity.score(docs, field).collect()}
    rows = got.collect()
    assert len(rows) == docs.count() and {r["doc_id"]: r["score"] for r in rows} == pytest.approx(want)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)


def test_evidence_rests_on_every_marginal():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 0, 40, 1])
    toxic = rng.random(lengths.sum()) ** 3
    got, at = toxicity.evidence(toxic, lengths), 0
    for n, z in zip(lengths, got):
        none = np.prod(1 - toxic[at : at + n] ** toxicity.READINGS)
        assert z == pytest.approx(np.clip(np.log(max(1 - none, 1e-12) / none), -20, 20))
        at += n


def sample_of(texts, toxic):
    return pa.table({"text": pa.chunked_array([texts]), "toxic": toxic})


def test_toxicity_of_odd_texts(spark, messy, nothing):
    texts = ["you idiot"] * 3 + ["fine words"] * 3 + [f"idiot number {k}" for k in range(9)] + [f"calm {k}" for k in range(40)]
    marks = [1] * 3 + [0] * 3 + [1] * 9 + [0] * 40
    field = toxicity.fit(sample_of(texts, marks))
    rows = toxicity.score(messy, field).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows) and toxicity.score(nothing, field).count() == 0
    assert toxicity.keep_clean(messy, field).columns == messy.columns
    long = spark.createDataFrame([(1, "calm 3 " * 60_000), (2, "calm 3 " * 30_000 + "you idiot " + "calm 4 " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["predicted"], r["spans"]) for r in toxicity.score(long, field).collect()}
    assert got[1] == (0, []) and got[2][0] == 1 and [tuple(s) for s in got[2][1]] == [(210_004, 210_009)]
    alone = toxicity.fit(sample_of([t for t, y in zip(texts, marks) if not y], [0] * 43))
    assert toxicity.score(messy, alone).filter("predicted = 1").count() == 0


def test_labelled_sample_of_odd_labels(spark, messy, nothing):
    labels = spark.createDataFrame([(3, 0), (3, 1), (4, 0), (5, None), (None, 1), (6, 0), (6, 0), (999, 1)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(messy, labels).orderBy("doc_id").collect()
    assert [r["toxic"] for r in sample] == [1, 0, 0]
    assert toxicity.labelled_sample(nothing, labels).count() == 0 and toxicity.labelled_sample(messy, labels.limit(0)).count() == 0
    assert toxicity.train(nothing, labels).line[1] < -5
    assert toxicity.train(messy, labels.filter("toxic = 0")).line[1] < -5


def test_labelled_sample_is_bounded_by_whole_rows(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2600)
    sample = toxicity.labelled_sample(docs, labels).toArrow()
    assert sorted(sample.column("toxic").to_pylist()) == [0] * 5 + [1] * 5
    assert set(sample.column("text").to_pylist()) == {"word " * 100}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10)
    assert sorted(r["toxic"] for r in toxicity.labelled_sample(docs, labels).collect()) == [0, 1]


def test_near_copies_against_brute_force():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = [" ".join(rng.choice(vocabulary, 100)) + " " + passage for _ in range(60)]
    for k in range(20):
        words = texts[k].split(" ")
        for at in rng.integers(0, len(words), 1 + k % 9):
            words[at] = f"edit{at}"
        texts.append(" ".join(words))
    texts += ["", "one", "one", "one two three four", texts[3]]
    toxic = np.array([k % 2 == 1 for k in range(len(texts))])

    def runs(text):
        words = text.split()
        return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))}

    kept = []
    for k, (text, y) in enumerate(zip(texts, toxic)):
        mine = runs(text)
        if not any(y == z and len(mine & other) >= 0.8 * len(mine | other) for _, z, other in kept):
            kept.append((k, y, mine))
    words, _ = toxicity.numbered(pa.chunked_array([texts]))
    assert toxicity.without_near_copies(words, toxic).tolist() == [k for k, *_ in kept]
    assert 60 <= len(kept) < len(texts)


def test_whole_sampled_texts_are_learned(spark):
    rng = np.random.default_rng(6)
    calm = lambda n: " ".join(f"{a}{k}" for a, k in zip(rng.choice(["calm", "fine", "good", "mild"], n), rng.integers(0, 500, n)))
    rows = [(i, f"{calm(2000)} idiot {calm(5)}", 1) for i in range(40)] + [(i, f"{calm(2000)} {calm(5)}", 0) for i in range(40, 100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels).toArrow()
    assert sorted(sample.column("text").to_pylist()) == sorted(t for _, t, _ in rows)
    field = toxicity.fit(sample)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, field).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_models_keep_all_grams(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_GRAMS", 100, raising=False)
    docs = spark.read.parquet(f"{TINY}/documents.parquet").filter("lang in ('en', 'de')").limit(60).cache()
    models = langid.train(docs)
    counts: dict = {}
    for r in langid.count_grams(docs.filter("text is not null")).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    want = langid.build({lang: langid._language_model(c) for lang, c in counts.items()})
    events = sorted({g for c in counts.values() for g in c} | {"^zqx", "xqzzy", "一", "ab一"})
    assert models.langs == want.langs
    assert models.event_scores(events) == pytest.approx(want.event_scores(events), abs=1e-4)


def test_every_language_gets_a_bound(spark):
    rows = [(i, f"plain english words {i} of many" + " and more" * (i % 7), "en") for i in range(1500)]
    rows += [(5000 + i, f"wenige deutsche wörter {i} " + "und mehr " * (i % 3), "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    models = langid.train(docs)
    assert models.langs == ["de", "en"] and np.isfinite(models.bound).all()
    texts = spark.createDataFrame([(1, "qqxzj vvkkq zzxqj"), (2, rows[0][1]), (3, rows[-1][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(texts, models).collect()}
    assert got == {1: True, 2: False, 3: False}
    shares, held = langid.calibration_shares(docs)
    assert held == {"en": 0.05} and shares == {"en": 0.05, "de": 1.0}


def test_all_taught_rows_are_counted_and_calibrate(spark):
    rows = [(i, f"plain english words {i} of many" + " and more" * (i % 7), "en") for i in range(1500)]
    rows += [(2000 + i, "wenige deutsche wörter", "de") for i in range(40)] + [(3000, "qqxzj vvkkq zzxqj", "en"), (3001, None, "en"), (3002, "12", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    taught = F.col("doc_id") % 5 != 0
    models = langid.train(docs.filter(taught))
    counts: dict = {}
    for r in langid.count_grams(langid.teaching(docs.filter(taught))).collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    want = langid.build({lang: langid._language_model(c) for lang, c in counts.items()})
    assert [len(keys) for keys, _ in models.grams] == [len(keys) for keys, _ in want.grams]
    _, cross = langid.score_texts(models, [t for i, t, lang in rows if lang == "en" and t and i % 5], {}, [np.zeros((0, 2))])
    at = np.sort(cross[:, models.langs.index("en")])[int(np.ceil(0.999 * len(cross))) - 1]
    assert models.bound[models.langs.index("en")] == pytest.approx(1.1 * at, abs=0.0012)
    got = {r["doc_id"]: tuple(r)[1:] for r in langid.identify(docs, taught).collect()}
    plain = {r["doc_id"]: tuple(r)[1:] for r in langid.predict(docs, models).collect()}
    assert got.keys() == plain.keys() and all(got[i] == pytest.approx(plain[i]) for i in got if i < 3001) and got[3001] == plain[3001] == ("und", 0.0, None, False)


def test_words_and_grams_by_arrays_are_those_of_texts(spark):
    texts = [None, "", "12 34 !?", "²³ a² _x_1y٣z", "ΑΣ", "Σ ΑΣΑ ΟΔΟΣ\n", "İstanbul ﬁ 𝒳𝒴 𐐀𐐁 日本語", "a\0b\nab ab AB", "z" * 3000, "ǅ ẞ", "a\u0301b"]
    words, index, owner = langid.words_of_texts(texts)
    words = [w.decode("utf-32-le") for w in words]
    want = [(k, w) for k, text in enumerate(texts) if text for w in langid.words_of(text)]
    assert [(k, words[i]) for k, i in zip(owner, index)] == want and len(set(words)) == len(words)
    codes, owner = langid.gram_codes([w.encode("utf-32-le") for w in words])
    grams = codes.view(f"<U{langid.ORDER}")[:, 0].tolist()
    assert list(zip(owner, grams)) == [(k, g) for k, w in enumerate(words) for g in langid.word_grams(w)]
    rows = [(lang, text) for k, text in enumerate(texts) for lang in ("x", "y")[: 1 + k % 2]]
    counts = collections.Counter((lang, g) for lang, text in rows if text for w in langid.words_of(text) for g in langid.word_grams(w))
    got = langid.count_grams(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()
    assert {(r["lang"], r["gram"]): r["n"] for r in got} == counts and len(got) == len(counts)


def test_scoring_costs_no_more_than_reading_words_and_grams():
    random.seed(7)
    texts = [" ".join("".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(400)) for _ in range(500)]
    counts = collections.Counter(g for text in texts[:50] for w in langid.words_of(text) for g in langid.word_grams(w))
    models = langid.build({lang: langid._language_model(counts) for lang in "wxyz"})

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    score = [seconds(lambda: langid.score_texts(models, texts, {}, [np.zeros((0, 4))])) for _ in range(3)]
    read = [seconds(lambda: collections.Counter(g for text in texts for w in langid.words_of(text) for g in langid.word_grams(w))) for _ in range(3)]
    assert min(score) < 1.5 * min(read), (score, read)
