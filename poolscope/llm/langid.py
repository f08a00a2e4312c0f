"""Language identification by interpolated Kneser-Ney character models.

Texts are read as words of letters, lower-cased, each between the marks `^` and `$`; a model predicts each character of
a word from up to ORDER-1 characters before it. Counts of all training rows are gathered by Spark: tasks count words,
turn them into character grams and sum them per language; continuation counts, totals, probabilities and back-off
weights are groupings and joins over all grams. The models are sorted arrays of 64-bit gram hashes with their
log-probabilities, one pair per language. A document goes to the language with the lowest cross-entropy per character;
a calibrated bound on that cross-entropy marks documents that fit no language.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import materialize, text_slices

ORDER = 5
DISCOUNT = 0.75
#: Characters that an unseen character is one of.
ALPHABET = 2000
#: The rejection bound of a language is MARGIN times this quantile of the cross-entropies of its training rows, counted in
#: bins of so many nats.
CALIBRATION_QUANTILE, BIN, MARGIN = 0.999, 0.001, 1.1
#: If asked, rows are held out of the counts for the bound: about so many, the lowest by hash of the id and text. A language
#: with fewer than MIN_HELD_OUT rows is calibrated on all of its training rows even then.
CALIBRATION_ROWS, CALIBRATION_SHARE, MIN_HELD_OUT = 2000, 0.05, 1000
#: Words a worker remembers with their scores.
CACHED_WORDS = 150_000
#: Grams a counting task holds before it sends them on.
MAX_HELD_GRAMS = 400_000
#: Cross-entropies are turned into probabilities as if a document had so many characters at most.
EFFECTIVE_CHARS = 40
WORDS = re.compile(r"[^\W\d_]+")

GRAMS = "lang string, gram string, n long"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def word_grams(word: str) -> list[str]:
    """Context and predicted character of each position, as one string of up to ORDER characters."""
    marked = f"^{word}$"
    return [marked[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(marked))]


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for what else WORDS matches (as superscript digits), 0 for all others."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.zeros(len(every), np.uint8)
    for found in WORDS.finditer(every):
        out[found.start() : found.end()] = [1 + c.isalpha() for c in found[0]]
    return out


def words_of_texts(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of the texts, in UTF-32; for each word of each text, as words_of has them, its place among
    those, and its text.
    """
    lowered = [text.lower() if text else "" for text in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le"), "<u4")
    inside = letter_kinds()[codes] > 0
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    upto = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in lowered]))
    owner = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
    offsets = np.concatenate([[0], np.cumsum(4 * (ends - starts))])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), owner


def codes_of(grams: list[str]) -> np.ndarray:
    """Code points of strings of up to ORDER characters, a row each, with zeros after them."""
    return np.array(grams, f"<U{ORDER}").view("<u4").reshape(len(grams), ORDER)


def gram_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_grams of all the UTF-32 words as codes_of has them, and the place of each gram's word."""
    before, after = "^".encode("utf-32-le"), "$".encode("utf-32-le")
    codes = np.frombuffer(before + (after + before).join(words) + after, "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4 + 1
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.arange(len(owner)) + owner + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    first = np.maximum(last + 1 - ORDER, starts[owner])
    out = np.zeros((len(owner), ORDER), np.uint32)
    for k in range(ORDER):
        at = first + k
        out[:, k] = np.where(at <= last, codes[np.minimum(at, last)], 0)
    return out, owner


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of code points, and the place of each row among them."""
    rows = pa.Array.from_buffers(pa.binary(4 * ORDER), len(codes), [None, pa.py_buffer(codes)]).dictionary_encode()
    found = np.frombuffer(rows.dictionary.buffers()[1], np.uint32, ORDER * len(rows.dictionary))
    return found.reshape(-1, ORDER), rows.indices.to_numpy()


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a language; partial counts leave each task once per gram."""

    def run(batches):
        words: dict[str, Counter[bytes]] = {}
        grams: dict[str, Counter] = {}

        def fold():
            for lang, counted in words.items():
                into = grams.setdefault(lang, Counter())
                codes, owner = gram_codes(list(counted))
                found, at = distinct(codes)
                times = np.fromiter(counted.values(), np.int64, len(counted))[owner]
                for gram, n in zip(found.view(f"<U{ORDER}")[:, 0].tolist(), np.bincount(at, times).astype(np.int64).tolist()):
                    into[gram] += n
            words.clear()

        for batch in batches:
            known = batch.column(0).to_pylist()
            langs = list(dict.fromkeys(known))
            place = {lang: j for j, lang in enumerate(langs)}
            known = np.array([place[lang] for lang in known], np.int64)
            for at, to, texts in text_slices(batch.column(1)):
                found, index, owner = words_of_texts(texts)
                pairs, times = np.unique(known[at:to][owner] * len(found) + index, return_counts=True)
                for pair, n in zip(pairs.tolist(), times.tolist()):
                    j, i = divmod(pair, len(found))
                    words.setdefault(langs[j], Counter())[found[i]] += n
                if sum(map(len, words.values())) > CACHED_WORDS:
                    fold()
                if sum(map(len, grams.values())) > MAX_HELD_GRAMS:
                    yield from emit(grams)
        fold()
        yield from emit(grams)

    def emit(grams):
        for lang, counted in grams.items():
            names = list(counted)
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array(some), pa.array([counted[g] for g in some], pa.int64())],
                    ["lang", "gram", "n"],
                )
        grams.clear()

    counted = docs.select("lang", "text").mapInArrow(run, GRAMS)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_hash(grams: list[str]) -> np.ndarray:
    """64-bit hashes of strings of up to ORDER characters."""
    return code_hash(codes_of(grams))


def code_hash(codes: np.ndarray) -> np.ndarray:
    """gram_hash of rows of code points."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        out = (out ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Models:
    """Per language: sorted hashes and log-probabilities of its grams, and of its contexts with log back-off weights."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    bound: np.ndarray

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Sum of log-probabilities of each UTF-32 word's characters, one column per language; NaN of words without a letter."""
        codes, owner = gram_codes(words)
        events, at = distinct(codes)
        logs = self.code_scores(events)
        out = np.zeros((len(words), len(self.langs)))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, logs[at, j], len(words))
        letters = letter_kinds()[np.frombuffer(b"".join(words), "<u4")] == 2
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        out[~np.logical_or.reduceat(letters, np.cumsum(sizes) - sizes)] = np.nan
        return out

    def event_scores(self, events: list[str]) -> np.ndarray:
        """Log-probability of each gram's last character after those before it, one column per language."""
        return self.code_scores(codes_of(events))

    def code_scores(self, events: np.ndarray) -> np.ndarray:
        """event_scores of rows of code points."""
        lengths = np.count_nonzero(events, axis=1)
        before = np.where(np.arange(ORDER) < lengths[:, None] - 1, events, 0)
        none = np.zeros_like(events)
        tails = [code_hash(np.hstack([events[:, k:], none[:, :k]])) for k in range(ORDER)]
        heads = [code_hash(np.hstack([before[:, k:], none[:, :k]])) for k in range(ORDER)]
        out = np.zeros((len(events), len(self.langs)))
        for j, ((keys, logs), (contexts, weights)) in enumerate(zip(self.grams, self.contexts)):
            todo = np.arange(len(events))
            for k in range(ORDER):
                hit, at = _find(keys, tails[k][todo])
                out[todo[hit], j] += logs[at[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
                hit, at = _find(contexts, heads[k][todo])
                out[todo[hit], j] += weights[at[hit]]
                last = lengths[todo] == k + 1
                out[todo[last], j] -= np.log(ALPHABET)
                todo = todo[~last]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)), at


def _language_model(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Interpolated Kneser-Ney: probability of each seen gram and back-off weight of each seen context, of few grams.

    kneser_ney gives the same of any number of grams.

    Grams of ORDER characters, and shorter ones at a word's start, use counts; all others use the number of different
    characters seen before them.
    """
    levels: dict[int, Counter] = {k: Counter() for k in range(1, ORDER + 1)}
    for gram, n in counts.items():
        levels[len(gram)][gram] += n
    for k in range(ORDER, 1, -1):
        for gram in levels[k]:
            if not gram[1:].startswith("^"):
                levels[k - 1][gram[1:]] += 1
    probability: dict[str, float] = {}
    weight: dict[str, float] = {}
    for k in range(1, ORDER + 1):
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in levels[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        for context, n in total.items():
            weight[context] = DISCOUNT * kinds[context] / n
        for gram, n in levels[k].items():
            context = gram[:-1]
            lower = probability.get(gram[1:], weight.get("", 1.0) / ALPHABET) if k > 1 else 1 / ALPHABET
            probability[gram] = max(n - DISCOUNT, 0) / total[context] + weight[context] * lower
    return probability, weight


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, context, name, log) of the (lang, gram, n) rows: log-probabilities of all grams, and log back-off weights
    of all contexts. No gram is left out; what is shared by many grams is joined, not held in a task.
    """
    size = F.length("gram")
    level = {ORDER: counts.filter(size == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        after = level[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        both = after.unionByName(counts.filter(size == k)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        level[k] = materialize(both, "langid-level")
    out, lower = [], None
    for k in range(1, ORDER + 1):
        context = F.expr(f"substring(gram, 1, {k - 1})").alias("context")
        rows = level[k].select("lang", "gram", "n", context)
        totals = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), (DISCOUNT * F.count(F.lit(1)) / F.sum("n")).alias("weight")
        )
        totals = materialize(totals, "langid-contexts")
        rows = rows.join(totals, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("lower", F.lit(1 / ALPHABET))
        else:
            rows = rows.withColumn("tail", F.expr("substring(gram, 2)")).join(lower, ["lang", "tail"])
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        fitted = materialize(rows.select("lang", "gram", p.alias("p")), "langid-grams")
        lower = fitted.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
        out.append(fitted.select("lang", F.lit(False).alias("context"), F.col("gram").alias("name"), F.log("p").alias("log")))
        out.append(totals.select("lang", F.lit(True).alias("context"), F.col("context").alias("name"), F.log("weight").alias("log")))
    return reduce(DataFrame.unionByName, out)


def hashed(logs: DataFrame) -> DataFrame:
    """The same with 64-bit hashes for names."""

    def run(batches):
        for batch in batches:
            keys = pa.array(gram_hash(batch.column(2).to_pylist()).view(np.int64))
            columns = [batch.column(0), batch.column(1), keys, batch.column(3).cast(pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "context", "name", "log"])

    return logs.select("lang", "context", "name", "log").mapInArrow(run, "lang string, context boolean, name long, log float")


def _ordered(keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], logs[order].astype(np.float32)


def build(models: dict[str, tuple[dict[str, float], dict[str, float]]]) -> Models:
    """Models of each language's probabilities and back-off weights."""
    langs = sorted(models)
    arrays = [[_ordered(gram_hash(list(d)), np.log(list(d.values()))) for d in models[lang]] for lang in langs]
    return Models(langs, [a[0] for a in arrays], [a[1] for a in arrays], np.full(len(langs), np.inf))


def collect_models(logs: DataFrame) -> Models:
    """Models of the rows of kneser_ney: 12 bytes a gram and a context, fetched language by language."""
    rows = materialize(hashed(logs), "langid-model")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    found: dict[bool, list] = {False: [], True: []}
    for lang in langs:
        for context, into in found.items():
            own = rows.filter((F.col("lang") == lang) & (F.col("context") == context)).select("name", "log").toArrow()
            into.append(_ordered(own["name"].to_numpy().view(np.uint64), own["log"].to_numpy()))
    return Models(langs, found[False], found[True], np.full(len(langs), np.inf))


def score_texts(models: Models, texts: list[str | None], cache: dict[bytes, int], table: list[np.ndarray]):
    """Per text: characters scored, and the cross-entropy under each language."""
    words, index, owner = words_of_texts(texts)
    if len(cache) > CACHED_WORDS:
        cache.clear()
        table[0] = np.zeros((0, len(models.langs)))
    new = [w for w in words if w not in cache]
    if new:
        cache.update(zip(new, range(len(table[0]), len(table[0]) + len(new))))
        table[0] = np.vstack([table[0], models.word_scores(new)])
    scores = table[0][np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]
    bare = np.isnan(scores[:, 0])
    scores[bare] = 0
    sizes = np.where(bare, 0, np.fromiter(map(len, words), np.int64, len(words)) // 4 + 1)
    chars = np.bincount(owner, sizes[index], len(texts)).astype(np.int64)
    out, good = np.full((len(texts), len(models.langs)), np.nan), chars > 0
    for j in range(len(models.langs)):
        out[good, j] = -np.bincount(owner, scores[index, j], len(texts))[good] / chars[good]
    return chars, out


def _probability(cross: np.ndarray, chars: np.ndarray) -> np.ndarray:
    z = -cross * np.minimum(chars, EFFECTIVE_CHARS)[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def calibration_shares(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Per language: the share of its rows to calibrate on, and the share to hold out of the counts."""
    lettered = rows.filter(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in lettered.groupBy("lang").count().collect()}
    held = {lang: min(CALIBRATION_SHARE, CALIBRATION_ROWS / n) for lang, n in sizes.items() if n >= MIN_HELD_OUT}
    return {lang: held.get(lang, 1.0) for lang in sizes}, held


def _below(shares: dict[str, float]):
    """Whether a row's hash is below its language's share of all hashes."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")] if shares else F.lit(None)
    return F.coalesce(place < share, F.lit(False))


def calibrate(models: Models, rows: DataFrame) -> None:
    """Set each language's bound from the cross-entropies of its (lang, text) rows."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = held.value
        cache, table = {}, [np.zeros((0, len(models.langs)))]
        place = {lang: j for j, lang in enumerate(models.langs)}
        for batch in batches:
            langs = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            for at, to, texts in text_slices(batch.column(1)):
                chars, cross = score_texts(models, texts, cache, table)
                good = np.flatnonzero((chars > 0) & (langs[at:to] >= 0))
                own = cross[good, langs[at:to][good]]
                yield pa.RecordBatch.from_arrays([pa.array(langs[at:to][good], pa.int32()), pa.array(own)], ["j", "own"])

    own = rows.select("lang", "text").mapInArrow(run, "j int, own double")
    for j, bound in bounds(own, "j").items():
        models.bound[j] = bound


def bounds(rows: DataFrame, key: str) -> dict:
    """Per key the rejection bound of its rows' `own` cross-entropies: all rows are counted, in bins."""
    bins: dict = {}
    counted = rows.filter("own is not null").groupBy(key, F.floor(F.col("own") / BIN).alias("bin")).count()
    for r in counted.collect():
        bins.setdefault(r[key], []).append((r["bin"], r["count"]))
    out = {}
    for name, found in bins.items():
        found.sort()
        upto = np.cumsum([n for _, n in found])
        out[name] = MARGIN * BIN * (found[int(np.searchsorted(upto, CALIBRATION_QUANTILE * upto[-1]))][0] + 1)
    return out


def teaching(docs: DataFrame) -> DataFrame:
    """The (doc_id, lang, text) rows that teach: those with text and language."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")


def fit(rows: DataFrame) -> Models:
    """Models of all grams of the given (lang, text) rows, without bounds."""
    return collect_models(kneser_ney(materialize(count_grams(rows), "langid-counts")))


def train(docs: DataFrame, hold_out: bool = False) -> Models:
    """Models of all languages of the given (doc_id, text, lang) rows. Rows without text or language teach nothing.

    All rows are counted, and the bounds are of all rows; with hold_out, the bounds are of some that are not counted.
    """
    rows = teaching(docs)
    if not hold_out:
        models = fit(rows)
        if models.langs:
            calibrate(models, rows)
        return models
    shares, held_out = calibration_shares(rows)
    models = fit(rows.filter(~_below(held_out)))
    if not models.langs:
        return models
    calibrate(models, rows.filter(_below(shares)))
    if np.isinf(models.bound).any():  # no held-out row fell to a language, as where its ids repeat
        left = [lang for lang, b in zip(models.langs, models.bound) if np.isinf(b)]
        calibrate(models, rows.filter(F.col("lang").isin(left)))
    return models


def answer(models: Models, texts: list[str | None], cache: dict[str, int], table: list[np.ndarray], known: list | None = None) -> list[pa.Array]:
    """Language, score, cross-entropy and rejection of each text; if languages are known, the cross-entropy under each text's own."""
    own = np.full(len(texts), np.nan)
    langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    lowest, rejected = np.full(len(texts), np.nan), np.zeros(len(texts), bool)
    if models.langs:
        chars, cross = score_texts(models, texts, cache, table)
        good = np.flatnonzero(chars)
        if len(good):
            best = cross[good].argmin(1)
            langs[good] = np.array(models.langs, object)[best]
            scores[good] = _probability(cross[good], chars[good])[np.arange(len(good)), best]
            lowest[good] = cross[good, best]
            rejected[good] = lowest[good] > models.bound[best]
            if known is not None:
                place = {lang: j for j, lang in enumerate(models.langs)}
                mine = np.array([place.get(x, -1) for x in known])
                good = good[mine[good] >= 0]
                own[good] = cross[good, mine[good]]
    out = [pa.array(langs, pa.string()), pa.array(scores), pa.array(lowest, from_pandas=True), pa.array(rejected)]
    return out if known is None else [*out, pa.array(own, from_pandas=True)]


def identify(docs: DataFrame, taught) -> DataFrame:
    """predict for every (doc_id, text, lang) row, by models and bounds of all rows where taught holds.

    Each text is scored once: the bounds come of the scores of the rows that taught, and reject afterwards. A row's
    language tells only which bound its score counts for.
    """
    models = fit(teaching(docs.filter(taught)))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = held.value
        cache, table = {}, [np.zeros((0, len(models.langs)))]
        for batch in batches:
            known = batch.column(2).to_pylist()
            for at, to, texts in text_slices(batch.column(1)):
                got = answer(models, texts, cache, table, known[at:to])
                columns = [batch.column(0).slice(at, to - at), *got[:3], batch.column(2).slice(at, to - at), got[4]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "cross_entropy", "known", "own"])

    known = F.when(taught, F.col("lang")).alias("known")
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), known)
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, known string, own double"
    scored = materialize(narrow.mapInArrow(run, schema), "langid-scores")
    found = bounds(scored, "known")
    bound = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[F.col("lang_pred")] if found else F.lit(None)
    return scored.select("doc_id", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > bound, F.lit(False)).alias("rejected"))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row.

    Null texts and texts without a letter get `und` and score 0; so do all rows if nothing was learned. Repeated rows
    get the same answer; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = held.value
        cache, table = {}, [np.zeros((0, len(models.langs)))]
        for batch in batches:
            for at, to, texts in text_slices(batch.column(1)):
                columns = [batch.column(0).slice(at, to - at), *answer(models, texts, cache, table)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
