"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of documents; token labels are derived from them: in toxic documents, tokens with a word or word start that
many toxic and next to no clean documents hold are toxic. The field has two states, features of the word and its first
letters, and transitions; it is fitted on a bounded sample of labelled rows, held as integer word numbers. Scoring runs
over whole texts of all rows: forward-backward marginals of all tokens, aggregated to a document score, with the
character offsets of toxic spans.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.common import BASE, mix64, text_slices

#: Bounds of the labelled sample: so many rows per class, the lowest by hash of the id, with their whole texts, which
#: together have so many bytes at most (one row is always taken).
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2500, 24_000_000
#: A word or word start marks toxic tokens if in so many toxic documents and so much more often than in clean ones.
MIN_SUPPORT, MIN_SHARE, MIN_LIFT = 4, 0.01, 40.0
STARTS = (4, 5, 6, 7)
HASH_BITS = 21
#: Longer words are told apart by so many letters and their length.
WORD_CHARS = 32
STEPS, BATCH, RATE, L2 = 200, 128, 0.5, 1e-6
#: Training windows: tokens kept around each toxic token. A document without one is learned as a whole.
WINDOW = 12
#: What is learned is cut into sequences of so many tokens at most; none is left out.
SEQUENCE = 300
#: Rows of one label whose runs of so many words agree to this share (Jaccard) count once in the sample.
NEAR_RUN, NEAR_SHARE = 4, 0.8
THRESHOLD = 0.3
SPAN_THRESHOLD = 0.5
#: A document's score is about some token that so many independent readings of the field all mark; every token counts,
#: and the many faint marginals of a long text add next to nothing.
READINGS = 2
CACHED_WORDS = 150_000
#: Tokens of the sample that are scored at once.
SLICE_TOKENS = 200_000
TOKEN = re.compile(r"[^\W_]+")


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each word's features, the word and its starts, one row per word; the mask tells which it has.

    A start counts only for longer words.
    """
    n = len(words)
    codes = np.array(words, dtype=f"<U{WORD_CHARS}").view("<u4").reshape(n, WORD_CHARS)
    sizes = np.fromiter(map(len, words), np.uint64, n)
    state, found = np.full(n, 0xCBF29CE484222325, np.uint64), []
    for k in range(min(WORD_CHARS, int(sizes.max()) if n else 0)):
        state = np.where(codes[:, k] > 0, (state ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), state)
        if k + 1 in STARTS:
            found.append((state + np.uint64(k + 1), sizes > k + 1))
    found.append((state + (sizes << np.uint64(8)), np.ones(n, bool)))
    while len(found) <= len(STARTS):
        found.insert(0, (state, np.zeros(n, bool)))
    return mix64(np.stack([h for h, _ in found], 1)), np.stack([m for _, m in found], 1)


def places_of(hashed: np.ndarray) -> np.ndarray:
    """Places of feature hashes in the table of weights."""
    return (hashed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Field:
    """Weights of the toxic state against the clean one, log transition scores, and the score's logistic line."""

    weights: np.ndarray
    transition: np.ndarray
    line: tuple[float, float]

    def emissions(self, words: list[str]) -> np.ndarray:
        hashed, mask = slots_of(words)
        return (self.weights[places_of(hashed)] * mask).sum(1)


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once, laid end to end in `emission`.

    Returns each token's probability of the toxic state, and summed pair marginals (2 x 2). Sequences are walked
    longest first, so that at each step only those that still have a token take part.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    toxic, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    if not len(size) or not size[0]:
        return toxic, pairs
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    t = np.exp(transition)
    growth = np.exp(np.clip(emission, -30, 30))
    odds = np.zeros(len(emission))  # forward odds of the toxic state
    at = first[: active[0]]
    odds[at] = growth[at]
    for i in range(1, size[0]):
        before, at = first[: active[i]] + i - 1, first[: active[i]] + i
        o = odds[before]
        odds[at] = growth[at] * (t[0, 1] + o * t[1, 1]) / (t[0, 0] + o * t[1, 0])
    back = np.ones(len(emission))  # backward ratio, toxic over clean
    for i in range(int(size[0]) - 2, -1, -1):
        at, after = first[: active[i + 1]] + i, first[: active[i + 1]] + i + 1
        ahead = growth[after] * back[after]
        back[at] = (t[1, 0] + t[1, 1] * ahead) / (t[0, 0] + t[0, 1] * ahead)
        o = odds[at]
        cell = np.stack([np.full(len(o), t[0, 0]), t[0, 1] * ahead, o * t[1, 0], o * t[1, 1] * ahead])
        pairs += (cell / cell.sum(0)).sum(1).reshape(2, 2)
    both = odds * back
    return both / (1 + both), pairs


def numbered(texts: pa.ChunkedArray) -> tuple[list[np.ndarray], list[str]]:
    """Each text's tokens as numbers, and the word of each number. No token is held as a string of its own."""
    ids: dict[str, int] = {}
    found = []
    for chunk in texts.chunks:
        for _, _, some in text_slices(chunk):
            for text in some:
                found.append(np.array([ids.setdefault(w, len(ids)) for w in TOKEN.findall((text or "").lower())], np.int32))
    return found, list(ids)


def runs_of(words: list[np.ndarray]) -> list[np.ndarray]:
    """Per text: its different runs of NEAR_RUN words, numbered so that those of the fewest texts come first.

    Runs that no other text holds are counted, not listed: -1 comes once for each.
    """
    hashed = []
    for w in words:
        w = np.pad(w.astype(np.uint64) + np.uint64(1), (0, max(0, NEAR_RUN - len(w))))
        code = np.zeros(len(w) - NEAR_RUN + 1, np.uint64)
        for k in range(NEAR_RUN):
            code = mix64(code * np.uint64(BASE) + w[k : len(w) - NEAR_RUN + 1 + k])
        hashed.append(np.unique(code))
    every, back, held = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
    del every
    rank = np.empty(len(held), np.int32)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held), dtype=np.int32)
    rank[held == 1] = -1
    return [np.sort(r) for r in np.split(rank[back], np.cumsum([len(h) for h in hashed])[:-1])]


def near_copies(words: list[np.ndarray]) -> np.ndarray:
    """Whether each text is a near copy of an earlier one that is none: their runs of words agree to NEAR_SHARE (Jaccard).

    Sets that agree so far share one of the rarest 1 - NEAR_SHARE of their runs, so only those are looked up; what is
    found is compared in full.
    """
    copies = np.zeros(len(words), bool)
    if not len(words):
        return copies
    runs = runs_of(words)
    kept: dict[int, list[int]] = {}
    for i, mine in enumerate(runs):
        rare = mine[: len(mine) - math.ceil(NEAR_SHARE * len(mine) - 1e-9) + 1]
        rare = rare[rare >= 0].tolist()
        for j in sorted({j for r in rare for j in kept.get(r, ())}):
            theirs = runs[j]
            if min(len(mine), len(theirs)) < NEAR_SHARE * max(len(mine), len(theirs)):
                continue
            both = len(np.intersect1d(mine[mine >= 0], theirs[theirs >= 0], assume_unique=True))
            if both >= NEAR_SHARE * (len(mine) + len(theirs) - both):
                copies[i] = True
                break
        else:
            for r in rare:
                kept.setdefault(r, []).append(i)
    return copies


def without_near_copies(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Rows of the sample that are no near copies of earlier rows of the same label."""
    kept = np.ones(len(words), bool)
    for y in (False, True):
        at = np.flatnonzero(toxic == y)
        kept[at] = ~near_copies([words[i] for i in at])
    return np.flatnonzero(kept)


def token_labels(words: list[np.ndarray], toxic: np.ndarray, features: np.ndarray, n_features: int) -> list[np.ndarray]:
    """Per text: whether each token is toxic, as toxic documents explain it. features: those of each word, -1 for none."""
    held = np.zeros((2, n_features), np.int64)
    for w, y in zip(words, toxic):
        own = np.unique(features[np.unique(w)])
        held[int(y), own[own >= 0]] += 1
    n_toxic, n_clean = max(1, toxic.sum()), max(1, (~toxic).sum())
    marks = (held[1] >= max(MIN_SUPPORT, MIN_SHARE * n_toxic)) & (held[1] / n_toxic >= MIN_LIFT * ((held[0] + 0.1) / n_clean))
    marked = (np.append(marks, False)[features]).any(1)
    return [marked[w] if y else np.zeros(len(w), bool) for w, y in zip(words, toxic)]


def learned_sequences(words: list[np.ndarray], labels: list[np.ndarray]):
    """(word numbers, labels) of the windows around toxic tokens, and of whole texts without one."""
    for w, y in zip(words, labels):
        near = np.zeros(len(w), bool)
        for i in np.flatnonzero(y):
            near[max(0, i - WINDOW) : i + WINDOW + 1] = True
        cuts = np.flatnonzero(near) if y.any() else np.arange(len(w))
        for run in np.split(cuts, np.flatnonzero(np.diff(cuts) > 1) + 1):
            for some in np.split(run, range(SEQUENCE, len(run), SEQUENCE)):
                if len(some):
                    yield w[some], y[some]


def fit(sample: pa.Table, odds: float | None = None) -> Field:
    """Fit on (text, toxic) rows by gradient steps on the field's likelihood. Without both classes all scores are low.

    Near copies within a label count once. odds are those of a toxic label among all labels, where the sample holds
    relatively more toxic ones. Apart from the sample itself, memory is a few numbers per token.
    """
    transition = np.log(np.array([[0.99, 0.01], [0.7, 0.3]]))
    toxic = sample.column("toxic").to_numpy() == 1
    words, vocabulary = numbered(sample.column("text"))
    del sample
    rows = without_near_copies(words, toxic)
    words, toxic = [words[i] for i in rows], toxic[rows]
    if toxic.all() or not toxic.any():
        return Field(np.zeros(1 << HASH_BITS, np.float32), transition, (0.0, -6.0))
    hashed, mask = slots_of(vocabulary)
    different, features = np.unique(hashed, return_inverse=True)
    features = np.where(mask, features.reshape(hashed.shape), -1).astype(np.int32)
    labels = token_labels(words, toxic, features, len(different))
    del different, features
    used, slots = np.unique(places_of(hashed), return_inverse=True)
    slots = np.where(mask, slots.reshape(hashed.shape), len(used)).astype(np.int32)  # the last weight stays 0
    kept = list(learned_sequences(words, labels))
    weights = np.zeros(len(used) + 1)
    rng = np.random.default_rng(7)
    squares, pair_squares = np.full(len(weights), 1e-6), np.full((2, 2), 1e-3)
    parts = max(1, len(kept) // BATCH)
    for _ in range(-(-STEPS // parts)):
        for some in np.array_split(rng.permutation(len(kept)), parts):
            at = slots[np.concatenate([kept[i][0] for i in some])]
            truth = np.concatenate([kept[i][1] for i in some]).astype(float)
            lengths = np.array([len(kept[i][1]) for i in some])
            got, pairs = marginals(weights[at].sum(1), lengths, transition)
            gradient = np.bincount(at.ravel(), np.repeat(truth - got, at.shape[1]), len(weights)) / len(some) - L2 * weights
            gradient[-1] = 0
            inside = np.ones(len(truth), bool)
            inside[np.cumsum(lengths) - 1] = False
            a, b = truth[:-1][inside[:-1]].astype(int), truth[1:][inside[:-1]].astype(int)
            seen = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
            pair_gradient = (seen - pairs) / len(some)
            squares += gradient**2
            pair_squares += pair_gradient**2
            weights += RATE * gradient / np.sqrt(squares)
            transition += 0.1 * pair_gradient / np.sqrt(pair_squares)
    every = np.zeros(1 << HASH_BITS, np.float32)
    every[used] = weights[:-1]
    emission, gathered = weights[slots].sum(1), []
    for some in _slices(words):
        lengths = np.array([len(w) for w in some])
        got, _ = marginals(emission[np.concatenate(some)], lengths, transition)
        gathered.append(evidence(got, lengths))
    # toxic documents without a marked token tell nothing about how tokens speak for a document
    told = ~toxic | np.array([y.any() for y in labels])
    slope, intercept = _logistic(np.concatenate(gathered)[told], toxic[told].astype(float))
    drawn = max(1, (told & toxic).sum()) / max(1, (~toxic).sum())
    return Field(every, transition, (slope, intercept + (np.log(odds) - np.log(drawn) if odds and odds < drawn else 0.0)))


def _slices(words: list[np.ndarray]):
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w)
        if size > SLICE_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def evidence(toxic: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: the log-odds that some token is marked by all of READINGS independent readings, from all its marginals."""
    faint = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(toxic, 1 - 1e-9) ** READINGS))])
    ends = np.cumsum(lengths)
    clean = faint[ends] - faint[ends - lengths]  # none of them marked
    return np.clip(np.log(np.maximum(-np.expm1(clean), 1e-12)) - clean, -20, 20)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the label's log-odds: short Newton steps, held near slope 1 and intercept 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 5 * (a - 1), (p - y).sum() + b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 5, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def _documents(field: Field, texts: list[str], cache: dict[str, int], table: list[np.ndarray]):
    """The evidence of each text, and the bounds of its toxic runs."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
        table[0] = np.zeros(0)
    words = [TOKEN.findall(t.lower()) for t in texts]
    new = list({w for some in words for w in some if w not in cache})
    if new:
        cache.update(zip(new, range(len(table[0]), len(table[0]) + len(new))))
        table[0] = np.concatenate([table[0], field.emissions(new)])
    lengths = np.array([len(w) for w in words], np.int64)
    at = np.fromiter((cache[w] for some in words for w in some), np.int64, int(lengths.sum()))
    got, _ = marginals(table[0][at], lengths, field.transition)
    hits = np.flatnonzero(got >= SPAN_THRESHOLD)
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(hits, [ends - lengths, ends])
    spans = [_spans(text, hits[a:b] - (to - n)) if b > a else [] for text, to, n, a, b in zip(texts, ends, lengths, *cuts)]
    return evidence(got, lengths), spans


def _spans(text: str, hits: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of runs of toxic tokens; lower-casing may change lengths, so the original is matched again."""
    lower = text.lower()
    bounds = [m.span() for m in TOKEN.finditer(lower)]
    out = []
    for i in hits:
        a, b = bounds[i]
        if out and i == last + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = i
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most SAMPLE_PER_CLASS labelled rows of each class, chosen by hash of the id.

    A document with labels of both classes is toxic; labels without a class or id teach nothing. Of each class only the
    first rows by hash with SAMPLE_BYTES of text between them are taken; every text is whole.
    """
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("doc_id is not null")
    by_class = [
        labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)
    ]
    chosen = F.broadcast(by_class[0].unionByName(by_class[1]))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(chosen, "doc_id").select("doc_id", "text", "toxic")
    by_hash = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.withColumn("before", F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("own", F.octet_length("text")).filter(F.coalesce(F.col("before") + F.col("own"), F.lit(0)) <= SAMPLE_BYTES)
    return rows.select("doc_id", "text", "toxic")


def label_odds(labels: DataFrame) -> float:
    """Toxic labels over clean ones, of all labels."""
    counts = labels.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    return counts[0] / counts[1] if counts[1] else 0.0


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of a bounded sample of the labelled rows. One task fits it, the driver gets the weights alone."""
    odds = label_odds(labels)

    def run(batches):
        held = [pa.record_batch([b.column(k) for k in range(3)], ["doc_id", "text", "toxic"]) for b in batches]
        if not held:
            return
        field = fit(pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]), odds)
        used = np.flatnonzero(field.weights).astype("<i4")
        parts = [used, field.weights[used].astype("<f4"), field.transition.astype("<f8"), np.array(field.line, "<f8")]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["used", "weights", "transition", "line"])

    sample = labelled_sample(docs, labels).repartition(1)
    got = sample.mapInArrow(run, "used binary, weights binary, transition binary, line binary").first()
    if got is None:
        return fit(pa.table({"text": pa.chunked_array([[]], pa.string()), "toxic": pa.array([], pa.int32())}), odds)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[np.frombuffer(got["used"], "<i4")] = np.frombuffer(got["weights"], "<f4")
    return Field(weights, np.frombuffer(got["transition"], "<f8").reshape(2, 2), tuple(np.frombuffer(got["line"], "<f8").tolist()))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted and spans (start, end of toxic runs in the lower-cased text) for every row.

    Null and empty texts hold no toxic token. Repeated rows get the same answer; other columns are ignored.
    """
    start = _scorer(docs, field)

    def run(batches):
        scorer = start()
        for batch in batches:
            for at, to, texts in text_slices(batch.column(1)):
                score, spans = scorer(texts)
                spans = pa.array([[{"start": i, "end": j} for i, j in s] for s in spans], SPANS)
                columns = [batch.column(0).slice(at, to - at), pa.array(score)]
                columns += [pa.array((score >= THRESHOLD).astype(np.int32)), spans]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def _scorer(docs: DataFrame, field: Field):
    """Makes, in a task, a function from texts to their scores and toxic spans; it remembers words while the task runs."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def start():
        field, cache, table = held.value, {}, [np.zeros(0)]

        def scores(texts: list[str | None]) -> tuple[np.ndarray, list]:
            z, spans = _documents(field, [t or "" for t in texts], cache, table)
            return 1 / (1 + np.exp(-np.clip(field.line[0] * z + field.line[1], -30, 30))), spans

        return scores

    return start


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold; decided row by row, in place, without a join."""
    start = _scorer(docs, field)
    place = docs.columns.index("text")

    def run(batches):
        scorer = start()
        for batch in batches:
            clean = [scorer(texts)[0] < THRESHOLD for _, _, texts in text_slices(batch.column(place))]
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
