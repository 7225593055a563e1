"""Toxic spans by a two-state linear-chain conditional random field, and a toxicity score of every text from its marginals.

Labels are of whole texts, so tokens get theirs first. Over all labelled training texts, words are counted in toxic and in other texts; a word that
is in far more toxic texts than the others let expect (`MIN_EXCESS` deviations), in as many different neighbourhoods (copies of one text share
theirs), is an offending word. Its places in toxic texts are labelled 1, all other tokens 0.

The field scores a word by its affixes and inner n-grams, its class in the lexicon (how strongly it leans to toxic texts) and those of
both neighbours, with learned transitions. With two states the messages of forward-backward are ratios, so a step is one fraction. The marginals give the
offending spans; their sum, their largest and the probability that every word is clean give the score, by a logistic curve fitted on labelled texts.

Fitted on a bounded sample: `SAMPLE_DOCS` texts of each label; spans of up to `SPAN_WORDS` words for the field, whole texts for the curve. Counts
cover all labelled texts; the lexicon keeps the `LEXICON_WORDS` words that lean most.

Null and empty texts and texts without letters have no marginals and get the curve's base score. Labels that are null are left out, as are those of no document; a document with
several labels is toxic if one says so. Repeated rows count as often as they occur. Without toxic or without other training texts the score is the share of toxic ones (none: 0).
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import in_bucket, query, stage, table
from areapanel.llm.words import NOT_LETTERS, Words, blocks, mix, split_words

SAMPLE_DOCS = 1500
SPAN_WORDS = 40
LEXICON_WORDS = 2000
MIN_TEXTS = 5
MIN_EXCESS = 5.0
LEANINGS = 6
FEATURE_BITS = 15
GRAMS = (2, 3, 4, 5)
EPOCHS = 15
BLOCK_BYTES = 4 << 20
SPAN_AT = 0.5
THRESHOLD = 0.3
_SALT = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- the field -----------------------------------------------------------------------------------------------------

def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between marks of its begin and end (so affixes are features of their own), and where a word's begin."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    data = _LOWER[np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8)].astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(data))
    slots, owner = [], []
    word = np.repeat(np.arange(len(words)), lengths)
    for n in GRAMS:
        begin = at[at + n <= ends]
        value = np.full(len(begin), n, np.uint64)
        for k in range(n):
            value = value * _SALT[0] + data[begin + k] * _SALT[1 + k]
        slots.append((mix(value) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        owner.append(word[begin])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(words)))


class Chains:
    """Sequences side by side, longest first: step i holds the i-th word of every sequence that has one."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[self.order]
        self.steps = int(sorted_lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-sorted_lengths, -np.arange(self.steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        self.row = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.places = starts[self.order][self.row] + np.repeat(np.arange(self.steps), self.active)

    def marginals(self, scores: np.ndarray, t: np.ndarray, begin: float, pairs: bool = False):
        """(marginal of state 1 at each place in layout order, -log P(all in state 0) by sequence, expected transitions).

        `scores` are log odds of state 1; t = exp of the transitions, t[0, 0] = 1.
        """
        e = np.exp(np.clip(scores[self.places], -30, 30))
        forward = np.empty_like(e)
        surprise = np.zeros(len(self.order))
        r = None
        for i in range(self.steps):
            k, own = self.active[i], slice(self.at[i], self.at[i + 1])
            if r is None:
                r = e[own] * np.exp(begin)
                surprise[:k] += np.log1p(r)
            else:
                r = r[:k]
                stay, enter = t[0, 0] + t[1, 0] * r, e[own] * (t[0, 1] + t[1, 1] * r)
                surprise[:k] += np.log((stay + enter) / (1 + r))
                r = enter / stay
            forward[own] = r
        expected = np.zeros((2, 2))
        odds = np.empty_like(e)
        s = np.zeros(0)
        for i in range(self.steps - 1, -1, -1):
            k, own = self.active[i], slice(self.at[i], self.at[i + 1])
            here = np.ones(k)
            if len(s):
                m = len(s)
                after = e[self.at[i + 1]:self.at[i + 2]] * s
                if pairs:
                    left = forward[own][:m]
                    both = np.stack([np.full(m, t[0, 0]), t[0, 1] * after, left * t[1, 0], left * t[1, 1] * after])
                    expected += (both / both.sum(0)).sum(1).reshape(2, 2)
                here[:m] = (t[1, 0] + t[1, 1] * after) / (t[0, 0] + t[0, 1] * after)
            odds[own] = forward[own] * here
            s = here
        return odds / (1 + odds), surprise, expected


class Field:
    """Weights of the features, and lexicon classes by word hash."""

    def __init__(self, lexicon: np.ndarray, classes: np.ndarray):
        self.lexicon, self.classes = lexicon, classes
        self.grams = np.zeros(1 << FEATURE_BITS)
        self.lexical = np.zeros((3, LEANINGS + 1))  # the word's own class, that of the word before, that of the word after; the last class is no lexicon word
        self.moves = np.zeros((2, 2))
        self.begin = np.zeros(1)
        self.bias = np.zeros(1)

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(hashes), LEANINGS)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.classes[at], LEANINGS)

    @staticmethod
    def neighbours(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.roll(classes, 1), np.roll(classes, -1)
        before[starts] = LEANINGS
        after[np.append(starts[1:], len(classes)) - 1] = LEANINGS
        return before, after

    def scores(self, own: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of each place from its word's n-gram sum and the lexicon classes around it."""
        before, after = self.neighbours(classes, starts)
        return own + self.bias[0] + self.lexical[0][classes] + self.lexical[1][before] + self.lexical[2][after]

    def fit(self, spans: list, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Maximum conditional likelihood of the labelled spans (words, hashes, labels), by adaptive gradient steps."""
        rng = np.random.Generator(np.random.PCG64(seed))
        names = ("grams", "lexical", "moves", "begin", "bias")
        speed = {k: np.full_like(getattr(self, k), 1e-2) for k in names}
        for _ in range(epochs):
            order = rng.permutation(len(spans))
            for lo in range(0, len(order), 128):
                chosen = [spans[i] for i in order[lo:lo + 128]]
                words = [w for s in chosen for w in s[0]]
                classes = self.class_of(np.concatenate([s[1] for s in chosen]))
                gold = np.concatenate([s[2] for s in chosen]).astype(np.int64)
                lengths = np.array([len(s[0]) for s in chosen])
                starts = np.cumsum(lengths) - lengths
                slots, begins = gram_slots(words)
                scores = self.scores(np.add.reduceat(self.grams[slots], begins), classes, starts)
                layout = Chains(lengths, starts)
                p, _, pairs = layout.marginals(scores, np.exp(self.moves), self.begin[0], pairs=True)
                error = np.empty(len(gold))
                error[layout.places] = p
                error -= gold
                inner = np.ones(len(gold), bool)
                inner[starts] = False
                later = np.flatnonzero(inner)
                np.add.at(pairs, (gold[later - 1], gold[later]), -1)
                pairs[0, 0] = 0  # fixed: only ratios matter
                each = np.repeat(error, np.diff(np.append(begins, len(slots))))
                lexical = np.stack([np.bincount(c, error, LEANINGS + 1) for c in (classes, *self.neighbours(classes, starts))])
                steps = {"grams": np.bincount(slots, each, 1 << FEATURE_BITS), "lexical": lexical, "moves": pairs,
                         "begin": np.array([error[starts].sum()]), "bias": np.array([error.sum()])}
                for k in names:
                    value = getattr(self, k)
                    g = steps[k] / len(chosen) + 1e-4 * value
                    speed[k] += g * g
                    value -= 0.2 * g / np.sqrt(speed[k])


# --- texts to marginals and scores ---------------------------------------------------------------------------------

def tag(field: Field, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of every word, -log P(all clean) of every text)."""
    lengths = np.diff(words.starts)
    surprise = np.zeros(len(lengths))
    if not len(words.hashes):
        return np.zeros(0), surprise
    known, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    slots, begins = gram_slots([words.text(i) for i in first])
    own = np.add.reduceat(field.grams[slots], begins)
    filled = np.flatnonzero(lengths > 0)
    starts = words.starts[:-1][filled]
    layout = Chains(lengths[filled], starts)
    p, s, _ = layout.marginals(field.scores(own[inverse], field.class_of(known)[inverse], starts), np.exp(field.moves), field.begin[0])
    out = np.empty(len(p))
    out[layout.places] = p
    surprise[filled[layout.order]] = s
    return out, surprise


def summaries(p: np.ndarray, surprise: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the score is made of, by text: largest marginal, expected toxic words, surprise over all-clean, share of toxic words."""
    lengths = np.diff(starts)
    out = np.zeros((len(lengths), 4))
    filled = np.flatnonzero(lengths > 0)
    if len(filled):
        total = np.add.reduceat(p, starts[:-1][filled])
        out[filled, 0] = np.maximum.reduceat(p, starts[:-1][filled])
        out[filled, 1] = np.log1p(total)
        out[filled, 3] = total / lengths[filled]
    out[:, 2] = np.log1p(surprise)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve by Newton steps; the last one is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- learning ------------------------------------------------------------------------------------------------------

def _word_counts(batches):
    """word, toxic, clean: texts with the word, combined over some texts of the task."""
    def merged(held):
        key, n = (np.concatenate(x) for x in zip(*held))
        key, at = np.unique(key, return_inverse=True)
        return key, np.stack([np.bincount(at, n[:, j], len(key)) for j in (0, 1)], 1).astype(np.int64)

    def rows(held):
        key, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], ["word", "toxic", "clean"])
    held, size = [], 0
    for batch in batches:
        for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
            words = split_words(batch.column(1).slice(lo, hi - lo), NOT_LETTERS)
            if not len(words.hashes):
                continue
            row = np.repeat(np.arange(hi - lo), np.diff(words.starts))
            order = np.lexsort((words.hashes, row))
            h, row = words.hashes[order], row[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            toxic = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)[row[once]]
            held.append(merged([(h[once], np.stack([toxic, 1 - toxic], 1))]))
            size += len(held[-1][0])
            if size > 1_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield rows(held)
                    held, size = [], 0
    if held:
        yield rows(held)


def _neighbourhoods(shared):
    """word, around: candidate words of toxic texts with a hash of the words before and after."""
    def run(batches):
        candidates = shared.value
        for batch in batches:
            for lo, hi in blocks(batch.column(0), BLOCK_BYTES):
                words = split_words(batch.column(0).slice(lo, hi - lo), NOT_LETTERS)
                if not len(words.hashes) or not len(candidates):
                    continue
                at = np.flatnonzero(np.isin(words.hashes, candidates))
                padded = np.concatenate([[np.uint64(0)], words.hashes, [np.uint64(0)]])
                found = np.unique(np.stack([words.hashes[at], mix(padded[at] * np.uint64(3) + padded[at + 2])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1].astype(np.int64))], ["word", "around"])
    return run


def _spans(shared):
    """Spans for the field: around an offending or lexicon word where there is one, else anywhere."""
    def run(batches):
        offending, lexicon = shared.value
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
                words = split_words(batch.column(1).slice(lo, hi - lo), NOT_LETTERS)
                out = []
                marked, leaning = np.isin(words.hashes, offending), np.isin(words.hashes, lexicon)
                for toxic, key, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(),
                                            words.starts[:-1].tolist(), words.starts[1:].tolist()):
                    if b == a:
                        continue
                    sought = np.flatnonzero(marked[a:b]) if toxic else np.flatnonzero(leaning[a:b])
                    middle = int(sought[key % len(sought)]) if len(sought) and key % 4 else key % (b - a)
                    begin = a + max(0, min(middle - key % SPAN_WORDS, b - a - SPAN_WORDS))
                    end = min(b, begin + SPAN_WORDS)
                    out.append(([words.text(i) for i in range(begin, end)], words.hashes[begin:end].astype(np.int64).tolist(),
                                (marked[begin:end] & bool(toxic)).tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.list_(pa.binary())), pa.array([r[1] for r in out], pa.list_(pa.int64())),
                                                      pa.array([r[2] for r in out], pa.list_(pa.bool_()))], ["words", "hashes", "marks"])
    return run


def _summaries(shared):
    def run(batches):
        field = shared.value
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
                words = split_words(batch.column(1).slice(lo, hi - lo), NOT_LETTERS)
                p, surprise = tag(field, words)
                x = summaries(p, surprise, words.starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, lexicon_words: int = LEXICON_WORDS) -> tuple[Field | None, np.ndarray]:
    """(field, curve) from rows (doc_id, toxic 0 or 1, text), nothing null. The driver gets the lexicon and the sample, both bounded."""
    spark = labelled.sparkSession
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return None, np.array([1.0 if toxic else 0.0])
    rows = labelled.select("toxic", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)).alias("key"))
    counted = rows.select("toxic", "text").mapInArrow(_word_counts, "word long, toxic long, clean long")
    counted = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    expected = (F.col("clean") + 0.5) * F.lit(toxic / clean)
    excess = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    leaning = counted.withColumn("excess", excess).where((F.col("excess") >= MIN_EXCESS) & (F.col("toxic") >= MIN_TEXTS))
    leaning = leaning.orderBy(F.desc("excess"), "word").limit(lexicon_words).toArrow()
    words = leaning["word"].to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(words)
    around = rows.where("toxic = 1").select("text").mapInArrow(_neighbourhoods(shared), "word long, around long")
    places = {r.word: r.n for r in around.distinct().groupBy("word").agg(F.count("*").alias("n")).collect()}
    # copies of one text share a word's neighbourhood, so they count once
    met = np.array([places.get(int(w), 0) for w in words.view(np.int64)], np.float64)
    hits = np.minimum(leaning["toxic"].to_numpy(), met)
    due = (leaning["clean"].to_numpy() + 0.5) * toxic / clean
    strength = (hits - due) / np.sqrt(due + 1)
    classes = np.digitize(strength, [2, MIN_EXCESS, 8, 12, 20])
    order = np.argsort(words)
    field = Field(words[order], classes[order])
    offending = words[strength >= MIN_EXCESS]
    shared = spark.sparkContext.broadcast((offending, words))
    rate = {1: min(1.0, sample_docs / toxic), 0: min(1.0, sample_docs / clean)}
    share = F.when(F.col("toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    chosen = stage(rows.where(F.pmod(F.xxhash64("key", F.lit(4)), F.lit(1 << 30)) < share * (1 << 30)), "sample")
    spans = chosen.mapInArrow(_spans(shared), "words array<binary>, hashes array<long>, marks array<boolean>").collect()
    spans = sorted((([bytes(w) for w in r.words], np.array(r.hashes, np.int64).view(np.uint64), np.array(r.marks)) for r in spans), key=lambda s: s[0])
    if spans:
        field.fit(spans)
    shared = spark.sparkContext.broadcast(field)
    seen = chosen.select("toxic", "text").mapInArrow(_summaries(shared), "toxic int, x array<double>").collect()
    seen = sorted((r.toxic, r.x) for r in seen)
    if not seen:
        return None, np.array([toxic / (toxic + clean)])
    y = np.array([s[0] for s in seen], np.float64)
    return field, fit_curve(np.array([s[1] for s in seen]), y, np.array([1 / rate[s[0]] for s in seen]))


# --- scoring -------------------------------------------------------------------------------------------------------

def _score(shared):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        field, curve = shared.value
        for batch in batches:
            for lo, hi in blocks(batch.column(2), BLOCK_BYTES):
                n = hi - lo
                spans = [[] for _ in range(n)]
                if field is None:
                    score = np.full(n, curve[0])
                else:
                    texts = batch.column(2).slice(lo, n)
                    words = split_words(texts, NOT_LETTERS)
                    p, surprise = tag(field, words)
                    score = 1 / (1 + np.exp(-np.clip(np.column_stack([summaries(p, surprise, words.starts), np.ones(n)]) @ curve, -700, 700)))
                    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    begin = np.cumsum(size) - size
                    flagged = np.flatnonzero(p >= SPAN_AT)
                    last = None
                    for i, text in zip(flagged.tolist(), (np.searchsorted(words.starts, flagged, "right") - 1).tolist()):
                        a, b, q = int(words.first[i] - begin[text]), int(words.last[i] - begin[text]), float(p[i])
                        if last == (text, i - 1):
                            held = spans[text][-1]
                            held["end"], held["p"] = b, max(held["p"], q)
                        else:
                            spans[text].append({"start": a, "end": b, "p": q})
                        last = (text, i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(score, pa.float64()),
                                                  pa.array(spans, pa.list_(span))], ["doc_id", "held_out", "score", "spans"])
    return run


def score_texts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS,
                lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (byte ranges of flagged words with their largest marginal) of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    # texts go to their labels: labels grow with the corpus, so they are not broadcast
    labelled = docs.where(~in_bucket("doc_id", 4, 2) & F.col("text").isNotNull()).join(marks.hint("merge"), "doc_id")
    model = learn(stage(labelled, "labelled"), sample_docs, lexicon_words)
    rows = docs.select("doc_id", in_bucket("doc_id", 4, 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)),
                             "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long,p:double>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


@query("op12_crf_toxic_spans")
def op12(spark, folder):
    return score_texts(table(spark, folder, "documents"), table(spark, folder, "labels"))
