"""Language of every word by a linear-chain conditional random field, and of every text by its words.

Words are runs of letters. A word's score for a language sums learned weights of its affixes (byte n-grams that
hold its begin or end), its inner n-grams, and its lexicon class; learned transitions link neighbouring words, so that
switches inside a text are labelled too. Forward-backward gives each word's probabilities; a text gets the
language with the largest mean probability, which is its score.

The lexicon counts every training text: the words in most texts, each with its main language and how pure it is. The weights are
fitted on a bounded sample: `SAMPLE_DOCS` texts a language, one span of up to `SPAN_WORDS` words each at a random place;
spans of different languages are chained, since the labels are of whole texts.

Texts that are null or without a letter are `und` with score 0; so is every text if nothing could be learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import as_struct, from_struct, in_bucket, query, stage, table
from areapanel.llm.words import NOT_LETTERS, Words, blocks, mix, split_words

SAMPLE_DOCS = 600
SPAN_WORDS = 30
LEXICON_WORDS = 50_000
FEATURE_BITS = 16
GRAMS = (1, 2, 3, 4)
BLOCK_BYTES = 4 << 20
SCORED_BYTES = 1 << 17
EPOCHS = 12
MIN_SCORE = 0.3
UNKNOWN = "und"
_SALT = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all affix and n-gram features, word by word, and where each word's begin."""
    lengths = np.array([len(w) for w in words], np.int64) + 2
    data = _LOWER[np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8)].astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    slots, owners = [], []
    value = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        value = value[:m] + data[n - 1:n - 1 + m] * _SALT[n]
        if n in GRAMS:
            same = owner[:m] == owner[n - 1:n - 1 + m]
            slots.append((mix(value[same] ^ _SALT[0]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
            owners.append(owner[:m][same])
        value = value.copy()
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray  # sorted word hashes
    classes: np.ndarray  # lexicon class of each
    grams: np.ndarray  # feature slot x language
    lexical: np.ndarray  # lexicon class (last: not in it) x language
    transitions: np.ndarray
    begins: np.ndarray

    def lexicon_class(self, hashes: np.ndarray) -> np.ndarray:
        absent = len(self.lexical) - 1
        if not len(self.lexicon):
            return np.full(len(hashes), absent)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.classes[at], absent)

    def word_scores(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Scores of all words; a feature takes over a hundred bytes while it is worked on, so words go in parts of bounded size."""
        out = self.lexical[self.lexicon_class(hashes)]
        ends = np.cumsum([len(w) for w in words])
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCORED_BYTES, "right")))
            slots, begins = word_features(words[lo:hi])
            out[lo:hi] += np.add.reduceat(self.grams[slots], begins)
            lo = hi
        return out


class Sequences:
    """Word sequences laid out step by step, longest first, so that each step is one slice."""

    def __init__(self, lengths: np.ndarray, starts: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(self.steps), "right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        row = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.places = starts[self.order][row] + np.repeat(np.arange(self.steps), self.active)
        self.n = len(lengths)

    def posteriors(self, scores: np.ndarray, transitions: np.ndarray, begins: np.ndarray):
        """(probabilities of each place in layout order, expected transitions, log of the normalisers' sum)."""
        e = scores[self.places]
        top = e.max(1, keepdims=True)
        e = np.exp(e - top)
        t, alpha, log_z = np.exp(transitions), np.empty_like(e), float(top.sum())
        a = None
        for i in range(self.steps):
            k, lo = self.active[i], self.at[i]
            a = (np.exp(begins) * e[:k]) if a is None else (a[:k] @ t) * e[lo:lo + k]
            s = a.sum(1, keepdims=True)
            a = a / s
            log_z += float(np.log(s).sum())
            alpha[lo:lo + k] = a
        pairs = np.zeros_like(t)
        beta = np.ones((self.active[-1], e.shape[1]), e.dtype)
        for i in range(self.steps - 1, -1, -1):
            k, lo = self.active[i], self.at[i]
            if i < self.steps - 1:
                m, hi = self.active[i + 1], self.at[i + 1]
                right = beta * e[hi:hi + m]
                left = alpha[lo:lo + m]
                whole = (left @ t * right).sum(1, keepdims=True)
                pairs += (left / whole).T @ right
                back = right @ t.T
                beta = np.ones((k, e.shape[1]), e.dtype)
                beta[:m] = back / back.sum(1, keepdims=True)
            both = alpha[lo:lo + k] * beta
            e[lo:lo + k] = both / both.sum(1, keepdims=True)
        return e, pairs * t, log_z


def fit(spans: list[tuple[str, list[bytes], np.ndarray]], languages: list[str], lexicon: np.ndarray, classes: np.ndarray, n_classes: int,
        epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Maximum conditional likelihood by adaptive gradient steps on chains of three spans."""
    n = len(languages)
    model = Model(languages, lexicon, classes, np.zeros((1 << FEATURE_BITS, n)), np.zeros((n_classes + 1, n)), np.zeros((n, n)), np.zeros(n))
    rng = np.random.Generator(np.random.PCG64(seed))
    speed = {k: np.full_like(getattr(model, k), 1e-2) for k in ("grams", "lexical", "transitions", "begins")}
    code = {x: i for i, x in enumerate(languages)}
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for lo in range(0, len(order), 96):
            group = order[lo:lo + 96]
            words, hashes, gold, lengths = [], [], [], []
            for chain in np.array_split(group, max(1, len(group) // 3)):
                count = 0
                for i in chain:
                    language, own, h = spans[i]
                    cut = int(rng.integers(1, len(own) + 1))
                    words += own[:cut]
                    hashes.append(h[:cut])
                    gold += [code[language]] * cut
                    count += cut
                lengths.append(count)
            gold, lengths, hashes = np.array(gold), np.array(lengths), np.concatenate(hashes)
            slots, begins = word_features(words)
            kinds = model.lexicon_class(hashes)
            scores = np.add.reduceat(model.grams[slots], begins) + model.lexical[kinds]
            starts = np.cumsum(lengths) - lengths
            layout = Sequences(lengths, starts)
            p, pairs, _ = layout.posteriors(scores, model.transitions, model.begins)
            error = np.zeros_like(scores)
            error[layout.places] = p
            error[np.arange(len(gold)), gold] -= 1
            inner = np.ones(len(gold), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            np.add.at(pairs, (gold[at - 1], gold[at]), -1)
            each = np.repeat(np.arange(len(words)), np.diff(np.append(begins, len(slots))))
            steps = {"grams": np.stack([np.bincount(slots, error[each, j], 1 << FEATURE_BITS) for j in range(n)], 1),
                     "lexical": np.stack([np.bincount(kinds, error[:, j], n_classes + 1) for j in range(n)], 1),
                     "transitions": pairs, "begins": error[starts].sum(0)}
            for k, g in steps.items():
                value = getattr(model, k)
                g = g / len(lengths) + 1e-4 * value
                speed[k] += g * g
                value -= 0.2 * g / np.sqrt(speed[k])
    return model


def _lexicon_counts(languages: list[str]):
    code = {x: i for i, x in enumerate(languages)}

    def merged(held):
        key, count = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        return key[first], np.add.reduceat(count, first)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
                words = split_words(batch.column(1).slice(lo, hi - lo), NOT_LETTERS)
                if not len(words.hashes):
                    continue
                row = np.repeat(np.arange(hi - lo), np.diff(words.starts))
                order = np.lexsort((words.hashes, row))
                h, row = words.hashes[order], row[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])  # once per text
                language = np.array([code[x] for x in batch.column(0).slice(lo, hi - lo).to_pylist()], np.uint64)[row[once]]
                held.append(merged([(np.stack([h[once], language], 1), np.ones(once.sum(), np.int64))]))
                n += len(held[-1][1])
                if n > 1_000_000:
                    held = [merged(held)]
                    n = len(held[0][1])
                    if n > 500_000:
                        yield rows(held[0])
                        held, n = [], 0
        if held:
            yield rows(merged(held))

    def rows(found):
        key, count = found
        return pa.RecordBatch.from_arrays([pa.array(key[:, 0].astype(np.int64)),
                                           pa.array(key[:, 1].astype(np.int32)), pa.array(count)], ["word", "language", "texts"])
    return run


def _spans(span_words: int):
    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
                words = split_words(batch.column(1).slice(lo, hi - lo), NOT_LETTERS)
                out = []
                for language, key, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(),
                                               words.starts[:-1].tolist(), words.starts[1:].tolist()):
                    if b > a:
                        at = a + (key % max(1, b - a - span_words + 1))
                        span = range(at, min(b, at + span_words))
                        out.append((language, [words.text(i) for i in span], words.hashes[at:at + len(span)].astype(np.int64).tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.list_(pa.binary())),
                                                      pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["lang", "words", "hashes"])
    return run


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, lexicon_words: int = LEXICON_WORDS) -> Model | None:
    """Model from rows (doc_id, lang, text), lang and text not null. The driver gets the sample and the lexicon, both bounded."""
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return None
    rows = labelled.select("lang", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)).alias("key"))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_docs / counts[k]))])
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    spans = chosen.mapInArrow(_spans(SPAN_WORDS), "lang string, words array<binary>, hashes array<long>").collect()
    spans = sorted(((r.lang, [bytes(w) for w in r.words], np.array(r.hashes, np.int64).view(np.uint64)) for r in spans),
                   key=lambda s: (s[0], s[1]))
    if not spans:
        return None
    seen = rows.select("lang", "text").mapInArrow(_lexicon_counts(languages), "word long, language int, texts long")
    by_word = seen.groupBy("word", "language").agg(F.sum("texts").alias("texts")).groupBy("word").agg(
        F.sum("texts").alias("total"), F.max(F.struct("texts", "language")).alias("main"))
    common = by_word.orderBy(F.desc("total"), "word").limit(lexicon_words).select("word", "total", "main.*").toArrow()
    words = common["word"].to_numpy().astype(np.int64).view(np.uint64)
    purity = common["texts"].to_numpy() / common["total"].to_numpy()
    classes = common["language"].to_numpy().astype(np.int64) * 4 + np.digitize(purity, [0.7, 0.9, 0.99])
    order = np.argsort(words)
    return fit(spans, languages, words[order], classes[order], 4 * len(languages))


def label_words(model: Model, words: Words) -> tuple[Sequences, np.ndarray]:
    """Layout and language probabilities of all words of a block of texts."""
    known, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    scores = model.word_scores([words.text(i) for i in first], known).astype(np.float32)
    lengths = np.diff(words.starts)
    layout = Sequences(lengths[lengths > 0], words.starts[:-1][lengths > 0])
    p, _, _ = layout.posteriors(scores[inverse], model.transitions.astype(np.float32), model.begins.astype(np.float32))
    return layout, p


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi in blocks(batch.column(2), BLOCK_BYTES):
                rows = batch.slice(lo, hi - lo)
                words = split_words(rows.column(2), NOT_LETTERS)
                lengths = np.diff(words.starts)
                mean = np.zeros((hi - lo, len(model.languages) if model else 1))
                if model and len(words.hashes):
                    layout, p = label_words(model, words)
                    total = np.zeros((layout.n, p.shape[1]))
                    for i in range(layout.steps):
                        total[:layout.active[i]] += p[layout.at[i]:layout.at[i + 1]]
                    texts = np.flatnonzero(lengths > 0)[layout.order]
                    mean[texts] = total / lengths[texts][:, None]
                best = mean.argmax(1)
                lettered = [bool(model) and t is not None and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array([model.languages[b] if x else UNKNOWN for b, x in zip(best, lettered)], pa.string()),
                    pa.array([min(1.0, max(0.0, float(m[b]))) if x else 0.0 for m, b, x in zip(mean, best, lettered)], pa.float64()),
                    rows.column(3)], ["doc_id", "held_out", "lang_pred", "score", "text_key"])
    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, text_key (hash of the text) of docs (doc_id, held_out, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"),
                       F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), (
        "doc_id long, held_out boolean, lang_pred string, score double, text_key long"))


def learn_and_predict(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", in_bucket("doc_id", 5, 0).alias("held_out"))
    return predict(rows, learn(rows.where("not held_out and lang is not null and text is not null")))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a language of at least this score; columns unchanged."""
    poor = stage(learn_and_predict(docs).where(F.col("lang_pred").eqNullSafe(UNKNOWN) | (F.col("score") < min_score)).select(
        "text_key").distinct(), "poor")
    keyed = docs.select(as_struct(docs).alias("doc"), F.xxhash64("text").alias("text_key"))
    return from_struct(keyed.join(poor, "text_key", "left_anti"), "doc", docs.columns)


@query("op2_crf_language_id")
def op2(spark, folder):
    return learn_and_predict(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")
