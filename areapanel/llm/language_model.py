"""N-gram language model in sharded Elias-Fano tries: contexts, pointers, successors.

Training texts are split into words and an end; every (context word, next token) pair is counted in
the tasks and sent, as packed arrays, to the shard of its context. Each shard becomes one file:

- contexts: an Elias-Fano sequence of their hashes, with exact counts;
- pointers: an Elias-Fano sequence, where each context's successors begin;
- successors: made monotone by their context's place in front, as one Elias-Fano sequence, each with its
  discounted probability as one of 256 values fitted to the shard.

A text's tokens are looked up shard by shard in memory-mapped files, by successor search inside the
range of their context. Probability: p(w|c) = max(n(c,w)-D, 0)/n(c) + D*T(c)/n(c) * p1(w), with T(c) the
number of different successors and p1 the add-one share of w; p1(w) after an unseen context.

Words are known by 64-bit hashes and, under their context, by 36 bits of them. Null and empty texts
are the end token alone. Without any training text every probability is 1 (log 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.elias_fano import EliasFano, from_bytes, to_bytes
from areapanel.llm.files import mapped, write_new
from areapanel.llm.tables import in_bucket, query, scratch_path, stage, table
from areapanel.llm.words import SPACES, blocks, split_words

DISCOUNT = 0.75
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20
FLUSH_PAIRS = 3_000_000
CODE_BITS = 36
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
TYPES = [np.int64, np.uint8, np.uint64, np.uint32, np.uint64, np.uint8, np.uint64, np.uint32, np.uint8, np.uint64, np.uint32,
         np.uint8, np.float64]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards cut the hash range into equal stretches."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def shard_start(shard: int, shards: int) -> int:
    return -(-(shard << 32) // shards) << 32


def pairs_of(words) -> tuple[np.ndarray, np.ndarray]:
    """(context, next token) for every token of every text, text by text."""
    return np.insert(words.hashes, words.starts[:-1], BEGIN), np.insert(words.hashes, words.starts[1:], END)


def _count_pairs(shards: int):
    def flush(held):
        context, token = (np.concatenate(x) for x in zip(*held))
        known, place = np.unique(context, return_inverse=True)
        order = np.argsort((place.astype(np.uint64) << np.uint64(CODE_BITS)) | (token >> np.uint64(64 - CODE_BITS)), kind="stable")
        code = ((place.astype(np.uint64) << np.uint64(CODE_BITS)) | (token >> np.uint64(64 - CODE_BITS)))[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        counts = np.diff(np.append(first, len(code))).astype(np.uint32)
        code = code[first]
        owner = (code >> np.uint64(CODE_BITS)).astype(np.int64)
        lengths = np.bincount(owner, minlength=len(known)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        home = shard_of(known, shards).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        rows = [[], [], [], [], [], []]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(known)]):
            lo, hi = ends[a], ends[b]
            part = code[lo:hi]
            for row, value in zip(rows, (int(home[a]), known[a:b].tobytes(), lengths[a:b].tobytes(), part.astype(np.uint32).tobytes(),
                                         ((part >> np.uint64(32)) & np.uint64(0xF)).astype(np.uint8).tobytes(), counts[lo:hi].tobytes())):
                row.append(value)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]],
                                          ["shard", "contexts", "lengths", "low", "high", "counts"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in blocks(texts, BLOCK_BYTES):
                held.append(pairs_of(split_words(texts.slice(lo, hi - lo), SPACES)))
                n += len(held[-1][0])
                if n >= FLUSH_PAIRS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
    return run


def _quantised(log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte bins of equal width and the mean value of each."""
    low, high = float(log_p.min()), float(log_p.max())
    bins = np.minimum(((log_p - low) / max(high - low, 1e-12) * 256).astype(np.int64), 255)
    sums, n = np.bincount(bins, log_p, 256), np.bincount(bins, minlength=256)
    return bins.astype(np.uint8), sums / np.maximum(n, 1)


def _build_shards(shards: int, folder: str, discount: float):
    def done(shard, rows):
        known, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        place = np.repeat(place.astype(np.uint64), np.concatenate([r[1] for r in rows]))
        code = (place << np.uint64(CODE_BITS)) | (np.concatenate([r[3] for r in rows]).astype(np.uint64) << np.uint64(32)) \
            | np.concatenate([r[2] for r in rows]).astype(np.uint64)
        del place
        order = np.argsort(code)
        code, counts = code[order], np.concatenate([r[4] for r in rows])[order].astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, counts = code[first], np.add.reduceat(counts, first)
        owner = (code >> np.uint64(CODE_BITS)).astype(np.int64)
        begins = np.searchsorted(owner, np.arange(len(known)))
        totals = np.add.reduceat(counts, begins)
        bins, book = _quantised(np.log10((counts - discount) / totals[owner]))
        start = shard_start(shard, shards)
        bound = shard_start(shard + 1, shards) - start
        level1 = EliasFano.build(known - np.uint64(start), bound)
        pointers = EliasFano.build(np.append(begins, len(code)).astype(np.uint64), len(code) + 1)
        level2 = EliasFano.build(code, len(known) << CODE_BITS)
        sizes = np.array([len(known), len(code)], np.int64)
        address = write_new(folder, "trie", to_bytes([
            sizes, level1.low, level1.high, level1.ones, totals, pointers.low, pointers.high, pointers.ones,
            level2.low, level2.high, level2.ones, bins, book]))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([address]), pa.array([len(known)], pa.int64()),
                                           pa.array([len(code)], pa.int64()), pa.array([int(totals.sum())], pa.int64())],
                                          ["shard", "address", "contexts", "pairs", "tokens"])

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != shard:
                    if rows:
                        yield done(shard, rows)
                    shard, rows = row[0], []
                rows.append([np.frombuffer(x, t) for x, t in zip(row[1:], (np.uint64, np.uint32, np.uint32, np.uint8, np.uint32))])
        if rows:
            yield done(shard, rows)
    return run


class Shard:
    """One trie file."""

    def __init__(self, address: str, shard: int, shards: int, discount: float):
        a = from_bytes(mapped(address), TYPES)
        n, m = a[0].tolist()
        self.start, self.discount = shard_start(shard, shards), discount
        self.contexts = EliasFano(n, shard_start(shard + 1, shards) - self.start, a[1], a[2], a[3])
        self.totals = a[4]
        self.pointers = EliasFano(n + 1, m + 1, a[5], a[6], a[7])
        self.successors = EliasFano(m, n << CODE_BITS, a[8], a[9], a[10])
        self.bins, self.book = a[11], a[12]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return self.contexts.find(hashes - np.uint64(self.start))

    def pair_terms(self, place: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For known contexts: discounted probability of each next token, and the weight of the shorter context."""
        at = self.successors.find((place.astype(np.uint64) << np.uint64(CODE_BITS)) | (tokens >> np.uint64(64 - CODE_BITS)))
        found = np.where(at >= 0, 10.0 ** self.book[self.bins[np.maximum(at, 0)]], 0.0)
        context, back = np.unique(place, return_inverse=True)
        different = self.pointers.get(context + 1).astype(np.float64) - self.pointers.get(context).astype(np.float64)
        return found, (self.discount * different / self.totals[context])[back]


def train(texts: DataFrame, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Manifest of the trie files of the `text` column: shard, address, contexts, pairs, tokens, shards."""
    texts = texts.select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0)).alias("n")).first().n
    shards = max(8, -(-size // shard_bytes))
    folder = scratch_path(texts.sparkSession, "tries")
    counted = texts.mapInArrow(_count_pairs(shards), "shard int, contexts binary, lengths binary, low binary, high binary, counts binary")
    built = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _build_shards(shards, folder, discount), "shard int, address string, contexts long, pairs long, tokens long")
    return stage(built, "manifest").withColumn("shards", F.lit(shards))


def _score(addresses, shards, tokens, types, ends, discount):
    def run(batches):
        opened: dict[int, Shard] = {}

        def shard(i):
            if i not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened)))
                opened[i] = Shard(addresses[i], i, shards, discount)
            return opened[i]

        def slices(hashes):
            home = shard_of(hashes, shards).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(home)]):
                if int(home[a]) in addresses:
                    yield shard(int(home[a])), a, b

        for batch in batches:
            texts = batch.column(2)
            for lo, hi in blocks(texts, BLOCK_BYTES):
                words = split_words(texts.slice(lo, hi - lo), SPACES)
                vocabulary, inverse = np.unique(np.append(words.hashes, BEGIN), return_inverse=True)
                begin, inverse = int(inverse[-1]), inverse[:-1]
                place, count = np.full(len(vocabulary), -1, np.int64), np.zeros(len(vocabulary))
                for s, a, b in slices(vocabulary):
                    place[a:b] = s.places(vocabulary[a:b])
                    known = place[a:b] >= 0
                    count[a:b][known] = s.totals[place[a:b][known]]
                count[begin] = 0
                share = np.append((count + 1) / (tokens + types + 1), (ends + 1) / (tokens + types + 1))
                last = len(vocabulary)
                context = np.insert(inverse, words.starts[:-1], begin)
                token = np.insert(inverse, words.starts[1:], last)
                pair, back = np.unique(context * (last + 1) + token, return_inverse=True)
                c, t = pair // (last + 1), pair % (last + 1)
                p = share[t].copy()
                hashes = np.append(vocabulary, END)
                live = np.flatnonzero(place[c] >= 0)
                for s, a, b in slices(hashes[c[live]]):
                    rows = live[a:b]
                    found, weight = s.pair_terms(place[c[rows]], hashes[t[rows]])
                    p[rows] = found + weight * share[t[rows]]
                firsts = words.starts[:-1] + np.arange(hi - lo)
                known = np.append(count > 0, ends > 0)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(np.diff(np.append(firsts, len(token))), pa.int64()),
                    pa.array(np.add.reduceat(known[token].astype(np.int64), firsts)), pa.array(np.full(hi - lo, tokens, np.int64)),
                    pa.array(np.add.reduceat(np.log10(share)[token], firsts)), pa.array(np.add.reduceat(np.log10(p)[back], firsts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, manifest: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Scores of docs (doc_id, held_out, text). The driver gets one row for each trie file."""
    files = manifest.collect()
    addresses = {r.shard: r.address for r in files}
    shards = files[0].shards if files else 1
    tokens = sum(r.tokens for r in files)
    ends = 0
    home = int(shard_of(np.array([BEGIN]), shards)[0])
    if home in addresses:
        first = Shard(addresses[home], home, shards, discount)
        at = int(first.places(np.array([BEGIN]))[0])
        ends = int(first.totals[at]) if at >= 0 else 0
    types = sum(r.contexts for r in files)  # the begin mark is a context and no token, the end a token and no context
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_score(addresses, shards, tokens, types, ends, discount), (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


@query("op6_elias_fano_lm")
def op6(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", in_bucket("doc_id", 7, 2).alias("held_out"))
    return score(docs, train(docs.where("not held_out")))
