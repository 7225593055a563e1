"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents become sets of hashed word n-grams; equal sets are one node. All documents are counted
into a table of fixed size that ranks n-grams from rare to frequent; any fixed ranking gives the
same links, a rare-first one gives few candidates. Two sets that link share an n-gram among the
first `n - ceil(t*n) + 1` of each (prefix), so candidates meet on prefix n-grams only.

No group is expanded into all its pairs. Each node is first verified against one pivot of the groups it
is in; what links becomes one component. Components are then compared through one member each, and last
every pair of a shared prefix n-gram that lies in different components is verified, once. Pairs
inside a component are never needed, since a component is all that is reported.

Null and empty texts have an empty set and link with nothing. Rows with equal text or equal sets
are one node, whatever their ids. A null doc_id is never a component id unless its component has no other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import as_struct, connected_components, from_struct, query, stage, table
from areapanel.llm.words import SPACES, Words, blocks, mix, split_words

N_GRAM = 5
PERCENT = 80
BLOCK_BYTES = 4 << 20
STAR_ROUNDS = 2
COUNT_BITS, COUNT_CHUNK_BITS = 24, 14
SEEN_BITS, SEEN_CHUNK_BITS = 25, 18
TOKEN_BITS = 48

_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def required(n: int, percent: int) -> int:
    """Fewest common n-grams of a set of n with any set it links to."""
    return (percent * n + 99) // 100


def n_gram_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram of its own length."""
    h, out = words.hashes, []
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            grams += h[j:len(h) - n + 1 + j] * _MULTIPLIERS[j]
        grams = mix(grams)
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _MULTIPLIERS[:b - a]).sum(dtype=np.uint64, keepdims=True) + _MULTIPLIERS[63 - (b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """A set's identity: a hash of all its members."""
    if not len(grams):
        return 0
    total = mix(grams ^ _MULTIPLIERS[40]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total ^ np.uint64(len(grams))).view(np.int64)[0])


def _each_set(batches, n):
    """(row batch, position in it, set) for all texts, in blocks of bounded size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for lo, hi in blocks(texts, BLOCK_BYTES):
            yield batch.slice(lo, hi - lo), n_gram_sets(split_words(texts.slice(lo, hi - lo), SPACES), n)


PROFILE = "kind string, chunk int, doc_id long, text_key long, node long, n_shingles long, counts binary"


def _profile(n: int):
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                        ("node", pa.int64()), ("n_shingles", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        counts, shift = np.zeros(1 << COUNT_BITS, np.uint32), np.uint64(64 - COUNT_BITS)
        for batch, sets in _each_set(batches, n):
            if sets and sum(map(len, sets)):
                slots, times = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                counts[slots.astype(np.int64)] += times.astype(np.uint32)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([
                pa.array(["doc"] * k), pa.nulls(k, pa.int32()), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()),
                pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.nulls(k, pa.binary())], schema=schema)
        step = 1 << COUNT_CHUNK_BITS
        for chunk in range(0, (1 << COUNT_BITS) // step):
            part = counts[chunk * step:(chunk + 1) * step]
            if part.any():
                blob = zlib.compress((part.astype(np.uint8) if part.max() < 256 else part).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(["counts"]), pa.array([chunk], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([blob], pa.binary())],
                    schema=schema)
    return run


def _add_counts(batches):
    """Rows sorted by chunk: the sum of each chunk's counters as one-byte rarity classes."""
    def done():
        classes = np.floor(4 * np.log2(1.0 + total)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["chunk", "classes"])
    chunk, total = None, None
    for batch in batches:
        for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, total = c, np.zeros(1 << COUNT_CHUNK_BITS, np.uint64)
            data = zlib.decompress(blob)
            total += np.frombuffer(data, np.uint8 if len(data) == len(total) else np.uint32)
    if chunk is not None:
        yield done()


def rarity(profile: DataFrame) -> np.ndarray:
    """Class of each of the 2**24 counters: 16 MB at every corpus size."""
    rows = (profile.where("kind = 'counts'").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(_add_counts, "chunk int, classes binary").collect())
    out, step = np.zeros(1 << COUNT_BITS, np.uint8), 1 << COUNT_CHUNK_BITS
    for r in rows:
        out[r.chunk * step:(r.chunk + 1) * step] = np.frombuffer(r.classes, np.uint8)
    return out


def _prefixes(n, percent, classes):
    def run(batches):
        seen: set[int] = set()
        for _, sets in _each_set(batches, n):
            tokens, nodes, sizes, places = [], [], [], []
            for grams in sets:
                node = node_of(grams)
                if not len(grams) or node in seen:
                    continue
                seen.add(node)
                k = len(grams) - required(len(grams), percent) + 1
                rank = np.lexsort((grams, classes.value[(grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[:k]
                tokens.append(grams[rank] >> np.uint64(64 - TOKEN_BITS))  # equal tokens of unequal n-grams: candidates only
                nodes.append(np.full(k, node, np.int64))
                sizes.append(np.full(k, len(grams), np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(places))], ["token", "node", "n", "pos"])
    return run


LIVE = "token long, node long, n int, pos int"
LONG_RUN, SHORT_RUN = 4096, 8


def _live(percent):
    """Rows sorted by (token, node): those whose n-gram some other node has too.

    In short runs a row also needs a partner that passes the length and positional filter.
    """
    def useful(starts, lengths, n, pos):
        keep = np.repeat(lengths > 1, lengths)
        for k in range(2, SHORT_RUN + 1):
            first = starts[lengths == k]
            if len(first):
                at = first[:, None] + np.arange(k)
                size, left = n[at].astype(np.int64), (n[at] - pos[at]).astype(np.int64)
                x, y = size[:, :, None], size[:, None, :]
                may = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (
                    (100 + percent) * np.minimum(left[:, :, None], left[:, None, :]) >= percent * (x + y))
                may[:, np.arange(k), np.arange(k)] = False
                keep[at] = may.any(2)
        return keep

    def table_of(rows, keep):
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], ["token", "node", "n", "pos"])

    def run(batches):
        held, open_run = None, False  # open_run: the held row is of a long run and already sent
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate([a, b]).astype(b.dtype) for a, b in zip(held, rows)]
            token, node = rows[:2]
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            rows = [x[fresh] for x in rows]
            token = rows[0]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lengths = np.diff(np.append(starts, len(token)))
            keep = useful(starts, lengths, rows[2], rows[3])
            if open_run:
                keep[:lengths[0]] = True  # the rest of a long run
                keep[0] = False
            last = int(starts[-1])
            if lengths[-1] > LONG_RUN or (open_run and last == 0):
                yield table_of(rows, keep)
                held, open_run = [x[-1:] for x in rows], True
            else:
                keep[last:] = False
                yield table_of(rows, keep)
                held, open_run = [x[last:] for x in rows], False
        if held is not None and not open_run:
            n = len(held[0])
            yield table_of(held, useful(np.zeros(1, np.int64), np.array([n]), held[2], held[3]))
    return run


def _mark_seen(batches):
    """Rows sorted by chunk: a bit for each node."""
    step = 1 << SEEN_CHUNK_BITS

    def done():
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["chunk", "bits"])
    chunk, bits = None, None
    for batch in batches:
        chunks, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for c in np.unique(chunks):
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, bits = int(c), np.zeros(step, bool)
            bits[slots[chunks == c]] = True
    if chunk is not None:
        yield done()


def _seen_bits(nodes: DataFrame) -> bytes:
    """A filter of fixed size (4 MB) that lets through all these nodes and few others."""
    slot = F.shiftrightunsigned("node", 64 - SEEN_BITS)
    rows = (nodes.select(F.shiftright(slot, SEEN_CHUNK_BITS).cast("int").alias("chunk"),
                         slot.bitwiseAND((1 << SEEN_CHUNK_BITS) - 1).cast("int").alias("slot"))
            .repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_mark_seen, "chunk int, bits binary").collect())
    out, step = bytearray(1 << (SEEN_BITS - 3)), 1 << (SEEN_CHUNK_BITS - 3)
    for r in rows:
        out[r.chunk * step:(r.chunk + 1) * step] = r.bits
    return bytes(out)


def packed(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each sorted hash."""
    return (grams >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _marked(marks: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    slot = nodes.view(np.uint64) >> np.uint64(64 - SEEN_BITS)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _only_marked(bits):
    def run(batches):
        for batch in batches:
            keep = _marked(np.frombuffer(bits.value, np.uint8), batch.column(0).to_numpy())
            yield batch.filter(pa.array(keep))
    return run


def _wanted_sets(n, bits):
    def run(batches):
        marks, done = np.frombuffer(bits.value, np.uint8), set()
        for _, sets in _each_set(batches, n):
            nodes, grams = [], []
            named = np.array([node_of(s) for s in sets], np.int64)
            for s, node, wanted in zip(sets, named.tolist(), _marked(marks, named)):
                if len(s) and wanted and node not in done:
                    done.add(node)
                    nodes.append(node)
                    grams.append(packed(s))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.binary())], ["node", "grams"])
    return run


def common(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Size of the intersection of two sorted sets of 48-bit hashes, or -1 if the suffix filter shows it is under `least`.

    Suffix filter: both sets are cut at the same 16 hash values; parts can share no more than the smaller has.
    """
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(44)
    x = np.diff(np.concatenate([[0], np.searchsorted(a, cuts), [len(a)]]))
    y = np.diff(np.concatenate([[0], np.searchsorted(b, cuts), [len(b)]]))
    if np.minimum(x, y).sum() < least:
        return -1
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verify(percent):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                least = -(-percent * (len(a) + len(b)) // (100 + percent))
                both = common(a, b, least)
                linked.append(both >= 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
    return run


def _may_link(percent, n, m, i, j):
    """Length and positional filter for an n-gram at places i and j of sets of n and m."""
    n, m, i, j = (F.col(c).cast("long") for c in (n, m, i, j))
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & ((1 + F.least(n - i - 1, m - j - 1)) * (100 + percent) >= (n + m) * percent))


def jaccard_components(docs: DataFrame, n: int = N_GRAM, percent: int = PERCENT, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and node (equal sets), text_key (equal texts), comp (component) of every row."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_key"),
                       F.col(text_column).cast("binary").alias("text"))
    texts = rows.select("text")
    profile = stage(rows.mapInArrow(_profile(n), PROFILE), "profile")
    classes = sc.broadcast(rarity(profile))
    prefixes = texts.mapInArrow(_prefixes(n, percent, classes), "token long, node long, n int, pos int")
    live = stage(prefixes.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_live(percent), LIVE), "live")
    bits = sc.broadcast(_seen_bits(live.select("node").distinct()))
    sets = stage(texts.mapInArrow(_wanted_sets(n, bits), "node long, grams binary").dropDuplicates(["node"]), "sets")
    classes.destroy()  # the tables are kept, nothing reads these again
    bits.destroy()

    def verify(pairs):
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = sc.broadcast(_seen_bits(nodes))
        own = sets.mapInArrow(_only_marked(wanted), "node long, grams binary")
        full = pairs.join(own.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(
            own.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")
        out = stage(full.mapInArrow(_verify(percent), "a long, b long, linked boolean"), "verified")
        wanted.destroy()
        return out

    # a node with many shared n-grams among its rarest is most likely the original of a group of copies
    degrees = live.groupBy("node").agg(F.count("*").alias("degree"))
    places = live.join(degrees, "node").withColumn("comp", F.col("node"))
    verified = docs.sparkSession.createDataFrame([], "a long, b long, linked boolean")
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            comps = connected_components(verified.where("linked").select("a", "b"))
            places = _in_several(places, comps)
        pairs = _stars(places, verified, percent) if turn < STAR_ROUNDS else _unverified(_across(places, percent), verified).distinct()
        verified = verified.unionByName(verify(stage(pairs, "pairs")))
    comps = connected_components(verified.where("linked").select("a", "b"))

    found = profile.where("kind = 'doc'").select("doc_id", "n_shingles", "node", "text_key").join(comps, "node", "left")
    found = found.withColumn("comp", F.coalesce("comp", "node"))
    least = found.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return found.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "node", "text_key", "comp")


def _unverified(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    pairs = pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return pairs.join(verified.select("a", "b"), ["a", "b"], "left_anti")


def _in_several(places: DataFrame, comps: DataFrame) -> DataFrame:
    """The places of n-grams found in several components, with the component; the others are settled for good."""
    placed = stage(places.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    several = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return stage(placed.join(several, "token"), "mixed")


def _stars(places: DataFrame, verified: DataFrame, percent: int) -> DataFrame:
    """One member of each component against the most shared member of another, that with which it has most n-grams."""
    members = places.groupBy("token", "comp").agg(F.max(F.struct("degree", "node", "n", "pos")).alias("r"))
    pivots = members.groupBy("token").agg(F.max(F.struct("r", "comp")).alias("p"))
    both = members.join(pivots, "token").where("comp <> p.comp").select(
        F.col("r.node").alias("own"), F.col("p.r.node").alias("pivot"), F.col("r.n").alias("n"), F.col("p.r.n").alias("m"),
        F.col("r.pos").alias("i"), F.col("p.r.pos").alias("j"))
    met = both.where(_may_link(percent, "n", "m", "i", "j")).groupBy("own", "pivot").agg(F.count("*").alias("times"))
    new = _unverified(met.withColumns({"a": F.col("own"), "b": F.col("pivot")}), verified)
    best = new.groupBy("own").agg(F.max(F.struct("times", "pivot")).alias("s")).select("own", F.col("s.pivot").alias("pivot"))
    return best.select(F.least("own", "pivot").alias("a"), F.greatest("own", "pivot").alias("b")).distinct()


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs of an n-gram that lie in different components, never those inside its largest component."""
    largest = placed.groupBy("token", "comp").count().groupBy("token").agg(
        F.max(F.struct("count", "comp")).alias("c")).select("token", F.col("c.comp").alias("big"))
    mixed = placed.join(largest, "token")
    few = mixed.where("comp <> big").select("token", F.col("node").alias("a"), F.col("n").alias("n"), F.col("pos").alias("i"), F.col("comp").alias("ca"))
    rest = mixed.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("comp").alias("cb"), "big")
    both = few.join(rest, "token").where("ca <> cb and (cb = big or a < b)")
    return both.where(_may_link(percent, "n", "m", "i", "j")).select("a", "b")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its smallest doc_id; columns unchanged."""
    found = jaccard_components(docs, **options)
    chosen = found.where("n_shingles > 0").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    chosen = chosen.unionByName(found.where("n_shingles = 0").select("doc_id", "text_key"))
    keyed = docs.select(as_struct(docs).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key")).distinct()
    kept = keyed.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("key") == F.col("chosen_key")), "left_semi")
    return from_struct(kept.dropDuplicates(["id", "key"]), "doc", docs.columns)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_ngram_jaccard_join", f"""
WITH RECURSIVE words AS (SELECT doc_id, text, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
word_list AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY w) AS node, doc_id, w FROM words),
shingle AS MATERIALIZED (SELECT DISTINCT node, array_to_string(w[pos:pos + 4], ' ') AS s
  FROM (SELECT node, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS pos FROM (SELECT DISTINCT node, w FROM word_list) WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT node, count(*) AS n FROM shingle GROUP BY node),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.node <> y.node GROUP BY ALL)
  JOIN size sa ON sa.node = a JOIN size sb ON sb.node = b WHERE 100 * shared >= 80 * (sa.n + sb.n - shared)),
reach AS (SELECT node AS a, node AS b FROM size UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_id AS (SELECT reach.a AS node, min(doc_id) AS component_id FROM reach JOIN word_list ON word_list.node = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id
FROM word_list LEFT JOIN size USING (node) LEFT JOIN least_id USING (node)""")
def op10(spark, folder):
    return jaccard_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
