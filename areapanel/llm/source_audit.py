"""Divergence of sources inside each language, by exact counts over minimal perfect hashes.

Two passes over the texts. The first counts, per language, the documents of every term and keeps the terms in at least
`MIN_DOCUMENTS` of them; the terms themselves are the keys of that count, so it is exact. Kept terms are numbered
and cut into shards of about `SHARD_TERMS` by a hash of the term. Tasks build a minimal perfect hash per shard: levels of bit
maps, each holding the keys that met no other key there, with ranks; the slot of a key is the rank of its bit. A shard also stores
its keys in slot order. Shards are broadcast in rounds of at most `ROUND_BYTES`, so what is shipped is bounded
however many terms are kept, and the texts are read once a round (one round up to about a million terms). The second pass looks every
distinct word of a block up, checks the stored key byte by byte, and adds to one dense array of slots per (language, source);
arrays leave a task when they exceed `HELD_SLOTS`, else at its end.

Shares are integers: p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), in decimals, so nothing rounds. `pair` sums |p - q| over all kept terms
of the language for each two sources: tiles of (all sources x some slots) become one matrix each, whose sums are added up. `term` ranks the
terms a source has more of than its language.

Null languages, sources and texts are the empty string. Languages without kept terms have distances 0. Repeated rows count as often
as they occur. Ties are ordered by the item's bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.llm.tables import query, running_totals, stage, table
from areapanel.llm.words import NOT_LETTERS, blocks, mix, split_words

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTH = 5
SHARD_TERMS = 100_000
ROUND_BYTES = 32 << 20
KEY_OVERHEAD = 48
HELD_SLOTS = 4_000_000
TILE_CELLS = 2_000_000
BLOCK_BYTES = 4 << 20
HELD_TERMS = 400_000
GAMMA = 2.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- distinct words of a block -------------------------------------------------------------------------------------

def _bytes_at(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lower-cased bytes of the words, one after the other."""
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, np.uint8)
    return _LOWER[data[np.arange(ends[-1]) + np.repeat(first - (ends - length), length)]]


class Distinct:
    """The distinct lower-cased words of some texts: `keys` (bytes after bytes), `lengths`, `hashes`, and `word` of each place.

    Words are told apart by hashes and compared byte by byte afterwards; should two words share a hash, they are told apart by a dictionary.
    """

    def __init__(self, texts: pa.Array):
        words = split_words(texts, NOT_LETTERS)
        self.starts = words.starts
        length = words.last - words.first
        self.hashes, at, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        step = 200_000
        clash = False
        for lo in range(0, len(length), step):
            own, rep = slice(lo, lo + step), at[self.word[lo:lo + step]]
            clash |= not (length[own] == length[rep]).all() or not np.array_equal(
                _bytes_at(words.data, words.first[own], length[own]), _bytes_at(words.data, words.first[rep], length[rep]))
            if clash:
                break
        if clash:
            seen: dict[bytes, int] = {}
            self.word = np.array([seen.setdefault(words.text(i).lower(), len(seen)) for i in range(len(length))])
            at = np.unique(self.word, return_index=True)[1]
            self.hashes = words.hashes[at]
        self.lengths = length[at]
        self.keys = _bytes_at(words.data, words.first[at], self.lengths)


def _terms_of(keys: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _document_counts(batches):
    """lang, term, documents: combined over the texts of a task, in bounded memory."""
    held: dict[str, dict[bytes, int]] = {}
    n = 0

    def rows():
        for language, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], ["lang", "term", "documents"])
    for batch in batches:
        for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
            languages = np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object)
            for language in set(languages):
                mine = np.flatnonzero(languages == language)
                found = Distinct(batch.column(1).slice(lo, hi - lo).take(pa.array(mine)))
                if not len(found.lengths):
                    continue
                row = np.repeat(np.arange(len(mine)), np.diff(found.starts))
                once = np.unique(found.word.astype(np.int64) * len(mine) + row) // len(mine)
                count = np.bincount(once, minlength=len(found.lengths)).tolist()
                counts = held.setdefault(language, {})
                n -= len(counts)
                for term, c in zip(_terms_of(found.keys, found.lengths).to_pylist(), count):
                    counts[term] = counts.get(term, 0) + c
                n += len(counts)
            if n > HELD_TERMS:
                yield from rows()
                held, n = {}, 0
    yield from rows()


# --- minimal perfect hash ------------------------------------------------------------------------------------------

def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_levels(hashes: np.ndarray, gamma: float = GAMMA) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit map of each level, slot of each key): keys that are alone at their place of a level settle there, the others go on.

    Equal hashes can never part, so they are refused.
    """
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two keys of a shard share a 64-bit hash")
    levels, base = [], 0
    slots = np.zeros(len(hashes), np.int64)
    left = np.arange(len(hashes))
    while len(left):
        size = max(64, int(gamma * len(left)))
        place = _places(hashes[left], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        rank = np.cumsum(alone) - 1
        slots[left[settled]] = base + rank[place[settled]]
        base += int(settled.sum())
        levels.append(alone)
        left = left[~settled]
    return levels, slots


class PerfectHash:
    """Slots of the keys of one shard; other keys are told by the stored ones."""

    def __init__(self, sizes: np.ndarray, bits: bytes, key_hashes: bytes, lengths: bytes, keys: bytes):
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.levels, at, base = [], 0, 0
        for size in sizes:
            alone = flat[at:at + size]
            self.levels.append((alone, base + np.cumsum(alone, dtype=np.int64) - 1))
            base += int(alone.sum())
            at += size
        self.n = base
        self.key_hashes = np.frombuffer(key_hashes, np.uint64)
        self.lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.keys = np.frombuffer(keys, np.uint8)

    def slots(self, hashes: np.ndarray, lengths: np.ndarray, begins: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 if it is no key: hash, length and all bytes must equal those stored."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            place = _places(hashes[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        maybe = np.flatnonzero(out >= 0)
        slot = out[maybe]
        same = (self.key_hashes[slot] == hashes[maybe]) & (self.lengths[slot] == lengths[maybe])
        out[maybe[~same]] = -1
        maybe, slot = maybe[same], slot[same]
        n = lengths[maybe]
        ends = np.cumsum(n)
        if len(ends):
            inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
            differs = self.keys[inside + np.repeat(self.begins[slot], n)] != keys[inside + np.repeat(begins[maybe], n)]
            wrong = np.add.reduceat(differs.astype(np.int64), ends - n) > 0
            out[maybe[wrong]] = -1
        return out


SHARD_SCHEMA = "lang string, shard long, sizes array<long>, bits binary, key_hashes binary, lengths binary, keys binary"


def _build_shard(part: pa.Table) -> pa.Table:
    """The perfect hash of one (language, shard); its terms are bounded by SHARD_TERMS on average."""
    terms = part.column("term").combine_chunks()
    words = split_words(terms, np.zeros(256, bool))
    levels, slots = build_levels(words.hashes)
    order = np.argsort(slots)
    sorted_terms = terms.take(pa.array(order)).to_pylist()
    return pa.table({
        "lang": pa.array([part.column("lang")[0].as_py()], pa.string()), "shard": pa.array([part.column("shard")[0].as_py()], pa.int64()),
        "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
        "key_hashes": pa.array([words.hashes[order].tobytes()], pa.binary()),
        "lengths": pa.array([np.array([len(t) for t in sorted_terms], np.int32).tobytes()], pa.binary()),
        "keys": pa.array([b"".join(sorted_terms)], pa.binary())})


# --- the two passes ------------------------------------------------------------------------------------------------

def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, term (bytes), documents, shard of every term in enough documents of its language, kept as a table."""
    counted = docs.mapInArrow(_document_counts, "lang string, term binary, documents long")
    kept = stage(counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= min_documents), "kept")
    shards = kept.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(shard_terms)).alias("shards"))
    return kept.join(shards, "lang").select("lang", "term", "documents", F.pmod(F.xxhash64("term"), "shards").alias("shard"))


def _recount(shared):
    def run(batches):
        hashes: dict = {}
        for language, shard, *parts in shared.value:
            hashes.setdefault(language, {})[shard] = parts
        opened: dict = {}
        held: dict = {}
        n = 0

        def rows():
            for (language, source, shard), counts in held.items():
                slot = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(slot), pa.string()), pa.array([source] * len(slot), pa.string()),
                     pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(counts[slot])], ["lang", "source", "shard", "slot", "n"])
        for batch in batches:
            for lo, hi in blocks(batch.column(2), BLOCK_BYTES):
                groups: dict = {}
                for i, key in enumerate(zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist())):
                    groups.setdefault(key[0], {}).setdefault(key[1], []).append(i)
                for language, sources in groups.items():
                    if language not in hashes:
                        continue
                    mine = np.array([i for rows_ in sources.values() for i in rows_])
                    found = Distinct(batch.column(2).slice(lo, hi - lo).take(pa.array(mine)))
                    if not len(found.lengths):
                        continue
                    edges = found.starts[np.cumsum([0] + [len(r) for r in sources.values()])]
                    begins = np.cumsum(found.lengths) - found.lengths
                    for shard, parts in hashes[language].items():
                        if (language, shard) not in opened:
                            opened[language, shard] = PerfectHash(*parts)
                        perfect = opened[language, shard]
                        slot = perfect.slots(found.hashes, found.lengths, begins, found.keys)
                        for source, a, b in zip(sources, edges[:-1].tolist(), edges[1:].tolist()):
                            hit = slot[found.word[a:b]]
                            key = (language, source, shard)
                            if key not in held:
                                held[key] = np.zeros(perfect.n, np.int64)
                                n += perfect.n
                            held[key] += np.bincount(hit[hit >= 0], minlength=perfect.n)
                    if n > HELD_SLOTS:
                        yield from rows()
                        held, n = {}, 0
        yield from rows()
    return run


def recount(docs: DataFrame, terms: DataFrame, round_bytes: int = ROUND_BYTES) -> tuple[DataFrame, DataFrame]:
    """(counts: lang, source, shard, slot, n; slots: lang, shard, slot, term), both kept as tables."""
    spark = docs.sparkSession
    sizes = terms.groupBy("lang", "shard").agg((F.sum(F.octet_length("term")) + F.count("*") * KEY_OVERHEAD).cast("long").alias("bytes"))
    rounds = stage(running_totals(sizes, [F.col("lang"), F.col("shard")], {"before": "bytes"}).select(
        "lang", "shard", F.floor(F.col("before") / F.lit(round_bytes)).cast("long").alias("round")), "rounds")
    shards = stage(terms.groupBy("lang", "shard").applyInArrow(_build_shard, SHARD_SCHEMA).join(rounds, ["lang", "shard"]), "shards")

    def slot_rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32)
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * n, pa.string()), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)),
                                                  _terms_of(np.frombuffer(row["keys"], np.uint8), lengths.astype(np.int64))], ["lang", "shard", "slot", "term"])
    slots = shards.select("lang", "shard", "lengths", "keys").mapInArrow(slot_rows, "lang string, shard long, slot long, term binary")
    slots = stage(slots.withColumn("term", F.col("term").cast("string")), "slots")
    last = shards.agg(F.max("round")).first()[0]
    counts = None
    for k in range(0 if last is None else last + 1):
        mine = shards.where(F.col("round") == k).drop("round").toArrow()  # at most round_bytes and one shard
        shared = spark.sparkContext.broadcast([tuple(r.values()) for r in mine.to_pylist()])
        one = docs.select("lang", "source", "text").mapInArrow(_recount(shared), "lang string, source string, shard long, slot long, n long")
        one = stage(one.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "counts")
        shared.destroy()
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, shard long, slot long, n long")
    return counts, slots


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 kept)), exact."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + kept.cast("decimal(15,0)") * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under).cast("long")


def _tile(part: pa.Table) -> pa.Table:
    """Sums of |p - q| over the slots of one tile, for each two sources. Rows with slot -1 give each source's share of an absent term."""
    source, slot, p = (part.column(c).to_numpy() for c in ("source_no", "slot", "p"))
    width = int(part.column("width")[0].as_py())
    absent = slot < 0
    sources = np.sort(source[absent])
    matrix = np.empty((len(sources), width), np.int64)
    matrix[np.searchsorted(sources, source[absent])] = p[absent][:, None]
    matrix[np.searchsorted(sources, source[~absent]), slot[~absent]] = p[~absent]
    lefts, rights, values = [], [], []
    for i in range(len(sources) - 1):
        lefts.append(np.full(len(sources) - 1 - i, sources[i]))
        rights.append(sources[i + 1:])
        values.append(np.concatenate([np.abs(matrix[lo:lo + 64] - matrix[i]).sum(1) for lo in range(i + 1, len(sources), 64)]))
    if not values:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
    value = np.concatenate(values)
    return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(value), pa.string()), "a": pa.array(np.concatenate(lefts)),
                     "b": pa.array(np.concatenate(rights)), "value": pa.array(value)})


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, shard_terms: int = SHARD_TERMS,
          round_bytes: int = ROUND_BYTES, tile_cells: int = TILE_CELLS) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    terms = stage(kept_terms(rows.select("lang", "text"), min_documents, shard_terms), "terms")
    counts, slots = recount(rows, terms, round_bytes)
    # groups: one row per (language, source), numbered inside the language; everything here is as small as the list of groups
    seen = rows.select("lang", "source").distinct()
    kept = slots.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = seen.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    groups = stage(groups.withColumns({"source_no": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")}), "groups")
    languages = stage(groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("total").alias("lang_total"), F.count("*").alias("sources")), "languages")
    # running number of every kept term inside its language, so that tiles hold as many slots as tile_cells allow
    per_shard = slots.groupBy("lang", "shard").agg(F.count("*").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_shard = per_shard.select("lang", "shard", offset.alias("offset"))
    width = F.greatest(F.lit(1), F.floor(F.lit(tile_cells) / F.col("sources"))).cast("long")
    known = counts.join(per_shard, ["lang", "shard"]).join(groups, ["lang", "source"]).join(languages.select("lang", "sources"), "lang")
    number = F.col("slot") + F.col("offset")
    known = known.select("lang", "source_no", F.floor(number / width).cast("long").alias("tile"), (number % width).alias("slot"), width.alias("width"),
                         share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    absent = groups.where("kept > 0").join(languages.select("lang", "sources"), "lang").select(
        "lang", "source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / width).cast("long"))).alias("tile"),
        F.lit(-1).cast("long").alias("slot"), F.least(width, F.col("kept")).alias("width"), share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"))
    # the last tile of a language has fewer slots; what lies beyond the last term must not count
    last = F.col("kept") - F.col("tile") * F.col("width")
    absent = absent.join(languages.select("lang", "kept"), "lang").withColumn("width", F.least("width", last)).drop("kept")
    known = known.join(languages.select("lang", "kept"), "lang").withColumn("width", F.least("width", last)).drop("kept")
    tiles = known.unionByName(absent).groupBy("lang", "tile").applyInArrow(_tile, "lang string, a long, b long, value long")
    sums = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = stage(sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")), "distances")
    left = groups.select("lang", "source", F.col("source_no").alias("a"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("b"))
    pairs = left.join(right, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n")).join(slots, ["lang", "shard", "slot"])
    more = counts.join(whole, ["lang", "shard", "slot"]).join(groups, ["lang", "source"]).join(languages.select("lang", "lang_total"), "lang")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = more.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top_terms))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {MIN_DOCUMENTS}),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
dense AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + {SCALE} * (n + {SMOOTH}) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT
    + {SMOOTH} * count(*) OVER (PARTITION BY lang, source)) AS p FROM dense),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL),
q AS (SELECT lang, term, 1 + {SCALE} * (n + {SMOOTH}) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + {SMOOTH} * count(*) OVER (PARTITION BY lang)) AS q FROM l),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


@query("op13_perfect_hash_source_audit", SQL)
def op13(spark, folder):
    return audit(table(spark, folder, "documents").select("text", "lang", "source"))
