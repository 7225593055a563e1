"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores, for blocks of documents, the postings of every word: the block's word hashes in order, where each
one's list begins, and the word positions of all lists. A block holds a bounded number of words (or one document), is
built where its documents are read, and is written once; nothing is shuffled.

`phrase_matches` looks test windows up in every block: a window with a word that the block lacks is out; for the
others the list of the rarest word gives candidate starts, and the lists of the other words, shifted by their place in the
window, are intersected from the rarest up. `proximity_matches` asks for all words within a span instead.

The test windows, not the documents, are sent to the tasks, in slices of at most `SLICE_WINDOWS`; every slice is one
more pass over the index, so a test set of any size is looked up whole. Windows never cross documents. Null and empty
texts have no words. Equal item ids count once, and so do null ones: all items without an id are one item, null in `items`,
which `n_items` of the query counts and its hash of the joined ids leaves out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import as_struct, from_struct, query, scratch_path, table
from areapanel.llm.words import MARKS, blocks, split_words

WINDOW = 10
BLOCK_BYTES = 8 << 20
SLICE_WINDOWS = 200_000
INDEX = ("part int, block int, doc_ids array<long>, text_keys array<long>, doc_starts array<int>, terms binary, lists binary, "
         "positions binary")


def _index(batches):
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi in blocks(batch.column(2), BLOCK_BYTES):
            rows = batch.slice(lo, hi - lo)
            words = split_words(rows.column(2), MARKS)
            terms, place = np.unique(words.hashes, return_inverse=True)
            order = np.argsort(place, kind="stable").astype(np.int32)
            lists = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(terms)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([rows.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([words.starts.tolist()], pa.list_(pa.int32())),
                pa.array([terms.tobytes()], pa.binary()), pa.array([lists.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())],
                ["part", "block", "doc_ids", "text_keys", "doc_starts", "terms", "lists", "positions"])
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text), one row per block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.col("text").cast("binary").alias("text"))
    path = scratch_path(docs.sparkSession, "postings")
    rows.mapInArrow(_index, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _windows(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK_BYTES):
                words = split_words(batch.column(1).slice(lo, hi - lo), MARKS)
                found: dict = {}
                for item, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), words.starts[:-1].tolist(), words.starts[1:].tolist()):
                    n = min(size, b - a)
                    for at in range(a, b - n + 1) if n else ():
                        found[item, words.hashes[at:at + n].tobytes()] = None
                if found:
                    items, grams = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(grams, pa.binary())], ["item_id", "words"])
    return run


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id (text), words: every run of `size` words of an item, or all words of a shorter one, as packed hashes."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_windows(size), "item_id string, words binary").distinct()


class Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.doc_ids, self.text_keys = row["doc_ids"], row["text_keys"]
        self.starts = np.array(row["doc_starts"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.lists = np.frombuffer(row["lists"], np.int32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        # (word, position) in one number: postings of a word are sorted, and so is this
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.lists)) << 32) | self.positions

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The words' places among the block's terms, -1 where absent."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        wanted = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (position >= 0)

    def postings_of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of `term`, position) for all postings of these words."""
        n = self.lists[term + 1] - self.lists[term]
        row = np.repeat(np.arange(len(term)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, self.positions[self.lists[term][row] + inside]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def live_windows(self, windows: np.ndarray):
        """Rows of windows whose words all occur here, their terms and these by rarity."""
        place = self.place(windows.ravel()).reshape(windows.shape)
        live = np.flatnonzero((place >= 0).all(1))
        place = place[live]
        rarity = np.argsort(self.lists[place + 1] - self.lists[place], axis=1, kind="stable")
        return live, place, rarity

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence of windows (rows of hashes, all of one length)."""
        live, place, rarity = self.live_windows(windows)
        if not len(live):
            return live, live
        each = np.arange(len(live))
        rarest = rarity[:, 0]
        row, at = self.postings_of(place[each, rarest])
        start = at - rarest[row]
        for k in range(1, windows.shape[1]):
            if not len(row):
                break
            offset = rarity[row, k]
            keep = self.has(place[row, offset], start + offset)
            row, start = row[keep], start[keep]
        inside = start >= 0
        row, start = row[inside], start[inside]
        whole = self.doc_of(start) == self.doc_of(start + windows.shape[1] - 1)
        return live[row[whole]], start[whole]

    def near(self, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest word) where every other word is within `span` words of it, in the same document."""
        live, place, rarity = self.live_windows(windows)
        if not len(live):
            return live, live
        each = np.arange(len(live))
        row, at = self.postings_of(place[each, rarity[:, 0]])
        doc = self.doc_of(at)
        for k in range(1, windows.shape[1]):
            if not len(row):
                break
            term = place[row, rarity[row, k]]
            lo = np.maximum(at - span, self.starts[doc])
            hi = np.minimum(at + span, self.starts[doc + 1] - 1)
            keep = np.searchsorted(self.keys, (term << 32) | lo) < np.searchsorted(self.keys, (term << 32) | hi, "right")
            row, at, doc = row[keep], at[keep], doc[keep]
        return live[row], at


def _by_length(slices: list[tuple[str | None, bytes]]):
    """The items, null first, and the windows of each length as one array, with the numbers of their items."""
    names = sorted({i for i, _ in slices}, key=lambda i: (i is not None, i or ""))
    number = {i: k for k, i in enumerate(names)}
    out: dict = {}
    for item, words in slices:
        out.setdefault(len(words) // 8, []).append((number[item], words))
    return names, [(np.array([i for i, _ in rows], np.int64), np.frombuffer(b"".join(w for _, w in rows), np.uint64).reshape(len(rows), n))
                   for n, rows in sorted(out.items())]


MATCHES = "part int, block int, row int, doc_id long, text_key long, n_words long, runs array<struct<first:int,stop:int,item_id:string>>"


def _match(names, groups, span):
    runs_type = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("item_id", pa.string())]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                block = Block(row)
                runs: list[list] = [[] for _ in block.doc_ids]
                for items, windows in groups:
                    window, start = block.phrases(windows) if span is None else block.near(windows, span)
                    n = windows.shape[1] if span is None else 1
                    item = items[window]
                    order = np.lexsort((start, item))
                    item, start = item[order], start[order]
                    doc = block.doc_of(start)
                    fresh = np.ones(len(start), bool)
                    fresh[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n)
                    opens = np.flatnonzero(fresh)
                    closes = np.append(opens[1:], len(start)) - 1
                    for a, b in zip(opens.tolist(), closes.tolist()):
                        d = int(doc[a])
                        base = int(block.starts[d])
                        runs[d].append({"first": int(start[a]) - base, "stop": int(start[b]) - base + n, "item_id": names[item[a]]})
                k = len(runs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(range(k), pa.int32()),
                    pa.array(block.doc_ids, pa.int64()), pa.array(block.text_keys, pa.int64()), pa.array(np.diff(block.starts), pa.int64()),
                    pa.array(runs, runs_type)], ["part", "block", "row", "doc_id", "text_key", "n_words", "runs"])
    return run


def matches(index: DataFrame, windows: DataFrame, span: int | None = None, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """One row per document, with the runs of its words that windows of an item cover (`span`: the near places instead)."""
    total = windows.count()
    slices = max(1, -(-total // slice_windows))
    passes = []
    for k in range(slices):
        own = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)) == k)
        names, groups = _by_length([(r.item_id, bytes(r.words)) for r in own.collect()])
        passes.append(index.mapInArrow(_match(names, groups, span), MATCHES))
    if slices == 1:
        return passes[0]
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    return every.groupBy("part", "block", "row", "doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def phrase_matches(index: DataFrame, windows: DataFrame, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    return matches(index, windows, None, slice_windows)


def proximity_matches(index: DataFrame, windows: DataFrame, span: int = 2 * WINDOW, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    return matches(index, windows, span, slice_windows)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit (words in any occurrence), the items found, and text_key (hash of its text)."""
    found = phrase_matches(build_index(docs), test_windows(benchmark, size))
    hit = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r.stop - F.greatest(r.first, s.stop))).alias("n"),
                              F.greatest(s.stop, r.stop).alias("stop")), lambda s: s.n)
    items = F.array_sort(F.array_distinct(F.transform("runs", lambda r: r.item_id)))
    return found.select("doc_id", "text_key", "n_words", hit.cast("long").alias("n_hit"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without a word in any test window; columns unchanged."""
    bad = contamination(docs, benchmark, size).where("n_hit > 0").select("text_key").distinct()
    keyed = docs.select(as_struct(docs).alias("doc"), F.xxhash64("text").alias("text_key"))
    return from_struct(keyed.join(bad, "text_key", "left_anti"), "doc", docs.columns)


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"coalesce(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


@query("op7_positional_index_decontamination", f"""
WITH doc AS (SELECT row_number() OVER () AS i, doc_id, {WORDS_SQL} AS words FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, words, least({WINDOW}, len(words)) AS n FROM (SELECT item_id, {WORDS_SQL} AS words FROM benchmark) WHERE len(words) > 0),
sought AS (SELECT DISTINCT item_id, n, array_to_string(words[pos:pos + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS pos FROM item)),
gram AS (SELECT i, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS gram
  FROM (SELECT i, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM doc, (SELECT DISTINCT n FROM sought) WHERE len(words) >= n)),
found AS (SELECT i, n, pos, item_id FROM gram JOIN sought USING (n, gram)),
hit AS (SELECT i, count(DISTINCT place) AS n_hit FROM (SELECT i, unnest(range(pos, pos + n)) AS place FROM found) GROUP BY i),
held AS (SELECT i, count(*) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS ids FROM (SELECT DISTINCT i, item_id FROM found) GROUP BY i)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN hit USING (i) LEFT JOIN held USING (i)""")
def op7(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
