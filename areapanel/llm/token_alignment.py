"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, and how many documents link each id pair.

Two dictionaries, arrays over the byte offsets of a text, lead from a token's end to its index, one per tokenizer. The intersection
of their keys, in order, cuts both id lists into groups, the smallest runs of tokens that cover the same bytes. Every token of a group is
linked with every token of the other side; links are expanded group by group, large groups by their distinct ids and multiplicities.

Both tokenizers end a token before a space that follows a character other than white space: the pattern of the first takes a space only at a
token's begin or in white space, and no piece of the second holds a space after anything else. So a text is a row of stretches, each worked out
once and kept; a text's ids, groups and links are those of its stretches in order. Stretches not met before are aligned many at a time, as one text.

`align` keeps the alignment as a table: ids of both sides and one bit per token that ends a group, in blocks of
about `BLOCK_BYTES` of text. The documents that hold a pair linked are counted per block first; blocks then ask for the counts of their own pairs,
so neither texts nor expanded links are shuffled. A pair that every document holds is one row per block.

Texts that are null, empty, or not given back byte for byte by one of the tokenizers (a literal U+2581, for one) have no tokens.
Repeated rows count as documents of their own; ties for the highest count all count. An empty table gives no rows. Other columns are not read.
A text is worked on in one task; its links are held as distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import query, scratch_path, stage, table
from areapanel.llm.words import blocks

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20
CHUNK_LINKS = 1_000_000
LARGE_GROUP = 4096
HELD_PAIRS = 2_000_000
CACHED_STRETCHES = 400_000
KEPT_CHARS = 64
LINE_CHARS = 2048
MAX_BUCKETS = 100_000
#: The fast encoder's pattern engine has a bounded stack; texts with a longer run of white space go to the other one.
LONG_BLANK = re.compile(r"\s{5000}")
#: A space that begins a stretch; one that ends the text does not.
BORDER = re.compile(r" (?<=\S )(?!\Z)")
#: What no piece of the second vocabulary may hold, else whole texts are the stretches.
ACROSS = re.compile(r"[^▁]▁")


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary; special strings are ordinary text."""

    def __init__(self, name: str):
        import tiktoken
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.path = path
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def encode(self, text: str) -> list[int]:
        if len(text) < 5000 or not LONG_BLANK.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and bytes of a piece vocabulary with byte fallback."""

    def __init__(self, name: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))
        self.apart = not any(ACROSS.search(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))


class Pair:
    """Two tokenizers, with token lengths, and token numbers as text followed by what comes after them (`,` or the end of a side)."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.lengths = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]
        self.names = [np.array([f"{i}{after}" for i in range(len(x.bytes)) for after in (",", end)], object) for x, end in ((self.a, "|"), (self.b, ";"))]
        self.width = [np.uint16 if len(x.bytes) <= 1 << 16 else np.uint32 for x in (self.a, self.b)]
        self.digits = [np.array([len(str(i)) for i in range(len(x.bytes))], np.int64) for x in (self.a, self.b)]
        self.stretches = Stretches(self)

    def cut(self, text: str) -> list[str]:
        """The text's stretches without the space before each; an empty text has none."""
        return (BORDER.split(text) if self.b.apart else [text]) if text else []

    def groups(self, text: str, b: list[int]) -> tuple[np.ndarray, ...] | None:
        """(ids, ids, cuts, cuts): the cuts count each side's tokens up to every common end. None for a text that a tokenizer does not give back."""
        whole = b" " + text.encode("utf-8")
        if b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        a = self.a.encode(" " + text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.zeros((2, len(whole) + 1), np.int64)
        for ends, ids, lengths in ((ends_a, a, self.lengths[0]), (ends_b, b, self.lengths[1])):
            ends[np.cumsum(lengths[ids])] = np.arange(1, len(ids) + 1)
        common = np.flatnonzero((ends_a > 0) & (ends_b > 0))
        return a, b, ends_a[common], ends_b[common]

    def written(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """The groups as text: ids joined by commas, sides by |, groups by ;."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cuts_a - 1] = last_b[cuts_b - 1] = 1
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(cuts_b - np.diff(cuts_b, prepend=0), np.diff(cuts_a, prepend=0))] = self.names[0][2 * a + last_a]
        out[np.arange(len(b)) + np.repeat(cuts_a, np.diff(cuts_b, prepend=0))] = self.names[1][2 * b + last_b]
        return "".join(out.tolist())[:-1]


#: What is kept for a stretch that a tokenizer does not give back.
LOST = (b"", b"", b"", 0)


class Stretches(dict):
    """Stretch of text: ids of both sides, written twice and one more for the last of a group; the groups as text; the number of links.

    What is asked for before it is known is the stretch alone, filled by `learn`.
    """

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair, self.waiting = pair, []

    def __missing__(self, stretch: str) -> list:
        out = self[stretch] = [stretch]
        self.waiting.append(out)
        return out

    def learn(self) -> None:
        """Fill what was asked for; long ones are not kept."""
        lines, alone, room = [], [], 0
        for kept in self.waiting:
            stretch = kept[0]
            if len(stretch) > KEPT_CHARS:
                del self[stretch]
            if stretch[-1].isspace():
                # it ends its text: a space after it could change its tokens
                alone.append([kept])
                continue
            room -= len(stretch) + 1
            if room < 0:
                lines.append([])
                room = LINE_CHARS - len(stretch) - 1
            lines[-1].append(kept)
        lines += alone
        self.waiting = []
        texts = [" ".join([kept[0] for kept in line]) for line in lines]
        for line, text, b in zip(lines, texts, self.pair.b.model.encode(texts, num_threads=1)):
            for kept, found in zip(line, self.aligned([kept[0] for kept in line], text, b)):
                kept[:] = found
        if len(self) > CACHED_STRETCHES:
            self.clear()

    def aligned(self, line: list[str], text: str, b: list[int]) -> list[tuple]:
        """What is kept for the stretches of a line; worked out one by one if the line is not given back."""
        found = self.pair.groups(text, b)
        if found is None:
            return [self.aligned([s], s, self.pair.b.model.encode(s))[0] for s in line] if len(line) > 1 else [LOST]
        a, b, cuts_a, cuts_b = found
        ends = np.cumsum([len(s.encode("utf-8")) + 1 for s in line])
        common = np.cumsum(self.pair.lengths[0][a])[cuts_a - 1]
        at = np.searchsorted(common, ends)
        if not np.array_equal(common[at], ends):
            raise RuntimeError("a stretch does not end tokens of both sides")
        parts, written = [], np.zeros(len(line), np.int64)
        for ids, cuts, digits in zip((a, b), (cuts_a, cuts_b), self.pair.digits):
            marked = 2 * ids
            marked[cuts - 1] += 1
            parts.append((marked.astype(np.uint32).tobytes(), 4 * cuts[at]))
            written += np.cumsum(digits[ids] + 1)[cuts[at] - 1]
        parts.append((self.pair.written(*found).encode() + b";", written))
        links = np.cumsum(np.diff(cuts_a, prepend=0) * np.diff(cuts_b, prepend=0))[at]
        pieces = [[whole[x:y] for x, y in zip([0, *hi], hi)] for whole, hi in ((whole, to.tolist()) for whole, to in parts)]
        return list(zip(*pieces, np.diff(links, prepend=0).tolist()))


_kept: dict = {}


def pair_of(a: str, b: str) -> Pair:
    """One per worker process."""
    if (a, b) not in _kept:
        _kept[a, b] = Pair(a, b)
    return _kept[a, b]


ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "a_ids binary, b_ids binary, a_marks binary, b_marks binary")


def _whole(parts: list[list], width_a, width_b) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, ids, ids, marks, marks of a text from what is kept for its stretches."""
    a, b, written, n_links = zip(*parts) if parts else [()] * 4
    if not parts or not all(a):
        return 0, 0, 0, 0, "", b"", b"", b"", b""
    a, b = (np.frombuffer(b"".join(x), np.uint32) for x in (a, b))
    last = [(x & 1).astype(bool) for x in (a, b)]
    return (len(a), len(b), int(np.count_nonzero(last[0])), sum(n_links), hashlib.sha256(memoryview(b"".join(written))[:-1]).hexdigest(),
            (a >> 1).astype(width_a).tobytes(), (b >> 1).astype(width_b).tobytes(), *[np.packbits(x).tobytes() for x in last])


def _align(name_a: str, name_b: str, block_bytes: int):
    def run(batches):
        pair = pair_of(name_a, name_b)
        first = TaskContext.get().partitionId() << 32
        number, filled = 0, 0
        for batch in batches:
            for lo, hi in blocks(batch.column(1), 1 << 20):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                parts = [list(map(pair.stretches.__getitem__, pair.cut(text))) for text in texts]
                pair.stretches.learn()
                rows = []
                for text, own in zip(texts, parts):
                    size = len(text)
                    if filled and filled + size > block_bytes:
                        number, filled = number + 1, 0
                    filled += size
                    rows.append((first + number, *_whole(own, *pair.width)))
                block, n_a, n_b, n_groups, n_links, digest, *parts = zip(*rows)
                longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), batch.column(0).slice(lo, hi - lo), *longs, pa.array(digest, pa.string()),
                     *[pa.array(x, pa.binary()) for x in parts]],
                    ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids", "a_marks", "b_marks"])
    return run


def align(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The alignment of every text of docs (doc_id, text), kept as a table: see `ALIGNED`.

    The table is bucketed by block as the tasks write it, so that what is asked for a block later meets it without moving the alignment.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    name = f"aligned_{uuid.uuid4().hex}"
    rows.mapInArrow(_align(a, b, block_bytes), ALIGNED).write.option("path", scratch_path(spark, "aligned")).option("compression", "zstd").bucketBy(
        buckets, "block").saveAsTable(name)
    return spark.table(name)


# --- links ---------------------------------------------------------------------------------------------------------

def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """(group, a, b, times) of all linked pairs, in chunks; n_a and n_b are the groups' sizes, ids follow each other."""
    at_a, at_b, n = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    single = np.flatnonzero(n == 1)
    for lo in range(0, len(single), CHUNK_LINKS):
        group = single[lo:lo + CHUNK_LINKS]
        yield group, a[at_a[group]], b[at_b[group]], np.ones(len(group), np.int64)
    small = np.flatnonzero((n > 1) & (n <= LARGE_GROUP))
    before = np.cumsum(n[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(before, (before[lo - 1] if lo else 0) + CHUNK_LINKS, "right")))
        part = small[lo:hi]
        group = np.repeat(part, n[part])
        inside = np.arange(len(group)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        yield group, a[at_a[group] + inside // n_b[group]], b[at_b[group] + inside % n_b[group]], np.ones(len(group), np.int64)
        lo = hi
    for g in np.flatnonzero((n > 1) & (n > LARGE_GROUP)).tolist():
        left, times_a = np.unique(a[at_a[g]:at_a[g] + n_a[g]], return_counts=True)
        right, times_b = np.unique(b[at_b[g]:at_b[g] + n_b[g]], return_counts=True)
        step = max(1, CHUNK_LINKS // len(right))
        for lo in range(0, len(left), step):
            x, t = left[lo:lo + step], times_a[lo:lo + step]
            yield np.full(len(x) * len(right), g), np.repeat(x, len(right)), np.tile(right, len(x)), np.outer(t, times_b).ravel()


def _sizes(marks: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all groups, text after text, and the text of each."""
    sizes, owner = [], []
    for i, (bits, n) in enumerate(zip(marks.to_pylist(), counts.tolist())):
        if n:
            size = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n)), prepend=-1)
            sizes.append(size)
            owner.append(np.full(len(size), i))
    none = np.zeros(0, np.int64)
    return (np.concatenate(sizes), np.concatenate(owner)) if sizes else (none, none)


def linked_pairs(rows: pa.RecordBatch, width_a, width_b):
    """(text, a, b, times) of the links of some rows of an alignment, in chunks."""
    column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
    a = np.frombuffer(b"".join(column["a_ids"].to_pylist()), width_a).astype(np.int64)
    b = np.frombuffer(b"".join(column["b_ids"].to_pylist()), width_b).astype(np.int64)
    n_a, text = _sizes(column["a_marks"], column["n_a"].to_numpy())
    n_b, _ = _sizes(column["b_marks"], column["n_b"].to_numpy())
    for group, x, y, times in links(a, b, n_a, n_b):
        yield text[group], x, y, times


def _slices(batch: pa.RecordBatch):
    """Row ranges of at most CHUNK_LINKS links, one row at least, inside one block."""
    block, n = batch.column(0).to_numpy(), batch.column(batch.schema.names.index("n_links")).to_numpy()
    lo, held = 0, 0
    for i in range(len(n)):
        if i > lo and (held + n[i] > CHUNK_LINKS or block[i] != block[lo]):
            yield lo, i
            lo, held = i, 0
        held += int(n[i])
    if lo < len(n):
        yield lo, len(n)


def _requests(widths, span_b: int, span: int):
    """block, a, b, documents: in how many of the block's documents the pair is linked."""
    def merged(held):
        key, n = (np.concatenate(x) for x in zip(*held))
        key, at = np.unique(key, return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, at, n)
        return key, out

    def rows(block, held):
        key, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array((key // span_b).astype(np.int32)),
                                           pa.array((key % span_b).astype(np.int32)), pa.array(n)], ["block", "a", "b", "documents"])

    def run(batches):
        held, size, block = [], 0, None
        for batch in batches:
            for lo, hi in _slices(batch):
                own = int(batch.column(0)[lo].as_py())
                if held and own != block:
                    yield rows(block, held)
                    held, size = [], 0
                block = own
                seen = [np.zeros(0, np.int64)]
                for text, a, b, _ in linked_pairs(batch.slice(lo, hi - lo), *widths):
                    seen.append(np.unique(text * span + a * span_b + b))
                if len(seen) > 2:
                    seen = [np.unique(np.concatenate(seen))]
                key, n = np.unique(seen[-1] % span, return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > HELD_PAIRS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield rows(block, held)
                        held, size = [], 0
        if held:
            yield rows(block, held)
    return run


def _answer(widths, span_b: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("a").to_numpy().astype(np.int64) * span_b + right.column("b").to_numpy()
        order = np.argsort(keys)
        keys, documents, best = keys[order], right.column("documents").to_numpy()[order], right.column("best").to_numpy()[order].astype(bool)
        totals, bests = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        at = 0
        for batch in left.combine_chunks().to_batches():
            for lo, hi in _slices(batch):
                for text, a, b, times in linked_pairs(batch.slice(lo, hi - lo), *widths):
                    found = np.searchsorted(keys, a * span_b + b)
                    np.add.at(totals, at + lo + text, documents[found] * times)
                    np.add.at(bests, at + lo + text, np.where(best[found], times, 0))
            at += len(batch)
        return left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column("n_best", pa.array(bests)).append_column(
            "count_sum", pa.array(totals))
    return run


def pair_counts(requests: DataFrame) -> DataFrame:
    """a, b, documents, best: corpus-wide counts of the pairs; best where it is the highest of its a."""
    counts = requests.groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    # one row per id of the first vocabulary, so its size does not grow with the corpus
    return counts.join(F.broadcast(highest), "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def align_and_count(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    pair = pair_of(a, b)
    span_b, span = len(pair.b.bytes), len(pair.a.bytes) * len(pair.b.bytes)
    aligned = align(docs, a, b, block_bytes)
    wanted = aligned.select("block", "n_a", "n_b", "n_links", "a_ids", "b_ids", "a_marks", "b_marks")
    requests = stage(wanted.mapInArrow(_requests(pair.width, span_b, span), "block long, a int, b int, documents long"), "requests")
    counts = stage(pair_counts(requests), "pairs")
    told = requests.select("block", "a", "b").join(counts, ["a", "b"])
    return aligned.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _answer(pair.width, span_b), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


@query("op11_end_dictionary_alignment")
def op11(spark, folder):
    return align_and_count(table(spark, folder, "documents").select("doc_id", "text"))
