"""Token files of directly addressable codes: any token by its place, without decoding what lies before it.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id and a bitmap of those that go on;
level k holds the next chunk of those, in the same order, and its own bitmap. A rank directory (ones before
every 512 bits) turns a place in one level into the place in the next. A file also holds its documents'
ids and first tokens.

Documents are written in ascending id order, one run of files per range partition; equal ids follow in the
order of their text's hash. Null texts are empty, each document ends with the end id; null ids come first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from areapanel.llm.elias_fano import from_bytes, to_bytes
from areapanel.llm.files import mapped, write_new
from areapanel.llm.tables import query, scratch_path, stage, table
from areapanel.llm.words import blocks

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CHUNK_BITS = 8
FILE_TOKENS = 4_000_000
CACHED_WORDS = 700_000
CACHED_PIECES = 300_000
READ_TOKENS = 1 << 18
BLOCK_BYTES = 8 << 20
LARGE_BYTES = 64 << 20
BLOCK_BITS = 512


class Codes:
    """Directly addressable codes of an array of ids."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @staticmethod
    def build(ids: np.ndarray) -> Codes:
        rest, levels, n = ids.astype(np.uint64), [], len(ids)
        while len(rest):
            more = rest >> np.uint64(CHUNK_BITS)
            goes_on = more > 0
            bits = np.zeros(-(-(len(rest) + 1) // BLOCK_BITS) * BLOCK_BITS, bool)
            bits[:len(rest)] = goes_on
            bitmap = np.packbits(bits, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bitmap).reshape(-1, BLOCK_BITS // 64).sum(1, dtype=np.uint32)
            rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)
            levels.append(((rest & np.uint64(255)).astype(np.uint8), bitmap, rank))
            rest = more[goes_on]
        return Codes(n, levels)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids at these places."""
        at = at.astype(np.int64)
        out, rows = np.zeros(len(at), np.uint64), np.arange(len(at))
        for depth, (chunks, bitmap, rank) in enumerate(self.levels):
            out[rows] |= chunks[at].astype(np.uint64) << np.uint64(CHUNK_BITS * depth)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            on = (bitmap[word] >> bit) & np.uint64(1) > 0
            at, rows, word, bit = at[on], rows[on], word[on], bit[on]
            if not len(at):
                break
            block = at // BLOCK_BITS
            ones = rank[block].astype(np.int64) + np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for k in range(1, BLOCK_BITS // 64):
                before = word - k
                ones += np.where(before >= block * (BLOCK_BITS // 64), np.bitwise_count(bitmap[np.maximum(before, 0)]), 0).astype(np.int64)
            at = ones
        return out


    def ones_before(self, depth: int, place: int) -> int:
        _, bitmap, rank = self.levels[depth]
        block, word = place // BLOCK_BITS, place >> 6
        ones = int(rank[block]) + int(np.bitwise_count(bitmap[block * (BLOCK_BITS // 64):word]).sum())
        return ones + int(np.bitwise_count(bitmap[word] & ((np.uint64(1) << np.uint64(place & 63)) - np.uint64(1))))

    def span(self, lo: int, hi: int, depth: int = 0) -> np.ndarray:
        """Ids of a stretch of places: what goes on is a stretch in the next level too."""
        chunks, bitmap, _ = self.levels[depth]
        out = chunks[lo:hi].astype(np.uint32)
        bits = np.unpackbits(bitmap[lo >> 6:(hi + 63) >> 6].view(np.uint8), bitorder="little")[lo & 63:(lo & 63) + hi - lo]
        on = np.flatnonzero(bits)
        if len(on):
            first = self.ones_before(depth, lo)
            out[on] |= self.span(first, first + len(on), depth + 1) << np.uint32(CHUNK_BITS * (depth + 1) - CHUNK_BITS * depth)
        return out


class TokenFile:
    """One written file: `codes`, the documents' ids (None where null) and first tokens."""

    def __init__(self, address: str):
        data = mapped(address)
        levels = int(data[8:16].view(np.int64)[0])
        kinds = [np.int64, np.int64, np.uint8, np.int64] + [np.uint8, np.uint64, np.uint32] * levels
        # the head of to_bytes, then: sizes, ids, null marks, first tokens, levels
        arrays = from_bytes(data[16:], kinds)
        n = int(arrays[0][0])
        self.doc_ids, self.nulls, self.starts = arrays[1], arrays[2], arrays[3]
        self.codes = Codes(n, [tuple(arrays[4 + 3 * k:7 + 3 * k]) for k in range(levels)])

    def tokens(self, document: int) -> np.ndarray:
        return self.codes.span(int(self.starts[document]), int(self.starts[document + 1]))

    def documents(self, n_tokens: int = READ_TOKENS):
        """The ids of every document in order, read in stretches of about `n_tokens` that end between documents."""
        lo, n = 0, len(self.doc_ids)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + n_tokens, "right")) - 1)
            hi = min(hi, n)
            first = int(self.starts[lo])
            ids = self.codes.span(first, int(self.starts[hi]))
            yield from np.split(ids, self.starts[lo + 1:hi] - first)
            lo = hi


MAGIC = b"DACODES1"


def write_file(folder: str, doc_ids: list, lengths: list[int], ids: np.ndarray) -> str:
    codes = Codes.build(ids)
    arrays = [np.array([len(ids)], np.int64), np.array([d or 0 for d in doc_ids], np.int64), np.array([d is None for d in doc_ids], np.uint8),
              np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]
    for level in codes.levels:
        arrays += level
    return write_new(folder, "dac", [MAGIC, np.array([len(codes.levels)], np.int64).tobytes(), *to_bytes(arrays)])


#: Marks that often end a word, and how the vocabulary cuts lower-case text into pieces.
END_MARKS = ",.;:!?"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class StandIns(dict):
    """A character's UTF-8 bytes as the letters that stand for them in a byte-level vocabulary."""

    def __init__(self):
        super().__init__()
        # bytes that are no visible ASCII or Latin-1 mark stand in the vocabulary as letters from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(self.byte[b] for b in chr(code).encode("utf-8"))
        return out


class PieceIds(dict):
    """Ids of a piece, from the library's model, as bytes; kept for pieces seen before. Many words differ only in case or in a mark at their end."""

    def __init__(self, model, size: int):
        super().__init__()
        self.model, self.stand_ins = model, StandIns()
        self.four = [row.tobytes() for row in np.arange(size, dtype="<u4")]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        shown = piece if piece.isascii() and piece.isprintable() else piece.translate(self.stand_ins)
        out = self[piece] = b"".join([self.four[t.id] for t in self.model.tokenize(shown)])
        return out


class WordIds(dict):
    """Ids of a stretch of text between white space, as bytes; kept for words seen before.

    Words of characters below U+0180 are lower-cased and cut into pieces here, as the vocabulary does, and only the pieces
    go to the library's model; other words, and those that may hold a special string, go to the library whole.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.encoder = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.pieces = PieceIds(self.encoder.model, max(self.encoder.get_vocab().values()) + 1)
        self.cut = regex.compile(PIECES)

    def encode(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if "<|" in word or not (word.isascii() or max(word) < "\u0180"):
            out = self.encode(word)
        else:
            low = word.lower()
            stem = low.rstrip(END_MARKS)
            if stem.isalpha():  # letters are one piece, the marks after them another
                out = self.pieces[stem] if len(stem) == len(low) else self.pieces[stem] + self.pieces[low[len(stem):]]
            else:
                out = b"".join(map(self.pieces.__getitem__, self.cut.findall(low)))
        self[word] = out
        return out

    def text(self, text: str) -> bytes:
        """White space always ends a word of this vocabulary and is no part of it, so stretches are independent."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an array without nulls, one after the other, and the number of ids of each. A stretch is looked up once an array."""
        if texts.nbytes > LARGE_BYTES:  # one text of that size; Arrow's offsets of the ids could run over
            parts = [self.text(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
        stretches = pc.ascii_split_whitespace(texts)
        places = stretches.flatten().dictionary_encode()
        ids = pa.array(list(map(self.__getitem__, places.dictionary.to_pylist())), pa.binary()).take(places.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(), dtype=np.int64) // 4])
        data = np.frombuffer(ids.buffers()[2] or b"", "<u4")[:ends[-1]]
        return data, np.diff(ends[stretches.offsets.to_numpy()])


_kept: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One per worker process, shared by its tasks."""
    if vocabulary not in _kept:
        _kept[vocabulary] = WordIds(vocabulary)
    return _kept[vocabulary]


def _write(folder: str, vocabulary: str, end_id: int, file_tokens: int):
    def run(batches):
        words, part, number = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, total = [], [], [], 0

        def flush():
            ids = np.concatenate(held)
            address = write_file(folder, doc_ids, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([address]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                                               pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64())],
                                              ["address", "part", "number", "n_docs", "n_tokens"])
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in blocks(texts, BLOCK_BYTES):
                ids, sizes = words.texts(texts.slice(lo, hi - lo))
                ends = np.cumsum(sizes)
                ids, sizes, ends = np.insert(ids, ends, end_id), sizes + 1, ends + np.arange(1, len(ends) + 1)
                own, at = batch.column(0).slice(lo, hi - lo).to_pylist(), 0
                while at < len(own):
                    before = int(ends[at] - sizes[at])
                    # the document that fills the file is its last
                    to = min(len(own), int(np.searchsorted(ends, before + file_tokens - total)) + 1)
                    doc_ids += own[at:to]
                    lengths += sizes[at:to].tolist()
                    held.append(ids[before:ends[to - 1]])
                    total += len(held[-1])
                    at = to
                    if total >= file_tokens:
                        yield flush()
                        doc_ids, lengths, held, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield flush()
    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files; the manifest: address, part, number, n_docs, n_tokens, start (of its first token among all)."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_k"))
    ordered = ordered.repartitionByRange("doc_id", "_k").sortWithinPartitions("doc_id", "_k").select("doc_id", "text")
    manifest = stage(ordered.mapInArrow(_write(folder, vocabulary, end_id, file_tokens),
                                        "address string, part int, number int, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for address, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(address)
            crcs = [zlib.crc32(ids.astype("<u4", copy=False)) for ids in file.documents()]
            yield pa.RecordBatch.from_arrays([
                pa.array(file.doc_ids, mask=file.nulls.astype(bool)), pa.array(file.starts[:-1] + start),
                pa.array(np.diff(file.starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = manifest.select("address", "start")
    return files.repartition(max(1, files.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op3_addressable_token_files")
def op3(spark, folder):
    docs = table(spark, folder, "documents")
    return read_digests(write_tokens(docs, scratch_path(spark, "tokens")))
