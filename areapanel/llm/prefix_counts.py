"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

For each prefix of a piece of text one token ends its tokenisation: the one that the vocabulary holds and that is
compatible with the last token of what comes before it (two tokens are compatible if their joined bytes are
tokenised into just them). So the counts of all prefixes come from one pass. Pieces (words,
numbers, marks, white space) are independent, and each distinct piece is worked out once per task.

Two places depend on what follows: a run of white space before a word gives its last character to the word, and a
contraction such as 'll is one piece once complete. The counts are those of the prefix taken as a text of its own.
The special string in a text is one special token, ordinary text while incomplete.

`prefix_counts` stores, per document, the change of the count at every character; `counts`, `truncate_at`
and `tokens_at` answer from it without encoding again. Null texts are empty.
"""

from __future__ import annotations

import json
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.tables import query, scratch_path, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHED_PIECES = 1_000_000
CACHED_PAIRS = 300_000
CACHED_PREFIXES = 500_000
SHARED_BYTES = 32

#: White space, and how this vocabulary cuts text into pieces.
SPACE = r"[\t\n\x0b\x0c\r \x85\xa0  -     　]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?" + NOT_SPACE[:-1] + r"\p{L}\p{N}]+|" + SPACE + r"+(?!" + NOT_SPACE + r")|" + SPACE + "+")
CONTRACTIONS = ("'re", "'ve", "'ll")


class Vocabulary:
    """Byte-pair merges read from a tokenizer file."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        # a token's rank: single bytes first, then the order of the merges; halves: what each was merged from
        self.rank = {token: 0 for token in self.ids if len(token) == 1}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.joined: dict[tuple[bytes, bytes], int] = {}
        for i, (a, b) in enumerate(pairs, 1):
            a, b = raw(a), raw(b)
            self.rank[a + b], self.halves[a + b], self.joined[a, b] = i, (a, b), i
        self._fits: dict = {}
        self._prefixes: dict[bytes, bytes] = {}

    def fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether `token` can follow `before` (None: it begins the piece): undoing merges on both sides of the border from
        the latest back, no pair across it may have been due earlier than what is undone."""
        if before is None:
            return True
        key = (before, token)
        held = self._fits.get(key)
        if held is None:
            if len(self._fits) >= CACHED_PAIRS:
                self._fits.clear()
            held = self._fits[key] = self._compatible(before, token)
        return held

    def _compatible(self, left: bytes, right: bytes) -> bool:
        # what is undone last on the left must stay undone only before `limit`; a merge on the right wins ties
        limit = (1 << 30, 0)
        while True:
            due = self.joined.get((left, right))
            if due is not None and (due, 0) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a == 0 and b == 0:
                return True
            if a > b:
                limit, left = (a, 0), self.halves[left][1]
            else:
                limit, right = (b, 1), self.halves[right][0]

    def piece_counts(self, data: bytes) -> list[int]:
        """Token count of data[:i] for every i. What ends a prefix follows from the prefix alone, so pieces that begin alike share it."""
        n, known, rank, held_fits = len(data), self._prefixes, self.rank, self._fits
        if len(known) > CACHED_PREFIXES:
            known.clear()
        # begins[i]: where the last token of data[:i] begins; up to SHARED_BYTES the begins of a prefix are kept under it
        done = min(n, SHARED_BYTES)
        while done and data[:done] not in known:
            done -= 1
        begins = [0, *known[data[:done]]] if done else [0]
        for i in range(done + 1, n + 1):
            # only one token fits, so the first one met from the shortest on is it
            at = i - 1
            while at:
                token = data[at:i]
                if token in rank:
                    key = (data[begins[at]:at], token)
                    fits = held_fits.get(key)
                    if self.fits(*key) if fits is None else fits:
                        break
                at -= 1
            begins.append(at)
            if i <= SHARED_BYTES:
                known[data[:i]] = bytes(begins[1:])
        counts = [0]
        for at in begins[1:]:
            counts.append(counts[at] + 1)
        return counts


class PieceChanges(dict):
    """Piece of text: the change of its token count at each character, as signed 16-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def counts(self, piece: str) -> list[int]:
        counts = self.vocabulary.piece_counts(piece.encode("utf-8"))
        if not piece.isascii():
            ends, end = [0], 0
            for c in piece:
                end += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                ends.append(end)
            counts = [counts[i] for i in ends]
        if piece in CONTRACTIONS:
            counts[2] = self.vocabulary.piece_counts(piece[:1].encode())[-1] + self.vocabulary.piece_counts(piece[1:2].encode())[-1]
        return counts

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        counts = self.counts(piece)
        out = self[piece] = array("h", map(sub, counts[1:], counts)).tobytes()
        return out

    def size(self, piece: str) -> int:
        return int(np.frombuffer(self[piece], np.int16).sum())


class PrefixCounter:
    """Token counts of all prefixes of a text."""

    def __init__(self, name: str = VOCABULARY):
        self.vocabulary = Vocabulary(name)
        self.changes = PieceChanges(self.vocabulary)
        self.pieces = regex.compile(PIECES)
        self.runs = regex.compile(SPACE + r"{2,}(?=" + NOT_SPACE + ")")
        self.specials = regex.compile("|".join(map(regex.escape, self.vocabulary.special)) or r"(?!)")

    def ordinary(self, text: str) -> np.ndarray:
        """counts[i] for text[:i], special strings taken as ordinary text."""
        changes = np.frombuffer(b"".join(map(self.changes.__getitem__, self.pieces.findall(text))), np.int16)
        counts = np.zeros(len(text) + 1, np.int32)
        np.cumsum(changes, out=counts[1:])
        for run in self.runs.finditer(text):
            whole = run.group()
            counts[run.end()] += self.changes.size(whole) - self.changes.size(whole[:-1]) - self.changes.size(whole[-1])
        return counts

    def counts(self, text: str) -> np.ndarray:
        found = [m.span() for m in self.specials.finditer(text)]
        if not found:
            return self.ordinary(text)
        out, base, at = [np.zeros(1, np.int32)], 0, 0
        for lo, hi in found:
            part = self.ordinary(text[at:hi])
            out.append(base + part[1:-1])
            base += int(part[lo - at]) + 1
            out.append(np.array([base], np.int32))
            at = hi
        out.append(base + self.ordinary(text[at:])[1:])
        return np.concatenate(out)


_kept: dict[str, PrefixCounter] = {}


def prefix_counter(name: str) -> PrefixCounter:
    """One per worker process, shared by its tasks."""
    if name not in _kept:
        _kept[name] = PrefixCounter(name)
    return _kept[name]


def _store(name: str):
    def run(batches):
        counter = prefix_counter(name)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 256):
                rows = [np.diff(counter.counts(t.as_py() or "")) for t in texts.slice(lo, 256)]
                wide = [bool(len(r) and np.abs(r).max() > 127) for r in rows]
                blobs = [r.astype(np.int32 if w else np.int8).tobytes() for r, w in zip(rows, wide)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), batch.column(2).slice(lo, 256), pa.array(wide, pa.bool_()),
                                                  pa.array(blobs, pa.binary())], ["doc_id", "n_bytes", "wide", "changes"])
    return run


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, wide, changes: the stored change of the count at each character (wide: 32 bits each, else 8)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    path = scratch_path(docs.sparkSession, "prefixes")
    rows.mapInArrow(_store(vocabulary), "doc_id long, n_bytes long, wide boolean, changes binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def counts_of(changes: bytes, wide: bool) -> np.ndarray:
    """Counts of all prefixes from what is stored: entry i is the count of the first i characters."""
    steps = np.frombuffer(changes, np.int32 if wide else np.int8)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def truncate_at(changes: bytes, wide: bool, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(counts_of(changes, wide) <= budget)[-1])


def tokens_at(stored: DataFrame, budget: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, kept_chars: the longest prefix within the budget, from the stored counts."""
    def run(batches):
        for batch in batches:
            totals, kept = [], []
            for wide, changes in zip(batch.column(2).to_pylist(), batch.column(3)):
                counts = counts_of(changes.as_buffer(), wide)
                totals.append(int(counts[-1]))
                kept.append(int(np.flatnonzero(counts <= budget)[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(kept, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens", "kept_chars"])
    return stored.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, kept_chars long")


@query("op5_prefix_token_counts")
def op5(spark, folder):
    counted = tokens_at(prefix_counts(table(spark, folder, "documents")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "kept_chars")
