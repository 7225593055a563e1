"""Source audit, token alignment and toxic spans against brute force, with nulls, empty, long and repeated texts, ties and clashing names."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from areapanel.llm import source_audit, token_alignment, toxicity

CLASH = "tile long, slot long, term string, n long, block long, toxic int, label int, _key long, rate double, score double"
EXTRA = (1, 2, "t", 3, 4, 5, 6, 7, 0.5, 0.25)


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {CLASH}")


# --- source audit ---

def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_audit(rows, least, top):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        docs = collections.Counter(w for t, g, _ in rows if g == lang for w in set(terms(t)))
        kept = sorted(w for w, n in docs.items() if n >= least)
        sources = sorted({s for _, g, s in rows if g == lang})
        count = {s: collections.Counter(w for t, g, x in rows if g == lang and x == s for w in terms(t) if w in set(kept)) for s in sources}
        count[None] = sum(count.values(), collections.Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            more = sorted((p[None][w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > p[None][w])
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(more[:top])]
    return sorted(out)


AUDIT_ROWS = [("a B c ÉÉ é", "en", "s1"), ("a b a a", "en", "s1"), ("A c d, d2d d", "en", "s2"), (None, "en", "s3"), ("", None, None), ("a c", None, "s1"),
              ("a c", None, "s1"), ("b é été", "fr", "s9"), ("x " * 5000 + "a b", "en", "s2"), ("a b", "en", None), ("a b c d", "en", "s2"), ("solo", "xx", "s1")]


def test_audit_equals_brute_force_in_small_shards_rounds_and_tiles(spark):
    df = frame(spark, AUDIT_ROWS, "text string, lang string, source string")
    want = brute_audit(AUDIT_ROWS, 2, 3)
    for parts in ({}, {"shard_terms": 2, "round_bytes": 60, "tile_cells": 7}):
        got = sorted(tuple(r) for r in source_audit.audit(df, 2, 3, **parts).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == want


def test_audit_without_terms_or_rows(spark):
    df = frame(spark, AUDIT_ROWS, "text string, lang string, source string")
    got = source_audit.audit(df, min_documents=1000).collect()
    assert got and {(r.part, r.value) for r in got} == {("pair", 0)}
    assert source_audit.audit(df.limit(0)).count() == 0


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    import pyarrow as pa
    plain = source_audit.split_words

    def clumsy(texts, between):
        words = plain(texts, between)
        words.hashes = words.hashes % np.uint64(2)
        return words
    monkeypatch.setattr(source_audit, "split_words", clumsy)
    found = source_audit.Distinct(pa.array([b"aa bb AA", b"cc bb"], pa.binary()))
    known = source_audit._terms_of(found.keys, found.lengths).to_pylist()
    assert [known[i] for i in found.word] == [b"aa", b"bb", b"aa", b"cc", b"bb"]


def test_perfect_hash_is_minimal_and_refuses_other_words():
    import pyarrow as pa
    keys = [f"word{i}".encode() for i in range(3000)]
    shard = source_audit._build_shard(pa.table({"lang": ["x"] * 3000, "shard": pa.array([0] * 3000, pa.int64()), "term": pa.array(keys, pa.binary())})).to_pylist()[0]
    perfect = source_audit.PerfectHash(shard["sizes"], shard["bits"], shard["key_hashes"], shard["lengths"], shard["keys"])

    def slots(words):
        found = source_audit.split_words(pa.array(words, pa.binary()), np.zeros(256, bool))
        lengths = np.array([len(w) for w in words])
        return perfect.slots(found.hashes, lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8))
    assert sorted(slots(keys)) == list(range(3000))
    assert set(slots([w + b"x" for w in keys])) == {-1}
    perfect.keys = perfect.keys ^ 1  # same hashes and lengths, other bytes
    assert set(slots(keys)) == {-1}


# --- token alignment ---

TEXTS = ["The cat sat on the mat, isn't it?", "", None, "  two  spaces \n\n and\ttabs ", "<|endoftext|> and <s> </s>", "naïve café — 日本語テキスト 🙂", "a▁b",
         "x" * 5000, "the the the of the", " " * 6000 + "end", "The cat sat on the mat, isn't it?", "1234567890 3.14159", "\x00nul", "ﬁ ligature   mark",
         "undeinpfheitung enenchte ieachau", "".join(map(chr, range(0x4e00, 0x4e00 + 300)))]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def brute_alignment(texts, tokenizers):
    a_model, b_model = tokenizers
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            byte_of[chr(256 + len(byte_of) - len(printable))] = b
    rows = []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
            rows.append([])
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
        groups, lo = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if lo < e <= end], [i for i, e in zip(b, ends_b) if lo < e <= end]))
            lo = end
        rows.append(groups)
    pairs = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in rows]
    count = collections.Counter(p for doc in pairs for p in set(doc))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(own), sum(count[p] == best[p[0]] for p in own),
             sum(count[p] for p in own), hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "")
            for groups, own in zip(rows, pairs)]


@pytest.mark.parametrize("block_bytes,large", [(16 << 20, 4096), (40, 2)])
def test_alignment_equals_brute_force(spark, tokenizers, monkeypatch, block_bytes, large):
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
    df = frame(spark, [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in
           token_alignment.align_and_count(df, block_bytes=block_bytes).collect()}
    want = {i if i != 3 else None: r for i, r in enumerate(brute_alignment(TEXTS, tokenizers))}
    assert got == want
    assert token_alignment.align_and_count(df.limit(0)).count() == 0


@pytest.mark.parametrize("line,cached", [(2048, 400_000), (0, 0), (9, 50)])
def test_stretches_of_a_text_are_aligned_once(tokenizers, monkeypatch, line, cached):
    """Stretches met before are not encoded again, and texts put together from them equal texts aligned whole."""
    monkeypatch.setattr(token_alignment, "LINE_CHARS", line)
    monkeypatch.setattr(token_alignment, "CACHED_STRETCHES", cached)
    rng = np.random.default_rng(3)
    signs = [*[" "] * 8, *"abest'.,!9", "'s", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "é", "中", "\u0301", "🙂", "  ", "the", "<s>", "\0", "x" * 70]
    texts = TEXTS + ["".join(rng.choice(signs, n)) for n in (1, 2, 3, 10, 40, 200) for _ in range(20)]
    pair = token_alignment.Pair(token_alignment.BYTE_LEVEL, token_alignment.PIECES)
    encoded, encode = [], pair.a.encode
    monkeypatch.setattr(pair.a, "encode", lambda text: encoded.append(text) or encode(text))
    for again in (False, True):
        parts = [list(map(pair.stretches.__getitem__, pair.cut(t or ""))) for t in texts]
        pair.stretches.learn()
        got = [token_alignment._whole(x, *pair.width) for x in parts]
        assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(*r[:4], r[6]) for r in brute_alignment(texts, tokenizers)]
        if again and cached == 400_000:
            assert all(len(t) > token_alignment.KEPT_CHARS for t in encoded)
        encoded.clear()


def test_links_of_large_groups_are_expanded_by_distinct_ids(monkeypatch):
    a, b = np.array([1, 1, 2, 9, 3, 3]), np.array([5, 6, 5, 7, 8])
    n_a, n_b = np.array([3, 1, 2]), np.array([3, 1, 1])
    want = collections.Counter()
    for g, (xs, ys) in enumerate(zip(np.split(a, [3, 4]), np.split(b, [3, 4]))):
        want.update((g, int(x), int(y)) for x in xs for y in ys)
    for large, chunk in ((4096, 1_000_000), (2, 3), (0, 1)):
        monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
        monkeypatch.setattr(token_alignment, "CHUNK_LINKS", chunk)
        got = collections.Counter()
        for chunk_rows in token_alignment.links(a, b, n_a, n_b):
            for g, x, y, n in zip(*map(np.ndarray.tolist, chunk_rows)):
                got[g, x, y] += n
        assert got == want


# --- toxic spans ---

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    starts = np.cumsum(lengths) - lengths
    scores = rng.normal(size=8)
    moves, begin = np.array([[0, -1.0], [0.3, 0.8]]), -0.4
    p, surprise, pairs = (layout := toxicity.Chains(lengths, starts)).marginals(scores, np.exp(moves), begin, pairs=True)
    marginal = np.empty(8)
    marginal[layout.places] = p
    want_pairs = np.zeros((2, 2))
    for k, (n, s) in enumerate(zip(lengths, starts)):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            w = begin * path[0] + sum(scores[s + i] * path[i] for i in range(n)) + sum(moves[x, y] for x, y in zip(path, path[1:]))
            weights[path] = np.exp(w)
        z = sum(weights.values())
        for i in range(n):
            assert np.isclose(marginal[s + i], sum(w for path, w in weights.items() if path[i]) / z)
        assert np.isclose(surprise[list(layout.order).index(k)], -np.log(weights[(0,) * n] / z))
        for path, w in weights.items():
            for x, y in zip(path, path[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(pairs, want_pairs)


BAD = ["zorgle", "blatfink", "quimpet"]


def toxic_corpus(n=600):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(5, 60)))
        bad = i % 5 == 0
        if bad:
            for w in rng.choice(BAD, 2):
                text.insert(int(rng.integers(0, len(text))), w.upper() if i % 2 else w)
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    # one toxic text and many copies of it: its other words must not become offending
    copy = " ".join(["zorgle", *[f"copyword{j}" for j in range(30)]])
    docs += [(n + i, copy) for i in range(40)]
    labels += [(n + i, 1) for i in range(40)]
    docs += [(n + 100 + i, " ".join([*rng.choice(words, 20), f"copyword{i}"])) for i in range(20)]
    return docs, labels


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    docs, labels = toxic_corpus()
    more = [(None, "zorgle"), (5000, None), (5001, ""), (5002, "123 !!"), (5003, "ban kat " * 20_000 + "blatfink"), (5003, "ban kat"), (5004, "né quimpet?")]
    df = frame(spark, docs + more, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (0, 0), (1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    rows = toxicity.score_texts(df, marks).collect()
    assert len(rows) == len(docs) + len(more)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    known = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(known) > 100 and all(r.predicted == truth[r.doc_id] for r in known)
    assert not any(r.predicted for r in rows if r.doc_id is not None and 700 <= r.doc_id < 800)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[None][0].predicted == 1 and sorted(r.predicted for r in by_id[5003]) == [0, 1]
    assert {len(by_id[i][0].spans) for i in (5000, 5001, 5002)} == {0} and len({by_id[i][0].score for i in (5000, 5001, 5002)}) == 1
    text = "né quimpet?".encode()
    assert [text[s.start:s.end] for s in by_id[5004][0].spans] == [b"quimpet"]


def test_toxicity_with_one_label_only_or_none(spark):
    df = frame(spark, [(i, "some text") for i in range(8)], "doc_id long, text string")
    for marks, score in (([], 0.0), ([(i, 0) for i in range(8)], 0.0), ([(i, 1) for i in range(8)], 1.0)):
        rows = toxicity.score_texts(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
        assert len(rows) == 8 and {r.score for r in rows} == {score}
    assert toxicity.score_texts(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
