"""Word hashes, Elias-Fano sequences and addressable codes against plain Python."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from areapanel.llm import words as W
from areapanel.llm.elias_fano import EliasFano
from areapanel.llm.prefix_counts import VOCABULARY, Vocabulary
from areapanel.llm.token_files import Codes, TokenFile, WordIds, write_file

TEXTS = [b"Hello  world, hello", b"", None, b"xx HELLO", b"a" * 100 + b" b", "Ünïcode\tñ x".encode(), b"q"]


@pytest.mark.parametrize("size", [7, 37, 1 << 20])
def test_words_do_not_depend_on_slices(monkeypatch, size):
    monkeypatch.setattr(W, "SLICE_BYTES", size)
    W._powers.clear()
    found = W.split_words(pa.array(TEXTS, pa.binary()), W.SPACES)
    expected = [w for t in TEXTS if t for w in t.lower().split()]
    assert [found.text(i).lower() for i in range(len(found.hashes))] == expected
    assert np.diff(found.starts).tolist() == [len((t or b"").split()) for t in TEXTS]
    by_word: dict = {}
    for word, h in zip(expected, found.hashes):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    W._powers.clear()


@pytest.mark.parametrize("n,bound", [(0, 10), (1, 5), (300, 1 << 62), (5000, 6000), (2000, 1 << 22)])
def test_elias_fano_access_and_search(n, bound):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, bound, n)).astype(np.uint64)
    sequence = EliasFano.build(values, bound)
    assert (sequence.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, bound, 500).astype(np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert sequence.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_codes_give_any_token():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 49_408, 3000), [0, 255, 256, 65_535, 65_536, 1 << 24], rng.integers(0, 200, 2000)])
    codes = Codes.build(ids)
    at = rng.permutation(len(ids))
    assert (codes.get(at) == ids[at].astype(np.uint64)).all()
    for lo, hi in ((0, len(ids)), (63, 64), (700, 3004), (2990, 3100)):
        assert (codes.span(lo, hi) == ids[lo:hi]).all()
    assert len(Codes.build(np.zeros(0)).levels) == 0


def test_word_ids_equal_the_library():
    words = WordIds("word_bpe_49k.json")
    for text in ["", "Don't  STOP''s", "é<|endoftext|>x", "A\x01B ñ 12ab\nÜber\xadall ¼ªº", "İi ΑΣ' ǅ 日本", "<|startoftext|> x"]:
        ids = np.frombuffer(words.text(text), "<u4").tolist()
        assert ids == words.encoder.encode(text, add_special_tokens=False).ids


def test_stretches_are_looked_up_once_an_array_and_pieces_asked_for_once():
    """Texts of an array cost one lookup a distinct stretch; words that differ in case or in marks at their end share a piece."""
    class Counted(WordIds):
        lookups = 0

        def __getitem__(self, word):
            type(self).lookups += 1
            return super().__getitem__(word)
    words = Counted("word_bpe_49k.json")
    texts = ["Ünder, under ünder! don't 12,5 " * 50, "", "  ", "under\tÜnder\nx\x0b\x85y Z <|endoftext|> 'll", "żółw ŻÓŁW; İx 中文 á"]
    ids, sizes = words.texts(pa.array(texts))
    assert Counted.lookups <= 20
    assert sum(p == "ünder" for p in words.pieces) == 1 and "Ünder" not in words.pieces
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == words.encoder.encode(text, add_special_tokens=False).ids


def test_documents_of_a_file_come_back_in_stretches(tmp_path):
    """Whatever a stretch holds, the documents are those read one by one, empty ones too."""
    rng = np.random.default_rng(3)
    lengths = [0, 5, 0, 40, 1, 300, 0, 2, 0]
    ids = rng.integers(0, 1 << 20, sum(lengths)).astype("<u4")
    file = TokenFile(write_file(str(tmp_path), list(range(len(lengths))), lengths, ids))
    for n in (1, 41, 10_000):
        got = [d.tolist() for d in file.documents(n)]
        assert got == [file.tokens(i).tolist() for i in range(len(lengths))] and [len(d) for d in got] == lengths


def test_pieces_that_begin_alike_share_the_work_on_their_prefix(monkeypatch):
    """A longer piece is worked out from where a known one ends; counts are those of the library for every prefix."""
    vocabulary, calls, fits = Vocabulary(VOCABULARY), [], Vocabulary.fits
    monkeypatch.setattr(Vocabulary, "fits", lambda self, *pair: calls.append(pair) or fits(self, *pair))
    vocabulary.piece_counts(b" internationalisation")
    del calls[:]
    vocabulary.piece_counts(b" internationalisations")
    assert len(calls) <= 10
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rng = np.random.default_rng(8)
    for _ in range(300):
        piece = "".join(rng.choice(list("aeinrstlouchéèXQzß"), int(rng.integers(1, 45))))
        counts = vocabulary.piece_counts((" " + piece).encode())
        ends = np.cumsum([1] + [len(c.encode()) for c in piece])
        for k in (1, len(piece) // 2, len(piece)):
            assert counts[ends[k]] == len(library.encode(" " + piece[:k], add_special_tokens=False).ids)
