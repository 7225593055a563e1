"""The operators on small tables with nulls, empty and repeated rows, ties and clashing column names, against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from areapanel.llm import chat, decontamination, jaccard, language_id, language_model, mixing, prefix_counts, sharding, token_files, top_k
from areapanel.llm.tables import connected_components, scratch_path

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "x30")
FAR = BASE.replace("w10", "x10").replace("w30", "x30").replace("w50", "x50")
ROWS = [(1, BASE), (2, BASE.upper()), (3, NEAR), (4, FAR), (5, None), (6, ""), (7, "a b"), (8, "A  b"), (9, "a b c"), (None, "a b"),
        (11, " ".join(f"z{i}" for i in range(20_000))), (12, "solo words that nobody else has in this order"), (12, "other text of the same id here")]
SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]))
    return out


def brute_components(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def got_components(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)


def test_components_equal_brute_force(spark):
    assert got_components(frame(spark, ROWS)) == brute_components(ROWS)


def test_hub_and_chain_of_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"h{i}" for i in range(80)]
    rows = [(0, " ".join(words))]
    for d in range(1, 60):
        own = list(words)
        for at in rng.choice(80, rng.integers(0, 6), replace=False):
            own[at] = f"u{d}_{at}"
        rows.append((d, " ".join(own)))
    assert got_components(frame(spark, rows)) == brute_components(rows)


def test_keep_one_keeps_columns_and_lone_rows(spark):
    rows = [(d, t, "de", 3) for d, t in ROWS]
    df = frame(spark, rows + rows[:2], "doc_id long, text string, node string, n int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 11, 12, 12], key=repr)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.jaccard_components(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert language_model.score(none.selectExpr("doc_id", "text", "true as held_out"), language_model.train(none)).count() == 0
    assert token_files.read_digests(token_files.write_tokens(none, scratch_path(spark, "t"))).count() == 0
    assert decontamination.contamination(none, frame(spark, [], "item_id long, text string")).count() == 0
    docs = frame(spark, [], "doc_id long, text string, lang string, source string")
    assert language_id.learn_and_predict(docs).count() == 0
    assert mixing.keep_mix(docs).count() == 0
    assert chat.read_back(chat.format_windows(frame(spark, [], "conv_id long, turn long, role string, text string"))).count() == 0


def test_components_of_a_long_path(spark):
    edges = frame(spark, [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.comp for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_language_model_equals_brute_force(spark):
    train = [(i, t) for i, t in enumerate(["a b a c", "B a", None, "a b a b é", "d\t\x0be"])]
    asked = [*train, (9, "a b zz"), (None, ""), (9, "a b zz")]
    got = language_model.score(frame(spark, asked).selectExpr("doc_id", "text", "false as held_out"), language_model.train(frame(spark, train)))
    uni, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    sequences = [[*(t or "").encode().lower().split(), None] for _, t in train]
    for s in sequences:
        uni.update(s)
        for a, b in zip([0, *s[:-1]], s):
            pairs[a, b] += 1
            context[a] += 1
    kinds = collections.Counter(a for a, _ in pairs)
    n, v, d = sum(uni.values()), len(uni), language_model.DISCOUNT
    for r, (_, text) in zip(got.collect(), asked):
        s = [*(text or "").encode().lower().split(), None]
        share = [(uni[x] + 1) / (n + v + 1) for x in s]
        p = [(max(pairs[a, b] - d, 0) + d * kinds[a] * q) / context[a] if context[a] else q for a, b, q in zip([0, *s[:-1]], s, share)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(uni[x] > 0 for x in s), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, share)))
        assert r.score == pytest.approx(sum(map(math.log10, p)), rel=0.02)


def test_token_files_in_order_and_back(spark):
    words = token_files.WordIds(token_files.VOCABULARY)
    got = token_files.read_digests(token_files.write_tokens(frame(spark, ROWS), scratch_path(spark, "tokens"), file_tokens=500)).collect()
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    expected = {}
    for d, t in ROWS:
        ids = np.frombuffer(words.text(t or ""), "<u4").tobytes() + (1).to_bytes(4, "little")
        expected.setdefault(d, []).append((len(ids) // 4, zlib.crc32(ids)))
    start, ids = 0, []
    for begin, d, n, crc in rows:
        assert begin == start and (n, crc) in expected[d]
        start += n
        ids.append(d)
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d) and len(ids) == len(ROWS)


@pytest.mark.parametrize("text", [
    "Hello world's we'll  x", "a\n\n  b \t c", "'ll'll ''s 'r", "été 日本語 🙂🙂 a", "<|endoftext|>x <|endoftext|><|endof", "  \n  word  ",
    "I'd they'ver  $$$***", "　　x\xa0y\x85z", "=" * 100, ""])
def test_prefix_counts_equal_the_library(text):
    from tokenizers import Tokenizer
    import public_tokenizers
    library = Tokenizer.from_file(public_tokenizers.path(prefix_counts.VOCABULARY))
    expected = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert prefix_counts.prefix_counter(prefix_counts.VOCABULARY).counts(text).tolist() == expected


def test_truncation_from_stored_counts(spark):
    stored = prefix_counts.prefix_counts(frame(spark, ROWS))
    for r in prefix_counts.tokens_at(stored, budget=7).collect():
        assert r.n_tokens <= 7 or r.kept_chars < 10_000 and r.n_bytes > r.kept_chars


def brute_hits(docs, items, size=10):
    import re
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows[tuple(w[a:a + n])].add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for x, owners in windows.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a:a + len(x)]) == x:
                    found |= owners
                    hit |= set(range(a, a + len(x)))
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_windows", [3, 200_000])
def test_contamination_equals_brute_force(spark, monkeypatch, slice_windows):
    items = [(1, BASE[:80]), (2, "a b"), (3, None), (10, "A-B"), (4, "!?"), (5, " ".join(["rep"] * 12))]
    docs = [*ROWS, (20, "x " + BASE[:80] + " y"), (21, "rep " * 15), (22, "rep"), (23, "ab")]
    found = decontamination.matches(decontamination.build_index(frame(spark, docs)),
                                    decontamination.test_windows(frame(spark, items, "item_id long, text string")), None, slice_windows)
    monkeypatch.setattr(decontamination, "phrase_matches", lambda *_: found)
    got = decontamination.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()), key=repr) == brute_hits(docs, items)


@pytest.mark.parametrize("slice_windows", [200_000, 1])
def test_null_item_ids_are_one_item(spark, slice_windows):
    """A document with hits of items without an id and of named ones, by windows of the same length."""
    items = [(None, "red fox"), (None, "blue owl"), (7, "red fox"), (8, "old cat"), (None, None)]
    docs = frame(spark, [(1, "a red fox an old cat a blue owl"), (2, "blue owl"), (3, "old cat"), (4, "red")])
    index, windows = decontamination.build_index(docs), decontamination.test_windows(frame(spark, items, "item_id long, text string"))
    for found in (decontamination.matches(index, windows, span, slice_windows) for span in (None, 1)):
        got = {r.doc_id: collections.Counter(x.item_id for x in r.runs) for r in found.collect()}
        assert got == {1: {None: 2, "7": 1, "8": 1}, 2: {None: 1}, 3: {"8": 1}, 4: {}}
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(docs, frame(spark, items, "item_id long, text string")).collect()}
    assert got == {1: (6, ["7", "8", None]), 2: (2, [None]), 3: (2, ["8"]), 4: (0, [])}


def test_proximity(spark):
    index = decontamination.build_index(frame(spark, [(1, "red x x fox"), (2, "fox x red"), (3, "red " + "x " * 30 + "fox"), (4, "red")]))
    windows = decontamination.test_windows(frame(spark, [(1, "red fox")], "item_id long, text string"))
    near = decontamination.proximity_matches(index, windows, span=5).where("size(runs) > 0")
    assert sorted(r.doc_id for r in near.collect()) == [1, 2]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 16)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 200)]
    rows += [(300 + i, rows[50][1]) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (450, [float("inf")]), (500, [])]
    vectors = top_k.whole_vectors(frame(spark, rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    usable = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i not in (400, 401, 402, 450)}
    expected = []
    for q in (i for i in usable if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:5]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got == sorted(expected)


def ranking(found):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_top_k_is_exact_for_large_components_and_raises_beyond_a_long(spark):
    def search(rows, kind="array<double>"):
        vectors = top_k.whole_vectors(frame(spark, rows, f"vec_id long, embedding {kind}"))
        return ranking(top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")))

    # terms of opposite signs: each product passes 62 bits, their sum does not
    big = 2.0 ** 25
    rows = [(50, [big, big]), *[(i, [big, -big + i]) for i in range(1, 9)], (9, [1.0, 1.0])]
    exact = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(exact[50], exact[i])), i) for i in exact if i != 50)[:5]
    assert search(rows) == [(50, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    for wrong in ([(50, [1e17, 1.0]), (1, [2.0, 1.0])], [(50, [1e15, 1.0]), (1, [1e15, 2.0])]):
        with pytest.raises(Exception, match="passes 64 bits|Overflow|too large|too big"):
            search(wrong)


def test_top_k_of_no_vectors_no_queries_and_repeated_rows(spark):
    none = top_k.whole_vectors(frame(spark, [], "vec_id long, embedding array<float>"))
    assert top_k.top_k(none, none).count() == 0
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [1.0, 0.0]), (3, None)]
    vectors = top_k.whole_vectors(frame(spark, rows, "vec_id long, embedding array<float>"))
    assert top_k.top_k(vectors, vectors.where("vec_id = 7")).count() == 0
    assert ranking(top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"))) == [(50, 1, 1, 65536), (50, 2, 1, 65536)]


def test_chat_windows_read_back(spark):
    turns = [(1, 0, "system", "be <kind> \\ now"), *[(1, t, "user" if t % 2 else "assistant", f"said </turn> {t} " + "w " * (40 * (t % 3))) for t in range(1, 12)],
             (2, 0, "assistant", None), (3, None, None, "no role"), (3, 1, "assistant", "long " * 2000), *chat.OWN_ROWS]
    windows = chat.format_windows(frame(spark, turns, "conv_id long, turn long, role string, text string"))
    rows = windows.collect()
    for r in rows:
        parsed = chat.parse(r.text)
        assert len(parsed) == r.n_turns and (r.n_tokens <= chat.BUDGET or r.n_turns - r.n_repeated == 1)
        if r.conv_id == 1:
            assert parsed[0][1] == "system"
            assert r.n_repeated <= chat.HISTORY_TURNS + 1
    assert sum(r.conv_id == 1 for r in rows) > 2
    by_conv = collections.defaultdict(list)
    for c, t, role, text in turns:
        by_conv[c].append((t or 0, role or "", text or ""))
    for r in chat.read_back(windows).collect():
        own = sorted(by_conv[r.conv_id])
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def language_rows():
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "ing", "th", "er"], "de": ["sch", "ung", "ein", "ö"]}
    word = lambda k: "".join(rng.choice(parts[k], 3))
    rows = [(i, " ".join(word(k) for _ in range(15)), k, "s") for i, k in enumerate(["en", "de"] * 60)]
    return rows + [(900, None, "en", None), (901, "123 !", "de", "s"), (902, "", None, "s"), (None, rows[0][1], None, None)]


def test_language_of_words_and_texts(spark):
    rows = language_rows()
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.learn_and_predict(df).collect()}
    held = [got[d].lang_pred == lang for d, _, lang, _ in rows[:120] if got[d].held_out]
    assert len(held) > 10 and all(held)
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert got[None].lang_pred == "en"
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 121


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "word " * int(rng.integers(5, 15)) + ("@" if i % 7 == 0 else ""), ["en", "de"][i % 3 == 0], ["big", "small"][i % 10 == 0])
            for i in range(6000)] + [(9999, None, None, None)]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string")
    wanted = {"source": frame(spark, [("big", 0.5), ("small", 0.5), ("(none)", 0.0)], "value string, share double")}
    drawn = mixing.mix(df, wanted, columns=("doc_id",)).collect()
    tokens = collections.Counter()
    for r in drawn:
        tokens[r.source] += r.tokens
    assert tokens["small"] / sum(tokens.values()) == pytest.approx(0.5, abs=0.06)
    kept = mixing.keep_mix(df)
    assert kept.columns == df.columns and kept.count() == kept.distinct().count()


def test_shards_are_even_and_keep_equal_texts(spark):
    rng = np.random.default_rng(6)
    texts = ["line number one of the shared kind, long enough\n" * int(k) + f"own words {i} " * int(rng.integers(3, 9)) for i, k in enumerate(rng.integers(0, 2, 400))]
    rows = [(i, texts[i % 400]) for i in range(600)] + [(1000 + i, "hot text " * 8) for i in range(300)] + [(2000, None), (2001, ""), (None, "x"), (5, texts[5])]
    got = sharding.shard_documents(frame(spark, rows), shards=4).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and sorted(slots) == [0, 1, 2, 3]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert sum(len(v) > 1 for v in homes.values()) <= 6


def test_word_scores_need_memory_by_part_and_not_by_block():
    """Features of all distinct words of a block at once took hundreds of MB in a worker; parts give the same scores to the last bit."""
    import tracemalloc
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c", "d"], np.zeros(0, np.uint64), np.zeros(0, np.int64), rng.normal(size=(1 << language_id.FEATURE_BITS, 4)),
                              rng.normal(size=(17, 4)), np.zeros((4, 4)), np.zeros(4))
    words = [bytes(w) for w in rng.integers(97, 123, (60_000, 9), dtype=np.uint8)] + [b"x" * 300_000, b"y"]
    hashes = np.arange(len(words), dtype=np.uint64)
    tracemalloc.start()
    scores = model.word_scores(words, hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    slots, begins = language_id.word_features(words)
    assert (scores == np.add.reduceat(model.grams[slots], begins) + model.lexical[-1]).all()
    assert peak < 130e6
