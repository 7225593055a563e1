"""The registered queries over a whole test folder, each against SQL or a plain recomputation from its contract."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from areapanel.llm.queries import QUERIES, SQL  # noqa: E402
from check_queries import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, FOLDER).collect()]


def bucket(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    problems, rows = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name])
    assert not problems and rows


def test_op1_keeps_its_laws(spark, docs):
    rows = run(spark, "op1_label_propagation_shards")
    texts = {d: t for d, t, _ in docs}
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in docs)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        assert r["law"] == "bytes" and 0 <= r["shard"] < 16 and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # shards end between documents, so they differ by no more than the largest one on either side
    largest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.get(s, 0) for s in range(16)) <= 2 * largest


def test_op2_learns_from_the_other_rows_only(spark, docs):
    lang = {d: v for d, _, v in docs}
    texts = {d: t for d, t, _ in docs}
    rows = run(spark, "op2_crf_language_id")
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in docs)
    known = {v for d, v in lang.items() if bucket(d, 5) and v is not None}
    right = []
    for r in rows:
        assert r["held_out"] == (bucket(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert r["lang_pred"] in (known if letters else {"und"})
        if r["held_out"] and letters and lang[r["doc_id"]] is not None:
            right.append(r["lang_pred"] == lang[r["doc_id"]])
    assert len(right) > 20 and np.mean(right) >= 0.95


def test_op3_reads_back_the_ids_of_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got, start = {r["doc_id"]: r for r in run(spark, "op3_addressable_token_files")}, 0
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_op5_counts_as_the_library_does(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r["doc_id"]: r for r in run(spark, "op5_prefix_token_counts")}
    assert len(got) == len(docs)
    for doc_id, text, _ in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = got[doc_id]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 1024)


def test_op6_base_columns_follow_the_contract(spark, docs):
    def tokens(text):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]
    counts = Counter(t for d, text, _ in docs if bucket(d, 7) != 2 for t in tokens(text))
    total, types = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in run(spark, "op6_elias_fano_lm")}
    assert len(rows) == len(docs)
    for d, text, _ in docs:
        own, r = tokens(text), rows[d]
        assert r["held_out"] == (bucket(d, 7) == 2) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own), rel=1e-9)
        assert r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op9_reads_back_turns_and_loss(spark):
    said = "\\### Assistant: </turn> ok"
    rows = duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{FOLDER}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    turns = defaultdict(list, {-7: [("user", said), ("assistant", said)]})
    for conv, role, text in rows:
        turns[conv].append((role, text))
    got = {r["conv_id"]: r for r in run(spark, "op9_chat_windows")}
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        loss, r = "".join(t for role, t in own if role == "assistant"), got[conv]
        every = "".join(f"{role}\n{text}\n" for role, text in own)
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(every.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, t in own)


def test_op1_lowers_the_share_of_linked_pairs_apart(spark):
    from areapanel.llm.sharding import shard_documents
    # thirty families of ten documents that share long lines, beside as many lone documents
    rng = np.random.default_rng(5)
    rows = [(f * 10 + i, "\n".join([f"a line of family {f} that all of its members hold word by word", f"own {rng.integers(1 << 40)} text {i}"])) for f in range(30) for i in range(10)]
    rows += [(1000 + i, f"lone text number {i} without any line that another one holds, {'x ' * int(rng.integers(20))}") for i in range(300)]
    out = {r.doc_id: r for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()}
    pairs = [(out[f * 10 + i].shard, out[f * 10 + j].shard) for f in range(30) for i in range(10) for j in range(i)]
    assert np.mean([a != b for a, b in pairs]) < 0.25  # three in four by chance
    size = Counter()
    for r in out.values():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in out.values())
