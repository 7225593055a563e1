"""The stages and the whole pipeline: clashing column names pass through, and what goes or stays equals a brute-force account."""

import numpy as np
import pytest

import corpus_pipeline
from areapanel.llm import decontamination, jaccard, language_id, mixing, sharding

HELPERS = {"_key": "long", "rate": "double", "label": "int", "_source": "string", "_u": "double", "node": "string", "text_key": "string", "doc": "string", "key": "int",
           "id": "int", "u": "double", "tokens": "int", "topic": "string", "total": "int", "weight": "double"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {v}" for k, v in HELPERS.items())
EXTRA = tuple({"long": 7, "int": 8, "double": 0.5, "string": "kept"}[v] for v in HELPERS.values())
WORDS = {"en": "the and of water house tree with from under over light dark river stone", "de": "der und von wasser haus baum mit aus unter licht dunkel fluss stein"}


def corpus():
    """Documents of two languages; copies, near copies, benchmark passages, letterless and null texts among them."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        words = [f"{w}{'' if rng.random() < 0.6 else rng.integers(0, 40)}" for w in rng.choice(WORDS[lang].split(), 60)]
        rows.append((i, " ".join(words), lang, ("web", "books")[i % 3 == 0], 1))
    near = rows[4][1].split()
    near[30] = "changed"
    rows += [(200, rows[4][1], "en", "web", 1), (201, " ".join(near), "en", "web", 1), (202, "123 !!", "en", "web", 1), (203, None, None, None, None), (204, "", "de", "web", 0)]
    passage = "what is the name of the old mill by the river crossing"
    rows += [(205, f"{rows[6][1]} {passage} {rows[8][1]}", "en", "web", 1)]
    return rows, [("b1", passage), (None, None), ("b2", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in corpus()[0]], SCHEMA).cache()


def test_every_stage_takes_helper_names_as_columns(spark, docs):
    bench = spark.createDataFrame(corpus()[1], "item_id string, text string")
    for kept in (language_id.keep_identified(docs), jaccard.keep_one(docs), decontamination.drop_contaminated(docs, bench), mixing.keep_mix(docs)):
        assert kept.dtypes == docs.dtypes
        assert kept.exceptAll(docs).count() == 0 and kept.count() > 20
    placed = sharding.shard_documents(docs, shards=3, rounds=1, keep=("label", "node", "rate", "_key"))
    assert {(r.label, r.node, r.rate, r._key) for r in placed.collect()} == {(8, "kept", 0.5, 7)}
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, keep=("size",))


def test_pipeline_drops_what_it_should(spark, docs, tmp_path):
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(corpus()[1], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, ids = docs, {None: {r.doc_id for r in docs.collect()}}
    for name, step in corpus_pipeline.STAGES:
        held = step(spark, held, str(tmp_path)).cache()
        ids[name] = {r.doc_id for r in held.collect()}
    assert ids["language"] == ids[None] - {202, 203, 204}
    assert ids["near_duplicates"] == ids["language"] - {200, 201}
    assert ids["decontaminate"] == ids["near_duplicates"] - {205}
    assert ids["mixture"] <= ids["decontaminate"] and len(ids["mixture"]) > 100
    assert ids["shards"] == ids["mixture"]
    sizes = {}
    for r in held.collect():
        sizes.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in sizes.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["shards"]


def test_rows_without_an_id_draw_by_their_text(spark):
    rows = [(None, f"text number {i}", "en", ("a", "b")[i % 9 == 0]) for i in range(400)]
    kept = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), columns=("text",)).count()
    assert 0 < kept < 400


def test_given_topics_and_token_counts_are_used(spark):
    from pyspark.sql import functions as F
    rows = [(i, "x", "en", "s", ("news", "code")[i % 4 == 0], 10 + i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, about string, counted int")
    share = {"topic": spark.createDataFrame([("news", 0.5), ("code", 0.5)], "value string, share double")}
    got = mixing.mix(df, share, topic=F.col("about"), tokens=F.col("counted")).groupBy("topic").agg(F.sum("tokens").alias("n")).collect()
    got = {r.topic: r.n for r in got}
    assert got["code"] / sum(got.values()) == pytest.approx(0.5, abs=0.06)
