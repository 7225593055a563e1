"""Model jobs. Only the neighbour scores have an exact SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.catalog.joins import crime_home
from areapanel.operators import features as FE
from areapanel.operators import models as ML
from areapanel.operators import hashed_neighbours as H
from areapanel.operators import panel as P
from areapanel.operators.neighbours import knn_score as neighbour_score
from areapanel.plans import scoring
from areapanel.session import stage

KEYS = ["tract", "year"]
TO_BIN = ["filings_rate", "filings_total", "total_crime"]
TEST_YEAR = 2000
GROUPS = scoring.group_columns(TO_BIN)


def labelled_panel(spark, folder):
    """Dense panel with crime counts and the label of the next year; the last year has none."""
    crime = crime_home(spark, folder).select("tract", "year", "total_crime")
    panel = stage(P.disjoint(B.panel_dense(spark, folder).drop("commarea"), crime, KEYS), "panel")
    return FE.create_label(panel, "filings_rate", drop_unlabelled=True).drop("next_year", "filings_rate_next_year")


def feature_sets(spark, folder):
    panel = stage(labelled_panel(spark, folder), "labelled")
    train, test = panel.where(F.col("year") != TEST_YEAR), panel.where(F.col("year") == TEST_YEAR)
    return tuple(FE.process_features(part, TO_BIN, impute=TO_BIN) for part in (train, test))


def _train(name: str, params: dict):
    def run(spark, folder):
        train, test = feature_sets(spark, folder)
        return ML.run_model(train, test, name, params, GROUPS, KEYS).select(*KEYS, "label", "score")
    return run


query("train_logistic")(_train("LR", {"C": 10, "penalty": "l2"}))
query("train_forest")(_train("RF", {"n_estimators": 20, "max_depth": 5, "max_features": "log2", "min_samples_split": 10}))
query("train_tree")(_train("DT", {"criterion": "entropy", "max_depth": 5}))
query("train_gbt")(_train("GB", {"n_estimators": 5, "learning_rate": 0.1, "subsample": 0.5, "max_depth": 3}))
query("train_svm")(_train("SVM", {"C": 0.1}))
query("train_bagged")(_train("B", {"n_estimators": 10}))


@query("knn_score", """
SELECT vec_id, round(avg(label), 9) AS score FROM (
  SELECT t.vec_id, r.label, row_number() OVER (PARTITION BY t.vec_id
      ORDER BY list_distance(t.embedding::double[], r.embedding::double[]), r.vec_id) AS pos
  FROM (SELECT * FROM embeddings WHERE vec_id % 5 = 0) t, (SELECT * FROM embeddings WHERE vec_id % 5 <> 0) r)
WHERE pos <= 5 GROUP BY vec_id""")
def knn_score(spark, folder):
    vectors = table(spark, folder, "embeddings")
    is_test = F.col("vec_id") % 5 == 0
    scores = neighbour_score(vectors.where(~is_test), vectors.where(is_test), ["vec_id"], "embedding", "label", k=5)
    return scores.withColumn("score", F.round("score", 9))


HASHED = {"tables": 6, "radius": 0, "bucket_rows": 64}


@query("knn_score_hashed", f"""
WITH v AS (SELECT vec_id, label, embedding::double[] AS e, vec_id % 5 = 0 AS asked FROM embeddings),
part AS (SELECT vec_id, asked, e, unnest(range(len(e))) AS d, unnest(list_transform(e, lambda c: floor(c * {H.SCALE}))) AS q FROM v),
middle AS (SELECT d, floor(sum(q) / count(*)) AS o FROM (SELECT DISTINCT e, d, q FROM part WHERE NOT asked) GROUP BY d),
bits AS (SELECT b FROM range(40) r(b), (SELECT greatest(1, ceil(log2(greatest(2.0, count(DISTINCT e)::DOUBLE / {HASHED["bucket_rows"]})))) AS n FROM v WHERE NOT asked) WHERE b < n),
plane AS (SELECT t, b, d, CASE WHEN substr(md5('{H.SEED}:' || t || ':' || b || ':' || d), 1, 1) >= '8' THEN 1 ELSE -1 END AS s
  FROM range({HASHED["tables"]}) r(t), bits, (SELECT DISTINCT d FROM part)),
side AS (SELECT vec_id, asked, t, b, sum((q - o) * s) >= 0 AS up FROM part JOIN middle USING (d) JOIN plane USING (d) GROUP BY ALL),
code AS (SELECT vec_id, asked, t, string_agg(up::INT::VARCHAR, '' ORDER BY b) AS code FROM side GROUP BY ALL),
met AS (SELECT DISTINCT a.vec_id AS row_id, k.vec_id AS known_id FROM code a JOIN code k USING (t, code) WHERE a.asked AND NOT k.asked),
short AS (SELECT vec_id FROM v LEFT JOIN met ON row_id = vec_id WHERE asked GROUP BY vec_id HAVING count(known_id) < 5),
every AS (SELECT * FROM met UNION SELECT s.vec_id, k.vec_id FROM short s, v k WHERE NOT k.asked)
SELECT row_id AS vec_id, round(avg(label), 9) AS score FROM (
  SELECT row_id, k.label, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(a.e, k.e), known_id) AS pos
  FROM every JOIN v a ON a.vec_id = row_id JOIN v k ON k.vec_id = known_id) WHERE pos <= 5 GROUP BY row_id""")
def knn_score_hashed(spark, folder):
    """Few small buckets, so that rows do miss neighbours and the SQL has to miss the same ones."""
    vectors = table(spark, folder, "embeddings")
    is_test = F.col("vec_id") % 5 == 0
    scores = H.hashed_knn_score(vectors.where(~is_test), vectors.where(is_test), ["vec_id"], "embedding", "label", k=5, **HASHED)
    return scores.withColumn("score", F.round("score", 9))


@query("grid_metrics")
def grid_metrics(spark, folder):
    panel = stage(labelled_panel(spark, folder), "labelled").withColumn("day", F.make_date("year", F.lit(1), F.lit(1)))
    splits = FE.temporal_splits(panel, "day", "1995-01-01", "2000-01-01")
    featured = scoring.split_features(splits, TO_BIN, impute=TO_BIN)
    _, grid = ML.model_grid("test")
    scores = scoring.grid_scores(featured, list(grid), grid, GROUPS, KEYS)
    return scoring.grid_results(scores, splits)


@query("feature_importance")
def feature_importance(spark, folder):
    train, _ = feature_sets(spark, folder)
    model = ML.fit_model(train, "LR", {"C": 10, "penalty": "l2"}, GROUPS)
    return ML.feature_importance("LR", model, train, GROUPS)


@query("top_features")
def top_features(spark, folder):
    train, _ = feature_sets(spark, folder)
    model = ML.fit_model(train, "RF", {"n_estimators": 20, "max_depth": 5, "max_features": "sqrt"}, GROUPS)
    return ML.feature_importance("RF", model, train, GROUPS, top=5)


@query("production_score")
def production_score(spark, folder):
    return scoring.production_score(labelled_panel(spark, folder).drop("label_prev_year"), TEST_YEAR)
