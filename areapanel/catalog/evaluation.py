"""Metrics at k, curves, bias, baselines and the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.aggregates import rounded
from areapanel.catalog.base import query, table
from areapanel.operators import features as FE
from areapanel.operators import metrics as M
from areapanel.operators.selection import flag_first
from areapanel.plans import scoring

RUNS = ["model", "split_date"]
KS = "(VALUES " + ", ".join(f"({k})" for k in M.REPORT_K) + ") ks(k)"
AT_K = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY model, split_date ORDER BY score DESC, doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY model, split_date) AS n FROM scored_runs),
at_k AS (SELECT model, split_date, k, count(*) FILTER (WHERE pos < floor(n * (k / 100.0::double))) AS m,
    coalesce(sum(label) FILTER (WHERE pos < floor(n * (k / 100.0::double))), 0) AS tp, sum(label) AS pos_all
  FROM placed, {KS} GROUP BY model, split_date, k),
prf AS (SELECT model, split_date, k, CASE WHEN m > 0 THEN tp / m::double ELSE 0 END AS p,
    CASE WHEN pos_all > 0 THEN tp / pos_all::double ELSE 0 END AS r FROM at_k),
full_prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM prf)"""


def _metrics(spark, folder):
    return M.at_k(B.score_table(spark, folder), "score", "label", ["doc_id"], RUNS)


def _one(column: str, short: str) -> str:
    return f", {AT_K} SELECT model, split_date, k, round({short}, 9) AS {column} FROM full_prf"


@query("precision_at_k", _one("precision", "p"), views="scored scored_runs")
def precision_at_k(spark, folder):
    return rounded(_metrics(spark, folder).select(*RUNS, "k", "precision"), ["precision"], 9)


@query("recall_at_k", _one("recall", "r"), views="scored scored_runs")
def recall_at_k(spark, folder):
    return rounded(_metrics(spark, folder).select(*RUNS, "k", "recall"), ["recall"], 9)


@query("f1_at_k", _one("f1", "f"), views="scored scored_runs")
def f1_at_k(spark, folder):
    return rounded(_metrics(spark, folder).select(*RUNS, "k", "f1"), ["f1"], 9)


@query("random_baseline", "SELECT model, split_date, round(avg(label), 9) AS random_baseline FROM scored_runs GROUP BY ALL",
       views="scored scored_runs")
def random_baseline(spark, folder):
    return rounded(M.random_baseline(B.scored_runs(spark, folder), "label", RUNS), ["random_baseline"], 9)


AUC = """auc AS (SELECT model, split_date, (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::double)
    / (sum(label) * (count(*) - sum(label))) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY model, split_date ORDER BY score)
      + (count(*) OVER (PARTITION BY model, split_date, score) - 1) / 2.0::double AS rk FROM scored_runs)
  GROUP BY model, split_date)"""


@query("roc_auc", f", {AUC} SELECT model, split_date, round(auc, 9) AS auc_roc FROM auc", views="scored scored_runs")
def roc_auc(spark, folder):
    return rounded(M.roc_auc(B.score_table(spark, folder), "score", "label", RUNS), ["auc_roc"], 9)


_GRID = ", ".join(f"round(max({s}) FILTER (WHERE k = {k}), 9) AS {n}_at_{k}"
                  for k in M.REPORT_K for n, s in (("p", "p"), ("recall", "r"), ("f1", "f")))


@query("metrics_grid", f""", {AT_K}, {AUC}
SELECT model, split_date, random_baseline, {_GRID}, round(max(auc), 9) AS auc_roc FROM full_prf JOIN auc USING (model, split_date)
JOIN (SELECT model, split_date, round(avg(label), 9) AS random_baseline FROM scored_runs GROUP BY ALL) USING (model, split_date)
GROUP BY model, split_date, random_baseline""", views="scored scored_runs")
def metrics_grid(spark, folder):
    grid = M.metrics_grid(B.score_table(spark, folder), "score", "label", ["doc_id"], RUNS)
    return rounded(grid, [c for c in grid.columns if c not in RUNS], 9)


@query("bias_crosstab", """
, f AS (SELECT *, cast(row_number() OVER (ORDER BY score DESC, doc_id) - 1 < floor(count(*) OVER () * (10 / 100.0::double)) AS int) AS flag FROM scored),
c AS (SELECT a AS attribute_name, v AS attribute_value, count(*) AS group_size, count(*) FILTER (WHERE flag = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE flag = 1 AND label = 0) AS fp, count(*) FILTER (WHERE flag = 0 AND label = 1) AS fn,
    count(*) FILTER (WHERE flag = 0 AND label = 0) AS tn
  FROM (SELECT 'lang' AS a, lang AS v, flag, label FROM f UNION ALL SELECT 'source', source, flag, label FROM f) GROUP BY a, v)
SELECT *, round(fn / nullif(fn + tp, 0)::double, 9) AS fnr, round(fn / nullif(fn + tn, 0)::double, 9) AS "for",
  round(fp / nullif(fp + tp, 0)::double, 9) AS fdr, round(tp / nullif(tp + fn, 0)::double, 9) AS tpr,
  round(tn / nullif(tn + fp, 0)::double, 9) AS tnr FROM c WHERE group_size >= 5""", views="scored")
def bias_crosstab(spark, folder):
    flagged = flag_first(B.scored(spark, folder), [], M.score_rank("score", ["doc_id"]), 10)
    table_ = M.bias_crosstab(flagged, "flag", "label", ["lang", "source"], min_group_size=5)
    return rounded(table_, ["fnr", "for", "fdr", "tpr", "tnr"], 9)


@query("persistence_baseline", """
SELECT year, round(sum(label * label_prev_year) / nullif(floor((SELECT count(*) FROM supplier) * 0.1::double), 0)::double, 9) AS correct_with_baseline
FROM labelled GROUP BY year""", views="panel_s cuts labelled")
def persistence_baseline(spark, folder):
    labelled = FE.create_label(B.panel_table(spark, folder), "filings_rate")
    areas = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    return rounded(M.persistence_baseline(labelled, areas), ["correct_with_baseline"], 9)


@query("leaderboard", f""", {AT_K},
results AS (SELECT model AS model_type, split_date, p AS p_at_10 FROM full_prf WHERE k = 10),
chance AS (SELECT model, split_date, avg(label) AS b FROM scored_runs GROUP BY ALL)
SELECT split_date, round(max(p_at_10), 9) AS p_at_10, model_type FROM results GROUP BY split_date, model_type UNION ALL
SELECT split_date, round(p_at_10, 9), 'Baseline' FROM (SELECT (year + 16)::varchar || '-01-01' AS split_date,
    sum(label * label_prev_year) / nullif(floor((SELECT count(*) FROM supplier) * 0.1::double), 0)::double AS p_at_10
  FROM labelled GROUP BY year) WHERE split_date IN ('2013-01-01', '2014-01-01', '2015-01-01', '2016-01-01') UNION ALL
SELECT split_date, round(avg(b), 9), 'Random Baseline' FROM chance GROUP BY split_date""",
       views="scored scored_runs panel_s cuts labelled")
def leaderboard(spark, folder):
    grid = M.metrics_grid(B.score_table(spark, folder), "score", "label", ["doc_id"], RUNS, ks=(10,)) \
        .withColumnRenamed("model", "model_type")
    labelled = FE.create_label(B.panel_table(spark, folder), "filings_rate")
    areas = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    persistence = M.persistence_baseline(labelled, areas).select(
        F.concat((F.col("year") + 16).cast("string"), F.lit("-01-01")).alias("split_date"),
        F.col("correct_with_baseline").alias("p_at_10"))
    board = M.leaderboard(grid, persistence, "p_at_10", [f"{y}-01-01" for y in (2013, 2014, 2015, 2016)])
    return rounded(board, ["p_at_10"], 9)


@query("best_models", f""", {AT_K}, {AUC},
long AS (SELECT model, split_date, 'f1_at_10' AS metric, round(f, 9) AS value FROM full_prf WHERE k = 10 UNION ALL
  SELECT model, split_date, 'auc_roc', round(auc, 9) FROM auc)
SELECT metric, value, model, split_date FROM long JOIN (SELECT metric, max(value) AS value FROM long GROUP BY metric) USING (metric, value)""",
       views="scored scored_runs")
def best_models(spark, folder):
    grid = M.metrics_grid(B.score_table(spark, folder), "score", "label", ["doc_id"], RUNS, ks=(10,))
    return M.best_points(rounded(grid, ["f1_at_10", "auc_roc"], 9), ["f1_at_10", "auc_roc"], RUNS)


@query("grid_bias", """
, f AS (SELECT r.model, r.split_date, s.lang, s.source, r.label, cast(row_number() OVER (PARTITION BY r.model, r.split_date ORDER BY r.score DESC, r.doc_id) - 1
    < floor(count(*) OVER (PARTITION BY r.model, r.split_date) * (10 / 100.0::double)) AS int) AS flag
  FROM scored_runs r JOIN documents s USING (doc_id)),
c AS (SELECT model, split_date, a AS attribute_name, v AS attribute_value, count(*) AS group_size, count(*) FILTER (WHERE flag = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE flag = 1 AND label = 0) AS fp, count(*) FILTER (WHERE flag = 0 AND label = 1) AS fn,
    count(*) FILTER (WHERE flag = 0 AND label = 0) AS tn
  FROM (SELECT *, 'lang' AS a, lang AS v FROM f UNION ALL SELECT *, 'source', source FROM f) WHERE v IS NOT NULL GROUP BY ALL)
SELECT *, round(fn / nullif(fn + tp, 0)::double, 9) AS fnr, round(fn / nullif(fn + tn, 0)::double, 9) AS "for",
  round(fp / nullif(fp + tp, 0)::double, 9) AS fdr, round(tp / nullif(tp + fn, 0)::double, 9) AS tpr,
  round(tn / nullif(tn + fp, 0)::double, 9) AS tnr FROM c""", views="scored scored_runs")
def grid_bias(spark, folder):
    found = scoring.grid_bias(B.score_table(spark, folder), table(spark, folder, "documents"), ["lang", "source"], ["doc_id"], runs=RUNS)
    return rounded(found, ["fnr", "for", "fdr", "tpr", "tnr"], 9)
