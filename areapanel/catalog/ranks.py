"""Growth, percentile ranks, top-k flags and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.aggregates import rounded
from areapanel.catalog.base import query
from areapanel.catalog.filters import PCT
from areapanel.operators import metrics as M
from areapanel.operators import ordering as O
from areapanel.operators.selection import flag_first
from areapanel.operators import panel as P


@query("growth_rate", """
SELECT tract, year, round((filings_total - before)::double / before, 9) AS perc_increase_filings_total
FROM (SELECT *, lag(filings_total) OVER (PARTITION BY tract ORDER BY year) AS before FROM panel_c)""", views="panel_c")
def growth_rate(spark, folder):
    grown = P.growth(B.panel_sparse(spark, folder), ["filings_total"])
    return rounded(grown.select("tract", "year", "perc_increase_filings_total"), ["perc_increase_filings_total"], 9)


@query("pct_rank", f"""
SELECT tract, year, filings_rate, CASE WHEN filings_rate IS NOT NULL THEN round({PCT.format(g='year', v='filings_rate')}, 9) END AS pct_rank
FROM panel_h""", views="panel_s panel_h")
def pct_rank(spark, folder):
    ranked = O.with_percentile_rank(B.panel_table(spark, folder, holes=True), "filings_rate", ["year"])
    return rounded(ranked.select("tract", "year", "filings_rate", "pct_rank"), ["pct_rank"], 9)


@query("flag_top_k", """
SELECT model, split_date, doc_id, cast(row_number() OVER (PARTITION BY model, split_date ORDER BY score DESC, doc_id) - 1
  < floor(count(*) OVER (PARTITION BY model, split_date) * (10 / 100.0::double)) AS int) AS flag FROM scored_runs""",
       views="scored scored_runs")
def flag_top_k(spark, folder):
    flagged = flag_first(B.score_table(spark, folder), ["model", "split_date"], M.score_rank("score", ["doc_id"]), 10)
    return flagged.select("model", "split_date", "doc_id", "flag")


RANKED = f"(SELECT *, {PCT.format(g='year', v='filings_rate')} AS p FROM panel_h)"


@query("times_in_top_decile", f"""
SELECT tract, sum(CASE WHEN filings_rate IS NOT NULL AND p >= 0.9::double THEN 1 ELSE 0 END)::bigint AS times
FROM {RANKED} GROUP BY tract HAVING times > 1""", views="panel_s panel_h")
def times_in_top_decile(spark, folder):
    return O.times_in_top(B.panel_table(spark, folder, holes=True), "filings_rate", "year", "tract", more_than=1)


@query("top_decile", f"""
SELECT tract, year, filings_rate FROM {RANKED.replace('FROM panel_h', 'FROM panel_h WHERE filings_rate IS NOT NULL')}
WHERE p > 0.9::double""", views="panel_s panel_h")
def top_decile(spark, folder):
    return O.top_share(B.panel_table(spark, folder, holes=True), "filings_rate", ["year"]).select("tract", "year", "filings_rate")


@query("pr_curve", """
SELECT model, split_date, score AS threshold, round(tp / m::double, 9) AS precision, round(tp / total_pos::double, 9) AS recall,
  round(m / total::double, 9) AS pct_population
FROM (SELECT model, split_date, score, sum(pos) OVER w AS tp, sum(n) OVER w AS m, pos,
        sum(pos) OVER (PARTITION BY model, split_date) AS total_pos, sum(n) OVER (PARTITION BY model, split_date) AS total
      FROM (SELECT model, split_date, score, count(*) AS n, sum(label) AS pos FROM scored_runs GROUP BY ALL)
      WINDOW w AS (PARTITION BY model, split_date ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
WHERE tp - pos < total_pos""", views="scored scored_runs")
def pr_curve(spark, folder):
    curve = M.pr_curve(B.score_table(spark, folder), "score", "label", ["model", "split_date"])
    return rounded(curve, ["precision", "recall", "pct_population"], 9)


HISTOGRAM = """hist AS (SELECT model, split_date, bin, lo + bin * ((hi - lo) / 64) AS low, count(*) AS n, sum(label)::bigint AS pos
  FROM (SELECT s.*, lo, hi, CASE WHEN score >= hi THEN 63 WHEN score <= lo THEN 0
          ELSE greatest(0, least(63, floor((score - lo) / ((hi - lo) / 64))))::int END AS bin
        FROM scored_runs s JOIN (SELECT model, split_date, min(score) AS lo, max(score) AS hi FROM scored_runs GROUP BY ALL) USING (model, split_date))
  GROUP BY model, split_date, bin, lo, hi),
from_top AS (SELECT *, sum(n) OVER w AS m, sum(pos) OVER w AS tp, sum(n) OVER (PARTITION BY model, split_date) AS n_all,
    sum(pos) OVER (PARTITION BY model, split_date) AS pos_all
  FROM hist WINDOW w AS (PARTITION BY model, split_date ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))"""


@query("bounded_curve", f""", {HISTOGRAM}
SELECT model, split_date, round(low, 6) AS threshold, round(tp / m::double, 9) AS precision, round(tp / pos_all::double, 9) AS recall,
  round(m / n_all::double, 9) AS pct_population FROM from_top WHERE tp - pos < pos_all""", views="scored scored_runs")
def bounded_curve(spark, folder):
    runs = ["model", "split_date"]
    histogram = M.score_histogram(B.score_table(spark, folder), "score", "label", runs, bins=64)
    curve = M.bounded_curve(histogram, runs).withColumn("threshold", F.round("threshold", 6))
    return rounded(curve, ["precision", "recall", "pct_population"], 9)


@query("auc_bounds", f""", {HISTOGRAM}
SELECT model, split_date, round(sum((n - pos) * (tp - pos)) / (any_value(pos_all) * (any_value(n_all) - any_value(pos_all)))::double, 9) AS auc_low,
  round(sum((n - pos) * tp) / (any_value(pos_all) * (any_value(n_all) - any_value(pos_all)))::double, 9) AS auc_high
FROM from_top GROUP BY model, split_date""", views="scored scored_runs")
def auc_bounds(spark, folder):
    runs = ["model", "split_date"]
    histogram = M.score_histogram(B.score_table(spark, folder), "score", "label", runs, bins=64)
    return rounded(M.auc_bounds(histogram, runs), ["auc_low", "auc_high"], 9)
