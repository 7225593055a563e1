"""Filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog import base as B
from areapanel.catalog.base import query, table
from areapanel.operators import metrics as M
from areapanel.operators import ordering as O
from areapanel.operators.selection import flag_first
from areapanel.operators import panel as P
from areapanel.sources import landed as L


@query("date_interval_filter", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def date_interval_filter(spark, folder):
    day = F.col("o_orderdate")
    low, high = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1997, 1998))
    return table(spark, folder, "orders").where((day >= low) & (day < high)).select("o_orderkey")


@query("year_filter", "SELECT tract, year, filings_total FROM panel_s WHERE year <> 2001", views="panel_s")
def year_filter(spark, folder):
    return B.panel_dense(spark, folder).where(F.col("year") != 2001).select("tract", "year", "filings_total")


@query("not_null_filter", "SELECT tract, year, filings_rate FROM panel_h WHERE filings_rate IS NOT NULL",
       views="panel_s panel_h")
def not_null_filter(spark, folder):
    return B.panel_holes(spark, folder).where(F.col("filings_rate").isNotNull()).select("tract", "year", "filings_rate")


@query("isin_filter", "SELECT tract, year FROM panel_c WHERE year IN (1996, 1997, 1998, 1999)", views="panel_c")
def isin_filter(spark, folder):
    return B.panel_sparse(spark, folder).where(F.col("year").isin(1996, 1997, 1998, 1999)).select("tract", "year")


@query("zscore_outliers", """
SELECT doc_id, n_chars FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)
WHERE abs(n_chars - m) > 3 * s""")
def zscore_outliers(spark, folder):
    return O.zscore_outliers(table(spark, folder, "documents").select("doc_id", "n_chars"), "n_chars")


@query("argmax_rows", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""")
def argmax_rows(spark, folder):
    return O.argmax_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


PCT = """(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::double)
  / count({v}) OVER (PARTITION BY {g})"""


@query("top_decile_filter", f"""
SELECT tract, year, filings_rate FROM (SELECT *, {PCT.format(g='1', v='filings_rate')} AS p FROM panel_h WHERE filings_rate IS NOT NULL)
WHERE p > 0.9::double""", views="panel_s panel_h")
def top_decile_filter(spark, folder):
    return O.top_share(B.panel_table(spark, folder, holes=True), "filings_rate").select("tract", "year", "filings_rate")


@query("source_predicate", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1997""")
def source_predicate(spark, folder):
    return L.between_years(table(spark, folder, "lineitem"), "l_shipdate", 1996, 1997, is_date=True) \
        .select("l_orderkey", "l_linenumber", "l_shipdate")


@query("flagged_entities", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos, count(*) OVER () AS n FROM scored)
WHERE pos < floor(n * (10 / 100.0::double))""", views="scored")
def flagged_entities(spark, folder):
    flagged = flag_first(B.scored(spark, folder), [], M.score_rank("score", ["doc_id"]), 10)
    return flagged.where(F.col("flag") == 1).select("doc_id")


@query("leaderboard_sorted", """
SELECT model, split_date, max(score) AS best, count(*) AS n FROM scored_runs GROUP BY ALL ORDER BY best DESC""",
       views="scored scored_runs")
def leaderboard_sorted(spark, folder):
    return B.scored_runs(spark, folder).groupBy("model", "split_date").agg(
        F.max("score").alias("best"), F.count("*").alias("n")).orderBy(F.desc("best"), "model", "split_date")


@query("sort_pairs_desc", """
SELECT doc_id, score, label, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS position FROM scored ORDER BY position""",
       views="scored")
def sort_pairs_desc(spark, folder):
    order = M.score_order("score", ["doc_id"])
    placed = O.positions(B.scored(spark, folder).select("doc_id", "score", "label"), [], order)
    return placed.drop("group_rows").orderBy("position")


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 4")
def limit_offset(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice") \
        .orderBy(F.desc("o_totalprice"), "o_orderkey").offset(4).limit(10)


@query("union_by_name", """
SELECT tract, year, filings_total, filings_rate FROM panel_s UNION ALL SELECT tract, year, filings_total, NULL FROM panel_c""",
       views="panel_s panel_c")
def union_by_name(spark, folder):
    return P.union_by_name(B.panel_dense(spark, folder).drop("commarea"), B.panel_sparse(spark, folder).drop("commarea"))


@query("union_common_columns", """
SELECT tract, year, commarea, filings_total FROM panel_s UNION ALL SELECT tract, year, commarea, filings_total FROM panel_c""",
       views="panel_s panel_c")
def union_common_columns(spark, folder):
    return P.union_common(B.panel_dense(spark, folder), B.panel_sparse(spark, folder))


@query("distinct_years", "SELECT DISTINCT cast(year(l_shipdate) AS int) AS year FROM lineitem")
def distinct_years(spark, folder):
    return table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
