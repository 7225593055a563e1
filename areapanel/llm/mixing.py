"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents fall into cells (source, language, topic). The cells' token sums are raked: in each sweep they are scaled to the
target share of every source, then of every language, then of every topic. A cell's fitted weight over its token
sum is its sampling rate; rates are scaled so that the largest is 1, which gives the largest sample
whose expected token shares are the targets. A document is drawn if a hash of its id, as a number from 0 to 1, is
below the rate of its cell, so draws do not depend on partitioning and can be repeated. Documents without an id draw by their text.

Targets: given tables (value, share), else the observed shares to the power `POWER`, normalised. All margins
are sums over cells, which are combined map-side from the documents, so a source with a third of all rows is a few rows of each task, and
the number of sources is not bounded. Null sources, languages and texts are the value '(none)' or no tokens; rows
without tokens weigh nothing, keep their cell's rate, and have rate 1 in a cell without any tokens.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.llm.tables import as_struct, from_struct, query, stage, table

POWER = 0.9
SWEEPS = 12
TOLERANCE = 1e-9
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"

#: Topics by the first mark that a text holds.
TOPICS = {"contact": ("@",), "table": ("|",), "markup": ("***", "$$$", "%%%", "&&&", "###")}


def topic_of(text: Column) -> Column:
    out = None
    for name, marks in TOPICS.items():
        has = F.contains(text, F.lit(marks[0]))
        for mark in marks[1:]:
            has = has | F.contains(text, F.lit(mark))
        out = F.when(has, name) if out is None else out.when(has, name)
    return F.when(text.isNull(), NONE).otherwise(out.otherwise("prose"))


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def draw(key: str, text: Column) -> Column:
    """A number from 0 to 1 from the key; rows without a key draw by their text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def power_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
    raised = margin.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("p"))
    total = raised.agg(F.sum("p").alias("p")).first().p
    return raised.select("value", (F.col("p") / F.lit(total or 1.0)).alias("share"))


def rates(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with `rate`; raises if the shares are still off the targets after the last sweep.

    Every cell carries the target shares of its three values, so a sweep is one sum per margin and one table written; it ends once a sweep finds all
    margins within the tolerance.
    """
    dims = list(targets)
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim in dims:
        fitted = fitted.join(targets[dim].select(F.col("value").alias(dim), F.col("share").alias(f"share_{dim}")), dim, "left")
    off = 0.0
    for _ in range(sweeps):
        for dim in dims:
            share = F.col(f"share_{dim}")
            fitted = fitted.withColumn("total", F.sum("weight").over(Window.partitionBy(dim)))
            fitted = fitted.withColumns({f"off_{dim}": F.coalesce(F.abs(F.col("total") - share), F.lit(0.0)),
                                         "weight": F.coalesce(F.col("weight") * F.try_divide(share, F.col("total")), F.lit(0.0))}).drop("total")
        fitted = stage(fitted, "sweep")
        off = fitted.agg(F.max(F.greatest(*[F.col(f"off_{d}") for d in dims]))).first()[0] or 0.0
        if off <= tolerance:
            break
    if off > 0.01:
        raise RuntimeError(f"shares are {off:.3f} off the targets after {sweeps} sweeps")
    ratio = F.try_divide(F.col("weight"), F.col("tokens"))
    largest = fitted.where("tokens > 0").agg(F.max(ratio).alias("r")).first().r or 1.0
    return fitted.select(*dims, F.when(F.col("tokens") > 0, ratio / F.lit(largest)).otherwise(F.lit(1.0)).alias("rate"))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, power: float = POWER, sweeps: int = SWEEPS,
        columns: tuple = (), topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The drawn documents: `doc` (a struct of the `columns` of docs), source, lang, topic, tokens and rate.

    `topic` and `tokens` are the documents' topics and stored token counts; without them, topics come from marks in the text and words are counted.
    """
    text = F.col("text")
    kept = [c for c in docs.columns if c in columns]
    placed = docs.select(*([as_struct(docs, kept).alias("doc")] if kept else []), draw("doc_id", text).alias("u"),
                         F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
                         F.coalesce(topic_of(text) if topic is None else topic, F.lit(NONE)).alias("topic"),
                         (token_count(text) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias("tokens"))
    cells = stage(placed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = {d: (targets or {}).get(d) or stage(power_targets(cells, d, power), "targets") for d in DIMENSIONS}
    rated = stage(rates(cells, targets, sweeps), "rates")
    return placed.join(rated, list(DIMENSIONS)).where("u < rate").drop("u")


def _sql() -> str:
    marks = " ".join(f"WHEN {' OR '.join(f'contains(text, {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{name}'" for name, ms in TOPICS.items())
    ctes = [f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
      CASE WHEN text IS NULL THEN '{NONE}' {marks} ELSE 'prose' END AS topic,
      coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS n_tokens,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)""",
            "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL)"]
    for d in DIMENSIONS:
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens)::DOUBLE, {POWER}) / "
                    f"sum(pow(sum(tokens)::DOUBLE, {POWER})) OVER () AS share FROM w0 GROUP BY {d} HAVING sum(tokens) > 0)")
    n = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            ctes.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(CASE WHEN s > 0 THEN weight * (share / s) END, 0) "
                        f"AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY {d}) AS s FROM w{n}) LEFT JOIN t_{d} USING ({d}))")
            n += 1
    ctes.append(f"r AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens / (SELECT max(weight / tokens) FROM w{n} "
                f"WHERE tokens > 0) ELSE 1.0 END AS rate FROM w{n})")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate FROM d JOIN r USING (source, lang, topic) WHERE u < rate"""


OP4_SQL = _sql()


@query("op4_proportional_mixing", OP4_SQL)
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, columns=("doc_id",)).select(
        F.col("doc.doc_id").alias("doc_id"), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("rate", 6).alias("rate"))


def keep_mix(docs: DataFrame) -> DataFrame:
    """The drawn documents; columns unchanged."""
    return from_struct(mix(docs, columns=tuple(docs.columns)), "doc", docs.columns)
