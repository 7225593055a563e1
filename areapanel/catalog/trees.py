"""Trees and forests on order lines, each with SQL that grows the same trees level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from areapanel.catalog.base import SQL, query, table
from areapanel.operators import models as ML
from areapanel.operators import trees as T
from areapanel.plans import grid_models as G

COLUMNS = {"returned": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "still_open": "l_linestatus = 'O'", "many": "l_quantity > 25", "very_many": "l_quantity > 40",
           "few": "l_quantity <= 10", "discounted": "l_discount > 0.05", "taxed": "l_tax > 0.02", "highly_taxed": "l_tax > 0.06", "first_line": "l_linenumber = 1",
           "late_line": "l_linenumber > 4", "early_supplier": "l_suppkey % 7 < 3"}
LABEL = "l_extendedprice > 45000"
KEYS = ["l_orderkey", "l_linenumber"]


def lines(spark, folder):
    """Order lines with 0/1 columns and the label."""
    flags = [F.coalesce(F.expr(e).cast("int"), F.lit(0)).alias(c) for c, e in COLUMNS.items()]
    return table(spark, folder, "lineitem").select(*KEYS, F.coalesce(F.expr(LABEL).cast("int"), F.lit(0)).alias("label"), *flags)


def _impurity(p: str, w: str, criterion: str) -> str:
    q = f"(({p})::DOUBLE / nullif({w}, 0))"
    if criterion == "gini":
        return f"(2 * {q} * (1 - {q}))"
    return f"(CASE WHEN {q} > 0 AND {q} < 1 THEN -({q} * log2({q}) + (1 - {q}) * log2(1 - {q})) ELSE 0 END)"


def grown_sql(criterion: str, depth: int, trees: int = 1, looked_at: int | None = None, min_split: int = 2, bootstrap: bool = False, seed: int = T.SEED,
              rows: str = "TRUE") -> list[str]:
    """CTEs r0, s0, t0, r1, ...: rows, splits and totals of each level over 0/1 columns, and `nodes`."""
    n = len(COLUMNS)
    flags = ", ".join(f"coalesce(({e})::INT, 0)" for e in COLUMNS.values())
    weight = "1"
    if bootstrap:
        u = f"('0x' || substr(md5('{seed}:' || tree || ':' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
        weight = "(" + " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in T.POISSON) + ")"
    out = [f"x AS MATERIALIZED (SELECT row_number() OVER () AS i, l_orderkey, l_linenumber, [{flags}] AS v, coalesce(({LABEL})::INT, 0) AS y FROM lineitem)",
           f"d AS (SELECT tree, v, y, {weight} AS w FROM x, range({trees}) g(tree) WHERE {rows})",
           "r0 AS MATERIALIZED (SELECT tree, '' AS path, v, count(*) AS n, sum(w) AS w, sum(w * y) AS p FROM d WHERE w > 0 GROUP BY tree, v)"]
    for k in range(depth + 1):
        out.append(f"t{k} AS MATERIALIZED (SELECT tree, path, sum(n) AS n, sum(w) AS w, sum(p) AS p FROM r{k} GROUP BY tree, path)")
        if k == depth:
            out.append(f"s{k} AS (SELECT tree, path, 0 AS feature, 0.0::DOUBLE AS gain FROM t{k} WHERE FALSE)")
            break
        hist = " UNION ALL ".join(f"SELECT tree, path, {i} AS feature, sum(CASE WHEN v[{i + 1}] = 0 THEN w ELSE 0 END) AS lw, "
                                  f"sum(CASE WHEN v[{i + 1}] = 0 THEN p ELSE 0 END) AS lp FROM r{k} GROUP BY tree, path" for i in range(n))
        gain = (f"round({_impurity('p', 'w', criterion)} - (lw / w::DOUBLE) * {_impurity('lp', 'lw', criterion)} "
                f"- ((w - lw) / w::DOUBLE) * {_impurity('p - lp', 'w - lw', criterion)}, {T.DIGITS})")
        place = f"md5('{seed}:' || tree || ':' || path || ':' || "
        places = ", ".join(f"{place}{f})" for f in range(n))
        drawn = "TRUE" if looked_at is None else f"place <= list_sort([{places}])[{looked_at}]"
        out.append(f"c{k} AS MATERIALIZED (SELECT *, {drawn} AS drawn FROM (SELECT tree, path, feature, {gain} AS gain, {place}feature) AS place "
                   f"FROM ({hist}) JOIN t{k} USING (tree, path) WHERE lw > 0 AND lw < w AND p > 0 AND p < w AND n >= {min_split}))")
        out.append(f"s{k} AS MATERIALIZED (SELECT tree, path, feature, gain FROM c{k} QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY drawn DESC, "
                   "CASE WHEN drawn THEN '' ELSE place END, gain DESC, feature) = 1)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT tree, path || CASE WHEN v[feature + 1] = 0 THEN 'L' ELSE 'R' END AS path, v, n, w, p FROM r{k} JOIN s{k} USING (tree, path))")
    nodes = " UNION ALL ".join(f"SELECT tree, path, {k} AS depth, n, w, p, feature, gain FROM t{k} LEFT JOIN s{k} USING (tree, path)" for k in range(depth + 1))
    return [*out, f"nodes AS MATERIALIZED ({nodes})"]


def scored_sql(depth: int, trees: int, rows: str) -> list[str]:
    """CTEs that walk the chosen rows down the trees: `scores`."""
    out = [f"v0 AS (SELECT i, l_orderkey, l_linenumber, v, tree, '' AS path FROM x, range({trees}) g(tree) WHERE {rows})"]
    for k in range(depth):
        out.append(f"v{k + 1} AS (SELECT i, l_orderkey, l_linenumber, v, tree, path || CASE WHEN v[feature + 1] = 0 THEN 'L' ELSE 'R' END AS path FROM v{k} JOIN s{k} USING (tree, path))")
    every = " UNION ALL ".join(f"SELECT i, l_orderkey, l_linenumber, tree, path FROM v{k}" for k in range(depth + 1))
    return [*out, f"scores AS (SELECT l_orderkey, l_linenumber, round(sum(p / w::DOUBLE) / {trees}, 9) AS score FROM ({every}) JOIN nodes USING (tree, path) "
                  "WHERE feature IS NULL GROUP BY i, l_orderkey, l_linenumber)"]


NAMES = "[" + ", ".join(f"'{c}'" for c in COLUMNS) + "]"
TREE = {"criterion": "entropy", "max_depth": 2}
DEEP = {"criterion": "entropy", "max_depth": 6, "min_samples_split": 10}
FOREST = {"trees": 4, "criterion": "gini", "max_depth": 4, "max_features": "log2", "min_samples_split": 10, "bootstrap": True}
TRAIN, TEST = "l_orderkey % 4 <> 0", "l_orderkey % 4 = 0"
_LOOKED_AT = T.feature_count("log2", len(COLUMNS))


def _nodes_sql(depth: int, **how) -> str:
    return ("WITH " + ", ".join(grown_sql(depth=depth, **how)) + f" SELECT tree::INT AS tree, path, depth, n::BIGINT AS n, w::BIGINT AS w, p::BIGINT AS p, "
            f"round(p / w::DOUBLE, 9) AS share, {NAMES}[feature + 1] AS feature, gain FROM nodes")


def _named(model):
    names = F.array(*[F.lit(c) for c in model.predictors])
    return model.nodes.select("tree", "path", "depth", "n", "w", "p", F.round("share", 9).alias("share"), F.get(names, F.col("feature")).alias("feature"),
                              "gain")


@query("tree_nodes", _nodes_sql(2, criterion="entropy"))
def tree_nodes(spark, folder):
    return _named(T.grow(lines(spark, folder), list(COLUMNS), keys=KEYS, **TREE))


@query("tree_scores", "WITH " + ", ".join([*grown_sql("entropy", 6, min_split=10, rows=TRAIN), *scored_sql(6, 1, TEST)]) + " SELECT * FROM scores")
def tree_scores(spark, folder):
    df = lines(spark, folder)
    model = T.grow(df.where(TRAIN), list(COLUMNS), keys=KEYS, **DEEP)
    return T.score(model, df.where(TEST)).select(*KEYS, F.round("score", 9).alias("score"))


@query("forest_nodes", _nodes_sql(4, criterion="gini", trees=4, looked_at=_LOOKED_AT, min_split=10, bootstrap=True))
def forest_nodes(spark, folder):
    return _named(T.grow(lines(spark, folder), list(COLUMNS), keys=KEYS, **FOREST))


@query("forest_scores", "WITH " + ", ".join([*grown_sql("gini", 4, 4, _LOOKED_AT, 10, True, rows=TRAIN), *scored_sql(4, 4, TEST)]) + " SELECT * FROM scores")
def forest_scores(spark, folder):
    df = lines(spark, folder)
    model = T.grow(df.where(TRAIN), list(COLUMNS), keys=KEYS, **FOREST)
    return T.score(model, df.where(TEST)).select(*KEYS, F.round("score", 9).alias("score"))


@query("forest_importance", "WITH " + ", ".join(grown_sql("gini", 4, 4, _LOOKED_AT, 10, True)) + f"""
, won AS (SELECT tree, feature, sum(gain * w / all_w) AS won FROM nodes JOIN (SELECT tree, w::DOUBLE AS all_w FROM nodes WHERE depth = 0) USING (tree)
  WHERE feature IS NOT NULL GROUP BY tree, feature),
part AS (SELECT feature, won / nullif(sum(won) OVER (PARTITION BY tree), 0) AS part FROM won)
SELECT {NAMES}[feature + 1] AS feature, round(sum(part) / (SELECT count(*) FROM nodes WHERE depth = 0 AND feature IS NOT NULL), 6) AS importance
FROM part GROUP BY feature HAVING sum(part) > 0""")
def forest_importance(spark, folder):
    model = T.grow(lines(spark, folder), list(COLUMNS), keys=KEYS, **FOREST)
    return T.importances(model).withColumn("importance", F.round("importance", 6))


@query("top_forest_features", f"SELECT * FROM ({SQL['forest_importance']}) ORDER BY importance DESC, feature LIMIT 5")
def top_forest_features(spark, folder):
    model = T.grow(lines(spark, folder), list(COLUMNS), keys=KEYS, **FOREST)
    found = T.importances(model).withColumn("importance", F.round("importance", 6))
    return found.orderBy(F.desc("importance"), "feature").limit(5)


_WITH_LABEL = SQL["tree_scores"].replace("scores AS (SELECT l_orderkey", "scores AS (SELECT i, l_orderkey").replace(
    "SELECT * FROM scores", "SELECT x.l_orderkey, x.l_linenumber, y AS label, score FROM scores JOIN x USING (i)")


@query("run_model", _WITH_LABEL)
def run_model(spark, folder):
    """One model by its name and parameters."""
    df = lines(spark, folder)
    scored = ML.run_model(df.where(TRAIN), df.where(TEST), "DT", DEEP, list(COLUMNS), KEYS)
    return scored.select(*KEYS, "label", F.round("score", 9).alias("score"))


GRID = {"DT": {"criterion": ["gini", "entropy"], "max_depth": [2, 4]},
        "B": {"n_estimators": [3], "criterion": ["entropy"], "max_depth": [3]},
        "RF": {"n_estimators": [4], "criterion": ["gini"], "max_depth": [4], "max_features": ["log2"], "min_samples_split": [10]}}
SPLITS = {"1996-01-01": "l_orderkey % 3 <> 0", "1997-01-01": "l_orderkey % 3 <> 1"}


def grid_table(spark, folder):
    df = lines(spark, folder)
    parts = [df.where(rows).select(F.lit(day).alias("split_date"), F.lit("train").alias("role"), "*") for day, rows in SPLITS.items()]
    return G.grid_models(parts[0].unionByName(parts[1]), GRID, list(COLUMNS), KEYS)


def _grid_sql(body: str) -> str:
    """`body` for every grid point and split, beside the names of both."""
    out = []
    for day, rows in SPLITS.items():
        for name in GRID:
            for params in ML.grid_points(GRID[name]):
                how = T.fit_params(name, {**ML.DEFAULTS[name], **params})
                looked_at = None if how.get("max_features") is None else T.feature_count(how["max_features"], len(COLUMNS))
                ctes = grown_sql(how["criterion"], how["max_depth"], how.get("trees", 1), looked_at, how["min_samples_split"], how.get("bootstrap", False),
                                 seed=ML.SEED, rows=rows)
                out.append(f"SELECT '{name}' AS model_type, '{ML.params_text(params)}' AS parameters, '{day}' AS split_date, * "
                           f"FROM (WITH {', '.join(ctes)} {body})")
    return " UNION ALL ".join(out)


@query("grid_nodes", _grid_sql(f"SELECT tree::INT AS tree, path, n::BIGINT AS n, w::BIGINT AS w, p::BIGINT AS p, {NAMES}[feature + 1] AS feature, gain FROM nodes"))
def grid_nodes(spark, folder):
    return grid_table(spark, folder).select(*G.POINT, "tree", "path", "n", "w", "p", "feature", "gain")


_IMPORTANCE = f""", won AS (SELECT tree, feature, sum(gain * w / all_w) AS won FROM nodes
    JOIN (SELECT tree, w::DOUBLE AS all_w FROM nodes WHERE depth = 0) USING (tree) WHERE feature IS NOT NULL GROUP BY tree, feature),
  part AS (SELECT feature, won / nullif(sum(won) OVER (PARTITION BY tree), 0) AS part FROM won),
  named AS (SELECT {NAMES}[feature + 1] AS feature, sum(part) / (SELECT count(*) FROM nodes WHERE depth = 0 AND feature IS NOT NULL) AS v
    FROM part GROUP BY feature HAVING sum(part) > 0)
SELECT feature, round(v, 6) AS importance FROM named ORDER BY round(v, 12) DESC, feature LIMIT 5"""


@query("grid_importance", _grid_sql(_IMPORTANCE))
def grid_importance(spark, folder):
    """The five columns of most weight in every grid point of every split."""
    return G.grid_importance(grid_table(spark, folder), 5).withColumn("importance", F.round("importance", 6))
