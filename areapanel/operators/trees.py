"""Decision trees and forests grown level by level with DataFrame operations.

Every training row carries, for each tree, the path of the node it is in (a letter per turn). A level is one aggregation over
(tree, node, column, bin), a running sum over the few bins of a column, the best split of each node, and a join of the splits back to the rows.
All trees of a forest grow in the same jobs. Rows with equal bins are one row with weights from the start, so the work follows the number of distinct
feature vectors, and a node with most rows is combined map-side. Depth is not bounded: paths are text.

Bins: thresholds lie midway between neighbouring quantiles of a column (all values of a 0/1 column), a row's bin is the number of thresholds below its value.
Splits follow the usual rules: a node stays whole at `max_depth`, with fewer than `min_samples_split` rows, with one class, or with no column that parts it; a split that
gains nothing is still made. Gains are compared to nine digits, ties go to the first column and the lowest threshold. With `max_features`, a node looks at that
many columns in an order drawn for it, and on to the first one that parts it. Bootstrap weights are drawn per row and tree from a Poisson law of mean 1,
by a hash of the row's keys. Leaves keep their share of positives; a forest's score is the mean of its trees' shares.

Every row is read twice: once for the thresholds (columns of only 0 and 1 need no quantiles), once to be collapsed. The draws of several trees are added up side by side
while rows collapse, so no row is copied for its trees before that.

Missing labels are left out; missing predictors are in the lowest bin. Without training rows there is no node and scores are missing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.session import stage

BINS = 32
DIGITS = 9
SEED = 100
TREES_A_ROW = 8
FEW_CUTS = 4
DRAWN_AT_ONCE = 100
#: Chance that a draw of the Poisson law with mean 1 is at most k, for k = 0, 1, ...
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]


@dataclass
class TreeModel:
    """`nodes`: tree, path, depth, n, w, p, share, and for inner nodes feature (number), bin, gain. thresholds: those of each predictor."""

    nodes: DataFrame
    predictors: list[str]
    thresholds: list[list[float]]
    trees: int
    depth: int


def split_points(df: DataFrame, predictors: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Thresholds of each predictor; bins x columns numbers reach the driver. Quantiles are taken of columns with other values than 0 and 1 only."""
    return split_points_of(df.withColumn("_part", F.lit(0)), "_part", predictors, bins).get(0, [[] for _ in predictors])


def split_points_of(df: DataFrame, part: str, predictors: Sequence[str], bins: int = BINS) -> dict:
    """Thresholds of each predictor for every value of the column `part` (not many), all in the same passes."""
    number = {c: F.col(c).cast("double") for c in predictors}
    ends = [(F.min(v), F.max(v), F.count_if((v != 0) & (v != 1))) for v in number.values()]
    found = df.groupBy(part).agg(*[e.alias(f"{k}{i}") for i, three in enumerate(ends) for k, e in zip("abo", three)]).collect()
    values = {r[part]: [{r[f"a{i}"], r[f"b{i}"]} - {None} for i in range(len(predictors))] for r in found}
    other = [i for i in range(len(predictors)) if any(r[f"o{i}"] for r in found)]
    if other:
        marks = [i / bins for i in range(bins + 1)]
        quantiles = df.groupBy(part).agg(*[F.percentile_approx(number[predictors[i]], marks, 100 * bins).alias(f"c{i}") for i in other]).collect()
        seen = {r[part]: r for r in found}
        for r in quantiles:
            for i in other:
                if seen[r[part]][f"o{i}"]:
                    values[r[part]][i] = set(r[f"c{i}"] or [])
    in_order = {k: [sorted(v) for v in columns] for k, columns in values.items()}
    return {k: [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in columns] for k, columns in in_order.items()}


def bins_of(predictors: Sequence[str], thresholds: Sequence[Sequence[float]]) -> Column:
    """Array of the bins of all predictors."""
    def one(name: str, cuts: Sequence[float]) -> Column:
        value = F.col(name).cast("double")
        if not cuts:
            return F.lit(0)
        if len(cuts) <= FEW_CUTS:
            return F.coalesce(sum(((value > F.lit(float(c))).cast("int") for c in cuts[1:]), (value > F.lit(float(cuts[0]))).cast("int")), F.lit(0))
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: value > c)), F.lit(0))
    return F.array(*[one(c, t) for c, t in zip(predictors, thresholds)])


def bootstrap_weight(seed: int, tree: Column, key: Column) -> Column:
    """How many chances of POISSON are at most the row's number: the first eight hexadecimal digits of an md5, over 2^32.

    Texts of such digits compare as their numbers do, so the digest is worked out once and needs no conversion.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), key).cast("binary"))
    marks = [f"{math.ceil(c * 2 ** 32):08x}" for c in POISSON]
    return sum(((digest >= F.lit(m)).cast("long") for m in marks[1:]), (digest >= F.lit(marks[0])).cast("long"))


def collapsed(train: DataFrame, bins: Column, label: str, keys: Sequence[str], trees: int, bootstrap: bool, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, tree, bins, n, w, p): rows of weight, their weights and those of positive rows, for every tree and distinct vector, apart for the values of `by`."""
    width = min(trees, TREES_A_ROW) if bootstrap else 1
    y, key = F.col(label).cast("long"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    rows = train.select(*by, bins.alias("bins"), y.alias("y"), key.alias("key"))
    if trees > width and bootstrap:
        rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(width))))
    else:
        rows = rows.withColumn("first", F.lit(0))
    rows = rows.select(*by, "first", "bins", "y", *[(bootstrap_weight(seed, F.col("first") + k, F.col("key")) if bootstrap else F.lit(1).cast("long")).alias(f"w{k}")
                                                    for k in range(width)])
    sums = rows.groupBy(*by, "first", "bins", "y").agg(*[e for k in range(width) for e in (F.count_if(F.col(f"w{k}") > 0).alias(f"n{k}"), F.sum(f"w{k}").alias(f"w{k}"))])
    if bootstrap:
        tree = F.explode(F.array(*[F.struct((F.col("first") + k).alias("tree"), F.col(f"n{k}").alias("n"), F.col(f"w{k}").alias("w")) for k in range(width)]))
        sums = sums.select(*by, "bins", "y", tree.alias("t")).select(*by, "t.*", "bins", "y").where((F.col("w") > 0) & (F.col("tree") < trees))
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
        sums = sums.select(*by, every.alias("tree"), "bins", "y", F.col("n0").alias("n"), F.col("w0").alias("w"))
    return sums.groupBy(*by, "tree", "bins").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"))


def impurity(p: Column, w: Column, criterion: str) -> Column:
    q = F.try_divide(p.cast("double"), w)
    if criterion == "entropy":
        return F.when((q > 0) & (q < 1), -(q * F.log2(q) + (1 - q) * F.log2(1 - q))).otherwise(F.lit(0.0))
    if criterion != "gini":
        raise ValueError("criterion is 'gini' or 'entropy'")
    return 2 * q * (1 - q)


def feature_count(max_features: str | int | None, n: int) -> int:
    """How many columns a node looks at."""
    if max_features in (None, "all"):
        return n
    if max_features in ("sqrt", "auto"):
        return max(1, int(math.sqrt(n)))
    if max_features == "log2":
        return max(1, int(math.log2(n)))
    return max(1, min(int(max_features), n))


def _splits(rows: DataFrame, n_features: int, criterion: str, looked_at: int, min_split: int, seed: int, min_leaf: int | None = None) -> DataFrame:
    """Best split of every node that may be split: tree, path, feature, bin, gain.

    With `min_leaf` the rules are MLlib's: both sides weigh that much, the split gains something, and a node looks at its drawn columns only.
    """
    node = ["tree", "path"]

    def place(f: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("path"), f.cast("string")).cast("binary"))
    totals = rows.groupBy(*node).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("p").alias("p"))
    totals = totals.where((F.col("n") >= min_split) & (F.col("p") > 0) & (F.col("p") < F.col("w")))
    if looked_at < n_features:
        # drawn once a node, not once a cut
        order = F.array_sort(F.array(*[place(F.lit(f)) for f in range(n_features)]))
        totals = totals.withColumn("limit", order[looked_at - 1])
    hist = rows.select(*node, F.posexplode("bins").alias("feature", "bin"), "w", "p").groupBy(*node, "feature", "bin").agg(
        F.sum("w").alias("bw"), F.sum("p").alias("bp"))
    run = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = hist.select(*node, "feature", "bin", F.sum("bw").over(run).alias("lw"), F.sum("bp").over(run).alias("lp"))
    cuts = cuts.join(totals, node).where((F.col("lw") > 0) & (F.col("lw") < F.col("w")))
    rw, rp = F.col("w") - F.col("lw"), F.col("p") - F.col("lp")
    gain = impurity(F.col("p"), F.col("w"), criterion) - (F.col("lw") / F.col("w")) * impurity(F.col("lp"), F.col("lw"), criterion) \
        - (rw / F.col("w")) * impurity(rp, rw, criterion)
    cuts = cuts.withColumn("gain", F.round(gain, DIGITS))
    if min_leaf is not None:
        cuts = cuts.where((F.col("lw") >= min_leaf) & (rw >= min_leaf) & (F.col("gain") > 0))
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    if looked_at >= n_features:
        return cuts.groupBy(*node).agg(best.alias("s")).select(*node, (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), F.col("s.gain").alias("gain"))

    cuts = cuts.withColumn("place", place(F.col("feature")))
    if min_leaf is not None:
        cuts = cuts.where(F.col("place") <= F.col("limit"))
    drawn = F.col("place") <= F.col("limit")
    own = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    beyond = F.struct("place", (-F.col("gain")).alias("g"), F.col("feature").alias("f"), F.col("bin").alias("b"))
    picked = cuts.groupBy(*node).agg(F.max(F.when(drawn, own)).alias("s"), F.min(F.when(~drawn, beyond)).alias("t"))
    seen = F.col("s").isNotNull()
    return picked.select(*node, F.when(seen, -F.col("s.f")).otherwise(F.col("t.f")).alias("feature"),
                         F.when(seen, -F.col("s.b")).otherwise(F.col("t.b")).alias("bin"), F.when(seen, F.col("s.gain")).otherwise(-F.col("t.g")).alias("gain"))


def grow(train: DataFrame, predictors: Sequence[str], label: str = "label", keys: Sequence[str] = (), trees: int = 1, criterion: str = "gini",
         max_depth: int | None = None, max_features: str | int | None = None, min_samples_split: int = 2, bootstrap: bool = False,
         seed: int = SEED, bins: int = BINS) -> TreeModel:
    """Trees on 0/1 labels. `keys` name a row for its bootstrap draws."""
    predictors = list(predictors)
    if bootstrap and not keys:
        raise ValueError("bootstrap draws need the rows' keys")
    train = train.where(F.col(label).isNotNull())
    thresholds = split_points(train, predictors, bins)
    rows = stage(collapsed(train, bins_of(predictors, thresholds), label, keys, trees, bootstrap, seed).withColumn("path", F.lit("")), "tree-rows")
    return _grown(rows, predictors, thresholds, trees, criterion, max_depth, feature_count(max_features, len(predictors)), min_samples_split, seed)


@dataclass
class CollapsedParts:
    """The collapsed training rows of several training sets: `rows` (part, bootstrap, tree, bins, n, w, p) and the thresholds of each set."""

    part: str
    rows: DataFrame
    thresholds: dict
    predictors: list[str]

    def grow(self, value, trees: int = 1, criterion: str = "gini", max_depth: int | None = None, max_features: str | int | None = None,
             min_samples_split: int = 2, bootstrap: bool = False, seed: int = SEED) -> TreeModel:
        """What `grow` gives over the rows of one set."""
        own = self.rows.where((F.col(self.part) == F.lit(value)) & (F.col("bootstrap") == F.lit(bootstrap)) & (F.col("tree") < trees))
        rows = own.select("tree", "bins", "n", "w", "p", F.lit("").alias("path"))
        return _grown(rows, self.predictors, self.thresholds.get(value, [[] for _ in self.predictors]), trees, criterion, max_depth,
                      feature_count(max_features, len(self.predictors)), min_samples_split, seed)


def collapse_parts(train: DataFrame, part: str, predictors: Sequence[str], label: str, keys: Sequence[str], trees: int, single: bool, seed: int = SEED,
                   bins: int = BINS) -> CollapsedParts:
    """Rows of all training sets, told apart by the column `part`, read once for the thresholds and collapsed once for everything grown from them.

    A row's draws depend on the seed, the tree and its keys only, so every forest of up to `trees` trees takes its first trees from the same sums.
    `single`: for trees without draws too.
    """
    predictors = list(predictors)
    train = train.where(F.col(label).isNotNull())
    thresholds = split_points_of(train, part, predictors, bins)
    alike: list = []
    for value, cuts in thresholds.items():
        held = next((values for values, c in alike if c == cuts), None)
        if held is None:
            alike.append(([value], cuts))
        else:
            held.append(value)
    # sets of equal thresholds share an expression
    own = bins_of(predictors, alike[0][1] if alike else [[] for _ in predictors])
    for values, cuts in alike[1:]:
        own = F.when(F.col(part).isin(values), bins_of(predictors, cuts)).otherwise(own)
    kinds = ([(True, trees)] if trees else []) + ([(False, 1)] if single else [])
    parts = [collapsed(train, own, label, keys, n, drawn, seed, [part]).withColumn("bootstrap", F.lit(drawn)) for drawn, n in kinds]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return CollapsedParts(part, stage(rows, "tree-rows"), thresholds, predictors)


def grow_like_mllib(groups: DataFrame, predictors: Sequence[str], trees: int, max_depth: int, looked_at: int, min_leaf: int, seed: int = SEED) -> TreeModel:
    """Forest of MLlib's rules over 0/1 columns from `groups` (bins, m, q): distinct vectors, their rows and their positive rows.

    MLlib draws a Poisson weight of mean 1 for every row and tree; those of m equal rows add up to one of mean m, which is drawn here at once.
    The work follows vectors x trees, not rows x trees. A draw is seeded by the vector and its slice of trees, so partitioning does not matter.
    """
    spark = groups.sparkSession
    tasks = groups.select("bins", "m", "q", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(DRAWN_AT_ONCE))).alias("first"))

    def draw(batches):
        import numpy as np
        import pandas as pd
        for part in batches:
            for bins, m, q, first in zip(part["bins"], part["m"], part["q"], part["first"]):
                rng = np.random.default_rng([seed, int(first), *[int(b) for b in bins]])
                some = min(DRAWN_AT_ONCE, trees - first)
                p = rng.poisson(q, some)
                w = p + rng.poisson(m - q, some)
                yield pd.DataFrame({"tree": np.arange(first, first + some, dtype="int32"), "bins": [list(bins)] * some, "n": w, "w": w, "p": p, "path": ""})

    parts = max(2, spark.sparkContext.defaultParallelism)
    drawn = tasks.repartition(parts, "bins", "first").mapInPandas(draw, "tree int, bins array<int>, n long, w long, p long, path string")
    rows = stage(drawn.where("w > 0"), "tree-rows")
    return _grown(rows, list(predictors), [[0.5]] * len(predictors), trees, "gini", max_depth, looked_at, 2, seed, min_leaf)


def _grown(rows: DataFrame, predictors: list[str], thresholds: list[list[float]], trees: int, criterion: str, max_depth: int | None, looked_at: int,
           min_samples_split: int, seed: int, min_leaf: int | None = None) -> TreeModel:
    """Levels of all trees from collapsed rows."""
    levels, depth = None, 0
    while True:
        totals = rows.groupBy("tree", "path").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("p").alias("p"))
        may_split = max_depth is None or depth < max_depth
        if may_split:
            splits = _splits(rows, len(predictors), criterion, looked_at, min_samples_split, seed, min_leaf)
        else:
            splits = rows.sparkSession.createDataFrame([], "tree int, path string, feature int, bin int, gain double")
        level = totals.join(splits, ["tree", "path"], "left").select(
            "tree", "path", F.lit(depth).alias("depth"), "n", "w", "p", (F.col("p") / F.col("w")).alias("share"), "feature", "bin", "gain")
        level = stage(level, "tree-level")
        levels = level if levels is None else levels.unionByName(level)
        if not may_split or level.where("feature is not null").isEmpty():
            break
        turn = F.when(F.col("bins")[F.col("feature")] <= F.col("bin"), "L").otherwise("R")
        parted = level.where("feature is not null").select("tree", "path", "feature", "bin")
        rows = stage(rows.join(parted, ["tree", "path"]).select("tree", "bins", "n", "w", "p", F.concat("path", turn).alias("path")), "tree-rows")
        depth += 1
    return TreeModel(stage(levels, "trees"), predictors, thresholds, trees, depth)


def score(model: TreeModel, df: DataFrame) -> DataFrame:
    """The rows with `score`: the mean share of the leaves that each row's vector reaches. Distinct vectors walk down level by level."""
    rows = stage(df.withColumn("_bins", bins_of(model.predictors, model.thresholds)), "to-score")
    walk = stage(rows.select(F.col("_bins").alias("bins")).distinct().select(
        "bins", F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1))).alias("tree"), F.lit("").alias("path")), "walk")
    reached = None
    for depth in range(model.depth + 1):
        here = model.nodes.where(F.col("depth") == depth).select("tree", "path", "share", "feature", "bin")
        met = walk.join(here, ["tree", "path"])
        leaves = met.where("feature is null").select("bins", "share")
        reached = leaves if reached is None else reached.unionByName(leaves)
        if depth < model.depth:
            turn = F.when(F.col("bins")[F.col("feature")] <= F.col("bin"), "L").otherwise("R")
            walk = stage(met.where("feature is not null").select("bins", "tree", F.concat("path", turn).alias("path")), "walk")
    # added up as decimals, so that equal vectors score the same whatever the order
    total = F.sum(F.col("share").cast("decimal(28,18)")).cast("double")
    scores = reached.groupBy(F.col("bins").alias("_bins")).agg((total / F.lit(float(model.trees))).alias("score"))
    return rows.join(scores, "_bins", "left").drop("_bins")


def importances(model: TreeModel) -> DataFrame:
    """(feature, importance): each column's share of a tree's impurity decrease, averaged over the trees that split at all."""
    root = model.nodes.where("depth = 0").select("tree", F.col("w").alias("all_w"))
    won = model.nodes.where("feature is not null").join(root, "tree").groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("w") / F.col("all_w")).alias("won"))
    per_tree = won.withColumn("part", F.try_divide(F.col("won"), F.sum("won").over(Window.partitionBy("tree"))))
    names = F.array(*[F.lit(c) for c in model.predictors])
    grown = model.nodes.where("depth = 0 and feature is not null").agg(F.count("*").alias("grown"))
    mean = per_tree.groupBy("feature").agg(F.sum("part").alias("s")).crossJoin(F.broadcast(grown))  # one row
    return mean.select(names[F.col("feature")].alias("feature"), (F.col("s") / F.col("grown")).alias("importance")).where("importance > 0")


def fit_params(name: str, params: Mapping) -> dict:
    """Arguments of `grow` for a model name (DT, RF, B) and its parameters."""
    out = {"criterion": params.get("criterion", "gini"), "max_depth": params.get("max_depth"), "min_samples_split": params.get("min_samples_split", 2)}
    if name == "DT":
        return out | {"max_features": params.get("max_features")}
    features = None if name == "B" else params.get("max_features") or "sqrt"
    return out | {"trees": params["n_estimators"], "max_features": features, "bootstrap": True}
