"""Regression forests grown level by level, all of them at once.

A tree is a key (by..., t, tree): trees of all draws, treatments and tree numbers grow together,
one aggregate per level.  Growing only needs a row's bins, so where their combinations are few the
rows are weighed once and folded to sums per (tree, combination), and the levels read these sums.
Else rows send sums per (tree, node, feature, bin) on every level, folded where the rows are.
Windows over the sums find each node's best cut.  Finished levels are arrays in heap order, a few
numbers per tree, which the next level walks down.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions import draws as D
from honestpick.functions.lineage import save_table
from honestpick.operators.joins import join_null_safe

FOLDED = 10_000      # combinations of bins up to which rows are folded to them

_NODE = "array<struct<f:int,bin:int,cut:double,value:double,low:double,high:double>>"


@dataclass(frozen=True)
class ForestSettings:
    depth: int = 5
    trees: int = 20
    max_bins: int = 64
    features_per_node: int | None = None    # None: all
    seed: int = 42
    fast: bool = False


def candidate_cuts(rows: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """Up to `max_bins` values per feature, evenly spread by rank; all of them when few differ.

    A fixed number of values comes to the driver, whatever the table's size.
    """
    return _cuts_and_tasks(rows, features, max_bins)[0]


def _cuts_and_tasks(rows: DataFrame, features: list[str], max_bins: int
                    ) -> tuple[list[list[float]], int]:
    """candidate_cuts(), and in how many tasks the rows came."""
    fine = 4 * max_bins
    ranks = F.array(*[F.lit(i / fine) for i in range(1, fine + 1)])
    slim = rows.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)],
                       F.spark_partition_id().alias("_task"))
    *found, last = slim.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(
        f"_{i}", ranks, F.lit(100 * fine)))).alias(f"_c{i}") for i in range(len(features))],
        F.max("_task")).first()
    cuts = []
    for values in found:
        values = values or []
        step = max(1, -(-len(values) // max_bins))
        cuts.append(values[step - 1::step])
    return cuts, (last or 0) + 1


def _bin(x: Column, cuts: list[float]) -> Column:
    """Number of cuts below x; 0 for a missing value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"),
                           lambda c: c < x))


def _walk(nodes: Column, x: Column, depth: int, cut: str = "cut") -> Column:
    """Heap index of the node where a row ends up; a missing value goes to the low side.

    `x` holds the values of the features, or their bins with `cut` "bin".
    """
    def step(at, _):
        node = F.get(nodes, at)
        high = F.coalesce(F.get(x, node["f"]) > node[cut], F.lit(False))
        return F.when(node["f"].isNull(), at).otherwise(2 * at + 1 + high.cast("int"))
    if depth == 0:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def grow_forests(rows: DataFrame, features: list[str], by: list[str] = (), t: str = "t",
                 y: str = "y", row_key: str = "row_id", weight: str | None = None,
                 settings: ForestSettings = ForestSettings()) -> DataFrame:
    """(by..., t, tree, nodes): bagged trees of every group and treatment, one job per level.

    Each tree weighs rows by Poisson(1), or Poisson(`weight`) where rows already count several
    times.  A cut puts x <= cut on the low side; it maximises the drop of squared error, ties go
    to the first feature and the lowest cut.  A group and treatment without rows has no trees.
    """
    s, by = settings, list(by)
    keys = [*by, t]
    cuts, tasks = _cuts_and_tasks(rows, features, s.max_bins)
    bins = [_bin(F.col(f), cut) for f, cut in zip(features, cuts, strict=True)]
    counts = [len(cut) + 1 for cut in cuts]
    folds = math.prod(counts) <= FOLDED
    # one number stands for a combination of bins
    steps = [math.prod(counts[:i]) for i in range(len(counts))]
    code = sum((b * step for b, step in zip(bins, steps)), F.lit(0)) if folds else F.array(*bins)
    slim = rows.where(F.col(y).isNotNull()).select(
        *dict.fromkeys([*keys, row_key, *([weight] if weight else [])]), F.col(y).alias("_y"),
        code.alias("_b"))
    # rows are copied for every tree
    if tasks < (cores := rows.sparkSession.sparkContext.defaultParallelism):
        slim = save_table(slim.repartition(cores))
    hash_keys = [*by, row_key]
    bagged = (D.with_rate_weights(slim, weight, s.trees, hash_keys, s.seed, "forest", s.fast,
                                  "tree", "_w") if weight else
              D.with_poisson_weights(slim, s.trees, hash_keys, s.seed, "forest", s.fast,
                                     "tree", "_w"))
    model = [*keys, "tree"]
    bagged = bagged.select(*model, "_b", "_w", (F.col("_w") * F.col("_y")).alias("_s"))
    if folds:
        decoded = [(F.floor(F.col("_b") / step) % n).cast("int") for step, n in zip(steps, counts)]
        bagged = save_table(bagged.groupBy(*model, "_b").agg(
            F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))).withColumn("_b", F.array(*decoded))
    grown = None
    for level in range(s.depth):
        first, size = 2 ** level - 1, 2 ** level
        at = (bagged.withColumn("_node", F.lit(0)) if grown is None else
              join_null_safe(bagged, grown, model, "inner").withColumn(
                  "_node", _walk(F.col("nodes"), F.col("_b"), level, "bin"))
              .where(F.col("_node") >= first))
        found = _best_cuts(at, model, cuts, s)
        if grown is not None:
            # a node of the level before that got no rows here keeps its own value
            found = join_null_safe(grown, found, model, "left")
        entries = F.transform(F.sequence(F.lit(first), F.lit(first + size - 1)),
                              lambda i: F.try_element_at("_m", i))
        grown = save_table(found.select(*model, (
            entries if grown is None else F.concat("nodes", entries)).cast(_NODE).alias("nodes")))
    return _with_leaves(grown, model, s.depth) if s.depth else _stumps(bagged, model)


def _best_cuts(at: DataFrame, model: list[str], cuts, s: ForestSettings) -> DataFrame:
    """(model..., _m: node -> struct) from the rows' nodes and bins."""
    node = [*model, "_node"]
    sums = at.select(*node, "_w", "_s", F.posexplode("_b").alias("f", "bin")).groupBy(
        *node, "f", "bin").agg(F.sum("_w").cast("double").alias("n"), F.sum("_s").alias("s"))
    whole = Window.partitionBy(*node, "f")
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, total, low, low_n = (F.sum("n").over(whole), F.sum("s").over(whole), F.sum("s").over(run),
                            F.sum("n").over(run))
    split = sums.select(*node, "f", "bin", n.alias("n"), total.alias("s"), low.alias("sl"),
                        low_n.alias("nl"))
    high, high_n = F.col("s") - F.col("sl"), F.col("n") - F.col("nl")
    gain = F.when(high_n > 0, F.col("sl") * F.col("sl") / F.col("nl") + high * high / high_n
                  - F.col("s") * F.col("s") / F.col("n")).otherwise(F.lit(-1.0))
    split = split.withColumn("_gain", F.round(gain, 9))
    if s.features_per_node is not None:
        # a node tries the features whose hashes come first
        place = F.dense_rank().over(Window.partitionBy(*node).orderBy(
            F.xxhash64(*[F.col(c).cast("string") for c in node], F.col("f"), F.lit(s.seed)), "f"))
        split = split.withColumn("_p", place).where(F.col("_p") <= s.features_per_node)
    table = F.array(*[F.array(*[F.lit(float(c)) for c in cut]).cast("array<double>")
                      for cut in cuts])
    worth = F.col("_gain") > 0
    entry = F.struct(
        F.when(worth, F.col("f")).alias("f"), F.when(worth, F.col("bin")).alias("bin"),
        F.when(worth, F.get(F.get(table, F.col("f")), F.col("bin"))).alias("cut"),
        (F.col("s") / F.col("n")).alias("value"),
        F.when(worth, F.col("sl") / F.col("nl")).alias("low"),
        F.when(worth, high / high_n).alias("high"))
    best = split.groupBy(*node).agg(F.max_by(entry, F.struct(
        "_gain", -F.col("f"), -F.col("bin"))).alias("e"))
    return best.groupBy(*model).agg(F.map_from_entries(F.collect_list(
        F.struct("_node", "e"))).alias("_m"))


def _with_leaves(grown: DataFrame, model: list[str], depth: int) -> DataFrame:
    """Adds the last level, whose values the level before holds, and drops what growing needed."""
    last = F.transform(F.sequence(F.lit(2 ** depth - 1), F.lit(2 ** (depth + 1) - 2)), lambda i: (
        F.struct(F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("cut"),
                 F.when(i % 2 == 1, F.get("nodes", F.floor((i - 1) / 2).cast("int"))["low"])
                 .otherwise(F.get("nodes", F.floor((i - 1) / 2).cast("int"))["high"])
                 .alias("value"))))
    inner = F.transform("nodes", lambda x: F.struct(x["f"].alias("f"), x["cut"].alias("cut"),
                                                    x["value"].alias("value")))
    return grown.select(*model, F.concat(inner, last).alias("nodes"))


def _stumps(bagged: DataFrame, model: list[str]) -> DataFrame:
    mean = F.sum("_s") / F.sum("_w")
    return bagged.groupBy(*model).agg(F.array(F.struct(
        F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("cut"),
        mean.alias("value"))).alias("nodes"))


def forest_value(trees: Column, features: list[str], depth: int) -> Column:
    """Mean of the trees' values for a row; `trees` is an array of node arrays."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    leaves = F.transform(trees, lambda nodes: F.get(nodes, _walk(nodes, x, depth))["value"])
    return F.aggregate(leaves, F.lit(0.0), lambda a, x: a + x) / F.size(trees)


def forests_by_treatment(grown: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(by..., t, trees), trees in their order."""
    return grown.groupBy(*by, t).agg(F.array_sort(F.collect_list(F.struct("tree", "nodes")))
                                     .alias("_t")).select(
        *by, t, F.transform("_t", lambda x: x["nodes"]).alias("trees"))
