"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight, but at most `max_epochs` times its own size.
Sources above their cap are clamped to it and what they leave is shared among the others by
weight, until none is above.  Each round is one aggregate over the table of sources that gives
two sums; a round clamps at least one more source or is the last.

Documents are then repeated: as many whole times as the target holds its source's size, and once
more for those that come first in a seeded order, up to the words that are left.  The running sum
that finds the last of these is made in two steps, so that one source may hold most rows: sums
over the leading digits of the seeded key (at most 65,536 a source) find the digits where the
target falls, and only documents with these digits are put in order.

DataFrame functions only.  Rows move thin (id, source, size, key); sums are saved before they are
joined with their rows, so that Spark can broadcast them or split a frequent source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions import ranks
from honestpick.functions.lineage import save_table

_WORD = "[^\\x20\\x09-\\x0D]+"
_DIGITS = 4


def n_words(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def with_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Adds `weight`: the weights in turn, by code points of the name, the null source last."""
    named = sources.where("source IS NOT NULL")
    places = ranks.with_position(named, [], ["source"],
                                 ranks.prefix_bucket(named, [], "source"), "_pos", None)
    last = sources.where("source IS NULL").withColumn("_pos", F.lit(named.count()).cast("bigint"))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    return places.unionByName(last).withColumn(
        "weight", F.element_at(turn, (F.col("_pos") % len(weights) + 1).cast("int"))).drop("_pos")


def fill(sources: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """Adds `target` to (source, source_size, weight): sources share `percent` of all sizes by
    weight, none above `max_epochs` times its size.

    A source without words gets 0.  If all are clamped, all have their cap.
    """
    wide = "decimal(38,0)"
    cap = F.col("source_size") * max_epochs
    total, free = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                              F.coalesce(F.sum("weight"), F.lit(0))).first()
    n, taken = 0, 0
    while True:
        left = F.lit(percent * total - 100 * taken).cast(wide)
        above = (left * F.col("weight") > cap.cast(wide) * (100 * free)) if free else F.lit(True)
        r = sources.where(above).agg(F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if r[0] == n:
            break
        n, taken = r[0], int(r[1])
        free = sources.where(~above).agg(F.sum("weight")).first()[0] or 0
    level = (left.cast("double") * F.col("weight") / F.lit(100 * free)
             if free else cap.cast("double"))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(level))


def _before(value: str, by: list, order: str) -> Column:
    """Sum of the rows that come before in the group."""
    rows = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150,
        max_epochs: int = 2, seed: int = 0, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, extra, taken.

    `copies` is how often the mix holds the whole document, `extra` how many of its first words it
    holds once more, taken = copies * size + extra words; a source's `taken` add up to its target
    rounded to whole words (less one word at most for each of equal rows that the cut falls on).
    The order within a source is that of md5(seed:doc_id), so reruns and any partitioning agree.

    A null text has size 0 and is taken with 0 words; a null id is a key like any other; rows of
    equal id and size are treated alike; the null source is a source of its own.  An empty table
    gives no rows; other columns are not read.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    thin = save_table(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        n_words(F.col(f"`{text}`").cast("string")).alias("size"), F.md5(name).alias("key")))
    digits = F.substring("key", 1, _DIGITS)
    parts = save_table(thin.groupBy("source", digits.alias("digits"))
                       .agg(F.sum("size").alias("part")))
    sources = save_table(parts.groupBy("source").agg(F.sum("part").alias("source_size")))
    targets = save_table(fill(save_table(with_weights(sources, weights)), percent, max_epochs))
    goal = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    goals = save_table(targets.select("source", "source_size", "target",
                                      whole.cast("int").alias("copies")).withColumn(
        "rest", goal - F.col("copies") * F.col("source_size")))

    # the digits in which the rest ends, and the words before them: running sums over the first
    # two digits, then within them, so that no window holds more than 256 rows of a source
    first = F.substring("digits", 1, 2)
    heads = parts.groupBy("source", first.alias("_d")).agg(F.sum("part").alias("_p"))
    heads = save_table(heads.select(F.col("source").alias("_h"), "_d", _before(
        "_p", ["source"], "_d").alias("_ahead")))
    ends = parts.withColumn("_within", _before("part", ["source", first], "digits")).join(
        heads, F.col("source").eqNullSafe(F.col("_h")) & (first == F.col("_d"))).select(
        F.col("source").alias("_s"), "digits", "part",
        (F.col("_ahead") + F.col("_within")).alias("before"))
    cut = ends.join(goals.select(F.col("source").alias("_g"), "rest"),
                    F.col("_s").eqNullSafe(F.col("_g"))).where(
        "before < rest AND rest <= before + part").select("_s", "digits", "before")
    plan = save_table(goals.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_p"), "source_size", "target", "copies", "rest",
        F.col("digits").alias("cut"), "before"))

    rows = thin.join(plan, F.col("source").eqNullSafe(F.col("_p")))
    # documents with these digits in order; equal ones count as one
    at_cut = (rows.where(digits == F.col("cut")).groupBy("source", "key", "size").agg(
        F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"),
        F.first("before").alias("before")))
    order = Window.partitionBy("source").orderBy("key", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    left = (F.col("rest") - F.col("before")
            - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    last = save_table(at_cut.select(
        F.col("source").alias("_l"), F.col("key").alias("_k"), F.col("size").alias("_n"),
        F.greatest(F.lit(0), F.least("size", F.floor(left / F.col("n")))).alias("_extra")))
    # no cut: nothing is left, or the rest is empty
    extra = (F.when(digits < F.col("cut"), F.col("size"))
             .when(digits == F.col("cut"), F.col("_extra")).otherwise(0)).cast("bigint")
    return rows.join(last, F.col("source").eqNullSafe(F.col("_l")) & (F.col("key") == F.col("_k"))
                     & (F.col("size") == F.col("_n")), "left").select(
        "doc_id", "source", "size", "source_size", "target", "copies", extra.alias("extra"),
        (F.col("copies") * F.col("size") + extra).alias("taken"))
