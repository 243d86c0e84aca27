"""Quality rules: base measures of a text, and lines that too many documents of a host share.

Lines are normalised and hashed; a line above the limits of its host is taken out, and a
document that loses most of its words is rejected.  Copies of a text count as one document, so
a text is not rejected for having been copied.  DataFrame and SQL functions only.

Two thin shuffles count (host, line, text) triples; counts are combined before the second.  What
is joined to the documents is one short array per host: a host has at most (mean lines of a
document / max_share) lines above its limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from honestpick.functions.lineage import save_table
from honestpick.llm.text import SPACES, free_name, lower_ascii

_POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where a lambda of the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(inner) > 0, F.split(inner, SPACES)).otherwise(
        F.array().cast("array<string>"))


def has_word(text: Column) -> Column:
    return text.rlike("[^\\x20\\x09-\\x0D]")


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more, the first occurrence included.

    Windows are sorted by 40 bits of hash and their position; only those whose hash has a
    neighbour are compared as words, so hashes save work and decide nothing.
    """
    low = (1 << _POSITION_BITS) - 1

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def has_twin(sorted_, of):
        def test(x, k):
            same = [F.coalesce(of(F.get(sorted_, k + d)) == of(x), F.lit(False))
                    for d in (F.lit(-1), F.lit(1))]
            return same[0] | same[1]
        return test

    at = F.sequence(F.lit(0), F.size(w) - 3)
    key = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
                      .bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint")))
    likely = let(F.sort_array(key), lambda s: F.transform(
        F.filter(s, has_twin(s, lambda x: F.shiftright(x, _POSITION_BITS))),
        lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    likely = F.when(F.size(w) > low, at).otherwise(likely)      # positions need more bits
    exact = let(F.sort_array(F.transform(likely, lambda i: F.struct(window(i).alias("t"),
                                                                     i.alias("i")))),
                lambda s: F.sort_array(F.transform(F.filter(s, has_twin(s, lambda x: x["t"])),
                                                   lambda x: x["i"])))
    covered = let(exact, lambda p: F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i,
                                                                F.lit(3)))),
        F.lit(0), lambda a, b: a + b))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(covered).cast("bigint")


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; zeros for null."""
    text = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("rep")))
    dup = let(F.filter(F.split(text, "\n"), has_word),
              lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"))
    return {"words": of_words,
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": dup}


def line_hash(line: Column) -> Column:
    """64 bits of the line with outer space cut, inner space single, A-Z lower, digits as 0.

    Only the few lines above a limit are looked up by hash, so a chance equality is not to be
    expected at any size.
    """
    line = F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\f\r")), SPACES, " ")
    return F.xxhash64(F.translate(lower_ascii(line), "123456789", "000000000"))


def common_lines(docs: DataFrame, host: str = "source", text: str = "text",
                 min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    """host, lines (hashes): lines in more than `min_docs` distinct texts of the host and in
    more than `max_share` of them.  A null host is a host of its own."""
    rows = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("t"))
    rows = rows.where(has_word(F.col("t"))).select(
        "host", F.xxhash64("t").alias("doc"),
        F.array_distinct(F.transform(F.filter(F.split("t", "\n"), has_word), line_hash))
        .alias("lines"))
    # line 0 of every document stands for the document itself
    each = rows.select("host", "doc", F.explode(F.concat(F.array(F.struct(
        F.lit(True).alias("whole"), F.lit(0).cast("bigint").alias("line"))),
        F.transform("lines", lambda h: F.struct(F.lit(False).alias("whole"),
                                                h.alias("line"))))).alias("x"))
    counts = (each.select("host", "doc", "x.whole", "x.line").distinct()
              .groupBy("host", "whole", "line").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("whole") | (F.col("n") > min_docs)))
    counts = save_table(counts)
    sizes = counts.where("whole").select(F.col("host").alias("h"), F.col("n").alias("docs"))
    many = counts.where("NOT whole")
    return (many.join(sizes, F.col("host").eqNullSafe(F.col("h")))
            .where(F.col("n") > max_share * F.col("docs"))
            .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def judge(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = 20,
          max_share: float = 0.05, min_left: float = 0.5, min_words: int = 50,
          max_repeat: float = 0.5, out: str = "quality") -> DataFrame:
    """All columns of `docs` and one more, a struct named `out` (with underscores before it
    where `docs` has such a column) of

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: of the text as it is;
    base_failed: under `min_words` words, or repeated words above `max_repeat` of them;
    n_words_cut, clean: words in common lines, and the text without those lines;
    kept: false if base_failed or under `min_left` of the words are left.

    A null or blank text has zeros and fails; its clean text is the same.  Repeated rows are
    judged each, an empty table gives no rows.
    """
    lines = save_table(common_lines(docs, host, text, min_docs, max_share)).select(
        F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    own = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(own))])      # whatever the columns' names
    body = F.col(f"c{own.index(text)}")
    marked = named.join(lines, F.col(f"c{own.index(host)}").eqNullSafe(F.col("_host")), "left")
    m = base_measures(body)
    is_common = lambda x: F.coalesce(                       # noqa: E731
        F.array_contains(F.col("_lines"), line_hash(x)), F.lit(False))
    split = F.split(body, "\n")
    cut = F.when(F.col("_lines").isNull() | body.isNull(), F.lit(0)).otherwise(F.aggregate(
        F.filter(split, lambda x: has_word(x) & is_common(x)), F.lit(0),
        lambda a, x: a + F.size(words(x)))).cast("bigint")
    clean = F.when(F.col("_lines").isNull(), body).otherwise(F.array_join(
        F.filter(split, lambda x: ~(has_word(x) & is_common(x))), "\n"))
    n, rep = F.col("_m.words.n"), F.col("_m.words.rep")
    failed = (n < min_words) | (rep > max_repeat * n)
    measured = marked.withColumn("_m", F.struct(*[c.alias(k) for k, c in m.items()],
                                                cut.alias("cut"), clean.alias("clean")))
    return measured.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], F.struct(
        n.alias("n_words"), "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines",
        rep.alias("n_repeat_words"), failed.alias("base_failed"),
        F.col("_m.cut").alias("n_words_cut"), F.col("_m.clean").alias("clean"),
        (~failed & (n - F.col("_m.cut") >= min_left * n)).alias("kept")).alias(free_name(docs, out)))
