"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import NOT_SPACE, apart, free_name, salt_of, salted, scratch

SALTS = 32
ROWS_PER_RANGE = 50_000
KEY = ("doc_id", "source", "copy", "size")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(source, n, source_size, target): the words that the mix takes from each source.

    ``sizes`` has one row per source. Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``ceiling`` times its source's size and the excess is shared again
    by weight. The final level solves sum(min(ceiling * size, level * weight)) = budget: sorted by the level at
    which each source fills up, the filled ones are a prefix, found from running totals.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    fills = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(everything) - 1) % len(weights)) + 1))
    levels = (
        ranked.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(fills), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.col("level") < F.col("full_at"))
    )
    # the first open source in filling order has the largest level among the open ones
    return levels.withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(whole)).select(
        "source",
        "n",
        "source_size",
        F.when(F.col("final").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("final") * F.col("weight")))
        .alias("target"),
    )


def uniform(*columns: str) -> Column:
    """A number strictly between 0 and 1 that depends on the columns' values alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2,
    odds: str | None = None,
) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, copy, size, source_size, target, copies, taken).

    A document of a source with target t and size s is expected t / s times: the whole part is certain, the rest
    is its inclusion probability p in a sample of fixed size in words. Documents are ranked by
    (u / (1 - u)) / (p / (1 - p)), u being a hash of the document, and taken in that order while they fit. Then the documents that fit
    into what is left are taken in the same order, again and again until none fits, and one more document, the best fit, ends it. ``odds`` names a positive column that multiplies the documents'
    inclusion odds and makes them unequal within a source; they are always unequal between sources.

    ``docs`` has doc_id, source, text. Null text has size 0 and is taken 0 words; a null source is a source; repeated rows
    are told apart by ``copy``; an empty table gives no rows; further columns are ignored.
    """
    place = scratch(docs.sparkSession)
    same = W.partitionBy("doc_id", "source", "size").orderBy("odds")
    rows = place.cut(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), (F.col(odds) if odds else F.lit(1.0)).alias("odds")
        )
        .withColumn("copy", F.row_number().over(same))
        .withColumn("salt", salt_of(SALTS, "doc_id", "copy")),
        "sizes",
    )
    sources = (
        rows.groupBy("source", "salt")
        .agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
        .groupBy("source")
        .agg(F.sum("n").alias("n"), F.sum("source_size").alias("source_size"))
    )
    plan = (
        source_targets(sources, weights, share, ceiling)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("certain", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("certain"))
        .withColumn("need", F.col("target") - F.col("certain") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n") / ROWS_PER_RANGE))
    )
    plan = place.cut(plan, "plan")
    ranked = (
        _by_source(rows, plan)
        .withColumn("u", uniform("doc_id", "source", "size", "copy"))
        .withColumn("drawn", F.col("u") / (1 - F.col("u")))
        .withColumn("rank", F.when(F.col("p") > 0, F.col("drawn") / (F.col("odds") * F.col("p") / (1 - F.col("p")))))
        # equal odds give evenly filled ranges, since then drawn / (1 + drawn) is u again
        .withColumn("even", F.col("drawn") / F.col("odds"))
        .withColumn("range", F.floor(F.col("ranges") * (F.col("even") / (1 + F.col("even")))))
    )
    base = place.cut(
        ranked.select(
            "doc_id", "source", "copy", "size", "salt", "source_size", "target", "certain", "rank", "range",
            ((F.col("p") > 0) & (F.col("size") > 0)).alias("open"),
        ),
        "ranked",
    )
    gaps = plan.select("source", F.col("need").alias("gap"))
    left = base.where("open").select(*KEY, "salt", "rank", "range")
    while True:  # what does not fit now never will: gaps only shrink
        fitting = _by_source(left, gaps).where(F.col("size") <= F.col("gap"))
        tried = place.cut(_running(fitting).withColumn("drawn", F.col("reached") <= F.col("gap")).drop("reached", "gap"), "tried", keep=2)
        new = place.cut(tried.where("drawn").select(*KEY), "drawn")
        if new.isEmpty():
            break
        used = new.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"))
        gaps = gaps.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left")
        gaps = place.cut(gaps.select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "gaps", keep=2)
        left = tried.where("not drawn").drop("drawn")
    drawn = place.all_of("drawn").select(*[F.col(c).alias(f"d_{c}") for c in KEY], F.lit(True).alias("drawn"))
    on = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in KEY]
    filled = base.join(drawn, on, "left").drop(*[f"d_{c}" for c in KEY]).withColumn("drawn", F.coalesce("drawn", F.lit(False)))
    gapped = _by_source(filled, gaps)
    fit = (
        gapped.where(F.col("open") & ~F.col("drawn") & (F.abs(F.col("gap") - F.col("size")) < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "doc_id", "copy", "size")).alias("fit"))
        .select("source", F.col("fit.doc_id").alias("fit_id"), F.col("fit.copy").alias("fit_copy"), F.col("fit.size").alias("fit_size"))
    )
    chosen = F.coalesce(
        F.col("doc_id").eqNullSafe(F.col("fit_id")) & (F.col("copy") == F.col("fit_copy")) & (F.col("size") == F.col("fit_size")),
        F.lit(False),
    )
    copies = F.col("certain").cast("int") + (F.col("drawn") | chosen).cast("int")
    return (
        _by_source(filled, place.cut(fit, "fit"), "left")
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
        .select(
            "doc_id", "source", "copy", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def _running(rows: DataFrame) -> DataFrame:
    """``reached``: the words up to and with each row in its source's rank order; ranges of ranks keep a hot source in many tasks."""
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "range").agg(F.sum("size").alias("held")).select(
        F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("source", "range").orderBy("rank", "doc_id", "copy").rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumn("inside", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range"))
    )
    return met.withColumn("reached", F.col("inside") + F.col("offset")).drop("inside", "offset", "o_source", "o_range")


def _by_source(rows: DataFrame, by: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per source to the documents; the salt spreads a hot source."""
    right = salted(by.withColumnRenamed("source", "s_source"), SALTS, "s_salt")
    on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("salt") == F.col("s_salt"))
    return rows.join(right, on, how).drop("s_source", "s_salt")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies``, how often each is taken.

    Where ``docs`` has a column ``copies`` itself, the new one is ``copies_taken``. Which of several rows with one id, source and size is which
    copy does not matter to the mix; they are numbered by text. Null texts and empty ones are never taken; an empty table stays empty.
    """
    out = free_name("copies", docs, "copies_taken")
    odds = [settings["odds"]] if settings.get("odds") else []
    return apart(docs, ["doc_id", "text", "source", *odds], lambda d: _mixed(d, settings), added=(("copies", out),))


def _mixed(docs: DataFrame, settings: dict) -> DataFrame:
    taken = mix(docs, **settings).where("copies > 0")
    t = taken.select(*[F.col(c).alias(f"t_{c}") for c in KEY], "copies")
    same = W.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    rows = docs.withColumn("_size", word_count(F.col("text"))).withColumn("_copy", F.row_number().over(same))
    on = (
        F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        & F.col("source").eqNullSafe(F.col("t_source"))
        & (F.col("_size") == F.col("t_size"))
        & (F.col("_copy") == F.col("t_copy"))
    )
    return rows.join(t, on).select(*docs.columns, "copies")
