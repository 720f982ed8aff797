"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, lower_ascii, row_key, scratch

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_ROWS = 200_000


def bench_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), NOT_WORD), "")


def _shingles(words: Column, k: int) -> Column:
    """Digests of every k consecutive words; none where the text is shorter."""
    ends = F.size(words) - k
    made = F.transform(
        F.sequence(F.lit(0), F.greatest(ends, F.lit(0))),
        lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]),
    )
    return F.when(ends >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _kept_in_row(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, however often later expressions read it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _small(side: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast only where the counted rows are few; otherwise both sides are shuffled on the key."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of ``size`` consecutive item words, each with the ids of its items; a shorter item is one window."""
    items = _kept_in_row(benchmark.select("item_id", "text"), "words", bench_words(F.col("text"))).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        items.select("item_id", "words", F.explode(starts).alias("at"))
        .select("item_id", F.slice("words", F.col("at"), F.lit(size)).alias("window"))
        .groupBy("window")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = 13, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, text, n_words, n_hit, items (ids of the items whose windows occur in it).

    A window is a set of positioned shingles. Containment asks for all of them, so its necessary prefix, in order
    of rarity over all documents, is the single rarest shingle. Documents are joined on that shingle; its offset
    fixes where the window would start (positional bound), the start and the end must lie within the document
    (length bound), and the words there are compared one by one.

    Null or wordless texts have no words and no hits; null or wordless items have no windows; an item without an id
    marks words but is not listed; repeated rows and repeated items change nothing; empty tables and further
    columns are fine. Hot shingles stay rows of (document, position), at most one per document word and shingle length.
    """
    found = _hit(docs.select("doc_id", "text"), benchmark, size, shingle)
    return found.select("doc_id", "text", *[F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "items")])


def _hit(docs: DataFrame, benchmark: DataFrame, size: int = 13, shingle: int = 3) -> DataFrame:
    """``docs`` with _n_words, _n_hit and _items."""
    place = scratch(docs.sparkSession)
    bench = place.cut(windows(benchmark, size), "windows")
    parts = (
        bench.withColumn("k", F.least(F.size("window"), F.lit(shingle)))
        .withColumn(
            "token",
            F.coalesce(*[F.when(F.col("k") == k, _shingles(F.col("window"), k)) for k in range(1, shingle + 1)]),
        )
        .select("window", "items", "k", F.posexplode("token").alias("offset", "token"))
    )
    parts = place.cut(parts, "parts")
    lengths = [r.k for r in parts.select("k").distinct().collect()]  # at most ``shingle`` values
    n_parts = parts.count()
    texts = docs.select("doc_id", "text").withColumn("version", row_key("text"))
    worded = _kept_in_row(texts, "words", bench_words(F.col("text"))).drop("text")
    asked = _small(parts.select("token").distinct(), n_parts)
    seen = None
    for k in lengths:
        one = worded.select("doc_id", "version", F.posexplode(_shingles(F.col("words"), k)).alias("pos", "token"))
        seen = one if seen is None else seen.unionByName(one)
    if seen is None:
        nothing = F.lit(None).cast("array<struct<start:int,window:array<string>,items:array<string>>>")
        found = texts.where("false").select("doc_id", "version", nothing.alias("found"))
    else:
        hits = place.cut(seen.join(asked, "token", "left_semi"), "hits")
        rarity = hits.groupBy("token").agg(F.count("*").alias("df"))
        prefix = (
            parts.join(rarity, "token", "left")
            .groupBy("window", "items")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "token")).alias("rarest"))
            .where("rarest.df > 0")
            .select(F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"), "window", "items")
        )
        found = (
            hits.join(_small(prefix, n_parts), "token")
            .where(F.col("pos") >= F.col("offset"))
            .groupBy("doc_id", "version")
            .agg(F.collect_set(F.struct((F.col("pos") - F.col("offset")).alias("start"), "window", "items")).alias("found"))
        )
    f = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("found").alias("_found"))
    joined = docs.join(f, F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key("text") == F.col("_version")), "left")
    checked = _kept_in_row(joined, "_words", bench_words(F.col("text")))
    right = F.filter(
        F.coalesce("_found", F.array()),
        lambda c: F.slice(F.col("_words"), c["start"] + 1, F.size(c["window"])) == c["window"],
    )
    checked = _kept_in_row(checked, "_sure", right)
    spots = F.transform("_sure", lambda c: F.sequence(c["start"], c["start"] + F.size(c["window"]) - 1))
    return checked.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.size(F.array_distinct(F.flatten(spots))).cast("long").alias("_n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.col("_sure.items")))).alias("_items"),
    )


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever those are called.

    Null and empty texts have no words and stay, repeated rows are judged alike, and empty tables on either side are fine.
    """
    clean = lambda d: _hit(d, benchmark, size).where(~is_contaminated("_n_hit", "_n_words"))
    return apart(docs, ["doc_id", "text"], clean)
