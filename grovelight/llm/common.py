"""Column expressions and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package
from ..sources.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> Scratch:
    """A fresh folder for one run's written tables, with the package sent to the executors."""
    ship_package(spark)
    return Scratch(spark)


def free_name(name: str, df: DataFrame, other: str) -> str:
    """``name``, or ``other`` where ``df`` has a column of that name, with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name, other = other, f"{other}_"
    return name


def apart(
    docs: DataFrame, needed: Sequence[str], work: Callable[[DataFrame], DataFrame], added: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """``work(docs)``, where columns that the work does not need bear neutral names, so that none clashes with a name used inside.

    The result has the columns of ``docs`` in their order, and the ``added`` ones under their second name.
    """
    neutral = {c: c if c in needed else f"carried__{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = work(docs.select(*[quoted(c).alias(n) for c, n in neutral.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in neutral.items()], *[F.col(inner).alias(outer) for inner, outer in added])


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*columns: str) -> Column:
    """A digest that tells rows of one id apart by their contents."""
    return F.xxhash64(*columns)


def salted(side: DataFrame, salts: int, name: str = "salt") -> DataFrame:
    """Every row of the smaller side once per salt, so that a hot key of the other side meets it in ``salts`` places."""
    return side.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(salts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, from its files; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def counted_bytes(df: DataFrame) -> int:
    """The bytes of all texts and arrays of a table, and 8 for each other value, from one aggregate."""
    sizes = []
    for name, kind in df.dtypes:
        c = F.col("`" + name.replace("`", "``") + "`")
        size = F.octet_length(c) if kind in ("string", "binary") else 8 * F.greatest(F.size(c), F.lit(0)) if kind.startswith("array") else F.lit(8)
        sizes.append(F.coalesce(size.cast("long"), F.lit(0)))
    return int(df.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0)


def part_count(df: DataFrame, bytes_each: float, least: int = 16) -> int:
    """How many parts a table is dealt into so that the work of one part stays bounded at every size.

    Where a table comes from no files Spark takes it for endless (over a PiB); then its bytes are counted.
    """
    estimate = estimated_bytes(df)
    return max(least, math.ceil((estimate if estimate < 2**50 else counted_bytes(df)) / bytes_each))
