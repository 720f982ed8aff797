"""Stages of the pipeline over awkward columns, and a mix with one very long document a source."""

import pytest
import rows
from pyspark.sql import functions as F

from grovelight.llm import decontam, jaccard, language_id, mixing, substrings

CLASHES = ["copies", "_words", "_id", "_lo", "_hi", "_margin", "_turn", "_h_id", "t_doc_id", "_size", "_copy", "_version", "a.b", "we`ird"]


def clashing(spark):
    """Documents with columns named like those that the operators use inside."""
    base = rows.frame(spark, rows.documents()).select("doc_id", "text", "lang", "source", "n_chars")
    return base.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


STAGES = {
    "language": lambda d: language_id.in_known_language(d),
    "near": lambda d: jaccard.one_of_each(d),
    "repeats": lambda d: substrings.with_kept_text(d),
    "benchmark": lambda d: decontam.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "one two three")], "item_id long, text string")),
    "mix": lambda d: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", list(STAGES))
def test_columns_of_any_name_are_carried(spark, name):
    docs, work = clashing(spark), STAGES[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = work(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == (["copies_taken"] if name == "mix" else [])
    found = out.collect()
    assert all([r[f"{c}"] for c in CLASHES] == list(range(len(CLASHES))) for r in found)
    assert sorted((r["doc_id"], r["text"]) for r in found if r["doc_id"] is not None) == sorted(
        (r["doc_id"], r["text"]) for r in work(plain).where("doc_id is not null").collect()
    )
    assert work(docs.where("false")).count() == 0


def test_a_long_document_blocks_no_source(spark):
    """Twenty sources of a thousand short documents and one long one: all come within a short document of their targets."""
    short, long = " ".join(["w"] * 100), " ".join(["w"] * 100_000)
    docs = spark.range(20 * 1001).select(
        F.col("id").alias("doc_id"), F.format_string("s%02d", F.col("id") % 20).alias("source"),
        F.when(F.col("id") < 20, F.lit(long)).otherwise(F.lit(short)).alias("text"),
    )
    got = mixing.mix(docs, weights=(1,), share=0.4).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 20 and all(abs(r["taken"] - r["target"]) <= 100 for r in got)
