"""Language ID: the language whose zstandard dictionary compresses a text best."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import ship_package
from .common import apart

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
SHORT = 256
_CODERS: dict[bytes, list] = {}


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def letters(text: str) -> str:
    """Lower-cased letters; everything between two runs of them is one space. Case and punctuation say little about a language."""
    return _OTHER.sub(" ", text.lower())


def learn(labelled: DataFrame, pieces: int = 128, piece_chars: int = 768) -> dict[str, bytes]:
    """A raw-content dictionary per language: ``pieces`` slices of ``piece_chars`` characters of labelled texts.

    The sample is bounded by these parameters and by the number of languages; texts and where they are cut are chosen by
    a hash of the text alone, so that every text may take part and reruns agree. Texts without a letter teach nothing.
    """
    digest = F.xxhash64("text")
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
    rows = rows.select("lang", "text", digest.alias("digest"), (F.pmod(digest, F.lit(1 << 30)) / float(1 << 30)).alias("share"))
    # copies share one hash and teach once, so different texts count
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("digest").alias("n")).collect()}
    if not sizes:
        return {}
    # a first cut by the hash keeps a few times the wanted texts of each language, then the smallest hashes win
    odds = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, 4.0 * pieces / n)])
    start = F.floor(F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - piece_chars, F.lit(1)))).cast("int") + 1
    drawn = (
        rows.where(F.col("share") < odds[F.col("lang")])
        .select("lang", "share", F.substring("text", start, F.lit(piece_chars)).alias("piece"))
        .distinct()
        .withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy("share", "piece")))
        .where(F.col("turn") <= pieces)
        .orderBy("lang", "turn")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in drawn:
        found.setdefault(row["lang"], []).append(letters(row["piece"]))
    return {lang: " ".join(texts).encode() for lang, texts in sorted(found.items())}


def _coders(dictionaries: dict[str, bytes], level: int) -> list:
    """One compressor per language, made once per worker."""
    import zstandard

    key = b"\0".join(dictionaries.values())
    if key not in _CODERS:
        made = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        _CODERS.clear()
        _CODERS[key] = made
    return _CODERS[key]


def sizes_of(text: str, coders: list, block: int) -> list[int]:
    """Compressed bytes of the whole text under each dictionary, block by block, so that a long text can't teach itself.

    A text of under ``SHORT`` bytes is repeated: alone it would be stored raw, whatever the dictionary holds.
    """
    data = letters(text).encode()
    if len(data) < SHORT:
        data = (data + b" ") * 8
    parts = [data[i : i + block] for i in range(0, len(data), block)]
    return [sum(len(c.compress(p)) for p in parts) for c in coders]


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, block: int = 16384, level: int = 8, certainty: float = 0.25
) -> DataFrame:
    """Per document: doc_id, lang_pred, score, margin, rejected.

    The language with the smallest compressed size wins, ties to the smaller code. ``margin`` of a row is how much smaller it
    is than the second smallest, as a share of that; below ``margin`` the row is rejected, though its best language is still
    named. ``score`` is the winner's share of 2 ** (-certainty * bits) over all languages: 1 over their number where
    all sizes agree, near 1 where one stands out.

    Null texts and texts without a letter are ``und``, with score 0, and rejected; so is everything if no language was learned; with one
    language nothing is narrow. Texts are compressed whole. Repeated rows are judged alike; empty tables and further columns are fine.
    """
    found = _judged(docs.select("doc_id", "text"), dictionaries, margin, block, level, certainty)
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("lang_pred", "score", "margin", "rejected")])


def _judged(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, block: int = 16384, level: int = 8, certainty: float = 0.25) -> DataFrame:
    """``docs`` with _lang_pred, _score, _margin and _rejected; rows stay where they are."""
    ship_package(docs.sparkSession)
    langs = sorted(dictionaries)
    contents = {lang: dictionaries[lang] for lang in langs}
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_margin", T.DoubleType())]
    )
    columns, names = docs.columns, schema.names

    def run(batches):
        coders = _coders(contents, level) if contents else []
        for batch in batches:
            pred, score, gap = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                if not coders or text is None or not _LETTER.search(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    gap.append(0.0)
                    continue
                sizes = sizes_of(text, coders, block)
                ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
                best, second = sizes[ranked[0]], sizes[ranked[1]] if len(ranked) > 1 else None
                pred.append(langs[ranked[0]])
                score.append(1.0 / sum(2.0 ** max(-900.0, certainty * 8 * (best - s)) for s in sizes))
                gap.append(1.0 if second is None else (second - best) / second)
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + added, names)

    rejected = (F.col("_lang_pred") == UNKNOWN) | (F.col("_margin") < margin)
    return docs.mapInArrow(run, schema).withColumn("_rejected", rejected)


def identify_held_out(docs: DataFrame, folds: int = 3, fold: int = 1, **settings) -> DataFrame:
    """Learn from the labelled rows outside the fold and judge all rows; adds ``held_out``."""
    dictionaries = learn(docs.where(~held_out(F.col("doc_id"), folds, fold)))
    return identify(docs, dictionaries, **settings).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))


def in_known_language(docs: DataFrame, folds: int = 3, fold: int = 1, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, learned as ``identify_held_out`` learns.

    Null texts and texts without a letter go; repeated rows are judged alike; other columns are kept, whatever they are called; an
    empty table stays empty.
    """
    dictionaries = learn(docs.where(~held_out(F.col("doc_id"), folds, fold)))
    return apart(docs, ["doc_id", "text"], lambda d: _judged(d, dictionaries, **settings).where(~F.col("_rejected")))
