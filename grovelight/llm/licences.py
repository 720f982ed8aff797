"""License scans: recognise known licence sentences, then match their order against licence rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

# Normalised sentences of public licence texts and the identifier of each.
SENTENCES = [
    ("apache-ref", "licensed under the apache license version 2 0"),
    ("apache-ref", "licensed under the apache license version 2 0 the license"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-ref", "released under the mit license"),
    ("mit-ref", "licensed under the mit license"),
    ("mit-ref", "this software is released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl3-ref", "this work is licensed under the gnu general public license version 3 0"),
    ("gpl3-ref", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-ref", "licensed under the gnu general public license version 3"),
    ("gpl-free3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-free2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-nc-ref", "licensed under cc by nc 4 0"),
    ("cc-by-sa-ref", "licensed under cc by sa 4 0"),
    ("cc-by-ref", "licensed under cc by 4 0"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

# Licences and the ordered sentence identifiers that make each; an earlier rule wins where two end together.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-copy", "apache-asis"]),
    ("GPL-3.0-or-later", ["gpl-free3", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-free2", "gpl-hope"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Apache-2.0", ["apache-ref"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
]

# Every known sentence holds one of these letters in a row; texts without any of them hold no sentence.
CUES = ["licens", "permission", "redistribut", "software", "warrant", "copyright"]

# A piece ends at a line end, or at . ! ? ; : followed by white space or the end. A known sentence is one piece or several in a row.
SENTENCE_END = "(?<![.!?;:])[.!?;:]++(?=[\\x20\\x09-\\x0D]|$)|[\\x0A-\\x0D]+"
NOT_LETTER = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
HAS_LETTER = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def normalised(text: Column) -> Column:
    """The pieces of a text between line feeds. Lower-case A-Z; runs of anything but ASCII letters, digits and non-ASCII characters become one space.

    None stands at either end of a piece, so comment marks and quotes go, and with them the pieces that hold nothing else.
    """
    ended = F.concat(F.lit("\n"), F.regexp_replace(text, SENTENCE_END, "\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(lower_ascii(ended), NOT_LETTER, " "), " ?\n[ \n]*", "\n")


def any_of(sentences: Sequence[tuple[str, str]]) -> str:
    """A pattern for known sentences in ``normalised`` texts, the longest first: from the start of a piece to the end of that or a later one."""
    texts = sorted((text for _, text in sentences), key=lambda t: (-len(t), t))
    words = ("[ \n]".join(re.escape(w) for w in t.split(" ")) for t in texts)
    return f"(?<=\n)(?:{'|'.join(words)})(?=\n)"


def scan(
    docs: DataFrame,
    sentences: Sequence[tuple[str, str]] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    cues: Sequence[str] = CUES,
) -> DataFrame:
    """Per document: doc_id, n_sentences, known (sentence identifiers in order), licences (in order of first match), leftover.

    Texts are split into pieces at line ends and closing punctuation, and ``n_sentences`` counts those with a letter. A
    known sentence is found where it is one piece or several in a row, so it may be wrapped over lines, with or without
    comment marks, and may hold ; : or . itself; of those that start together the longest counts. The identifiers found,
    in text order, are matched against the rules: a rule matches where its identifiers stand in a row. Rules apply in
    their order and use up what they match, so a reference inside a full licence text is not reported again. ``leftover``
    holds the identifiers that no rule used. ``sentences`` and ``rules`` are configuration and travel inside the plan.

    Texts are looked at in rows; nothing is shuffled. Null or empty texts have no sentence; repeated rows each get
    their result; empty tables and further columns are fine. Very long texts stay one row.
    """
    known = F.create_map(*[F.lit(x) for name, text in sentences for x in (text, name)])
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.regexp_extract_all(normalised(text), F.lit(any_of(sentences)), F.lit(0))
    named = F.when(text.rlike("(?i)" + "|".join(cues)), F.transform(hits, lambda s: known[F.translate(s, "\n", " ")])).otherwise(
        F.array().cast("array<string>")
    )
    n_sentences = F.size(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(HAS_LETTER))).cast("long")
    found = docs.select("doc_id", n_sentences.alias("n_sentences"), F.explode(F.array(named)).alias("known"))
    sequence = F.concat(F.lit(" "), F.array_join(F.transform("known", lambda k: F.concat(k, F.lit(" "))), " "))
    used = found.withColumn("rest", F.explode(F.array(sequence))).withColumn("matched", F.array().cast("array<struct<at:int,licence:string>>"))
    for licence, ids in rules:
        text = "".join(f" {i} " for i in ids)
        gone = "".join(f" {'#' * len(i)} " for i in ids)
        hit = F.instr(F.col("rest"), text)
        used = used.withColumn(
            "matched",
            F.when(hit > 0, F.concat("matched", F.array(F.struct(hit.alias("at"), F.lit(licence).alias("licence"))))).otherwise(F.col("matched")),
        ).withColumn("rest", F.replace(F.col("rest"), F.lit(text), F.lit(gone)))
    return used.select(
        "doc_id",
        "n_sentences",
        "known",
        F.array_distinct(F.transform(F.array_sort("matched"), lambda m: m["licence"])).alias("licences"),
        F.filter(F.split(F.trim("rest"), " +"), lambda t: (t != "") & ~t.startswith("#")).alias("leftover"),
    )

