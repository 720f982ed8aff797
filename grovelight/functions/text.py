"""String columns: cleaning, category splitting, list replies, configuration names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The white-space characters of the text model, ASCII first, then the rest of Unicode.
ASCII_SPACE = r"\t-\r\x1c-\x1f "
UNICODE_SPACE = ASCII_SPACE + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Substrings of a configuration name and the short code each stands for.
TOPIC_CODES = [("Energy_Ecosystems", "EEH")]
TOPIC_DEFAULT = "OEF"
SHAPE_CODES = [("maxsub3_depth5", "3s_d5")]
SHAPE_DEFAULT = "5s_d3"
NOISE_CODES = [("noise0.5", "_n50"), ("noise0.25", "_n25")]
NOISE_DEFAULT = "_clean"


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{UNICODE_SPACE}]")


def ascii_clean(text: Column) -> Column:
    """Runs of non-ASCII and runs of white space each become one space; ends are trimmed."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7f]+", " ")
    return F.trim(F.regexp_replace(ascii_only, f"[{ASCII_SPACE}]+", " "))


def first_token(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"[^{ASCII_SPACE}]+", 0), F.lit(""))


def category_parts(categories: Column) -> tuple[Column, Column]:
    """The first listed category cut at its first dot; both null when it has no dot."""
    token = first_token(categories)
    dot = F.instr(token, ".")
    level_0 = F.when(dot > 0, F.substring_index(token, ".", 1))
    level_1 = F.when(dot > 0, F.substring(token, dot + 1, F.length(token)))
    return level_0, level_1


def remove_terms(text: Column, terms: Sequence[str]) -> Column:
    """Delete each term, with its first letter in either case."""
    quoted = lambda t: r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = "|".join(f"(?:{quoted(t[0].upper())}|{quoted(t[0].lower())}){quoted(t[1:]) if t[1:] else ''}" for t in terms)
    return F.regexp_replace(text, pattern, "")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{ASCII_SPACE}]+"), F.lit(0)))


def _json_list(text: Column) -> Column:
    return F.when(F.trim(text).startswith("["), F.from_json(F.trim(text), "array<string>"))


def _first_nonempty(*lists: Column) -> Column:
    chosen = F.lit(None).cast("array<string>")
    for candidate in reversed(lists):
        chosen = F.when(F.size(candidate) > 0, candidate).otherwise(chosen)
    return F.coalesce(chosen, F.array().cast("array<string>"))


def parse_topic_reply(reply: Column) -> Column:
    """A reply as a list: JSON, else the first bracket as JSON, else numbered, else starred lines."""
    whole = _json_list(reply)
    bracket = _json_list(F.regexp_extract(reply, r"(?s)\[.*?\]", 0))
    numbered = F.regexp_extract_all(reply, F.lit(r"(?m)^\d+\.\s*(.+)$"), F.lit(1))
    starred = F.regexp_extract_all(reply, F.lit(r"(?m)^\*\s*(.+)$"), F.lit(1))
    return F.coalesce(whole, bracket, _first_nonempty(numbered, starred))


def parse_synonym_reply(reply: Column, n: int) -> Column:
    """A reply as a list: JSON, else the widest bracket of a line, else the first n quoted phrases."""
    trimmed = F.trim(reply)
    bracket = _json_list(F.regexp_extract(trimmed, r"\[.*\]", 0))
    quoted = F.regexp_extract_all(trimmed, F.lit("[“\"]([^”\"]+)[”\"]"), F.lit(1))
    phrases = F.transform(F.slice(quoted, 1, n), lambda p: F.trim(p))
    return F.coalesce(_json_list(trimmed), bracket, phrases)


def config_name(
    theme: Column, max_sub: Column, depth: Column, noise: Column, t: str = "1.0", synonyms: int = 0,
    branching: str = "random",
) -> Column:
    """The long name of a generated data set; the noise part appears only for noise > 0."""
    return F.concat_ws(
        "_",
        theme,
        F.lit(f"hierarchy_t{t}"),
        F.concat(F.lit("maxsub"), max_sub.cast("string")),
        F.concat(F.lit("depth"), depth.cast("string")),
        F.lit(f"synonyms{synonyms}"),
        F.when(noise > 0, F.concat(F.lit("noise"), noise.cast("string"))),
        F.lit(branching),
    )


def _code(name: Column, codes: Sequence[tuple[str, str]], default: str) -> Column:
    chosen = F.lit(default)
    for part, code in reversed(codes):
        chosen = F.when(name.contains(part), F.lit(code)).otherwise(chosen)
    return chosen


def config_label(name: Column) -> Column:
    """A short label such as ``EEH_3s_d5_n25`` from a long configuration name."""
    return F.concat(
        _code(name, TOPIC_CODES, TOPIC_DEFAULT),
        F.lit("_"),
        _code(name, SHAPE_CODES, SHAPE_DEFAULT),
        _code(name, NOISE_CODES, NOISE_DEFAULT),
    )
