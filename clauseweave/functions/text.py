"""Text functions as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and separators that define the results.
TOKEN_PATTERN = r"[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*"
REFERENCE_PATTERN = r"(?iU)\b3GPP\s+TS\s+\d{2}\.\d{3}\b"
CITATION_PATTERN = r"(?i)chunk_id\s*(?:[:=]\s*)?(?:[`*_]+)?([A-Za-z0-9._-]+)"
MULTI_VALUE_SEPARATOR = "<SEP>"

# Unicode white space plus the four ASCII separators Python also counts as space.
_SPACE = r"[\s\x1c-\x1f]"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order; ``5G-GUTI`` and ``5.5.1.2`` stay whole."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, lambda token: F.lower(token))


def tokenize_literal(text: str) -> list[str]:
    """Distinct tokens of one query string, first occurrence first."""
    return list(dict.fromkeys(token.lower() for token in re.findall(TOKEN_PATTERN, text)))


@lru_cache(maxsize=1)
def _fold_exceptions() -> dict[str, str]:
    """Letters whose folding is not their lower case, found by rule."""
    table = {"Σ": "σ"}  # lower() of a final sigma depends on its context
    for code in range(0x80, 0x110000):
        char = chr(code)
        if char.casefold() != char.lower():
            table[char] = char.casefold()
    return table


def casefold(text: Column) -> Column:
    """Full Unicode case folding, with a fast path for everything but rarities."""
    table = _fold_exceptions()
    rare = "".join(sorted(set(table) - {"ß", "ẞ"}))  # sharp s is common: fast path
    pairs = ",".join(f"{char}:{folded}" for char, folded in table.items())
    spelled = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda char: F.coalesce(
                F.try_element_at(F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":")), char),
                F.lower(char),
            ),
        ),
        "",
    )
    plain = F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    # Looking letters up in a hash table beats a character class of this size; most texts
    # are Latin-1 throughout, which one range tells, and the micro sign is the only rare letter there.
    has_rare = text.rlike(r"[^\x00-\xB4\xB6-\xFF]") & (F.translate(text, rare, "") != text)
    return F.when(has_rare, spelled).otherwise(F.lower(plain))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def normalize_entity(text: Column) -> Column:
    """Folded words separated by single spaces; all other characters separate."""
    return F.trim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " "))


def normalize_entity_literal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.casefold()).strip()


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(casefold(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("item")).otherwise(trimmed)


def span_at(at: Column, value: Column, size: Column) -> Column:
    """Offsets of ``value`` found at 1-based ``at`` (0: nowhere) in a text of ``size``.

    A value that does not occur gets a leading placeholder of its length.
    """
    width = F.char_length(value)
    start = F.when(at > 0, at - 1).otherwise(F.lit(0))
    end = F.when(at > 0, at - 1 + width).otherwise(F.least(size, F.greatest(width, F.lit(1))))
    return F.struct(start.alias("start"), end.alias("end"))


def span(text: Column, value: Column) -> Column:
    """Offsets of ``value`` in ``text`` ignoring case."""
    at = F.when(value == "", F.lit(0)).otherwise(F.instr(casefold(text), casefold(value)))
    return span_at(at, value, F.char_length(text))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches with code-point offsets, as array<struct<start,end,match>>.

    Splitting on the same pattern yields the gaps between the matches; running
    sums of gap and match lengths are the exact offsets, without any UDF.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = "array<struct<start:int,end:int,match:string>>"
    steps = F.zip_with(
        gaps,
        matches,
        lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")),
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast(empty).alias("out"),
    )

    def advance(acc: Column, step: Column) -> Column:
        begin = acc["at"] + step["gap"]
        end = begin + F.char_length(step["match"])
        hit = F.struct(begin.alias("start"), end.alias("end"), step["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    found = F.aggregate(
        F.filter(steps, lambda step: step["match"].isNotNull()),
        start,
        advance,
        lambda acc: acc["out"],
    )
    # one search tells the many texts without a match, which are not split
    return F.when(text.isNull() | text.rlike(pattern), found).otherwise(F.array().cast(empty))


def reference_label(text: Column) -> Column:
    return collapse_space(F.upper(text))


def split_values(text: Column) -> Column:
    """Trimmed non-empty parts of a multi-valued attribute."""
    parts = F.transform(F.split(text, MULTI_VALUE_SEPARATOR), strip)
    return F.filter(parts, lambda part: part != "")


def excerpt(text: Column, size: int, ellipsis: bool = False) -> Column:
    """A display cut of a stored text; the text itself is always processed whole."""
    cut = F.substring(text, 1, size)
    if not ellipsis:
        return cut
    return F.when(F.char_length(text) > size, F.concat(cut, F.lit("..."))).otherwise(text)


def cited_chunk_ids(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION_PATTERN), F.lit(1)))


def token_overlap(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity from the sizes of two token sets and their intersection.

    Takes sizes, not arrays, so that the intersection is computed once, in a
    column of its own.
    """
    union = left + right - shared
    ratio = shared.cast("double") / F.nullif(union, F.lit(0))
    return F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(ratio)
