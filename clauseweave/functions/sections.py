"""Section-number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MULTI_VALUE_SEPARATOR, casefold, strip

# Section grammar and the default provenance tokens.
SECTION_TOKEN = r"\d+[A-Z]?(?:\.[0-9A-Z]+)*"
DEFAULT_SPEC_TOKEN = "24501"
DEFAULT_SOURCE_TOKEN = "24501-j20"


def under_prefix(section: Column, prefix: Column | str) -> Column:
    """Equal to the prefix or nested below it ("5" does not cover "50")."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (section == prefix) | F.startswith(section, F.concat(prefix, F.lit(".")))


def parent(section: Column) -> Column:
    """The section one level up, or null at the top."""
    return F.when(F.contains(section, F.lit(".")), F.regexp_replace(section, r"\.[^.]*$", ""))


def numeric_sort_key(section: Column) -> Column:
    """Orderable key: digit parts by value, any other part after all digits."""
    return F.transform(
        F.split(section, r"\."),
        lambda part: F.struct(
            F.when(part.rlike("^[0-9]+$"), part.try_cast("decimal(38,0)"))
            .otherwise(F.lit(10**9).cast("decimal(38,0)"))
            .alias("number"),
            F.when(part.rlike("^[0-9]+$"), F.lit("")).otherwise(part).alias("text"),
        ),
    )


def provenance_sections(file_path: Column, source_token: str = DEFAULT_SOURCE_TOKEN) -> Column:
    """Sorted distinct sections named after ``<token>.md`` in a provenance path."""
    marker = source_token.replace(".", r"\.")
    found = F.regexp_extract_all(file_path, F.lit(rf"(?i){marker}\.md([0-9A-Z.]+)"), F.lit(1))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"^\.+|\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda s: s != "")))


def marked_sections(file_path: Column, source_token: str = DEFAULT_SOURCE_TOKEN) -> Column:
    """Per path of a multi-valued attribute, the trimmed text after ``<token>.md``."""
    marker = F.lit(f"{source_token}.md")
    hits = F.filter(F.split(file_path, MULTI_VALUE_SEPARATOR), lambda raw: F.contains(raw, marker))
    tails = F.transform(
        hits, lambda raw: strip(F.substr(raw, F.instr(raw, marker) + F.char_length(marker)))
    )
    return F.array_distinct(F.filter(tails, lambda s: s != ""))


def names_spec(attributes: Column, spec_token: str = DEFAULT_SPEC_TOKEN) -> Column:
    """Any provenance attribute mentions the token, ignoring case and dots."""
    token = spec_token.casefold().replace(".", "")
    hits = F.lit(False)
    for key in ("source_file", "file_path", "description", "source_id"):
        value = F.coalesce(F.try_element_at(attributes, F.lit(key)), F.lit(""))
        if any(char.isalpha() for char in token):  # digits need no folding
            value = casefold(value)
        hits = hits | F.contains(F.replace(value, F.lit("."), F.lit("")), F.lit(token))
    return hits
