"""Text functions as Column expressions. Null in, empty string out, unless stated otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import vocab as V


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squash(x: Column) -> Column:
    """White space collapsed to single blanks, trimmed; casing kept."""
    return F.trim(F.regexp_replace(empty(x), r"(?U)\s+", " "))


def squash_lower(x: Column) -> Column:
    return F.lower(squash(x))


def clean_scalar(x: Column) -> Column:
    """Carriage returns to line breaks, runs of blanks and of line breaks shortened, trimmed."""
    y = F.regexp_replace(F.replace(empty(x), F.lit("\r"), F.lit("\n")), "[ \\t]+", " ")
    return strip(F.regexp_replace(y, "\\n{3,}", "\n\n"))


def tokens(x: Column) -> Column:
    """Index tokens: runs of a-z, 0-9, +, # and dot in the lower-cased text."""
    return F.regexp_extract_all(F.lower(empty(x)), F.lit("[a-z0-9+#.]+"), F.lit(0))


def identifier(x: Column) -> Column:
    return F.regexp_replace(F.trim(empty(x.cast("string"))), r"\.0$", "")


def truncate(x: Column, n: int = 500) -> Column:
    y = squash(x)
    return F.when(F.length(y) > n, F.concat(F.rtrim(F.substring(y, 1, n - 3)), F.lit("..."))).otherwise(y)


def bullet(x: Column) -> Column:
    """A bullet line without its mark and emphasis signs."""
    y = F.regexp_replace(F.trim(empty(x)), r"^[-•*+]\s*", "")
    return squash(F.regexp_replace(y, r"[*_]", ""))


def is_sub_header(x: Column) -> Column:
    y = F.trim(F.regexp_replace(F.trim(F.lower(x)), ":+$", ""))
    return y.rlike("^(?:" + "|".join(V.SUB_HEADERS) + ")$") | F.trim(F.lower(x)).rlike(f"^{V.LABEL_LINE}$")


def header(x: Column) -> Column:
    return F.lower(squash(F.regexp_replace(empty(x), r"[#*_`>]", "")))


def section_type(x: Column) -> Column:
    """Kind of section a heading opens, or null: responsibilities before skills before other."""
    y = header(x)
    out = F.lit(None).cast("string")
    for kind, names in reversed(V.SECTION_HEADERS.items()):
        out = F.when(y.rlike("|".join(re.escape(n) for n in names)), F.lit(kind)).otherwise(out)
    return out


def location(x: Column) -> Column:
    """struct(city, country) of a 'city, country' field; the usual marks for nothing give two empty strings."""
    y = F.trim(empty(x))
    none = F.upper(y).isin("N/A", "NA", "-", "NONE", "NULL", "")
    parts = F.filter(F.transform(F.split(y, ","), lambda p: F.trim(p)), lambda p: p != "")
    part = lambda i: F.when(none, F.lit("")).otherwise(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    return F.struct(part(1).alias("city"), part(2).alias("country"))


def compose_location(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", F.nullif(squash(city), F.lit("")), F.nullif(squash(country), F.lit("")))


def labelled(*pairs: tuple[str, Column]) -> Column:
    """'Label:\\nvalue' blocks separated by blank lines; empty values left out."""
    blocks = [F.when(clean_scalar(v) != "", F.concat(F.lit(f"{k}:\n"), clean_scalar(v))) for k, v in pairs]
    return F.concat_ws("\n\n", *blocks)


def labelled_lists(*pairs: tuple[str, Column]) -> Column:
    """'Label:' followed by one '- item' line each; empty lists left out."""
    blocks = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n"))) for k, v in pairs]
    return F.concat_ws("\n\n", *blocks)


def sentence_fields(*pairs: tuple[str, Column]) -> Column:
    """'label: value' parts joined by blanks, empty ones left out, lower case."""
    return squash_lower(F.concat_ws(" ", *[F.when(squash(v) != "", F.concat(F.lit(f"{k}: "), squash(v))) for k, v in pairs]))


def parse_bool(x: Column) -> Column:
    """Null stays null; otherwise whether the text says yes."""
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y", "on"))


def unfence(x: Column) -> Column:
    """Text without an enclosing code fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(empty(x)), r"^```[^\n]*\n?", ""), r"\n?```$", ""))


def highlight(text: Column, terms: Column) -> Column:
    """Marks whole words of the term array; texts without a hit are shortened to 500 characters."""
    pattern = F.concat(F.lit(r"(?i)(?<![a-z0-9+#.])("), F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"), F.lit(r")(?![a-z0-9+#])"))
    marked = F.regexp_replace(empty(text), pattern, F.lit("<mark>$1</mark>"))
    return F.when((F.size(terms) > 0) & (marked != empty(text)), marked).otherwise(F.substring(empty(text), 1, 500))


def years(x: Column) -> Column:
    """Whole years: the number truncated towards zero; what is no number gives 0."""
    return F.coalesce(F.trim(x).try_cast("double").cast("int"), F.lit(0))


def words(x: Column) -> Column:
    """Number of words."""
    return F.size(F.filter(F.split(empty(x), r"(?U)\s+"), lambda w: w != "")).cast("long")


def rerank_text(text: Column, title: Column, source: Column, industry: Column, location: Column) -> Column:
    """What a reranker reads of a chunk: 1,500 characters of its text, or 512 of title, source, industry and location where it has none."""
    rest = F.concat_ws(" | ", *[F.nullif(squash(x), F.lit("")) for x in (title, source, industry, location)])
    return F.when(squash(text) != "", F.substring(strip(text), 1, 1500)).otherwise(F.substring(rest, 1, 512))


def match_text(*fields: Column) -> Column:
    """The fields of a result as one lower-case text; nulls are left out."""
    return F.lower(F.concat_ws(" ", *fields))


def parent_id(chunk_id: Column) -> Column:
    """The id a chunk was made from: without the name of its source and without its section."""
    return F.element_at(F.split(F.regexp_replace(chunk_id, "^(?:profile|demand|jd)_", ""), "_"), 1)


def hashed(text: Column, width: int = 64) -> Column:
    """A text as a unit vector of `width` numbers without a model: its tokens counted by digest. Texts without tokens give zeros."""
    slots = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % width).cast("int"))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 - evaluates x once, not in every use of it
    counts = bound(slots, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(xs, lambda s: s == i)).cast("double")))
    return bound(counts, lambda c: bound(F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, w: a + w * w)), F.lit(1e-12)), lambda n: F.transform(c, lambda v: v / n)))
