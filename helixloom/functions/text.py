"""Column rules for texts: markup, numbers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_markup(html: Column) -> Column:
    """Text without tags and entities, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    bare = F.regexp_replace(bare, "&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, thousands separators taken out."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit("([0-9]+)"), F.lit(1)))


def norm_title(text: Column) -> Column:
    """First sixty letters and digits, lower case."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", ""), 1, 60)


def strip_local_path(text: Column) -> Column:
    """Absolute paths of folders become their file's name."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:/[A-Za-z0-9._-]+)+/([A-Za-z0-9._-]+)", "$1")


def exact_record(url: Column) -> Column:
    """Whether a link points at a record, not at a site: two parts of the path one after the other, a query that names a value, or
    a numbered article."""
    place = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    parts = F.split(F.substring(place, F.instr(place, "://") + 3, F.length(place)), "/")  # host first
    path = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    following = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    deep = F.exists(F.zip_with(path, following, lambda a, b: (a != "") & (b != "")), lambda x: F.coalesce(x, F.lit(False)))
    value = F.contains(F.split_part(F.regexp_extract(url, "[?](.*)$", 1), F.lit("#"), F.lit(1)), F.lit("="))
    article = F.endswith(F.get(parts, F.lit(0)), F.lit("pubmed.ncbi.nlm.nih.gov")) & F.substring(F.coalesce(F.get(path, F.lit(0)), F.lit("")), 1, 1).between("0", "9")
    return F.coalesce((F.contains(place, F.lit("://")) & (deep | article)) | value, F.lit(False))
