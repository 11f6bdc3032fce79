"""Text of names and values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry no topic.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def snake(name: Column) -> Column:
    """camelCase to snake_case, lower."""
    parts = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(parts, "([a-z0-9])([A-Z])", "$1_$2"))


def name_tokens(name: Column) -> Column:
    """The words of a property name."""
    return F.filter(F.split(F.trim(F.translate(snake(name), "_-", "  ")), r"\s+"), lambda t: t != "")


def curated_tokens(tokens: Column) -> Column:
    """Distinct lower-case tokens of more than one character that aren't stop words, sorted."""
    lower = F.transform(tokens, F.lower)
    return F.array_sort(F.array_distinct(F.filter(lower, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))))


def curated_string(name: Column) -> Column:
    return F.lower(F.translate(snake(name), "_-", "  "))


def words(text: Column) -> Column:
    """Runs of lower-case letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Word tokens of two characters or more, lower; underscores count as letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))


def key_of(value: Column) -> Column:
    """Join keys compare as lower-case strings."""
    return F.lower(value.cast("string"))


def keyword_score(query: Column, text: Column) -> Column:
    """0.8 x share of the query's words in the text + 0.2 x share of the text's words in the query."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(text))
    both = F.size(F.array_intersect(q, t))
    score = 0.8 * both / F.size(q) + 0.2 * both / F.size(t)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(score)


#: Stems of files that describe data, and forms of such stems.
METADATA_STEMS = ["cc-zero", "cc-by", "legalcode", "open-licenses", "government-works", "odc-odbl", "license", "index", "metadata", "catalog", "dcat-us", "iso", "edit", "search", "contact", "resolve", "request", "wmsserver", "policyinformation", "gmxcodelists", "gmi", "readme", "headers", "signed-metadata", "bios", "hires", "cwhr", "v1", "v2"]
METADATA_FORMS = [r"^[a-z0-9]{4}-[a-z0-9]{4}$", r"^\d+(-\d+)?$", r"^index-[A-Za-z0-9]{6}$", r"^doi-[a-z0-9]+$", r"^www_[a-z0-9_]+$"]


def is_metadata_uri(uri: Column) -> Column:
    """Whether a path names a description of data rather than data: by a known stem or form, or by the name of the
    folder before its first ``files``."""
    parts = F.split(uri, "/")
    stem = F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    at = F.array_position(parts, "files").cast("int")
    slug = F.when(at > 0, F.lower(F.element_at(parts, F.when(at > 1, at - 1).otherwise(-1)))).otherwise("")
    known = stem.isin(METADATA_STEMS) | ((slug != "") & (stem == slug))
    for form in METADATA_FORMS:
        known = known | stem.rlike(form)
    return known


def table_name_of(path: Column) -> Column:
    """<slug>/<stem> of a path with a ``files`` segment, else its last two segments."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    at = F.array_position(parts, "files")
    before = F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(-2)))
    return F.concat_ws("/", before, stem)


def counter(mark: str):
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))


def looks_like_table(text: Column) -> Column:
    """Whether the first lines look like JSON rows or delimited rows of equal width. What begins as JSON but isn't a
    row a line is no table."""
    stripped = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(stripped, lambda x: x != "")
    first = F.slice(lines, 1, 5)
    json_rows = F.size(F.filter(first, lambda x: x.startswith("{") & x.endswith("}"))) >= 3
    delimited = []
    for mark in (",", "\t", "|", ";"):
        bare = F.transform(first, lambda x: F.regexp_replace(x, '"[^"]*"', ""))
        counts = F.slice(F.filter(F.transform(bare, counter(mark)), lambda n: n > 0), 1, 3)
        delimited.append((F.size(counts) == 3) & (F.size(F.array_distinct(counts)) == 1))
    nested = F.substring(F.get(lines, 0), 1, 1).isin("{", "[")
    return (F.size(lines) >= 3) & (json_rows | (~nested & F.array_contains(F.array(*delimited), True)))
