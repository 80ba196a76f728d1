"""Column functions over text: hygiene, masks, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boilerplate wording of scanned documents. Fixed values.
BOILERPLATE = ("all rights reserved", "copyright", "license", "confidential")


def strip_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """One kind of line end, runs of blanks as one, at most one empty line, no outer space."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return strip_all(F.regexp_replace(c, "\n{3,}", "\n\n"))


def ascii_fold(c: Column) -> Column:
    """Everything outside printable ASCII and line ends as one space, so that \\b means the same in every engine."""
    return F.regexp_replace(c, "[^ -~\n]", " ")


def mask(c: Column, pattern: str, fill: str = " ") -> Column:
    """Matches overwritten with as many `fill` characters: every offset stays valid."""
    hits, rest = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    pieces = F.zip_with(rest, hits, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.repeat(F.lit(fill), F.length(F.coalesce(m, F.lit(""))))))
    return F.concat_ws("", pieces)


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    # A tag is from a "<" to the next ">": cut at each ">" first, so that a text of many "<" is read once.
    parts = F.split(c, ">", -1)
    open_at = lambda p: F.instr(p, "<")
    closed = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.when(open_at(p) > 0, F.concat(F.substring_index(p, "<", 1), F.lit(" "))).otherwise(F.concat(p, F.lit(">"))))
    c = F.concat(F.array_join(closed, ""), F.element_at(parts, -1))
    return strip_all(F.regexp_replace(c, r"\s+", " "))


def count_of(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).cast("bigint")


def alpha_ratio(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n > 0, F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / n).otherwise(0.0)


def tokens(c: Column, pattern: str = "[a-z]+") -> Column:
    """Lower-case ASCII words, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bucket_of(key: Column, buckets: int) -> Column:
    """A stable bucket of a key, the same in every engine: 32 bits of md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def normalized_enum(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Free text to a closed set of values, by lower-cased containment in the table's order."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(F.lower(c).contains(k), F.lit(v)).otherwise(out)
    return out
