"""Text functions. White space is Unicode's where the data model says so: Spark's trim() knows blanks only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that are replaced, in this order; the ampersand comes first, so &amp;lt; ends as <.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
NAME_LENGTH = 60


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(text, r"\s+", " "))


def blank(text: Column) -> Column:
    return F.length(trim(text)) == 0


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_name(name: Column) -> Column:
    """A file name without what file systems forbid; null if blank."""
    return F.when(~blank(name), F.substring(F.regexp_replace(trim(name), r'[/\\:*?"<>|]', "_"), 1, NAME_LENGTH))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def span_attribute(token: Column, name: str) -> Column:
    """The number of a colspan or rowspan attribute; null where there is none."""
    return F.regexp_extract(token, name + r'="(\d+)"', 1).try_cast("int")


def pages_label(n: Column) -> Column:
    return F.concat(F.lit("("), n.cast("string"), F.when(n == 1, F.lit(" page)")).otherwise(F.lit(" pages)")))


def in_order(order: Sequence[str], value: str, separator: str) -> Column:
    """An aggregate: value by the order columns, joined. The order must be total, as Spark's rows have none."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return F.array_join(F.transform(listed, lambda x: x["_value"]), separator)
