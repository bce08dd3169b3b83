"""Text expressions of the readers and audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def truncated_tokens(text: Column, n: int) -> Column:
    """The first n tokens of a split at single spaces, joined again; a stand-in for a model's tokenizer."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def titled(title: Column, text: Column) -> Column:
    """Title and text with a space between, stripped of all white space, where there is a title; else the text as it is. Nulls are empty."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    both = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", title, text), r"^\s+", ""), r"\s+$", "")
    return F.when(title != "", both).otherwise(text)


def parsed_ids(value: Column) -> Column:
    """A list that was written as text."""
    return F.from_json(value, "array<bigint>")


def filled(text: Column) -> Column:
    """Texts count as present if not null and not empty."""
    return text.isNotNull() & (text != "")
