"""Signal names such as ``209_abs``: an id, then what was done to the signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_signal(name: str, strip: str | None = None) -> tuple[str, str | None]:
    """``209_abs`` -> (``209``, ``abs``); a name with no id is kept whole."""
    if strip:
        name = name.replace(strip, "")
    head, mark, rest = name.partition("_")
    if head.isnumeric():
        return head, rest if mark else None
    return name, None


def signal_id(name: Column) -> Column:
    """The id part of a column of signal names."""
    head = F.substring_index(name, "_", 1)
    return F.when(head.rlike("^[0-9]+$"), head).otherwise(name)


def signal_suffix(name: Column) -> Column:
    """What follows the id; null without an id or without a suffix."""
    head = F.substring_index(name, "_", 1)
    has_rest = head.rlike("^[0-9]+$") & name.contains("_")
    return F.when(has_rest, F.regexp_replace(name, "^[0-9]+_", ""))
