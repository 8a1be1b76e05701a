"""What of a long text a learned part is fitted on; scoring always reads whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRETCHES = 8


def stretches(text: Column, longest: int, parts: int = STRETCHES) -> Column:
    """The text, or of a longer one ``parts`` stretches from all of it, as long together, cut between words where they have any."""
    n = F.length(text)
    size = longest // parts
    starts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor((n - size) * i / (parts - 1)).cast("int") + 1)
    whole_words = lambda t: F.regexp_replace(t, r"^\S{0,40}\s|\s\S{0,40}$", " ")
    return F.when(n <= longest, text).otherwise(F.concat_ws("\n", F.transform(starts, lambda a: whole_words(F.substring(text, a, F.lit(size))))))
