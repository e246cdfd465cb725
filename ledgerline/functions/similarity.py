"""Sequence similarity, which no built-in function has: Arrow-batched, over distinct pairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.functions.text import containment_score


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def row_match_score(alias: Column, label: Column) -> Column:
    """How well a row label fits an alias, 0 to 100."""
    return F.coalesce(containment_score(alias, label), sequence_ratio(alias, label) * 80.0)


def field_similarity(a: Column, b: Column) -> Column:
    """Of two field names: the better of the Jaccard similarity of their parts and the sequence ratio."""
    x, y = F.array_distinct(F.split(F.lower(a), "_")), F.array_distinct(F.split(F.lower(b), "_"))
    jaccard = F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y)).cast("double")
    return F.greatest(jaccard, sequence_ratio(F.lower(a), F.lower(b)))
