"""Best fuzzy match of a quote among a few chunks, for which Spark has no function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def repaired(quote: pd.Series, chunks: pd.Series) -> pd.Series:
    """The chunk that holds the quote (white space aside), else the one most like it at a ratio of 0.6 or more, else the
    first; null without chunks."""

    def one(q, cs) -> str | None:
        if cs is None or len(cs) == 0:
            return None
        flat = lambda s: "".join((s or "").split())
        for c in cs:
            if q and flat(q) in flat(c):
                return c
        best = max(cs, key=lambda c: SequenceMatcher(None, q or "", c or "").ratio())
        return best if SequenceMatcher(None, q or "", best or "").ratio() >= 0.6 else cs[0]

    return pd.Series([one(q, c) for q, c in zip(quote, chunks)])
