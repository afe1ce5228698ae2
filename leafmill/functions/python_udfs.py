"""What the built-in functions can't express: Arrow-batched Python functions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import stem


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff/Obershelp ratio of two texts in lower case; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits: matched blocks are one, so they hold no more characters."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = left = (1 << len(a)) - 1
    for c in b:
        met = left & masks.get(c, 0)
        left = (left + met | left - met) & full
    return len(a) - left.bit_count()


def ratio_from(least: float):
    """``ratio`` of texts in lower case; null where it can't reach ``least``, unless it is asked for all the same."""

    @F.pandas_udf(T.DoubleType())
    def measured(a: pd.Series, b: pd.Series, always: pd.Series) -> pd.Series:
        pairs = ((x.lower(), y.lower(), told) for x, y, told in zip(a, b, always))
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if told or 2 * common(x, y) >= least * (len(x) + len(y)) - 1e-9 else None for x, y, told in pairs], dtype="float64")

    return measured


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Unicode compatibility form."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """A capital after anything that isn't a letter: P/S Pump."""
    return text.map(lambda x: None if x is None else x.title())


@F.pandas_udf(T.StringType())
def stemmed(word: pd.Series) -> pd.Series:
    """The stem of a lower-case word."""
    return word.map(lambda x: None if x is None else stem(x))
