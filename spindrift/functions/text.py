"""Unicode normal form of search texts: lower case, compatibility decomposition, no combining marks, trimmed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = re.compile("[̀-ͯ]")


def norm_value(s: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", s.lower())).strip()


def norm(c: Column) -> Column:
    """The same for a column: the built-in functions have no decomposition, so this is a vectorised Python function."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(norm_value, na_action="ignore")

    return normal(c)
