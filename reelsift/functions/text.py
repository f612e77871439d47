"""Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(column: Column) -> Column:
    """Text in Unicode form NFC.  Text in ASCII is in that form already and passes the UDF as a null."""
    ascii_only = ~column.rlike("[^\\x00-\\x7F]")
    return F.coalesce(F.when(ascii_only, column), _nfc_udf(F.when(~ascii_only, column)))
