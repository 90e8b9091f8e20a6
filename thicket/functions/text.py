"""Column rules for names, numbers held as text, and addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

U64_MAX = 18446744073709551615


def u64(c: Column) -> Column:
    """The text as an unsigned 64-bit integer (DECIMAL(20,0)): an optional plus, digits, any leading zeros;
    null for all else."""
    digits = F.regexp_replace(c, r"^\+?0*(?=[0-9])", "")
    number = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
    return F.when(c.rlike(r"^\+?[0-9]+\z") & (number <= F.lit(str(U64_MAX)).cast("decimal(20,0)")), number)


def trim_white(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def plain_key(name: Column) -> Column:
    """The name's key for checks and sibling order: trimmed and lower-cased."""
    return F.lower(trim_white(name))


@pandas_udf(StringType())
def _nfc(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFC")


def with_merge_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` with the name's merging key: normal form C, trimmed, lower-cased.

    Only rows whose name has other than ASCII characters, the sole ones that the normal form can change, go
    through Python; nothing is shuffled. A null name has a null key.
    """
    odd = F.coalesce(F.col(name).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = df.where(~odd).withColumn(key, plain_key(F.col(name)))
    return plain.unionByName(df.where(odd).withColumn(key, plain_key(_nfc(name))))


def canonical_url(url: Column) -> Column:
    """Trimmed, without fragment; scheme and authority lower-cased where there is a scheme."""
    text = F.substring_index(trim_white(url), "#", 1)
    at = F.instr(text, "://")
    scheme = F.lower(F.substring(text, F.lit(1), at - 1))
    rest = F.substring(text, at + 3, F.length(text))
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    return F.when(at == 0, text).otherwise(F.concat(scheme, F.lit("://"), F.lower(authority), F.substring(rest, F.length(authority) + 1, F.length(rest))))
