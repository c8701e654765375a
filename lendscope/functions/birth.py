"""Birth-number decoding: ``YYMMDD`` where women's months carry +50."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.dates import parse_yyyymmdd

# Month offset marking a female client, and the century that
# every birth year belongs to.
FEMALE_MONTH_OFFSET = 50
BIRTH_CENTURY = "19"


def decode_birth(df: DataFrame, col: str = "birth_number", literal: bool = False,
                 birth_date: str = "birth_date", sex: str = "sex") -> DataFrame:
    """Add ``birth_date`` and ``sex`` decoded from a birth-number column.

    In ``literal`` mode the field still holds its surrounding quotes, so the
    digits start at position 2 (as in the source text); otherwise at 1.
    """
    start = 2 if literal else 1
    s = F.col(col)
    yy = F.substring(s, start, 2)
    mm = F.substring(s, start + 2, 2).try_cast("int")
    dd = F.substring(s, start + 4, 2)
    female = mm > FEMALE_MONTH_OFFSET
    month = F.when(female, mm - FEMALE_MONTH_OFFSET).otherwise(mm)
    text = F.concat(F.lit(BIRTH_CENTURY), yy, F.lpad(month.cast("string"), 2, "0"), dd)
    return (df.withColumn(birth_date, parse_yyyymmdd(text))
              .withColumn(sex, F.when(mm.isNull(), F.lit(None))
                          .when(female, F.lit("F")).otherwise(F.lit("M"))))


def birth_number_from_date(date_col: Column, female: Column) -> Column:
    """Encode a date and a female flag as a ``YYMMDD`` birth number."""
    month = F.month(date_col) + F.when(female, FEMALE_MONTH_OFFSET).otherwise(0)
    return F.concat(F.date_format(date_col, "yy"), F.lpad(month.cast("string"), 2, "0"),
                    F.date_format(date_col, "dd"))
