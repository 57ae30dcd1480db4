"""Orders: by columns as a reader expects them, natural, by object key, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcover.functions.scalars import num


def _parts(text: Column, number) -> Column:
    """text in lower case, each run of digits, without leading zeros, as number makes of it."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)), "")


def natural_key(text: Column) -> Column:
    """Digits compare as numbers of any length, letters without case, all by bytes."""
    # Beyond 20 digits a number is led by its length, behind a colon, which comes after all digits.
    long = lambda d: F.concat(F.lit(":"), F.lpad(F.length(d).cast("string"), 6, "0"), d)
    return _parts(text, lambda d: F.when(F.length(d) > 20, long(d)).otherwise(F.lpad(d, 20, "0")))


def natural_order(text: Column) -> Column:
    """A key that sorts numbers likewise and takes letters that differ in case or accents only as equal."""
    # A number is led by its length, as a collation puts other signs before digits.
    return F.collate(_parts(F.coalesce(text, F.lit("")), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 6, "0"), d)), "UNICODE_CI_AI")


def sort_rows(df: DataFrame, key: str, descending: bool = False, numeric: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """df by one column: as numbers (leading number of a text, else 0), or as text in German order, null as blank. Rows
    that compare equal follow ties."""
    text = F.collate(F.coalesce(F.col(key).cast("string"), F.lit("")), "de")
    by = num(F.col(key)) if numeric else text
    return df.orderBy(by.desc() if descending else by.asc(), *ties)


def natural_sort(df: DataFrame, key: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """df by one text column in natural order: TEST-2 before TEST-10, neither case nor accents count."""
    by = natural_order(F.col(key).cast("string"))
    return df.orderBy(by.desc() if descending else by.asc(), *ties)


def object_key(part: Column) -> list[Column]:
    """Numeric parts come before others, by number."""
    number = part.try_cast("long")
    return [number.isNull(), number, part]


def page(df: DataFrame, order: list, n: int, size: int = 25) -> DataFrame:
    """Page n (from 1) in order, clamped to the pages there are."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(n, 1), pages) - 1) * size).limit(size)
