"""Bibliography field parsing as column expressions.

``nanify``        null / "nan" in any case (untrimmed) / blank -> null
``norm_str``      trim, empty -> null
``parse_year``    first non-empty of pub_year, year: its integer value when it
                  is all digits; otherwise the leading four digits of the
                  cover date; otherwise null
``split_authors`` author string -> trimmed, non-empty names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.constants import AUTHOR_SEPARATOR

# ---- fixed values: white space that is trimmed from fields ------------------
WS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
# -----------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim Unicode white space (tabs, new lines, no-break spaces too)."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def nanify(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c.isNull() | (F.lower(c) == "nan") | (strip_ws(c) == ""), F.lit(None)).otherwise(c)


def norm_str(c: Column | str) -> Column:
    t = strip_ws(_c(c))
    return F.when(t == "", F.lit(None)).otherwise(t)


def clean(c: Column | str) -> Column:
    """nanify then norm_str: what every bibliography field goes through."""
    return norm_str(nanify(c))


def optional(df: DataFrame, name: str) -> Column:
    """A column that may be missing from the input (then null)."""
    lower = {c.lower(): c for c in df.columns}
    return F.col(lower[name.lower()]).cast("string") if name.lower() in lower else F.lit(None).cast("string")


def parse_year(pub_year: Column, year: Column, cover_date: Column) -> Column:
    y = F.coalesce(nanify(pub_year), nanify(year))
    ys = strip_ws(y)
    direct = F.when(ys.rlike("^[0-9]+$"), ys.try_cast("int"))
    return F.coalesce(direct, _date_year(cover_date))


def _date_year(cover_date: Column) -> Column:
    return F.regexp_extract(strip_ws(nanify(cover_date)), "^([0-9]{4})", 1).try_cast("int")


def key_year(pub_year: Column, year: Column, cover_date: Column) -> Column:
    """Year of a ``title::year`` key: the whole part of the first non-empty of
    pub_year and year if that is a number (``2001.0`` too), else the cover
    date's."""
    y = strip_ws(F.coalesce(nanify(pub_year), nanify(year)))
    return F.coalesce(F.regexp_extract(y, r"^([0-9]+)(\.[0-9]*)?$", 1).try_cast("int"), _date_year(cover_date))


def split_authors(authors: Column | str) -> Column:
    """Array of names; null or separators only -> empty array."""
    parts = F.transform(F.split(F.coalesce(nanify(authors), F.lit("")), AUTHOR_SEPARATOR), strip_ws)
    return F.filter(parts, lambda x: x != "")


def author_names(df: DataFrame, column: str) -> Column:
    """Names from an author field of any supported shape: a separated string,
    an array of strings, or one struct or an array of structs with ``name`` or
    ``given``/``family`` (a missing given name is simply left out)."""
    from pyspark.sql import types as T

    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, T.StructType):
        c, dtype = F.array(c), T.ArrayType(dtype)
    if isinstance(dtype, T.StringType):
        return split_authors(c)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        names = F.transform(F.coalesce(c, F.array().cast(dtype)), lambda x: F.coalesce(norm_str(x), F.lit("")))
        return F.filter(names, lambda x: x != "")
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        fields = {f.name.lower(): f.name for f in dtype.elementType.fields}

        def name_of(a):
            parts = [norm_str(a[fields[k]]) for k in ("given", "family") if k in fields]
            joined = F.nullif(F.concat_ws(" ", *parts), F.lit("")) if parts else F.lit(None).cast("string")
            return F.coalesce(norm_str(a[fields["name"]]) if "name" in fields else F.lit(None).cast("string"),
                              joined, F.lit(""))
        return F.filter(F.transform(F.coalesce(c, F.array().cast(dtype)), name_of), lambda x: x != "")
    raise TypeError(f"unsupported author field type: {dtype.simpleString()}")
