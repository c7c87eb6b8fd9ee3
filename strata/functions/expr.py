"""Projections and predicates over columns. Everything stays in whole-stage codegen; bad input gives NULL, never an error."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- columns that may be absent ---------------------------------------------------------------------------------


def existing(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """Candidates that are columns, in order; names match without regard to case."""
    names = {c.lower(): c for c in df.columns}
    return [names[c.lower()] for c in candidates if c.lower() in names]


def resolve(df: DataFrame, candidates: Sequence[str], kind: str = "string", required: bool = False) -> Column:
    """The first candidate that exists; else a typed NULL, or an error where the field is required."""
    found = existing(df, candidates)
    if found:
        return F.col(f"`{found[0]}`")
    if required:
        raise ValueError(f"none of {list(candidates)} is a column")
    return F.lit(None).cast(kind)


def coalesced(df: DataFrame, candidates: Sequence[str], kind: str = "string", required: bool = False) -> Column:
    """The first non-NULL value of the candidates that exist."""
    found = existing(df, candidates)
    if len(found) > 1:
        return F.coalesce(*[F.col(f"`{c}`") for c in found])
    return resolve(df, candidates, kind, required)


def with_missing(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Absent columns as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in wanted.items() if c not in df.columns})


def align(df: DataFrame, schema: StructType, extra_to: str | None = None) -> DataFrame:
    """Columns of ``schema`` in its order: cast without errors, absent ones NULL, all others packed as JSON if wanted."""
    fields = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra_to:
        fields.append((F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit(None).cast("string")).alias(extra_to))
    return df.select(*fields)


def renamed(df: DataFrame, names: Mapping[str, str], keep_rest: bool = False) -> DataFrame:
    """Canonical names; columns without one go unless kept."""
    rest = [F.col(c) for c in df.columns if c not in names] if keep_rest else []
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], *rest)


# --- text, numbers, dates ---------------------------------------------------------------------------------------


def canonical_text(c: Column, case: str = "keep") -> Column:
    """Trimmed text in the wanted case."""
    c = F.trim(c)
    return F.lower(c) if case == "lower" else F.upper(c) if case == "upper" else c


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9 ]", "")


def filled(c: Column, value: object) -> Column:
    """NULL and blank text become ``value``."""
    return F.coalesce(F.when(F.length(F.trim(c.cast("string"))) > 0, c), F.lit(value))


def at_least_zero(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def unit_price(price: Column, total: Column, quantity: Column) -> Column:
    """The price, or total over quantity where it is missing; NULL for a quantity of zero."""
    return F.coalesce(price, F.try_divide(total, quantity))


def parsed_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy")) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def date_like_or(first: Column, second: Column, fallback: Column) -> Column:
    """The first column where it starts like a date, else the beginning of the second, else the fallback."""
    looks = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(
        F.when(looks(first), F.to_date(F.try_to_timestamp(F.substring(first, 1, 10), F.lit("yyyy-MM-dd")))),
        F.when(looks(second), F.to_date(F.try_to_timestamp(F.substring(second, 1, 10), F.lit("yyyy-MM-dd")))),
        fallback,
    )


def date_parts(c: Column) -> dict[str, Column]:
    return {
        "year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "day": F.dayofmonth(c), "day_of_week": F.dayofweek(c),
        "week": F.weekofyear(c), "day_name": F.date_format(c, "EEEE"), "month_name": F.date_format(c, "MMMM"),
        "year_month": F.date_format(c, "yyyyMM"), "is_weekend": F.dayofweek(c).isin(1, 7), "is_month_end": c == F.last_day(c),
    }


def age_in_days(c: Column, as_of: Column) -> Column:
    return F.datediff(as_of, c)


def banded(c: Column, bands: Sequence[tuple[float, str]], top: str, missing: str | None = None) -> Column:
    """The name of the first band whose upper limit lies above the value."""
    out = F.when(c.isNull(), F.lit(missing))
    for limit, name in bands:
        out = out.when(c < limit, name)
    return out.otherwise(top)


def mapped(c: Column, names: Mapping[str, str], other: str) -> Column:
    """A category for each value, matched without regard to case and blanks."""
    key, out = F.lower(F.trim(c)), None
    for value, name in names.items():
        out = F.when(key == value.lower(), name) if out is None else out.when(key == value.lower(), name)
    return F.lit(other) if out is None else out.otherwise(other)


def flag_status(cancelled: Column, shipped: Column, delivered: Column) -> Column:
    return F.when(cancelled, "cancelled").when(delivered, "delivered").when(shipped, "shipped").otherwise("pending")


def full_name(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.trim(p) for p in parts]))


def email_domain(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "@([^@]+)$", 1))


def tag_array(c: Column, separator: str = ",") -> Column:
    return F.transform(F.split(c, separator), lambda x: F.trim(x))


RATE_MAJOR = ("EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD")


def rate_category(c: Column) -> Column:
    code = F.upper(F.trim(c))
    return F.when(code.isin(*RATE_MAJOR), "major").when(code.rlike("^[A-Z]{3}$"), "minor").otherwise("exotic")


# --- keys -------------------------------------------------------------------------------------------------------


def surrogate_key(*parts: Column, separator: str = "||") -> Column:
    """SHA-256 of the parts. A NULL part differs from an empty one; characters of the separator inside a part are
    escaped, so parts cannot run into each other."""
    plain = lambda c: F.regexp_replace(c.cast("string"), r"([\\|])", r"\\$1")
    return F.sha2(F.concat_ws(separator, *[F.coalesce(plain(p), F.lit("\u0000")) for p in parts]), 256)


def change_hash(*parts: Column) -> Column:
    """One number for the attributes of a version; NULLs count (unlike in a plain concatenation)."""
    return F.xxhash64(F.to_json(F.struct(*[p.alias(f"c{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}))


def salt(c: Column, n: int) -> Column:
    """A number below n from the key's text: spreads a hot key over n partitions."""
    return F.crc32(c.cast("string")) % n


def row_key(df: DataFrame) -> Column:
    """A reproducible id of a row's content."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)


# --- predicates -------------------------------------------------------------------------------------------------


def non_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def in_range(c: Column, low: object = None, high: object = None) -> Column:
    """Within the limits; a NULL passes, as range rules only count violations. Plain comparisons, so scans can prune by them."""
    out = F.lit(True)
    if low is not None:
        out = (c >= low) | c.isNull()
    if high is not None:
        upper = (c <= high) | c.isNull()
        out = upper if low is None else out & upper
    return out


def member(c: Column, values: Sequence[object], null: bool = False) -> Column:
    return c.isin(*values) | c.isNull() if null else c.isin(*values) & c.isNotNull()


def not_member(c: Column, values: Sequence[object], null: bool = True) -> Column:
    """NULL counts as outside the set unless told otherwise (a plain negation would drop it)."""
    return ~c.isin(*values) | c.isNull() if null else ~c.isin(*values) & c.isNotNull()


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
        if df.schema[k].dataType.typeName() in ("float", "double"):
            df = df.where(~F.isnan(k))
    return df


#: How far back each kind of source may lie, in hours.
FRESHNESS_HOURS = {"crm": 24, "warehouse": 24, "stream": 1, "fx": 48}


def fresh(df: DataFrame, column: str, as_of: Column, hours: float) -> DataFrame:
    return df.where(F.col(column).cast("timestamp") >= as_of - F.make_dt_interval(hours=F.lit(int(hours))))


def lookback_split(df: DataFrame, column: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(history, window): rows before the cutoff or without a date, and the others."""
    dated = df.schema[column].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
    c = F.col(column) if dated else F.to_date(column)  # a raw date or time prunes row groups
    return df.where((c < cutoff) | c.isNull()), df.where(c >= cutoff)


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A repeatable page: ordered by the key."""
    return df.orderBy(key).offset(offset).limit(limit)


def secured(df: DataFrame, rule: str | None, masks: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows a rule lets through, with columns masked."""
    return (df.where(F.expr(rule)) if rule else df).withColumns(dict(masks or {}))
