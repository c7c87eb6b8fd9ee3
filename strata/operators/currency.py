"""Exchange rates and conversion to US dollars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import latest


def usd_rates(fx: DataFrame) -> DataFrame:
    """(rate_date, currency, usd_rate): one unit in dollars. Direct rates come before inverted ones, then the latest."""
    fx = fx.withColumns({"base_ccy": F.upper(F.trim("base_ccy")), "quote_ccy": F.upper(F.trim("quote_ccy"))}).where("rate > 0")
    direct = fx.where("quote_ccy = 'USD' and base_ccy <> 'USD'").select("rate_date", F.col("base_ccy").alias("currency"), F.col("rate").alias("usd_rate"), F.lit(0).alias("way"))
    inverse = fx.where("base_ccy = 'USD' and quote_ccy <> 'USD'").select("rate_date", F.col("quote_ccy").alias("currency"), (1.0 / F.col("rate")).alias("usd_rate"), F.lit(1).alias("way"))
    return latest(direct.unionByName(inverse), ["rate_date", "currency"], [F.col("way"), F.col("usd_rate").desc()]).drop("way")


def in_usd(df: DataFrame, rates: DataFrame, date: str, currency: str, amount: str, name: str = "amount_usd", strict: bool = False) -> DataFrame:
    """Amounts in dollars by (date, currency). Dollars need no rate; a missing rate keeps the amount, or raises if strict."""
    r = rates.select(F.col("rate_date").alias("_date"), F.col("currency").alias("_ccy"), "usd_rate")
    code = F.upper(F.trim(F.coalesce(F.col(currency), F.lit("USD"))))
    joined = df.join(r, (df[date] == F.col("_date")) & (code == F.col("_ccy")), "left")
    missing = F.raise_error(F.concat(F.lit("no rate for "), code, F.lit(" on "), F.col(date).cast("string"))).cast("double") if strict else F.col(amount)
    value = F.when(code == "USD", F.col(amount)).when(F.col("usd_rate").isNotNull(), F.col(amount) * F.col("usd_rate")).otherwise(missing)
    return joined.withColumn(name, value).drop("_date", "_ccy", "usd_rate")


def fixed_usd(amount: str, currency: str, rates: dict[str, float]):  # noqa: ANN201
    """Conversion by a small literal table; unknown currencies stay as they are."""
    out = F.when(F.col(currency) == "USD", F.col(amount))
    for code, rate in rates.items():
        out = out.when(F.col(currency) == code, F.col(amount) * rate)
    return out.otherwise(F.col(amount))


def averaged(fx: DataFrame) -> DataFrame:
    """One rate for each (date, base, quote) from several quotations: averages, least bid, greatest ask, rounded to 6."""
    keys = ["rate_date", "base_ccy", "quote_ccy"]
    return fx.groupBy(*keys).agg(F.round(F.avg("rate"), 6).alias("rate"), F.round(F.min("bid"), 6).alias("bid"), F.round(F.max("ask"), 6).alias("ask"), F.min("source").alias("source"))


def rate_faults(fx: DataFrame) -> DataFrame:
    """One row: NULL keys, rates that are missing or not positive, repeated (date, base, quote)."""
    keys = ["rate_date", "base_ccy", "quote_ccy"]
    per = fx.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("rate") <= 0, F.lit(True))).alias("bad"))
    null_key = F.col("rate_date").isNull() | F.col("base_ccy").isNull() | F.col("quote_ccy").isNull()
    return per.agg(F.coalesce(F.sum(F.when(null_key, F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_rates"), F.count_if(F.expr("n > 1")).alias("repeated_keys"))
