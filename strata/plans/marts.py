"""Silver tables, dimensions, facts and marts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import banded, canonical_text, date_parts, filled, surrogate_key
from ..operators.currency import in_usd, usd_rates
from ..operators.history import OPEN_END
from ..operators.quality import assert_row_drop
from ..operators.relational import as_of, join_dimension, latest, newest, small
from ..sources.writers import Bounds, load_observed

# --- silver -----------------------------------------------------------------------------------------------------


def customers_silver(df: DataFrame) -> DataFrame:
    return df.where("customer_id is not null").select(
        "customer_id", canonical_text(F.col("customer_name")).alias("customer_name"), filled(F.upper(F.trim("country")), "UNKNOWN").alias("country"),
        filled(F.trim("region"), "unknown").alias("region"), filled(F.lower(F.trim("segment")), "unknown").alias("segment"), F.col("balance").try_cast("double").alias("balance"),
    ).dropDuplicates(["customer_id"])


def products_silver(df: DataFrame) -> DataFrame:
    good = df.where("product_id is not null and price > 0")
    return good.select("product_id", canonical_text(F.col("product_name"), "lower").alias("product_name"), F.trim("brand").alias("brand"), filled(F.trim("category"), "unknown").alias("category"), "size", F.col("price").try_cast("double").alias("price")).dropDuplicates(["product_id"])


def orders_silver(df: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    good = df.where("order_id is not null and customer_id is not null and coalesce(total_amount, 0) >= 0")
    out = good.select("order_id", "customer_id", "product_id", "quantity", F.col("total_amount").try_cast("double").alias("total_amount"), filled(F.upper(F.trim("currency")), "USD").alias("currency"), F.upper(F.trim("status")).alias("status"), "order_date")
    out = out.withColumn("unit_price", F.try_divide("total_amount", "quantity")).dropDuplicates(["order_id"])
    return out if customers is None else out.join(customers.select("customer_id"), "customer_id", "left_semi").select(out.columns)


def checked_silver(before: DataFrame, after: DataFrame, key: str, max_drop: float) -> DataFrame:
    """``after``, or an error for an empty input, NULL keys, or too many dropped rows: for frames that are not written, by
    two counting jobs. ``load_silver`` counts while it writes."""
    b = before.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    if not b["n"]:
        raise ValueError("the input is empty")
    if b["nulls"]:
        raise ValueError(f"{b['nulls']} rows have no {key}")
    assert_row_drop(b["n"], after.count(), max_drop)
    return after


def load_silver(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, key: str, max_drop: float, partition_by: Sequence[str] = ()) -> DataFrame:
    """Clean a table into ``path``; an empty input, NULL keys or too many dropped rows raise before it is touched. What is
    counted is observed by the job that writes the rows, so no counting job runs."""
    load_observed(source, transform, path, [key], Bounds(least_rows=1, most_dropped=max_drop), partition_by=partition_by)
    return source.sparkSession.read.parquet(path)


def behaviour_silver(df: DataFrame) -> DataFrame:
    out = df.select("event_id", "customer_id", F.lower(F.trim("event_type")).alias("event_type"), F.greatest(F.coalesce(F.col("amount"), F.lit(0.0)), F.lit(0.0)).alias("amount"), "event_ts", F.coalesce(F.col("event_date"), F.to_date("event_ts")).alias("event_date"), "session_id")
    return latest(out.where("event_id is not null"), ["event_id"], newest("event_ts"))


_EVENT = "k long, amount double, currency string, channel string"


def order_events_silver(df: DataFrame, payload: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Event payloads as columns: JSON first, a pattern where JSON does not parse (quotes doubled by a CSV export), defaults last."""
    text = F.regexp_replace(F.col(payload), '""', '"')
    got = F.from_json(F.col(payload), _EVENT)
    amount = F.regexp_extract(text, r'"amount"\s*:\s*"?(-?[0-9]+(?:\.[0-9]+)?)', 1).try_cast("double")
    number = F.regexp_extract(text, r'"k"\s*:\s*"?(-?[0-9]+)', 1).try_cast("long")
    out = df.withColumns({"payload_k": F.coalesce(got["k"], number), "payload_amount": F.coalesce(got["amount"], amount, F.lit(0.0)), "currency": F.coalesce(got["currency"], F.lit("USD")), "channel": F.coalesce(got["channel"], F.lit("unknown"))})
    return latest(out, keys, newest(*order))


def enriched_orders(orders: DataFrame, customers: DataFrame, products: DataFrame, fx: DataFrame) -> DataFrame:
    out = in_usd(orders, usd_rates(fx), "order_date", "currency", "total_amount")
    return out.join(customers.select("customer_id", "country", "segment"), "customer_id", "left").join(products.select("product_id", "category", "price"), "product_id", "left")


def enriched_customers(customers: DataFrame, contacts: DataFrame, events: DataFrame, as_of: Column, months: int = 24) -> DataFrame:
    """Profile, latest contact, and event counts of the last months."""
    contact = latest(contacts, ["customer_id"], newest("contacted_at", "contact_id")).select("customer_id", "contact_id", "contacted_at")
    recent = events.where(F.col("event_date") >= F.add_months(as_of, -months))
    counts = recent.groupBy("customer_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("signup", "view", "click", "purchase", "error")], F.sum(F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(0.0)).alias("event_revenue"))
    out = customers.join(contact, "customer_id", "left").join(counts, "customer_id", "left")
    return out.fillna(0, [c for c in counts.columns if c != "customer_id"])


# --- dimensions ---------------------------------------------------------------------------------------------------


def type2_dimension(df: DataFrame, key: str, start: str, name: str, tracked: Sequence[str] = ()) -> DataFrame:
    """Versions by start; the surrogate key is a hash of key and start, the open end a far date. With ``tracked``
    attributes only rows that change one of them (NULLs count as values) begin a version, so the dimension grows with
    changes and not with the rows seen."""
    once, order = df.dropDuplicates([key, start]), Window.partitionBy(key).orderBy(start)
    if tracked:
        state = F.struct(*[F.col(c) for c in tracked])
        once = once.withColumn("_before", F.lag(state).over(order)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")
    end = F.lead(start).over(order)
    timed = once.withColumns({"effective_from": F.col(start), "effective_to": F.coalesce(end.cast("timestamp"), F.lit(OPEN_END).cast("timestamp")), "is_current": end.isNull()})
    return timed.withColumn(name, version_key(key, start)).drop(start)  # a step of its own: beside the window Spark hashes before the shuffle, 64 bytes a row


def version_key(key: str, start: str) -> Column:
    return surrogate_key(F.col(key), F.date_format(start, "yyyy-MM-dd"))


def current_starts(df: DataFrame, key: str, start: str, name: str) -> DataFrame:
    """When the current version of each member of ``type2_dimension`` began: one aggregate that combines before its
    shuffle, as facts that ask for current versions only need no history. Rows without a key or a start are no version."""
    return df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).groupBy(key).agg(F.max(start).alias(name))


def with_start(df: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """The start of each row's current member, NULL where there is none. It is a few bytes in the joins that follow, where
    the surrogate key would be 64 that no codec shortens; ``member_key`` turns it into the key after the last of them."""
    return join_dimension(df, small(starts), [key])


def member_key(key: str, start: str, missing: str = "-1") -> Column:
    """The surrogate key of the member version of a key and start, ``missing`` without a start."""
    return F.when(F.col(start).isNotNull(), version_key(key, start)).otherwise(missing)


def with_member(df: DataFrame, dimension: DataFrame, key: str, name: str, missing: str = "-1") -> DataFrame:
    """The surrogate key of the current version of each row's member, ``missing`` where there is none. A dimension of at
    most a counted size is broadcast."""
    current = dimension.where("is_current").select(F.col(key), F.col(name))
    return join_dimension(df, small(current), [key]).withColumn(name, F.coalesce(name, F.lit(missing)))


def with_member_at(df: DataFrame, dimension: DataFrame, key: str, name: str, time: str, missing: str = "-1") -> DataFrame:
    """The surrogate key of the version of each row's member that was valid at the row's time: the last that had begun
    by then, unless it had ended. ``missing`` where there is none (before the first version as well)."""
    versions = dimension.select(F.col(key), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), F.col(name))
    found = as_of(df, versions, [key], time, "_from", ["_to", name])
    valid = F.col("_to").isNull() | (F.col(time) < F.col("_to"))
    return found.withColumn(name, F.coalesce(F.when(valid, F.col(name)), F.lit(missing))).drop("_to")


def date_dimension(df: DataFrame, date: str, least_days: int = 730) -> DataFrame:
    """Every day of a fact's range, at least so many; the range joins in as one row, nothing is collected."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", F.greatest(F.col("b"), F.date_add("a", least_days)))).alias("date"))
    return with_parts(days)


def date_range(spark, first: str, last: str) -> DataFrame:  # noqa: ANN001
    return with_parts(spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")))


def with_parts(days: DataFrame) -> DataFrame:
    return days.select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", *[c.alias(n) for n, c in date_parts(F.col("date")).items()])


def sub_dimension(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with a hashed key."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, surrogate_key(F.col(column)))


def with_sub_key(df: DataFrame, column: str, name: str) -> DataFrame:
    """The hashed key in the column's place: no join, as the key follows from the value."""
    return df.withColumn(name, F.when(F.col(column).isNotNull(), surrogate_key(F.col(column)))).drop(column)


def demographic_customers(df: DataFrame, since: str, as_of: Column) -> DataFrame:
    days = F.datediff(as_of, F.col(since))
    return df.withColumns({"tenure_days": days, "tenure_tier": banded(days, [(365, "new"), (1095, "established")], "loyal", "unknown"), "value_tier": banded(F.col("balance"), [(0, "debtor"), (2500, "bronze"), (7500, "silver")], "gold", "unknown")})


# --- facts and marts ----------------------------------------------------------------------------------------------


def fact_orders(orders: DataFrame, customer_dim: DataFrame, product_dim: DataFrame, fx: DataFrame) -> DataFrame:
    """Dollar amounts, keys of current members (-1 where there is none), date parts. Members are matched as they are keyed."""
    out = in_usd(orders, usd_rates(fx), "order_date", "currency", "total_amount")
    c = customer_dim.select(F.col("customer_id"), F.col("customer_id").alias("customer_key"))
    p = product_dim.select(F.col("product_id"), F.col("product_id").alias("product_key"))
    out = out.join(c, "customer_id", "left").join(p, "product_id", "left")
    return out.select(
        "order_id", "customer_id", "product_id", F.coalesce("customer_key", F.lit(-1)).alias("customer_key"), F.coalesce("product_key", F.lit(-1)).alias("product_key"), "quantity", "total_amount", "currency", "amount_usd",
        "status", "order_date", F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_key"), F.year("order_date").alias("year"), F.month("order_date").alias("month"),
    )


def fact_order_events(events: DataFrame, customer_dim: DataFrame, orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Events with the key of the customer version valid at the event (-1 where there is none), the amount in dollars at
    the last rate known by then (as it is without one), and the order context as of the event: the customer's last order
    at or before it, that order's number, and the days since. No later order is seen.

    Customers hold few rows each; currencies are few and so hold many, which is why rates are carried by month."""
    count = F.row_number().over(Window.partitionBy("customer_id").orderBy("order_date", "order_id"))
    past = orders.where("order_date is not null").select("customer_id", F.col("order_id").alias("last_order_id"), F.col("order_date").alias("last_order_date"), count.alias("order_number"))
    out = as_of(events, past, ["customer_id"], "event_ts", "last_order_date", ["last_order_id", "last_order_date", "order_number"], order=["last_order_id"])
    out = with_member_at(out, customer_dim, "customer_id", "customer_sk", "event_ts")
    out = as_of(out, rates, ["currency"], "event_ts", "rate_date", ["usd_rate"], split="month")
    usd = F.when(F.col("currency") == "USD", F.col("amount")).otherwise(F.col("amount") * F.coalesce("usd_rate", F.lit(1.0)))
    return out.withColumns({"amount_usd": usd, "days_since_order": F.datediff("event_ts", "last_order_date"), "orders_before": F.coalesce("order_number", F.lit(0))}).drop("usd_rate", "order_number")


def order_metrics(facts: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Facts hold an order once (the silver step sees to it), so orders are counted without a distinct."""
    return facts.groupBy(*keys).agg(
        F.sum("amount_usd").alias("revenue_usd"), F.count("order_id").alias("orders"), F.avg("amount_usd").alias("avg_order_usd"),
        F.max("order_date").alias("last_order"), F.min("order_date").alias("first_order"),
    )


def behaviour_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.sum("amount").alias("event_value"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"))


def customer_360(customers: DataFrame, facts: DataFrame | None, events: DataFrame | None) -> DataFrame:
    """Profile, order and behaviour metrics; zeros (and NULL dates) where an input is absent."""
    out = customers
    numbers = {"revenue_usd": "double", "orders": "long", "avg_order_usd": "double", "event_value": "double", "sessions": "long", "events": "long"}
    if facts is not None:
        out = out.join(order_metrics(facts), "customer_id", "left")
    if events is not None:
        out = out.join(behaviour_metrics(events), "customer_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(k) if c in out.columns else F.lit(0).cast(k) for c, k in numbers.items()})
    out = out.withColumns({c: F.lit(None).cast("date") for c in ("first_order", "last_order") if c not in out.columns})
    return out.withColumn("lifetime_value_usd", F.col("revenue_usd") * 1.5)


def product_performance(products: DataFrame, facts: DataFrame) -> DataFrame:
    """Sales of each product; facts hold an order once. Buyers are counted by a first aggregate of (product, customer), so
    nothing is expanded for a distinct count."""
    pairs = facts.groupBy("product_id", "customer_id").agg(F.sum("quantity").alias("units"), F.sum("amount_usd").alias("revenue_usd"), F.count("order_id").alias("orders"))
    sold = pairs.groupBy("product_id").agg(F.sum("units").alias("units"), F.sum("revenue_usd").alias("revenue_usd"), F.sum("orders").alias("orders"), F.count("customer_id").alias("buyers"))
    out = products.join(sold, "product_id", "left").fillna(0, ["units", "revenue_usd", "orders", "buyers"])
    return out.withColumn("is_active", F.col("orders") > 0)


def attribution(customers: DataFrame, facts: DataFrame, spend: DataFrame, channel: str) -> DataFrame:
    """Revenue, buyers and return on spend of each channel; no division by a zero spend."""
    got = customers.select("customer_id", channel).join(order_metrics(facts), "customer_id", "left").groupBy(channel)
    out = got.agg(F.count("*").alias("customers"), F.coalesce(F.sum("revenue_usd"), F.lit(0.0)).alias("revenue_usd")).join(spend, channel, "left")
    out = out.withColumns({"revenue_per_customer": F.try_divide("revenue_usd", "customers"), "roi": F.try_divide(F.col("revenue_usd") - F.col("spend"), F.col("spend")), "payback": F.try_divide("spend", "revenue_usd")})
    return out.withColumn("tier", banded(F.col("roi"), [(0, "loss"), (10, "fair")], "strong", "unknown"))
