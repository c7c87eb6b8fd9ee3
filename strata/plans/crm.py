"""CRM tables: cleaning under any of their column names, dimensions and the opportunity fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import canonical_text, coalesced, digits, filled, parsed_date, resolve
from ..operators.relational import latest, newest
from .marts import with_member


def _text(df: DataFrame, *names: str, case: str = "keep") -> Column:
    return canonical_text(coalesced(df, names), case)


def _date(df: DataFrame, *names: str) -> Column:
    c = coalesced(df, names)
    return F.coalesce(c.try_cast("date"), parsed_date(c.cast("string")))


def accounts_silver(df: DataFrame) -> DataFrame:
    out = df.select(
        resolve(df, ["account_id", "AccountId", "Id"], required=True).alias("account_id"), _text(df, "account_name", "Name").alias("account_name"), filled(_text(df, "account_type", "Type", case="lower"), "unknown").alias("account_type"),
        filled(_text(df, "industry", "Industry", case="lower"), "unknown").alias("industry"), filled(_text(df, "country", "BillingCountry", case="upper"), "UNKNOWN").alias("country"),
        coalesced(df, ["annual_revenue", "AnnualRevenue"], "double").try_cast("double").alias("annual_revenue"), _date(df, "created_date", "CreatedDate").alias("created_date"),
    )
    return latest(out.where("account_id is not null"), ["account_id"], newest("created_date"))


def contacts_silver(df: DataFrame) -> DataFrame:
    out = df.select(
        resolve(df, ["contact_id", "ContactId", "Id"], required=True).alias("contact_id"), resolve(df, ["account_id", "AccountId"]).alias("account_id"), _text(df, "first_name", "FirstName").alias("first_name"),
        _text(df, "last_name", "LastName").alias("last_name"), _text(df, "email", "Email", case="lower").alias("email"), digits(_text(df, "phone", "Phone")).alias("phone"), _date(df, "created_date", "CreatedDate").alias("created_date"),
    )
    return latest(out.where("contact_id is not null"), ["contact_id"], newest("created_date"))


def opportunities_silver(df: DataFrame) -> DataFrame:
    out = df.select(
        resolve(df, ["opportunity_id", "OpportunityId", "Id"], required=True).alias("opportunity_id"), resolve(df, ["account_id", "AccountId"]).alias("account_id"), resolve(df, ["contact_id", "ContactId"]).alias("contact_id"),
        filled(_text(df, "stage", "StageName", case="lower"), "unknown").alias("stage"), coalesced(df, ["amount", "Amount"], "double").try_cast("double").alias("amount"), _date(df, "close_date", "CloseDate").alias("close_date"),
    )
    return latest(out.where("opportunity_id is not null"), ["opportunity_id"], newest("close_date"))


def contact_dimension(contacts: DataFrame, account_dim: DataFrame) -> DataFrame:
    """Contacts with the hashed key of their account's current version, -1 where there is none."""
    return with_member(contacts, account_dim, "account_id", "account_key")


def fact_opportunity(opportunities: DataFrame, account_dim: DataFrame, contact_dim: DataFrame) -> DataFrame:
    """Opportunities with the hashed keys of the account's and contact's current versions (-1 where there is none)."""
    out = with_member(with_member(opportunities, account_dim, "account_id", "account_key"), contact_dim, "contact_id", "contact_key")
    return out.withColumns({"close_date_key": F.date_format("close_date", "yyyyMMdd").cast("int"), "close_year": F.year("close_date"), "close_month": F.month("close_date")})
