"""Masking, PII search and classification as column expressions: no Python workers, one pass whatever the number of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as personal data in a text. Patterns use no look-around, so any engine reads them alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}


def mask_email(c: Column) -> Column:
    """First character and domain stay; text without an @ is masked whole."""
    at = F.locate("@", c)
    return F.when(at > 1, F.concat(F.substring(c, 1, 1), F.lit("***"), F.regexp_extract(c, "(@.*)$", 1))).when(c.isNotNull(), "***")


def mask_phone(c: Column) -> Column:
    """Only the last four digits stay."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 4, F.concat(F.lit("***-***-"), F.right(d, F.lit(4)))).when(c.isNotNull(), "***")


def mask_name(c: Column) -> Column:
    """The first character, then stars."""
    return F.when(F.length(c) > 1, F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), F.length(c) - 1))).when(c.isNotNull(), "*")


def mask_ssn(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 9, F.concat(F.lit("***-**-"), F.right(d, F.lit(4)))).when(c.isNotNull(), "***")


def mask_card(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 12, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).when(c.isNotNull(), "****")


def mask_ip(c: Column) -> Column:
    """The last two parts of an address go."""
    return F.when(c.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.regexp_replace(c, r"^([0-9]+\.[0-9]+)\..*$", "$1.*.*")).when(c.isNotNull(), "***")


def mask_partial(c: Column, shown: int = 2) -> Column:
    return F.when(F.length(c) > shown, F.concat(F.substring(c, 1, shown), F.repeat(F.lit("*"), F.length(c) - shown))).otherwise(c)


def hashed(c: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


METHODS = {"email": mask_email, "phone": mask_phone, "name": mask_name, "ssn": mask_ssn, "card": mask_card, "ip": mask_ip, "partial": mask_partial, "hash": hashed, "nullify": lambda c: F.lit(None).cast("string")}


def masked(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Columns masked by method; rules for absent columns are ignored."""
    return df.withColumns({c: METHODS[m](F.col(c)) for c, m in rules.items() if c in df.columns})


def masked_by_name(df: DataFrame, as_of: Column, version: str = "v1") -> DataFrame:
    """Every column masked by what its name says, and audit columns."""
    kinds = {"email": "email", "phone": "phone", "ssn": "ssn", "card": "card", "ip_address": "ip", "_name": "name"}
    rules = {}
    for c in df.columns:
        kind = next((m for part, m in kinds.items() if part in c.lower() or c.lower() == part.strip("_")), None)
        if kind:
            rules[c] = kind
    return masked(df, rules).withColumns({"_masked_at": as_of, "_mask_version": F.lit(version)})


def pii_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, pii_type, matches, share): all columns and patterns counted in one aggregate."""
    columns = list(columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"])
    cells = [(c, p) for c in columns for p in PATTERNS]
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).rlike(PATTERNS[p])).alias(f"m{k}") for k, (c, p) in enumerate(cells)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("pii_type"), F.col(f"m{k}").alias("matches")) for k, (c, p) in enumerate(cells)]
    told = sums.select("n", F.explode(F.array(*rows)).alias("r")).select("r.*", "n")
    return told.select("column_name", "pii_type", "matches", F.coalesce(F.try_divide("matches", "n"), F.lit(0.0)).alias("share"))


SENSITIVE_NAMES = {"restricted": ("ssn", "card", "password", "secret"), "confidential": ("email", "phone", "name", "address", "birth"), "internal": ("acctbal", "balance", "salary", "amount", "price")}


def classify(df: DataFrame, share: float = 0.1) -> DataFrame:
    """(column_name, sensitivity): by name, else confidential where more than ``share`` of values hold personal data."""
    by_name = {c: next((k for k, parts in SENSITIVE_NAMES.items() if any(p in c.lower() for p in parts)), None) for c in df.columns}
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and by_name[f.name] is None]
    spark = df.sparkSession
    named = spark.createDataFrame([(c, k or "public") for c, k in by_name.items() if c not in texts], "column_name string, sensitivity string")
    if not texts:
        return named
    found = pii_report(df, texts).groupBy("column_name").agg(F.max("share").alias("s"))
    return named.unionByName(found.select("column_name", F.when(F.col("s") > share, "confidential").otherwise("public").alias("sensitivity")))


def anonymize(df: DataFrame, sensitivity: Mapping[str, str], salt: str = "") -> DataFrame:
    """Restricted columns go to NULL, confidential ones are hashed, internal numbers are cut to hundreds."""
    new = {}
    for c, level in sensitivity.items():
        if c not in df.columns or level == "public":
            continue
        numeric = df.schema[c].dataType.typeName() in ("double", "float", "integer", "long", "decimal")
        if level == "restricted":
            new[c] = F.lit(None).cast(df.schema[c].dataType)
        elif level == "confidential":
            new[c] = hashed(F.col(c), salt)
        else:
            new[c] = F.floor(F.col(c) / 100) * 100 if numeric else mask_partial(F.col(c))
    return df.withColumns(new)
