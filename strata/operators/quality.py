"""Contracts and rules. All counters of a table come from one aggregate; keys need one grouping, each parent one anti-join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from .relational import orphans

REPORT = "rule string, target string, severity string, failed long, total long"


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, range, positive, in_set, pattern, expression, max_length, not_future or reference."""

    kind: str
    target: str
    severity: str = "critical"
    low: object = None
    high: object = None
    values: Sequence[object] = ()
    text: str = ""
    parent: str = ""
    parent_key: str = ""

    def failing(self, as_of: Column | None = None) -> Column | None:
        """The predicate of rows that break the rule, where a row alone tells. NULLs break not_null only."""
        c = F.col(self.target) if self.kind != "expression" else None
        fails = {
            "not_null": lambda: c.isNull(),
            "range": lambda: reduce(lambda a, b: a | b, [x for x in (c < self.low if self.low is not None else None, c > self.high if self.high is not None else None) if x is not None]),
            "positive": lambda: c <= 0,
            "in_set": lambda: ~c.isin(*self.values),
            "pattern": lambda: ~c.rlike(self.text),
            "max_length": lambda: F.length(c) > self.high,
            "not_future": lambda: c > as_of,
            "expression": lambda: ~F.expr(self.text),
        }.get(self.kind)
        return None if fails is None else F.coalesce(fails(), F.lit(False))


def evaluate(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None, as_of: Column | None = None) -> DataFrame:
    """(rule, target, severity, failed, total) for every rule. Row rules and references are counted by one aggregate over
    the table, joined to the distinct keys of its parents; each uniqueness rule is a grouping of its own."""
    one_pass, marked, cells = [r for r in rules if r.kind != "unique"], df, []
    for k, r in enumerate(one_pass):
        if r.kind == "reference":
            keys = (parents or {})[r.parent].select(F.col(r.parent_key).alias(f"_parent{k}")).distinct()
            marked = marked.join(keys, marked[r.target] == keys[f"_parent{k}"], "left")
    for k, r in enumerate(one_pass):
        fails = F.col(f"_parent{k}").isNull() if r.kind == "reference" else r.failing(as_of)
        cells.append(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.target).alias("target"), F.lit(r.severity).alias("severity"), F.count_if(fails).alias("failed")))
    out = marked.agg(F.array(*cells).alias("c"), F.count("*").alias("total")).select(F.explode("c").alias("c"), "total").select("c.*", "total") if cells else None
    for r in rules:
        if r.kind == "unique":
            keys = [k.strip() for k in r.target.split(",")]
            one = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("failed"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
            one = one.select(F.lit(r.kind).alias("rule"), F.lit(r.target).alias("target"), F.lit(r.severity).alias("severity"), "failed", "total")
            out = one if out is None else out.unionByName(one)
    return out


def accuracy_and_timeliness(df: DataFrame, rules: Sequence[Rule], ts: str, as_of: Column, most_hours: float = 24.0) -> DataFrame:
    """(dimension, name, violations, total, score): the share of rows that keep each range or pattern rule, below and above
    a range told apart, and the share of rows at most so many hours old; one aggregate. An empty table scores 0.

    Times may be timestamps, dates or text; rows without a readable time are not timely, and NULLs break no rule."""
    cells, total = [], F.count(F.lit(1))
    row = lambda dimension, name, bad: F.struct(F.lit(dimension).alias("dimension"), F.lit(name).alias("name"), bad.alias("violations"), total.alias("total"), F.coalesce(F.try_divide(total - bad, total), F.lit(0.0)).alias("score"))
    for r in rules:
        if r.kind not in ("range", "pattern"):
            raise ValueError(f"{r.kind} is no rule of accuracy")
        cells.append(row("accuracy", f"{r.kind}:{r.target}", F.count_if(r.failing())))
        for bound, name in ((r.low, "below"), (r.high, "above")):
            if r.kind == "range" and bound is not None:
                past = F.col(r.target) < bound if name == "below" else F.col(r.target) > bound
                cells.append(row("accuracy", f"{name}:{r.target}", F.count_if(past)))
    at = F.try_to_timestamp(F.col(ts).cast("string")) if df.schema[ts].dataType.simpleString() == "string" else F.col(ts).cast("timestamp")
    late = F.coalesce(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at) > F.lit(int(most_hours * 3_600_000_000)), F.lit(True))
    cells.append(row("timeliness", f"{ts}:{most_hours:g}h", F.count_if(late)))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@dataclass(frozen=True)
class Contract:
    required: Sequence[str]
    primary_key: Sequence[str]
    ranges: Mapping[str, tuple[object, object]] = field(default_factory=dict)
    references: Sequence[tuple[str, str, str]] = ()  # column, parent table, its key

    def rules(self) -> list[Rule]:
        out = [Rule("not_null", c) for c in dict.fromkeys([*self.required, *self.primary_key])]
        out.append(Rule("unique", ",".join(self.primary_key)))
        out += [Rule("range", c, low=a, high=b) for c, (a, b) in self.ranges.items()]
        return out + [Rule("reference", c, parent=p, parent_key=k) for c, p, k in self.references]


def check_contract(df: DataFrame, contract: Contract, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The report; absent required columns raise at once."""
    absent = [c for c in {*contract.required, *contract.primary_key} if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {sorted(absent)}")
    return evaluate(df, contract.rules(), parents)


def enforce_contract(df: DataFrame, contract: Contract, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df``, or an error naming the rules that fail."""
    failed = check_contract(df, contract, parents).where("failed > 0").collect()  # a row for each rule
    if failed:
        raise ValueError("; ".join(f"{r['rule']} {r['target']}: {r['failed']} of {r['total']}" for r in failed))
    return df


def tagged(df: DataFrame, rules: Sequence[Rule], name: str = "_errors") -> DataFrame:
    """Every row with the row rules it breaks."""
    cells = [F.when(r.failing(), f"{r.kind}:{r.target}") for r in rules if r.failing() is not None]
    return df.withColumn(name, F.array_compact(F.array(*cells)))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected with ``_errors``): together the input."""
    marked = tagged(df, rules)
    return marked.where(F.size("_errors") == 0).drop("_errors"), marked.where(F.size("_errors") > 0)


def gate(df: DataFrame, rules: Sequence[Rule], parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row: rules, rules failed by severity, and whether the table passes (no critical failure)."""
    report = evaluate(df, rules, parents)
    bad = lambda s: F.count_if((F.col("failed") > 0) & (F.col("severity") == s))
    return report.agg(F.count("*").alias("rules"), bad("critical").alias("critical_failed"), bad("warning").alias("warning_failed"), (bad("critical") == 0).alias("passed"))


def thresholds(df: DataFrame, key: Sequence[str], columns: Sequence[str], ts: str, as_of: Column) -> DataFrame:
    """One row of a table's size, largest NULL share, hours since the newest row, and share of repeated keys."""
    one = df.agg(F.count("*").alias("row_count"), F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in columns]).alias("max_null_share"), F.max(ts).alias("newest")) if len(columns) > 1 else df.agg(F.count("*").alias("row_count"), F.avg(F.col(columns[0]).isNull().cast("double")).alias("max_null_share"), F.max(ts).alias("newest"))
    keys = df.groupBy(*key).count().agg(F.try_divide(F.sum(F.col("count") - 1), F.sum("count")).alias("duplicate_share"))
    hours = (F.unix_seconds(as_of) - F.unix_seconds(F.col("newest").cast("timestamp"))) / 3600.0
    return one.join(F.broadcast(keys)).withColumn("age_hours", F.round(hours, 4)).drop("newest")


def assert_row_drop(before: int, after: int, most: float) -> None:
    if before and (before - after) / before > most:
        raise ValueError(f"{before - after} of {before} rows were dropped; at most a share of {most} may be")


# --- schemas: no data is read -------------------------------------------------------------------------------------

_WIDER = {("integer", "long"), ("float", "double"), ("integer", "double"), ("date", "timestamp")}


def schema_diff(actual: StructType, expected: StructType) -> dict[str, list[str]]:
    """Names that are missing, extra, or of another type."""
    have = {f.name: f.dataType for f in actual}
    return {
        "missing": [f.name for f in expected if f.name not in have],
        "extra": [f.name for f in actual if f.name not in expected.fieldNames()],
        "mismatched": [f.name for f in expected if f.name in have and have[f.name] != f.dataType],
    }


def widens(old: StructField, new: StructField) -> bool:
    a, b = old.dataType, new.dataType
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
    return a == b or (a.typeName(), b.typeName()) in _WIDER


def check_evolution(baseline: StructType, current: StructType, allow_new: bool = True) -> list[str]:
    """What breaks between two schemas: missing columns, narrowed types, loosened NULLs, and new columns if not allowed."""
    now = {f.name: f for f in current}
    out = [f"missing: {f.name}" for f in baseline if f.name not in now]
    for f in baseline:
        if f.name in now:
            if not widens(f, now[f.name]):
                out.append(f"type: {f.name} {f.dataType.simpleString()} -> {now[f.name].dataType.simpleString()}")
            if not f.nullable and now[f.name].nullable:
                out.append(f"nullable: {f.name}")
    return out + ([] if allow_new else [f"new: {c}" for c in now if c not in baseline.fieldNames()])


CONTRACT_TYPES = {"string": "string", "int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "array": "array<string>", "map": "map<string,string>"}


def declared_schema(columns: Sequence[Mapping[str, object]]) -> StructType:
    """A StructType from a declared list of name, type and nullability."""
    kinds = [(str(c["name"]), str(c["type"]).lower(), bool(c.get("nullable", True))) for c in columns]
    return StructType([StructField(n, StructType.fromDDL(f"x {k if k.startswith('decimal') else CONTRACT_TYPES[k]}")[0].dataType, null) for n, k, null in kinds])


# --- dates, samples, reports --------------------------------------------------------------------------------------


def date_realism(df: DataFrame, columns: Sequence[str], as_of: Column, future_days: int = 1, past_years: int = 10) -> DataFrame:
    """(column_name, present, unparsable, future, old): every date-like column in one aggregate; text is parsed."""
    cells = []
    for k, c in enumerate(columns):
        day = F.to_date(F.try_to_timestamp(F.col(c).cast("string")))
        cells += [
            F.count(F.col(c)).alias(f"present{k}"), F.count_if(F.col(c).isNotNull() & day.isNull()).alias(f"unparsable{k}"),
            F.count_if(day > F.date_add(as_of, future_days)).alias(f"future{k}"), F.count_if(day < F.add_months(as_of, -12 * past_years)).alias(f"old{k}"),
        ]
    one = df.agg(*cells)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{k}").alias(n) for n in ("present", "unparsable", "future", "old")]) for k, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def freshness(tables: Mapping[str, tuple[DataFrame, str, float]], as_of: Column) -> DataFrame:
    """(table_name, newest, age_hours, fresh): each table's newest row against the hours it may lag."""
    out = None
    for name, (df, ts, hours) in tables.items():
        one = df.agg(F.max(F.col(ts).cast("timestamp")).alias("newest")).select(F.lit(name).alias("table_name"), "newest")
        one = one.withColumn("age_hours", (F.unix_seconds(as_of) - F.unix_seconds("newest")) / 3600.0).withColumn("fresh", F.coalesce(F.col("age_hours") <= hours, F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


def orphan_sample(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, n: int = 100) -> DataFrame:
    """Up to n keys without a parent, the smallest first, with their rows."""
    return orphans(child, parent, child_key, parent_key).groupBy(child_key).agg(F.count("*").alias("child_rows")).orderBy(F.col(child_key).asc_nulls_first()).limit(n)


def expectations(df: DataFrame, wanted: Sequence[Mapping[str, object]]) -> DataFrame:
    """Declared expectations (not_null, unique, between, in_set, type) as a report; types are read off the schema."""
    rules, typed = [], []
    for e in wanted:
        kind, column = str(e["kind"]), e["column"]
        if kind == "type":
            typed.append((f"type:{e['type']}", str(column), df.schema[column].dataType.simpleString() == e["type"]))
        elif kind == "between":
            rules.append(Rule("range", column, low=e.get("low"), high=e.get("high")))
        else:
            rules.append(Rule(kind, column if isinstance(column, str) else ",".join(column), values=e.get("values", ())))
    out = evaluate(df, rules).select(F.concat_ws(":", "rule", "target").alias("expectation"), (F.col("failed") == 0).alias("met")) if rules else None
    for kind, column, met in typed:
        one = df.sparkSession.range(1).select(F.lit(f"{kind}:{column}").alias("expectation"), F.lit(met).alias("met"))
        out = one if out is None else out.unionByName(one)
    return out
