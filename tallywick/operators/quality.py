"""Data quality: schema checks, violation counts, expectations, column profiles and cross-layer validation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, NumericType

from ..schemas import CHECKED_SCHEMAS, WEIGHTS

CHECK = "name string, severity string, violations long"


def schema_checks(tables: Mapping[str, DataFrame]) -> list[dict]:
    out = []
    for name, expected in CHECKED_SCHEMAS.items():
        actual = tables[name].columns if name in tables else []
        out.append({"name": f"schema_{name}", "severity": "critical", "success": actual == expected, "violations": int(actual != expected), "observed": actual})
    return out


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows exceed the first of each key; nulls are equal to each other."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))


def orphans(rows: DataFrame, parents: DataFrame, on: Column) -> DataFrame:
    return rows.join(parents, on, "left_anti").agg(F.count("*").alias("violations"))


def _named(name: str, severity: str, one: DataFrame) -> DataFrame:
    return one.select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.col("violations"))


def _counted(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All checks of a table from one scan, as rows."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit("critical").alias("severity"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")


def missing(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def violations(t: Mapping[str, DataFrame]) -> DataFrame:
    """(name, severity, violations, success): every check as a row of one DataFrame."""
    event = F.col("event_type")
    buys = event == "transaction"
    parts = [
        _counted(t["bronze_events"], {"missing_bronze_event_keys": missing("timestamp", "visitorid", "itemid", "event")}),
        _named("duplicate_bronze_events", "warning", duplicates(t["bronze_events"], ["timestamp", "visitorid", "event", "itemid", "transactionid"])),
        _counted(t["silver_user_events"], {
            "invalid_silver_event_types": ~event.isin(*WEIGHTS) | event.isNull(),
            "missing_silver_event_keys": missing("visitor_id", "item_id", "event_timestamp_ms", "event_timestamp"),
            "transaction_id_consistency": (buys & F.col("transaction_id").isNull()) | (~buys & F.col("transaction_id").isNotNull()),
        }),
        _counted(t["silver_products"], {"availability_domain": ~F.col("available").isin(0, 1)}),
        _named("duplicate_silver_products", "critical", t["silver_products"].agg((F.count("*") - F.count_distinct("item_id")).alias("violations"))),
        _named("orphan_event_items", "warning", t["silver_user_events"].alias("e").join(t["silver_products"].alias("p"), F.col("e.item_id") == F.col("p.item_id"), "left_anti").agg(F.count("*").alias("violations"))),
        _named("orphan_parent_categories", "warning", t["silver_category_hierarchy"].where(F.col("parent_category_id").isNotNull()).alias("c").join(t["silver_category_hierarchy"].alias("p"), F.col("c.parent_category_id") == F.col("p.category_id"), "left_anti").agg(F.count("*").alias("violations"))),
        _counted(t["bronze_item_properties"], {"missing_property_values": missing("timestamp", "itemid", "property", "value") | (F.col("value") == "")}),
        _named("duplicate_gold_user_items", "critical", duplicates(t["gold_user_item_features"], ["visitor_id", "item_id"])),
        _counted(t["gold_user_item_features"], {"interaction_score_formula": F.col("interaction_score") != F.col("view_count") + 3 * F.col("cart_count") + 5 * F.col("purchase_count")}),
        _counted(t["gold_item_features"], {"missing_gold_vectors": F.col("item_feature_vector").isNull()}),
    ]
    bronze, silver = (t[n].agg(F.count("*").alias("n")) for n in ("bronze_events", "silver_user_events"))
    parts.append(_named("bronze_to_silver_rejections", "information", bronze.select(F.col("n").alias("b")).join(silver).select(F.greatest(F.lit(0), F.col("b") - F.col("n")).cast("long").alias("violations"))))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("success", (F.col("violations") == 0) | (F.col("severity") == "information"))


@dataclass(frozen=True)
class Expectation:
    table: str
    kind: str  # not_null, unique, in_set, at_least
    column: str
    argument: tuple = ()


# The twelve expectations.
EXPECTATIONS = (
    Expectation("silver_user_events", "not_null", "visitor_id"),
    Expectation("silver_user_events", "not_null", "item_id"),
    Expectation("silver_user_events", "not_null", "event_timestamp_ms"),
    Expectation("silver_user_events", "in_set", "event_type", tuple(WEIGHTS)),
    Expectation("silver_products", "not_null", "item_id"),
    Expectation("silver_products", "unique", "item_id"),
    Expectation("silver_products", "in_set", "available", (0, 1)),
    Expectation("gold_user_item_features", "not_null", "visitor_id"),
    Expectation("gold_user_item_features", "not_null", "item_id"),
    Expectation("gold_user_item_features", "at_least", "interaction_score", (1,)),
    Expectation("gold_item_features", "unique", "item_id"),
    Expectation("gold_item_features", "not_null", "item_feature_vector"),
)


def expectations(tables: Mapping[str, DataFrame], wanted: tuple[Expectation, ...] = EXPECTATIONS) -> DataFrame:
    """(dataset, expectation, column, unexpected_count, success); nulls are only unexpected to not_null."""
    parts = []
    for e in wanted:
        rows, c = tables[e.table], F.col(e.column)
        if e.kind == "unique":
            again = rows.where(c.isNotNull()).groupBy(e.column).agg(F.count("*").alias("n")).where("n > 1")
            one = again.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("unexpected_count"))
        else:
            bad = {"not_null": c.isNull(), "in_set": ~c.isin(*e.argument) if e.argument else F.lit(False), "at_least": c < (e.argument or (0,))[0]}[e.kind]
            one = rows.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("unexpected_count"))
        parts.append(one.select(F.lit(e.table).alias("dataset"), F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column"), "unexpected_count"))
    return reduce(DataFrame.unionByName, parts).withColumn("success", F.col("unexpected_count") == 0)


def column_profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, missing, distinct, minimum, maximum, mean) from one scan; numbers only have the last three. Maps are counted by their entries."""
    wanted = []
    for field in rows.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        c = F.col(f"`{field.name}`")
        value = F.sort_array(F.map_entries(c)) if isinstance(field.dataType, MapType) else c
        number = c.cast("double") if isinstance(field.dataType, NumericType) else F.lit(None).cast("double")
        wanted.append(F.struct(F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("dtype"), F.count_if(c.isNull()).alias("missing"), F.count_distinct(value).alias("distinct"), F.min(number).alias("minimum"), F.max(number).alias("maximum"), F.avg(number).alias("mean")))
    return rows.agg(F.array(*wanted).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def table_profile(full: DataFrame, sampled: DataFrame) -> dict:
    """Sizes of a table and its sample, repeated rows and missing cells of the sample, and its columns."""
    plain = [F.sort_array(F.map_entries(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in sampled.schema.fields]
    columns = [r.asDict() for r in column_profile(sampled).collect()]
    n, different = sampled.count(), sampled.select(*plain).distinct().count()
    return {"full_row_count": full.count(), "sample_row_count": n, "sample_duplicate_rows": n - different, "sample_missing_values": sum(c["missing"] for c in columns), "columns": columns}


def sample(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows in key order, so that reruns profile the same rows."""
    if n < 1:
        raise ValueError("a sample has at least one row")
    return rows.orderBy(*keys).limit(n)


def overall(checks: DataFrame, expected: DataFrame, schemas: list[dict]) -> dict:
    """Success: no critical check failed and every expectation held; warnings do not block."""
    critical = checks.where((F.col("severity") == "critical") & ~F.col("success")).count() + sum(not s["success"] for s in schemas)
    failed = expected.where(~F.col("success")).count()
    warnings = checks.where((F.col("severity") == "warning") & ~F.col("success")).count()
    return {"success": critical == 0 and failed == 0, "critical_failures": critical, "warning_failures": warnings, "failed_expectations": failed}


def report(checks: DataFrame, expected: DataFrame, summary: dict) -> str:
    """A Markdown report; as many lines as there are checks."""
    lines = ["# Data quality", "", f"Success: {summary['success']}", "", "| check | severity | violations | success |", "|-|-|-:|-|"]
    lines += [f"| {r['name']} | {r['severity']} | {r['violations']} | {r['success']} |" for r in checks.orderBy("name").collect()]
    lines += ["", "| dataset | expectation | column | unexpected | success |", "|-|-|-|-:|-|"]
    lines += [f"| {r['dataset']} | {r['expectation']} | {r['column']} | {r['unexpected_count']} | {r['success']} |" for r in expected.orderBy("dataset", "expectation", "column").collect()]
    return "\n".join(lines) + "\n"


def validate(t: Mapping[str, DataFrame]) -> DataFrame:
    """(check, success): five checks of the layers, and four of the feature tables where all three are given."""
    gold, items = t["gold_user_item_features"], t["gold_item_features"]
    ones = [
        t["silver_user_events"].agg((F.count_if(~F.col("event_type").isin(*WEIGHTS)) == 0).alias("valid_event_types")),
        t["silver_products"].agg((F.count("*") == F.count_distinct("item_id")).alias("unique_products")),
        gold.groupBy("visitor_id", "item_id").agg(F.count("*").alias("n")).agg((F.count_if(F.col("n") > 1) == 0).alias("unique_user_items")),
        gold.agg((F.count_if(F.col("interaction_score") != F.col("view_count") + 3 * F.col("cart_count") + 5 * F.col("purchase_count")) == 0).alias("scores_match")),
        items.agg((F.count_if(F.col("item_feature_vector").isNull()) == 0).alias("vectors_present")),
    ]
    if {"feature_user_activity", "feature_item_popularity", "feature_item_cooccurrence"} <= set(t):
        users, popular, near = t["feature_user_activity"], t["feature_item_popularity"], t["feature_item_cooccurrence"]
        count = lambda rows, name: rows.agg(F.count("*").alias(name))
        ones += [
            count(users, "a").join(gold.agg(F.count_distinct("visitor_id").alias("b"))).select((F.col("a") == F.col("b")).alias("feature_users_complete")),
            count(popular, "a").join(count(items, "b")).select((F.col("a") == F.col("b")).alias("feature_items_complete")),
            users.agg((F.count_if(F.col("avg_interaction_score").isNull()) == 0).alias("feature_scores_present")),
            near.agg((F.count_if((F.col("neighbor_rank") < 1) | F.col("similarity").isNull()) == 0).alias("feature_cooccurrence_ranked")),
        ]
    rows = [o.select(F.lit(o.columns[0]).alias("check"), F.col(o.columns[0]).alias("success")) for o in ones]
    return reduce(DataFrame.unionByName, rows)
