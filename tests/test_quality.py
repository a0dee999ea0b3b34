import math

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from layerwright.literacy import FACT_RULES, MART_RULES, entities
from layerwright.operators import QualityError, evaluate, gate, quality_report
from layerwright.operators.quality import counters
from layerwright.sources import stage
from layerwright.spec import Rule, ruleset


def verdict(df, *rules):
    return [(o.measured, o.passed) for o in evaluate({"t": (df, rules)})["t"]]


def values(spark, *data, dtype="double"):
    return spark.createDataFrame([(v,) for v in data], f"v {dtype}")


def test_not_null_counts_null_but_not_nan(spark):
    assert verdict(values(spark, 1.0, None, math.nan, None), Rule("not_null", "v")) == [(2, False)]
    assert verdict(values(spark, math.nan), Rule("not_null", "v")) == [(0, True)]


def test_min_count(spark):
    df = values(spark, 1.0, 2.0)
    assert verdict(df, Rule("min_count", minimum=2), Rule("min_count", minimum=3)) == [(2, True), (2, False)]
    assert verdict(df.where("false"), Rule("min_count", minimum=1)) == [(0, False)]


def test_unique_takes_null_as_one_value(spark):
    unique = Rule("unique", "v")
    assert verdict(values(spark, 1, None, 2, dtype="int"), unique) == [(0, True)]
    assert verdict(values(spark, 1, None, None, dtype="int"), unique) == [(1, False)]
    assert verdict(values(spark, 1, 1, 1, 2, dtype="int"), unique) == [(2, False)]
    assert verdict(values(spark, dtype="int"), unique) == [(0, True)]


def test_range_is_inclusive_passes_null_and_fails_nan(spark):
    bounds = Rule("range", "v", bounds=(0, 100))
    assert verdict(values(spark, 0.0, 100.0, None), bounds) == [(0, True)]
    assert verdict(values(spark, -0.01, 100.01, math.nan), bounds) == [(3, False)]
    assert verdict(values(spark, "5", "101", "x", None, dtype="string"), bounds) == [(1, False)]


def test_missing_column_fails(spark):
    df = values(spark, 1.0)
    rules = [Rule(k, "gone", bounds=(0, 1)) for k in ("not_null", "range", "unique")]
    assert verdict(df, *rules, Rule("not_null", "v")) == [(None, False)] * 3 + [(0, True)]
    assert rows(quality_report(df, rules))[0] == (0, "not_null", "gone", None, False)


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        quality_report(values(spark, 1.0), [Rule("odd", "v")])


def test_staged_counts_equal_fresh_ones(spark):
    df = spark.range(50).select(
        F.nullif(F.col("id") % 7, F.lit(3)).alias("v"), (F.col("id") * 1.5).alias("w")
    )
    rules = ruleset(required=("v", "gone"), unique=("v",), ranges={(0, 10): ("w",)})
    staged = stage(df, "q", counters(df, rules))
    assert evaluate({"t": (staged, rules)}) == evaluate({"t": (df, rules)})


def test_gate_names_table_and_rule(spark):
    outcomes = evaluate({"good": (values(spark, 1.0), ruleset(required=("v",))), "bad": (values(spark, None), ruleset(required=("v",)))})
    with pytest.raises(QualityError, match=r"bad: not_null\(v\) measured 1"):
        gate(outcomes)
    gate({"good": outcomes["good"]})


def test_all_algebraic_rules_share_one_scan(spark):
    fact = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = ruleset(
        required=("l_orderkey", "l_partkey", "l_suppkey"),
        ranges={(0, 100): ("l_quantity", "l_tax", "l_discount"), (0, 10**6): ("l_extendedprice",)},
    )
    text = plan(quality_report(fact, rules))
    assert text.count("FileScan") == 1
    with_unique = plan(quality_report(fact, (*rules, Rule("unique", "l_orderkey"))))
    assert with_unique.count("FileScan") == 2
    assert "ReadSchema: struct<l_orderkey:bigint>" in with_unique


def test_rule_counts_per_layer():
    sizes = [sum(len(rules) for rules in layer) for layer in (
        [e.rules for e in entities().values()], FACT_RULES.values(), MART_RULES.values()
    )]
    assert sizes == [24, 40, 29]
