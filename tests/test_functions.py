import hashlib
import math

import pytest
from pyspark.sql import functions as F

from layerwright import functions as LF
from layerwright.literacy import AREA_NETWORK, BAND_EDGES, NETWORK_FEATURE, STUDENT_NETWORK, TARGETS
from layerwright.sources.landing import typed


def column(spark, values, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    found = df.select("i", expression(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(found, key=lambda r: r["i"])]


TEXTS = ["07", "12a", "3.7", " 7 ", "99999999999", "-1.9", "", None, "NaN", "1e2"]


@pytest.mark.parametrize(
    "want, expected",
    [
        ("int", [7, None, 3, 7, None, -1, None, None, None, 100]),
        ("bigint", [7, None, 3, 7, 99999999999, -1, None, None, None, 100]),
    ],
)
def test_text_to_whole_numbers(spark, want, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(TEXTS)], "i int, v string")
    found = typed(df, {"v": want}).collect()
    assert [r["v"] for r in sorted(found, key=lambda r: r["i"])] == expected
    assert dict(typed(df, {"v": want}).dtypes)["v"] == want


def test_numbers_to_narrower_numbers(spark):
    df = spark.createDataFrame([(3.7, 2**40), (math.nan, 5), (None, None)], "d double, l bigint")
    assert [tuple(r) for r in typed(df, {"d": "int", "l": "int"}).collect()] == [(3, None), (None, 5), (None, None)]


def test_flags(spark):
    df = spark.createDataFrame([("1",), ("0",), ("true",), ("2",), ("x",), (None,)], "v string")
    assert [r["v"] for r in typed(df, {"v": "boolean"}).collect()] == [True, False, True, True, None, None]


def test_large_ids_keep_all_digits(spark):
    df = spark.createDataFrame([("9007199254740993",)], "v string")
    assert typed(df, {"v": "bigint"}).first()["v"] == 9007199254740993


def test_fill_covers_null_and_nan(spark):
    assert column(spark, [1.5, None, math.nan], "double", lambda c: LF.fill_number(c, 0)) == [1.5, 0.0, 0.0]
    assert column(spark, [4, None], "int", lambda c: LF.fill_number(c, 0, floating=False)) == [4, 0]


def test_half_up(spark):
    values = [1.005, 2.675, -1.005, 649.996, 0.125]
    assert column(spark, values, "double", LF.half_up) == [1.01, 2.68, -1.01, 650.0, 0.13]


def test_text_styles(spark):
    values = ["  PUBLICA (F,E,M) ", "\tsp ", None]
    assert column(spark, values, "string", lambda c: LF.clean_text(c, "trim")) == ["PUBLICA (F,E,M)", "\tsp", None]
    assert column(spark, values, "string", lambda c: LF.clean_text(c, "upper")) == ["PUBLICA (F,E,M)", "\tSP", None]
    assert column(spark, values[:1], "string", lambda c: LF.clean_text(c, "title")) == ["Publica (f,e,m)"]


def test_band_edges_belong_above(spark):
    scores = [0.0, 649.99, 650.0, 674.99, 675.0, 742.0, 750.0, 799.99, 800.0, 824.99, 825.0, 1000.0]
    assert column(spark, scores, "double", lambda c: LF.band(c, BAND_EDGES)) == [0, 0, 1, 1, 2, 4, 5, 6, 7, 7, 8, 8]


def test_labels(spark):
    codes = [0, 1, 2, 3, 4, 5, 9, None]
    assert column(spark, codes, "int", lambda c: LF.label(c, STUDENT_NETWORK)) == [
        "Privada", "Federal", "Estadual", "Municipal", "Privada", "Privada", "Privada", "Privada",
    ]
    assert column(spark, codes, "int", lambda c: LF.label(c, AREA_NETWORK)) == [
        "Total", "Federal", "Estadual", "Municipal", "Privada", "Publica (E,M)", "Publica (F,E,M)", "Publica (F,E,M)",
    ]
    names = ["Municipal", "Estadual", "Federal", "Privada", None]
    assert column(spark, names, "string", lambda c: LF.label(c, NETWORK_FEATURE)) == [1, 2, 3, 4, 4]


def test_value_for_year(spark):
    targets = [(y, *(float(t - 2000) for t in TARGETS)) for y in (2023, 2024, 2030, None)]
    df = spark.createDataFrame(targets, "ano int, " + ", ".join(f"{c} double" for c in TARGETS.values()))
    zero = [r[0] for r in df.select(LF.value_for_year(F.col("ano"), TARGETS)).collect()]
    null = [r[0] for r in df.select(LF.value_for_year(F.col("ano"), TARGETS, "null")).collect()]
    assert zero == [0.0, 24.0, 30.0, 0.0]
    assert null == [None, 24.0, 30.0, None]
    with pytest.raises(ValueError):
        LF.value_for_year(F.col("ano"), TARGETS, "other")


def test_record_hash(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "x", "b")], "p string, q string, r string")
    plain = [r[0] for r in df.select(LF.record_hash(df.columns)).collect()]
    safe = [r[0] for r in df.select(LF.record_hash(df.columns, null_safe=True)).collect()]
    assert plain[0] == plain[1] == hashlib.sha256(b"a||b").hexdigest()
    assert plain[2] == hashlib.sha256(b"a||x||b").hexdigest()
    assert safe[0] == hashlib.sha256(b"1:a-1:b").hexdigest()
    assert len(set(safe)) == 3


def test_safe_record_hash_tells_all_rows_apart(spark):
    data = [("a||b", "c"), ("a", "b||c"), ("-", "x"), (None, "x"), ("", "x"), ("1:x", ""), ("1", ":x")]
    df = spark.createDataFrame(data, "p string, q string")
    assert df.select(LF.record_hash(df.columns, null_safe=True)).distinct().count() == len(data)
    assert df.select(LF.record_hash(df.columns)).distinct().count() < len(data)


def test_guarded_percentages(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "part bigint, whole bigint")
    found = df.select(LF.percent(F.col("part"), F.col("whole")), LF.percent_or_zero(F.col("part"), F.col("whole")))
    assert [tuple(r) for r in found.collect()] == [(33.33, 33.33), (None, 0.0)]
