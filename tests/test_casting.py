import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions import cast_text, is_rejected, require_cast, spark_type, type_name, typed_projection

D, DT = datetime.date, datetime.datetime

ACCEPTED = [
    ("Int32", "731", 731),
    ("Int32", "0", 0),
    ("Int32", "-92", -92),
    ("Int32", "+7", 7),
    ("Int32", "2147483647", 2147483647),
    ("Int32", "-2147483648", -2147483648),
    ("Int64", "9223372036854775807", 9223372036854775807),
    ("Int64", "-9223372036854775808", -9223372036854775808),
    ("Float64", "88.125", 88.125),
    ("Float64", "-0.0625", -0.0625),
    ("Float64", "1.7976931348623157E308", 1.7976931348623157e308),
    ("Float64", "4.9E-324", 4.9e-324),
    ("Float64", " 12 ", 12.0),
    ("Float64", "1.", 1.0),
    ("Float64", "5d", 5.0),
    ("Float64", "-Infinity", float("-inf")),
    ("UUID", "FFFFFFFF-FFFF-FFFF-FFFF-FFFFFFFFFFFF", "ffffffff-ffff-ffff-ffff-ffffffffffff"),
    ("UUID", "0b5c11d4-9f3e-4c58-8a77-c0ffee123456", "0b5c11d4-9f3e-4c58-8a77-c0ffee123456"),
    ("Date", "1987-11-03", D(1987, 11, 3)),
    ("Date", "2061-07-28", D(2061, 7, 28)),
    ("Date", "2024-02-29", D(2024, 2, 29)),
    ("DateTime", "1969-07-20T20:17:40", DT(1969, 7, 20, 20, 17, 40)),
    ("DateTime", "2061-07-28t00:00:01", DT(2061, 7, 28, 0, 0, 1)),
    ("DateTime", "1999-08-11T10:24", DT(1999, 8, 11, 10, 24)),
    ("DateTime", "1999-08-11T10:24:06.5", DT(1999, 8, 11, 10, 24, 6, 500000)),
    ("Bool", "true", True),
    ("Bool", "TRUE", True),
    ("Bool", "1", True),
    ("Bool", "yes", True),
    ("Bool", "False", False),
    ("Bool", "0", False),
    ("Bool", "no", False),
    ("String", "river otter", "river otter"),
    ("SomethingElse", "kept", "kept"),
    ("UInt8", "255", 255),
    ("UInt32", "4294967295", 4294967295),
    ("Nullable(Int32)", "5", 5),
    ("LowCardinality(Nullable(String))", "x", "x"),
    ("Array(Int32)", "[1,2]", [1, 2]),
]

REFUSED = [
    ("Int32", "seven"),
    ("Int32", "2147483648"),
    ("Int32", "-2147483649"),
    ("Int32", "6.0"),
    ("Int32", "12,000"),
    ("Int32", " 12 "),
    ("Int64", "9223372036854775808"),
    ("Int64", "-9223372036854775809"),
    ("Int64", "0.5"),
    ("Float64", "pi"),
    ("Float64", "9,99"),
    ("Float64", "inf"),
    ("Float64", "nan"),
    ("Float64", "12L"),
    ("UUID", "beef"),
    ("UUID", "0b5c11d49f3e4c588a77c0ffee123456"),
    ("UUID", "0b5c11d4-9f3e-4c58-8a77-c0ffee12345g"),
    ("Date", "yesterday"),
    ("Date", "11/03/1987"),
    ("Date", "1987-13-03"),
    ("Date", "1987-11-31"),
    ("Date", "1900-02-29"),
    ("Date", "1987-11-3"),
    ("Date", "1987"),
    ("DateTime", "20.07.1969 20:17"),
    ("DateTime", "1969-00-20T20:17:40"),
    ("DateTime", "1969-07-00T20:17:40"),
    ("DateTime", "1969-07-20T24:00:00"),
    ("DateTime", "1969-07-20 20:17:40"),
    ("DateTime", "1969-07-20"),
    ("Bool", "maybe"),
    ("Bool", "3"),
    ("Bool", "-1"),
    ("Bool", "t"),
    ("UInt8", "256"),
    ("UInt32", "-1"),
    *((kind, text + "\n") for kind, text in (("Int32", "12"), ("Int64", "12"), ("UInt8", "1"), ("Date", "1987-11-03"))),
    *((kind, text + "\n") for kind, text in (("DateTime", "1969-07-20T20:17:40"), ("UUID", "0b5c11d4-9f3e-4c58-8a77-c0ffee123456"))),
]


def convert(spark, kind, texts):
    """(value, rejected) of each text, in one job per type."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").repartition(1)
    out = df.select("i", cast_text(F.col("v"), kind).alias("value"), is_rejected(F.col("v"), kind).alias("rejected"))
    return [(r.value, r.rejected) for r in sorted(out.collect(), key=lambda r: r.i)]


@pytest.mark.parametrize("kind", sorted({k for k, *_ in ACCEPTED}))
def test_accepted(spark, kind):
    cases = [(text, value) for k, text, value in ACCEPTED if k == kind]
    assert convert(spark, kind, [t for t, _ in cases]) == [(value, False) for _, value in cases]


@pytest.mark.parametrize("kind", sorted({k for k, _ in REFUSED}))
def test_refused(spark, kind):
    texts = [text for k, text in REFUSED if k == kind]
    assert convert(spark, kind, texts) == [(None, True)] * len(texts)


@pytest.mark.parametrize("kind", ["Int32", "Int64", "Float64", "Date", "DateTime", "Bool", "UUID", "String", "UInt64", "Array(Int32)"])
def test_missing_text_is_null_and_not_rejected(spark, kind):
    assert convert(spark, kind, ["", None]) == [(None, False), (None, False)]


def test_largest_unsigned(spark):
    assert convert(spark, "UInt64", ["18446744073709551615", "18446744073709551616"]) == [(18446744073709551615, False), (None, True)]


def test_strict_conversion_fails(spark):
    df = spark.createDataFrame([("",)], "v string")
    for kind in ("Bool", "UUID", "Date", "DateTime", "Int32"):
        with pytest.raises(Exception, match="Cannot convert"):
            df.select(require_cast(F.col("v"), kind)).collect()
    one = spark.createDataFrame([("yes",)], "v string")
    assert one.select(require_cast(F.col("v"), "Bool")).head()[0] is True


def test_projection_keeps_declared_order(spark):
    df = spark.createDataFrame([("1", "x", "1987-11-03")], "a string, b string, c string")
    out = typed_projection(df, {"c": "Date", "a": "Int32"})
    assert out.dtypes == [("c", "date"), ("a", "int")]
    assert tuple(out.head()) == (D(1987, 11, 3), 1)


def test_type_names():
    assert spark_type("Decimal(10, 2)") == T.DecimalType(10, 2)
    assert spark_type("Map(String, Array(Int64))") == T.MapType(T.StringType(), T.ArrayType(T.LongType()))
    assert spark_type("Tuple(a Int32, b String)") == T.StructType(
        [T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]
    )
    assert spark_type("Tuple(Int32, Decimal(4, 1))").names == ["1", "2"]
    assert spark_type(" ") == T.StringType()
    assert spark_type("DateTime64(3)") == T.TimestampNTZType()
    for name in ("Int32", "Float64", "Bool", "Date", "DateTime", "Decimal(10, 2)", "Array(Int32)", "Map(String, Int64)"):
        assert type_name(spark_type(name)) == name
