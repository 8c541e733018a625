import datetime
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesync.functions import hashing as h
from tablesync.functions.text import export_text, from_hex, text_of, to_hex


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def text(df, column, scale=None):
    return df.select(text_of(F.col(column), df.schema[column].dataType, scale)).first()[0]


def test_row_hash_sorts_names_and_writes_null(spark):
    df = spark.createDataFrame([(1, None, "x", bytearray(b"\xab"), True)], "z int, b string, a string, c binary, t boolean")
    want = md5("a=x|b=NULL|c=ab|t=true|z=1|")
    assert h.row_hash(df, "z").first()["row_hash"] == want


def test_timestamps_have_fixed_width_and_no_session_zone(spark):
    df = spark.sql("""select timestamp_ntz'2024-03-31 02:30:00' as n, timestamp_ntz'2024-01-02 03:04:05.17' as f,
        timestamp'2024-07-01 12:00:00 UTC' as z, timestamp_ntz'+12345-01-02 03:04:05.5' as far""")
    assert text(df, "n") == "2024-03-31T02:30:00.000000"
    assert text(df, "f") == "2024-01-02T03:04:05.170000"
    assert text(df, "far") == "+12345-01-02 03:04:05.5"
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert text(df, "z") == "2024-07-01T12:00:00.000000"
        assert text(df, "n") == "2024-03-31T02:30:00.000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_floats(spark):
    df = spark.sql("select -0.0d as m, 0.0d as p, 1.5d as x, 1e300d as big, double('NaN') as nan, 0.1f as f")
    assert text(df, "m") == text(df, "p") == "0.0"
    assert text(df, "x", 6) == "1.500000"
    assert text(df, "big", 6) == "1.0E300" and text(df, "nan", 6) == "NaN"
    assert text(df, "f") == "0.1"


def test_other_types(spark):
    df = spark.sql("""select cast(1.50 as decimal(10,2)) as d, date'2024-01-02' as day,
        array(1, null) as arr, named_struct('a', 1, 'b', cast(null as string)) as st, map('k', 1.0d, 'a', 2.0d) as m""")
    assert text(df, "d") == "1.50" and text(df, "day") == "2024-01-02"
    assert text(df, "arr") == '["1",null]'
    assert text(df, "st") == '{"a":"1","b":null}'
    assert text(df, "m") == '[{"key":"a","value":"2.0"},{"key":"k","value":"1.0"}]'


def test_hex_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x1f"),)], ["b"])
    assert df.select(to_hex(F.col("b"))).first()[0] == "001f"
    assert df.select(from_hex(F.lit("001f")) == F.col("b")).first()[0]


def test_tagged_text_tells_null_from_text(spark):
    df = spark.createDataFrame([("NULL", "x"), (None, "x"), ("a|b=1:x", ""), ("a", "x|b=")], "a string, b string")
    texts = [r[0] for r in df.select(h.tagged_row_text(df)).collect()]
    assert len(set(texts)) == 4
    plain = [r[0] for r in df.select(h.row_text(df)).collect()]
    assert plain[0] == plain[1] == "a=NULL|b=x|"


def test_value_words_see_nulls_and_nesting(spark):
    df = spark.createDataFrame(
        [(None, "x", [1, None]), ("x", None, [1, None]), ("x", None, [None, 1])], "a string, b string, c array<int>"
    )
    as_text = h.text_columns(df, df, df.columns)
    assert as_text == {"c"}
    words = df.select(*[w.alias(str(i)) for i, w in enumerate(h.value_words(df, df.columns, as_text))]).collect()
    assert len(set(words)) == 3
    assert all(0 <= v < 2**21 for r in words for v in r)


def test_combined_hash_orders_keys_as_text(spark):
    df = spark.createDataFrame([(9, "a"), (10, "b")], "id int, v string")
    hashes = {r["id"]: r["row_hash"] for r in h.row_hash(df, "id").collect()}
    want = md5(f"{hashes[10]}|{hashes[9]}|")
    assert h.combined_hash(df, "id").first().asDict() == {"rows": 2, "combined_hash": want}


def test_combined_hash_of_nothing_and_too_much(spark):
    empty = spark.createDataFrame([], "id int")
    assert h.combined_hash(empty, "id").first()["combined_hash"] == md5("")
    with pytest.raises(Exception, match="at most"):
        h.combined_hash(spark.range(h.MAX_COMBINED_ROWS + 1), "id").collect()


def test_export_text(spark):
    values = ("a\tb\nc\rd", None, bytearray(b"\x0a"), True, datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), Decimal("1.20"))
    df = spark.createDataFrame([values], "s string, n string, b binary, t boolean, ts timestamp_ntz, d decimal(5,2)")
    out = df.select(*[export_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert tuple(out) == ("a b c d", "", "0a", "1", "2024-01-02 03:04:05.678", "1.20")


def test_words_hold_all_bits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    digest = F.md5(F.col("v").cast("binary"))
    for r in df.select(digest.alias("h"), *[w.alias(f"w{i}") for i, w in enumerate(h.md5_words(digest))]).collect():
        assert "".join(f"{r[f'w{i}']:05x}" for i in range(6)) + f"{r['w6']:02x}" == r["h"]
    names = ["id", "v"]
    want = F.xxhash64("id", "v", F.lit(False), F.lit(False))
    for r in df.select(want.alias("x"), *[w.alias(f"w{i}") for i, w in enumerate(h.value_words(df, names, set()))]).collect():
        assert sum(r[f"w{i}"] << (h.WORD_BITS * i) for i in range(4)) == r["x"] % (1 << 64)
