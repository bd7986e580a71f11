import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.functions import embedding, scoring, text, ulid, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("\t a ", "a"), ("  ", ""), ("x", "x"), ("\n y z\n", "y z")])
def test_trim(spark, raw, want):
    assert one(spark, text.trimmed(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("éééé", 1)])
def test_tokens(spark, raw, want):
    assert one(spark, text.token_estimate(F.col("t")), t=raw) == want


def test_truncation_counts_bytes_but_cuts_characters(spark):
    assert one(spark, text.truncated_message(F.col("t")), t="é" * 251) == "é" * 251 + "…"
    assert one(spark, text.truncated_message(F.col("t")), t="a" * 500) == "a" * 500


@pytest.mark.parametrize("raw, nested, want", [
    (None, True, []), ("null", True, []), ('["a", "b"]', True, ["a", "b"]), ('"[\\"a\\"]"', True, ["a"]), ('"[\\"a\\"]"', False, None), ("[1]", True, None), ("{}", True, None), ("[]", True, []),
])
def test_tags(spark, raw, nested, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.parsed_tags(F.col("t"), nested).alias("x")).first()["x"] == want


def test_recency_halves_in_14_days_and_clamps_the_future(spark):
    now = F.lit(datetime(2024, 2, 1))
    assert one(spark, scoring.recency(F.lit(datetime(2024, 1, 18)), now)) == pytest.approx(0.5)
    assert one(spark, scoring.recency(F.lit(datetime(2024, 2, 2)), now)) == 1.0


def test_stub_embedding_uses_the_first_byte_and_is_a_unit_vector(spark):
    v = one(spark, embedding.stub_embedding(F.col("t"), 8), t="éa")
    raw = [math.sin(0xC3 * 0.07 + i * 0.61803) if i % 2 == 0 else math.cos(3 * 0.13 + i * 0.61803) for i in range(8)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert v == pytest.approx([x / norm for x in raw])


def test_zero_vector_normalises_to_zero(spark):
    assert one(spark, vectors.l2_normalised(vectors.literal([0.0, 0.0]))) == [0.0, 0.0]


def test_ids_sort_by_time_and_give_it_back(spark):
    a, b = ulid.new(1_700_000_000_000), ulid.new(1_700_000_000_001)
    assert a < b and ulid.timestamp_ms(a) == 1_700_000_000_000
    assert one(spark, ulid.created_ms(F.col("i")), i=a) == 1_700_000_000_000
    with pytest.raises(ValueError):
        ulid.parse("nope")


def test_human_bytes():
    assert text.human_bytes(10) == "10 B" and text.human_bytes(1536) == "1.50 KiB"
