"""Explicit schemas; nothing is inferred from the first row of a file."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight scored attributes, lower case, in output order.
ATTRIBUTES = (
    "toxicity",
    "severe_toxicity",
    "identity_attack",
    "insult",
    "threat",
    "profanity",
    "sexually_explicit",
    "flirtation",
)

# The ten identity domains (six single, four aggregated).
SINGLE_DOMAINS = ("male", "female", "christian", "muslim", "white", "black")
AGGREGATE_DOMAINS = ("LGBTQ", "other_religions", "asian_latino_etc", "disability_any")
DOMAINS = AGGREGATE_DOMAINS + SINGLE_DOMAINS

_scored = [T.StructField(a, T.DoubleType()) for a in ATTRIBUTES]

PROMPT = T.StructType([T.StructField("text", T.StringType()), *_scored])
PROMPTS = T.StructType(
    [
        T.StructField("prompt_idx", T.LongType()),
        T.StructField("prompt", PROMPT),
        T.StructField("domain", T.StringType()),
    ]
)

_value = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("type", T.StringType())])
ATTRIBUTE_SCORES = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("summaryScore", _value),
            T.StructField(
                "spanScores",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("begin", T.IntegerType()),
                            T.StructField("end", T.IntegerType()),
                            T.StructField("score", _value),
                        ]
                    )
                ),
            ),
        ]
    ),
)
RESPONSE = T.StructType([T.StructField("attributeScores", ATTRIBUTE_SCORES)])
SCORES = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("response", RESPONSE),
        T.StructField("error", T.StringType()),
    ]
)
FLAT_SCORES = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("attributeScores", ATTRIBUTE_SCORES)]
)

GENERATION_SHAPES = {
    "list": T.ArrayType(T.StringType()),
    "records": T.ArrayType(T.StructType([T.StructField("text", T.StringType())])),
    "record": T.StructType([T.StructField("text", T.StringType())]),
    "text": T.StringType(),
}

CORPUS = T.StructType([T.StructField("text", T.StringType())])

DATASTORE = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("key", T.ArrayType(T.FloatType())),
        T.StructField("token", T.IntegerType()),
    ]
)

ANNOTATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("comment_text", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("toxicity", T.DoubleType()),
        *[T.StructField(d, T.DoubleType()) for d in DOMAINS],
        T.StructField("identity_any", T.DoubleType()),
        T.StructField("more_than_one_identity", T.BooleanType()),
    ]
)
