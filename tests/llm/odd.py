"""Odd documents that every operator must handle."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     # extra columns whose names the operators use themselves
                     StructField("word", StringType()), StructField("ids", StringType()), StructField("n_words", LongType()),
                     StructField("tag", StringType()), StructField("body", StringType()), StructField("start", StringType())])

LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))

TEXTS = [
    (1, "The quick brown fox, the lazy dog's tail; it's 2024!"), (2, ""), (3, None), (4, " \t\n "), (5, "one"), (6, LONG),
    (7, "ÉCOLE École école İstanbul ﬁne  nb sp \x1c!\x1c! a b <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>"),
    (8, "The quick brown fox, the lazy dog's tail; it's 2024!"), (8, "The quick brown fox, the lazy dog's tail; it's 2024!"),
    (9, "other text under one id"), (9, "one id with two texts"), (None, "no id at all"), (None, None),
    (10, "日本語のテキスト emoji 🎉🎉 mixed ▁mark ▁ 漢字"), (11, "la " * 500), (12, f"{PASSAGE} tail one"), (13, f"head two {PASSAGE}"),
    (14, "x" * 5000), (15, "line\nline\n\nline\n other line\r\nline"), (-7, "negative id"), (16, "\u0000nul\u0000 byte"),
]


def odd_rows():
    return [(i, t, "en" if (i or 0) % 2 else None, None if i == 5 else f"s{(i or 0) % 3}", None, "w", None, 5, "t", "b", "s") for i, t in TEXTS]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
