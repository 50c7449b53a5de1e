import random

import pytest
from pyspark.sql import types as T

#: Columns whose names the operators use themselves.
CLASHING = ("keep_id", "kept", "group_size", "text_sha256", "class", "class_id", "key", "row", "score", "w", "sequence_id", "n_tokens", "id", "k")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ta", "re", "mi", "so", "lu", "na", "the", "of")) for _ in range(r.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, *["x"] * len(CLASHING))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and rows that repeat."""
    base = prose(1)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        row(1, base), row(2, base), row(3, " ".join(base.split()).replace(" ", "  ")), row(4, near), row(5, prose(2), None, None),
        row(6, None), row(7, ""), row(8, " \t\n"), row(None, prose(3)), row(None, None, None, None), row(9, prose(4), "fr", "b"),
        row(9, prose(4), "fr", "b"), row(10, "!!! ???"), row(11, "x"), row(12, prose(5, 30_000), "de", "b"), row(13, "y" * 60_000),
        row(14, "中文 ñandú \U0001f600 ﬁ   \x00 end", "zh", "c"), row(15, "Licensed under CC BY-NC 4.0. All rights reserved."),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """A data folder with the odd documents and labels for them."""
    path = str(tmp_path_factory.mktemp("sf"))
    odd.write.parquet(f"{path}/documents.parquet")
    labels = [(i, (1 if i % 3 else 0) if i != 9 else None, 0) for i in range(1, 15)] + [(None, 1, None), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def bare_folder(spark, none, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bare"))
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
