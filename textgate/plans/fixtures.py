"""Views over the data folder that the queries share, each as a DataFrame and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import verdicts as vd

SCAM_AT, SAFE_AT = 0.5, 0.4

MESSAGES = """m AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS ordinal, d.text, d.source, d.lang AS source_language,
    CASE WHEN l.toxic = 1 THEN 'SCAM' WHEN l.quality = 1 THEN 'SAFE' ELSE 'UNCERTAIN' END AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
BENCHMARK = "b AS (SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark)"
DIALOGUES = """dlg AS (
  SELECT conv_id, string_agg(upper(role) || ': ' || text, ' ' ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id)"""
NORMAL = "regexp_replace(replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss'), '[^a-z0-9 ]+', '', 'g')"


def hex8(x: str) -> str:
    return f"CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT)"


def normal(x: str) -> str:
    return NORMAL.format(x)


def ledger(name: str = "l", salt: str = "a") -> str:
    """A ledger CTE over m: probabilities from salted hashes."""
    raw = ", ".join(f"1 + {hex8(f'''id || ':{salt}{k}' ''')} % 1000 AS w_{k}" for k in ("safe", "uncertain", "scam"))
    return f"""{name}_w AS (SELECT *, {raw} FROM m),
{name}_p AS (
  SELECT id, text, source, source_language, label AS truth,
    CASE WHEN {hex8('id')} % 100 < 80 THEN 'train' WHEN {hex8('id')} % 100 < 90 THEN 'dev' ELSE 'test' END AS split,
    'c' || CAST({hex8("id || ':cat'")} % 5 AS VARCHAR) AS category,
    w_safe / CAST(w_safe + w_uncertain + w_scam AS DOUBLE) AS p_safe, w_uncertain / CAST(w_safe + w_uncertain + w_scam AS DOUBLE) AS p_uncertain,
    w_scam / CAST(w_safe + w_uncertain + w_scam AS DOUBLE) AS p_scam
  FROM {name}_w),
{name} AS (
  SELECT *, CASE WHEN p_safe >= p_uncertain AND p_safe >= p_scam THEN 'SAFE' WHEN p_uncertain >= p_scam THEN 'UNCERTAIN' ELSE 'SCAM' END AS argmax,
    CASE WHEN p_scam >= {SCAM_AT} THEN 'SCAM' WHEN p_safe >= {SAFE_AT} THEN 'SAFE' ELSE 'UNCERTAIN' END AS verdict,
    -ln(CASE truth WHEN 'SAFE' THEN p_safe WHEN 'UNCERTAIN' THEN p_uncertain ELSE p_scam END) AS nll
  FROM {name}_p)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def confusion_columns() -> list:
    return [
        vd.count_of((F.col("truth") == t) & (F.col("verdict") == v)).alias(f"n_{t}_{v}".lower()) for t in vd.LABELS for v in vd.LABELS
    ]


class Tables:
    """The folder's tables and the shared views, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def m(self) -> DataFrame:
        label = F.when(F.col("toxic") == 1, "SCAM").when(F.col("quality") == 1, "SAFE").otherwise("UNCERTAIN")
        joined = self.documents.join(self.labels, "doc_id", "left")
        return joined.select(
            F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), "text", "source",
            F.col("lang").alias("source_language"), label.alias("label"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """The messages without their labels, for which no text is shuffled."""
        return self.documents.select(
            F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"), "text", "source", F.col("lang").alias("source_language")
        )

    @cached_property
    def b(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").cast("string").alias("id"), "text")

    @cached_property
    def dlg(self) -> DataFrame:
        line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
        rows = self.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
        return rows.select("conv_id", F.array_join("lines.line", " ").alias("text"), F.size("lines").cast("long").alias("turns"))

    def l(self, salt: str = "a") -> DataFrame:  # noqa: E743
        rows = self.m
        for k in ("safe", "uncertain", "scam"):
            rows = rows.withColumn(f"w_{k}", 1 + tx.hash_number(F.concat("id", F.lit(f":{salt}{k}"))) % 1000)
        total = (F.col("w_safe") + F.col("w_uncertain") + F.col("w_scam")).cast("double")
        rows = rows.select(
            "id", "text", "source", "source_language", F.col("label").alias("truth"), tx.split_for_family(F.col("id")).alias("split"),
            F.concat(F.lit("c"), (tx.hash_number(F.concat("id", F.lit(":cat"))) % 5).cast("string")).alias("category"),
            *[(F.col(f"w_{k}") / total).alias(f"p_{k}") for k in ("safe", "uncertain", "scam")],
        )
        p = [F.col(f"p_{k}") for k in ("safe", "uncertain", "scam")]
        own = F.when(F.col("truth") == "SAFE", p[0]).when(F.col("truth") == "UNCERTAIN", p[1]).otherwise(p[2])
        return rows.select(
            "*", vd.top_label(*p).alias("argmax"), vd.verdict(p[0], p[2], SCAM_AT, SAFE_AT).alias("verdict"), (-F.log(own)).alias("nll")
        )
