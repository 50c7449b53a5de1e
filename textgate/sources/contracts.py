"""Readers' contracts: what a source's rows become, and which rows break its rules.

No rule stops a job: each gives a column or a table of problems, which a caller refuses or reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as sg
from ..functions import text as tx
from .readers import exists

INTENT_SEPARATOR = "<div>"
URL = r"(?i)https?://\S+|www\.\S+"
CALL_KEYS = ("accent", "domain", "duration", "file_name", "segments")
SEGMENT_KEYS = ("end", "gender", "role", "speaker_id", "start", "text")


def regional_rows(rows: DataFrame) -> DataFrame:
    """text, label, label_policy, source_label, split of a CSV with message and label, for held-out use only.

    A message that its source calls smishing is SCAM only by its own text; unknown labels are left out.
    """
    mark = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    rows = rows.select(tx.mask_contacts(tx.clean(F.coalesce("message", F.lit("")))).alias("text"), mark.alias("source_label"))
    rows = rows.where(F.col("source_label").isin("ham", "spam", "smishing") & (F.length("text") >= 4))
    rows = rows.withColumn("signals", F.transform(sg.signal_matches(F.col("text")), lambda s: s["signal"]))
    policy = lambda label, why: F.struct(F.lit(label).alias("label"), F.lit(why).alias("policy"))
    strong = sg.strong_evidence(F.col("signals"))
    by_text = F.coalesce(
        sg.protective_label(F.col("text"), F.col("signals")),
        F.when(strong, policy("SCAM", "source_smishing_with_strong_text_evidence")).otherwise(policy("UNCERTAIN", "source_smishing_without_strong_text_evidence")),
    )
    own = F.when(F.col("source_label") == "ham", policy("SAFE", "source_ham")).when(F.col("source_label") == "spam", policy("UNCERTAIN", "source_generic_spam")).otherwise(by_text)
    return rows.select("text", own.alias("own"), "source_label").select("text", "own.label", F.col("own.policy").alias("label_policy"), "source_label", F.lit("ood").alias("split"))


def dialogue_rows(rows: DataFrame, scam_types: dict[str, str], safe_types: tuple[str, ...]) -> DataFrame:
    """text, type, label, category, problem of a CSV with dialogue, type and label (0 or 1).

    ``problem`` is null where label and type are known and agree.
    """
    kind, mark = F.lower(F.trim(F.coalesce("type", F.lit("")))), F.trim(F.coalesce("label", F.lit("")))
    is_scam, is_known = kind.isin(*scam_types), kind.isin(*scam_types, *safe_types)
    problem = (
        F.when(~mark.isin("0", "1"), "unexpected label").when(~is_known, "unexpected type").when((mark == "1") != is_scam, "type and label differ")
    )
    category = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in scam_types.items()], F.lit("NONE"))
    return rows.select(
        F.regexp_replace(F.coalesce("dialogue", F.lit("")), URL, "<URL>").alias("text"), kind.alias("type"),
        F.when(mark == "1", "SCAM").when(mark == "0", "SAFE").alias("label"), category.alias("category"), problem.alias("problem"),
    )


def index_of(value: Column) -> Column:
    """A whole number written as 3 or 3.0, or null."""
    return F.regexp_extract(F.trim(value), r"^(0|[1-9][0-9]*)(?:\.0+)?$", 1).try_cast("long")


def slot_types(labels: Column) -> Column:
    """Types of BIO labels without their prefix; O is none."""
    return F.transform(F.filter(labels, lambda x: x != "O"), lambda x: F.regexp_replace(x, "^[BI][-_](?=.)", ""))


def annotations(spark: SparkSession, path: str, sentences: bool = False) -> DataFrame:
    """Rows of a tab-separated annotation file, whose header must be the expected one.

    conversation_id, turn_number, sentence_number (null for turns), utterance_id, utterance, intents,
    slot_labels, empty_utterance, problem (incomplete or a number that is none; else null).
    """
    names = ["conversationId", "turnNumber", *(["sentenceNumber"] if sentences else []), "utteranceId", "utterance", "slot-labels", "intent"]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.csv(path, schema=schema, header=True, sep="\t", multiLine=True, quote='"', escape='"', enforceSchema=False)
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    parts = lambda c, by: F.filter(F.transform(F.split(text(c), by), lambda x: F.trim(x)), lambda x: x != "")
    found = rows.select(
        text("conversationId").alias("conversation_id"), index_of(text("turnNumber")).alias("turn_number"),
        (index_of(text("sentenceNumber")) if sentences else F.lit(None).cast("long")).alias("sentence_number"), text("utteranceId").alias("utterance_id"),
        tx.clean(text("utterance")).alias("utterance"), parts("intent", INTENT_SEPARATOR).alias("intents"), parts("slot-labels", r"\s+").alias("slot_labels"),
    )
    lacks = (F.col("conversation_id") == "") | (F.col("utterance_id") == "") | (F.size("intents") == 0)
    no_number = F.col("turn_number").isNull() | (F.col("sentence_number").isNull() if sentences else F.lit(False))
    return found.withColumn("empty_utterance", F.col("utterance") == "").withColumn("problem", F.when(lacks, "incomplete").when(no_number, "not a number"))


def call_problems(lines: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """file_name, problem: every rule that a call (column ``value``, one JSON object) breaks.

    Keys must be exactly the known ones, names unique, segments there, roles known, speakers named,
    and times in order.
    """
    top = F.from_json("value", "map<string,string>")
    own = F.from_json(top["segments"], "array<map<string,string>>")
    calls = lines.select(top.alias("top"), own.alias("segments"), F.coalesce(top["file_name"], F.lit("")).alias("file_name"))
    keys = lambda m, expected: F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, expected))
    at = lambda s, k: s[k].try_cast("double")
    n = F.size("segments")
    following = F.slice("segments", F.lit(2), F.greatest(n - 1, F.lit(0)))
    backwards = F.exists(F.zip_with("segments", following, lambda a, b: b.isNotNull() & (at(b, "start") < at(a, "start"))), lambda x: x)
    ends_early = F.exists("segments", lambda s: at(s, "end") < at(s, "start"))
    timeless = F.exists("segments", lambda s: at(s, "start").isNull() | at(s, "end").isNull())
    some = F.col("segments").isNotNull() & (n > 0)
    rules = {
        "unexpected keys": F.col("top").isNull() | ~keys(F.col("top"), CALL_KEYS),
        "no name": (F.col("file_name") == "") | (F.coalesce(F.col("top")["accent"], F.lit("")) == "") | (F.coalesce(F.col("top")["domain"], F.lit("")) == ""),
        "no segments": ~some,
        "unexpected segment keys": some & F.exists("segments", lambda s: ~keys(s, SEGMENT_KEYS)),
        "unexpected role": some & F.exists("segments", lambda s: ~F.coalesce(s["role"].isin(*roles), F.lit(False))),
        "times out of order": some & F.coalesce(backwards | ends_early | timeless, F.lit(True)),
        "no speaker": some & F.exists("segments", lambda s: F.trim(F.coalesce(s["speaker_id"], F.lit(""))) == ""),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    found = calls.select("file_name", F.explode(broken).alias("problem"))
    twice = calls.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND file_name <> ''")
    return found.unionByName(twice.select("file_name", F.lit("repeated name").alias("problem")))


def by_stem(left: DataFrame, right: DataFrame, stem: str = r"([^/]+)\.[^./]+$", path: str = "_metadata.file_path") -> DataFrame:
    """Two tables read from files, joined on the part of the files' paths that ``stem`` captures: stem, and
    the columns of both but ``path``; right's are null where it has no such file. Never by broadcast: how many files there
    are is not known before."""
    name = lambda d: d.withColumn("stem", F.regexp_extract(F.col(path), stem, 1)).drop(path)
    return name(left).join(name(right).hint("merge"), "stem", "left")


def reference_union(spark: SparkSession, paths: list[str], schema: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all JSON Lines files of several paths (files, folders, patterns), each file once.

    Files that are named for quarantine or excluded by name are left out, and so are rows without
    id, family_id or text.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files: dict[str, None] = {}
    for path in paths:
        if not exists(spark, path):
            continue
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        open_ = [s for s in fs.globStatus(p)]
        while open_:
            s = open_.pop()
            name = s.getPath().getName()
            if s.isDirectory():
                open_.extend(fs.listStatus(s.getPath()))
            elif not name.startswith(("_", ".")) and "quarantine" not in s.getPath().toString() and name not in excluded:
                files[fs.resolvePath(s.getPath()).toString()] = None
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(sorted(files))
    return rows.where("id IS NOT NULL AND family_id IS NOT NULL AND text IS NOT NULL")
