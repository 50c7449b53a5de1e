"""Readers with explicit schemas. A missing path is an empty table, not an error, where said so."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import located, opened

#: Characters of files that a task holds at a time.
AT_ONCE = 1 << 22


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, asked of the file system that the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines; blank lines are skipped, a missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV with a header that must have the schema's names in order; a byte-order mark is ignored."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True, quote='"', escape='"', enforceSchema=False)


def read_first_tab(spark: SparkSession, path: str) -> DataFrame:
    """label, text: lines cut at their first tab; lines without one are dropped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("label"), F.get(parts, F.lit(1)).alias("text"))


def read_zip_csv(spark: SparkSession, path: str, schema: str, members: str = ".csv", max_bytes: int = 1 << 28) -> DataFrame:
    """CSV members of ZIP archives, an archive a task. Names that leave the archive and members that
    declare more than ``max_bytes`` are errors."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.filename.startswith("/") or ".." in info.filename.split("/"):
                            raise ValueError(f"{name}: unsafe member {info.filename}")
                        if not info.filename.endswith(members):
                            continue
                        if info.file_size > max_bytes:
                            raise ValueError(f"{name}: member {info.filename} is too large")
                        text = z.read(info).decode("utf-8-sig", "replace")
                        for rows in pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False, chunksize=10_000):
                            yield rows.assign(member=info.filename)[names]

    names = [f.name for f in T.StructType.fromDDL(schema).fields] + ["member"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpacked, f"{schema}, member string")


def read_xlsx(spark: SparkSession, path: str, sheets: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows of named sheets of XLSX workbooks, a workbook a task; rows that lack a column are left out.

    A workbook is a ZIP of XML: sheet names, shared strings and cells are read from there.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for sheet, table in sheet_tables(content, sheets):
                    head = {name: at for at, name in table.pop(0).items()} if table else {}
                    if set(columns) <= set(head):
                        found = [[r.get(head[c], "") for c in columns] for r in table]
                        frame = pd.DataFrame([r for r in found if all(r)], columns=list(columns))
                        yield frame.assign(sheet=sheet)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns) + ", sheet string")


def sheet_tables(content: bytes, wanted: tuple[str, ...]) -> Iterator[tuple[str, list[dict[str, str]]]]:
    """(name, rows) of the wanted sheets; a row maps column letters to texts."""
    import re
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet"):
            if sheet.get("name") not in wanted:
                continue
            table = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(link)].removeprefix("/xl/"))).iter(f"{space}row"):
                cells = {}
                for c in row.iter(f"{space}c"):
                    value = c.findtext(f"{space}v") or ""
                    kind = c.get("t")
                    cells[re.match("[A-Z]+", c.get("r"))[0]] = shared[int(value)] if kind == "s" else text(c) if kind == "inlineStr" else value
                table.append(cells)
            yield sheet.get("name"), table


def verified(spark: SparkSession, path: str, sha256: dict[str, str]) -> DataFrame:
    """name, sha256, matches: the digests of input files against the expected ones."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    expected = F.create_map(*[F.lit(x) for pair in sha256.items() for x in pair]) if sha256 else F.create_map().cast("map<string,string>")
    return found.withColumn("matches", F.coalesce(F.try_element_at(expected, F.col("name")) == F.col("sha256"), F.lit(False)))


def read_references(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All JSON Lines files of a pattern with their file's name, but those named for quarantine."""
    rows = spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_name"))
    return rows.where(~F.contains("file", F.lit("quarantine")))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Nested calls; the file must hold exactly the declared fields, and start times must not fall."""
    schema = (
        "accent string, domain string, file_name string, duration double, "
        "segments array<struct<role:string,speaker_id:string,gender:string,text:string,start:double,end:double>>"
    )
    calls = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return calls.withColumn("monotone", monotone(F.transform("segments", lambda s: s["start"])))


def monotone(values):  # noqa: ANN001, ANN201
    pairs = F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b.isNull() | (a <= b))
    return F.forall(pairs, lambda x: x)


def read_candidate(spark: SparkSession, path: str, text: str, label: str) -> DataFrame:
    """text, label from CSV, TSV or JSON Lines by the path's ending; empty ones are dropped."""
    if path.endswith((".csv", ".tsv")):
        rows = spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", multiLine=True, escape='"')
    else:
        rows = spark.read.json(path)
    pick = lambda c: F.when(F.typeof(F.col(c)) == "string", F.col(c).cast("string"))
    return rows.select(pick(text).alias("text"), pick(label).alias("label")).where("trim(text) <> '' AND trim(label) <> ''")


def flatten_content(content: str) -> DataFrame:
    """Text of a JSON value that is a string or a list of parts with texts and audio references."""
    v = F.try_parse_json(F.col(content))
    parts = F.from_json(F.col(content), "array<struct<type:string,text:string,audio:string>>")
    return F.struct(
        F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n"), F.try_variant_get(v, "$", "string")).alias("text"),
        F.coalesce(F.size(F.filter(parts, lambda p: p["audio"].isNotNull())), F.lit(0)).alias("audios"),
    )


def cached_scores(spark: SparkSession, path: str, identity: str) -> DataFrame | None:
    """Scores of a finished run, or nothing where they belong to another identity."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path).where(F.col("identity") == identity)
    return rows.drop("identity") if rows.limit(1).count() else None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below a folder but those that begin with "_". The driver lists the folder itself; what
    is in its folders is listed and read by tasks, which hold ``AT_ONCE`` characters at a time."""
    where = located(spark, path)
    store, top = opened(where)
    first = sorted((f.path,) for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if not f.base_name.startswith("_"))
    tasks = max(1, min(len(first), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(where)
        names, contents, held = [], [], 0
        for b in batches:
            for at in b.column(0).to_pylist():
                own = store.get_file_info(at)
                for f in [own] if own.is_file else store.get_file_info(fs.FileSelector(at, recursive=True)):
                    if f.is_file and not f.base_name.startswith("_"):
                        with store.open_input_stream(f.path) as file:
                            contents.append(file.read().decode("utf-8", "replace"))
                        names.append(f.path)
                        held += len(contents[-1])
                    if held > AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.string())], names=["path", "content"])
                        names, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.string())], names=["path", "content"])

    folders = spark.createDataFrame(first, "at string").repartition(tasks, "at")
    return folders.mapInArrow(per_batch, "path string, content string")
