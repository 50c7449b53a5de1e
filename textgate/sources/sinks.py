"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import located, opened

#: Folders that files of their own are dealt to.
FOLDERS = 1024


def write_jsonl(rows: DataFrame, path: str) -> int:
    """JSON Lines; returns the rows written, counted while they are."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_manifest(counts: DataFrame, path: str) -> None:
    """One JSON object from a table of counts."""
    counts.agg(F.collect_list(F.struct(*counts.columns)).alias("counts"), F.sum("n").alias("rows")).coalesce(1).write.mode("overwrite").json(path)


def write_audit(rows: DataFrame, path: str, blank: tuple[str, ...] = ("auditor_label", "notes")) -> None:
    """A CSV with empty columns for decisions."""
    rows.select(*rows.columns, *[F.lit("").alias(c) for c in blank]).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_scores(scores: DataFrame, path: str, identity: str) -> None:
    scores.withColumn("identity", F.lit(identity)).write.mode("overwrite").parquet(path)


def write_one_csv(rows: DataFrame, path: str) -> None:
    """One CSV file of that name, for tables that people read: complete under its name or not there.

    A task writes it beside the target, which then takes the file's name at once.
    """
    import uuid

    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    part, target = f"{path}.{uuid.uuid4().hex}", jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.coalesce(1).write.csv(part, header=True, escape='"', emptyValue="")
    (found,) = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(part)) if s.getPath().getName().startswith("part-")]
    fs.delete(target, False)
    if not fs.rename(found, target):
        raise OSError(f"could not move {path} into place")
    fs.delete(jvm.org.apache.hadoop.fs.Path(part), True)


def zipped(members: dict[str, bytes]) -> bytes:
    """A ZIP whose bytes depend on its members alone: sorted names, fixed times and modes."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            z.writestr(info, members[name])
    return out.getvalue()


def write_bytes(spark, path: str, data: bytes) -> None:  # noqa: ANN001
    """A small file through the file system that the path names, complete under its name or not there."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    stream.write(bytearray(data))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not move {path} into place")


def workbook(sheets: dict[str, list[tuple[str, ...]]]) -> bytes:
    """An XLSX workbook of text cells: a ZIP of XML whose bytes depend on the cells alone."""
    from xml.sax.saxutils import escape, quoteattr

    space = "http://schemas.openxmlformats.org"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    letter = lambda i: chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26)
    members, names, links, kinds = {}, "", "", ""
    for n, (name, rows) in enumerate(sheets.items(), 1):
        cells = "".join(
            f'<row r="{r}">' + "".join(f'<c r="{letter(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(row)) + "</row>"
            for r, row in enumerate(rows, 1)
        )
        members[f"xl/worksheets/sheet{n}.xml"] = f'{head}<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'.encode()
        names += f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>'
        links += f'<Relationship Id="rId{n}" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>'
        kinds += f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    members["xl/workbook.xml"] = (
        f'{head}<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>'.encode()
    )
    members["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{space}/package/2006/relationships">{links}</Relationships>'.encode()
    members["_rels/.rels"] = (
        f'{head}<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" '
        f'Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'.encode()
    )
    members["[Content_Types].xml"] = (
        f'{head}<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>'.encode()
    )
    return zipped(members)


def write_files(rows: DataFrame, path: str) -> int:
    """Each row's ``content`` as a file of its own, named by its ``name``, and how many there are.

    Tasks write them, into ``FOLDERS`` folders by a hash of the name: nothing a file goes to the driver, and none is moved
    by it. A file takes its name when it is whole, so that a task that runs again writes the same files.
    """
    where = located(rows.sparkSession, path)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(where)
        made: set[str] = set()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if "/" in name or name[:1] in ("", "_"):
                    raise ValueError(f"not a file's name: {name!r}")
                folder = f"{top}/{zlib.crc32(name.encode()) % FOLDERS:04d}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content.encode())
                store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, pa.schema([("n", pa.int64())]))

    return rows.select("name", "content").mapInArrow(per_batch, "n long").groupBy().sum("n").first()[0] or 0
