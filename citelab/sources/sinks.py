"""Writers: by key and repeatable, guarded, with manifests and failure logs."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelab.lineage import cut


def write_by_key(df: DataFrame, path: str, partition: str = "engine") -> None:
    """Rewrites only the partitions that df has rows of; a rerun gives the same files' content."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


class WouldOverwriteInput(ValueError):
    pass


def write_atomic(df: DataFrame, path: str) -> None:
    """Writes beside the path first and puts the whole in its place: a run that fails leaves what was there, and nothing of its own."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    path = path.rstrip("/")
    new, old = (f"{path}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
        there = fs.exists(at(path))
        if there and not fs.rename(at(path), at(old)):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(at(new), at(path)):
            if there:
                fs.rename(at(old), at(path))
            raise OSError(f"{new} can't be moved")
        if there:
            fs.delete(at(old), True)
    finally:
        fs.delete(at(new), True)


def write_guarded(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Refuses to overwrite a path that df is read from; other overwriting is atomic."""
    bare = lambda p: "/" + re.sub(r"^\w+:/*", "", p).strip("/") + "/"
    if any(bare(f).startswith(bare(path)) for f in df.inputFiles()):
        raise WouldOverwriteInput(path)
    if mode == "overwrite":
        write_atomic(df, path)
    else:
        df.write.mode(mode).parquet(path)


def freeze(df: DataFrame, path: str, **facts) -> None:
    """A dataset that is written once, with a manifest of its schema and facts; a second write is an error."""
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    manifest = {"schema": json.loads(df.schema.json()), "rows": spark.read.parquet(path).count(), **facts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_manifest")


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't there yet, each key once; returns how many."""
    spark: SparkSession = df.sparkSession
    once = df.dropDuplicates(keys)
    try:
        there = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        once = once.join(there.select(*keys), keys, "left_anti")
    once = cut(once)  # counted and written are the same rows, whichever of equal keys were kept
    before = once.count()
    if before:
        once.write.mode("append").parquet(path)
    return before


def failure_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Rows of a worksheet, a fixed value of the format.
SHEET_ROWS = 1_048_576


def workbook(sheets: dict[str, DataFrame], most: int = SHEET_ROWS) -> bytes:
    """An XLSX file with a sheet for each table: a head row, then its rows in order, numbers as numbers. A table that
    doesn't fit in a sheet is an error, not cut. Rows come to the driver one by one."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        names = [re.sub(r"[\[\]:*?/\\]", " ", name)[:31] for name in sheets]
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, x in enumerate(names, 1)) + "</sheets></workbook>")
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData><row>{"".join(map(cell, df.columns))}</row>'.encode())
                for k, row in enumerate(df.toLocalIterator()):
                    if k + 2 > most:
                        raise ValueError(f"{names[i - 1]} has more rows than a sheet holds")
                    f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()
