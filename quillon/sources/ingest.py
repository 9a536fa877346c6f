"""Readers: files and columns to (source, source_type, is_scanned, text, structured, metadata).

Text, CSV, JSON, HTML and page-level decisions are built-in; office archives are unpacked
with the standard library in an Arrow stage.  Formats that need a model or a decoder that is
not installed (PDF, images, audio) yield an error row instead of failing the job.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import html_to_text, strip, word_count

SCHEMA = "source string, source_type string, is_scanned boolean, text string, structured array<map<string,string>>, metadata map<string,string>"
# Extension -> handler.
HANDLERS = {
    **dict.fromkeys(["txt", "md", "log"], "text"), **dict.fromkeys(["csv", "tsv"], "csv"), **dict.fromkeys(["xlsx", "xlsm"], "xlsx"),
    "json": "json", **dict.fromkeys(["html", "htm"], "html"), "docx": "docx", "pdf": "pdf",
    **dict.fromkeys(["png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "gif"], "image"), **dict.fromkeys(["wav", "mp3", "m4a", "ogg", "flac"], "audio"),
}
DELIMITERS = ",;\t|"
DIGITAL_CHARS = 80
#: Bytes of files that a task hands on at once.
BATCH_BYTES = 8 << 20


def decode_text(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def handler(path: Column) -> Column:
    """Handler by extension; unknown ones try text."""
    pairs = [F.lit(x) for item in HANDLERS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("text"))


def mime(content: Column, path: Column) -> Column:
    """Type by leading bytes, else by extension."""
    head = F.hex(F.substring(content, 1, 12))
    # Leading bytes of formats.
    return (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(extension(path) == "pdf", "application/pdf").when(extension(path) == "png", "image/png").when(extension(path).isin("jpg", "jpeg"), "image/jpeg")
        .otherwise("application/octet-stream")
    )


def flatten_json(text: str | None) -> tuple[str, list[dict[str, str]] | None]:
    """``a.b.0: value`` lines; rows only where the top level is a list of objects."""
    data, lines, stack = json.loads(text or "null"), [], []
    stack.append(("", data))
    while stack:
        path, value = stack.pop()
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if items is None:
            lines.append(f"{path}: {value}" if path else f"{value}")
        else:
            stack += [(f"{path}.{k}" if path else f"{k}", v) for k, v in reversed(list(items))]
    rows = [{str(k): str(v) for k, v in r.items()} for r in data if isinstance(r, dict)] if isinstance(data, list) else None
    return "\n".join(lines), rows


@F.pandas_udf(T.StringType())
def json_text(values: pd.Series) -> pd.Series:
    def one(x):
        try:
            return flatten_json(x)[0]
        except ValueError:
            return x

    return values.map(one)


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits the first lines most evenly; comma if none does."""
    lines = [x for x in sample[:4096].splitlines() if x][:20]
    best = max(DELIMITERS, key=lambda d: (min((x.count(d) for x in lines), default=0), -DELIMITERS.index(d)))
    return best if any(best in x for x in lines) else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; the delimiter is sniffed on the first lines of the data."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    table = spark.read.option("header", True).option("multiLine", True).option("sep", sniff_delimiter(head)).csv(path)
    return table.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in table.columns])


def row_text(table: DataFrame) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns])


def row_map(table: DataFrame) -> Column:
    return F.create_map(*[x for c in table.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))])


def _docx(data: bytes) -> tuple[str, None]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")

    def said(node):
        return "".join(t.text or "" for t in node.iter(f"{w}t"))

    lines = [said(p) for p in body.findall(f"{w}p") if said(p).strip()]
    for row in (r for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")):
        lines.append(" | ".join(said(c).strip() for c in row.findall(f"{w}tc")))
    return "\n".join(lines), None


def _xlsx(data: bytes) -> tuple[str, list[dict[str, str]]]:
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{m}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    lines, rows = [], []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{m}sheet"):
        name, table = sheet.get("name"), []
        lines.append(f"## Sheet: {name}")
        for row in ElementTree.fromstring(book.read("xl/" + targets[sheet.get(rel)].lstrip("/").removeprefix("xl/"))).iter(f"{m}row"):
            cells: dict[int, str] = {}
            for place, c in enumerate(row.findall(f"{m}c")):
                letters = "".join(x for x in c.get("r") or "" if x.isalpha())
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else place
                value = c.find(f"{m}v")
                text = "".join(t.text or "" for t in c.iter(f"{m}t")) if value is None else value.text or ""
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            table.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        width = max(map(len, table), default=0)
        table = [r + [""] * (width - len(r)) for r in table]
        if table:
            header = [h or f"col_{i}" for i, h in enumerate(table[0])]
            lines.append(" | ".join(header))
            for r in table[1:]:
                rows.append(dict(zip(header, r, strict=True)) | {"_sheet": name})
                lines.append(" | ".join(r))
    return "\n".join(lines), rows


def read_files(spark: SparkSession, path: str, forced: str | None = None, empty: bool = False) -> DataFrame:
    """SCHEMA rows plus ``error``; one row per file (of no bytes only with ``empty``), a failing file never fails the others."""
    if forced is not None and forced not in set(HANDLERS.values()):
        raise ValueError(f"unknown type {forced!r}")
    return ingest_bytes(file_bytes(spark, path, empty), forced)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def file_bytes(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(source, content) of the files below a folder, as Spark's binaryFile reader gives them (no hidden and no empty files).

    With ``empty``, files without bytes are rows, too, where tasks list the folder.

    Spark's reader brings the list of all files to the driver. Here the driver sees the folder's direct entries only:
    tasks list one subfolder each, or a share of it by a hash of the names. Patterns, single files and
    stores that ``pyarrow.fs`` does not know are left to Spark's reader.
    """
    try:
        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        plain = not re.search(r"[*?\[{]", path) and store.get_file_info(base).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        plain = False
    if not plain:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.col("path").alias("source"), "content")
    below = [x.path for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and not _hidden(x.base_name)]
    shares = max(1, -(-2 * spark.sparkContext.defaultParallelism // (len(below) + 1)))
    units = [(folder, i) for folder in [base, *sorted(below)] for i in range(shares)]
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else "file:"

    def read(batches):
        store, _ = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        for batch in batches:
            for folder, share in (units[i] for i in batch.column("id").to_pylist()):
                held, size = [], 0
                for x in store.get_file_info(fs.FileSelector(folder, recursive=folder != base)):
                    inner = x.path[len(folder) :].strip("/")
                    if x.type != fs.FileType.File or not (x.size or empty) or any(map(_hidden, inner.split("/"))) or zlib.crc32(inner.encode()) % shares != share:
                        continue
                    with store.open_input_stream(x.path) as f:
                        held.append((scheme + x.path, f.read()))
                    size += x.size
                    if size > BATCH_BYTES or len(held) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.binary())], ["source", "content"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.binary())], ["source", "content"])

    # Not createDataFrame: that makes a session the thread's active one, in which later calls look for data sources.
    return spark.range(0, len(units), 1, len(units)).mapInArrow(read, "source string, content binary")


def ingest_bytes(files: DataFrame, forced: str | None = None) -> DataFrame:
    """The same for a frame of (source, content)."""
    kind = F.lit(forced) if forced else handler(F.col("source"))
    rows = files.select("source", "content", kind.alias("kind"))
    simple = rows.where(F.col("kind").isin("text", "html"))
    text = decode_text(F.col("content"))
    none = F.lit(None).cast("array<map<string,string>>")
    native = simple.select(
        "source", F.col("kind").alias("source_type"), F.lit(False).alias("is_scanned"), F.when(F.col("kind") == "html", html_to_text(text)).otherwise(text).alias("text"),
        none.alias("structured"), F.create_map(F.lit("chars"), F.length(text).cast("string")).alias("metadata"), F.lit(None).cast("string").alias("error"),
    )

    def table_rows(data: bytes):
        import csv

        raw = data.decode("utf-8") if _utf8(data) else data.decode("latin-1")
        records = list(csv.DictReader(io.StringIO(raw), delimiter=sniff_delimiter(raw)))
        clean = [{k or "": v if isinstance(v, str) else "" for k, v in r.items() if k is not None} for r in records]
        header = list(clean[0]) if clean else []
        return "\n".join([" | ".join(header), *[" | ".join(r.values()) for r in clean]]) if clean else "", clean

    def decode(batches):
        for frame in batches:
            out = []
            for source, content, k in zip(frame["source"], frame["content"], frame["kind"], strict=True):
                try:
                    data = bytes(content)
                    if k == "json":
                        text_, made = flatten_json(data.decode("utf-8-sig"))
                    elif k in ("csv", "docx", "xlsx"):
                        text_, made = {"csv": table_rows, "docx": _docx, "xlsx": _xlsx}[k](data)
                    else:
                        raise NotImplementedError(f"no decoder for {k} is installed")
                    out.append((source, k, False, text_, made, {"chars": str(len(text_))}, None))
                except Exception as e:  # isolated: the row says what failed
                    out.append((source, "unknown", False, "", None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "source_type", "is_scanned", "text", "structured", "metadata", "error"])

    rest = rows.where(~F.col("kind").isin("text", "html")).mapInPandas(decode, SCHEMA + ", error string")
    return native.unionByName(rest)


def _utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def ingest_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("<inline>", "text", False, text, None, {"chars": str(len(text))})], SCHEMA)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(text, spans) from line-delimited JSON; missing spans mean none."""
    kind = "array<struct<start:int,end:int,entity:string>>"
    rows = spark.read.schema(f"text string, spans {kind}").json(path).where("text is not null")
    return rows.select("text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def page_signals(text: Column) -> Column:
    """struct(scanned, chars, distinct, wordlike): whether a page's text layer is unusable."""
    bare = F.regexp_replace(text, r"(?U)\s", "")
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    like = F.size(F.filter(tokens, lambda w: w.rlike("^[A-Za-z]{2,}"))) / F.greatest(F.size(tokens), F.lit(1))
    distinct = F.size(F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != "")))
    chars = F.length(strip(text))
    return F.struct(((chars < 50) | (distinct < 10) | (like < 0.15)).alias("scanned"), chars.alias("chars"), distinct.alias("distinct"), F.round(like, 6).alias("wordlike"))


def digital_page(text: Column) -> Column:
    return F.length(strip(text)) >= DIGITAL_CHARS


def scan_summary(pages: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Per file: pages, digital and scanned pages, needs_ocr, kind."""
    digital = digital_page(F.col(text_col))
    counts = pages.groupBy(file_col).agg(F.count("*").alias("pages"), F.count_if(digital).alias("digital_pages"), F.count_if(~digital).alias("scanned_pages"))
    kind = F.when(F.col("scanned_pages") == 0, "pdf_digital").when(F.col("digital_pages") == 0, "pdf_scanned").otherwise("pdf_mixed")
    return counts.select("*", (F.col("scanned_pages") > 0).alias("needs_ocr"), kind.alias("kind"))


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.count_if("needs_ocr").alias("scanned_files"), F.count_if(~F.col("needs_ocr")).alias("digital_files"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("scanned_pages"), F.lit(0)).alias("scanned_pages"),
    )


def assemble_lines(boxes: Column) -> Column:
    """Text lines from boxes (top, bottom, left, text): a box joins the first row that it
    overlaps by 40 % of the lower height (8 at least); rows are read from left to right."""
    item = "struct<top:double,bottom:double,left:double,text:string>"
    empty = F.array().cast(f"array<array<{item}>>")

    def step(rows: Column, b: Column) -> Column:
        def overlaps(row: Column) -> Column:
            first = F.get(row, F.lit(0))
            height = F.greatest(F.least(first["bottom"] - first["top"], b["bottom"] - b["top"]), F.lit(8.0))
            return F.least(first["bottom"], b["bottom"]) - F.greatest(first["top"], b["top"]) >= 0.4 * height

        at = F.array_position(F.transform(rows, lambda r: F.when(overlaps(r), 1).otherwise(0)), 1)
        joined = F.transform(rows, lambda r, i: F.when(i + 1 == at, F.concat(r, F.array(b))).otherwise(r))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(F.array(b))))

    rows = F.aggregate(F.array_sort(boxes.cast(f"array<{item}>")), empty, step)
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(F.transform(r, lambda b: F.struct(b["left"].alias("left"), b["text"].alias("text")))), lambda b: b["text"]), "  "))


def recognition_quality(confidence: Column) -> Column:
    return F.when(confidence > 0.85, "high").when(confidence > 0.6, "medium").otherwise("low")


def text_long_enough(text: Column) -> Column:
    return word_count(text) >= 10
