"""Sources: library files and what they hold, JSON records, HTML pages."""

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: File types of the library (fixed values).
SUFFIXES = ["docx", "doc", "xlsx", "xls", "pdf", "txt"]
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_SHEETS, MOST_ROWS, MOST_COLUMNS, MOST_TABLE = 20, 500, 100, 10_000


def library_files(spark: SparkSession, root: str) -> DataFrame:
    """name, size, mtime, path of the library's files (not those of folders below)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "path")


def numbered(kind: str, n: int) -> str:
    """A list number as its kind writes it: decimal, lowerLetter, upperLetter, lowerRoman, upperRoman, bullet."""
    if kind == "bullet":
        return "•"
    if kind.endswith("Letter"):
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
    elif kind.endswith("Roman"):
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // value), n % value
    else:
        return str(n)
    return out.upper() if kind.startswith("upper") else out


def outline(levels: list[int]) -> list[str]:
    """Heading numbers of levels in order: a level counts on, deeper ones begin anew."""
    counts, out = [], []
    for level in levels:
        counts = (counts + [0] * level)[:level]
        counts[-1] += 1
        out.append(".".join(str(c or 1) for c in counts))
    return out


def read_docx(data: bytes) -> str:
    """Paragraphs and tables of a Word file in order; headings numbered; a table's rows as `a | b`."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t"))
    out, levels = [], []
    for node in body if body is not None else []:
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            heading = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{WORD}val", "")) if style is not None else None
            line = text(node)
            if heading and line.strip():
                levels.append(int(heading[1]))
                line = f"{outline(levels)[-1]} {line}"
            if line.strip():
                out.append(line)
        elif node.tag == f"{WORD}tbl":
            rows = [" | ".join(text(c).strip() for c in r.iter(f"{WORD}tc")) for r in node.iter(f"{WORD}tr")]
            out.append("\n".join(rows)[:MOST_TABLE])
    return "\n".join(out)


def markdown(rows: list[list[str]]) -> str:
    """A table as markdown; the first row is the header if most of its cells are short texts."""
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    short = sum(1 for c in rows[0] if c and len(c) < 40) >= 0.6 * width
    head, body = (rows[0], rows[1:]) if short else ([f"Column {i + 1}" for i in range(width)], rows)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *body])


def read_xlsx(data: bytes) -> str:
    """Sheets of an Excel file as markdown tables under `[Sheet: name]`, without empty rows and columns."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet")]
        out = []
        for k, title in enumerate(titles[:MOST_SHEETS], 1):
            path = f"xl/worksheets/sheet{k}.xml"
            if path not in names:
                continue
            grid = []
            for r in list(ElementTree.fromstring(z.read(path)).iter(f"{SHEET}row"))[:MOST_ROWS]:
                row: dict[int, str] = {}
                for i, c in enumerate(r.iter(f"{SHEET}c")):
                    letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    value = c.find(f"{SHEET}v")
                    cell = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if value is None else value.text or ""
                    row[(col or i + 1) - 1] = strings[int(cell)] if c.get("t") == "s" and cell else cell
                grid.append([row.get(j, "") for j in range(min(max(row, default=-1) + 1, MOST_COLUMNS))])
            width = max(map(len, grid), default=0)
            some = [j for j in range(width) if any(j < len(r) and r[j] for r in grid)]
            rows = [[r[j] if j < len(r) else "" for j in some] for r in grid if any(r)]
            if rows:
                out.append(f"[Sheet: {title}]\n{markdown(rows)}")
    return "\n\n".join(out)


READERS = {"txt": lambda b: b.decode("utf-8", "ignore"), "docx": read_docx, "xlsx": read_xlsx}


def read_texts(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """name, text of the library's files: by suffix; a file that cannot be read, or whose type has no reader here, gives
    a text that begins with [READ_ERROR]."""

    def read(batches):
        for b in batches:
            texts = []
            for name, data in zip(b["name"], b["content"], strict=True):
                try:
                    text = READERS[name.rsplit(".", 1)[-1].lower()](bytes(data))
                except Exception as e:  # whatever a broken file raises becomes its row
                    text = f"[READ_ERROR] {type(e).__name__}"
                texts.append(text[:most] if most else text)
            yield pd.DataFrame({"name": b["name"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(read, "name string, text string")


def read_records(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """JSON lines with a schema: lines that do not parse or lack the key are skipped, of equal keys the last line counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(key).isNotNull())
    rows = rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "_at")


def page_text(html) -> F.Column:
    """Text of an HTML page: without scripts, styles and tags, entities of the basic five, single spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
