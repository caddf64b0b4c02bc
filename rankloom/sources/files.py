"""File sources and sinks: query lists, JSON lines, ranking lists (CSV, TSV, XLSX), snapshots."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rankloom.functions.scalars import norm_issn, norm_title, rank_number, text

# Words that mark a header row, and names of columns of query lists.
HEADER_WORDS = {"title", "journal", "name", "rank", "issn", "eissn", "acronym", "year", "publisher", "source", "quartile", "field"}
QUERY_NAMES = {"query_id": ("query_id", "id"), "query_text": ("query_text", "text", "query", "queryText")}


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A CSV query list as query_id, query_text and the other filled columns as a map; duplicate rows stay, blank ones go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = {new: F.coalesce(*[text(F.col(f"`{c}`")) for c in names if c in raw.columns] or [F.lit(None).cast("string")]) for new, names in QUERY_NAMES.items()}
    taken = {c for names in QUERY_NAMES.values() for c in names}
    rest = [c for c in raw.columns if c not in taken]
    more = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[text(F.col(f"`{c}`")) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return raw.select(*[c.alias(n) for n, c in known.items()], F.map_filter(more, lambda _, v: v.isNotNull()).alias("metadata")).where("query_id is not null or query_text is not null")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; a malformed line fails the read. Without a schema the objects come as VARIANT in ``value``."""
    if schema:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def latest_snapshot(paths: list[str]) -> str | None:
    """The path with the latest ``yyyymmddThhmmssZ`` stem, else the last one by name; None of none."""
    dated = [(m[0], p) for p in paths if (m := re.search(r"\d{8}T\d{6}Z", os.path.basename(p)))]
    return max(dated)[1] if dated else max(paths, default=None)


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.sheet, self.width = options["path"], options.get("sheet"), len(schema)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from ((*row[: self.width], *[None] * (self.width - len(row))) for row in xlsx_rows(partition.value, self.sheet))


class XlsxSource(DataSource):
    """``spark.read.format("xlsx_rows")``: the cells of a sheet as text columns c0, c1, ... (a list of reference size)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return ", ".join(f"c{k} string" for k in range(int(self.options.get("columns", 20))))

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options, schema)


def xlsx_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of one sheet (by name, else the first) of an XLSX file."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as book:
        shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{main}sheets/{main}sheet")
        wanted = next((s for s in sheets if s.get("name") == sheet), sheets[0])
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[wanted.get(rel)].lstrip("/")
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{main}row"):
            cells: list[str | None] = []
            for cell in row.findall(f"{main}c"):
                column = 0
                for letter in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [None] * (column - 1 - len(cells))
                value = cell.find(f"{main}v")
                inline = cell.find(f"{main}is")
                cells.append(shared[int(value.text)] if cell.get("t") == "s" and value is not None else value.text if value is not None else "".join(t.text or "" for t in inline.iter(f"{main}t")) if inline is not None else None)
            yield cells


def is_header(cells: list[str | None]) -> bool:
    """Does a row name columns: two cells or more with a header word?"""
    return sum(bool(HEADER_WORDS & set(re.findall("[a-z]+", (c or "").lower()))) for c in cells) >= 2


def read_ranking(spark: SparkSession, path: str, columns: dict[str, str | int], header: bool | None = None) -> DataFrame:
    """A ranking list (.csv, .tsv, .xlsx) as venue_key, title, title_norm, ISSNs, rank_value, rank_number.

    ``columns`` maps title and rank_value (required), key, issn_print, issn_online, issn_l to a header name or position.
    """
    if not {"title", "rank_value"} <= set(columns):
        raise ValueError("columns must name title and rank_value")
    if path.lower().endswith(".xlsx"):
        spark.dataSource.register(XlsxSource)
        raw = spark.read.format("xlsx_rows").option("path", path).load()
    else:
        raw = spark.read.option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)
    top = raw.first()
    head = list(top) if top else []
    named = is_header(head) if header is None else header
    plain = {re.sub("[^a-z0-9]", "", (h or "").lower()): k for k, h in enumerate(head)} if named else {}
    at = lambda ref: ref if isinstance(ref, int) else plain.get(re.sub("[^a-z0-9]", "", ref.lower()))
    if any(at(columns[c]) is None for c in ("title", "rank_value")):
        raise ValueError("a required column is missing")
    col = lambda c: text(F.col(raw.columns[at(columns[c])])) if c in columns and at(columns[c]) is not None else F.lit(None).cast("string")
    out = raw.select(col("key").alias("key"), col("title").alias("title"), norm_title(col("title")).alias("title_norm"), *[norm_issn(col(c)).alias(c) for c in ("issn_l", "issn_print", "issn_online")], col("rank_value").alias("rank_value"), rank_number(col("rank_value")).alias("rank_number"))
    if named:
        out = out.where(~(F.col("title").eqNullSafe(text(F.lit(head[at(columns["title"])]))) & F.col("rank_value").eqNullSafe(text(F.lit(head[at(columns["rank_value"])])))))
    return out.where("title_norm is not null").withColumn("venue_key", F.coalesce("key", "issn_l", "issn_print", "issn_online", "title_norm")).drop("key")
