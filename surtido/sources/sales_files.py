"""Many sales files, CSV and xlsx, as one frame of raw texts.

Every reader returns the raw columns plus ``problema``: a row with a problem
stands for a whole file that could not be read. A file is known by its whole
path, ``source_file``; names repeat from folder to folder.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    MSG_BAD_FORMAT,
    MSG_EMPTY_FILE,
    MSG_LONG_HEADER,
    MSG_MISSING_COLUMNS,
    MSG_NO_SHEET,
    MSG_UNREADABLE,
    REQUIRED_COLUMNS,
    SHEET_NAME,
)
from ..operators.lookups import lookup_join
from ..operators.sales import missing_columns
from ..schemas import RAW_SALES
from ..session import materialize
from .commits import hadoop
from .uris import filesystem_of
from .xlsx import MissingSheet, sheet_rows

RAW_WITH_PROBLEM = T.StructType([*RAW_SALES.fields, T.StructField("problema", T.StringType())])
_HEADER = T.StructType([
    T.StructField("uri", T.StringType()),
    T.StructField("source_file", T.StringType()),
    *[T.StructField(f"at_{name}", T.IntegerType()) for name in ("sku", "fecha", "cantidad")],
    T.StructField("problema", T.StringType()),
])
_CSV_PATTERN = "*.[cC][sS][vV]"
_CHUNK_ROWS = 20_000
_BLOCK_BYTES = 1 << 16
#: A file whose header line does not end within so many bytes is reported, not read on.
HEADER_BYTES = 1 << 20
#: A longer line of a CSV file is no sale; it is passed over and not held in memory.
LINE_BYTES = 1 << 24
_LISTED = "ruta string, carpeta boolean, bytes bigint"


def _ending(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def list_files(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """URI, path (``source_file``), size, ending and whether empty, of the files in a folder or a list.

    Contents are not read. Folders are listed by tasks, level by level, so the
    driver sees only what ``source`` itself names. Hidden files (``_x``, ``.x``)
    are left out, as Spark's readers do.
    """
    named = []
    for pattern in [source] if isinstance(source, str) else source:
        path, store = hadoop(spark, pattern)
        found = store.globStatus(path)
        if not found:
            raise FileNotFoundError(pattern)
        named += [(s.getPath().toString(), s.isDirectory(), s.getLen()) for s in found]
    level = spark.createDataFrame(named, _LISTED)
    files = []
    while True:
        files.append(level.filter(~F.col("carpeta")))
        folders = level.filter("carpeta")
        count = folders.count()
        if not count:
            break
        slices = min(count, 4 * spark.sparkContext.defaultParallelism)
        level = materialize(folders.repartition(slices, "ruta").mapInPandas(_list_folders, _LISTED), "folders")
    name = F.element_at(F.split("source_file", "/"), -1)
    listed = reduce(DataFrame.unionByName, files).select(
        _plain("ruta").alias("source_file"), F.col("bytes"), (F.col("bytes") == 0).alias("vacio"))
    listed = listed.withColumn("ending", F.lower(F.element_at(F.split(name, r"\."), -1)))
    return materialize(listed.distinct(), "listing")


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened: dict = {}
    for batch in batches:
        rows: list = []  # of many folders: a frame for each would cost more than its listing
        for folder in batch["ruta"]:
            filesystem, inner = filesystem_of(folder, opened)
            found = filesystem.get_file_info(fs.FileSelector(inner))
            rows += [(f"{folder.rstrip('/')}/{f.base_name}", f.type == fs.FileType.Directory, f.size or 0)
                     for f in found if not f.base_name.startswith((".", "_"))]
            while len(rows) >= _CHUNK_ROWS:
                yield pd.DataFrame(rows[:_CHUNK_ROWS], columns=["ruta", "carpeta", "bytes"])
                rows = rows[_CHUNK_ROWS:]
        if rows:
            yield pd.DataFrame(rows, columns=["ruta", "carpeta", "bytes"])


def _plain(path: str) -> Column:
    """The path in one form, whoever names it: ``file:/a`` and ``file:///a`` are the same."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def hadoop_uri(path: str) -> str:
    """The path as Spark's metadata columns spell it: what a URI may not hold, in percent signs; no empty host."""
    path = re.sub("^file:/+", "file:/", path)
    return re.sub(r"[\x00-\x20\x7f\"<>\\^`{|}%#?\[\]\s]", lambda m: quote(m[0], safe=""), path)


def _missing_message(missing: list[str]) -> str:
    return MSG_MISSING_COLUMNS + ", ".join(missing)


def _first_line(path: str, opened: dict) -> str:
    """First non-blank line of a file, through the filesystem its URI names; no more than ``HEADER_BYTES`` are read."""
    filesystem, inner = filesystem_of(path, opened)
    with filesystem.open_input_stream(inner) as stream:
        data, at = bytearray(), 0  # lines before ``at`` are blank
        while True:
            block = stream.read(_BLOCK_BYTES)
            seen = max(at, len(data))
            data += block
            for end in re.finditer(rb"[\r\n]", data[seen:]):
                line = bytes(data[at : seen + end.start()])
                if line.removeprefix(b"\xef\xbb\xbf").strip():
                    return line.decode("utf-8-sig")
                at = seen + end.end()
            if not block:
                line = bytes(data[at:])
                return line.decode("utf-8-sig") if line.removeprefix(b"\xef\xbb\xbf").strip() else ""
            if len(data) >= HEADER_BYTES:
                raise LongHeader(path)


class LongHeader(ValueError):
    """The first bytes of a file hold no whole line."""


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened: dict = {}
    for batch in batches:
        found = []
        for source in batch["source_file"]:
            places, problem = (None, None, None), None
            # A failing store is no fault of the file: the error ends the task, which is tried again.
            try:
                names = next(csv.reader(io.StringIO(_first_line(source, opened))), [])
                missing = missing_columns(names)
                if not names:
                    problem = MSG_EMPTY_FILE
                elif missing:
                    problem = _missing_message(missing)
                else:
                    places = tuple(names.index(name) for name in REQUIRED_COLUMNS)
            except LongHeader:
                problem = MSG_LONG_HEADER % HEADER_BYTES
            except (UnicodeDecodeError, csv.Error) as error:
                problem = f"{MSG_UNREADABLE}{error}"
            found.append((hadoop_uri(source), source, *places, problem))
        # Object columns keep missing places null instead of turning them into NaN.
        yield pd.DataFrame(found, columns=_HEADER.names, dtype=object)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists named files with a task for each of up to 10,000; inside this, with a few for each core."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_csv_files(
    spark: SparkSession, source: str | list[str], listed: DataFrame, multiline: bool = False
) -> DataFrame:
    """CSV files, each row taken by its own file's header.

    Spark binds CSV columns by place and files may order them differently, so
    every file's header line is read first, in parallel, and the one scan of the
    data looks the places up by file. ``multiline`` allows line breaks inside
    quotes, at the price of reading each file in one task.
    """
    files = listed.filter((F.col("ending") == "csv") & ~F.col("vacio")).select("source_file")
    # One small read per file. A fixed number of slices, because by their bytes
    # a million paths would look like work for one task.
    slices = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    headers = materialize(files.repartition(slices, "source_file").mapInPandas(_read_headers, _HEADER), "headers")
    at = ["at_sku", "at_fecha", "at_cantidad"]
    last = headers.agg(F.max(F.greatest(*at))).first()[0]
    problems = headers.filter(F.col("problema").isNotNull()).select(
        "source_file", *[F.lit(None).cast("string").alias(f.name) for f in RAW_SALES.fields[1:]], "problema"
    )
    if last is None:
        return problems
    columns = [f"c{i}" for i in range(last + 1)]
    paths = source if isinstance(source, str) else [p for p in source if _ending(p) == "csv"]
    reader = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _CSV_PATTERN)
        .schema(", ".join(f"{c} string" for c in columns))
        .option("header", "true").option("escape", '"').option("mode", "PERMISSIVE")
        .option("multiLine", str(multiline).lower())
        .option("mapreduce.input.linerecordreader.line.maxlength", str(LINE_BYTES))
    )
    with _few_listing_tasks(spark):
        rows = reader.csv(paths).select(F.array(*columns).alias("values"), F.col("_metadata.file_path").alias("uri"))
    places = headers.filter(F.col("problema").isNull()).drop("problema")
    taken = lookup_join(rows, places, "uri", "inner")
    return taken.select(
        "source_file",
        *[F.get("values", F.col(a)).alias(f.name) for a, f in zip(at, RAW_SALES.fields[1:])],
        F.lit(None).cast("string").alias("problema"),
    ).unionByName(problems)


def _workbook_frames(book, source: str) -> Iterator[pd.DataFrame]:
    def problem(text: str) -> pd.DataFrame:
        return pd.DataFrame([(source, None, None, None, text)], columns=RAW_WITH_PROBLEM.names)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=RAW_WITH_PROBLEM.names)

    rows = sheet_rows(book, SHEET_NAME)
    header = next(rows, None)
    if header is None:
        yield problem(MSG_EMPTY_FILE)
        return
    missing = missing_columns(name for name in header if name)
    if missing:
        yield problem(_missing_message(missing))
        return
    places = [header.index(name) for name in REQUIRED_COLUMNS]
    chunk = []
    for row in rows:
        chunk.append((source, *(row[i] if i < len(row) else None for i in places), None))
        if len(chunk) == _CHUNK_ROWS:
            yield frame(chunk)
            chunk = []
    yield frame(chunk)


def _read_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened: dict = {}
    for batch in batches:
        for source in batch["source_file"]:
            text = None
            filesystem, inner = filesystem_of(source, opened)
            try:
                # Only the zip's directory and the parts that are needed are read, range by range.
                with filesystem.open_input_file(inner) as book:
                    yield from _workbook_frames(book, source)
            except MissingSheet:
                text = MSG_NO_SHEET
            except OSError:
                raise  # a failing store is no fault of the file
            except Exception as error:  # noqa: BLE001 - any damage makes this one file invalid
                text = f"{MSG_UNREADABLE}{error}"
            if text:
                yield pd.DataFrame([(source, None, None, None, text)], columns=RAW_WITH_PROBLEM.names)


def read_workbooks(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """Sheet ``Detalle`` of Excel files, spread over tasks file by file; no file has to fit in a value or in memory.

    A workbook that breaks half way gives rows as well as a problem; whoever
    stores the rows leaves out those of files with a problem.
    """
    files = listed.filter(F.col("ending").isin("xlsx", "xls") & ~F.col("vacio")).select("source_file")
    slices = max(1, min(files.count(), 16 * spark.sparkContext.defaultParallelism))
    return files.repartition(slices, "source_file").mapInPandas(_read_workbooks, RAW_WITH_PROBLEM)


def unsupported_files(listed: DataFrame) -> DataFrame:
    """A problem for each file that is empty or neither CSV nor Excel."""
    known = F.col("ending").isin("csv", "xlsx", "xls")
    return listed.filter(~known | F.col("vacio")).select(
        "source_file",
        *[F.lit(None).cast("string").alias(f.name) for f in RAW_SALES.fields[1:]],
        F.when(known, MSG_EMPTY_FILE).otherwise(MSG_BAD_FORMAT).alias("problema"),
    )


def read_sales_files(
    spark: SparkSession, source: str | list[str], listed: DataFrame, multiline: bool = False
) -> DataFrame:
    """All sales files of a folder or a list, by extension; ``listed`` is its ``list_files``."""
    return (
        read_csv_files(spark, source, listed, multiline)
        .unionByName(read_workbooks(spark, listed))
        .unionByName(unsupported_files(listed))
    )
