"""First lines of text files, without reading the files."""

from __future__ import annotations

import csv
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are looked at for its first line.
FIRST_BYTES = 1 << 16
#: Files opened at a time.
THREADS = 16
# What has a meaning in the path patterns of the readers.
PATTERN_SIGNS = "\\{}[]*?"


def literal_path(path: str) -> str:
    """A path that readers take for itself, whatever signs its names contain."""
    return "".join(f"\\{c}" if c in PATTERN_SIGNS else c for c in path)


def list_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files that a read of ``paths`` takes, as the store names them."""
    return sorted(set(spark.read.text(paths).inputFiles()))


#: The column by which rows find their file in ``file_table``, ``_metadata.file_path`` of both.
FILE = "_file"


def decoded_path() -> Column:
    """Decoded path of the file a row comes from."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def encoded_path(spark: SparkSession, path: str) -> str:
    """A decoded path as ``_metadata.file_path`` gives it."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def file_table(spark: SparkSession, paths: dict[str, str], columns: list[Column]) -> DataFrame:
    """(_file, columns): a row for each file, with columns made of its decoded ``path``.

    ``paths`` has the decoded path by the encoded one. Rows are joined with what their path says
    instead of parsing it anew; the planner knows the size of the table, and no job is run for it.
    """
    names = pa.table({FILE: pa.array(paths.keys(), pa.string()), "path": pa.array(paths.values(), pa.string())})
    return spark.createDataFrame(names).select(FILE, *columns)


def _opened(spark: SparkSession, paths: str | list[str], read: Callable) -> dict[str, str]:
    """What ``read`` takes from the beginning of every file, by decoded path.

    Each file is opened through its store, several at a time, so the cost is one short request a
    file, however large the files are. Compressed files are recognised by their name, as the readers do.
    """
    jvm = spark._jvm
    settings = spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings)

    def look(name: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        source = path.getFileSystem(settings).open(path)
        try:
            codec = codecs.getCodec(path)
            return path.toString(), read(codec.createInputStream(source) if codec else source)
        finally:
            source.close()

    names = list_files(spark, paths)
    with ThreadPoolExecutor(min(THREADS, max(1, len(names)))) as pool:
        return dict(pool.map(look, names))


def first_lines(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """First line with any text of every file, by decoded path; empty where there is none.

    It is looked for in the first FIRST_BYTES; a line longer than that is cut.
    """
    hadoop = spark._jvm.org.apache.hadoop

    def read(source) -> str:
        lines, text, left = hadoop.util.LineReader(source), hadoop.io.Text(), FIRST_BYTES
        while left > 0:
            got = lines.readLine(text, left, left)
            if got <= 0 or text.toString().strip():
                break
            left -= got
        return text.toString().strip("\r\n")

    return _opened(spark, paths, read)


def beginnings(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """The text of the first FIRST_BYTES of every file, by decoded path."""
    hadoop = spark._jvm.org.apache.hadoop
    never = bytes([0, 1, 0, 1])

    def read(source) -> str:
        text = hadoop.io.Text()
        hadoop.util.LineReader(source, never).readLine(text, FIRST_BYTES, FIRST_BYTES)
        return text.toString()

    return _opened(spark, paths, read)


def fields(line: str) -> list[str]:
    """The cells of a CSV header line, without a byte order mark or space around them."""
    cells = next(csv.reader([line.removeprefix("\ufeff")]), [])
    return [c.strip() for c in cells]


def distinct_names(names: list[str]) -> list[str]:
    """``names`` with a number behind those that are empty or repeat an earlier one, in any case."""
    out: list[str] = []
    taken = {n.lower() for n in names}
    seen: set[str] = set()
    for i, name in enumerate(names):
        if not name or name.lower() in seen:
            name = f"{name}_c{i}"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        seen.add(name.lower())
        out.append(name)
    return out
