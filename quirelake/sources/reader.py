"""Books as tables: one scan of files, one parse each, and the tables that come of it."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import chm, comic, djvu, epub, fb2, markdown, mobi
from .common import extension
from .model import SCHEMA, ParseError

# Parsers by extension.
PARSERS = {"epub": epub, "fb2": fb2, "cbz": comic, "cbt": comic, "chm": chm, "djvu": djvu, "djv": djvu, "mobi": mobi, "azw": mobi, "azw3": mobi, "md": markdown, "markdown": markdown, "mdx": markdown}
#: Files of an unpacked EPUB.
BUNDLE = r"(?i)^(.*\.epub)/"
#: Bytes of files whose rows a worker holds.
HELD = 8 << 20
TABLES = ("sections", "toc", "resources", "pages", "bookmarks")


def parse(path: str, content: bytes | dict[str, bytes], sections: int | None = None, resources: bool = True) -> dict:
    """A row; a file that cannot be read becomes a row with parse_error."""
    ext = extension(path)
    try:
        if ext not in PARSERS:
            raise ParseError("unsupported format")
        return PARSERS[ext].parse(content, path, sections, resources).row(path)
    except ParseError as e:
        return {"path": path, "format": {"cbt": "cbz", "djv": "djvu"}.get(ext, ext), "parse_error": str(e)}
    except Exception as e:  # a damaged file must not fail the job
        return {"path": path, "format": ext, "parse_error": f"{type(e).__name__}: {e}"}


def read_books(spark: SparkSession, path: str, thumbnails: bool = False, resources: bool = True, glob: str | None = None) -> DataFrame:
    """One row per file below path, with nested sections, toc, resources, pages and bookmarks.

    thumbnails stops after the first section and skips resources; resources=False leaves out the
    bytes of pictures and styles, which are most of a book.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    inside = F.col("path").rlike(BUNDLE)
    plain = parse_files(files.where(~inside), thumbnails, resources)
    return plain if glob else plain.unionByName(parse_bundles(files.where(inside), thumbnails, resources))


def parse_bundles(files: DataFrame, thumbnails: bool = False, resources: bool = True) -> DataFrame:
    """One row per folder whose name ends in .epub, from rows of path and content of the files in it. A book's files meet in one task."""
    schema = T._parse_datatype_string(SCHEMA)
    kinds = to_arrow_schema(schema)

    def run(data: pa.Table) -> pa.Table:
        name = data.column("book")[0].as_py()
        held = {unquote(p[len(name) + 1 :]): c for p, c in zip(data.column("path").to_pylist(), data.column("content").to_pylist(), strict=True)}
        return pa.Table.from_pylist([parse(name, held, 1 if thumbnails else None, resources and not thumbnails)], schema=kinds)

    return files.withColumn("book", F.regexp_extract("path", BUNDLE, 1)).groupBy("book").applyInArrow(run, schema)


def parse_files(files: DataFrame, thumbnails: bool = False, resources: bool = True) -> DataFrame:
    """The same for rows of path and content. What a worker has parsed is sent on after HELD bytes of files."""
    schema = T._parse_datatype_string(SCHEMA)
    kinds = to_arrow_schema(schema)
    first, whole = (1, False) if thumbnails else (None, resources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                rows.append(parse(name.as_py() or "", data, first, whole))
                held += len(data)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def read_zones(files: DataFrame) -> DataFrame:
    """Hidden text zones of DjVu files given as rows of path and content; a file that cannot be read gives none."""
    schema = T._parse_datatype_string("path string, page_idx int, zone_idx int, parent_idx int, kind string, xmin int, ymin int, xmax int, ymax int, start int, length int, text string")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = djvu.page_zones(content.as_py() or b"")
                except ParseError:
                    continue
                yield pa.RecordBatch.from_pylist([{"path": name.as_py()} | r for r in rows], schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def rows_of(books: DataFrame, part: str) -> DataFrame:
    """A nested part as a table: book, the file's path, and the part's columns."""
    return books.select(F.col("path").alias("book"), F.explode(part).alias("_r")).select("book", "_r.*")


def resource(books: DataFrame, path: str, name: str) -> DataFrame:
    """The bytes of one resource of one book."""
    return books.where(F.col("path") == path).select(F.explode("resources").alias("r")).where(F.col("r.path") == name).select("r.mime", "r.content")
