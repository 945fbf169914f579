"""Staged pages of paged boards as a Python data source (S21, S28): a partition per file, or per some files of many, and a stream of the files not yet taken.

A page is {"board", "term", "offset", "total", "jobPostings": [{"title", "externalPath", "locationsText"}]}. A file holds one, or one in each line. The folder is one that
pyarrow can open (file, hdfs, s3, gs); folders that Spark alone can read go through `files.read_directory`.
"""

from __future__ import annotations

import io
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, board string, term long, offset long, total long, position long, path string, title string, location string, error string"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


# Tasks of a read at most: beyond as many files a task reads several, one after the other.
MOST_TASKS = 1000
PAGES_PER_BATCH = 100


class Page(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _dealt(files: list[str]) -> list[Page]:
    each = max(1, -(-len(files) // MOST_TASKS))
    return [Page(files[i : i + each]) for i in range(0, len(files), each)]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def page_files(folder: str) -> list[str]:
    """Names, below the folder, of all its *.txt and *.json files, sorted; a missing folder has none. Hidden files and folders are left out."""
    from pyarrow import fs

    store, root = _open(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [x.path[len(root) :].lstrip("/") for x in found if x.type == fs.FileType.File and x.path.endswith((".txt", ".json"))]
    return sorted(n for n in names if not any(part.startswith(("_", ".")) for part in n.split("/")))


def _text(value) -> str | None:
    return None if value is None else str(value)


def _page_rows(file: str, page: dict) -> list[tuple]:
    head = (file, str(page["board"]), int(page.get("term") or 0), int(page["offset"]), int(page.get("total") or 0))
    listed = page.get("jobPostings") or []
    rows = [(*head, i, _text(p.get("externalPath")), _text(p.get("title")), _text(p.get("locationsText")), None) for i, p in enumerate(listed)]
    return rows or [(*head, None, None, None, None, None)]


def page_rows(file: str, data: bytes) -> list[tuple]:
    """The rows of a page; one row without a path for a page without postings, and one with an error for a page that is none."""
    try:
        return _page_rows(file, json.loads(data))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return [(file, None, None, None, None, None, None, None, None, type(e).__name__)]


def file_rows(file: str, lines: Iterator[bytes]) -> Iterator[list[tuple]]:
    """The rows of each page of a file: a page a line if the first line is JSON, else the whole file as one page, else what lines are pages."""
    first = next(lines, b"")
    try:
        json.loads(first)
    except ValueError:
        rest = list(lines)
        whole = page_rows(file, b"".join([first, *rest]))
        each = [page_rows(file, x) for x in (first, *rest) if x.strip()] if whole[0][-1] else []
        yield from each if any(rows[0][-1] is None for rows in each) else [whole]
    else:
        yield page_rows(file, first)
        yield from (page_rows(file, x) for x in lines if x.strip())


class _Pages:
    def __init__(self, folder: str):
        self.folder = folder

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page at all
            return
        store, root = _open(self.folder)
        for file in partition.files:
            with store.open_input_stream(f"{root}/{file}") as f:
                pages = file_rows(file, iter(io.BufferedReader(f)))
                while some := list(itertools.islice(pages, PAGES_PER_BATCH)):
                    rows = [r for page in some for r in page]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return _dealt(page_files(self.folder))


class _Stream(_Pages, DataSourceStreamReader):
    """The offset is the set of files that are taken, so a file is taken once, whenever it arrives and whatever its time."""

    def initialOffset(self) -> dict:
        return {"taken": []}

    def latestOffset(self) -> dict:
        return {"taken": page_files(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _dealt(sorted(set(end["taken"]) - set(start["taken"])))

    def commit(self, end: dict) -> None:
        pass


class StagedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages below a folder, one task per file, MOST_TASKS at most."""
    spark.dataSource.register(StagedPages)
    return spark.read.format("staged_pages").load(folder)


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a folder as they arrive; the checkpoint holds the set of those taken."""
    spark.dataSource.register(StagedPages)
    return spark.readStream.format("staged_pages").load(folder)


def board_postings(pages: DataFrame, limit: int = 100, most: int = 1000) -> DataFrame:
    """Board, path, title, location of each board's postings, one per path: the last by search term, offset and position.

    Of a board and term the pages count from offset 0 on in steps of `limit`, below `most`, as long as all before were full and lay
    below their total, as a client would have asked for them. A page read twice counts once; postings without a path are left out.
    """
    asked = pages.where("error is null").where((F.col("offset") % limit == 0) & (F.col("offset") < most))
    ok = asked.dropDuplicates(["board", "term", "offset", "position"])
    sizes = ok.groupBy("board", "term", "offset").agg(F.count("position").alias("n"), F.max("total").alias("total"))
    order = W.partitionBy("board", "term").orderBy("offset")
    goes_on = (F.col("n") >= limit) & (F.col("offset") + limit < F.col("total"))
    reached = F.coalesce(F.min(goes_on.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(1)) == 1
    kept = sizes.select("board", "term", "offset", (reached & (F.col("offset") == (F.row_number().over(order) - 1) * limit)).alias("kept")).where("kept").drop("kept")
    rows = ok.join(kept, ["board", "term", "offset"]).where("path is not null and path <> ''")
    last = F.max_by(F.struct("title", "location"), F.struct("term", "offset", "position"))
    return rows.groupBy("board", "path").agg(last.alias("p")).select("board", "path", "p.title", "p.location")
