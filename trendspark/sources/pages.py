"""Reads that happen at the source (SRC-9): a data source over landed pages.

Records are landed as pages, Parquet files of one stretch of time each, newest
first, with an index of their dates and row counts. The ``landed_pages``
source takes the column list, date bounds and row cap that a remote service
would take: pages outside the bounds, and pages older than the newest ``cap``
rows inside them, are not opened, and of the others only the asked columns are
read. A task reads a run of pages, a batch at a time.

The bounds come as options or, where the session pushes filters to Python
sources (``spark.sql.python.filterPushdown.enabled``), from the query itself;
Spark checks pushed filters again, so they only ever save work.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
                                    LessThanOrEqual)

NAME = "landed_pages"


def land_pages(df: DataFrame, path: str, date_col: str, pages: int) -> None:
    """Write ``df`` as about ``pages`` pages by falling date, and their index
    (file, lo, hi, rows; one row a page)."""
    newest = F.col(date_col).desc_nulls_last()
    df.repartitionByRange(pages, newest).sortWithinPartitions(newest).write.mode("overwrite").parquet(f"{path}/pages")
    rows = df.sparkSession.read.parquet(f"{path}/pages")
    index = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"), F.count(F.lit(1)).alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}" if path.startswith(("/", "file:/")) else path)


@dataclass
class Pages(InputPartition):
    """A task's pages: file names."""
    files: tuple[str, ...]


class LandedPages(DataSource):
    """Options: path; dateColumn; columns (comma-joined; default: all);
    since, until (ISO, inclusive); cap (the newest rows); pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _page_schema(self):
        import pyarrow.parquet as pq
        f, root = _open(self.options["path"])
        first = sorted(x.path for x in f.get_file_info(_below(f"{root}/pages")) if x.path.endswith(".parquet"))[0]
        with f.open_input_file(first) as file:
            return pq.read_schema(file)

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema
        whole = from_arrow_schema(self._page_schema())
        names = [c for c in self.options.get("columns", "").split(",") if c] or whole.names
        return T.StructType([whole[c] for c in names])

    def reader(self, schema: T.StructType) -> "PageReader":
        filtering = self.options.get("pushFilters", "false") == "true"
        return (FilteringPageReader if filtering else PageReader)(schema, dict(self.options))


def _below(path: str):
    from pyarrow import fs
    return fs.FileSelector(path)


def _moment(text) -> dt.datetime:
    if isinstance(text, dt.datetime):
        return text.replace(tzinfo=None)
    if isinstance(text, dt.date):
        return dt.datetime(text.year, text.month, text.day)
    return dt.datetime.fromisoformat(text)


class PageReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        options = self.options
        self.date_column = options.get("datecolumn")
        self.since = _moment(options["since"]) if options.get("since") else None
        self.until = _moment(options["until"]) if options.get("until") else None
        self.dated = self.since is not None or self.until is not None

    def _index(self) -> list[dict]:
        """The pages' index, newest first (a row a page on the driver)."""
        import pyarrow.parquet as pq
        f, root = _open(self.options["path"])
        rows = pq.read_table(f"{root}/index", filesystem=f).to_pylist()
        return sorted(rows, key=lambda r: (r["hi"] is not None, r["hi"] or dt.datetime.min, r["file"]), reverse=True)

    def partitions(self) -> list[Pages]:
        inside = lambda r: not self.dated or (r["hi"] is not None and (self.since is None or _moment(r["hi"]) >= self.since)
                                              and (self.until is None or _moment(r["lo"]) <= self.until))
        pages = [r for r in self._index() if inside(r)]
        cap = int(self.options["cap"]) if self.options.get("cap") else None
        if cap is not None:
            kept, sure, floor = [], 0, None   # rows that surely lie inside the bounds
            for r in pages:
                if floor is not None and (r["hi"] is None or _moment(r["hi"]) < floor):
                    break
                kept.append(r)
                whole = r["hi"] is not None and (self.until is None or _moment(r["hi"]) <= self.until) and (self.since is None or _moment(r["lo"]) >= self.since)
                sure += r["rows"] if whole or not self.dated else 0
                if floor is None and sure >= cap and r["lo"] is not None:
                    floor = _moment(r["lo"])   # older pages cannot have one of the newest rows
            pages = kept
        step = int(self.options.get("pagespertask") or 1)
        files = [r["file"] for r in pages]
        return [Pages(tuple(files[i:i + step])) for i in range(0, len(files), step)]

    def read(self, partition: Pages) -> Iterator:
        import pyarrow.parquet as pq
        f, root = _open(self.options["path"])
        for name in partition.files:
            with f.open_input_file(f"{root}/pages/{name}") as file:
                yield from pq.ParquetFile(file).iter_batches(columns=self.schema.names)


class FilteringPageReader(PageReader):
    """For sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - the name is the interface's
        """Bounds on the date column become the page bounds; all filters are
        left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.date_column,):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = _moment(f.value)
                    self.since, self.dated = max(self.since, low) if self.since else low, True
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = _moment(f.value)
                    self.until, self.dated = min(self.until, high) if self.until else high, True
            yield f


def read_pages(spark, path: str, date_col: str, columns: list[str] | None = None, since: dt.datetime | None = None,
               until: dt.datetime | None = None, cap: int | None = None, pages_per_task: int = 1) -> DataFrame:
    """Rows of the landed pages between the bounds; with ``cap`` those pages
    that hold the newest ``cap`` of them (the caller sorts and limits)."""
    spark.dataSource.register(LandedPages)
    wanted = columns or []
    reader = spark.read.format(NAME).option("path", path).option("dateColumn", date_col).option("pagesPerTask", str(pages_per_task))
    reader = reader.option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    reader = reader.option("columns", ",".join([*wanted, *([date_col] if wanted and date_col not in wanted else [])]))
    for name, value in (("since", since), ("until", until)):
        reader = reader.option(name, value.isoformat()) if value else reader
    rows = (reader.option("cap", str(cap)) if cap is not None else reader).load()
    if since:
        rows = rows.where(F.col(date_col) >= F.lit(since.isoformat(" ")).cast("timestamp_ntz"))
    if until:
        rows = rows.where(F.col(date_col) <= F.lit(until.isoformat(" ")).cast("timestamp_ntz"))
    return rows.select(*wanted) if wanted else rows
