"""Stored pages as a data source of its own, in batches and as a stream: each host's pages in one partition, spaced in time.

    spark.dataSource.register(StoredPages)
    spark.read.format("stored_pages").option("path", folder).load()
    spark.readStream.format("stored_pages").option("path", folder).load()

Options: path (a parquet file or a folder of them with page_id, url and html, by any path that Arrow's file systems read), buckets (partitions
a read is dealt over), spacing (seconds between two pages of one host), wait (true: a page is given only when it is due).

Pages have positions: files in the order of their times and names, rows in theirs. A stream's offset is a position, so what is added later is read
later, once. Hosts are dealt over buckets by a hash; a bucket's partition reads addresses first and bodies only of row groups
that hold pages of its own. `due` is the time from the partition's start at which a page may be asked: its number among those of its host in this
read, times the spacing; nothing needs a lock, since no other partition asks that host.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page_id long, url string, host string, fetch_status string, content_length long, html string, position long, due double"
_HOST = re.compile(r"[^:/?#]+://([^/?#]*)")
#: Rows read at once.
ROWS = 512


@dataclass
class Bucket(InputPartition):
    """Positions from `start` to before `end`, of them the hosts of one bucket."""

    bucket: int
    start: int
    end: int


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1] if m else ""


class _Stored:
    """What batch and stream readers share: the files, their rows' positions, and how a bucket is read."""

    def __init__(self, options: dict) -> None:
        self.path, self.buckets = options["path"], int(options.get("buckets", 8))
        self.spacing, self.wait = float(options.get("spacing", 0.1)), str(options.get("wait", "false")).lower() == "true"

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        if len(urlparse(self.path).scheme) > 1:
            fs, path = pafs.FileSystem.from_uri(self.path)
        else:
            fs, path = pafs.LocalFileSystem(), self.path
        if fs.get_file_info(path).type == pafs.FileType.File:
            return fs, [path]
        found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".parquet")]
        return fs, [f.path for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path))]

    def rows(self) -> int:
        """From the files' footers."""
        fs, files = self._files()
        return sum(pq.read_metadata(f, filesystem=fs).num_rows for f in files)

    def split(self, start: int, end: int) -> list[Bucket]:
        return [Bucket(b, start, end) for b in range(self.buckets)] if end > start else []

    def read(self, part: Bucket) -> Iterator[pa.RecordBatch]:
        fs, files = self._files()
        asked: dict[str, int] = {}
        began, at = time.monotonic(), 0
        for name in files:
            with pq.ParquetFile(name, filesystem=fs) as f:
                for g in range(f.num_row_groups):
                    n = f.metadata.row_group(g).num_rows
                    first, at = at, at + n
                    if at <= part.start or first >= part.end:
                        continue
                    urls = f.read_row_group(g, ["url"]).column(0).to_pylist()
                    own = [i for i, u in enumerate(urls) if part.start <= first + i < part.end and zlib.crc32(host_of(u).encode()) % self.buckets == part.bucket]
                    if own:
                        yield from self._bodies(f, g, own, first, asked, began)

    def _bodies(self, f: pq.ParquetFile, g: int, own: list[int], first: int, asked: dict[str, int], began: float) -> Iterator[pa.RecordBatch]:
        wanted, seen = iter(own), 0
        nxt = next(wanted, None)
        for batch in f.iter_batches(ROWS, row_groups=[g], columns=["page_id", "url", "html"]):
            here = []
            while nxt is not None and nxt < seen + batch.num_rows:
                here.append(nxt - seen)
                nxt = next(wanted, None)
            if here:
                yield from self._due(batch.take(pa.array(here)), [first + seen + i for i in here], asked, began)
            seen += batch.num_rows

    def _due(self, pages: pa.RecordBatch, positions: list[int], asked: dict[str, int], began: float) -> Iterator[pa.RecordBatch]:
        page_id, url, html = (pages.column(pages.schema.get_field_index(n)) for n in ("page_id", "url", "html"))
        hosts = [host_of(u) for u in url.to_pylist()]
        due = []
        for h in hosts:
            asked[h] = asked.get(h, -1) + 1
            due.append(asked[h] * self.spacing)
        ok = pc.greater(pc.binary_length(pc.fill_null(pc.utf8_trim_whitespace(html), "")), 0)
        columns = [page_id.cast(pa.int64()), url.cast(pa.string()), pa.array(hosts), pc.if_else(ok, "ok", "empty_response"), pc.fill_null(pc.binary_length(html), 0).cast(pa.int64()), html.cast(pa.string()), pa.array(positions, pa.int64()), pa.array(due, pa.float64())]
        made = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])
        if not self.wait:
            yield made
            return
        for i, t in enumerate(due):
            left = began + t - time.monotonic()
            if left > 0:
                time.sleep(left)
            yield made.slice(i, 1)


class BatchReader(DataSourceReader):
    def __init__(self, stored: _Stored) -> None:
        self.stored = stored

    def partitions(self) -> list[Bucket]:
        return self.stored.split(0, self.stored.rows())

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return self.stored.read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, stored: _Stored) -> None:
        self.stored = stored

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": self.stored.rows()}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        return self.stored.split(start["position"], end["position"])

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        return self.stored.read(partition)


class StoredPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(_Stored(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(_Stored(self.options))


def stored_pages(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """The pages below a path by this source."""
    spark.dataSource.register(StoredPages)
    reader = spark.readStream if stream else spark.read
    return reader.format("stored_pages").options(path=path, **options).load()
