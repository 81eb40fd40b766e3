"""Pages of a remote search or stream, landed as files, as a Spark data source that follows their cursors.

A page is one JSON file: path/<query>/<cursor>.json. Pages of a search hold
`results` and `next`, those of a stream `items` and `continuation`; next and
continuation name the cursor of the page that follows, the first page's cursor
is `first`. Fetching is somebody else's work: it lands pages as they come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

SCHEMA = "query string, page int, place int, link string, title string, filed string, body string"
#: (name of the results, name of the next cursor) by kind of page.
KINDS = {"search": ("results", "next"), "stream": ("items", "continuation")}
FIRST = "first"


def file_of(query: str, cursor: str) -> str:
    """Where a page lies below the folder of all pages."""
    return f"{quote(query, safe='')}/{quote(cursor, safe='')}.json"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Page(InputPartition):
    query: str
    number: int
    path: str


class PagedReader(DataSourceReader):
    """One partition a page. Planning follows the cursors of each query, page by page, up to max_pages, and stops at
    a cursor whose page is not there, at one that was met before, and, in streams, at a page without items."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "search")
        self.max_pages = int(options.get("max_pages", "3"))
        self.queries: set[str] | None = None
        self.after = options.get("filed_after")
        self.before = options.get("filed_before")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Date bounds and queries are taken over; what is not goes back to Spark."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("filed",):
                self.after = max(filter(None, (self.after, f.value)))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("filed",):
                self.before = min(filter(None, (self.before, f.value)))
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = wanted if self.queries is None else self.queries & wanted
            else:
                yield f

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        files, root = _files(self.path)
        results, following = KINDS[self.kind]
        out: list[Page] = []
        for info in sorted(files.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            query = unquote(info.base_name)
            if info.type != fs.FileType.Directory or (self.queries is not None and query not in self.queries):
                continue
            cursor, met = FIRST, set()
            while cursor and cursor not in met and len(met) < self.max_pages:
                met.add(cursor)
                page = f"{root}/{file_of(query, cursor)}"
                if files.get_file_info(page).type != fs.FileType.File:
                    break
                out.append(Page(query, len(met), page))
                with files.open_input_stream(page) as f:
                    read = json.loads(f.read())
                cursor = read.get(following) if read.get(results) or self.kind == "search" else None
                cursor = cursor if isinstance(cursor, str) else None
        return out

    def read(self, page: Page | None) -> Iterator[tuple]:
        if page is None:  # there is no page at all
            return
        files, _ = _files(self.path)
        with files.open_input_stream(page.path) as f:
            found = json.loads(f.read()).get(KINDS[self.kind][0])
        for place, hit in enumerate(found if isinstance(found, list) else []):
            if not isinstance(hit, dict) or not hit.get("link"):
                continue
            filed = hit.get("filed")
            if (self.after and not (filed and filed >= self.after)) or (self.before and not (filed and filed <= self.before)):
                continue
            yield page.query, page.number, place, hit["link"], hit.get("title"), filed, hit.get("body")


class LandedPages(DataSource):
    """spark.read.format("landed_pages"): options path, kind (search or stream), max_pages, filed_after, filed_before."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """All hits of all pages that the cursors lead to. Bounds on `filed` and `query` go to the source."""
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("landed_pages").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def each_link_once(hits: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The first hit of each link, by query, page and place; `within` a query if that is given."""
    keys = [*(within or []), "link"]
    others = F.struct(*[c for c in hits.columns if c not in keys])
    first = hits.groupBy(*keys).agg(F.min_by(others, F.struct("query", "page", "place") if not within else F.struct("page", "place")).alias("_hit"))
    return first.select(*keys, "_hit.*").select(*hits.columns)


def land(hits: DataFrame, path: str, kind: str = "search") -> None:
    """Write hits (query, page, link, title, filed, body) as landed pages; `page` numbers a query's pages in any ascending way.

    One file a page, written by the task that holds it; a page's hits are in
    the order of their links.
    """
    results, following = KINDS[kind]
    pages = hits.groupBy("query", "page").agg(F.array_sort(F.collect_list(F.struct("link", "title", "filed", "body"))).alias("hits"))
    order = Window.partitionBy("query").orderBy("page")
    numbers = hits.select("query", "page").distinct().withColumns({"nth": F.row_number().over(order), "then": F.lead("page").over(order)})
    cursor = F.when(F.col("nth") == 1, FIRST).otherwise(F.concat(F.lit("p"), F.col("page")))
    following_cursor = F.when(F.col("then").isNotNull(), F.concat(F.lit("p"), F.col("then")))
    body = F.to_json(F.struct(F.col("hits").alias(results), following_cursor.alias(following)))
    rows = pages.join(numbers, ["query", "page"]).select("query", cursor.alias("cursor"), body.alias("body"))

    def write(batches: Iterator) -> Iterator:
        files, root = _files(path)
        for b in batches:
            for query, at, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                name = f"{root}/{file_of(query, at)}"
                files.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(name) as f:  # the same bytes if a task runs twice
                    f.write(text.encode())
            yield b.select(["query"])

    rows.mapInArrow(write, "query string").count()
