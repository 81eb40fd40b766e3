"""Parsers of pages and payloads: HTML metadata, links, visible text, JSON and feeds."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "noscript", "template", "head"}
#: Names of meta elements, in order of precedence.
_DATES = ("article:published_time", "og:published_time", "pubdate", "publish-date", "date", "dc.date.issued")
_TITLES, _ABOUT = ("og:title", "twitter:title"), ("og:description", "description", "twitter:description")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.links, self.text, self.times = "", {}, [], [], []
        self._hidden, self._in_title = [], False

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag == "title":
            self._in_title = True
        elif tag == "meta":
            name = (named.get("property") or named.get("name") or named.get("itemprop") or "").lower()
            if named.get("content", "").strip():
                self.meta.setdefault(name, named["content"])
            if (named.get("name") or "").lower() == "citation_pdf_url" and named.get("content"):
                self.links.append((0, named["content"]))
        elif tag == "time" and named.get("datetime"):
            self.times.append(named["datetime"])
        elif tag == "a" and named.get("href"):
            self.links.append((2, named["href"]))
        elif tag == "link" and named.get("href") and named.get("type", "").lower() == "application/pdf":
            self.links.append((1, named["href"]))
        if tag in _SKIP:
            self._hidden.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if tag in self._hidden:
            while self._hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._hidden:
            self.text.append(data)


def _parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _date(text: str | None) -> str | None:
    """An ISO or RFC 2822 date as ISO text in UTC; without a zone it is UTC; null if it is neither."""
    text = (text or "").strip()
    for read in (lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            found = read(text)
            return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
        except (TypeError, ValueError, IndexError, OverflowError):
            continue
    return None


def _plain(text: str) -> str:
    return " ".join(text.split())


_TEXT = T.StringType()
_PARTS = T.StructType([T.StructField(c, _TEXT) for c in ("title", "description", "published", "text")] + [T.StructField("links", T.ArrayType(_TEXT))])


@F.pandas_udf(_PARTS)
def page_parts(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title (og and twitter over title), description, first date that can be read (as it stands there), visible text, and hrefs in page order."""
    for series in pages:
        rows = []
        for html in series:
            p = _parse(html)
            published = next((d.strip() for d in [*map(p.meta.get, _DATES), *p.times] if _date(d)), None)
            about = _plain(next((p.meta[k] for k in _ABOUT if k in p.meta), "")) or None
            title = _plain(next((p.meta[k] for k in _TITLES if k in p.meta), p.title))
            rows.append((title, about, published, _plain(" ".join(p.text)), [h for rank, h in p.links if rank == 2]))
        yield pd.DataFrame(rows, columns=["title", "description", "published", "text", "links"])


def plain_text(text: Column) -> Column:
    """Text without tags and entities, white space collapsed; only texts with a tag are parsed."""
    fast = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.contains(text, F.lit("<")), page_parts(text)["text"]).otherwise(fast)


@F.udtf(returnType=T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("url", _TEXT)]))
class SameSiteLinks:
    """Links of a page on its own host and under its own parent path, each once, in page order."""

    def eval(self, url: str, html: str):
        base = urlsplit(url or "")
        parent, seen = base.path.rpartition("/")[0] + "/", set()
        for rank, href in _parse(html).links:
            if rank < 2:
                continue
            full = urljoin(url or "", href)
            at = urlsplit(full)
            if at.netloc == base.netloc and at.path.startswith(parent) and full not in seen:
                seen.add(full)
                yield len(seen), full


@F.udtf(returnType=T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("url", _TEXT)]))
class PdfLinks:
    """PDF links of a page, each once: those its citation names, then those typed as PDF, then links that end in .pdf."""

    def eval(self, url: str, html: str):
        found = [(rank, urljoin(url or "", href)) for rank, href in _parse(html).links]
        found = [(rank, full) for rank, full in found if rank < 2 or urlsplit(full).path.lower().endswith(".pdf")]
        for nth, full in enumerate(dict.fromkeys(full for _, full in sorted(found, key=lambda x: x[0])), 1):
            yield nth, full


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON; blank and corrupt lines are left out."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RSS or Atom entries with title and a link over HTTP, one for each link of a file; dates in RFC 2822 or ISO form.

    An Atom entry's link is its first of relation "alternate" or none.
    """
    link = "array<struct<_VALUE string, _href string, _rel string>>"
    schema = f"title string, link {link}, description string, summary string, pubDate string, published string, updated string"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("file", F.input_file_name())
    urls = F.transform("link", lambda x: F.when(F.trim(x["_VALUE"]) != "", F.trim(x["_VALUE"])).when(F.coalesce(x["_rel"], F.lit("alternate")) == "alternate", F.trim(x["_href"])))
    rows = rows.withColumn("link", F.get(F.filter(urls, lambda u: u.rlike("^https?://")), F.lit(0)))
    stamp = F.coalesce(
        F.try_to_timestamp(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp("published"),
        F.try_to_timestamp("updated"),
        F.try_to_timestamp("pubDate"),
    )
    found = rows.where("trim(title) <> '' and link is not null")
    found = found.select("file", F.trim("title").alias("title"), "link", F.coalesce("description", "summary").alias("summary"), stamp.alias("published"))
    return found.dropDuplicates(["file", "link"]).drop("file")


def tweets(payload: Column) -> Column:
    """Posts of a timeline payload: title of at most 120 characters, summary of at most 500."""
    schema = "data array<struct<id string, text string, created_at string>>"
    return F.transform(
        F.from_json(payload, schema)["data"],
        lambda t: F.struct(
            F.concat(F.lit("https://x.com/i/status/"), t["id"]).alias("link"),
            F.substring(t["text"], 1, 120).alias("title"),
            F.substring(t["text"], 1, 500).alias("summary"),
            F.try_to_timestamp(t["created_at"]).alias("published"),
        ),
    )


def listing_posts(payload: Column) -> Column:
    """Posts of a forum listing without the pinned ones; score, comments and flair end the summary."""
    schema = "data struct<children array<struct<kind string, data struct<title string, permalink string, selftext string, score long, num_comments long, link_flair_text string, created_utc double, stickied boolean>>>>"
    kept = F.filter(F.from_json(payload, schema)["data"]["children"], lambda c: (c["kind"] == "t3") & ~F.coalesce(c["data"]["stickied"], F.lit(False)))
    return F.transform(
        kept,
        lambda c: F.struct(
            F.concat(F.lit("https://www.reddit.com"), c["data"]["permalink"]).alias("link"),
            c["data"]["title"].alias("title"),
            F.concat_ws(" ", F.substring(c["data"]["selftext"], 1, 500), F.concat(F.lit("["), c["data"]["score"].cast("string"), F.lit(" points, "), c["data"]["num_comments"].cast("string"), F.lit(" comments]"))).alias("summary"),
            F.timestamp_seconds(c["data"]["created_utc"]).alias("published"),
        ),
    )
