"""Walks over landed sitemap files: an index names further sitemaps, a sitemap names pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions.text import any_of
from caselode.sources import shared


def _holds(url: Column, parts: list[str]) -> Column:
    return any_of([F.contains(F.lower(url), F.lit(p.lower())) for p in parts if p])


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = shared.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ordered(entries: DataFrame, preferred: list[str], skipped: list[str]) -> DataFrame:
    """(parent, child, place): each child once a parent, preferred ones first, the others in their order; without those that are skipped."""
    rows = entries.where("child is not null and child <> parent").where(~_holds(F.col("child"), skipped))
    rows = rows.groupBy("parent", "child").agg(F.min("nth").alias("nth"))
    first = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc(_holds(F.col("child"), preferred)), "nth", "child"))
    return rows.select("parent", "child", first.alias("place"))


def _opened(edges: DataFrame, root: str, most: int) -> list[str]:
    """The first `most` sitemaps that a walk opens, one job after the other over the edges (parent, child, place, names) of what it opened so far.

    A child's path is that of the first opened one that names it, then its
    place there; the next to open is the child whose path comes first. Only
    the opened ones come to the driver, what waits stays in the edges. names:
    whether the child names others; what stands behind one that does is not
    known before it is open, but a run of children that don't is opened at once.
    """
    opened: list[tuple[str, list[int]]] = [(root, [])][:most]
    while opened and len(opened) < most:
        urls = [s for s, _ in opened]
        named = edges.where(F.col("parent").isin(urls) & ~F.col("child").isin(urls))
        which = F.array_position(F.array(*map(F.lit, urls)), F.col("parent")).cast("int").alias("which")
        first = named.groupBy("child").agg(F.min(F.struct(which, "place")).alias("first"), F.bool_or("names").alias("names"))
        paths = F.array(*[F.array(*map(F.lit, p)).cast("array<int>") for _, p in opened])
        path = F.concat(F.element_at(paths, F.col("first.which")), F.array("first.place")).alias("path")
        ahead = first.select("child", path, "names").orderBy("path").limit(most - len(opened)).collect()
        if not ahead:
            break
        for r in ahead:
            opened.append((r["child"], r["path"]))
            if r["names"]:
                break
    return [s for s, _ in opened]


#: Walks of at most so many sitemaps open one after the other, longer ones find all paths in rounds.
STEPS = 1000


def visit_order(entries: DataFrame, root: str, *, preferred: list[str] | None = None, skipped: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(sitemap, rank): the order in which a walk opens the sitemaps that root leads to, `most` of them at most.

    entries holds (parent, nth, child). The walk opens one sitemap after the
    other; the children of the one that it opens go before all that wait,
    unless they wait already or were opened. So a sitemap's place is that of
    the first one that names it, and then its place among that one's
    children: a path of places, and the walk goes by the order of paths.

    A walk of at most STEPS sitemaps reads the edges of those alone. Without
    such a bound, paths are found in rounds of joins over the edges, each of
    which takes the named path of the parent that comes first so far; a round
    that changes nothing is the last, so cycles end. There are as many rounds
    as the walk is deep.
    """
    spark = entries.sparkSession
    edges = _ordered(entries, preferred or [], skipped or [])
    if most is not None and most <= STEPS:
        naming = edges.select(F.col("parent").alias("child"), F.lit(True).alias("names")).distinct()
        edges = _stage(edges.join(naming, "child", "left").select("parent", "child", "place", F.coalesce("names", F.lit(False)).alias("names")), "sitemap-edges")
        ranked = [(s, i) for i, s in enumerate(_opened(edges, root, most), 1)]
        return spark.createDataFrame(ranked, "sitemap string, rank int")
    edges = _stage(edges, "sitemap-edges")
    start = spark.createDataFrame([(root, [])], "sitemap string, path array<int>")
    known, before = _stage(start, "sitemap-paths"), None
    while True:
        state = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("sitemap", "path").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        named = edges.join(known.select(F.col("sitemap").alias("parent"), "path"), "parent")
        first = F.min(F.struct("path", "place")).alias("first")
        found = named.where(F.col("child") != root).groupBy("child").agg(first)
        found = found.select(F.col("child").alias("sitemap"), F.concat("first.path", F.array("first.place")).alias("path"))
        known = _stage(start.unionByName(found), "sitemap-paths")
    # The result is cut at `most`, so only that many rows are numbered in one place.
    ranked = known.orderBy("path").limit(most) if most is not None else known
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("path"))).select("sitemap", "rank")


def walk(entries: DataFrame, pages: DataFrame, root: str, *, hints: list[str] | None = None, preferred: list[str] | None = None, skipped: list[str] | None = None, max_sitemaps: int = 40, max_urls: int = 50_000) -> DataFrame:
    """(place, sitemap, url): the pages (sitemap, nth, url) of the sitemaps that a walk from root opens, in its order.

    With hints, only pages whose path holds one of them. A sitemap whose file
    is not there has no rows and counts as opened. max_sitemaps and max_urls
    end the walk, as they do for a fetching one. Null URLs are passed over; a
    page that two sitemaps name stands twice.
    """
    order = visit_order(entries, root, preferred=preferred, skipped=skipped, most=max_sitemaps)
    path = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    rows = pages.where("url is not null")
    if hints:
        rows = rows.where(_holds(path, hints))
    found = rows.join(F.broadcast(order), "sitemap").orderBy("rank", "nth", "url").limit(max_urls)  # at most max_sitemaps rows
    return found.withColumn("place", F.row_number().over(Window.orderBy("rank", "nth", "url"))).select("place", "sitemap", "url")
