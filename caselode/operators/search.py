"""Search, lookup and trends."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.functions.text import any_of, tokens
from caselode.operators.matching import computed


def _query_tokens(query: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9][a-z0-9+._-]{1,}", query.lower())))


def keyword_score(query: str, found: Column, in_title: Column, named: Column | None = None) -> Column:
    """Share of query tokens among the article's, 0.15 more for one in the title, 0.2 for a CVE, 0.1 for a technique's id, at most 1.

    found and in_title: the article's and the title's query tokens; named: ids
    of its techniques. Without any token found, 0.4 if title and content hold
    the sorted query tokens as a string.
    """
    asked = _query_tokens(query)
    more = F.when(F.size(in_title) > 0, 0.15).otherwise(0.0) + F.when(F.exists(found, lambda t: t.startswith("cve")), 0.2).otherwise(0.0)
    if named is not None:
        ids = F.transform(named, lambda i: F.lower(i))
        more = more + F.when(F.arrays_overlap(found, ids), 0.1).otherwise(0.0)
    score = F.least(F.size(found) / F.lit(float(len(asked))) + more, F.lit(1.0))
    whole = F.lower(F.concat_ws(" ", "title", "content")).contains(" ".join(asked))
    return F.when(F.size(found) > 0, score).when(whole, 0.4).otherwise(0.0)


def with_keyword_score(articles: DataFrame, query: str, named: Column | None = None) -> DataFrame:
    """articles with `keyword`, their score for a query; each text is cut into tokens once, and only if it holds a query token as a string."""
    q = F.array(*map(F.lit, _query_tokens(query))).cast("array<string>")
    blob = F.concat_ws(" ", "title", "summary", "content")
    some = any_of([F.lower(blob).contains(t) for t in _query_tokens(query)])
    rows = computed(articles, {"_found": F.when(some, F.array_intersect(tokens(blob), q)).otherwise(F.array().cast("array<string>"))})
    rows = computed(rows, {"keyword": keyword_score(query, F.col("_found"), F.array_intersect(tokens(F.col("title")), q), named)})
    return rows.drop("_found")


def keyword_top(articles: DataFrame, query: str, k: int, named: Column | None = None) -> DataFrame:
    """The k best articles, ties in corpus order; a query without tokens finds nothing."""
    if not _query_tokens(query):
        return articles.limit(0).select("link", F.lit(0.0).alias("score"))
    found = with_keyword_score(articles, query, named).where("keyword > 0")
    return found.select("link", "row_ord", "keyword").orderBy(F.desc("keyword"), "row_ord").limit(k).select("link", F.bround("keyword", 4).alias("score"))


class Embedder:
    """Hashing embedder: each token adds a sign at an index from its 8-byte BLAKE2b; unit length."""

    def __init__(self, dims: int = 256, most: int = 200_000):
        self.dims, self.most, self.known = dims, most, {}

    def places(self, text: str) -> np.ndarray:
        """One number a token: its index, or index + dims where its sign is minus."""
        words = re.findall(r"[a-z0-9][a-z0-9+._-]{1,}", (text or "").lower())
        # looked up word by word: a set less the view of a dict's keys goes over the whole dict
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set(words)
        for w in new:
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            self.known[w] = int.from_bytes(h[:4], "little") % self.dims + self.dims * (h[4] % 2)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [self.places(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        flat = np.bincount(row * 2 * self.dims + np.concatenate([np.empty(0, np.int64), *found]), minlength=len(texts) * 2 * self.dims)
        plus, minus = flat.reshape(len(texts), 2, self.dims).transpose(1, 0, 2)
        v = (plus - minus).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=v, where=norm > 0)


def embed(text: str, dims: int = 256) -> list[float]:
    return Embedder(dims)([text])[0].tolist()


def similar_to(query: str) -> Callable[[Column], Column]:
    """A function of a text column: cosine with the query, in Arrow batches."""
    asked = np.array(embed(query))

    @F.pandas_udf("double")
    def similarity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = Embedder()
        for t in texts:
            yield pd.Series(embedder(t.tolist()) @ asked)

    return similarity


def hybrid_top(articles: DataFrame, query: str, k: int, weights: tuple[float, float, float] = (0.55, 0.35, 0.10)) -> DataFrame:
    """Keyword, semantic and relevance parts (relevance_score) blended; ties in corpus order."""
    blob = F.concat_ws(" ", "title", "summary", "content")
    semantic = F.greatest((similar_to(query)(blob) + 1) / 2, F.lit(0.0))
    rows = with_keyword_score(articles, query).withColumn("_semantic", semantic)
    score = weights[0] * F.col("keyword") + weights[1] * F.col("_semantic") + weights[2] * F.col("relevance_score")
    return rows.select("link", "row_ord", score.alias("s")).orderBy(F.desc("s"), "row_ord").limit(k).select("link", F.bround("s", 4).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """In the order of the components, so the sum is the same in any plan."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    """The k rows of largest cosine to one row, without it."""
    one = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    pairs = vectors.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(one))  # one row
    cosine = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    return pairs.select("vec_id", F.bround(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """For each vector the label whose mean vector has the largest cosine, ties to the smaller label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    means = means.select("label", F.transform("m", lambda x: x / F.sqrt(dot(F.col("m"), F.col("m")))).alias("m"))
    table = means.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("all"))  # one row for each label
    scored = vectors.crossJoin(F.broadcast(table)).select(
        "vec_id", F.transform("all", lambda c: F.struct(F.bround(dot(F.col("embedding"), c["m"]), 9).alias("s"), (-c["label"]).alias("neg"))).alias("s")
    )
    return scored.select("vec_id", (-F.array_max("s")["neg"]).alias("nearest"))


def lookup(articles: DataFrame, links: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the links in the order asked, links that no article has)."""
    asked = articles.sparkSession.createDataFrame(list(enumerate(links)), "ask int, link string")
    return articles.join(F.broadcast(asked), "link"), asked.join(articles.select("link"), "link", "left_anti").select("ask", "link")


def trending(rows: DataFrame, *, days: int, floor: int | Column, anchor: DataFrame | None = None) -> DataFrame:
    """Distinct stories per key in total, in the last `days` before the anchor (by default the newest stamp), and in those before.

    channel is the most frequent one, of equals the first seen. Keys of fewer
    than `floor` stories are left out. The recent window has no upper bound.
    """
    anchor = rows.agg(F.max("stamp").alias("anchor")) if anchor is None else anchor
    gap = F.expr(f"interval {days} days")
    w = rows.crossJoin(F.broadcast(anchor)).withColumn("recent", F.col("stamp") >= F.col("anchor") - gap)  # one row
    w = w.withColumn("prior", ~F.col("recent") & (F.col("stamp") >= F.col("anchor") - gap - gap))
    totals = w.groupBy("key").agg(
        F.count_distinct("story").alias("stories"),
        F.count_distinct(F.when(F.col("recent"), F.col("story"))).alias("recent"),
        F.count_distinct(F.when(F.col("prior"), F.col("story"))).alias("prior"),
    )
    seen = w.groupBy("key", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("first"))
    modal = seen.groupBy("key").agg(F.max(F.struct("n", (-F.col("first")).alias("first"), "channel"))["channel"].alias("channel"))
    r, p = F.col("recent"), F.col("prior")
    return totals.where(F.col("stories") >= floor).join(modal, "key").select(
        "key",
        "stories",
        "recent",
        "prior",
        "channel",
        F.when(p > 0, F.bround((r - p) * F.lit(100.0) / p, 1)).alias("delta_pct"),
        F.when((p == 0) & (r > 0), "new").when(r > p, "up").when(r < p, "down").otherwise("flat").alias("direction"),
    )
