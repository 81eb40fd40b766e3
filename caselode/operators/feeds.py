"""Whole documents and totals over articles: a feed with its envelope, merged runs, states of filings, terms to search for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions.text import first_wins
from caselode.operators.reports import atom_entries, xml_escape

# Phrases that say nothing about an operator's search.
VACUOUS_TERMS = [
    "confidential information",
    "confidential data",
    "proprietary information",
    "proprietary data",
    "trade secret",
    "trade secrets",
    "intellectual property",
    "sensitive information",
    "sensitive data",
    "company data",
    "customer data",
    "misappropriation",
]


def atom_document(page: DataFrame, *, title: str, subtitle: str, self_url: str, home_url: str) -> DataFrame:
    """(updated, entries, feed): one row, the Atom document of a page of articles (a limited number of rows), newest first.

    The feed's stamp is that of its newest dated article; without one it is
    the epoch. An empty page is a feed without entries.
    """
    esc = lambda s: xml_escape(F.lit(s))
    rows = atom_entries(page).join(page.select("link", "published", "row_ord"), "link")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("published").isNull().alias("undated"), (-F.unix_micros("published")).alias("age"), "row_ord", "entry")))
    stamp = F.date_format(F.coalesce(F.max("published"), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    whole = rows.agg(stamp.alias("updated"), F.count(F.lit(1)).alias("entries"), F.transform(ordered, lambda e: e["entry"]).alias("all"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n<title>'), esc(title), F.lit("</title>\n<subtitle>"), esc(subtitle),
        F.lit('</subtitle>\n<link rel="self" href="'), esc(self_url), F.lit('"/>\n<link rel="alternate" href="'), esc(home_url), F.lit('"/>\n<id>'), esc(home_url),
        F.lit("/feed.xml</id>\n<updated>"), F.col("updated"), F.lit("</updated>\n"),
    )
    return whole.select("updated", "entries", F.concat(head, F.array_join(F.transform("all", lambda e: F.concat(e, F.lit("\n"))), ""), F.lit("</feed>")).alias("feed"))


def run_totals(runs: DataFrame) -> DataFrame:
    """(lane, runs, fetched, saved, started, finished) of each lane, and of all lanes as one run (lane null): the first start, the last finish, the sums."""
    return runs.groupingSets([[F.col("lane")], []], "lane").agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.min("started").alias("started"), F.max("finished").alias("finished")
    )


def filing_states(rows: DataFrame, model: str, schema: int, body_chars: int = 1500) -> DataFrame:
    """One row of counts over articles (channel, content, processed_at, model, schema, bought): corpus size, newest stamp, filings with a body and
    stubs, stubs that were paid for, filings never enriched (model null), of another model, of an older schema, and current."""
    filing, n = F.col("channel") == "filings", F.length(F.coalesce("content", F.lit("")))
    done = filing & F.col("model").isNotNull()
    old = F.coalesce(F.col("schema"), F.lit(0)) < schema
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.max("processed_at").alias("newest"),
        F.count_if(filing).alias("filings"),
        F.count_if(filing & (n >= body_chars)).alias("with_body"),
        F.count_if(filing & (n < body_chars)).alias("stubs"),
        F.count_if(filing & (n < body_chars) & F.col("bought")).alias("paid_stubs"),
        F.count_if(filing & F.col("model").isNull()).alias("never_enriched"),
        F.count_if(done & (F.col("model") != model)).alias("stale_by_model"),
        F.count_if(done & (F.col("model") == model) & old).alias("stale_by_schema"),
        F.count_if(done & (F.col("model") == model) & ~old).alias("current"),
    )


def search_terms(own: Column, others: list[Column], technique_id: str = r"^[A-Za-z]{2}\d{3}(\.\d{3})?$") -> Column:
    """Terms to search for: the article's own that are not vacuous, or, if it has none, those of the other arrays in turn.

    Of the others, terms of three characters and more that are no technique
    ids and not vacuous, each once whatever its case, the first spelling.
    """
    told = lambda t: ~F.lower(F.trim(t)).isin(*VACUOUS_TERMS)
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(own, none), lambda t: t.isNotNull() & told(t))
    rest = F.filter(F.concat(*[F.coalesce(o, none) for o in others]), lambda t: (F.length(F.trim(t)) >= 3) & ~F.trim(t).rlike(technique_id) & told(t))
    return F.when(F.size(kept) > 0, kept).otherwise(first_wins(rest))
