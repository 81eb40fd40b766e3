"""Technique matching, classification and relevance of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselode.functions.text import has_any, plain_quote
from caselode.operators.lexicon import Lexicon, scan_large
from caselode.operators.lexicon import hits as lexicon_hits


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each computed once a row however often it is used later.

    The optimiser writes a column's expression out wherever it is used; it
    doesn't look behind an explode, here of one row into itself. Filters on
    the columns of df still move below.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], "_made.*")


_HIT = ["theme", "technique", "title", "alias"]


def _entries(taxonomy: list[tuple]) -> list[tuple]:
    return [(technique, a, theme, technique, title, a) for technique, title, theme, aliases in taxonomy for a in aliases]


def technique_hits(articles: DataFrame, taxonomy: list[tuple] | DataFrame, stop: frozenset = frozenset()) -> DataFrame:
    """articles with `hits`: array of (theme, technique, title, alias), sorted.

    A technique has one hit, by the longest of its aliases that the text
    holds (the first listed of equal length). Aliases of under three
    characters and stop words never match. The taxonomy is a list of
    (technique, title, theme, aliases) or a table with one row an alias
    (technique, title, theme, alias, nth). One automaton finds all aliases in
    one pass over each text: no join and no shuffle.
    """
    if isinstance(taxonomy, list):
        lexicon = Lexicon.of_list(_entries(taxonomy), _HIT, stop=stop)
    else:
        lexicon = Lexicon.of_table(taxonomy, group="technique", alias="alias", nth="nth", payload=_HIT, stop=stop)
    return articles.withColumn("hits", lexicon_hits(articles, F.lower("content"), lexicon))


def hits_and_phrases(articles: DataFrame, taxonomy: list[tuple], phrases: list[str]) -> DataFrame:
    """articles with `hits`, as technique_hits, and `said`, those of the phrases that the text holds, from one pass over each text."""
    entries = [("hit " + g, a, "hit", *rest) for g, a, *rest in _entries(taxonomy) if len(a.strip()) >= 3]
    entries += [("said " + p, p, "said", "", "", "", p) for p in sorted({p.lower() for p in phrases})]
    found = lexicon_hits(articles, F.lower("content"), Lexicon.of_list(entries, ["kind", *_HIT], least=1))
    of = lambda kind, take: F.transform(F.filter("_found", lambda h: h["kind"] == kind), take)
    parts = {"hits": of("hit", lambda h: F.struct(*[h[c].alias(c) for c in _HIT])), "said": of("said", lambda h: h["alias"])}
    return computed(articles.withColumn("_found", found), parts).drop("_found")


def technique_counts(matched: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Articles per technique; a child's hit counts for its parent once; techniques without hits count 0."""
    ids = F.transform("hits", lambda h: h["technique"])
    ids = F.array_distinct(F.concat(ids, F.transform(ids, lambda i: F.split_part(i, F.lit("."), F.lit(1)))))
    counts = matched.select(F.explode(ids).alias("technique")).groupBy("technique").count()
    return taxonomy.join(counts, "technique", "left").select(
        "technique", "title", "theme", F.coalesce("count", F.lit(0)).alias("articles")
    )


def has_technique(technique: str) -> Column:
    """Exact id or a child of it."""
    return F.exists("hits", lambda h: (h["technique"] == technique) | h["technique"].startswith(technique + "."))


def has_theme(theme: str) -> Column:
    """Any hit of the theme, whatever its case; a blank theme passes everything."""
    wanted = (theme or "").strip().lower()
    return F.exists("hits", lambda h: F.lower(h["theme"]) == wanted) if wanted else F.lit(True)


def has_topic(title: str, aliases: list[str]) -> Column:
    """Whether title, summary or content hold a technique's title or alias of three characters or more."""
    phrases = [p.strip().lower() for p in [title, *aliases] if len(p.strip()) >= 3]
    return has_any(F.lower(F.concat_ws(" ", "title", "summary", "content")), phrases)


def _phrases(phrases: list[str]) -> Column:
    return F.array(*[F.lit(p.lower()) for p in phrases]).cast("array<string>")


def topics_of(articles: DataFrame, taxonomy: list[tuple] | DataFrame) -> DataFrame:
    """articles with `topics`: the techniques whose title or an alias, of three characters or more, stands in title, summary or content.

    The taxonomy is as for technique_hits; stop words count here.
    """
    if isinstance(taxonomy, list):
        lexicon = Lexicon.of_list([(t, p, t) for t, title, _, aliases in taxonomy for p in [title, *aliases]], ["technique"])
    else:
        names = taxonomy.select("technique", F.explode(F.array("title", "alias")).alias("alias")).distinct()
        lexicon = Lexicon.of_table(names, group="technique", alias="alias", payload=["technique"])
    low = F.lower(F.concat_ws(" ", "title", "summary", "content"))
    return articles.withColumn("topics", F.transform(lexicon_hits(articles, low, lexicon), lambda t: t["technique"]))


def terms_found(said: Column, terms: list[str]) -> Column:
    """How many of the terms are among the phrases that a text holds."""
    return F.size(F.array_intersect(said, _phrases(terms)))


def alignment(framed: Column) -> Column:
    """insider if there are hits and framing terms or a motive, weak otherwise."""
    motive = F.exists("hits", lambda h: h["theme"] == "motive")
    return F.when((F.size("hits") > 0) & ((framed > 0) | motive), "insider").otherwise("weak")


def _hits_of(theme: str) -> Column:
    return F.size(F.filter("hits", lambda h: h["theme"] == theme))


def relevance(theme_weights: list[tuple], framed: Column, n_cves: Column | None = None, n_domains: Column | None = None, weak: Column | None = None) -> Column:
    """Capped sum of CVEs, theme weights in fixed order, framing terms, domains and length; four places, half to even, at most 1.

    A CVE counts less where the article is weak.
    """
    total = F.lit(0.0)
    if n_cves is not None:
        few = F.least(n_cves * F.lit(0.03), F.lit(0.06))
        total = total + F.when(weak, few).otherwise(F.least(n_cves * F.lit(0.15), F.lit(0.3)))
    for theme, weight, cap in theme_weights:
        total = total + F.least(_hits_of(theme) * F.lit(weight), F.lit(cap))
    total = total + F.when(framed > 0, F.least(F.lit(0.08) + framed * F.lit(0.04), F.lit(0.2))).otherwise(F.lit(0.0))
    if n_domains is not None:
        total = total + F.least(n_domains * F.lit(0.02), F.lit(0.06))
    total = total + F.when(F.length("content") > 80, F.lit(0.03)).otherwise(F.lit(0.0))
    return F.least(F.bround(total, 4), F.lit(1.0))


def use_cases(said: Column, registry: list[tuple]) -> Column:
    """Names, in registry order, with a technique hit, one strong phrase or two weak ones among those that the text holds."""
    ids, found = F.transform("hits", lambda h: h["technique"]), []
    for name, techniques, strong, weak in registry:
        hit = F.arrays_overlap(ids, F.array(*map(F.lit, techniques)).cast("array<string>"))
        two = terms_found(said, weak) >= 2
        found.append(F.when(hit | F.arrays_overlap(said, _phrases(strong)) | two, name))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def insider_type(said: Column, rules: list[tuple]) -> Column:
    """First type, in order, with a phrase that the text holds or a technique; null if none."""
    ids, out = F.transform("hits", lambda h: h["technique"]), []
    for name, phrases, techniques in rules:
        out.append(F.when(F.arrays_overlap(said, _phrases(phrases)) | F.arrays_overlap(ids, F.array(*map(F.lit, techniques)).cast("array<string>")), name))
    return F.coalesce(*out)


def promoted(aligned: Column, cases: Column, kind: Column) -> Column:
    """A weak article with a use case and a type is an insider article."""
    return F.when((aligned == "weak") & (F.size(cases) > 0) & kind.isNotNull(), "insider").otherwise(aligned)


def in_channel(channel: str | None) -> Column:
    """Blank, all and * pass everything."""
    return F.lit(True) if (channel or "").strip().lower() in ("", "all", "*") else F.col("channel") == channel.strip().lower()


def score_floor(score: Column, least: float) -> Column:
    """Publications pass whatever their score."""
    return (score >= least) | (F.col("channel") == "publications")


def of_type(column: Column, kind: str | None) -> Column:
    """none and unclassified mean no type."""
    if not kind:
        return F.lit(True)
    return column.isNull() if kind in ("none", "unclassified") else column == kind


def quotes_found(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the quotes (item_id, text) that stand verbatim, after plain_quote, in the documents (doc_id, text).

    A quote of any length may begin and end inside a word. All quotes are one
    lexicon, whose parts of bounded size each read the texts once; no word is
    a join key, so none can be hot. Blank quotes are nowhere; null texts hold
    nothing; rows that repeat give one row.
    """
    wanted = quotes.select("item_id", plain_quote(F.coalesce("text", F.lit(""))).alias("quote"))
    kind = dict(wanted.dtypes)["item_id"]
    wanted = wanted.withColumn("id", F.col("item_id").cast("string"))
    lexicon = Lexicon.of_table(wanted, group="id", alias="quote", payload=["id"], least=1)
    bodies = docs.select("doc_id", plain_quote(F.coalesce("text", F.lit(""))).alias("body"))
    found = scan_large(bodies, ["doc_id"], "body", lexicon, bounded_under=0)
    return found.select("doc_id", F.col("id").cast(kind).alias("item_id")).distinct()
