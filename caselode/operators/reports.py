"""Candidates, shortlists, reports, feeds and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.operators.search import dot

STRENGTH_RANK = {"weak": 0, "moderate": 1, "strong": 2}


def method_strength(claim: Column, mechanical: Column, inferred_only: Column) -> Column:
    """strong: proven claim with a mechanical trace; weak: alleged claim with inferred traces or none."""
    proven, alleged = claim.isin("adjudicated", "admitted"), claim.isin("alleged", "unclear")
    return F.when(proven & mechanical, "strong").when(alleged & inferred_only, "weak").otherwise("moderate")


def candidate_rollup(records: DataFrame, known: DataFrame, distinct_below: float = 0.6) -> DataFrame:
    """One row per cluster: corroboration by distinct stories, domains, best strength, nearest known vector, status.

    Two stories corroborate; a representative (smallest id) whose largest
    cosine to a known technique is under the threshold is distinct; both make
    it eligible. Weak evidence is always a seed.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STRENGTH_RANK.items() for x in kv]), F.col("strength"))
    by = records.groupBy("cluster").agg(
        F.count_distinct("story").alias("stories"),
        F.count_distinct("domain").alias("domains"),
        F.max(F.struct(rank.alias("r"), "strength"))["strength"].alias("strength"),
        F.min_by("vector", "id").alias("rep"),
        F.min("seen").alias("first_seen"),
        F.max("seen").alias("last_seen"),
    )
    table = known.groupBy().agg(F.collect_list(F.struct("technique", "vector")).alias("known"))  # the taxonomy
    unit = F.sqrt(dot(F.col("rep"), F.col("rep")))
    near = F.transform("known", lambda k: F.struct(F.bround(dot(F.col("rep"), k["vector"]) / (unit * F.sqrt(dot(k["vector"], k["vector"]))), 6).alias("s"), k["technique"].alias("t")))
    by = by.crossJoin(F.broadcast(table)).withColumn("near", F.array_max(near))  # one row
    status = F.when(F.col("strength") == "weak", "seed").when((F.col("stories") >= 2) & (F.col("near.s") < distinct_below), "eligible")
    status = status.when(F.col("stories") >= 2, "corroborated").otherwise("seed")
    return by.select(
        "cluster", "stories", "domains", "strength", "first_seen", "last_seen", F.bround("near.s", 4).alias("similarity"), F.col("near.t").alias("nearest"), status.alias("status")
    )


def valid_refs(lexical: Column, refs: Column, known: list[str], least: float = 0.6, most: int = 5) -> Column:
    """Technique ids that a model proposed: in the taxonomy, not found by the lexicon, confident, first of each, at most `most`."""
    ids = F.transform(F.filter(refs, lambda r: (r["confidence"] >= least) & r["id"].isin(*known)), lambda r: r["id"])
    return F.slice(F.array_except(F.array_distinct(ids), lexical), 1, most)


def shortlist(hits: Column, similar: Column, k: int) -> Column:
    """Lexical techniques first, then the most similar others (ties to the larger id), k in all or all lexical ones."""
    rest = F.filter(similar, lambda s: ~F.array_contains(hits, s["technique"]))
    ranked = F.transform(F.sort_array(rest, asc=False), lambda s: s["technique"])
    return F.slice(F.concat(hits, ranked), F.lit(1), F.greatest(F.lit(k), F.size(hits)))


def sentence_clamp(text: Column, most: int) -> Column:
    """Collapsed text of at most `most` characters: to the last sentence end in the second half, else to the last word and an ellipsis."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(whole, 1, most)
    back = F.reverse(cut)
    end = lambda sep: F.when(F.instr(back, sep[::-1]) > 0, F.length(cut) - F.instr(back, sep[::-1]) - 1).otherwise(-1)
    out = F.concat(F.rtrim(F.substring(cut, F.lit(1), F.greatest(F.length(cut) - F.instr(back, " "), F.lit(0)))), F.lit("…"))
    for sep in ("? ", "! ", ". "):
        out = F.when(end(sep) >= most // 2, F.substring(cut, F.lit(1), end(sep) + 1)).otherwise(out)
    return F.when(F.length(whole) <= most, whole).otherwise(out)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def atom_entries(articles: DataFrame) -> DataFrame:
    """(link, entry): an Atom entry for each article; undated ones carry the epoch."""
    stamp = F.date_format(F.coalesce("published", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link, terms = xml_escape(F.col("link")), F.array_append(F.col("use_cases"), F.col("channel"))
    entry = F.concat(
        F.lit("<entry><title>"), xml_escape(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("link"))), F.lit('</title><link href="'), link, F.lit('"/><id>'), link,
        F.lit("</id><updated>"), stamp, F.lit("</updated><source><title>"), xml_escape(F.col("source_name")), F.lit("</title></source>"),
        F.array_join(F.transform(terms, lambda t: F.concat(F.lit('<category term="'), xml_escape(t), F.lit('"/>'))), ""),
        F.lit('<summary type="text">'), xml_escape(F.col("summary")), F.lit("</summary></entry>"),
    )
    return articles.select("link", entry.alias("entry"))


def hunt_worklist(counts: DataFrame, cache: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """Techniques of enough cases whose signature the cache lacks, most cases first."""
    signature = F.substring(F.sha2(F.concat_ws("|", "technique", F.col("cases").cast("string")), 256), 1, 16)
    todo = counts.where(F.col("cases") >= least).withColumn("signature", signature).join(cache, ["technique", "signature"], "left_anti")
    return todo.orderBy(F.desc("cases"), "technique").limit(most)


def keep_richer(current: DataFrame, donor: DataFrame) -> DataFrame:
    """Current rows, replaced by the donor's where the current one has no methods and the donor is richer."""
    d = donor.select("link", *[F.col(c).alias(f"d_{c}") for c in donor.columns if c != "link"])
    better = (F.col("n_methods") == 0) & (F.coalesce("d_rich", F.lit(-1.0)) > F.col("rich"))
    return current.join(d, "link", "left").select("link", F.when(better, F.col("d_gen")).otherwise(F.col("gen")).alias("gen"), F.when(better, "donor").otherwise("current").alias("source"))


def docket_summary(court: Column, docket: Column, cause: Column, parties: Column) -> Column:
    """Labelled lines of what there is; at most eight parties."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label + ": "), c))
    named = F.filter(F.slice(parties, 1, 8), lambda p: p.isNotNull() & (p != ""))
    return F.concat_ws("\n", line("Court", court), line("Docket", docket), line("Cause", cause), F.when(F.size(named) > 0, F.concat(F.lit("Parties: "), F.array_join(named, "; "))))


def docket_text(documents: DataFrame, key: str, number: str, title: str, text: str, cap: int) -> DataFrame:
    """A docket's documents in order, each under a header, until the cap; blank documents are skipped."""
    rows = documents.where(F.trim(text) != "")
    header = F.concat(F.lit("--- Document "), F.col(number).cast("string"), F.when(F.col(title) != "", F.concat(F.lit(": "), F.col(title))).otherwise(""), F.lit(" ---\n"))
    rows = rows.withColumn("body", F.concat(header, F.trim(text)))
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("body") + 2).over(w), F.lit(0))).where(F.col("before") < cap)
    part = F.substring(F.col("body"), F.lit(1), (F.lit(cap) - F.col("before")).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), part.alias("p")))), lambda s: s["p"])
    return rows.groupBy(key).agg(F.array_join(parts, "\n\n").alias("body"))


def history_windows(first: Column, last: Column, days: int = 90) -> Column:
    """Windows of `days` days from the newest date back to the oldest."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.datediff(last, first) / days).cast("int")), lambda i: F.struct(i.alias("nth"), F.date_sub(last, (i + 1) * days - 1).alias("from"), F.date_sub(last, i * days).alias("to")))
