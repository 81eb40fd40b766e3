"""Hits, stored texts, spending gates, follow-ups, lanes, social sources and trial runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from caselode.functions.text import story_key


def model_label(model: Column, known: dict[str, str]) -> Column:
    """A model id as a label: known ones by table, others without owner and date, words with a capital; null where blank."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.lit(None).cast("map<string,string>")
    raw = F.trim(model)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^.*/", ""), r"-20\d{6}$", "")
    words = F.filter(F.split(bare, r"[-_]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Ll}+$"), F.initcap(w)).otherwise(w))
    return F.coalesce(F.try_element_at(table, F.lower(raw)), F.when(bare != "", F.array_join(words, " ")))


def as_hits(scored: DataFrame, model: Column, known: dict[str, str]) -> DataFrame:
    """Articles as search hits: story key, score to four places half to even, alignment or weak, label of the model that enriched."""
    key = story_key(F.col("title"), F.col("published"), F.col("processed_at"))
    return scored.select(
        "link",
        "title",
        "channel",
        key.alias("story"),
        F.bround("relevance_score", 4).alias("score"),
        F.coalesce("alignment", F.lit("weak")).alias("alignment"),
        F.array_join(F.transform("hits", lambda h: h["technique"]), ",").alias("techniques"),
        F.array_join("use_cases", ",").alias("use_cases"),
        model_label(model, known).alias("enriched_by"),
    )


def full_text(processed: DataFrame, raw: DataFrame, tag: str) -> DataFrame:
    """(link, text): the raw body where there is one, else the processed text, without lines that begin with a tag."""
    both = processed.select("link", "clean_text").join(raw.select("link", "content"), "link", "left")
    body = F.coalesce(F.when(F.col("content") != "", F.col("content")), "clean_text", F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: ~F.ltrim(x).startswith(tag))
    return both.select("link", F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "").alias("text"))


def spend_gate(signal: Column, framed: Column, *, least: int = 1500, body_needed: bool = True) -> Column:
    """Whether an article may cost money: columns channel, content, use_cases, hits and alignment.

    A filing needs its body (or only a hit, where the body is what is to be
    bought) and a use case, an insider alignment or a technique in the body
    (`signal`). Elsewhere a use case is enough but for news; a hit is enough
    where the alignment is insider (`framed`).
    """
    filing, cases, hits = F.col("channel") == "filings", F.size("use_cases") > 0, F.size("hits") > 0
    body = F.length(F.trim("content")) >= max(1, least)
    bodied = body & (cases | framed | signal)
    other = (cases & (F.col("channel") != "news")) | (hits & framed) | (filing & bodied)
    return F.when(filing & F.lit(body_needed), bodied).otherwise(other)


def follow_candidates(cases: DataFrame, state: DataFrame, now_s: int, repoll_days: int) -> DataFrame:
    """Cases of true verdict, without outcome, with a docket number in the link, not done, and not polled in the last days.

    state: (link, polled_s, done). Never polled ones come first, then the oldest poll: `turn` sorts them.
    """
    rows = cases.where(F.col("verdict").eqNullSafe(True) & (F.trim(F.coalesce("outcome", F.lit(""))) == "") & F.col("docket").isNotNull())
    rows = rows.join(state, "link", "left").where(~F.coalesce("done", F.lit(False)))
    rows = rows.where(F.col("polled_s").isNull() | (F.lit(now_s) - F.col("polled_s") >= repoll_days * 86400))
    return rows.select("link", "docket", F.coalesce("polled_s", F.lit(0)).alias("turn"))


def lane_states(expected: DataFrame, results: DataFrame, previous: DataFrame, broken_after: int = 3) -> DataFrame:
    """One row for each expected lane and each other lane with results; lanes that are neither are dropped.

    expected: (lane, name); results: (lane, name, success, fetched, saved,
    error), several rows a lane; previous: (lane, failures). A lane without
    result is skipped and keeps its failures. Any success of the cycle counts:
    then the lane is ok, or empty if it fetched nothing. Otherwise the errors
    tell http_error, parse_error or error. All but ok and skipped are failures.
    """
    by = results.groupBy("lane").agg(
        F.min("name").alias("result_name"),
        F.bool_or("success").alias("success"),
        F.sum("fetched").alias("fetched"),
        F.sum("saved").alias("saved"),
        F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"),
    )
    both = expected.join(by, "lane", "full_outer").join(previous, "lane", "left")
    low = F.lower("errors")
    outcome = (
        F.when(F.col("success").isNull(), "skipped")
        .when(F.col("success"), F.when(F.col("fetched") > 0, "ok").otherwise("empty"))
        .when(low.contains("http ") | low.contains("status"), "http_error")
        .when(low.contains("parse"), "parse_error")
        .otherwise("error")
    )
    failed = ~outcome.isin("ok", "skipped")
    before = F.coalesce("failures", F.lit(0))
    run = F.when(F.col("success").isNull(), before).when(failed, before + 1).otherwise(0)
    return both.select(
        "lane",
        F.coalesce("result_name", "name").alias("name"),
        outcome.alias("outcome"),
        F.when(failed & (F.col("errors") != ""), F.col("errors")).alias("error"),
        F.coalesce("fetched", F.lit(0)).alias("fetched"),
        F.coalesce("saved", F.lit(0)).alias("saved"),
        run.cast("long").alias("failures"),
        (run >= broken_after).alias("broken"),
    )


def social_sources(suggested: DataFrame, subscribed: DataFrame, counts: DataFrame) -> DataFrame:
    """Suggested and subscribed accounts, one row each, with use cases in order, subscription and number of articles.

    suggested: (platform, handle, use_case, nth); subscribed: (platform, handle, enabled); counts: (source_id, articles).
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim("handle"), r"^https?://[^/]+/", ""), r"^(r/|u/|@)|[/?].*$", ""))
    cases = F.array_sort(F.collect_list(F.when(F.col("use_case").isNotNull(), F.struct("nth", "use_case"))))
    s = suggested.withColumn("id", plain).groupBy("platform", "id").agg(F.array_distinct(F.transform(cases, lambda c: c["use_case"])).alias("cases"))
    mine = subscribed.withColumn("id", plain).groupBy("platform", "id").agg(F.bool_or("enabled").alias("enabled"))
    both = s.join(mine, ["platform", "id"], "full_outer").withColumn("source_id", F.concat_ws("-", "platform", "id"))
    return both.join(counts, "source_id", "left").select(
        "platform",
        "id",
        "source_id",
        F.array_join(F.coalesce("cases", F.array().cast("array<string>")), ",").alias("use_cases"),
        F.coalesce("enabled", F.lit(False)).alias("subscribed"),
        F.coalesce("articles", F.lit(0)).alias("articles"),
    )


def first_distinct(rows: DataFrame, by: str, norm: str, order: list[str], cap: int) -> DataFrame:
    """Up to `cap` rows of each `by` with different `norm`, first seen first: nth is the place."""
    first = rows.groupBy(by, norm).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return first.withColumn("nth", nth.cast("long")).where(F.col("nth") <= cap)


def trial_metrics(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of measures of two arms, on and off, over pairs (link, on_verdict, off_verdict, on_verbatim, off_verbatim,
    on_seconds, off_seconds; a null verdict was not parsed) and gold (link, verdict): rates to four places, half to even."""
    rows = pairs.join(gold, "link", "left")
    rate = lambda c, among: F.bround(F.avg(F.when(among, c.cast("double"))), 4)
    both = F.col("on_verdict").isNotNull() & F.col("off_verdict").isNotNull()
    arms = []
    for arm in ("on", "off"):
        parsed = F.col(f"{arm}_verdict").isNotNull()
        arms += [
            rate(~parsed, F.lit(True)).alias(f"{arm}_unparsed"),
            rate(F.col(f"{arm}_verdict") == F.col("verdict"), parsed & F.col("verdict").isNotNull()).alias(f"{arm}_agreement"),
            rate(F.col(f"{arm}_verbatim"), F.col(f"{arm}_verbatim").isNotNull()).alias(f"{arm}_verbatim"),
        ]
    speed = F.bround(F.avg(F.when(both, F.col("on_seconds"))) / F.avg(F.when(both, F.col("off_seconds"))), 3)
    return rows.agg(F.count(F.lit(1)).alias("pairs"), rate(F.col("on_verdict") == F.col("off_verdict"), both).alias("arms_agree"), *arms, speed.alias("speedup"))


def trial_decision(metrics: DataFrame, *, tolerance: float = 0.95, drop_points: float = 5.0, speed: float = 1.5, floor: float = 0.85) -> DataFrame:
    """(criterion, passed): the off arm may take over only where all pass; a measure that can't be taken passes, but for speed and parsing."""
    m = F.col
    checks = {
        "unparsed": F.coalesce(m("off_unparsed") <= m("on_unparsed"), F.lit(False)),
        "agreement": F.when(m("on_agreement").isNull() & m("off_agreement").isNull(), True).otherwise(
            F.coalesce(m("off_agreement") >= F.bround(tolerance * F.coalesce("on_agreement", F.lit(0.0)), 4), F.lit(False))
        ),
        "verbatim_floor": F.coalesce(m("on_verbatim") >= floor, F.lit(True)),
        "verbatim_drop": F.coalesce(m("off_verbatim") >= F.bround(m("on_verbatim") - drop_points / 100, 4), F.lit(True)),
        "speedup": F.coalesce(m("speedup") >= speed, F.lit(False)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("passed")) for k, v in checks.items()])
    return metrics.select(F.inline(rows))


def docket_updates(text: Column, entries: Column, date: Column, most: int = 12, longest: int = 300) -> Column:
    """A text whose block of updates is replaced by one of the first entries, each cut; without entries the block goes."""
    bare = F.regexp_replace(text, r"(?s)\n=== UPDATES as of [^=]*===\n.*\z", "")
    lines = F.transform(F.slice(entries, 1, most), lambda e: F.concat(F.lit("- "), F.substring(e, 1, longest)))
    block = F.concat(F.lit("\n=== UPDATES as of "), date, F.lit(" ===\n"), F.array_join(lines, "\n"))
    return F.when(F.size(entries) > 0, F.concat(bare, block)).otherwise(bare)


def reserve_split(rows: DataFrame, order: list[str], cap: int, reserve: int) -> DataFrame:
    """Which rows two passes over one budget take: fresh rows get cap - reserve, older ones the reserve and what is left.

    rows: link, fresh and the order's columns. Only the first `cap` rows of each kind are ever looked at.
    """
    top = [rows.where(F.col("fresh") == f).orderBy(*order).limit(cap) for f in (True, False)]
    numbered = [t.withColumn("nth", F.row_number().over(Window.orderBy(*order))) for t in top]  # at most cap rows
    batch = numbered[0].where(F.col("nth") <= cap - reserve)
    spent = batch.agg(F.count(F.lit(1)).alias("spent"))
    back = numbered[1].crossJoin(F.broadcast(spent)).where(F.col("nth") <= F.lit(cap) - F.col("spent")).drop("spent")  # one row
    tag = lambda df, name: df.select("link", F.lit(name).alias("part"), F.col("nth").cast("long").alias("nth"))
    return tag(batch, "batch").unionByName(tag(back, "backfill"))


def query_match(query: str, technique: Column, title: Column, aliases: Column) -> Column:
    """How well a technique answers a query: by its id 100, by an alias 92, by its title 88; by a part of an alias, or an
    alias that is part of the query, 55 and its length (25 at most); by a part of title or id 40; else 0."""
    q = query.strip().lower()
    low = F.transform(aliases, lambda a: F.lower(a))
    part = lambda a: F.contains(a, F.lit(q)) | ((F.length(a) >= 3) & F.lit(len(q) >= 3) & F.contains(F.lit(q), a))
    longest = F.array_max(F.transform(F.filter(low, part), lambda a: F.length(a)))
    return (
        F.when(F.lower(technique) == q, 100)
        .when(F.array_contains(low, q), 92)
        .when(F.lower(title) == q, 88)
        .when(longest.isNotNull(), 55 + F.least(longest, F.lit(25)))
        .when(F.contains(F.lower(title), F.lit(q)) | F.contains(F.lower(technique), F.lit(q)), 40)
        .otherwise(0)
    )


def hunt_map(taxonomy: DataFrame, counts: DataFrame, query: str) -> DataFrame:
    """Techniques that a query finds, and those that articles have: (technique, title, score, articles, from_catalog).

    taxonomy: (technique, title, aliases); counts: (technique, articles). What
    the query finds keeps its score; the others score 10 and their articles.
    """
    found = taxonomy.select("technique", "title", query_match(query, F.col("technique"), F.col("title"), F.col("aliases")).alias("match"))
    both = found.join(counts.where("articles > 0"), "technique", "full_outer").where("match > 0 or articles is not null")
    hit = F.coalesce(F.col("match") > 0, F.lit(False))
    n = F.coalesce("articles", F.lit(0))
    return both.select("technique", "title", F.when(hit, F.col("match")).otherwise(10 + n).cast("long").alias("score"), n.alias("articles"), hit.alias("from_catalog"))


def tool_table(directory: DataFrame, needle: str, court_only: bool) -> DataFrame:
    """Rows (category, vendor, verdict_true, total) whose category or vendor holds the text, and `place` in their category:
    named ones first, by cases of true verdict, by all cases, by name."""
    low = needle.strip().lower()
    rows = directory.where(F.lower("category").contains(low) | F.lower("vendor").contains(low))
    if court_only:
        rows = rows.where("total > 0")
    order = [F.desc(F.col("total") > 0), F.desc("verdict_true"), F.desc("total"), F.lower("vendor")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order)).cast("long"))


def watch_queries(companies: DataFrame, topics: DataFrame, scope: str) -> DataFrame:
    """(query): the topics, and two queries a company (its quoted name with the scope, and alone), each once."""
    name = F.concat(F.lit('"'), F.trim("company"), F.lit('"'))
    both = companies.where(F.trim("company") != "").select(F.explode(F.array(F.concat(name, F.lit(f" ({scope})")), name)).alias("query"))
    return topics.select(F.trim("query").alias("query")).where("query <> ''").unionByName(both).distinct()


def example_picks(hits: DataFrame, n: int = 3) -> DataFrame:
    """The n links of highest rank: 1,000 a hit and the score; of rows that repeat a link the best counts, ties by link."""
    rank = F.size("hits") * 1000 + F.col("relevance_score")
    return hits.groupBy("link").agg(F.max(rank).alias("rank")).orderBy(F.desc("rank"), "link").limit(n)


def unfinished(links: DataFrame, done: DataFrame, seed: str) -> DataFrame:
    """(link, first_arm): links for which not both arms are recorded; which arm goes first follows from a hash of the link."""
    both = done.groupBy("link").agg(F.count_distinct("arm").alias("arms")).where("arms = 2")
    last = F.conv(F.right(F.sha2(F.concat(F.lit(f"{seed}:"), "link"), 256), F.lit(1)), 16, 10).cast("int")
    return links.join(both, "link", "left_anti").select("link", F.when(last % 2 == 0, "on").otherwise("off").alias("first_arm"))


def text_upgrade(old: Column, new: Column, least: int = 5000, times: int = 2) -> Column:
    """Whether a new text of at least `least` characters is `times` as long as the old one."""
    n = F.length(F.coalesce(new, F.lit("")))
    return (n >= least) & (n >= times * F.length(F.coalesce(old, F.lit(""))))


def rescued_json(text: Column) -> Column:
    """The JSON value between the first and the last brace of a chatty text; null where there is none that parses."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def picked_packs(observed: DataFrame, packs: DataFrame) -> DataFrame:
    """(link, pack) of packs with a technique among an article's, or a hint in its lower-case title.

    observed: (link, title, ids); packs: (pack, anchors, hints), a small table.
    """
    by_id = observed.select("link", F.explode(F.array_distinct("ids")).alias("id")).join(F.broadcast(packs.select("pack", F.explode("anchors").alias("id"))), "id")
    rows = [(r["pack"], r["hints"]) for r in packs.collect()]  # a parameter, not data
    named = [F.when(F.exists(F.array(*map(F.lit, hints)).cast("array<string>"), lambda h: F.contains(F.lower("title"), h)), pack) for pack, hints in rows]
    by_hint = observed.select("link", F.explode(F.filter(F.array(*named), lambda p: p.isNotNull())).alias("pack"))
    return by_id.select("link", "pack").unionByName(by_hint).distinct()


def export_package(rows: DataFrame, candidates: DataFrame, path: str) -> dict[str, int]:
    """Write rows and candidates as lines of JSON and a manifest with their numbers, counted as they are written."""
    counts = {}
    for name, df in (("rows", rows), ("candidates", candidates)):
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct(*df.columns))).write.text(f"{path}/{name}")
        counts[name] = seen.get["n"]
    rows.sparkSession.createDataFrame([tuple(counts.values())], "rows long, candidates long").coalesce(1).write.json(f"{path}/manifest")
    return counts


def state_of(text: Column) -> Column:
    """A key-value state from its JSON text; what is no JSON object is an empty state."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
