"""The evidence ledger: proven against alleged cases, by technique, record family, channel and role.

Inputs are the flattened views: cases(link, title, row_ord, year, verdict,
posture, model, role) and methods(row_ord, m_pos, claim_status, has_quote,
verbatim, technique, family, channel, basis). Only cases whose verdict is
true contribute. Each function is a small aggregate over those views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strength of a claim and weight of a legal posture; a posture under 4 holds a case at alleged.
STRENGTH = {"adjudicated": 4, "admitted": 3, "alleged": 2, "reported": 1}
POSTURE_WEIGHT = {"conviction": 6, "plea": 5, "settlement": 4, "indictment": 3, "complaint": 2}
PROVEN_POSTURE = 4
SMALL_N = 10


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def contributing(cases: DataFrame) -> DataFrame:
    """Verdict true; a missing verdict doesn't count."""
    return cases.where(F.col("verdict").eqNullSafe(True))


def basis(cases: DataFrame, methods: DataFrame) -> DataFrame:
    """One row of counts: all, with a verdict, true, contributing with methods, left out and why."""
    with_methods = cases.join(methods.select("row_ord").distinct().withColumn("m", F.lit(1)), "row_ord", "left")
    v = F.col("verdict")
    return with_methods.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.isNotNull()).alias("with_verdict"),
        F.count_if(v.eqNullSafe(True)).alias("verdict_true"),
        F.count_if(v.eqNullSafe(True) & F.col("m").isNotNull()).alias("contributing"),
        F.count_if(v.eqNullSafe(False)).alias("excluded_non_insider"),
        F.count_if(v.isNull()).alias("excluded_no_verdict"),
    )


def case_strength(cases: DataFrame, methods: DataFrame) -> DataFrame:
    """cases with `claimed`, the strongest claim of a case, and `strength`, capped by posture.

    A known posture of weight under 4 makes adjudicated and admitted claims
    alleged; it never promotes. An unknown posture caps nothing. Cases without methods are reported.
    """
    best = methods.groupBy("row_ord").agg(F.max(lookup(STRENGTH, F.col("claim_status"))).alias("w"))
    w = F.coalesce("w", F.lit(1))
    weight = lookup(POSTURE_WEIGHT, F.col("posture"))
    capped = F.when(weight.isNotNull() & (weight < PROVEN_POSTURE), F.least(w, F.lit(2))).otherwise(w)
    names = F.array(*[F.lit(k) for k, _ in sorted(STRENGTH.items(), key=lambda kv: kv[1])])
    return contributing(cases).join(best, "row_ord", "left").select(
        *cases.columns, F.element_at(names, w).alias("claimed"), F.element_at(names, capped).alias("strength"), (w > capped).alias("capped")
    )


def strength_totals(strong: DataFrame) -> DataFrame:
    return strong.groupBy("strength").agg(F.count(F.lit(1)).alias("cases"), F.count_if("capped").alias("capped"))


def posture_mix(strong: DataFrame) -> DataFrame:
    """Cases by posture and by model, with both in one pass."""
    return strong.groupingSets([[F.col("posture")], [F.col("model")]], "posture", "model").agg(F.count(F.lit(1)).alias("cases"))


def quote_grounding(cases: DataFrame, methods: DataFrame) -> DataFrame:
    """Verbatim, not verbatim and unstamped among quotes that are not blank; share of verbatim among stamped, half to even."""
    m = methods.join(contributing(cases).select("row_ord"), "row_ord").where("has_quote")
    counts = m.agg(
        F.count_if(F.col("verbatim")).alias("verbatim"), F.count_if(~F.col("verbatim")).alias("not_verbatim"), F.count_if(F.col("verbatim").isNull()).alias("unstamped")
    )
    stamped = F.col("verbatim") + F.col("not_verbatim")
    return counts.withColumn("share", F.when(stamped > 0, F.bround(100.0 * F.col("verbatim") / stamped, 0).cast("int")))


def role_function(role: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose word the role holds, else unknown."""
    out = F.lit("unknown")
    for word, name in reversed(rules):
        out = F.when(F.lower(role).contains(word), name).otherwise(out)
    return out


def role_state(role: Column, function: Column) -> Column:
    """former if the role says so, else current where the function is known."""
    low = F.lower(role)
    return F.when(low.contains("former") | low.contains("left"), "former").when(low.contains("current") | (function != "unknown"), "current").otherwise("unknown")


def role_axes(strong: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(axis, value, cases, adjudicated, share) for function and state; no share under 10 cases."""
    function = role_function(F.col("role"), rules)
    pairs = F.explode(F.array(F.struct(F.lit("function").alias("axis"), function.alias("value")), F.struct(F.lit("state").alias("axis"), role_state(F.col("role"), function).alias("value"))))
    counts = strong.select("strength", pairs.alias("p")).groupBy("p.axis", "p.value").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("strength") == "adjudicated").alias("adjudicated")
    )
    return counts.withColumn("share", F.when(F.col("cases") >= SMALL_N, F.bround(100.0 * F.col("adjudicated") / F.col("cases"), 0).cast("int")))


def case_techniques(strong: DataFrame, methods: DataFrame) -> DataFrame:
    """One row per occurrence: a technique that a case names twice counts twice."""
    return methods.select("row_ord", "m_pos", "technique", "family").join(strong.select("row_ord", "title", "year", "strength"), "row_ord")


def technique_strength(uses: DataFrame) -> DataFrame:
    by = [F.count_if(F.col("strength") == s).alias(s) for s in STRENGTH]
    return uses.groupBy("technique").agg(F.count(F.lit(1)).alias("cases"), *by)


def technique_exemplars(uses: DataFrame, n: int = 3) -> DataFrame:
    """The first n titles of each technique in corpus order; only n rows a technique are kept."""
    w = Window.partitionBy("technique").orderBy("row_ord", "m_pos")
    top = uses.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    return top.select("technique", F.col("nth").cast("long").alias("nth"), F.substring("title", 1, 90).alias("title"))


def technique_families(uses: DataFrame, methods: DataFrame, n: int = 5) -> DataFrame:
    """Record families of a technique's cases, each counted once per occurrence of the technique; the top n, ties by name."""
    families = methods.select("row_ord", F.col("family").alias("record")).distinct()
    counts = uses.select("row_ord", "technique").join(families, "row_ord").groupBy("technique", "record").agg(F.count(F.lit(1)).alias("cases"))
    w = Window.partitionBy("technique").orderBy(F.desc("cases"), "record")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def theme_rollup(uses: DataFrame) -> DataFrame:
    """Occurrences by the first two letters of the id; observations, not distinct cases."""
    return uses.groupBy(F.substring("technique", 1, 2).alias("theme")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("technique").alias("techniques"))


def year_top(uses: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent techniques of each year, of equals the first seen."""
    counts = uses.groupBy(F.coalesce("year", F.lit("????")).alias("year"), "technique").agg(F.count(F.lit(1)).alias("cases"), F.min(F.struct("row_ord", "m_pos")).alias("first"))
    w = Window.partitionBy("year").orderBy(F.desc("cases"), "first")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("year", "technique", "cases")


def channel_coverage(strong: DataFrame, methods: DataFrame, channels: list[str]) -> DataFrame:
    """Distinct cases of each listed channel, zero-filled; other channels are left out."""
    seen = methods.join(strong.select("row_ord"), "row_ord").groupBy("channel").agg(F.count_distinct("row_ord").alias("cases"))
    listed = strong.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return listed.join(seen, "channel", "left").select("channel", F.coalesce("cases", F.lit(0)).alias("cases"))


def evidence_families(strong: DataFrame, methods: DataFrame) -> DataFrame:
    """Per record family: distinct cases, distinct cases with a strong method, observables by basis.

    adjudicated_share divides cases with a strong method by all adjudicated
    cases after the posture cap, so it may exceed 100.
    """
    m = methods.join(strong.select("row_ord", "strength"), "row_ord")
    strong_method = F.col("claim_status").isin("adjudicated", "admitted")
    by = m.groupBy("family").agg(
        F.count_distinct("row_ord").alias("cases"),
        F.count_distinct(F.when(strong_method, F.col("row_ord"))).alias("strong_cases"),
        F.count_if(F.col("basis") == "mechanically_implied").alias("mechanical"),
        F.count_if(F.col("basis") != "mechanically_implied").alias("inferred"),
    )
    total = strong.agg(F.count_if(F.col("strength") == "adjudicated").alias("all"))
    share = F.when(F.col("all") > 0, F.bround(100.0 * F.col("strong_cases") / F.col("all"), 0).cast("int"))
    return by.crossJoin(F.broadcast(total)).withColumn("adjudicated_share", share).drop("all")  # one row


def behaviours(strong: DataFrame, methods: DataFrame, cap: int = 15) -> DataFrame:
    """Up to `cap` distinct actions of a technique, first seen first, those of adjudicated claims before others."""
    m = methods.join(strong.select("row_ord"), "row_ord").withColumn("norm", F.lower(F.trim("action")))
    first = Window.partitionBy("technique", "norm").orderBy("row_ord", "m_pos")
    m = m.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    nth = F.row_number().over(Window.partitionBy("technique").orderBy("row_ord", "m_pos"))
    m = m.withColumn("nth", nth).where(F.col("nth") <= cap)
    rank = F.row_number().over(Window.partitionBy("technique").orderBy(F.desc(F.col("claim_status") == "adjudicated"), "nth"))
    return m.select("technique", rank.alias("rank"), "action", "claim_status")


def corroboration(uses: DataFrame, methods: DataFrame, controls: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Detections of each technique with the cases whose record families back them (0: not corroborated)."""
    families = technique_families(uses, methods, 1 << 30)
    backed = families.join(F.broadcast(crosswalk), families.record == crosswalk.family)
    backed = backed.groupBy("technique", "control").agg(F.sum("cases").alias("cases"), F.array_join(F.array_sort(F.collect_set("record")), ",").alias("families"))
    wanted = controls.where("kind = 'detection'").select("technique", "control")
    return wanted.join(backed, ["technique", "control"], "left").select(
        "technique", "control", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("families", F.lit("")).alias("families"), F.col("cases").isNotNull().alias("corroborated")
    )


def tool_cover(counts: DataFrame, controls: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, technique, cases, how): techniques that share a control with a tool category; both, detect or prevent."""
    covered = tools.join(F.broadcast(controls), "control").groupBy("tool", "technique").agg(
        F.bool_or(F.col("kind") == "detection").alias("d"), F.bool_or(F.col("kind") == "prevention").alias("p")
    )
    how = F.when(F.col("d") & F.col("p"), "both").when(F.col("d"), "detect").otherwise("prevent")
    return covered.join(counts, "technique").select("tool", "technique", "cases", how.alias("how"))


def tool_ranking(cover: DataFrame, counts: DataFrame) -> DataFrame:
    """Cases that each tool category can detect and prevent, its share of all, in order."""
    total = counts.agg(F.sum("cases").alias("all"))
    sums = cover.groupBy("tool").agg(
        F.sum(F.when(F.col("how") != "prevent", F.col("cases")).otherwise(0)).alias("detects"),
        F.sum(F.when(F.col("how") != "detect", F.col("cases")).otherwise(0)).alias("prevents"),
        F.sum("cases").alias("covers"),
        F.count(F.lit(1)).alias("techniques"),
    )
    share = F.bround(100.0 * F.col("covers") / F.col("all"), 1)
    return sums.crossJoin(F.broadcast(total)).select("tool", "detects", "prevents", "covers", "techniques", share.alias("share")).orderBy(F.desc("covers"), F.desc("detects"), "tool")
