"""All sections of the evidence ledger from one view and one aggregate.

A case and its methods are one row; that row is cut into facts (section, a, b)
and the facts are added up once. Every section is a part of the sums: a small
table, whatever the number of cases. Since a case is whole in its row, what
counts once a case is made distinct there, and the sums need no distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselode.operators.ledger import POSTURE_WEIGHT, PROVEN_POSTURE, STRENGTH, lookup, role_function, role_state
from caselode.sources import shared

STRONG = ("adjudicated", "admitted")
#: Columns of a method, besides its place, that facts are made of.
METHOD = ["claim_status", "has_quote", "verbatim", "technique", "family", "channel", "basis", "artifact"]
#: Rows that a section keeps for each of its first keys, and what decides between equal numbers.
TOP = {"year_technique": (5, "first"), "technique_family": (5, "b"), "family_channel": (3, "first"), "family_example": (3, "first")}


def whole_cases(cases: DataFrame, methods: DataFrame) -> DataFrame:
    """cases with their methods in order (ms), strength and capped, which are null where the verdict isn't true. One scan of each table.

    Methods are dealt by case as plain rows of the columns that facts read, and
    put in lists afterwards: lists that each task begins hold hardly more than
    one row a case, and would be sorted and sent as well.
    """
    columns = ["m_pos", *METHOD]
    best = F.max(lookup(STRENGTH, F.col("claim_status"))).alias("w")
    ms = methods.select("row_ord", *columns).repartition("row_ord").groupBy("row_ord").agg(best, F.sort_array(F.collect_list(F.struct(*columns))).alias("ms"))
    rows = cases.join(ms, "row_ord", "left")
    w, weight = F.coalesce("w", F.lit(1)), lookup(POSTURE_WEIGHT, F.col("posture"))
    held = F.when(weight.isNotNull() & (weight < PROVEN_POSTURE), F.least(w, F.lit(2))).otherwise(w)
    names = F.array(*[F.lit(k) for k, _ in sorted(STRENGTH.items(), key=lambda kv: kv[1])])
    true = F.col("verdict").eqNullSafe(True)
    none = F.array().cast(dict(rows.dtypes)["ms"])
    return rows.withColumns({"ms": F.coalesce("ms", none), "strength": F.when(true, F.element_at(names, held)), "capped": true & (w > held)}).drop("w")


def facts(whole: DataFrame, rules: list[tuple[str, str]], channels: list[str]) -> DataFrame:
    """(section, a, b, n, strong, first) summed over all cases; first is the place of the first that counts.

    A place is one number, row_ord (below 2**47) and the method's place in its
    case (below 2**16), so that all sums are of fixed width and are added up
    in hash tables before anything is shuffled.
    """
    true, nothing = F.col("verdict").eqNullSafe(True), F.lit("")

    def fact(section: str, a: Column, b: Column = nothing, n: Column | None = None, strong: Column | None = None, at: Column | None = None) -> Column:
        n, strong = F.lit(1) if n is None else n, F.lit(False) if strong is None else strong
        values = (F.lit(section), a, b, n.cast("long"), strong.cast("long"), (F.lit(0) if at is None else at).cast("long"))
        return F.struct(*[v.alias(k) for k, v in zip(("section", "a", "b", "n", "strong", "at"), values, strict=True)])

    ms, contributes = F.col("ms"), F.size("ms") > 0
    each = lambda make: F.transform(ms, make)
    claimed = lambda m: m["claim_status"].isin(*STRONG)
    counts = {"total": F.lit(True), "with_verdict": F.col("verdict").isNotNull(), "verdict_true": true, "contributing": true & contributes, "excluded_non_insider": F.col("verdict").eqNullSafe(False), "excluded_no_verdict": F.col("verdict").isNull()}
    basis = F.array(*[fact("basis", F.lit(k), n=c.cast("int")) for k, c in counts.items()])
    function = role_function(F.col("role"), rules)
    strong = F.col("strength").isin("adjudicated")
    one = F.array(
        fact("strength", F.col("strength"), strong=F.col("capped")), fact("posture", F.col("posture")), fact("model", F.col("model")),
        fact("role_function", function, strong=strong), fact("role_state", role_state(F.col("role"), function), strong=strong),
    )
    families = F.array_distinct(each(lambda m: m["family"]))
    seen = F.array_distinct(F.filter(each(lambda m: m["channel"]), lambda c: c.isin(*channels)))
    many = [
        each(lambda m, i: fact("technique", m["technique"], F.col("strength"), at=i)),
        each(lambda m, i: fact("year_technique", F.coalesce("year", F.lit("????")), m["technique"], at=i)),
        F.flatten(each(lambda m: F.transform(families, lambda f: fact("technique_family", m["technique"], f)))),
        F.filter(each(lambda m: fact("quotes", F.when(m["verbatim"], "verbatim").when(~m["verbatim"], "not_verbatim").otherwise("unstamped"), n=m["has_quote"].cast("int"))), lambda x: x["n"] > 0),
        F.transform(families, lambda f: fact("family", f, strong=F.exists(ms, lambda m: (m["family"] == f) & claimed(m)))),
        each(lambda m: fact("family_basis", m["family"], F.when(m["basis"] == "mechanically_implied", "mechanical").otherwise("inferred"))),
        F.filter(each(lambda m, i: fact("family_channel", m["family"], F.when(m["channel"].isin(*channels), m["channel"]), at=i)), lambda x: x["b"].isNotNull()),
        F.filter(each(lambda m, i: fact("family_example", m["family"], F.trim(m["artifact"]), at=i)), lambda x: x["b"] != ""),
        F.transform(seen, lambda c: fact("channel", c)),
    ]
    listed = F.flatten(F.array(basis, *[F.when(true, x).otherwise(F.slice(x, 1, 0)) for x in (one, *many)]))
    rows = whole.select("row_ord", F.explode(listed).alias("f")).select("row_ord", "f.*")
    first = F.min(F.coalesce("row_ord", F.lit(0)).cast("long") * (1 << 16) + F.col("at"))
    return rows.groupBy("section", "a", "b").agg(F.sum("n").alias("n"), F.sum("strong").alias("strong"), first.alias("first"))


def staged(summed: DataFrame) -> DataFrame:
    """The sums as a small table in the shared folder, which every section reads, so that they are made once."""
    path = shared.fresh_path(summed.sparkSession, "ledger-facts")
    summed.write.parquet(path)
    return summed.sparkSession.read.schema(summed.schema).parquet(path)


def sections(summed: DataFrame, channels: list[str]) -> DataFrame:
    """(section, a, b, n, strong, rank) of all sections: the largest rows of those in TOP, all rows of the others (rank 0), listed channels without cases too."""
    listed = summed.sparkSession.createDataFrame([("channel", c, "") for c in channels], "section string, a string, b string")
    known = summed.where("section <> 'channel'").unionByName(
        listed.join(summed.where("section = 'channel'"), ["section", "a", "b"], "left").select("section", "a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("strong", F.lit(0)).alias("strong"), "first")
    )
    # artifacts that differ in capitals only are one example, written as the first of them
    same = known.where(F.col("section") == "family_example").groupBy("section", "a", F.lower("b").alias("b"))
    examples = same.agg(F.sum("n").alias("n"), F.sum("strong").alias("strong"), F.min("first").alias("first"), F.substring(F.min_by("b", "first"), 1, 70).alias("text"))
    known = known.where(F.col("section") != "family_example").withColumn("text", F.lit("")).unionByName(examples)
    out = known.where(~F.col("section").isin(*TOP)).withColumn("rank", F.lit(0))
    for section, (n, tie) in TOP.items():
        own = known.where(F.col("section") == section)
        order = [F.col("first")] if section == "family_example" else [F.desc("n"), F.col(tie)]
        out = out.unionByName(own.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("rank") <= n))
    return out.select("section", "a", "b", "n", "strong", "rank", "text")


def evidence_records(cut: DataFrame) -> DataFrame:
    """One row for each record family, by sections alone: cases, cases with a strong method, observables by basis, top channels with their numbers, example artifacts, share of the adjudicated cases."""
    of = lambda s: cut.where(F.col("section") == s)
    basis = of("family_basis").groupBy("a").agg(*[F.coalesce(F.sum(F.when(F.col("b") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("mechanical", "inferred")])
    row = lambda text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), ", ")
    channels = of("family_channel").groupBy("a").agg(row(F.concat_ws(":", "b", "n")).alias("channels"))
    examples = of("family_example").groupBy("a").agg(row(F.col("text")).alias("examples"))
    total = of("strength").where("a = 'adjudicated'").agg(F.sum("n").alias("all"))
    found = of("family").select("a", F.col("n").alias("cases"), F.col("strong").alias("strong_cases"))
    for other in (basis, channels, examples):
        found = found.join(other, "a", "left")
    share = F.when(F.col("all") > 0, F.bround(100.0 * F.col("strong_cases") / F.col("all"), 0).cast("int"))
    found = found.crossJoin(F.broadcast(total))  # one row
    return found.select(F.col("a").alias("family"), "cases", "strong_cases", "mechanical", "inferred", F.coalesce("channels", F.lit("")).alias("channels"), F.coalesce("examples", F.lit("")).alias("examples"), share.alias("adjudicated_share"))


def tool_dossiers(cut: DataFrame, controls: DataFrame, tools: DataFrame, crosswalk: DataFrame, top: int = 6) -> DataFrame:
    """One row for each tool category, in order of cases to detect, to prevent, corroborated cases, and name: shares of all
    technique cases, the record families that back it with the most frequent one's cases, its first techniques."""
    of = lambda s: cut.where(F.col("section") == s)
    observed = of("technique").groupBy(F.col("a").alias("technique")).agg(F.sum("n").alias("cases"))
    observed = observed.join(F.broadcast(controls.select("technique").distinct()), "technique", "left_semi")
    volume = observed.agg(F.sum("cases").alias("volume"))
    kinds = tools.join(F.broadcast(controls), "control").groupBy("tool", "technique").agg(
        F.bool_or(F.col("kind") == "detection").alias("d"), F.bool_or(F.col("kind") == "prevention").alias("p")
    )
    covered = kinds.join(observed, "technique")
    best = F.sort_array(F.collect_list(F.struct((-F.col("cases")).alias("order"), "technique", F.when(F.col("d") & F.col("p"), "both").when(F.col("d"), "detect").otherwise("prevent").alias("how"))))
    sums = covered.groupBy("tool").agg(
        F.coalesce(F.sum(F.when(F.col("d"), F.col("cases"))), F.lit(0)).alias("detects"),
        F.coalesce(F.sum(F.when(F.col("p"), F.col("cases"))), F.lit(0)).alias("prevents"),
        F.array_join(F.transform(F.slice(best, 1, top), lambda x: F.concat_ws(":", x["technique"], x["how"], -x["order"])), ", ").alias("techniques"),
    )
    detections = tools.join(F.broadcast(controls.where("kind = 'detection'").select("control").distinct()), "control", "left_semi")
    backing = detections.join(F.broadcast(crosswalk), "control").select("tool", "family").distinct()
    backing = backing.join(of("family").select(F.col("a").alias("family"), F.col("n").alias("cases")), "family")
    via = F.sort_array(F.collect_list(F.struct((-F.col("cases")).alias("order"), "family")))
    backing = backing.groupBy("tool").agg(F.max("cases").alias("corroborated"), F.array_join(F.transform(via, lambda x: x["family"]), ", ").alias("via"))
    found = tools.select("tool").distinct().join(sums, "tool", "left").join(backing, "tool", "left").crossJoin(F.broadcast(volume))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: F.when(F.col("volume") > 0, F.bround(100.0 * zero(c) / F.col("volume"), 0).cast("int"))
    rows = found.select("tool", zero("detects").alias("detects"), zero("prevents").alias("prevents"), share("detects").alias("detect_share"), share("prevents").alias("prevent_share"), zero("corroborated").alias("corroborated"), F.coalesce("via", F.lit("")).alias("via"), F.coalesce("techniques", F.lit("")).alias("techniques"))
    order = Window.orderBy(F.desc("detects"), F.desc("prevents"), F.desc("corroborated"), "tool")  # one row a tool category
    return rows.withColumn("place", F.row_number().over(order))


def detection_totals(corroborated: DataFrame, titles: DataFrame) -> DataFrame:
    """For each technique, of rows (technique, control, cases, corroborated): its detections in scope, how many are corroborated, and the titles of these."""
    named = corroborated.join(F.broadcast(titles), "control", "left").withColumn("title", F.coalesce("title", "control"))
    shown = F.array_sort(F.collect_list(F.when(F.col("corroborated"), F.struct((-F.col("cases")).alias("order"), "control", "title"))))
    return named.groupBy("technique").agg(
        F.count(F.lit(1)).alias("in_scope"), F.count_if("corroborated").alias("corroborated"), F.array_join(F.transform(shown, lambda x: x["title"]), ", ").alias("titles")
    )


def payload(cut: DataFrame) -> DataFrame:
    """The whole ledger as one row: a JSON object with an array of rows for each section."""
    rows = F.sort_array(F.collect_list(F.struct("a", "b", "rank", "n", "strong")))
    by = cut.groupBy("section").agg(rows.alias("rows"))
    return by.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "rows"))))).alias("ledger"))
