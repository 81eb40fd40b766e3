"""Line deduplication from a suffix array over line ids, by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stage_table

#: Words are cut at blanks, for min_words.
WORD = "[^ \\t\\r\\f\\n]+"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_id, text, n_lines): doc numbers the rows, so that rows may repeat and ids may be null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"doc": F.monotonically_increasing_id(), "n_lines": F.size(F.split("text", "\n", -1))})
    return stage_table(rows, "numbered")


def line_ids(rows: DataFrame, min_words: int | None = None) -> DataFrame:
    """(doc, doc_id, pos, left, long, line): line is the 128-bit hash of a line, left the number of lines from it to the end.

    long says whether the line has min_words words.
    """
    found = rows.select("doc", "doc_id", "n_lines", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    long = F.lit(False)
    if min_words:  # so many words can't be shorter
        long = (F.length("text") >= 2 * min_words - 1) & (F.regexp_count("text", F.lit(WORD)) >= min_words)
    return found.select(
        "doc", "doc_id", F.col("pos").cast("long").alias("pos"), (F.col("n_lines") - F.col("pos")).cast("long").alias("left"),
        long.alias("long"), F.unhex(F.md5("text")).alias("line"),
    )


def _smaller(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys with `less`: the sum of n over all keys that sort before.

    Keys are dealt out by range; a running sum in each range is added to the
    sums of the ranges before it, of which there is one row for each.
    """
    ranges = stage_table(keys.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("range").agg(F.sum("n").alias("n"))
    sizes = sizes.select("range", so_far(Window.orderBy("range")).alias("before"))
    inside = ranges.withColumn("inside", so_far(Window.partitionBy("range").orderBy(*by)))
    return inside.join(F.broadcast(sizes), "range").withColumn("less", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def suffix_ranks(lines: DataFrame, upto: int | None = None) -> DataFrame:
    """(doc, pos, left, rank, n): the suffix array's order of the lines' suffixes by their first `upto` line ids.

    rank is the number of suffixes that sort before, n the number that share
    it: those with the same first `upto` lines (or the same fewer lines, where
    the document ends). None: whole suffixes. Lines sort by their hash.

    Doubling: suffixes ranked by k lines are ranked by 2k lines by the pair of
    their own rank and the rank of the suffix k lines on (-1 past the end).
    Only suffixes that share their rank take part. Ranks are running sums over
    the distinct pairs, so a very common line makes one large count, not one large group.
    """
    keys = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    ranks = _smaller(keys, ["line"]).select("line", F.col("less").alias("rank"), "n")
    ranked = stage_table(lines.join(ranks, "line").select("doc", "pos", "left", "rank", "n"), "ranks")
    k = 1
    while upto is None or k < upto:
        step = k if upto is None else min(k, upto - k)
        shared = ranked.where("n > 1")
        if not shared.where(F.col("left") > k).limit(1).count():
            break
        on = ranked.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = shared.drop("n").join(on, ["doc", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1)))
        pairs = stage_table(pairs, "pairs")
        keys = _smaller(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")), ["rank", "next"])
        firsts = keys.groupBy("rank").agg(F.min("less").alias("first"))
        keys = keys.join(firsts, "rank").select("rank", "next", (F.col("rank") + F.col("less") - F.col("first")).alias("new"), "n")
        finer = pairs.join(keys, ["rank", "next"]).select("doc", "pos", "left", F.col("new").alias("rank"), "n")
        ranked = stage_table(finer.unionByName(ranked.where("n = 1")), "ranks")
        k += step
    return ranked


def long_runs(rows: DataFrame, n: int, min_words: int) -> DataFrame:
    """(doc, doc_id, pos, line): runs of n lines that have at least min_words words; line is the hash of the run."""
    lines = F.split("text", "\n", -1)
    whole = F.slice(lines, F.col("i") + 1, n)
    found = rows.where(F.col("n_lines") >= n).select("doc", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("n_lines") - n)).alias("i"))
    found = found.select("doc", "doc_id", F.col("i").alias("pos"), F.array_join(whole, "\n").alias("text"))
    found = found.where(F.length("text") >= 2 * min_words - 1).where(F.regexp_count("text", F.lit(WORD)) >= min_words)
    return found.select("doc", "doc_id", F.col("pos").cast("long").alias("pos"), F.unhex(F.md5("text")).alias("line"))


def _at() -> Column:
    """Where a suffix stands: rows of smaller doc_id (nulls last) are earlier, and lines further up in a row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "pos")


def _members(suffixes: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The suffixes that share `by` with others: their columns `keep`, their interval's rank, its size n and its first suffix.

    rank is the interval's place in the suffix array of the shared suffixes:
    an interval of rank r and size n that is divided (by = rank, next) gives
    parts within r to r + n, after the members that ended or dropped out.
    """
    sizes = [F.count(F.lit(1)).alias("n"), F.min(_at()).alias("first")] + [F.max("n").alias("whole")] * ("rank" in by)
    keys = _smaller(suffixes.groupBy(*by).agg(*sizes).where("n > 1"), by)
    if "rank" in by:
        parts = keys.groupBy("rank").agg(F.min("less").alias("least"), F.sum("n").alias("rest"))
        place = F.col("rank") + F.col("whole") - F.col("rest") + F.col("less") - F.col("least")
        keys = keys.join(parts, "rank").select(*by, "n", "first", place.alias("new"))
    else:
        keys = keys.withColumnRenamed("less", "new")
    keys = stage_table(keys, "intervals")
    suffixes = suffixes.select(*dict.fromkeys([*keep, *by]))
    found = spread_join(suffixes, keys, by, "n", ["doc", "pos"])
    return stage_table(found.select(*keep, F.col("new").alias("rank"), "n", "first"), "members")


def _later(members: DataFrame, span: Column) -> DataFrame:
    """All but the earliest suffix of each interval, and the earliest."""
    later = members.where("doc <> first.doc or pos <> first.pos")
    first = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "doc", "pos")]
    return later.select("doc", "doc_id", "pos", span.cast("long").alias("span"), *first)


def later_copies(rows: DataFrame, min_lines: int = 2, min_words: int | None = 50) -> DataFrame:
    """(doc, doc_id, pos, span, first_doc_id, first_doc, first_pos): suffixes that share `span` lines with an earlier one, and the earliest.

    Prefix doubling over the suffixes of line ids. An interval is a set of two
    or more suffixes whose longest common prefix has at least k lines, or ends
    with the texts. From the intervals of k lines those of 2k lines follow by
    the pair of a suffix's interval and that of the suffix k lines on (-1 past
    the end). A suffix that has nothing in common with another any more drops
    out; the doubling goes on until no interval is left that could be longer.
    k is 1, 2, 4, ..., min_lines, 2 min_lines, 4 min_lines, ...

    Each suffix is given with each k from min_lines on, or the lines left if
    fewer. Single lines, and runs of less than min_lines lines, count if they
    have at least min_words words (None: never).
    """
    keep = ["doc", "doc_id", "pos", "left", "long"]
    now = _members(line_ids(rows, min_words), ["line"], keep)
    k, ended = 1, None
    found = _later(now if min_lines == 1 else now.where("long"), F.lit(1))
    for n in range(2, min_lines if min_words else 0):
        found = found.unionByName(_later(_members(long_runs(rows, n, min_words), ["line"], ["doc", "doc_id", "pos"]), F.lit(n)))
    while now.where(F.col("left") > k).limit(1).count():
        step = min(k, min_lines - k) if k < min_lines else k
        over = now.where(F.col("left") <= k)  # whole suffixes: these intervals stay as they are
        ended = over if ended is None else ended.unionByName(over)
        on = now.where(F.col("left") > k).unionByName(ended).select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = now.where(F.col("left") > k).join(on, ["doc", "pos"], "left")
        pairs = pairs.withColumn("next", F.coalesce("next", F.when(F.col("left") <= step, F.lit(-1)))).where("next is not null")
        k += step
        now = _members(stage_table(pairs.select(*keep, "rank", "n", "next"), "pairs"), ["rank", "next"], keep)
        if k >= min_lines:
            found = found.unionByName(_later(now.where(F.col("left") >= min_lines), F.least(F.lit(k), F.col("left"))))
    return found


def repeated_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = 50
) -> DataFrame:
    """doc_id, start, n_lines, first_doc_id, first_start: runs of lines that repeat an earlier run.

    Each suffix counts with its longest interval, whose common prefix is known
    to the last doubling; neighbouring suffixes whose earliest copies are
    neighbours too make one run, and runs that lie inside another of the same
    text are left out. So a run is as long as its one source allows, and all
    runs together are what drop_repeated_lines deletes.
    """
    rows = numbered(docs, id_col, text_col)
    copies = later_copies(rows, min_lines, min_words)
    best = F.max(F.struct("span", F.struct(-F.col("first_doc"), -F.col("first_pos")), "first_doc_id", "first_doc", "first_pos"))
    copies = copies.groupBy("doc", "doc_id", "pos").agg(best.alias("b")).select("doc", "doc_id", "pos", "b.span", "b.first_doc_id", "b.first_doc", "b.first_pos")
    copies = copies.withColumn("shift", F.col("pos") - F.col("first_pos"))
    run = Window.partitionBy("doc", "first_doc", "shift").orderBy("pos")
    copies = copies.withColumn("island", F.col("pos") - F.row_number().over(run))
    runs = copies.groupBy("doc", "doc_id", "first_doc", "first_doc_id", "shift", "island").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("span")).alias("end")
    )
    before = Window.partitionBy("doc").orderBy("start", F.desc("end"), "first_doc", "shift").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inside", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))).where("not inside")
    return runs.select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_lines"), "first_doc_id", (F.col("start") - F.col("shift")).alias("first_start"))


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int | None = 50
) -> DataFrame:
    """doc_id, text, n_lines, n_deleted, n_runs: every text without the lines of later copies.

    A line goes if it lies in a run that occurs earlier (see later_copies) and
    has at least min_lines lines or min_words words, so a long line goes on
    its own; overlapping runs of one text are included. What
    goes has a copy that stays: its earliest. n_runs is the number of gaps.
    Every step is a DataFrame operation.

    Defined cases: a null or empty text is one empty line; texts whose lines
    all go are empty; null ids count as last; repeated rows are later copies
    of each other; very long texts cost their number of lines; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    copies = later_copies(rows, min_lines, min_words).groupBy("doc", "pos").agg(F.max(F.col("pos") + F.col("span")).alias("end"))
    order = Window.partitionBy("doc").orderBy("pos")  # at most a text's own lines
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("opens", F.coalesce(F.col("pos") > reached, F.lit(True)).cast("int"))
    copies = copies.withColumn("gap", F.sum("opens").over(order))
    gaps = copies.groupBy("doc", "gap").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    gone = gaps.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"), F.sum(F.col("end") - F.col("start")).alias("n_deleted")
    )
    # the lines between two gaps: from the end of the one to the start of the other
    lines = F.split("text", "\n", -1)
    edge = lambda at: F.array(F.struct(at.cast("long").alias("start"), at.cast("long").alias("end")))
    edges = F.concat(edge(F.lit(0)), "gaps", edge(F.col("n_lines")))
    spans = F.zip_with(
        F.slice("edges", F.lit(1), F.size("edges") - 1),
        F.slice("edges", F.lit(2), F.size("edges") - 1),
        lambda a, b: F.slice(F.col("lines"), (a["end"] + 1).cast("int"), (b["start"] - a["end"]).cast("int")),
    )
    whole = rows.join(gone, "doc", "left").withColumns({"edges": F.when(F.col("gaps").isNotNull(), edges), "lines": F.when(F.col("gaps").isNotNull(), lines)})
    return whole.select(
        "doc_id",
        F.when(F.col("gaps").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(spans), "\n")).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.size("gaps"), F.lit(0)).cast("long").alias("n_runs"),
    )


def _digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of two lines or more, the rule of ORACLE_SQL."""
    return _digests(drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=None))


def passages(spark, sf_dir: str) -> DataFrame:
    """Runs of two lines or more, and single lines of 50 words or more."""
    return _digests(drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM lines
), marked AS (
  SELECT *, following IS NOT NULL
            AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS later
  FROM pairs
), judged AS (
  SELECT *, later OR coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM marked
), gaps AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM judged
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM gaps GROUP BY doc_id
"""

PASSAGES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM lines
), marked AS (
  SELECT *, following IS NOT NULL
            AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS later,
         len(regexp_extract_all(line, '[^ \t\r\f]+')) >= 50
            AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS alone
  FROM pairs
), judged AS (
  SELECT *, later OR alone OR coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM marked
), gaps AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM judged
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM gaps GROUP BY doc_id
"""
