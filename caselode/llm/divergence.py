"""How far the sources of a language differ in their use of terms, by a frequent-pattern tree of term rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Bytes of terms: letters of ASCII, lower-cased, and all of other characters; everything else parts terms.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))

# ------------------------------------------------------------------------- counting


def _coded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of the term, number of the text) of all terms of the texts."""
    joined = b" \n ".join(t.translate(_CLEAN) for t in texts)
    coded = pc.split_pattern(pa.array([joined], pa.large_binary()).view(pa.large_utf8()), " ").flatten().dictionary_encode()
    terms, at = coded.dictionary, coded.indices.to_numpy()
    place = lambda word: pc.index(terms, pa.scalar(word, terms.type)).as_py()
    ends = at == place("\n")
    text = np.cumsum(ends)
    keep = ~ends & (at != place(""))
    return terms, at[keep].astype(np.int64), text[keep]


def _cuts(text: bytes, most: int) -> Iterator[bytes]:
    """The text in blocks, cut where no term is."""
    text, at = text.translate(_CLEAN), 0
    while len(text) - at > most and (end := text.find(b" ", at + most)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


_COUNTS = "lang string, source string, term string, docs long, n long"


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = 16 << 20) -> DataFrame:
    """(lang, source, term, docs, n): documents with the term and occurrences. Terms are runs of ASCII letters (A-Z lower-cased) and other characters beyond ASCII; nulls are ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))

    def counted(held: list[tuple[tuple, bytes]]) -> Iterator[pa.RecordBatch]:
        groups = {g: i for i, g in enumerate(dict.fromkeys(g for g, _ in held))}
        names = list(groups)
        if len(held) == 1 and len(held[0][1]) > block:  # the counts of its blocks belong to one document
            parts = []
            for cut in _cuts(held[0][1], block):
                terms, at, _ = _coded([cut])
                parts.append(pa.table({"term": terms.cast(pa.string()), "n": np.bincount(at, minlength=len(terms))}))
            whole = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
            whole = whole.filter(pc.greater(whole["n_sum"], 0)).combine_chunks()
            terms, n = whole["term"].combine_chunks(), whole["n_sum"].to_numpy()
            group, term, n_docs = np.zeros(len(n), np.int64), np.arange(len(n)), np.ones(len(n), np.int64)
        else:
            terms, at, text = _coded([t for _, t in held])
            in_text, times = np.unique(text * np.int64(len(terms)) + at, return_counts=True)
            of = np.array([groups[g] for g, _ in held], np.int64)[in_text // len(terms)]
            code, where = np.unique(of * np.int64(len(terms)) + in_text % len(terms), return_inverse=True)
            group, term = code // len(terms), code % len(terms)
            n_docs, n = np.bincount(where, minlength=len(code)), np.zeros(len(code), np.int64)
            np.add.at(n, where, times)
        for i in range(0, len(term), 1 << 16):
            cut = slice(i, i + (1 << 16))
            labels = [pa.array([names[g][k] for g in group[cut].tolist()], pa.string()) for k in (0, 1)]
            words = terms.take(pa.array(term[cut])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*labels, words, pa.array(n_docs[cut].astype(np.int64)), pa.array(n[cut].astype(np.int64))], ["lang", "source", "term", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                text = text.as_py()
                if held and size + len(text) > block:
                    yield from counted(held)
                    held, size = [], 0
                held.append(((lang, source), text))
                size += len(text) + 3
        if held:
            yield from counted(held)

    found = rows.mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


# ----------------------------------------------------------------------------- tree


def tree_nodes(lengths: np.ndarray, first: np.ndarray, item: np.ndarray, count: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a row of each node, multiplicity of each node) of the tree of sorted paths, level by level.

    Row i's path is the run of `lengths[i]` pairs (item, count) from place
    first[i], inserted times[i] times. A node is a distinct beginning of
    paths; equal beginnings stand next to each other as the rows are sorted.
    """
    n = len(lengths)
    shared = np.zeros(n, np.int64)  # how long the beginning is that a row shares with the one before it
    both = np.minimum(lengths[1:], lengths[:-1])
    starts = np.cumsum(both) - both
    step = np.arange(both.sum()) - np.repeat(starts, both)
    here, before = np.repeat(first[1:], both) + step, np.repeat(first[:-1], both) + step
    same = (item[here] == item[before]) & (count[here] == count[before])
    if n > 1:
        shared[1:] = np.minimum.reduceat(np.where(same, np.repeat(both, both), step), starts)
    rows, depth = np.arange(n), 0
    while len(rows):
        begin = np.flatnonzero(shared[rows] <= depth)
        yield depth, rows[begin], np.add.reduceat(times[rows], begin)
        depth += 1
        rows = rows[lengths[rows] > depth]


def pair_corrections(lengths: np.ndarray, item: np.ndarray, count: np.ndarray, p: np.ndarray, base: np.ndarray, times: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, later item, correction): summed over the paths that hold both items, once for each node and ancestor.

    For a term that both items have, |p - p'| stands where the sums over
    single items put |p - base'| + |base - p'| - |base - base'|. A node's
    correction with an ancestor counts as often as the node's multiplicity.
    """
    first = np.cumsum(lengths) - lengths
    width = np.int64(item.max(initial=0) + 1)
    keys, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def fold() -> None:
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, np.concatenate(sums))
        keys[:], sums[:] = [distinct], [total]

    waiting = 0
    for depth, rows, multiplicity in tree_nodes(lengths, first, item, count, times):
        each = max(1, most // max(depth, 1))
        for i in range(0, len(rows) if depth else 0, each):
            node = first[rows[i : i + each]]
            above, node = node[:, None] + np.arange(depth), node[:, None] + depth
            change = np.abs(p[above] - p[node]) - np.abs(p[above] - base[node]) - np.abs(base[above] - p[node]) + np.abs(base[above] - base[node])
            keys.append((item[above] * width + item[node]).ravel())
            sums.append((change * multiplicity[i : i + each, None]).ravel())
            waiting += len(keys[-1])
            if waiting > most:
                fold()
                waiting = 0
    fold()
    return keys[0] // width, keys[0] % width, sums[0]


# ---------------------------------------------------------------------------- audit


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + 5) / (total + 5 kept)), exact; null if nothing is kept."""
    over = F.lit(10**9).cast("decimal(10,0)") * (n + 5).cast("decimal(19,0)")
    under = F.nullif(total + 5 * kept, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


def _corrections(paths: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): the pair corrections of the trees of (lang, path, times), path an array of (g, n, p, base).

    Rows are dealt by ranges of their paths, so paths that begin alike meet in
    one task; a beginning that two tasks or batches share becomes a node in
    each, which changes no sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            code, path, times = langs.indices.to_numpy(), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if s == e:
                    continue
                own = path.slice(s, e - s)
                lengths, flat = pc.list_value_length(own).to_numpy().astype(np.int64), own.flatten()
                g, n, p, base = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                lo, hi, value = pair_corrections(lengths, g, n, p, base, times[s:e])
                for i in range(0, len(lo), 1 << 16):
                    x, y, z = (pa.array(c[i : i + (1 << 16)]) for c in (lo, hi, value))
                    yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[code[s]].as_py()] * len(x), pa.string()), x, y, z], ["lang", "lo", "hi", "value"])

    together = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return together.mapInArrow(run, "lang string, lo long, hi long, value long")


def audit(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 30,
    top: int = 50,
) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language, and its most overused terms.

    Each language keeps the V terms that stand in at least `least_docs` of its
    documents. A source that has N of their occurrences gives a term that it
    has n times the share p = 1 + floor(10**9 (n + 5) / (N + 5 V)), and so
    does the language as a whole. Part `pair` sums |p - q| over the kept terms
    for each other source of the language, all of them; part `term` lists
    the terms that the source has and uses more than the language, the `top`
    largest differences. Ranks go by value, then by the item's bytes.

    The sum of a pair is V |b - b'| for the shares b, b' of a term that neither
    has, plus for each source what its own terms add against the other's b,
    plus a correction for terms that both have. Corrections come from a
    frequent-pattern tree for each language: a term's row is its sources with
    nonzero counts, ordered by their number of kept terms; equal rows are
    inserted once with their number, rows that begin alike share nodes, and a
    node adds its correction with each of its ancestors once, times the
    number of rows that pass it. A row is as long as the term has sources; no
    row holds a document.

    All arithmetic is on whole numbers: exact while counts stay below 10**18.

    Defined cases: null text, lang and source are '', which is a language and
    a source like any other; repeated rows count again; a source without terms
    takes part with N = 0; a language without kept terms has pairs of value 0,
    one with a single source has no pairs; other columns are ignored; an empty
    table gives an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    counts = term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = stage_table(kept.where(F.col("docs") >= least_docs).select("lang", "term", "total", "by_source"), "kept-terms")
    cells = kept.select("lang", "term", "total", F.inline("by_source"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("sum"))
    groups = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("own", "sum", "kept", "lang_total")}
    groups = groups.withColumns(none)
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns(
        {
            "g": F.row_number().over(by_lang.orderBy(F.desc("own"), "source")).cast("long") - 1,
            "sources": F.count(F.lit(1)).over(by_lang),
            "base": F.coalesce(_share(F.lit(0), F.col("sum"), F.col("kept")), F.lit(0)),
        }
    )
    groups = stage_table(groups, "groups")
    shared = cells.join(groups.select("lang", "source", "g", "sum", "kept", "lang_total", "base"), ["lang", "source"])
    share, of_lang = _share(F.col("n"), F.col("sum"), F.col("kept")), _share(F.col("total"), F.col("lang_total"), F.col("kept"))
    shared = shared.select("lang", "source", "term", "g", "n", share.alias("p"), of_lang.alias("q"), "base")
    shared = stage_table(shared, "shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # Every two sources of a language: the result has a row for each. Languages of many sources are dealt over several keys.
    dealt = F.ceil(F.col("sources") / 1000).cast("int")
    one = groups.select("lang", "g", "source", "base", "kept", F.pmod("g", dealt).cast("int").alias("deal"))
    other = groups.select("lang", F.col("g").alias("g2"), F.col("source").alias("source2"), F.col("base").alias("base2"), F.explode(F.sequence(F.lit(0), dealt - 1)).alias("deal"))
    pairs = one.join(other, ["lang", "deal"]).where("g <> g2").drop("deal")
    # What a source's own terms add against another's base: sums over the shares below and above it, in one order with the bases.
    points = shared.groupBy("lang", "g", F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("times")).withColumns({"base": F.lit(0).cast("long"), "g2": F.lit(-1).cast("long"), "s1": F.lit(""), "s2": F.lit(""), "kept": F.lit(0).cast("long")})
    asked = pairs.select("lang", "g", F.col("base2").alias("x"), F.lit(0).cast("long").alias("times"), "base", "g2", F.col("source").alias("s1"), F.col("source2").alias("s2"), "kept")
    own = Window.partitionBy("lang", "g")
    below = own.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    weighed = F.col("times") * F.col("x")
    line = points.unionByName(asked).withColumns(
        {"n_low": F.sum("times").over(below), "x_low": F.sum(weighed).over(below), "n_all": F.sum("times").over(own), "x_all": F.sum(weighed).over(own)}
    )
    line = line.where("g2 >= 0")
    x, gap = F.col("x"), F.abs(F.col("base") - F.col("x"))
    against = x * F.col("n_low") - F.col("x_low") + (F.col("x_all") - F.col("x_low")) - x * (F.col("n_all") - F.col("n_low"))
    # V |b - b'| is added once a pair, by the side of smaller g.
    value = against - F.col("n_all") * gap + F.when(F.col("g") < F.col("g2"), F.col("kept") * gap).otherwise(F.lit(0))
    low = F.col("g") < F.col("g2")
    single = line.select(
        "lang", F.least("g", "g2").alias("lo"), F.greatest("g", "g2").alias("hi"), value.alias("value"),
        F.when(low, F.col("s1")).otherwise(F.col("s2")).alias("s_lo"), F.when(low, F.col("s2")).otherwise(F.col("s1")).alias("s_hi"),
    )
    row = F.sort_array(F.collect_list(F.struct("g", "n", "p", "base")))
    paths = shared.groupBy("lang", "term").agg(row.alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    nothing = F.lit(None).cast("string")
    both = _corrections(stage_table(paths, "paths")).select("lang", "lo", "hi", "value", nothing.alias("s_lo"), nothing.alias("s_hi"))
    found = single.unionByName(both).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"), F.max("s_lo").alias("s_lo"), F.max("s_hi").alias("s_hi"))
    sides = F.explode(F.array(F.struct(F.col("s_lo").alias("source"), F.col("s_hi").alias("item")), F.struct(F.col("s_hi").alias("source"), F.col("s_lo").alias("item")))).alias("side")
    listed = found.select("lang", "value", sides).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    listed = listed.withColumn("rank", F.row_number().over(best))
    return listed.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(s.total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 5) // (g.total + 5 * z.v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.total + 5) // (z.lang_total + 5 * z.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM listed)
WHERE part = 'pair' OR rank <= 50
"""
