"""SimHash near-deduplication by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread_join, stage_table
from .components import connected_components

# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included, as an unsigned int."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        block = hashes[at : at + (1 << 14)].view(np.uint8)
        ones += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


# --------------------------------------------------------------- covering code

#: Generator polynomials of perfect cyclic codes: (length, information bits, radius, polynomial).
GOLAY = (23, 12, 3, 0b101011100011)
HAMMING = (15, 11, 1, 0b10011)
#: The first blocks of the fingerprint's bits that make up the anchors, by number of blocks.
BLOCKS = (GOLAY, GOLAY, HAMMING)


def _syndrome(words: np.ndarray, code: tuple) -> np.ndarray:
    """Remainder by the generator polynomial; words that differ by a code word have the same."""
    n, k, _, poly = code
    rest = words.astype(np.int64)
    for bit in range(n - 1, n - k - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (poly << (bit - (n - k))), rest)
    return rest


@lru_cache
def _steps(code: tuple, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the differences to all code words within radius + more: (first index, differences, excess over the radius)."""
    n, k, radius, _ = code
    all_words = np.arange(1 << n, dtype=np.int64)
    weight = np.bitwise_count(all_words)
    near = all_words[weight <= radius + more]
    syndrome = _syndrome(near, code)
    order = np.argsort(syndrome, kind="stable")
    first = np.searchsorted(syndrome[order], np.arange((1 << (n - k)) + 1))
    near = near[order]
    return first, near, np.maximum(np.bitwise_count(near).astype(np.int64) - radius, 0)


def anchors(fps: np.ndarray, blocks: int, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, excess) for each anchor within reach.

    The anchors are the product of perfect codes on the first blocks of bits.
    Each block of a fingerprint lies within its code's covering radius of
    exactly one code word; the excess of an anchor is the sum, over blocks, of
    the distance beyond that radius. All anchors of excess <= more are given.
    """
    who, key, excess = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    low = 0
    for code in BLOCKS[:blocks]:
        n = code[0]
        bits = (fps >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64)[who]
        first, steps, over = _steps(code, more)
        syndrome = _syndrome(bits, code)
        count = first[syndrome + 1] - first[syndrome]
        rep = np.repeat(np.arange(len(who)), count)
        at = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + first[syndrome[rep]]
        word, total = bits[rep] ^ steps[at], excess[rep] + over[at]
        ok = total <= more
        rep = rep[ok]
        who, key, excess = who[rep], key[rep] << n | word[ok], total[ok]
        low += n
    return who, key, excess


def blocks_for(rows: int) -> int:
    """So many blocks that an anchor has a bounded number of fingerprints on average: 2^12, 2^24 or 2^35 anchors."""
    return 1 if rows <= 1 << 20 else 2 if rows <= 1 << 32 else 3


# -------------------------------------------------------------------- linking


def _forest(near: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between near and fps (near's members are among fps)."""
    label = np.arange(len(fps))
    rows = max(1, (1 << 21) // max(1, len(fps)))
    for at in range(0, len(near), rows):
        i, j = np.nonzero(np.bitwise_count(near[at : at + rows, None] ^ fps[None, :]) <= bits)
        if not len(i):
            continue
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        ends = np.concatenate((starts[1:], [len(i)]))
        while True:
            low, high = np.minimum.reduceat(label[j], starts), np.maximum.reduceat(label[j], starts)
            split = np.flatnonzero(low != high)
            if not len(split):
                break
            r = split[0]
            found = np.unique(label[j[starts[r] : ends[r]]])
            to = np.arange(len(fps))
            to[found] = found[0]
            label = to[label]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, *, bits: int = 3, blocks: int = 1, hot: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between fingerprints that differ in at most `bits` bits.

    Not all such pairs are given, but a forest that connects exactly the same
    fingerprints: no link between different components is lost or invented.

    Fingerprints at distance d <= bits have a point between them, within
    bits // 2 of one and bits - bits // 2 of the other. That point lies within
    the covering radius of an anchor, so both lie within the radius plus their
    share of the threshold, the smaller share on one side. Each fingerprint is
    copied to every anchor within the radius plus the larger share, and those
    within the smaller share are compared with all at the anchor.

    Anchors that more than `hot` copies reach are dealt out over several
    tasks: the compared side is split, the other side repeated for each part.
    """
    small, large = bits // 2, bits - bits // 2

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                who, key, excess = anchors(part, blocks, large)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(excess <= small), pa.array(part[who].view(np.int64))], ["anchor", "near", "fp"]
                )

    copies = distinct.select("fp").mapInArrow(copy, "anchor long, near boolean, fp long")
    crowded = stage_table(copies.groupBy("anchor").count().where(F.col("count") > hot), "anchors")
    if crowded.limit(1).count():
        parts = F.ceil(F.col("count") / hot).cast("int")
        dealt = copies.join(crowded, "anchor", "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
        own = F.when(F.col("near"), F.pmod(F.xxhash64("fp"), "parts").cast("int"))
        copies = dealt.withColumn("own", own).select(
            "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own", "fp"
        ).select("anchor", "part", (F.coalesce("own", F.lit(-1)) == F.col("part")).alias("near"), "fp")
    else:
        copies = copies.select("anchor", F.lit(0).alias("part"), "near", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            anchor, part, near, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for s, e in zip([0, *cut], [*cut, len(fps)], strict=True):
                if e - s > 1 and near[s:e].any():
                    x, y = _forest(fps[s:e][near[s:e]], fps[s:e], bits)
                    a.append(x), b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:  # sorted; a group may run over several batches
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[3] = new[3].view(np.uint64)
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or held and (held[-1][0][-1] != new[0][0] or held[-1][1][-1] != new[1][0]):
                yield done([*held, tuple(c[:cut] for c in new)])
                held = []
            held.append(tuple(c[cut:] for c in new))
        if held:
            yield done(held)

    grouped = copies.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return grouped.mapInArrow(compare, "a long, b long")


def _rooted(classes: DataFrame, bits: int) -> DataFrame:
    """classes (one row a fingerprint fp, in a table) with root, the same for all fingerprints that links connect."""
    edges = stage_table(links(classes, bits=bits, blocks=blocks_for(classes.count())), "links")
    roots = connected_components(edges)
    return classes.join(roots, classes.fp == roots.node, "left").select(*classes.columns, F.coalesce("component", "fp").alias("root"))


def near_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Documents with one fingerprint are one class; classes are linked at
    `bits` or fewer differing bits by `links`, and component_id is the
    smallest doc_id that links reach. Defined cases: a null or empty text has
    fingerprint zero and is linked like any other; a null id is passed over
    when the smallest is taken (component_id is null only where all ids of the
    component are null); repeated rows stay; other columns are ignored; an
    empty table gives an empty result.
    """
    fps = stage_table(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    rooted = _rooted(classes, bits)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = stage_table(rooted.join(smallest, "root").select("fp", "component_id", "n"), "known")
    return spread_join(fps, known, ["fp"], "n", ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of docs for each component of near_dedup, with all its columns: that of smallest id.

    Defined cases: rows are told apart by their place, so a repeated id stands
    for as many rows; of rows that share the smallest id one stays; null ids
    come last; null and empty texts are one component, of which one row stays;
    an empty table gives an empty result; columns keep their names, whatever
    they are.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(text)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "__fp"])

    rows = stage_table(docs.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    fps = rows.select(F.col("__fp").alias("fp"), place.alias("at"))
    rooted = _rooted(stage_table(fps.groupBy("fp").agg(F.min("at").alias("at")), "classes"), bits)
    stay = rooted.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias("__stays"))
    return rows.join(stay, rows["__row"] == stay["__stays"], "left_semi").select(*[rows[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
