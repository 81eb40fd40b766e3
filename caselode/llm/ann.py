"""Maximum inner product search by score-aware (anisotropic) quantisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

# ----------------------------------------------------------------------- codebooks


def _parts(x: np.ndarray, width: int) -> np.ndarray:
    """Vectors cut into sub-vectors of `width` numbers, padded with zeros."""
    n, d = x.shape
    pad = -d % width
    return np.pad(x, ((0, 0), (0, pad))).reshape(n, -1, width)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of least anisotropic loss: |r|^2 + (eta - 1) (r . x / |x|)^2 for the residual r.

    Starts from the nearest code word in each part, then goes over the parts
    and lets each choose again, given the parallel error of all the others.
    """
    parts = _parts(x, books.shape[2])
    norm = np.linalg.norm(x, axis=1)
    codes = np.empty(parts.shape[:2], np.int64)
    square, along = [], []
    for m in range(parts.shape[1]):
        r = parts[:, m, None, :] - books[m][None]
        square.append((r * r).sum(axis=2))
        along.append((r * parts[:, m, None, :]).sum(axis=2) / norm[:, None])
        codes[:, m] = square[m].argmin(axis=1)
    rows = np.arange(len(x))
    total = sum(a[rows, codes[:, m]] for m, a in enumerate(along))
    for _ in range(sweeps):
        for m in range(parts.shape[1]):
            rest = total - along[m][rows, codes[:, m]]
            codes[:, m] = (square[m] + (eta - 1) * (rest[:, None] + along[m]) ** 2).argmin(axis=1)
            total = rest + along[m][rows, codes[:, m]]
    return codes


def fit_codebooks(x: np.ndarray, *, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 0) -> tuple[np.ndarray, float]:
    """(code words [parts, 16, width], eta).

    eta weighs the residual's parallel part against each orthogonal direction,
    for inner products above `threshold` times the norms. Assignment and a
    least-squares update of all code words together take turns.
    """
    d = x.shape[1]
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = _parts(x, width)
    n, m, _ = parts.shape
    books = np.stack([parts[rng.integers(0, n, 16), i] for i in range(m)])
    for _ in range(6):  # plain k-means in each part to start from
        for i in range(m):
            near = ((parts[:, i, None] - books[i][None]) ** 2).sum(axis=2).argmin(axis=1)
            count = np.bincount(near, minlength=16)
            for w in range(width):
                mean = np.bincount(near, parts[:, i, w], 16) / np.maximum(count, 1)
                books[i, :, w] = np.where(count > 0, mean, parts[rng.integers(0, n, 16), i, w])
    norm = np.linalg.norm(x, axis=1)
    size = m * 16 * width
    for _ in range(rounds):
        codes = encode(x, books, eta)
        at = ((np.arange(m) * 16 + codes)[:, :, None] * width + np.arange(width)).reshape(n, -1)
        flat = parts.reshape(n, -1)
        v = np.zeros((n, size))
        np.put_along_axis(v, at, flat / norm[:, None], axis=1)
        left = (eta - 1) * (v.T @ v)
        left[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-6
        right = np.bincount(at.ravel(), flat.ravel(), size) + (eta - 1) * (v.T @ norm) + 1e-6 * books.ravel()
        books = np.linalg.solve(left, right).reshape(m, 16, width)
    return books, eta


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; an odd last part is paired with code 0."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def pair_tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of a query's parts with the code words, added up for both halves of a packed byte."""
    table = (_parts(query[None], books.shape[2])[0][:, None, :] * books).sum(axis=2)
    if len(table) % 2:
        table = np.vstack((table, np.zeros(16)))
    return (table[1::2, :, None] + table[::2, None, :]).reshape(len(table) // 2, 256)


# -------------------------------------------------------------------------- search

#: Levels of norm that the vectors of one length are dealt into.
LEVELS = 16


def _coded(x: np.ndarray, books: np.ndarray, eta: float) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, and a radius: |query| times it bounds the error of a table scan, its rounding included."""
    codes = encode(x, books, eta)
    near = books[np.arange(len(books)), codes].reshape(len(x), -1)[:, : x.shape[1]]
    rounding = 2.4e-7 * (len(books) + 4) * np.linalg.norm(near, axis=1)
    return pack_codes(codes), np.linalg.norm(x - near, axis=1) * (1 + 1e-6) + rounding


def best_of(
    query: np.ndarray, reps: np.ndarray, vecs: np.ndarray, packed: np.ndarray, radius: np.ndarray, books: np.ndarray, k: int, candidates: int, least: float = -np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """(places, inner products) of the k vectors of largest inner product, best first; of equals the smaller rep. Those under `least` may be left out."""
    tables = pair_tables(query, books)
    scale = np.abs(tables).max(initial=0.0) or 1.0  # single precision from here on, whatever the size of the numbers
    approximate = np.zeros(len(reps), np.float32)
    for table, column in zip((tables / scale).astype(np.float32), packed, strict=True):
        approximate += table[column]
    bound = np.linalg.norm(query) * radius + len(tables) * 3e-45 * scale
    first = min(max(candidates, k), len(reps))
    floor = least
    if first < len(reps):
        likely = np.argpartition(-approximate, first - 1)[:first]
        floor = max(floor, np.partition((vecs[likely] * query).sum(axis=1), first - k)[first - k])
    left = np.flatnonzero(~(approximate * scale + bound < floor))
    score = (vecs[left] * query).sum(axis=1)
    best = np.lexsort((reps[left], -score))[:k]
    return left[best], score[best]


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, vec, norm, times) of the rows that take part: id not null, all components finite, not all zero.

    vec holds the components as doubles; key is a 128-bit hash of them, equal
    for equal vectors (-0.0 counts as 0.0). times is the number of rows that
    repeat id and vector.
    """
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = found.where("vec_id is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    found = found.where(F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 for v in b.column(1)]
            vecs = [v.tobytes() for v in x]
            keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(list(map(_norm, x)), pa.float64())], ["vec_id", "key", "vec", "norm"])

    made = found.mapInArrow(run, "vec_id long, key binary, vec binary, norm double")
    return made.groupBy("vec_id", "key").agg(F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.count(F.lit(1)).alias("times"))


def _norm(x: np.ndarray) -> float:
    """The norm, also of numbers whose squares are too large or too small; rounded up."""
    most = np.abs(x).max()
    return float(most * np.linalg.norm(x / most) * (1 + 1e-12))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), np.float64) for v in column])


def search(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries=lambda vec_id: vec_id % 20 == 0,
    k: int = 20,
    candidates: int = 150,
    sample: int = 8192,
    row_block: int | None = None,
    query_block: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row.

    Equal vectors are one class, searched once. Code words are fitted on at
    most `sample` classes (those of smallest hash); every class is encoded and
    scanned. About `row_block` classes make a block, which goes to one task
    with its codes, residual norms and vectors, followed by all queries.

    The result is exact. In each block, a scan by four-bit tables finds the
    `candidates` classes of best approximate score; the k-th of their inner
    products in double precision is a floor, and every class whose approximate
    score plus |query| |residual| reaches it is scored exactly too. So
    `candidates` moves work only, at any number of rows.

    Blocks hold vectors of one length (inner products of others are not
    defined) and of similar norms, the largest first. All queries meet the
    blocks of largest norms; after that a query goes only to blocks whose
    largest norm, times its own, can reach the worst of its results so far,
    which is also its first floor there. Where all norms are equal no block
    can be left out, and comparisons are queries times classes.

    Defined cases: vectors that are null, empty, zero, or hold null or
    non-finite components, and rows of null id take no part; a vector meets
    those of its own length; rows that repeat id and vector are rows like any
    other (each is a query, and a candidate of its copies); ties go to the
    smaller vec_id; a query with fewer than k candidates gets all; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    vectors = stage_table(_vectors(rows, id_col, vector_col), "vectors")
    first = F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.first(F.length("vec")).alias("bytes")
    classes = stage_table(vectors.groupBy("key").agg(F.min("vec_id").alias("rep"), *first), "vector-classes")
    shape = classes.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("norm", [i / LEVELS for i in range(1, LEVELS)], 1000).alias("cuts"))
    shapes = {r["bytes"]: (r["n"], sorted(set(r["cuts"]), reverse=True)) for r in shape.collect()}  # one row for each length of vectors
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def learn(table: pa.Table) -> pa.Table:
        books, eta = fit_codebooks(_matrix(table["vec"]))
        return pa.table({"bytes": table["bytes"][:1], "books": [books.tobytes()], "parts": [books.shape[0]], "width": [books.shape[2]], "eta": [eta]})

    nth = F.row_number().over(Window.partitionBy("bytes").orderBy(F.xxhash64("key"), "key"))
    chosen = classes.select("bytes", "key", "vec").withColumn("nth", nth).where(F.col("nth") <= sample).select("bytes", "vec")
    got = chosen.groupBy("bytes").applyInArrow(learn, "bytes int, books binary, parts long, width long, eta double").collect()
    books = {r["bytes"]: (np.frombuffer(r["books"]).reshape(r["parts"], 16, r["width"]), r["eta"]) for r in got}

    def code(table: pa.Table) -> pa.Table:
        order = np.argsort(table["rep"].to_numpy())
        x = _matrix(table["vec"])[order]
        packed, radius = zip(*(_coded(x[i : i + 2048], *books[table["bytes"][0].as_py()]) for i in range(0, len(x), 2048)), strict=True)
        single = x.astype(np.float32)
        found = {
            "reps": table["rep"].to_numpy()[order].astype(np.int64).tobytes(),
            "keys": b"".join(np.array(table["key"].to_pylist(), object)[order]),
            "codes": np.concatenate(packed).T.tobytes(),
            "radius": np.concatenate(radius).tobytes(),
            "vecs": (single if (single == x).all() else x).tobytes(),
        }
        return pa.table({"block": table["block"][:1], "bytes": table["bytes"][:1], **{k: pa.array([v], pa.binary()) for k, v in found.items()}})

    # Norm levels of each length, and blocks of about row_block classes in each level; the tables have one row a level.
    cuts = spark.createDataFrame([(b, c) for b, (_, c) in shapes.items()], "bytes int, cuts array<double>")
    level = F.size(F.filter("cuts", lambda c: c > F.col("norm")))
    levelled = classes.join(F.broadcast(cuts), "bytes").withColumn("level", level).drop("cuts")
    counts = levelled.groupBy("bytes", "level").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()
    table, at = [], 0
    for r in sorted(counts, key=lambda r: (r["bytes"], r["level"])):
        most = row_block or max(1, (128 << 20) // r["bytes"])
        parts = max(1, -(-r["n"] // most), min(12, r["n"] // 4096))
        table.append((r["bytes"], r["level"], at, parts, r["most"]))
        at += parts
    levels = spark.createDataFrame(table, "bytes int, level int, base int, parts int, most double")
    block = (F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int")
    placed = levelled.join(F.broadcast(levels), ["bytes", "level"]).withColumn("block", block)
    packed = "block int, bytes int, reps binary, keys binary, codes binary, radius binary, vecs binary"
    codes = stage_table(placed.select("block", "bytes", "rep", "key", "vec").groupBy("block").applyInArrow(code, packed), "vector-codes")

    asked = vectors.where(queries(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey"), F.col("vec").alias("qvec"), F.col("norm").alias("qnorm"), F.col("times").alias("asked"))
    asked = stage_table(asked, "queries")
    asking = asked.groupBy("qkey").agg(F.first("qvec").alias("qvec"), F.first("qnorm").alias("qnorm"), F.first(F.length("qvec")).alias("bytes"))
    n_blocks, kinds = at, (pa.binary(), pa.binary(), pa.int64(), pa.float64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, None
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("qkey", "key", "rep", "score")}
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                if r["qkey"] is None:
                    number, reps, width = r["block"], np.frombuffer(r["reps"], np.int64), r["bytes"] // 8
                    vecs = np.frombuffer(r["vecs"], np.float32 if len(r["vecs"]) == len(reps) * width * 4 else np.float64)
                    held = (vecs.reshape(len(reps), width), np.frombuffer(r["codes"], np.uint8).reshape(-1, len(reps)), np.frombuffer(r["radius"], np.float64))
                    keys, book = r["keys"], books[r["bytes"]][0]
                elif number == r["block"]:
                    best, score = best_of(np.frombuffer(r["qvec"]), reps, *held, book, k + 1, candidates, -np.inf if r["floor"] is None else r["floor"])
                    out["qkey"] += [r["qkey"]] * len(best)
                    out["key"] += [keys[16 * j : 16 * j + 16] for j in best.tolist()]
                    out["rep"] += reps[best].tolist()
                    out["score"] += score.tolist()
                    if i % query_block == 0:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))
                        out = {n: [] for n in out}
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    by_query = Window.partitionBy("qkey")
    best_first = by_query.orderBy(F.desc("score"), "rep")
    top_classes = lambda df: df.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k + 1).drop("n")

    def scanned(queries_: DataFrame) -> DataFrame:
        """The best classes of each query (with block and floor) in each block that it goes to."""
        meet = codes.unionByName(queries_, allowMissingColumns=True).repartition(n_blocks, "block")
        meet = meet.sortWithinPartitions("block", F.col("qkey").isNotNull())  # a block, then its queries
        return meet.mapInArrow(scan, "qkey binary, key binary, rep long, score double")

    top_level = F.broadcast(levels.where("level = 0"))
    to = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    start = asking.join(top_level, "bytes").select("qkey", "qvec", to.alias("nth"), "base", F.lit(None).cast("double").alias("floor"))
    start = start.select("qkey", "qvec", "floor", (F.col("base") + F.col("nth")).cast("int").alias("block"))
    scored = stage_table(top_classes(scanned(start)), "scored")
    if any(r[1] for r in table):
        floor = scored.groupBy("qkey").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
        below = [(b, [(lev, base, parts, most) for b2, lev, base, parts, most in table if b2 == b and lev]) for b in shapes]
        below = spark.createDataFrame(below, "bytes int, below array<struct<level:int,base:int,parts:int,most:double>>")
        reach = F.filter("below", lambda x: F.col("floor").isNull() | (x["most"] * F.col("qnorm") * (1 + 1e-9) >= F.col("floor")))
        blocks = F.flatten(F.transform(reach, lambda x: F.sequence(x["base"], x["base"] + x["parts"] - 1)))
        more = asking.join(floor, "qkey", "left").join(F.broadcast(below), "bytes").select("qkey", "qvec", "floor", F.explode(blocks).alias("block"))
        scored = top_classes(scored.unionByName(scanned(more)))
    # Of each class the first rows by id, as many as a result can hold, copies one by one.
    each = vectors.select("key", "vec_id", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k + 1)).cast("int"))).alias("copy"))
    members = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id", "copy"))).where(F.col("n") <= k + 1)
    top = scored.select("qkey", "key", "score").join(members.select("key", "vec_id", "copy"), "key")
    # k + 1 and not k, as one of them may be the query itself: the first row of its id and vector
    top = top.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id", "copy"))).where(F.col("n") <= k + 1)
    own = (F.col("query_id") == F.col("vec_id")) & (F.col("qkey") == F.col("key")) & (F.col("copy") == 1)
    per_query = asked.select("query_id", "qkey", "asked").join(top.select("qkey", "key", "vec_id", "copy", "score"), "qkey").where(~own)
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id", "copy"))
    ranked = per_query.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int")))).drop("col")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
