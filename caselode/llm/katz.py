"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, stage_table

#: Counts up to this are discounted.
K = 5
#: The end of a text, which also stands before its first word; no word can hold a line end.
END = b"\n"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def discounts(n_r: list[int]) -> np.ndarray:
    """Katz's discount ratios d[0..K+1] from the numbers of types seen 1, 2, ..., K+1 times.

    d[r] = (r*/r - x) / (1 - x) with r* = (r + 1) n[r+1] / n[r] and x = (K + 1) n[K+1] / n[1].
    Where that is not strictly between 0 and 1 (small corpora), half an
    occurrence is taken off instead. Larger counts have the ratio 1 here; see `kept`.
    """
    n = [0, *n_r]
    d = np.ones(K + 2)
    d[0] = 0
    x = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - x) / (1 - x) if n[r] and x < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def kept(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What is left of r occurrences of an n-gram of two words or more.

    Counts up to K keep d[r] r. Larger ones lose half an occurrence, so that a
    context whose followers are all frequent leaves something for other words
    too, and its backoff weight is finite.
    """
    return np.where(r > K, r - 0.5, d[np.minimum(r, K + 1)] * r)


class Grams:
    """The distinct n-grams of one length in a chunk, in the order of their hashes.

    of: the n-gram that ends at each token, -1 where the text has too few words
    before it. prefix and suffix: each n-gram's context (all but the last word) and
    end (all but the first), as places among the n-grams one shorter.
    """

    def __init__(self, keys: np.ndarray, of: np.ndarray, prefix: np.ndarray | None, suffix: np.ndarray | None, learn: np.ndarray):
        order = np.argsort(keys)
        place = np.empty(len(keys) + 1, np.int32)
        place[order], place[-1] = np.arange(len(keys)), -1
        self.keys, self.of = keys[order], place[of]
        self.prefix, self.suffix = (None, None) if prefix is None else (prefix[order], suffix[order])
        self.counts = np.bincount(self.of[learn & (self.of >= 0)], minlength=len(keys)).astype(np.uint32)
        #: whether the n-gram stands in a held-out text: only there can an n-gram be new, so only such contexts need a weight
        self.held = np.bincount(self.of[~learn & (self.of >= 0)], minlength=len(keys)) > 0


class Chunk:
    """The tokens of a chunk of documents, and its distinct n-grams of 1 to `order` words.

    Everything depends on the rows' texts alone, so two passes over the same
    rows, in whatever order, give the same lists of hashes.
    """

    def __init__(self, texts: list[bytes], held_out: np.ndarray, order: int):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        end = ids[END]
        parts, lengths = [np.array([end], np.int32)], []
        for t in texts:
            words = t.lower().split()  # lower() of bytes changes A-Z only
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            parts.append(parts[0])
            lengths.append(len(words) + 1)
        tokens = np.concatenate(parts)
        del parts
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        learn = ~held_out[self.doc]
        h = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in ids), np.uint64, len(ids))
        words = Grams(h, tokens[1:].astype(np.int64), None, None, learn)
        self.grams = [words]
        place = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        end = int(words.of[-1])  # every text has one
        for n in range(2, order + 1):
            short = self.grams[-1]
            # the context of a token: the n-gram one shorter that ends before it; the end token stands before a text
            before = np.concatenate(([end if n == 2 else -1], short.of[:-1])).astype(np.int64)
            has = np.flatnonzero((place >= n - 2) & (before >= 0))
            pairs, where = np.unique(before[has] * np.int64(len(h)) + words.of[has], return_inverse=True)
            first, last = pairs // len(h), pairs % len(h)
            suffix = np.empty(len(pairs), np.int64)
            suffix[where] = short.of[has]
            of = np.full(len(self.doc), -1, np.int64)
            of[has] = where
            keys = (short.keys[first] * _MIX[0] ^ (words.keys[last] >> _MIX[2])) * _MIX[1] ^ words.keys[last] * _MIX[0]
            keys &= ~np.uint64(0xFF)  # 56 bits: the last byte would be a sixth of what is moved
            self.grams.append(Grams(keys, of, first, suffix, learn))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which the shuffle's compression makes small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted keys with the same leading bits."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(buckets)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
        yield int(buckets[s]), s, e


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held_out) as chunks of about `most` bytes, one row each: ids, sizes, flags and compressed texts."""
    task, nth = TaskContext.get().partitionId(), 0

    def done(docs: list, texts: list[bytes], held: list[bool]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
        values = [(task << 32) + nth], [docs], [sizes], [np.array(held, bool).tobytes()], [zstandard.compress(b"".join(texts), 6)]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["chunk", "docs", "sizes", "held", "texts"])

    docs, texts, held, size = [], [], [], 0
    for b in batches:
        for doc, text, flag in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            if docs and size + len(text) > most:
                yield done(docs, texts, held)
                docs, texts, held, size, nth = [], [], [], 0, nth + 1
            docs.append(doc), texts.append(text), held.append(flag)
            size += len(text) + 8
    if docs:
        yield done(docs, texts, held)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 10, order: int = 2, chunk_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    A Katz model of n-grams of up to `order` words, learned from the documents
    whose crc32(doc_id) modulo held_mod is not 0. An n-gram seen r times whose
    context (its first n - 1 words) was seen c times has probability
    kept(r) / c: d[r] r / c with discounts d of its own length, or (r - 1/2) / c
    for r > K; other words get the weight
    that is left, times their probability after the context without its first
    word: p(w | h) = a(h) p(w | h'), and so on down to single words. a(h) is
    such that each context sums to one; a context never seen has a(h) = 1.
    Words seen r times have d[r] r / N, and what is left is the probability of
    one unknown word. The end of a text stands before its first word.

    Documents are dealt, as they are read, into chunks of about `chunk_bytes`,
    which are kept packed as one row each. A chunk sends the
    64-bit hashes of its distinct n-grams, with their counts, to the
    count tables, which are partitioned by the hashes' leading bits, packed so
    that a row holds a run of them; it gets back the totals in the same order,
    so a count is moved once for each chunk that holds it and not for
    each occurrence, and there are never more rows than counts. Backoff weights
    are sums over the n-grams of a context,
    each counted by the one chunk that the table names its owner, and go to
    the texts by a join on the context. Contexts that one chunk alone holds need no exchange.

    Defined cases: a null or empty text is its end token alone; a null id is
    hashed as empty text; repeated rows are learned and scored again; other
    columns are ignored; an empty table gives an empty result; without
    training rows every token is unknown and of probability one. Words have
    hashes of 64 bits, longer n-grams of 56: of 10**10 distinct ones about 700 pairs share one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("held_out", crc32_mod(F.col("doc_id"), held_mod) == 0)
    if order < 2:
        raise ValueError("order must be 2 or more")
    packed = stage_table(rows.mapInArrow(lambda b: _pack(b, chunk_bytes), "chunk long, docs array<long>, sizes binary, held binary, texts binary"), "chunks")
    bits = max(0, int(max(packed.count(), 1) - 1).bit_length())

    def read(row: dict) -> Chunk:
        sizes, raw = np.frombuffer(row["sizes"], np.int64), zstandard.decompress(row["texts"])
        ends = np.cumsum(sizes)
        texts = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        del raw
        return Chunk(texts, np.frombuffer(row["held"], bool), order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield messages({n: b.column(n)[i].as_py() for n in b.schema.names if n != "docs"})

    def messages(row: dict) -> pa.RecordBatch:
        chunk, number = read(row), row["chunk"]
        out: dict[str, list] = {k: [] for k in ("chunk", "order", "bucket", "keys", "counts")}
        for n, grams in enumerate(chunk.grams, 1):
            for bucket, s, e in _split(grams.keys, bits):
                own, flagged = grams.keys[s:e], grams.counts[s:e] << 1 | grams.held[s:e]
                for k, v in zip(out, (number, n, bucket, _planes(np.diff(own, prepend=np.uint64(0))), _planes(flagged.astype(np.uint32))), strict=True):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]]
        flagged = np.concatenate([_unplanes(x.as_py(), np.uint32) for x in table["counts"]])
        ends = np.cumsum([len(k) for k in keys])
        _, first, where, chunks = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
        totals = np.bincount(where, flagged >> 1, len(first)).astype(np.uint32)
        held = np.bincount(where, flagged & 1, len(first)) > 0
        owner = np.zeros(len(where), np.uint8)
        owner[first] = 1
        state = owner | (chunks[where] == 1).astype(np.uint8) << 1 | held[where].astype(np.uint8) << 2
        stats = [*np.bincount(totals[totals <= K + 1], minlength=K + 2)[1:].tolist(), int(totals.sum(dtype=np.int64)), int((totals > 0).sum())]
        spread = [x[s:e] for x in (totals[where], state) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        n = len(keys)
        return pa.table(
            {
                "chunk": table["chunk"],
                "order": table["order"],
                "bucket": table["bucket"],
                "totals": pa.array([_planes(x) for x in spread[:n]], pa.binary()),
                "state": pa.array([np.packbits(np.stack((x & 1, x >> 1 & 1, x >> 2))).tobytes() for x in spread[n:]], pa.binary()),
                "stats": pa.array([stats] + [None] * (n - 1), pa.list_(pa.int64())),
            }
        )

    sent = packed.mapInArrow(send, "chunk long, order int, bucket long, keys binary, counts binary")
    tables = sent.groupBy("order", "bucket").applyInArrow(
        add, "chunk long, order int, bucket long, totals binary, state binary, stats array<long>"
    )
    tables = stage_table(tables, "ngrams")
    sums = tables.where("stats is not null").groupBy("order").agg(*[F.sum(F.col("stats")[i]) for i in range(K + 3)])
    stats = {r[0]: r[1:] for r in sums.collect()}  # one row for each length
    d = [discounts(list(stats[o][: K + 1])) if o in stats else np.zeros(K + 2) for o in range(1, order + 1)]
    n_train, n_types = (stats[1][K + 1], stats[1][K + 2]) if 1 in stats else (0, 0)
    taken = sum((1 - d[0][r]) * r * stats[1][r - 1] for r in range(1, K + 1)) / n_train if n_train else 1.0
    scale, unknown = (1.0, taken) if taken > 0 else (n_train / (n_train + 1), 1 / (n_train + 1))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = read(row)
        got: list[list] = [[] for _ in range(order)]
        orders = right["order"].to_numpy()
        for i in np.lexsort((right["bucket"].to_numpy(), orders)):
            totals = _unplanes(right["totals"][i].as_py(), np.uint32)
            state = np.unpackbits(np.frombuffer(right["state"][i].as_py(), np.uint8))[: 3 * len(totals)].reshape(3, -1)
            got[orders[i] - 1].append((totals, state))
        total = [np.concatenate([t for t, _ in g] or [np.empty(0, np.uint32)]).astype(np.int64) for g in got]
        state = [np.concatenate([s for _, s in g] or [np.empty((3, 0), np.uint8)], axis=1) for g in got]
        if [len(t) for t in total] != [len(g.keys) for g in chunk.grams]:
            raise ValueError("the documents changed between two passes")
        # probability of each n-gram that was seen, and log10 of each n-gram's by the weights that are known here
        p = np.where(total[0] > 0, scale * d[0][np.minimum(total[0], K + 1)] * total[0] / max(n_train, 1), unknown)
        values, asked, giving = [np.log10(p)], [None], []
        for n in range(1, order):
            grams, context, short = chunk.grams[n], total[n - 1][chunk.grams[n].prefix], chunk.grams[n - 1]
            seen, size_ = total[n] > 0, len(short.keys)
            own, alone = seen & (state[n][0] == 1), state[n - 1][1] == 1
            stays = kept(total[n], d[n])
            longer = stays / np.maximum(context, 1)
            # what the followers of a context leave: a sum of what each loses, and never a difference from one
            freed = (total[n] - stays) / np.maximum(context, 1)
            free, low = (np.bincount(grams.prefix[own], x[own], size_) for x in (freed, p[grams.suffix]))
            here = alone & (total[n - 1] > 0) & (free > 0)
            weight = np.where(here, np.log10(np.where(here, free, 1)) - np.log10(np.where(here, 1 - low, 1)), 0.0)
            asked.append(~seen & ~alone[grams.prefix] & (context > 0))
            p = longer
            values.append(np.where(seen, np.log10(np.where(seen, longer, 1)), values[-1][grams.suffix] + weight[grams.prefix]))
            give = np.flatnonzero(~alone & (state[n - 1][2] == 1) & (np.bincount(grams.prefix[own], minlength=size_) > 0))
            giving.append((short.keys[give], free[give], low[give]))
        n_docs, known = len(chunk.lengths), total[0][chunk.grams[0].of]
        base = np.log10((known + 0.1) / (n_train + 0.1 * (n_types + 1)))
        # a token's score is that of the longest n-gram that ends there; where it was not seen, it holds weights of
        # contexts that several chunks share, and those of the shorter n-grams that follow
        score, todo, opened, done = np.zeros(len(chunk.doc)), [], [], np.zeros(len(chunk.doc), bool)
        following = np.empty(0, np.int64)
        for n in range(order - 1, 0, -1):
            grams = chunk.grams[n]
            longest = np.flatnonzero(~done & (grams.of >= 0))
            score[longest], done[longest] = values[n][grams.of[longest]], True
            todo = np.concatenate((following, longest))
            g = grams.of[todo]
            ask = asked[n][g]
            opened.append((chunk.doc[todo[ask]], chunk.grams[n - 1].keys[grams.prefix[g[ask]]]))
            following = todo[total[n][g] == 0]
        docs_of, contexts = (np.concatenate(x) for x in zip(*opened, strict=True))
        distinct, which = np.unique(contexts, return_inverse=True)
        pairs, times = np.unique(docs_of * np.int64(max(len(distinct), 1)) + which, return_counts=True)
        at, words = pairs // max(len(distinct), 1), distinct[pairs % max(len(distinct), 1)]
        give = [np.concatenate(x) for x in zip(*giving, strict=True)]
        sizes = (n_docs, len(at), len(give[0]))
        n_rows = sum(sizes)

        def column(kind: pa.DataType, *parts) -> pa.Array:
            """doc rows, open pairs and context sums below each other; None leaves a part null."""
            return pa.concat_arrays([pa.nulls(n, kind) if p is None else pa.array(p).cast(kind) for n, p in zip(sizes, parts, strict=True)])

        return pa.table(
            {
                "kind": pa.array(np.repeat(np.arange(3, dtype=np.int32), sizes)),
                "chunk": pa.array(np.full(n_rows, row["chunk"], np.int64)),
                "nth": column(pa.int64(), np.arange(n_docs), at, None),
                "doc_id": column(pa.int64(), pa.array(row["docs"], pa.int64()), None, None),
                "held_out": column(pa.bool_(), np.frombuffer(row["held"], bool), None, None),
                "n": column(pa.int64(), chunk.lengths, times, None),
                "n_known": column(pa.int64(), np.bincount(chunk.doc, known > 0, n_docs).astype(np.int64), None, None),
                "context": column(pa.int64(), None, words.view(np.int64), give[0].view(np.int64)),
                "x": column(pa.float64(), np.bincount(chunk.doc, base, n_docs), None, give[1]),
                "y": column(pa.float64(), np.bincount(chunk.doc, score, n_docs), None, give[2]),
            }
        )

    judged = packed.groupBy("chunk").cogroup(tables.drop("stats").groupBy("chunk")).applyInArrow(
        judge, "kind int, chunk long, nth long, doc_id long, held_out boolean, n long, n_known long, context long, x double, y double"
    )
    judged = stage_table(judged, "judged")
    backoff = judged.where("kind = 2").groupBy("context").agg(F.sum("x").alias("free"), F.sum("y").alias("low"))
    backoff = backoff.select("context", (F.log10("free") - F.log10(1 - F.col("low"))).alias("weight"))
    opened = judged.where("kind = 1").select("chunk", "nth", "context", "n").join(backoff, "context")
    opened = opened.groupBy("chunk", "nth").agg(F.sum(F.col("n") * F.col("weight")).alias("more"))
    return (
        judged.where("kind = 0")
        .join(opened, ["chunk", "nth"], "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            "n_known",
            F.lit(int(n_train)).cast("long").alias("train_tokens"),
            F.col("x").alias("base_score"),
            (F.col("y") + F.coalesce("more", F.lit(0.0))).alias("score"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=2, chunk_bytes=5 << 20)
