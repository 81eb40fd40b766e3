"""Phrase collocations by dynamic itemset counting over cyclic scans of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, planes, spread_join, stage_table, unplanes

#: What ends a piece: . , ; : ! ? and the line ends from \n to \r. Spaces and tabs part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(PIECE_ENDS)
)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT = np.uint64(30), np.uint64(27), np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _SHIFT[0]) * _MIX[0]
    x = (x ^ x >> _SHIFT[1]) * _MIX[1]
    return x ^ x >> _SHIFT[2]


class Activated:
    """When phrases reached the threshold: a Bloom filter whose cells hold the first step at which they count as reached.

    A key is in from the largest step of its cells on. Cells are set once and
    never change, so that step is the same in every later scan. A key that
    only seems to be in makes longer phrases be counted early, for a whole
    cycle, and so changes no result. The size is fixed, whatever the input.
    """

    NEVER = 255

    def __init__(self, cells: np.ndarray, hashes: int = 3):
        self.cells, self.hashes = cells, hashes

    def packed(self) -> bytes:
        return zstandard.compress(self.cells.tobytes(), 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> Activated:
        return cls(np.frombuffer(zstandard.decompress(raw), np.uint8))

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        mask, step = np.uint64(len(self.cells) - 1), keys >> np.uint64(32) | np.uint64(1)
        for i in range(self.hashes):
            yield (keys + np.uint64(i) * step & mask).astype(np.int64)

    def since(self, keys: np.ndarray) -> np.ndarray:
        """The step from which each key counts as reached, or NEVER."""
        out = np.zeros(len(keys), np.uint8)
        for at in self.places(keys):
            np.maximum(out, self.cells[at], out=out)
        return out


class Tokens:
    """The words of texts of one language: distinct words, their hashes, and for each place of a word its number, -1 where a piece ends."""

    def __init__(self, lang: str, words: pa.Array, hashes: np.ndarray, at: np.ndarray):
        self.lang, self.words, self.hashes, self.at = lang, words, hashes, at

    @classmethod
    def of(cls, texts: list[bytes], lang: str) -> Tokens:
        joined = b"\n".join(t.translate(_CLEAN) for t in texts).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([joined], pa.large_binary()).view(pa.large_utf8()), " ").flatten()
        coded = words.dictionary_encode()
        distinct = [w.encode() for w in coded.dictionary.to_pylist()]
        at, number = coded.indices.to_numpy(), {w: i for i, w in enumerate(distinct)}
        at = at[at != number.get(b"", -1)]
        at = np.where(at == number.get(b"\n", -1), -1, at)
        of_lang = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        hashes = _mixed(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct)) ^ of_lang)
        return cls(lang, coded.dictionary, hashes, at.astype(np.int64))

    def packed(self) -> tuple:
        """(lang, words, hashes, at, number of words) as bytes. No word holds a line end; the two entries that are none keep their places."""
        words = "\n".join(w if w != "\n" else "" for w in self.words.to_pylist())
        pack = lambda raw: zstandard.compress(raw, 1)
        return self.lang, pack(words.encode()), self.hashes.tobytes(), pack(planes(self.at.astype(np.int32))), int((self.at >= 0).sum())

    @classmethod
    def unpacked(cls, lang: str, words: bytes, hashes: bytes, at: bytes) -> Tokens:
        distinct = pa.array(zstandard.decompress(words).decode().split("\n"), pa.large_utf8())
        return cls(lang, distinct, np.frombuffer(hashes, np.uint64), unplanes(zstandard.decompress(at), np.int32).astype(np.int64))

    def phrases(self, places: np.ndarray, n: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.at[places + i])) for i in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", self.words.type))

    def counted(self, longest: int, step: int, shards: int, active: Activated) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, a place of each phrase, its key, its count, the step it began at) of the phrases whose cycle holds this step."""
        if not len(self.at):
            return
        inside = self.at >= 0
        places = np.flatnonzero(inside)
        code, keys = self.at[places], self.hashes[self.at[places]]
        if step < shards:
            times = np.bincount(code, minlength=len(self.words))
            found = np.flatnonzero(times)
            first = np.empty(len(self.words), np.int64)
            first[code[::-1]] = places[::-1]
            yield 1, first[found], self.hashes[found], times[found], np.zeros(len(found), np.uint8)
        since = active.since(self.hashes)[code]
        for n in range(2, longest + 1):
            # the phrases one shorter that begin at `places`; those that end a word later begin at the next place
            end = places + (n - 1)
            grows = np.flatnonzero((end < len(self.at)) & (since < Activated.NEVER))
            grows = grows[inside[end[grows]]]
            if not len(grows):
                return
            nth = np.full(len(self.at) + 1, -1, np.int64)
            nth[places] = np.arange(len(places))
            after = nth[places[grows] + 1]  # the phrase without its first word; -1: it was not looked at, as its own parts are rare
            grows, after = grows[after >= 0], after[after >= 0]
            start = np.maximum(since[grows], since[after])
            grows, after, start = (x[start < Activated.NEVER] for x in (grows, after, start))
            if not len(grows):
                return
            last = self.at[places[grows] + (n - 1)]
            if n > 2:
                code = np.unique(code, return_inverse=True)[1]
            code, keys = code[grows] * np.int64(len(self.words)) + last, _mixed(keys[grows] * _MIX[0] + self.hashes[last])
            places = places[grows]
            now = np.flatnonzero((start <= step) & (step < start + np.int64(shards)))
            if len(now):
                _, first, times = np.unique(code[now], return_index=True, return_counts=True)
                yield n, places[now[first]], keys[now[first]], times, start[now[first]]
            # a phrase whose mark is older than its own beginning seems to be marked only; longer ones begin no earlier than it
            since = np.maximum(active.since(keys), start) if n < longest else None


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about `most` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            if size and size + len(text) > most:
                yield from held.items()
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
    yield from held.items()


_CODED = "shard int, lang string, words binary, hashes binary, at binary, size long"


def _encode(rows: DataFrame, shards: int, block: int) -> DataFrame:
    """The texts (lang, text) as packed Tokens, one row for each block of about `block` bytes and language, dealt over the shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        names = ["shard", "lang", "words", "hashes", "at", "size"]
        for nth, (lang, texts) in enumerate(_texts(batches, block), TaskContext.get().partitionId()):
            values = (nth % shards, *Tokens.of(texts, lang).packed())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return rows.mapInArrow(run, _CODED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for b in batches:
        for row in zip(*(b.column(c) for c in ("lang", "words", "hashes", "at")), strict=True):
            yield Tokens.unpacked(*(x.as_py() for x in row))


#: Packed counts: the n-grams of n words whose keys fall into a bucket: sorted keys as differences, their counts, and the steps they began at.
_PACKED = "n int, bucket long, old boolean, keys binary, counts binary, begun binary"
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _added(parts: list[Counts]) -> Counts:
    """Distinct keys, sorted, the sums of their counts, and the last step that one of them began at."""
    keys, counts, begun = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, counts, begun
    return keys[first], np.add.reduceat(counts[order], first), np.maximum.reduceat(begun[order], first)


def _runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted keys in one bucket; buckets are ranges of keys."""
    of = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    cut = np.flatnonzero(np.diff(of)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
        yield int(of[s]), s, e


def _packed(n: int, found: Counts, buckets: int) -> Iterator[pa.RecordBatch]:
    keys, counts, begun = found
    rows = [(n, at, False, planes(np.diff(keys[s:e], prepend=np.uint64(0))), planes(counts[s:e]), begun[s:e].tobytes()) for at, s, e in _runs(keys, buckets)] if len(keys) else []
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    for i in range(0, len(rows), 256):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 256], strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["n", "bucket", "old", "keys", "counts", "begun"])


def _unpacked(keys: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(keys.as_py(), np.uint64), dtype=np.uint64), unplanes(counts.as_py(), np.int64)


def _scan(shard: DataFrame, longest: int, step: int, shards: int, sent, buckets: int, most: int = 1 << 20) -> DataFrame:
    """The packed counts of this step, added up in each task while they are at most about `most` keys a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, held = Activated.unpacked(sent.value), {n: [] for n in range(1, longest + 1)}
        for tokens in _blocks(batches):
            for n, _, keys, times, start in tokens.counted(longest, step, shards, active):
                held[n].append((keys, times.astype(np.int64), start.astype(np.uint8)))
                if sum(len(x[0]) for x in held[n]) > most:
                    held[n] = [_added(held[n])]
                    if len(held[n][0][0]) > most // 2:
                        yield from _packed(n, held[n].pop(), buckets)
            pa.default_memory_pool().release_unused()
        for n, parts in held.items():
            if parts:
                yield from _packed(n, _added(parts), buckets)

    return shard.mapInArrow(run, _PACKED)


def _merge(so_far: DataFrame, least: int, ended: int) -> DataFrame:
    """One row for each length and bucket, with the sums of all; `before`: the keys' counts before.

    Keys whose cycle has ended (they began at step `ended` or before) and that
    did not come to `least` are left out: nothing can be added to them.
    """

    def add(table: pa.Table) -> pa.Table:
        parts, before = [], []
        for keys, counts, begun, old in zip(table["keys"], table["counts"], table["begun"], table["old"].to_pylist(), strict=True):
            k, c = _unpacked(keys, counts)
            parts.append((k, c, np.frombuffer(begun.as_py(), np.uint8)))
            if old:
                before.append((k, c))
        keys, counts, begun = _added(parts)
        stays = (counts >= least) | (begun.astype(np.int64) > ended)
        was = np.zeros(len(keys), np.int64)
        for k, c in before:
            was[np.searchsorted(keys, k)] = c
        keys, counts, begun, was = (x[stays] for x in (keys, counts, begun, was))
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        row = table["n"][0].as_py(), table["bucket"][0].as_py(), True, planes(np.diff(keys, prepend=np.uint64(0))), planes(counts), begun.tobytes(), planes(was)
        return pa.table({c: pa.array([v], k) for c, v, k in zip(("n", "bucket", "old", "keys", "counts", "begun", "before"), row, kinds, strict=True)})

    return so_far.groupBy("n", "bucket").applyInArrow(add, _PACKED + ", before binary")


_GROUP = 1 << 16


def _reached(least: int, fresh: bool):
    """Makes the keys of a batch of packed sums that have come to `least`; fresh: those that had not before."""

    def keys_of(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for raw, new, old in zip(*(b.column(c) for c in ("keys", "counts", "before")), strict=True):
            keys, counts = _unpacked(raw, new)
            yield keys[(counts >= least) & (unplanes(old.as_py(), np.int64) < least) if fresh else counts >= least]

    return keys_of


def _listed(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)


def _set_cells(rows: DataFrame, cells: np.ndarray, keys_of, start: int) -> bool:
    """Set the cells, not set yet, of the keys that keys_of takes from batches of rows; whether there were any.

    Each task sends bitmaps of the groups of 65,536 cells that it touches, and
    the driver gets one bitmap a group: at most len(cells) / 8 bytes.
    """
    n = len(cells)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, bits = Activated(np.empty(n, np.uint8)), np.zeros(n, bool)
        for b in batches:
            for keys in keys_of(b):
                for at in shape.places(keys):
                    bits[at] = True
        for part in range(-(-n // _GROUP)):
            own = bits[part * _GROUP : (part + 1) * _GROUP]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["part", "bits"])

    def either(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table["bits"]])
        return pa.table({"part": table["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    found = rows.mapInArrow(places, "part long, bits binary").groupBy("part").applyInArrow(either, "part long, bits binary")
    new = False
    for r in found.collect():  # at most one row for each 65,536 cells
        own = cells[r["part"] * _GROUP : (r["part"] + 1) * _GROUP]
        fresh = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: len(own)].astype(bool) & (own == Activated.NEVER)
        new |= bool(fresh.any())
        own[fresh] = start
    return new


_NAMED = "lang string, n int, phrase string, key long, c long"


def _named(blocks: DataFrame, longest: int, sent, wanted, most: int = 1 << 19) -> DataFrame:
    """(lang, n, phrase, key, c) of the phrases whose keys are wanted, found through those that are marked; added up in each task while they are at most about `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, asked, held, size = Activated.unpacked(sent.value), Activated.unpacked(wanted.value), [], 0
        by = ["lang", "n", "phrase", "key"]

        def added() -> pa.Table:
            table = pa.concat_tables(held).group_by(by, use_threads=False).aggregate([("c", "sum")])
            return table.rename_columns([*by, "c"])

        for tokens in _blocks(batches):
            for n, places, keys, times, _ in tokens.counted(longest, 0, Activated.NEVER - 1, marked):
                keep = np.flatnonzero(asked.since(keys) < Activated.NEVER)
                phrases, n_rows = tokens.phrases(places[keep], n).cast(pa.string()), len(keep)
                held.append(
                    pa.table(
                        {
                            "lang": pa.array([tokens.lang] * n_rows, pa.string()),
                            "n": pa.array(np.full(n_rows, n, np.int32)),
                            "phrase": phrases,
                            "key": pa.array(keys[keep].view(np.int64)),
                            "c": pa.array(times[keep].astype(np.int64)),
                        }
                    )
                )
                size += n_rows
            if size > most:
                held = [added()]
                size = held[0].num_rows
                if size > most // 2:
                    yield from held.pop().to_batches(1 << 16)
                    size = 0
            pa.default_memory_pool().release_unused()
        if held:
            yield from added().to_batches(1 << 16)

    return blocks.mapInArrow(run, _NAMED)


def frequent_phrases(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, shards: int = 4, cells: int = 1 << 25, block: int = 3 << 20
) -> tuple[DataFrame, DataFrame]:
    """((lang, n, phrase, f) of all phrases of 1 to `longest` words that occur `least` times, (lang, words) with all occurrences of words).

    Dynamic itemset counting. The texts are dealt over `shards` shards, which
    are scanned in turn, again and again. Single words are counted from the
    first step. After each step, phrases whose count so far reaches `least`
    are marked, and a longer phrase is counted from the next step on once both
    its subphrases (without the last, without the first word) are marked; it
    is counted for one full cycle, from whatever shard it began with, so its
    count is exact. So pairs are counted while words still are, and triples
    while pairs are; the scans end when the last phrase has seen its cycle.

    Texts are cut into words once and kept as numbers of words, in blocks.
    Counts are kept by 64-bit key, packed: a task sends, for each bucket of
    keys, one row of sorted keys and their counts, and the sums so far are one
    row a bucket; buckets grow with the texts, so a row has a bounded number
    of keys, and keys whose cycle ended below the threshold are dropped. Marks travel as a Bloom filter of `cells` bytes, which holds the
    step of each mark. When all are counted, the words of
    the frequent keys are looked for, shard by shard until each has its words.
    A key that two phrases of those shards share shows there, and one more
    scan counts both by their words; of 10**10 distinct phrases about three
    pairs share a key.
    """
    if longest < 2 or shards < 1 or shards * longest > 250:
        raise ValueError("longest must be 2 or more, and shards * longest at most 250")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = stage_table(_encode(rows, shards, block), "shards", by="shard")
    n_words = dealt.agg(F.sum("size")).first()[0] or 0
    buckets = max(12, -(-n_words // 3_000_000))  # a length has at most as many phrases as there are words
    marks = np.full(cells, Activated.NEVER, np.uint8)
    step, begun = 0, 0  # begun: the last step at which phrases can have begun to be counted, as marks were set before it
    so_far = None
    while step < begun + shards:
        sent = spark.sparkContext.broadcast(Activated(marks).packed())
        counted = _scan(dealt.where(F.col("shard") == step % shards).drop("shard", "size"), longest, step, shards, sent, buckets)
        last = so_far
        so_far = stage_table(_merge(counted if last is None else counted.unionByName(last.drop("before")), least, step - shards + 1), "counts")
        sent.destroy()
        if last is not None:
            drop_table(last)
        if _set_cells(so_far.where(F.col("n") < longest).select("keys", "counts", "before"), marks, _reached(least, True), step + 1):
            begun = step + 1
        step += 1
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, raw, new in zip(*(b.column(c) for c in ("n", "keys", "counts")), strict=True):
                keys, counts = _unpacked(raw, new)
                at = np.flatnonzero(counts >= least)
                for i in range(0, len(at), 1 << 16):
                    k, c = (x[at[i : i + (1 << 16)]] for x in (keys, counts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n.as_py(), np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["n", "key", "f"])

    counts = stage_table(so_far.select("n", "keys", "counts").mapInArrow(frequent, "n int, key long, f long"), "frequent")
    found = np.full(cells, Activated.NEVER, np.uint8)
    _set_cells(counts.select("key"), found, _listed, 0)
    sent = spark.sparkContext.broadcast(Activated(found).packed())

    def names(blocks: DataFrame, wanted: np.ndarray) -> DataFrame:
        asked = spark.sparkContext.broadcast(Activated(wanted).packed())
        made = _named(blocks.select("lang", "words", "hashes", "at"), longest, sent, asked)
        made = stage_table(made.groupBy("lang", "n", "phrase", "key").agg(F.sum("c").alias("c")), "named")
        asked.destroy()
        return made

    # Most phrases are found in the first shard; the next ones are asked only for what is still without words.
    parts, rest = [], found
    for shard in range(shards):
        parts.append(names(dealt.where(F.col("shard") == shard), rest))
        rest = np.full(cells, Activated.NEVER, np.uint8)
        known = parts[0]
        for more in parts[1:]:
            known = known.unionByName(more)
        if not _set_cells(counts.join(known.select("n", "key"), ["n", "key"], "left_anti").select("key"), rest, _listed, 0):
            break
    known = known.join(counts.select("n", "key"), ["n", "key"], "left_semi").groupBy("lang", "n", "phrase", "key").agg(F.sum("c").alias("c"))
    known = stage_table(known.withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("n", "key"))), "known")
    single = known.where("sharing = 1").join(counts, ["n", "key"]).select("lang", "n", "phrase", "f")
    shared = known.where("sharing > 1").select("n", "key").distinct()
    rest = np.full(cells, Activated.NEVER, np.uint8)
    if _set_cells(shared.select("key"), rest, _listed, 0):
        again = names(dealt, rest).join(shared, ["n", "key"], "left_semi")
        single = single.unionByName(again.select("lang", "n", "phrase", F.col("c").alias("f")))
    totals = stage_table(single.where(F.col("f") >= least), "phrases")
    sent.destroy()
    words = stage_table(dealt.groupBy("lang").agg(F.sum("size").alias("words")), "words")
    for table in (dealt, so_far, counts, known, *parts):
        drop_table(table)
    return totals, words


def _sub(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 10,
    longest: int = 3,
    top: int = 2000,
    absorbed: int = 50,
    shards: int = 4,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` collocations of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends,
    and pieces into words at spaces and tabs. Candidates are phrases of 2 to
    `longest` words that occur a >= `least` times inside pieces
    (frequent_phrases counts them). A cut after the first k words gives
    l = f(first part), r = f(rest) and floor(1000000 a a / (l r)); the smallest
    of a candidate's cuts is its score, of equals the one of smallest k.
    Candidates inside a longer one that occurs in at least `absorbed` percent
    of their occurrences are dropped, whether or not that one is dropped too.

    Arithmetic is on decimals of 38 digits: exact while f is below 10**15.

    Defined cases: a null language is und, a null or empty text has no words;
    repeated rows count again; languages without candidates have no rows;
    ties go to the larger a, then to the phrase that is first in bytes; other
    columns are ignored; an empty table gives an empty result.
    """
    totals, words = frequent_phrases(docs, lang_col=lang_col, text_col=text_col, least=least, longest=longest, shards=shards)
    split = F.split("phrase", " ")
    candidates = totals.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("n").alias("size"), split.alias("w"))
    # Each cut's two parts, looked up by language and phrase.
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "size", "w", k)
    sides = F.explode(
        F.array(
            F.struct(F.lit(True).alias("left"), _sub(F.col("w"), F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("left"), _sub(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
        )
    ).alias("side")
    asked = cuts.select("lang", "phrase", "a", "k", sides).select("lang", "phrase", "a", "k", "side.*")
    uses = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    known = stage_table(uses.join(totals.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "parts")
    got = spread_join(asked, known, ["lang", "part"], "uses", ["phrase"])
    cut = got.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    square = (exact("a", 15) * exact("a", 15)).cast("decimal(30,0)")
    cut = cut.withColumns({"over": (square * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), "under": (exact("l", 15) * exact("r", 15)).cast("decimal(38,0)")})
    cut = cut.withColumn("score", F.expr("over div under"))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # The most frequent longer candidate around each candidate.
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _sub(F.col("w"), i, n)))))
    around = candidates.where("size > 2").select("lang", spans.alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed)
    kept = scored.join(around, ["lang", "phrase"], "left").where(stays).drop("longer")
    # The best of many parts of a language, then of the language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, n, phrase, count(*) AS f
  FROM (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase, len(w) AS size, i
        FROM places, (VALUES (1), (2), (3)) AS lengths(n) WHERE i + n - 1 <= len(w))
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, n AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, (VALUES (1), (2)) AS ks(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  WHERE k < c.size),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a OR s.size = 3)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INT) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""
