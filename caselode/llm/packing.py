"""Best-fit packing of tokenised documents by bin completion."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

# ------------------------------------------------------------------ bin completion


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: [(lengths in a bin, number of such bins)].

    The largest length opens a bin, which takes the largest that still fits
    until none does; the bin is repeated as often as the counts allow.
    """
    left, plan = dict(counts), []
    while left:
        room, items, used = capacity, [], {}
        for size in sorted(left, reverse=True):
            n = min(left[size], room // size)
            if n:
                items += [size] * n
                used[size] = n
                room -= n * size
        times = min(left[s] // n for s, n in used.items())
        plan.append((tuple(items), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return plan


class Effort:
    """What is left of the work that a search may do, in steps."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        """Take steps off; False once nothing is left."""
        self.left -= steps
        return self.left > 0


class Fillings:
    """The fillings of a room by lengths of a histogram, by subset sums.

    reach[i] has bit t set if the i smallest lengths, each at most as often as
    it is there, can add up to t; so a search for a total never runs into a
    dead end.
    """

    def __init__(self, counts: dict[int, int], room: int, effort: Effort | None = None):
        self.counts, self.room, self.effort = counts, room, effort or Effort(1 << 62)
        self.sizes = sorted(s for s, n in counts.items() if n and s <= room)
        mask, sums, self.reach = (1 << (room + 1)) - 1, 1, [1]
        for s in self.sizes:
            n, take = min(counts[s], room // s), 1
            while n:  # n copies as runs of 1, 2, 4, ... and the rest
                take = min(take, n)
                sums |= sums << (take * s) & mask
                n -= take
                take *= 2
            self.reach.append(sums)

    def totals(self, least: int) -> Iterator[int]:
        """All totals that can be reached and are at least `least`, largest first."""
        left = self.reach[-1]
        while left and (t := left.bit_length() - 1) >= least:
            yield t
            left ^= 1 << t

    def of(self, total: int, every: bool = True) -> Iterator[tuple[int, ...]]:
        """All fillings of exactly this total, those with larger lengths first, until the effort is spent.

        every=False leaves out a part of a filling, with all that it leads to,
        as soon as a larger length that is left over could stand for one of
        its items; so it leaves out dominated fillings only.
        """
        slack = self.room - total
        stack: list[tuple[tuple[int, ...], int, int]] = [((), total, len(self.sizes))]
        while stack and self.effort.spend():
            items, rest, i = stack.pop()
            if not rest:
                yield items
                continue
            # the largest length of the rest that takes part, and how often: least good choices first on the stack
            choices = []
            for k in range(min(i, bisect_right(self.sizes, rest)), 0, -1):
                if not self.reach[k] >> rest & 1:
                    break
                s = self.sizes[k - 1]
                if not every and slack and self._replaced(s, items, k, slack):
                    continue
                for n in range(min(self.counts[s], rest // s), 0, -1):
                    if self.reach[k - 1] >> (rest - n * s) & 1:
                        choices.append((items + (s,) * n, rest - n * s, k - 1))
                if len(choices) >= 64:  # the others wait below on the stack
                    choices.append((items, rest, k - 1))
                    break
            stack += reversed(choices)

    def _replaced(self, s: int, items: tuple[int, ...], k: int, slack: int) -> bool:
        """Whether a length over s, by no more than the slack, is left over; lengths from place k on are decided."""
        for x in self.sizes[k : bisect_right(self.sizes, s + slack)]:
            if items.count(x) < self.counts[x]:
                return True
        return False

    def dominated(self, items: tuple[int, ...]) -> bool:
        """Whether a length that is left over has room still, or could stand for some of the items and fill the room at least as well.

        Then those items fit in the places that are left elsewhere, and the
        filling with the larger length is never worse.
        """
        slack, used = self.room - sum(items), Counter(items)
        one, more = 0, 0  # sums of one item, of several
        for s in items:
            more |= (more | one) << s
            one |= 1 << s
        for x in self.sizes:
            if used[x] < self.counts[x]:
                low = max(0, x - slack)
                if x <= slack or more >> low & ((1 << (x - low + 1)) - 1) or (x > low and one >> low & ((1 << (x - low)) - 1)):
                    return True
        return False

    def undominated(self, least: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of at least this total, least waste first, until the effort is spent."""
        for total in self.totals(least):
            for items in self.of(total, every=False):
                if not self.effort.spend(1 + len(self.sizes) // 64):
                    return
                if not self.dominated(items):
                    yield items


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the total, or the large items plus what their waste can't hold."""
    size = np.array(sorted(s for s, n in counts.items() if n), np.int64)
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    number, volume = (np.concatenate(([0], np.cumsum(x))) for x in (n, size * n))
    half = int(np.searchsorted(size, capacity // 2, "right"))
    k = np.concatenate(([0], size[:half]))  # items below k are left out
    over = np.searchsorted(size, capacity - k, "right")  # items from here on share a bin with none of at least k
    small = volume[half] - volume[np.searchsorted(size, k, "left")]
    free = (number[over] - number[half]) * capacity - (volume[over] - volume[half])
    needed = number[-1] - number[half] + np.maximum(0, -((free - small) // capacity))
    return int(max(-(-volume[-1] // capacity), needed.max()))


def _take(left: dict[int, int], need: dict[int, int], times: int) -> dict[int, int]:
    out = dict(left)
    for s, n in need.items():
        out[s] -= n * times
        if not out[s]:
            del out[s]
    return out


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan that fills each bin around the largest length left as full as can be, with the largest lengths that do."""
    left, plan = dict(counts), []
    while left:
        top = max(left)
        fill = Fillings(_take(left, {top: 1}, 1), capacity - top)
        items = (top, *next(fill.of(next(fill.totals(0)))))
        need = Counter(items)
        plan.append((items, min(left[s] // n for s, n in need.items())))
        left = _take(left, need, plan[-1][1])
    return plan


#: Steps that a node of the search counts as: about the time of its lower bound and its table of sums.
NODE = 16


def complete_bins(counts: dict[int, int], capacity: int, effort: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion by branch and bound: [(lengths in a bin, number of such bins)].

    Each level takes the largest length left and branches over its undominated
    completions, least waste first, and over how many bins get it: as many as
    the counts allow, then fewer. So the depth is bounded by the number of
    distinct lengths, not by that of documents. A branch ends when the waste
    so far is more than the bins below the incumbent allow, or when the lower
    bound of what is left shows it. Incumbents are best-fit decreasing, and
    the plan that fills each bin as full as can be. No bin can hold more than
    the largest sum of lengths that fits, which is less than the capacity
    where the lengths have a common factor, say; bounds and waste are taken
    from that sum. The search ends at the lower bound, when no branch is left
    (then the result is optimal), or after the work of `effort` nodes, in
    which every filling looked at counts, dominated or not; the number of bins
    may then be above the optimum.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    capacity = next(Fillings(counts, capacity).totals(0))
    size = lambda plan: sum(n for _, n in plan)
    bound, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    if size(best) > bound:
        best = min(best, fullest(counts, capacity), key=size)
    n_best, work = size(best), Effort(effort * NODE)

    def children(left: dict[int, int], waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        top = max(left)
        room = capacity - top
        fill = Fillings(_take(left, {top: 1}, 1), room, work)
        for items in fill.undominated(room - ((n_best - 1) * capacity - total - waste)):
            need = Counter((top, *items))
            for times in range(min(left[s] // n for s, n in need.items()), 0, -1):
                yield (top, *items), times

    # Depth first, in rounds: round d takes a branch that is not the first of its level only d times on a path.
    spread, cut = 0, True
    while cut and n_best > bound and work.left > 0:
        cut = False
        # (histogram left, its branches still to try, their number so far, plan so far, bins so far, waste so far, turns left)
        stack = [[counts, children(counts, 0), 0, None, 0, 0, spread]]
        while stack and n_best > bound and work.left > 0:
            left, branches, tried, plan, bins, waste, turns = stack[-1]
            if tried > 0 and not turns:
                cut = True  # perhaps no branch is left; the next round finds out
                stack.pop()
                continue
            step = next(branches, None)
            if step is None:
                stack.pop()
                continue
            work.spend(NODE)
            stack[-1][2] += 1
            items, times = step
            bins, waste = bins + times, waste + times * (capacity - sum(items))
            if waste > (n_best - 1) * capacity - total:
                continue
            after, plan = _take(left, Counter(items), times), (plan, items, times)
            if after:
                if bins + lower_bound(after, capacity) < n_best:
                    stack.append([after, children(after, waste), 0, plan, bins, waste, turns - (tried > 0)])
            elif bins < n_best:
                n_best, best = bins, []
                while plan:
                    plan, items, times = plan
                    best.append((items, times))
        spread += 1
    return best


# ------------------------------------------------------------------------- tokens


@lru_cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


class WordIds:
    """Ids of texts, as arrays of unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so the runs
    between spaces and line ends are encoded once each and looked up after
    that; the tables are emptied when they are full. It also lower-cases, and
    splits letters from the marks after them, so a word of Latin letters is
    encoded once for all its capitals and closing marks. That is done only for
    letters of ASCII and Latin-1, each of which is one letter in lower case
    too, so the cut lies where the tokenizer cuts.
    """

    marks = ".,!?;:|#$%&*"
    space = re.compile(r"[ \n]")

    def __init__(self, path: str, most: int = 300_000, block: int = 4 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.block = _tokenizer(path), most, block
        # the same model for runs of lower-case letters between spaces, which need no other preparation
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # pieces that end a word
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.cores: dict[str, bytes] = {"": b""}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list[str], joined: bool) -> None:
        """Learn words; joined: each is one run of letters, so its ids end at the first that ends a word."""
        cores, step = self.cores, 200
        if joined:
            made = self.letters.encode_batch_fast([" ".join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False)
            for i, e in enumerate(made):
                ids = np.array(e.ids, np.uint32)
                ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                raw = ids.tobytes()
                for w, a, b in zip(words[i * step : (i + 1) * step], [0, *ends], ends, strict=False):
                    cores[w] = raw[a:b]
        else:
            for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                cores[w] = array("I", e.ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        cores, marks, parts, letters, others = self.cores, self.marks, [], set(), set()
        for w in words:
            core = w.rstrip(marks)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                low = core.lower()
                parts.append((low, w[len(core) :]))
                letters.add(low)
            else:
                parts.append((w, ""))
                others.add(w)
        others.update({b for _, b in parts})
        self._encode([w for w in letters if w not in cores], True)
        self._encode([w for w in others if w not in cores], False)
        raw = [cores[a] + cores[b] for a, b in parts]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(raw), np.uint32)))
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // 4
        self.starts = np.concatenate((self.starts, self.starts[-1] + ends))

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.known.get, distinct))
        if None in rows:
            new = [w for w, r in zip(distinct, rows, strict=True) if r is None]
            if len(self.known) + len(new) > self.most:
                self._clear()
                new, rows = distinct, [None] * len(distinct)
            numbers = iter(range(len(self.known), len(self.known) + len(new)))
            self._learn(new)
            rows = [next(numbers) if r is None else r for r in rows]
        rows = np.array(rows, np.int64)
        first, n = self.starts[rows], np.diff(self.starts)[rows]
        at = coded.indices.to_numpy()
        n = n[at]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(first[at] - ends + n, n) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(pc.list_value_length(words).to_numpy())[:-1] - 1])

    def _cut(self, text: str) -> Iterator[str]:
        """The text in blocks, cut at spaces and line ends."""
        at = 0
        while len(text) - at > self.block and (m := self.space.search(text, at + self.block)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, about a block of bytes at a time."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        first, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if first < i and size + n > self.block:
                yield from self._block(texts[first:i])
                first, size = i, 0
            if n > self.block:
                yield np.concatenate([self._block(pa.array([part]))[0] for part in self._cut(texts[i].as_py())])
                first, size = i + 1, 0
            else:
                size += n
        if first < len(texts):
            yield from self._block(texts[first:])


@lru_cache
def _word_ids(path: str) -> WordIds:
    """One table a worker process, which runs many tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and the task and number within task and length that wrote it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = _word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, found in zip(b.column(0).to_pylist(), ids(b.column(1)), strict=True):
                raw = np.concatenate((found, tail)).astype("<u4", copy=False).tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    n = len(cut) // 4
                    for column, value in zip(out, (doc, k, at // 4, n, zlib.crc32(cut), int(seen[n])), strict=True):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            arrays.append(pa.array(np.full(len(out[0]), task, np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, uses in a bin, first bin, offset in the bin), by rank.

    Rank r of a length, counted from a row's first rank, goes to bin
    first bin + r // uses, at offset + r % uses * length.
    """
    table: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for items, times in plan:
        at = 0
        for size in sorted(set(items), reverse=True):
            uses = items.count(size)
            table.setdefault(size, []).append((ranks.get(size, 0), uses, first_bin, at))
            ranks[size] = ranks.get(size, 0) + uses * times
            at += uses * size
        first_bin += times
    return {s: np.array(rows, np.int64) for s, rows in table.items()}


def pack(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    effort: int = 3000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document.

    A document's ids end with end_id; only documents longer than `capacity`
    are cut. What is packed is the histogram of lengths, which has at most
    `capacity` rows however many documents there are: complete_bins makes the
    plan from it on the driver, and each piece finds its place by its rank
    among the pieces of its length. Ranks come from counts by length and task,
    so no length is numbered in one task.

    Defined cases: a null or empty text is the end id alone; a null id stays
    null; repeated rows are packed again; other columns are ignored; an empty
    table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    cut = stage_table(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(slots(complete_bins(counts, capacity, effort)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at, rows = np.flatnonzero(length == size), table[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                r = rank[at] - row[:, 0]
                bins[at] = row[:, 2] + r // row[:, 1]
                offset[at] = row[:, 3] + r % row[:, 1] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offset)], names)

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
