"""Lexicons of any size against texts: one automaton over all aliases, run in Arrow batches.

A lexicon is a table of entries (a group, an alias, an order). It is packed
into parts of bounded size, each of which a task turns into one automaton
(failure links), so a text is read once for each part however many aliases
that has, and the plan has one expression a part.
"""

from __future__ import annotations

import uuid
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alias bytes of a part, which bounds what is sent to a task at once (an automaton takes up to a hundred times as much).
PART_BYTES = 1 << 20
#: Alias bytes of a lexicon that the map-only forms take; larger ones go through `scan_large`.
MOST_BYTES = 64 << 20
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Lexicon:
    """Entries (group, alias, payload), packed in parts by group.

    payload is a tuple of strings that a hit returns. Aliases are trimmed and
    lower-cased; those of under `least` characters and those in `stop` are
    left out, as are null ones. In a group, longer aliases go before shorter
    ones, and of equal length the one of smaller `nth`.
    """

    def __init__(self, payload: list[str], size: int, part: Callable[[int, int], list[tuple]]):
        self.payload, self.bytes, self._part = payload, size, part
        self.n_parts = max(1, -(-size // PART_BYTES))

    @classmethod
    def of_table(cls, entries: DataFrame, *, group: str, alias: str, nth: str | None = None, payload: list[str], least: int = 3, stop: frozenset = frozenset()) -> Lexicon:
        """From a table of any size; about PART_BYTES of aliases come to the driver at a time."""
        low = F.lower(F.trim(alias))
        place = (F.col(nth) if nth else F.lit(0)).cast("long").alias("nth")
        rows = entries.select(F.col(group).alias("g"), low.alias("a"), place, *[F.col(p).cast("string").alias(f"p{i}") for i, p in enumerate(payload)])
        rows = rows.where(F.length("a") >= least)
        if stop:
            rows = rows.where(~F.col("a").isin(*[s.lower() for s in stop]))
        size = rows.agg(F.coalesce(F.sum(F.octet_length("a")), F.lit(0)).alias("bytes")).first()["bytes"]
        order = [F.desc(F.length("a")), "nth", "a", "g"]
        return cls(payload, size, lambda i, n: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("g"), F.lit(n)) == i).orderBy(*order).collect()])

    @classmethod
    def of_list(cls, entries: list[tuple], payload: list[str], *, least: int = 3, stop: frozenset = frozenset()) -> Lexicon:
        """From a short list of (group, alias, *payload); the order of the list is that of equal lengths."""
        rows = [(e[0], e[1].strip().lower(), i, *e[2:]) for i, e in enumerate(entries)]
        skip = {x.lower() for x in stop}
        rows = sorted((r for r in rows if len(r[1]) >= least and r[1] not in skip), key=lambda r: (-len(r[1]), r[2]))
        size = min(PART_BYTES, sum(len(r[1].encode()) for r in rows))
        return cls(payload, size, lambda i, n: rows)

    def part(self, i: int) -> list[tuple]:
        """Entries of part i, best first."""
        return self._part(i, self.n_parts)


class Automaton:
    """Finds which entries of a part stand in a text."""

    #: Automata of one worker process, by part; two at most.
    held: OrderedDict = OrderedDict()

    def __init__(self, entries: list[tuple], bounded_under: int | None):
        import ahocorasick

        self.groups = [e[0] for e in entries]
        self.payloads = [e[3:] for e in entries]
        self.rows: pa.Array | None = None
        self.made = ahocorasick.Automaton()
        by_alias: dict[str, list[int]] = {}
        for i, e in enumerate(entries):
            by_alias.setdefault(e[1], []).append(i)
        for alias, places in by_alias.items():
            # aliases of one word and under `bounded_under` characters must stand alone; None: all must
            alone = bounded_under is None or (" " not in alias and len(alias) < bounded_under)
            self.made.add_word(alias, (len(alias), alone, tuple(places)))
        if by_alias:
            self.made.make_automaton()
        self.empty = not by_alias

    @classmethod
    def of(cls, sent: Broadcast, name: str, bounded_under: int | None) -> Automaton:
        """The automaton of a part, built once a worker process; name is the part's own."""
        if name not in cls.held:
            cls.held[name] = cls(sent.value, bounded_under)
            while len(cls.held) > 2:
                cls.held.popitem(last=False)
        return cls.held[name]

    def table(self, payload: list[str], kind: pa.DataType) -> pa.Array:
        """The payloads as an array, made once."""
        if self.rows is None:
            columns = [pa.array([p[k] for p in self.payloads], pa.string()) for k in range(len(payload))]
            self.rows, self.payloads = pa.StructArray.from_arrays(columns, fields=list(kind)), []
        return self.rows

    def best(self, text: str) -> dict:
        """The first entry, in the part's order, of each group that the text has."""
        found: set[int] = set()
        if not self.empty:
            for end, (n, alone, places) in self.made.iter(text):
                if places[0] in found:
                    continue
                if alone and (end >= n and text[end - n] in _EDGE or end + 1 < len(text) and text[end + 1] in _EDGE):
                    continue
                found.update(places)
        first: dict = {}
        for i in sorted(found):
            first.setdefault(self.groups[i], i)
        return first

    def longest_first(self, text: str) -> set[int]:
        """Entries of the aliases that a scan finds which takes, from left to right, the longest alias at a place and goes on behind it."""
        taken: set[int] = set()
        if self.empty:
            return taken
        spans: dict[int, tuple[int, tuple]] = {}
        for end, (n, alone, places) in self.made.iter(text):
            start = end - n + 1
            if alone and (start > 0 and text[start - 1] in _EDGE or end + 1 < len(text) and text[end + 1] in _EDGE):
                continue
            if spans.get(start, (0,))[0] < n:
                spans[start] = n, places
        free = 0
        for start in sorted(spans):
            if start >= free:
                n, places = spans[start]
                taken.update(places)
                free = start + n
        return taken


def _matcher(rows: DataFrame, lexicon: Lexicon, i: int, bounded_under: int | None, whole: bool = False):
    payload, name, sent = lexicon.payload, uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(lexicon.part(i))
    kind = pa.list_(pa.struct([(p, pa.string()) for p in payload]))

    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton.of(sent, name, bounded_under)
        entries = automaton.table(payload, kind.value_type)
        for batch in texts:
            # hits are places in the table of entries, four bytes each: what a batch holds are numbers, not rows
            ends, hit = array("i", [0]), array("i")
            for text in batch:
                low = text.as_py() or ""
                hit.extend(sorted(automaton.longest_first(low) if whole else automaton.best(low).values()))
                ends.append(len(hit))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries.take(pa.array(hit, pa.int32())))

    find.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "array<struct<" + ",".join(f"{p}:string" for p in payload) + ">>")


def hits(rows: DataFrame, lowered: Column, lexicon: Lexicon, *, bounded_under: int = 8) -> Column:
    """An array of the lexicon's payloads for each text, sorted: one a group, by the best alias that the text holds.

    Aliases of several words, or of `bounded_under` characters and more, may
    stand anywhere; shorter ones not next to a-z or 0-9. A null text has none.
    A map over the rows: no shuffle. What is sent to the tasks is checked:
    lexicons over MOST_BYTES are an error here and go through `scan_large`.
    """
    if lexicon.bytes > MOST_BYTES:
        raise ValueError(f"{lexicon.bytes} bytes of aliases are more than {MOST_BYTES}: use scan_large")
    parts = [_matcher(rows, lexicon, i, bounded_under)(lowered) for i in range(lexicon.n_parts)]
    return F.array_sort(F.concat(*parts) if len(parts) > 1 else parts[0])


def mentions(rows: DataFrame, lowered: Column, lexicon: Lexicon) -> Column:
    """An array of the payloads of all aliases that a scan from left to right finds, the longest at each place, which uses up what it covers.

    Aliases stand alone (not next to a-z or 0-9), and any white space of the
    text stands for a space of an alias. The lexicon must be of one part, as
    parts would not see what the others cover.
    """
    if lexicon.n_parts > 1:
        raise ValueError("a scan that uses up what it covers needs a lexicon of one part")
    return _matcher(rows, lexicon, 0, None, True)(F.regexp_replace(lowered, r"\s+", " "))


def scan_large(rows: DataFrame, key: list[str], lowered: str, lexicon: Lexicon, *, bounded_under: int = 8) -> DataFrame:
    """(key, payload) of each hit, for lexicons of any size: as `hits`, one row a group and text.

    Each part is a scan of its own, so a task holds one automaton at a time;
    a group lies in one part, so nothing is decided between parts.
    """
    found = None
    for i in range(lexicon.n_parts):
        own = rows.select(*key, F.inline(_matcher(rows, lexicon, i, bounded_under)(F.col(lowered))))
        found = own if found is None else found.unionByName(own)
    return found
