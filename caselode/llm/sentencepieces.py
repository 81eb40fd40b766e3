"""SentencePiece encoding and decoding with N-best segmentations by A-star."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_LOW = float("-inf")


class Lattice:
    """Viterbi over the piece lattices of many words at once, for words of up to `most` Latin letters, ASCII and U+2581.

    The pieces are a trie whose nodes are numbered, node 0 being dead and node
    1 the root; a step is one look-up by node and character class.
    """

    most = 40

    def __init__(self, pieces: dict[str, tuple[int, float] | None], single: dict[str, tuple[int, float]], longest: int):
        chars = sorted({c for k in pieces for c in k if c < "\u0180" or c == SPACE} | set(single))
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        known = {k: v for k, v in pieces.items() if all(self.classes[ord(c)] for c in k)} | single
        inner = [""] + sorted({k[:-1] for k in known if len(k) > 1})
        node = {k: i + 1 for i, k in enumerate(inner)}
        for k in known:
            node.setdefault(k, len(node) + 1)
        self.inner, self.longest = len(inner) + 1, longest
        self.next = np.zeros((self.inner, len(chars) + 1), np.uint32 if len(node) >= 1 << 16 else np.uint16)
        self.score, self.id = np.full(len(node) + 1, _LOW), np.zeros(len(node) + 1, np.uint32)
        for k, entry in known.items():
            self.next[node[k[:-1]], self.classes[ord(k[-1])]] = node[k]
            if entry:
                self.id[node[k]], self.score[node[k]] = entry

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether it can be done here, best score, loss of the second best, number of ids) of each word; ids in self.found."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        ok = (sizes <= self.most) & (sizes > 0)
        ok[np.repeat(np.arange(len(words)), sizes)[codes == 0]] = False
        score, loss, count = np.zeros(len(words)), np.full(len(words), np.inf), np.zeros(len(words), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # (places of words, their ids one after the other)
        able = np.flatnonzero(ok)
        able = able[np.argsort(sizes[able], kind="stable")]
        for at in range(0, len(able), 1 << 14):
            who = able[at : at + (1 << 14)]
            score[who], loss[who], count[who] = self._solve(codes, starts[who], sizes[who], who)
        return ok, score, loss, count

    def _solve(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(who), int(sizes.max())
        place = np.arange(width)[:, None]
        chars = np.where(place < sizes, codes[np.minimum(starts + place, len(codes) - 1)], 0)
        best, second = np.full((width + 1, n), _LOW), np.full((width + 1, n), _LOW)
        piece, length = np.zeros((width + 1, n), np.uint32), np.zeros((width + 1, n), np.int8)
        best[0] = 0
        for i in range(width):
            state = np.ones(n, np.int64)
            for d in range(1, min(self.longest, width - i) + 1):
                state = self.next[np.where(state < self.inner, state, 0), chars[i + d - 1]].astype(np.int64)
                live = np.flatnonzero(state)
                if 4 * len(live) > n:
                    live = slice(None)
                elif not len(live):
                    break
                step = self.score[state[live]]
                new, j = best[i, live] + step, i + d
                old = best[j, live]
                second[j, live] = np.maximum(np.maximum(second[j, live], np.minimum(old, new)), second[i, live] + step)
                better = new > old
                best[j, live] = np.where(better, new, old)
                piece[j, live] = np.where(better, self.id[state[live]], piece[j, live])
                length[j, live] = np.where(better, d, length[j, live])
        at, rows = sizes.copy(), np.arange(n)
        ids, count = np.zeros((width, n), np.uint32), np.zeros(n, np.int64)
        while (going := np.flatnonzero(at)).size:
            j = at[going]
            ids[count[going], going] = piece[j, going]
            count[going] += 1
            at[going] = j - length[j, going]
        back = np.repeat(count, count) - 1 - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        self.found.append((who, ids[back, np.repeat(rows, count)]))
        top = best[sizes, rows]
        return top, top - second[sizes, rows], count


class Pieces:
    """The pieces of a model and their scores; nothing but the vocabulary is taken from the model.

    A segmentation's score is the sum of its pieces' scores. A character that
    is no piece costs the lowest score less 10 and is written as its bytes.
    Space is written as U+2581, also before the first word. No piece joins a
    letter to a space after it, so words are segmented on their own; nor does
    any piece hold two neighbouring characters that are in no piece together,
    so words can be cut there too (line ends always are such places here), and
    all these cuts are exact.

    Distinct words are segmented once and kept in tables, which are emptied
    when they are full.
    """

    def __init__(self, path: str, n_best: int = 5, most: int = 800_000, block: int = 4 << 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best, self.most, self.block = n_best, most, block
        self.table: dict[str, tuple[int, float] | None] = {}
        self.text: list[bytes] = []
        self.bytes_ids = [0] * 256
        self.joined: set[str] = set()
        for i in range(model.get_piece_size()):
            piece, plain = model.id_to_piece(i), not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))
            if model.is_byte(i):
                self.bytes_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(piece.replace(SPACE, " ").encode() if plain else b"")
            if plain:
                for k in range(1, len(piece)):
                    self.table.setdefault(piece[:k], None)
                    self.joined.add(piece[k - 1 : k + 1])
                self.table[piece] = (i, model.get_score(i))
        self.longest = max(map(len, self.table))
        self.unknown = min(e[1] for e in self.table.values() if e) - 10
        if any(a != SPACE and b == SPACE for a, b in self.joined):
            raise ValueError("a piece joins a word to the space after it: words can't be segmented on their own")
        if any("\n" in pair for pair in self.joined):
            raise ValueError("a piece joins a line end to another character: lines can't be segmented on their own")
        single = {chr(c): (self.bytes_ids[c], self.unknown) for c in range(128) if not self.table.get(chr(c))}
        self.lattice = Lattice(self.table, single, self.longest)
        self.text_flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_ends = np.cumsum([len(t) for t in self.text])
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.units: dict[str, tuple] = {}
        self.lists: dict[str, list] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.scores, self.losses = np.empty(0), np.empty(0)

    def _char(self, c: str) -> tuple[tuple[int, ...], float]:
        e = self.table.get(c)
        return ((e[0],), e[1]) if e else (tuple(self.bytes_ids[b] for b in c.encode("utf-8", "replace")), self.unknown)

    def viterbi(self, s: str) -> tuple[float, bytes, float]:
        """(best score, its ids as bytes, loss of the second best)."""
        n, find = len(s), self.table.get
        best, second, back = [0.0] + [_LOW] * n, [_LOW] * (n + 1), [(0, 0)] * (n + 1)
        for i in range(n):
            b, c = best[i], second[i]
            j = i + 1
            e = find(s[i]) or (s[i], self.unknown)
            while True:
                if e:
                    step = e[1]
                    if b + step > best[j]:
                        second[j] = best[j] if best[j] > c + step else c + step
                        best[j] = b + step
                        back[j] = (i, e[0])
                    elif b + step > second[j]:
                        second[j] = b + step
                j += 1
                if j > n or (e := find(s[i:j], 0)) == 0:
                    break
        out, j = [], n
        while j:
            j, x = back[j]
            if type(x) is int:
                out.append(x)
            else:
                out += reversed(self._char(x)[0])
        out.reverse()
        return best[n], array("I", out).tobytes(), best[n] - second[n]

    def forward(self, s: str) -> list[float]:
        best = [0.0] + [_LOW] * len(s)
        for i in range(len(s)):
            best[i + 1] = max(best[i + 1], best[i] + self._char(s[i])[1])
            for j in range(i + 2, len(s) + 1):
                e = self.table.get(s[i:j], 0)
                if e == 0:
                    break
                if e:
                    best[j] = max(best[j], best[i] + e[1])
        return best

    def n_best_of(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        """The n_best segmentations (score, ids), best first.

        A path is grown from the end of the string to its start; the forward
        Viterbi score of the place it has reached is exactly the best that can
        still be added, so paths leave the queue in the order of their total.
        Among equal totals the one nearest to its end goes first. Only the
        n_best first paths that reach a place can be part of the result, so
        each place is left at most so often, however many paths tie.
        """
        heuristic = self.forward(s)
        queue: list[tuple] = [(-heuristic[-1], len(s), 0, 0.0, None)]
        made, found, visits = 0, [], [0] * (len(s) + 1)
        while queue and len(found) < self.n_best:
            _, j, _, score, path = heapq.heappop(queue)
            if visits[j] == self.n_best:
                continue
            visits[j] += 1
            if j == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((score, tuple(ids)))
                continue
            for i in range(max(0, j - self.longest), j):
                if visits[i] == self.n_best:
                    continue
                if i == j - 1:
                    ids, add = self._char(s[i])
                elif e := self.table.get(s[i:j]):
                    ids, add = (e[0],), e[1]
                else:
                    continue
                made += 1
                heapq.heappush(queue, (-(score + add + heuristic[i]), i, made, score + add, (ids, path)))
        return found

    def _word(self, w: str) -> tuple[float, bytes, float]:
        """As viterbi, unit by unit between the places where no piece can lie."""
        cuts = [0, *(k for k in range(1, len(w)) if w[k - 1 : k + 1] not in self.joined), len(w)]
        score, ids, loss = 0.0, [], float("inf")
        for a, b in zip(cuts, cuts[1:], strict=False):
            unit = w[a:b]
            got = self.units.get(unit)
            if got is None:
                got = self.units[unit] = self.viterbi(unit)
            score, loss = score + got[0], min(loss, got[2])
            ids.append(got[1])
        return score, b"".join(ids), loss

    def _learn(self, words: list[str]) -> None:
        ok, score, loss, count = self.lattice.best(words)
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        for who, ids in self.lattice.found:
            for i, part in zip(who.tolist(), np.split(ids, np.cumsum(count[who])[:-1]), strict=True):
                parts[i] = part
        for i in np.flatnonzero(~ok).tolist():
            if words[i]:
                score[i], raw, loss[i] = self._word(words[i])
                parts[i] = np.frombuffer(raw, np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.ids = np.concatenate((self.ids, *parts))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.scores, self.losses = np.concatenate((self.scores, score)), np.concatenate((self.losses, loss))

    def _rows(self, words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, place of each word among them, table row of each distinct word)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.words.get, distinct))
        if None in rows:
            new = [w for w, r in zip(distinct, rows, strict=True) if r is None]
            if len(self.words) + len(new) > self.most or len(self.units) > self.most // 4 or len(self.lists) > self.most // 8:
                self._clear()
                new, rows = distinct, [None] * len(distinct)
            numbers = iter(range(len(self.words), len(self.words) + len(new)))
            self._learn(new)
            rows = [next(numbers) if r is None else r for r in rows]
        return distinct, coded.indices.to_numpy(), np.array(rows, np.int64)

    def _alternatives(self, words: list[str], losses: np.ndarray, best: float, ids: bytes, starts: np.ndarray) -> list[tuple[float, bytes]]:
        """The n_best segmentations of a text from those of its words; starts: where a word's ids begin and end."""
        if self.n_best == 1:
            return [(best, ids)]
        # only the n_best - 1 words with the least losses can differ from the best segmentation
        most = self.n_best - 1
        low = np.flatnonzero(losses <= np.partition(losses, most - 1)[most - 1]) if len(losses) > most else np.arange(len(losses))
        order = low[np.argsort(losses[low], kind="stable")][:most].tolist()
        options = []
        for i in order:
            s = words[i]
            if not s:
                continue
            if s not in self.lists:
                self.lists[s] = self.n_best_of(s)
            top = self.lists[s]
            options.append([(top[0][0] - score, len(x) - len(top[0][1]), ((i, n),) if n else ()) for n, (score, x) in enumerate(top)])
        totals: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
        for o in options:
            totals = heapq.nsmallest(self.n_best, ((a + c, b + d, p + q) for a, b, p in totals for c, d, q in o))
        out = []
        for loss, _, changes in totals:
            pieces, at = [], 0
            for i, n in sorted(changes):
                pieces += [ids[at : 4 * int(starts[i])], array("I", self.lists[words[i]][n][1]).tobytes()]
                at = 4 * int(starts[i + 1])
            out.append((best - loss, b"".join((*pieces, ids[at:])) if changes else ids))
        return out

    def _block(self, texts: pa.Array) -> Iterator[list[tuple[float, bytes]]]:
        odd = pc.or_(pc.match_substring_regex(texts, "  |^ | $"), pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False)
        if odd.any():  # spaces that pieces may join: each run of them goes to the word after it
            lists = []
            for t, o in zip(texts.to_pylist(), odd.tolist(), strict=True):
                marked = SPACE + (t.replace(" ", SPACE) if o else t.replace(" ", " " + SPACE))
                found = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked) if o else marked.split(" ")
                lists.append([y for x in found for y in re.split("(\n)", x)])
            words = pa.array(lists, pa.list_(pa.string()))
        else:
            spaced = pc.replace_substring(pc.replace_substring(texts, " ", " " + SPACE), "\n", " \n ")
            words = pc.split_pattern(pc.binary_join_element_wise(SPACE, spaced, ""), " ")
        distinct, at, rows = self._rows(words.flatten())
        first, n = self.ends[rows], np.diff(self.ends)[rows]
        n = n[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        scores, losses, low = self.scores[rows][at], self.losses[rows][at], 0
        for high in np.cumsum(pc.list_value_length(words).to_numpy()).tolist():
            raw = ids[ends[low] : ends[high]].tobytes()
            own = _Words(distinct, at[low:high])
            yield self._alternatives(own, losses[low:high], float(scores[low:high].sum()), raw, ends[low : high + 1] - ends[low])
            low = high

    def encode_many(self, texts: pa.Array) -> Iterator[list[tuple[float, bytes]]]:
        """[(score, ids as bytes)] of the n_best segmentations of each text, best first."""
        first, size = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if not n or first < i and size + n > self.block:
                yield from self._block(texts[first:i]) if first < i else ()
                first, size = i, 0
            if n:
                size += n
            else:
                yield [(0.0, b"")]
                first = i + 1
        if first < len(texts):
            yield from self._block(texts[first:])

    def encode(self, text: str) -> tuple[bytes, list[tuple[float, int]]]:
        """(ids of the best segmentation as bytes, [(score, number of ids)] of the n_best)."""
        found = self.encode_all(text)
        return found[0][1], [(score, len(ids) // 4) for score, ids in found]

    def encode_all(self, text: str) -> list[tuple[float, bytes]]:
        """[(score, ids as bytes)] of the n_best segmentations, best first."""
        return next(self.encode_many(pa.array([text], pa.string())))

    def decoded(self, ids: bytes) -> bytes:
        """The bytes of all pieces, one after the other."""
        at = np.frombuffer(ids, np.uint32)
        ends = self.text_ends[at]
        n = ends - np.where(at > 0, self.text_ends[at.astype(np.int64) - 1], 0)
        return self.text_flat[np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes put together, without the space before the first word."""
        return self.decoded(ids).decode("utf-8", "replace").removeprefix(" ")


class _Words:
    """The words of one text, by their places among the distinct ones."""

    def __init__(self, distinct: list[str], at: np.ndarray):
        self.distinct, self.at = distinct, at

    def __getitem__(self, i: int) -> str:
        return self.distinct[self.at[i]]


@lru_cache
def _pieces(path: str, n_best: int) -> Pieces:
    """One table a worker process, which runs many tasks."""
    return Pieces(path, n_best)


def segment(docs: DataFrame, *, model: str | None = None, n_best: int = 5, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_best (array of score, n_tokens and ids_crc32, best first), round_trip.

    with_ids adds the ids of the best segmentation, and to n_best the ids of
    each. round_trip says that those of the best decode to the text. Defined cases: a null text counts as empty, an empty
    text has no ids and the one score 0; equal scores are ordered by number of
    ids in n_best; a U+2581 in a text decodes as a space; repeated rows are
    encoded again; other columns are ignored; an empty table gives an empty
    result. Texts are whole: work and memory grow with their length.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.list_(pa.struct(fields + [("ids", pa.list_(pa.int32()))] * with_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, n_best)
        for b in batches:
            n, crc, best, same, kept = [], [], [], [], []
            for t, top in zip(b.column(1), pieces.encode_many(b.column(1)), strict=True):
                text, ids = t.as_buffer(), top[0][1]
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                best.append([{"score": s, "n_tokens": len(x) // 4, "ids_crc32": zlib.crc32(x)} for s, x in top])
                raw = pieces.decoded(ids)
                same.append(raw == b" " + text.to_pybytes() or not raw and not text.size)
                if with_ids:
                    kept.append(array("I", ids).tolist())
                    for made, (_, x) in zip(best[-1], top, strict=True):
                        made["ids"] = array("I", x).tolist()
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(best, kind), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_crc32", "n_best", "round_trip"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    each = "score:double,n_tokens:long,ids_crc32:long" + ",ids:array<int>" * with_ids
    schema = f"doc_id long, n_tokens long, ids_crc32 long, n_best array<struct<{each}>>, round_trip boolean"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text that each row's ids stand for; null ids give a null text, no ids an empty one.

    Ids outside the vocabulary or null are an error. Repeated rows are decoded again.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    found = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, 5)
        for b in batches:
            texts = [None if x is None else pieces.decode(array("I", x).tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return segment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
