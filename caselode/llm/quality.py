"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, stage_table

# ---------------------------------------------------------------- line features

#: Byte classes whose share of a line is a feature, as lists of characters.
CLASSES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    ".,;:'\"()-?",
    "!",
    "#$%&*+=@^~_\\/",
    "|<>{}[]`",
    " \t\v\f\r",
    "aeiouAEIOU",
)
OWN = len(CLASSES) + 9
#: Own features of a line, those of the line before and after, and whether these exist.
WIDTH = 3 * OWN + 2


def _table() -> np.ndarray:
    table = np.zeros((len(CLASSES) + 1, 256), np.uint8)
    for i, chars in enumerate(CLASSES):
        table[i, list(chars.encode())] = 1
    table[len(CLASSES), 128:] = 1
    return table


_TABLE = _table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, bytes of each line, features of each line) of all texts, line after line."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    per_text = np.diff(np.searchsorted(ends, text_ends - 1, "right"), prepend=0)
    text_of = np.repeat(np.arange(len(raw)), per_text)
    n_lines = len(ends)
    own = np.zeros((n_lines, OWN), np.float32)
    length = np.maximum(size, 1)
    for i in range(len(CLASSES) + 1):
        own[:, i] = np.add.reduceat(_TABLE[i][buf], starts, dtype=np.int64) / length
    # words: a hash for each, from its bytes and their places in it
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    k = len(CLASSES) + 1
    own[:, k + 1] = 1  # of lines without words, also where no line has any
    if len(first):
        last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
        line_of = np.searchsorted(starts, first, "right") - 1
        word_len = last - first + 1
        place = np.arange(len(buf), dtype=np.uint64)
        mixed = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        at = np.repeat(first, word_len).astype(np.uint64)
        inside = np.flatnonzero(~space)
        mixed = mixed[inside] * (np.uint64(2) * (place[inside] - at) + np.uint64(3))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        words = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(word_len)[:-1])))
        n_words = np.bincount(line_of, minlength=n_lines)
        some = np.maximum(n_words, 1)
        same = np.concatenate(([False], (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])))
        own[:, k] = np.bincount(line_of, same, n_lines) / some
        pair = np.stack((line_of.astype(np.uint64), words))
        order = np.lexsort(pair[::-1])
        pair = pair[:, order]
        new = np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))
        own[:, k + 1] = np.where(n_words > 0, np.bincount(pair[0][new].astype(np.int64), minlength=n_lines) / some, 1)
        own[:, k + 2] = np.bincount(line_of, word_len, n_lines) / some / 10
        own[:, k + 3] = np.log1p(n_words) / 4
        own[:, k + 4] = np.bincount(line_of, word_len > 25, n_lines) / some
        # a line whose hash another line of the text has
        order_in = words * (np.arange(len(words), dtype=np.uint64) - (np.cumsum(n_words) - n_words)[line_of].astype(np.uint64) + np.uint64(7))
        line_hash = np.zeros(n_lines, np.uint64)
        np.add.at(line_hash, line_of, order_in)
        key = np.stack((text_of.astype(np.uint64), line_hash))
        order = np.lexsort(key[::-1])
        eq = (key[:, order][:, 1:] == key[:, order][:, :-1]).all(axis=0)
        repeated = np.zeros(n_lines, bool)
        repeated[order[1:][eq]] = True
        repeated[order[:-1][eq]] = True
        own[:, k + 5] = repeated & (n_words > 0)
    own[:, k + 6] = np.log1p(size) / 6
    own[:, k + 7] = size == 0
    x = np.zeros((n_lines, WIDTH), np.float32)
    x[:, :OWN] = own
    before = np.concatenate(([False], text_of[1:] == text_of[:-1]))
    after = np.concatenate((before[1:], [False]))
    x[1:, OWN : 2 * OWN] = own[:-1] * before[1:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * after[:-1, None]
    x[:, 3 * OWN], x[:, 3 * OWN + 1] = ~before, ~after
    return per_text, size, x


# ---------------------------------------------------------------------- the chain


def _logaddexp(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(per_text: np.ndarray, good: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all chains at once.

    good: score of label 1 over label 0 of each line. edges[a, b]: score of b
    after a. Returns P(line is 1), the log partition of each chain, and the
    expected number of each label pair in each chain.
    """
    first = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    alpha[:, 1] = good
    longest = int(per_text.max(initial=0))
    alive = [int(np.searchsorted(-per_text[order], -t, "left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        at = first[order[: alive[t]]] + t
        alpha[at] += _logaddexp(alpha[at - 1][:, :, None] + edges, 1)
    pairs = np.zeros((len(per_text), 2, 2))
    log_z = np.zeros(len(per_text))
    has = per_text > 0
    log_z[has] = _logaddexp(alpha[(first + per_text - 1)[has]], 1)
    for t in range(longest - 1, 0, -1):
        who = order[: alive[t]]
        at = first[who] + t
        here = beta[at].copy()
        here[:, 1] += good[at]
        joint = edges + here[:, None, :]
        pairs[who] += np.exp(alpha[at - 1][:, :, None] + joint - log_z[who][:, None, None])
        beta[at - 1] = _logaddexp(joint, 2)
    z = np.repeat(log_z, per_text)
    return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0)), log_z, pairs


def _gradient(theta: np.ndarray, per_text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Negative log likelihood and its gradient, chains weighted by 1 / lines^0.5; y: the label of all lines of a text."""
    w, edges = theta[:-5], theta[-4:].reshape(2, 2)
    p, log_z, pairs = marginals(per_text, x @ w + theta[-5], edges)
    weight = 1 / np.sqrt(np.maximum(per_text, 1))
    line_y, line_w = np.repeat(y, per_text), np.repeat(weight, per_text)
    own = np.add.reduceat(x @ w + theta[-5], np.cumsum(per_text) - per_text) * y
    moves = np.zeros_like(pairs)
    moves[np.arange(len(y)), y, y] = per_text - 1
    loss = (weight * (log_z - own - (moves * edges).sum(axis=(1, 2)))).sum()
    diff = (p - line_y) * line_w
    return np.concatenate(([loss], x.T @ diff, [diff.sum()], ((pairs - moves) * weight[:, None, None]).sum(axis=0).ravel()))


def _minimise(fn, theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; fn gives value and gradient."""
    value, grad = fn(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(steps, reversed(used), strict=True):
            q += s * (a - y @ q / (s @ y))
        rate = 1.0
        for _ in range(12):
            new = theta - rate * q
            new_value, new_grad = fn(new)
            if new_value <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-10:
            steps = [*steps, (s, y)][-memory:]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        theta, value, grad = new, new_value, new_grad
        if done:
            break
    return theta


def _blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of texts of about `most` characters."""
    run: list[str] = []
    first, total = 0, 0
    for i, t in enumerate(texts):
        run.append(t.as_py() or "")
        total += len(run[-1])
        if total >= most:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run


def fit(labelled: DataFrame, *, rounds: int = 40, l2: float = 1.0, parts: int = 12) -> dict:
    """Weights from (text, label) rows; each line takes its document's label.

    Features stay in the shared folder; each step of L-BFGS is a Spark job in
    which every task adds up the gradient of its rows, so the driver gets one
    vector a task. Without rows of both labels all weights are zero.
    """
    spark = labelled.sparkSession
    deal = [F.xxhash64(*[c for c in labelled.columns if c in ("doc_id", "text")])]  # by id and text
    sample = labelled.where("label in (0, 1)").repartition(parts, *deal).select("text", F.col("label").cast("int").alias("label"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, texts in _blocks(b.column(0)):
                per_text, _, x = line_features(texts)
                y = labels[at : at + len(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in (per_text.astype(np.int64), x, y)], ["per_text", "x", "y"]
                )

    blocks = stage_table(sample.mapInArrow(extract, "per_text binary, x binary, y binary"), "crf")

    def totals(run, width: int) -> np.ndarray:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                for per_text, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.frombuffer(x, np.float32).reshape(-1, WIDTH)
                    total += run(np.frombuffer(per_text, np.int64), x, np.frombuffer(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        got = blocks.mapInArrow(over, "total binary").collect()  # one vector a task
        return sum((np.frombuffer(r["total"]) for r in got), np.zeros(width))

    stats = totals(lambda n, x, y: np.concatenate(([len(y), y.sum(), len(x)], x.sum(axis=0), (x.astype(float) ** 2).sum(axis=0))), 3 + 2 * WIDTH)
    docs, ones, lines = stats[:3]
    if not 0 < ones < docs:
        return {"theta": np.zeros(WIDTH + 5), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    mean = stats[3 : 3 + WIDTH] / lines
    deviation = np.sqrt(np.maximum(stats[3 + WIDTH :] / lines - mean**2, 0))
    scale = np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        out = totals(lambda n, x, y: _gradient(theta, n, (x - mean) * scale, y), WIDTH + 6)
        decay = np.where(np.arange(WIDTH + 5) == WIDTH, 0, l2)
        return out[0] + 0.5 * (decay * theta**2).sum(), out[1:] + decay * theta

    return {"theta": _minimise(loss, np.zeros(WIDTH + 5), rounds), "mean": mean, "scale": scale}


def _scorer(model: dict):
    """A function from a column of texts to (scores, lines, good lines)."""
    theta, mean, scale = model["theta"], model["mean"], model["scale"]
    weights = theta[:WIDTH] * scale
    bias, edges = theta[WIDTH] - mean @ weights, theta[-4:].reshape(2, 2)

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [np.empty((3, 0))]
        for _, texts in _blocks(column):
            per_text, size, x = line_features(texts)
            p, _, _ = marginals(per_text, x @ weights.astype(np.float32) + bias, edges)
            of = np.repeat(np.arange(len(texts)), per_text)
            total = np.bincount(of, size + 1.0, len(texts))
            value = np.clip(np.bincount(of, p * (size + 1.0), len(texts)) / total, 0, 1)
            out.append(np.stack((value, per_text, np.bincount(of, p >= 0.5, len(texts)))))
        value, lines, good = np.concatenate(out, axis=1)
        return value, lines.astype(np.int64), good.astype(np.int64)

    return run


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, good_lines): score is the mean, weighted by bytes, of the lines' probabilities to be good."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(0), *map(pa.array, scorer(b.column(1)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_lines", "good_lines"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_lines long, good_lines long")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_docs: int = 8000) -> DataFrame:
    """The rows of docs, with all columns, that classify would predict 1; no row is moved.

    Defined cases: a null or empty text is one empty line and is judged by its
    score like any other; a score equal to the threshold is kept; repeated
    rows are judged alike; without usable labels every score is 0.5; an empty
    table gives an empty result; columns keep their names, whatever they are.
    """
    scorer = _scorer(fit(labelled_texts(docs, labels, "quality", lambda i: crc32_mod(i, 5) != 0, max_docs)))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(text))[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn, max_docs: int, max_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, text, label) of at most max_docs labelled documents for which learn(doc_id) holds, of at most max_bytes in all.

    Of the labelled ids that have a document those of smallest hash are taken
    before the join with the texts, so what is broadcast has at most max_docs
    rows of two numbers, and no other text is moved. Of rows that repeat an id
    one teaches, that of smallest text hash; ids with conflicting labels are
    left out. Texts of more than max_bytes teach nothing and take no room;
    of the others, in hash order of the ids, those that pass max_bytes are
    left out too.
    """
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    marks = marks.where((F.col("label") == F.col("most")) & F.col("label").isin(0, 1)).where(learn(F.col("marked"))).drop("most")
    present = docs.select("doc_id").distinct()
    marks = marks.join(present, marks.marked == present.doc_id, "left_semi")
    marks = marks.orderBy(F.xxhash64("marked"), "marked").limit(max_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(marks), rows.doc_id == marks.marked)
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = stage_table(rows.select("doc_id", F.col("t.text").alias("text"), F.col("label").cast("int").alias("label")), "labelled")
    rows = rows.where(F.octet_length("text") <= max_bytes)
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most max_docs numbers
    fit_in = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= max_bytes).select("doc_id")
    return rows.join(F.broadcast(fit_in), "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, max_docs: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, good_lines of every document.

    The random field is fitted on labelled rows whose crc32(doc_id) mod 5 is
    not 0, and scores every whole text by its lines alone. Defined cases: a
    null or empty text is one empty line and is scored like any other; null
    labels and null ids teach nothing; repeated rows are scored again; other
    columns are ignored; without usable labels every score is 0.5.
    """
    model = fit(labelled_texts(docs, labels, "quality", lambda i: crc32_mod(i, 5) != 0, max_docs))
    return score(docs, model).select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_lines",
        "good_lines",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
