import hashlib
import random

import duckdb
import pytest

from caselode.llm import line_dedup as ld


def brute(rows, m):
    """(lines, deleted positions) of (id, text) rows."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seen, out = set(), {}
    for r in order:
        lines, gone = (rows[r][1] or "").split("\n"), set()
        for p in range(len(lines) - m + 1):
            w = tuple(lines[p : p + m])
            if w in seen:
                gone |= set(range(p, p + m))
            seen.add(w)
        out[r] = (lines, gone)
    return out


def texts(seed, n=40):
    rnd = random.Random(seed)
    return [(i, "\n".join(rnd.choice("abcde") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "m"), [(0, 2), (1, 3), (2, 5), (3, 1)])
def test_against_windows(spark, seed, m):
    rows = [*texts(seed), (None, "a\nb\nc\nd"), (50, None), (51, ""), (52, "x\nx\nx\nx\nx\nx"), (52, "x\nx\nx\nx\nx\nx"), (53, "q\n" * 3000 + "q")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pos int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in ld.drop_repeated_lines(docs, min_lines=m).collect()), key=repr)
    want = []
    for r, (lines, gone) in brute(rows, m).items():
        want.append((rows[r][0], "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("upto", [None, 1, 2, 3])
def test_ranks_are_a_suffix_array(spark, upto):
    rows = [*texts(5, 15), (20, "a\nb\na\nb\na\nb\na\nb\na\nb"), (21, "a\nb\na\nb\na\nb\na\nb\na\nb")]
    docs = ld.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.doc: r.doc_id for r in docs.collect()}
    got = {(ids[r.doc], r.pos): (r["rank"], r["n"]) for r in ld.suffix_ranks(ld.line_ids(docs), upto).collect()}
    suffixes = {}
    for i, t in rows:
        lines = [hashlib.md5(x.encode()).digest() for x in t.split("\n")]
        suffixes |= {(i, p): lines[p:][:upto] for p in range(len(lines))}
    every = sorted(suffixes.values())
    assert got == {k: (every.index(v), every.count(v)) for k, v in suffixes.items()}


def test_runs_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "d\ne\nb\nc")], "doc_id long, text string")
    got = sorted(tuple(r) for r in ld.repeated_runs(docs).collect())
    assert got == [(2, 1, 3, 1, 1), (3, 0, 2, 1, 3), (3, 2, 2, 1, 1)]


def test_oracle_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, ld.query(spark, sf).collect())) == sorted(con.execute(ld.ORACLE_SQL).fetchall())
    assert ld.drop_repeated_lines(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0
