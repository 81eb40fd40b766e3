import duckdb

from caselode.llm import line_dedup as ld

LONG = " ".join(f"w{i}" for i in range(50))
SHORT = " ".join(f"w{i}" for i in range(49))


def test_a_long_line_goes_on_its_own(spark):
    rows = [(1, f"a\n{LONG}\nb"), (2, LONG), (3, f"c\n{LONG}\nd"), (4, f"{SHORT}\ne"), (5, SHORT), (6, f"b\n{LONG}\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted, r.n_runs) for r in ld.drop_repeated_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("", 1, 1), 3: ("c\nd", 1, 1), 4: (rows[3][1], 0, 0), 5: (SHORT, 0, 0), 6: ("b\na", 1, 1)}
    runs = sorted(tuple(r) for r in ld.repeated_runs(docs).collect())
    assert runs == [(2, 0, 1, 1, 1), (3, 1, 1, 1, 1), (6, 1, 1, 1, 1)]


def test_words_count_over_shorter_runs(spark):
    half = " ".join(f"v{i}" for i in range(25))
    rows = [(1, f"a\n{LONG}\n{half}\n{half}\nb"), (2, f"{half}\n{half}"), (3, f"x\n{LONG}"), (4, "a\nb\nc"), (5, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(docs, min_lines=3).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "x", 4: "a\nb\nc", 5: "a\nb"}


def test_passages_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(ld.PASSAGES_SQL).fetchall())
    assert sorted(map(tuple, ld.passages(spark, sf).collect())) == want
    assert want != sorted(con.execute(ld.ORACLE_SQL).fetchall())
