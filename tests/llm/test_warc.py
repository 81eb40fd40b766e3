import base64
import glob
import gzip
import hashlib

from caselode.llm import warc

ROWS = [(3, "http://a/%41 x\r\nX: y", "<p>é</p>", 1), (1, None, "same", 2), (2, "http://b/", "same", 3), (9, "u", None, 4), (4, "u", "", 5), (None, "u", "same", 6), (1, None, "same", 7), (7, "v", "z" * 500_000, 8), (None, "w", "only", 9)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, offset int")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder).cache()
    assert index.count() == len(ROWS)
    got = {(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_records(index, folder, gap=0, most=50).collect()}
    first = {}
    for i, _, h, _ in ROWS:
        ids = [x for x in (first.get(h or ""), i) if x is not None]
        first[h or ""] = min(ids) if ids else None
    want = set()
    for i, u, h, _ in ROWS:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = i == first[h or ""]
        want.add((i, u, "response" if same else "revisit", None if same else first[h or ""], len(raw), digest, raw if same else None))
    assert {(*g[:6], bytes(g[6]) if g[6] is not None else None) for g in got} == want
    # any reader of gzip members sees plain records one after another
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS) and whole.count(b"WARC-Type: revisit") == 3
    assert {r.page_id for r in warc.read_records(index.where("page_id = 7"), folder).collect()} == {7}


def test_edges(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, offset int")
    assert warc.archive_pages(pages.limit(0)).count() == 0
    kinds = [r.record_type for r in warc.archive_pages(pages, min_bytes=5).collect()]
    assert kinds.count("revisit") == 0


def test_oracle(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.ORACLE_SQL})").fetchall())
    assert sorted(map(tuple, warc.query(spark, sf).collect())) == want
