"""The ledger from one view: scans, small cases, nulls and empty tables."""

from caselode.operators import ledger_facts as LF
from caselode.plans import ledgers
from caselode.sources import fixtures as X

SF = "/root/testdata/sf0.001"
CASES = "link string, row_ord long, title string, year string, verdict boolean, posture string, model string, role string"
METHODS = "row_ord long, m_pos int, claim_status string, has_quote boolean, verbatim boolean, technique string, family string, channel string, basis string, artifact string"


def test_one_scan_of_each_table(spark):
    whole = LF.whole_cases(X.cases(spark, SF), X.methods(spark, SF))
    plan = LF.facts(whole, [], X.OBSERVED_CHANNELS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderpriority#") > 0 and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) == 1


def test_small_cases(spark):
    cases = [("a", 1, "A", "2024", True, "indictment", "m", "former sales"), ("b", 2, "B", None, True, "plea", "m", ""), ("c", 3, "C", "2024", False, "plea", None, None), ("d", 4, None, None, None, None, None, None)]
    methods = [
        (1, 1, "adjudicated", True, True, "T1", "mail", "email", "mechanically_implied", " Log "),
        (1, 2, "reported", True, None, "T1", "mail", "usb", "analyst_inference", "log"),
        (2, 1, "admitted", False, None, "T1", "disk", "other", "analyst_inference", "Disk image"),
        (2, 2, "alleged", True, False, "T2", "mail", "usb", "analyst_inference", "third"),
        (3, 1, "adjudicated", True, True, "T1", "mail", "email", "mechanically_implied", "x"),
    ]
    whole = LF.whole_cases(spark.createDataFrame(cases, CASES), spark.createDataFrame(methods, METHODS))
    cut = LF.sections(LF.facts(whole, [("sales", "commercial")], ["email", "usb", "print"]), ["email", "usb", "print"])
    got = {}
    for r in cut.collect():
        got.setdefault(r.section, set()).add((r.a, r.b, r.n, r.strong, r["rank"]))
    assert got["basis"] == {("total", "", 4, 0, 0), ("with_verdict", "", 3, 0, 0), ("verdict_true", "", 2, 0, 0), ("contributing", "", 2, 0, 0), ("excluded_non_insider", "", 1, 0, 0), ("excluded_no_verdict", "", 1, 0, 0)}
    assert got["strength"] == {("alleged", "", 1, 1, 0), ("admitted", "", 1, 0, 0)}
    assert got["technique"] == {("T1", "alleged", 2, 0, 0), ("T1", "admitted", 1, 0, 0), ("T2", "admitted", 1, 0, 0)}
    assert got["family"] == {("mail", "", 2, 1, 0), ("disk", "", 1, 1, 0)}
    assert got["channel"] == {("email", "", 1, 0, 0), ("usb", "", 2, 0, 0), ("print", "", 0, 0, 0)}
    assert got["family_channel"] == {("mail", "usb", 2, 0, 1), ("mail", "email", 1, 0, 2)}
    assert got["family_example"] == {("mail", "log", 2, 0, 1), ("mail", "third", 1, 0, 2), ("disk", "disk image", 1, 0, 1)}
    assert got["quotes"] == {("verbatim", "", 1, 0, 0), ("not_verbatim", "", 1, 0, 0), ("unstamped", "", 1, 0, 0)}
    assert got["year_technique"] == {("2024", "T1", 2, 0, 1), ("????", "T1", 1, 0, 1), ("????", "T2", 1, 0, 2)}
    assert got["technique_family"] == {("T1", "mail", 3, 0, 1), ("T1", "disk", 1, 0, 2), ("T2", "disk", 1, 0, 1), ("T2", "mail", 1, 0, 2)}
    records = {r.family: (r.channels, r.examples, r.adjudicated_share) for r in LF.evidence_records(cut).collect()}
    assert records == {"mail": ("usb:2, email:1", "Log, third", None), "disk": ("", "Disk image", None)}


def test_empty_tables(spark):
    whole = LF.whole_cases(spark.createDataFrame([], CASES), spark.createDataFrame([], METHODS))
    cut = LF.sections(LF.facts(whole, [], ["email"]), ["email"])
    assert [(r.section, r.a, r.n) for r in cut.collect()] == [("channel", "email", 0)]
    assert ledgers.QUERIES.keys() == ledgers.ORACLE_SQL.keys()


def test_only_what_counts_is_dealt_by_case(spark):
    """Methods of untrue cases and columns that no fact reads are left out before the shuffles; the facts are the same."""
    made = lambda m: LF.facts(LF.whole_cases(X.cases(spark, SF), m), [], X.OBSERVED_CHANNELS)
    every, true = X.methods(spark, SF), X.methods(spark, SF, true_only=True)
    kept = every.join(X.cases(spark, SF).where("verdict"), "row_ord", "left_semi")
    assert true.count() == kept.count() < every.count() and true.exceptAll(kept).count() == 0
    plan = made(true)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Project" in line and "p_name" in line for line in plan.splitlines()) and plan.index("collect_list") < plan.index("RepartitionByExpression")
    assert sorted(made(true).collect()) == sorted(made(every).collect())
