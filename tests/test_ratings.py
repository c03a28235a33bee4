"""Pass rates in long form and case detail, on literal rows."""
from veilspan.operators import benchstats as B


def test_rates_skip_unjudged_answers_and_pool_overall(spark):
    rows = [("a", True, None), ("a", False, True), ("a", None, True), ("b", None, None), (None, True, False)]
    got = {(r.source, r.criterion): (r.passed, r.n, r.rate) for r in B.criterion_rates(spark.createDataFrame(rows, "source string, x boolean, y boolean"), "source", ["x", "y"]).collect()}
    assert got == {
        ("a", "x"): (1, 2, 0.5), ("a", "y"): (2, 2, 1.0), ("a", "overall"): (3, 4, 0.75),
        ("b", "x"): (0, 0, None), ("b", "y"): (0, 0, None), ("b", "overall"): (0, 0, None),
        (None, "x"): (1, 1, 1.0), (None, "y"): (0, 1, 0.0), (None, "overall"): (1, 2, 0.5),
    }


def test_detail_has_a_row_per_case_and_null_where_a_source_is_missing(spark):
    rows = [("k", "local", 120, True, False, 4, 5), ("k", "nube", 90, True, True, 3, 3), ("m", "nube", 10, False, False, None, 2)]
    d = spark.createDataFrame(rows, "id string, source string, w int, x boolean, y boolean, s int, t int")
    out = B.case_detail(d, ["id"], "source", ["local", "nube"], ["x", "y"], "w", ["s", "t"])
    assert sorted(map(tuple, out.collect())) == [("k", 120, 1, 4.5, 90, 2, 3.0), ("m", None, None, None, 10, 0, None)]
    assert B.case_detail(d.limit(0), ["id"], "source", ["local"], ["x"], "w", ["s"]).collect() == []
