import pytest

from commune.sources.edges import parse_edge_lines


def scan(spark, lines, delimiter=",", ip=False, mode="fail"):
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    return parse_edge_lines(df, delimiter, ip, mode)


@pytest.mark.parametrize("line,expected", [
    ("1,2", (1, 2, 1)),
    ("1,2,7", (1, 2, 7)),
    (" 1 , 2 ", (1, 2, 1)),
    ("1,2,", (1, 2, 1)),
    ("1,2,-3", (1, 2, -3)),
    ("1,2,0", (1, 2, 0)),
    ("\t1\t,2", (1, 2, 1)),
])
def test_good_lines(spark, line, expected):
    assert tuple(scan(spark, [line]).edges.first()) == expected


@pytest.mark.parametrize("line,delimiter", [
    ("1", ","), ("", ","), ("1,2,3,4", ","), ("a,2", ","), ("1.5,2", ","), ("1  2", " "), ("1,2, x", ","),
])
def test_bad_lines_fail(spark, line, delimiter):
    with pytest.raises(Exception, match="cannot read edge"):
        scan(spark, [line], delimiter).edges.collect()


def test_quarantine_reasons(spark):
    r = scan(spark, ["1,2", "1", "a,2", "1,2,x", "1,2,3,4"], mode="quarantine")
    assert [tuple(x) for x in r.edges.collect()] == [(1, 2, 1)]
    reasons = dict((x.line, x.reason) for x in r.rejects.collect())
    assert reasons == {"1": "token_count", "a,2": "bad_integer", "1,2,x": "bad_integer", "1,2,3,4": "token_count"}


def test_ip_ids(spark):
    assert tuple(scan(spark, ["10.10.10.10,0.154.33.18"], ip=True).edges.first()) == (168430090, 10101010, 1)
    for bad in ["10.10.10.256,1.2.3.4", "::1,1.2.3.4"]:
        with pytest.raises(Exception, match="cannot read edge"):
            scan(spark, [bad], ip=True).edges.collect()


def test_regex_delimiter(spark):
    assert tuple(scan(spark, ["1 \t 2\t5"], r"\s+").edges.first()) == (1, 2, 5)
