import pytest
from pyspark.sql import functions as F

from commune.functions import ceil_score, ip_to_long, long_to_ip, reported_score


def test_ip_round_trip(spark):
    df = spark.createDataFrame([("10.10.10.10", 10101010)], "ip STRING, x BIGINT")
    r = df.select(ip_to_long(F.col("ip")).alias("v"), long_to_ip(F.col("x")).alias("s")).first()
    assert r.v == 168430090
    assert r.s == "0.154.33.18"


@pytest.mark.parametrize("bad", ["10.10.10.256", "::1", "10.1", "host.example"])
def test_ip_rejects_non_dotted_quad(spark, bad):
    df = spark.createDataFrame([(bad,)], "ip STRING")
    with pytest.raises(Exception, match="not a dotted quad"):
        df.select(ip_to_long(F.col("ip"))).collect()


def test_long_to_ip_uses_low_32_bits(spark):
    df = spark.createDataFrame([(4294967296 + 1,), (-1,)], "x BIGINT")
    assert [r[0] for r in df.select(long_to_ip(F.col("x"))).collect()] == ["0.0.0.1", "255.255.255.255"]


def test_score_hand_values(spark):
    df = spark.createDataFrame([(2, 1, 2), (3, 2, 3), (1, 0, 5), (2, 0, 0)], "n BIGINT, a BIGINT, t BIGINT")
    s = [r[0] for r in df.select(ceil_score(F.col("n"), F.col("a"), F.col("t"), 5)).collect()]
    assert s[0] == pytest.approx(0.2)
    assert s[1] == pytest.approx(2 * 4 / (2 * 3 * 5))
    assert s[2] == 0.0 and s[3] == 0.0   # singleton, and t = 0 guarded (no NaN)
    r = [x[0] for x in df.select(reported_score(F.col("n"), F.col("a"), F.col("t"), 5)).collect()]
    assert r[0] == pytest.approx(2 * 1 / (1 * 3 * 5))
