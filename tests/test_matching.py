"""One-to-one matches by value."""

from verityloom.operators import elements


def test_values_meet_whatever_their_order_and_equal_positions_first(spark):
    a = spark.createDataFrame([("k", 1, 1), ("k", 5, 2), ("k", 5, 3), ("m", None, 1)], "k string, v int, p int")
    b = spark.createDataFrame([("k", 5, 3), ("k", 7, 1), ("l", 1, 1), ("m", None, 4)], "k string, v int, p int")
    got = {
        (
            r.k, r.v, r.expected and r.expected.p, r.observed and r.observed.p
        ) for r in elements.matched_by_value(a, b, ["k"], "v", ["p"]).collect()
    }
    assert got == {
        ("k", 5, 3, 3), ("k", 1, 1, None), ("k", 5, 2, None), ("k", 7, None, 1), ("l", 1, None, 1), ("m", None, 1, 4)
    }
