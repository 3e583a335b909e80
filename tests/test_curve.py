import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curveloom.functions import curve as C


def key(p, bits):
    return int.from_bytes(C.interleave(C.to_transposed(np.array([p]), bits), bits)[0].tobytes(), "big")


@pytest.mark.parametrize(
    ("point", "bits", "index"),
    [((0, 0, 0), 3, 0), ((1, 2, 3), 3, 48), ((7, 7, 7), 3, 365), ((7, 0, 0), 3, 511), ((5, 6, 2), 3, 295), ((5, 10, 20), 5, 7865), ((31, 0, 31), 5, 28086), ((1, 2, 3, 4), 4, 3940), ((5, 9, 2, 14, 0, 7, 11, 3), 4, 1676646721), ((1000, 1, 500, 750, 23, 999), 10, 1027111126234129751), ((1, 65535, 32768, 40000, 7, 12345, 54321, 256), 16, 0x5C72484EA8AB556A556A4BB5AAAC5245)],
)
def test_golden(point, bits, index):
    assert key(point, bits) == index


def test_golden_table():
    want = [[0, 3, 4, 5], [1, 2, 7, 6], [14, 13, 8, 9], [15, 12, 11, 10]]
    assert [[key((i, j), 2) for j in range(4)] for i in range(4)] == want
    wide = C.interleave(C.to_transposed(np.array([[(37 * i + 11) % 1024 for i in range(100)]]), 10), 10)[0].tobytes().hex()
    assert len(wide) == 250 and wide.startswith("0002aaa0002aaa0005554000") and wide.endswith("937be93be249490bc811a332")


@pytest.mark.parametrize(("dims", "bits"), [(2, 2), (2, 6), (3, 3), (4, 4)])
def test_round_trip_and_adjacency(dims, bits):
    n = 1 << dims * bits
    width = -(-dims * bits // 8)
    raw = np.frombuffer(b"".join(i.to_bytes(width, "big") for i in range(n)), np.uint8).reshape(n, width)
    p = C.from_transposed(C.deinterleave(raw, bits, dims), bits)
    assert (np.abs(np.diff(p.astype(int), axis=0)).sum(axis=1) == 1).all()
    assert (C.interleave(C.to_transposed(p, bits), bits) == raw).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 12), st.integers(1, 20), st.data())
def test_prefix(dims, bits, data):
    p = np.array([data.draw(st.lists(st.integers(0, (1 << bits) - 1), min_size=dims, max_size=dims))])
    low = data.draw(st.integers(1, bits))
    assert key(p[0], bits) >> dims * (bits - low) == key(p[0] >> (bits - low), low)


def test_bits_and_columns(spark):
    df = spark.createDataFrame([(1, [5, 10, 20]), (2, None)], "id long, coords array<int>")
    rows = df.select("id", C.curve_key(F.col("coords"), 3, 5).alias("k"), C.curve_key(F.col("coords"), 3, 31).alias("w")).orderBy("id").collect()
    assert rows[0].k == 7865 and len(rows[0].w) == 12 and rows[1].k is None and rows[1].w is None
    back = df.where("coords is not null").select(C.curve_point(C.curve_key(F.col("coords"), 3, 31), 3, 31).alias("c")).first().c
    assert back == [5, 10, 20]
    got = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)], "n long").select(C.bits_needed(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 2, 2, 3, 10, 11]
