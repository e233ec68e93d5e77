"""Binary snapshots: what is written comes back, and only the bytes that are asked for are read."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import orrery as o
from orrery.sources.gadget import COLUMNS, FAMILIES, Header, Layout, files_of, frame_bytes, plan, read_gadget, write_gadget


@pytest.fixture(scope="module")
def snap(spark):
    rng = np.random.default_rng(1)
    s = o.from_arrays(spark, {"pos": rng.normal(size=(300, 3)), "vel": rng.normal(size=(300, 3)), "mass": rng.uniform(1, 2, 300)}, boxsize=9.0)
    return s.with_frame(s.df.withColumn("family", F.when(F.col("pid") % 3 == 0, "gas").when(F.col("pid") % 3 == 1, "dm").otherwise("star")))


def test_round_trip_and_pushed_filters(spark, snap, tmp_path):
    path = f"{tmp_path}/s"
    write_gadget(snap, path, files=3)
    assert [f.rsplit("/", 1)[1] for f in files_of(path)] == ["snapshot.0", "snapshot.1", "snapshot.2"]
    back = read_gadget(spark, path, chunk=40)
    names = ["pid", "family", *[c for c in COLUMNS if c != "pid"]]
    assert sorted(map(tuple, back.df.select(names).collect())) == sorted(map(tuple, snap.df.select(names).collect())) and back.properties == {"boxsize": 9.0}
    assert back.df.rdd.getNumPartitions() >= 9 and back.s.df.count() == 100 and o.ParamSum("mass")(back.g) == pytest.approx(o.ParamSum("mass")(snap.g))
    assert back.s.df.rdd.getNumPartitions() == sum(-(-Layout.of(f).header.counts[4] // 40) for f in files_of(path))
    few = read_gadget(spark, path, columns=["mass"], families=["star"])
    assert few.df.columns == ["family", "mass"] and few.df.agg(F.sum("mass")).first()[0] == pytest.approx(o.ParamSum("mass")(snap.s))


def test_only_asked_bytes_are_read(snap, tmp_path):
    path = f"{tmp_path}/s"
    write_gadget(snap, path, files=1)
    (file,) = files_of(path)
    layout = Layout.of(file)
    assert layout.header.totals == layout.header.counts == (100, 100, 0, 0, 100, 0) and layout.header.files == 1
    assert frame_bytes(plan(layout, ["mass"], {"star"}, 10**6)) == 800 and frame_bytes(plan(layout, ["x", "pid"], None, 7)) == 300 * 32
    parts = plan(layout, ["x", "y", "mass"], None, 30)
    assert max(p.count for p in parts) <= 30 and sum(p.count for p in parts) == 300 and len(parts) == 12
    spans = sorted((a, a + n) for p in parts for b, a, n, _ in p.ranges if b == "pos")
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_short_numbers_and_masses_in_the_header(spark, tmp_path):
    """4 bytes a number; dark matter's mass is in the header alone, disc particles count as dark matter."""
    counts, masses = (2, 3, 1, 0, 2, 0), (0.0, 5.0, 0.0, 0.0, 0.0, 0.0)
    n = sum(counts)
    blocks = [np.arange(3 * n, dtype="<f4"), np.arange(3 * n, dtype="<f4") + 100, np.arange(n, dtype="<u4") + 7, np.array([1, 2, 3, 4, 5], "<f4")]
    with open(f"{tmp_path}/one", "wb") as f:
        for r in [Header(counts, masses, 1.0, 0.0, counts, 1, 0.0).pack(), *[b.tobytes() for b in blocks]]:
            f.write(struct.pack("<I", len(r)) + r + struct.pack("<I", len(r)))
    s = read_gadget(spark, f"{tmp_path}/one", chunk=2)
    rows = s.df.orderBy("pid").collect()
    assert [r.mass for r in rows] == [1, 2, 5, 5, 5, 3, 4, 5] and [r.x for r in rows] == [3.0 * i for i in range(n)] and [r.vz for r in rows] == [3.0 * i + 102 for i in range(n)]
    assert [r.family for r in rows] == [FAMILIES[k] for k, c in enumerate(counts) for _ in range(c)] and s.properties == {}
    with open(f"{tmp_path}/bad", "wb") as f:
        f.write(b"\0" * 300)
    with pytest.raises(ValueError, match="layout"):
        read_gadget(spark, f"{tmp_path}/bad")
