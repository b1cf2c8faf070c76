"""Queries over whole tables: every row of the input counts, compared with plain Python."""

import math
import os
from collections import defaultdict

import pytest

from eventide import catalog
from eventide.plans import queries  # noqa: F401
from eventide.plans.frames import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")


@pytest.fixture(scope="module")
def users(spark):
    """The events of each user in order of time."""
    found = defaultdict(list)
    for r in sorted(rows(spark, DATA).collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        found[r["user_id"]].append(r)
    return found


@pytest.mark.parametrize("name", ["win_path_length_whole", "win_residence_whole", "src_unwrapped_lines_whole"])
def test_every_event_is_a_point_of_its_path(spark, users, name):
    assert catalog.QUERIES[name](spark, DATA).count() == sum(map(len, users.values()))


def test_deposit_takes_every_event(spark, users):
    got = {r["user_id"]: r["m"] for r in catalog.QUERIES["trj_deposit_whole"](spark, DATA).groupBy("user_id").agg({"mass": "sum"}).toDF("user_id", "m").collect()}
    assert got == {u: pytest.approx(len(p), abs=1e-4) for u, p in users.items()}


def test_resample_ends_at_the_last_event(spark, users):
    got = {r["user_id"]: r["t"] for r in catalog.QUERIES["trj_resample"](spark, DATA).groupBy("user_id").agg({"t": "max"}).toDF("user_id", "t").collect()}
    assert got == {u: int(p[-1]["ts"].timestamp()) for u, p in users.items()}


def test_rasterise_matches_brute_force(spark, users):
    want = set()
    for u, p in users.items():
        for a, b in zip(p, p[1:], strict=False):
            x0, y0, x1, y1 = a["predictor"] / 10, a["control"] / 10, b["predictor"] / 10, b["control"] / 10
            length = (x1 - x0) ** 2 + (y1 - y0) ** 2
            for i in range(math.floor(min(y0, y1)) - 1, math.ceil(max(y0, y1)) + 2):
                for j in range(math.floor(min(x0, x1)) - 1, math.ceil(max(x0, x1)) + 2):
                    t = max(0.0, min(1.0, ((j - x0) * (x1 - x0) + (i - y0) * (y1 - y0)) / length)) if length else 0.0
                    if math.hypot(j - x0 - t * (x1 - x0), i - y0 - t * (y1 - y0)) <= 0.5 + 1e-9:
                        want.add((u, i, j))
    assert {tuple(r) for r in catalog.QUERIES["grd_rasterise_whole"](spark, DATA).select("user_id", "ilat", "ilon").collect()} == want


def test_lines_levels_and_days_are_all_there(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    assert catalog.QUERIES["jn_last_at_or_before_whole"](spark, DATA).count() == read("lineitem").count()
    assert catalog.QUERIES["grd_level_mixing_whole"](spark, DATA).count() == 64 * read("embeddings").count()
    m = catalog.QUERIES["agg_matrix_whole"](spark, DATA)
    cells = {(r["day"], r["lat"], r["lon"]) for r in rows(spark, DATA).select("day", "lat", "lon").distinct().collect()}
    assert {(r["day"], r["lat"], k) for r in m.collect() for k in range(12) if r[f"c{k}"] is not None} == cells


def test_covering_head_covers_its_share_beyond_fifty_rows(spark, tmp_path):
    events = [(i, i, f'{{"k": {1 + i % 3}}}') for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, user_id long, props string").selectExpr("event_id", "timestamp'2024-01-10' AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    ordered = sorted(((100 * (1 + i % 3), i) for i in range(400)), key=lambda r: (-r[0], r[1]))
    total, before, want = sum(c for c, _ in ordered), 0, []
    for c, u in ordered:
        if before < 0.3 * total:
            want.append((u, c))
        before += c
    assert len(want) > 50
    assert sorted(map(tuple, catalog.QUERIES["top_covering_head_whole"](spark, str(tmp_path)).collect())) == sorted(want)
