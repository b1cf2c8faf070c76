"""Small tables on which earlier versions gave other rows than their SQL, or grew faster than their input."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from eventide import catalog
from eventide.operators import asof, grid, inference, rank, skill, trajectory, verify
from eventide.plans import queries  # noqa: F401
from eventide.sources import bulletins, scratch


def test_strokes_end_with_the_grid(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 8.0, 0.0), (2, 0, 20.0, 20.0), (2, 1, 30.0, 20.0)], "line int, seq int, x double, y double")
    got = {tuple(r) for r in grid.rasterise(p, ["line"], "seq", "x", "y", 1.0, (-1, 3, 2, 5)).collect()}
    assert got == {(1, 0, j) for j in range(2, 6)}


def test_query_marks_the_grid_of_its_sql(spark, tmp_path):
    events = [(i, f"2024-01-0{1 + i}", 7, v) for i, v in enumerate([480.0, 560.0])]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "'view' AS event_type", "value", """'{"k": 20}' AS props""").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["ilat"], r["ilon"]) for r in catalog.QUERIES["grd_rasterise"](spark, str(tmp_path)).collect()}
    assert got == {(2, j) for j in range(48, 52)}


def bulletin(stamp, *tokens):
    return f"CODSUS\nVALID {stamp}Z {' '.join(tokens)} $"


def test_repeated_bulletins_count_once(spark):
    one, other = bulletin("010203", "COLD", "40100", "41101"), bulletin("010206", "WARM", "30090", "31091")
    df = spark.createDataFrame([(1, one), (2, one), (3, other), (4, other), (5, other)], "id long, text string")
    for tie in (None, "id"):
        got = bulletins.points_of(df, "text", F.lit(2016), tie).groupBy("kind").count().collect()
        assert {r["kind"]: r["count"] for r in got} == {"cold": 2, "warm": 2}


def test_equally_complete_bulletins_go_by_the_tie(spark):
    df = spark.createDataFrame([(i, bulletin("010203", "COLD", f"40{100 + i}")) for i in range(8)], "id long, text string")
    assert bulletins.points_of(df, "text", F.lit(2016), "id").first()["lon"] == -107.0


def test_bulletins_of_conversations_with_equal_texts(spark, tmp_path):
    """Texts repeat every 10,080 conversations."""
    spark.createDataFrame([(c, t) for c in (5, 5 + 10_080) for t in range(3)], "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {tuple(r) for r in catalog.QUERIES["src_bulletin_points"](spark, str(tmp_path)).collect()} == {("cold", 4), ("warm", 2)}


def test_containment_takes_its_means_once(spark):
    members = spark.createDataFrame([(1, float(i), 0.0) for i in range(40)], "g int, x double, y double")
    found = trajectory.containment(members, ["g"], "x", "y")
    assert "avg" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(found.first()) == (1, 19.5, 0.0, 17.5)


@pytest.mark.parametrize(("counts", "want"), [((0, 5, 0, 0), (math.nan, 1.0, math.nan, math.inf)), ((0, 0, 0, 4), (0.0, math.nan, math.nan, 0.0)), ((0, 5, 0, 4), (0.0, 1.0, 0.0, 1.25)), ((3, 1, 3, 3), (0.5, 0.25, 1 / (2 + 4 / 3 - 1), 4 / 6)), ((None,) * 4, (None,) * 4)])
def test_scores_of_nothing_are_those_of_division(spark, counts, want):
    names = ("pred_hit", "pred_miss", "truth_hit", "truth_miss")
    df = spark.createDataFrame([tuple(None if c is None else float(c) for c in counts)], ", ".join(f"{n} double" for n in names))
    got = verify.scores(df, [], ieee=True).first()
    assert [got[c] for c in ("pod", "far", "csi", "fb")] == ([None] * 4 if want[0] is None else pytest.approx(want, nan_ok=True))
    plain = verify.scores(df, []).first()
    assert [plain[c] for c in ("pod", "far", "csi", "fb")] == [None if w is None or not math.isfinite(w) else pytest.approx(w) for w in want]


def test_brackets_do_not_look_ahead_row_by_row(spark):
    """A frame that only shrinks is summed anew for each row: quadratic in a key's rows."""
    left, right = spark.range(5).selectExpr("1 AS k", "id", "id * 10 AS t"), spark.createDataFrame([(1, 10, 1.0), (1, 10, 0.5), (1, 30, 3.0), (1, 36, 9.0)], "k int, u long, v double")
    found = asof.interpolated_or_nearest(left, right, ["k"], "t", "u", "v", 10, 7, "w")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["t"]: r["w"] for r in found.collect()} == {0: None, 10: 0.5, 20: None, 30: 3.0, 40: 9.0}


@pytest.mark.parametrize("most", [3, 1000])
def test_deposits_take_a_bounded_number_of_points_a_task(spark, most):
    points = spark.createDataFrame([(None if i < 20 else i, float(i % 4), 1.0, 0.6, 1.0) for i in range(60)], "k int, y double, x double, s double, m double").coalesce(1)
    found = trajectory.deposit(points, ["k"], "y", "x", "s", "m", most=most)
    assert found.rdd.getNumPartitions() >= 60 / most
    got = found.groupBy("k").agg(F.sum("mass").alias("m")).collect()
    assert {r["k"]: r["m"] for r in got} == {None: pytest.approx(20)} | {k: pytest.approx(1) for k in range(20, 60)}
    assert found.count() == found.select("k", "ilat", "ilon").distinct().count()


@pytest.mark.parametrize("most", [3, 200_000])
@pytest.mark.parametrize("bins", [7])
def test_bins_inside_common_values_follow_the_tie(spark, monkeypatch, most, bins):
    """Against plain ranks: common and rare values, keys, missing and repeated ties."""
    monkeypatch.setattr(rank, "SORTED", most)
    rng = random.Random(bins)
    data = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, 2, 3, rng.randint(4, 9)])), rng.choice([None, *range(40)])) for _ in range(160)]
    df = spark.createDataFrame(data, "k string, v double, i long")
    place = lambda r: (r[1], -1 if r[2] is None else r[2])
    want = []
    for k in "ab":
        own = [r for r in data if r[0] == k]
        want += [(*r, sum(place(o) < place(r) for o in own) * bins // len(own)) for r in own]
    got = rank.equal_count_bins(df, ["k"], "v", "i", bins).select("k", "v", "i", "bin").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_common_values_are_not_ranked_row_by_row(spark, monkeypatch):
    """One value with most rows: its bins come from selected ties; no window runs over its rows."""
    monkeypatch.setattr(rank, "SORTED", 10)
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"))
    out = rank.equal_count_bins(df, [], "v", "id", 8)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["bin"]: r["count"] for r in out.groupBy("bin").count().collect()} == dict.fromkeys(range(8), 250)


@pytest.fixture
def many_ranges(spark):
    """Small tables are sorted in several ranges too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_count_every_row(spark, many_ranges):
    numbers = [random.Random(1).choice([None, *range(90)]) for _ in range(400)]
    found = rank.places(spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v int").repartition(3), [F.col("v").asc_nulls_last(), F.col("i")]).collect()
    want = sorted(range(400), key=lambda i: (numbers[i] is None, numbers[i] or 0, i))
    assert [r["i"] for r in sorted(found, key=lambda r: r["place"])] == want and sorted(r["place"] for r in found) == list(range(400))
    assert rank.places(spark.createDataFrame([], "v int"), [F.col("v")]).count() == 0


def test_columns_share_one_permutation_inside_groups(spark, many_ranges):
    rows = [(None if i % 3 == 0 else i % 3, i * 5 % 301, float(i), -i) for i in range(301)]
    got = {r["k"]: (r["_v"], r["_w"]) for r in inference.with_others(spark.createDataFrame(rows, "g int, k long, v double, w int"), ["v", "w"], "k", 5, ["g"]).collect()}
    for g in (None, 1, 2):
        group = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        others = sorted(group, key=lambda r: int(hashlib.md5(f"5:{r[1]}".encode()).hexdigest()[:15], 16))
        assert [got[r[1]] for r in group] == [r[2:] for r in others]
    assert len(got) == 301


def test_permuted_keeps_the_rows_of_repeated_and_null_keys(spark):
    rows = [(None if i < 3 else i // 2, float(i)) for i in range(60)]
    out = inference.permuted(spark.createDataFrame(rows, "k long, v double"), "v", "k", 5).collect()
    assert sorted(r["v"] for r in out) == [r[1] for r in rows] and sorted(r["k"] or 0 for r in out) == sorted(r[0] or 0 for r in rows)


def test_permutation_importance_reads_and_permutes_its_rows_once(spark, tmp_path):
    """The parsed rows, both sorted tables and the scores' groups are written; before, the plan parsed and hashed them in each branch."""
    events = [(i, "2024-01-02", 7, i * 37 % 101 / 4, f'{{"k": {i * 11 % 13}}}') for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, value double, props string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "'view' AS event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["inf_permutation_importance"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "md5" not in plan
    targets = sorted(e[3] * (e[0] * 11 % 13) for e in events)
    cut = targets[179] + 0.1 * (targets[180] - targets[179])
    others = sorted(events, key=lambda e: int(hashlib.md5(f"11:{e[0]}".encode()).hexdigest()[:15], 16))
    flags = [e[3] * (e[0] * 11 % 13) > cut for e in events]
    for r in found.collect():
        scores = [(o if r["permuted"] == "predictor" else e)[3] * (1 + (o if r["permuted"] == "control" else e)[0] * 11 % 13 / 50) for e, o in zip(events, others, strict=True)]
        pairs = sum((a > b) + (a == b) / 2 for a, f in zip(scores, flags, strict=True) if f for b in scores)
        assert r["n"] == 200 and r["n_events"] == sum(flags) and r["gini"] == pytest.approx(2 * pairs / (200 * sum(flags)) - 1, abs=1e-6)
    assert found.count() == 3


def test_permutation_importance_of_no_rows(spark):
    df = spark.createDataFrame([], "k long, v double, w double, flag boolean")
    got = inference.permutation_importance(df, ["v", "w"], lambda c: c["v"] + c["w"], "flag", "k", 1).collect()
    assert sorted(tuple(r) for r in got) == [(n, None, None, None) for n in ("none", "v", "w")]


def test_few_keys_give_the_same_gini(spark):
    groups = spark.createDataFrame([(k, float(v), 1 + v % 3, v % 2) for k in "ab" for v in range(200)], "k string, v double, n long, e long")
    assert sorted(skill.gini_of_groups(groups, ["k"], "v").collect()) == sorted(skill.gini_of_groups(groups, ["k"], "v", few=True).collect())


def rearranged(df):
    """The same rows, dealt over partitions anew whenever they are read: as parts reach several executors in any order."""
    deal = F.udf(lambda: random.SystemRandom().randrange(5), "int").asNondeterministic()
    return df.withColumn("_deal", deal()).repartition(5, "_deal").drop("_deal")


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("few", [False, True])
def test_selection_counts_and_sorts_the_same_gaps(spark, monkeypatch, keys, few):
    """Cuts that are computed anew for the rows that go on differ from those whose gaps were counted."""
    monkeypatch.setattr(rank, "ACCURACY", 20)
    monkeypatch.setattr(rank, "EVEN", 4)
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1237 % 4001).cast("double").alias("_v"))
    asked = spark.range(0, 2000, 53).select(F.col("id").alias("_rank"))
    asked = df.select(*keys).distinct().crossJoin(asked) if keys else asked
    own = {k: sorted(r["_v"] for r in df.collect() if not keys or r["k"] == k) for k in (0, 1)}
    found = rank.selected(rearranged(df), asked, keys, [0.25, 0.5, 0.75], 100, few).collect()
    assert len(found) == asked.count() and all(r["_v"] == own[r["k"] if keys else 0][r["_rank"]] for r in found)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("few", [False, True])
def test_totals_of_ranges_are_those_of_their_rows(spark, keys, few):
    """Edges are evaluated once, whatever the joins: computed anew for the rows, they may differ from those whose totals were added."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1237 % 40_009).alias("v"), (F.col("id") % 7).alias("n"))
    want, sums = {}, {}
    for k, v, n in sorted(map(tuple, df.collect()), key=lambda r: r[1]):
        want[k, v] = sums.get(k if keys else 0, 0)
        sums[k if keys else 0] = want[k, v] + n
    found = rank.running_totals(rearranged(df), keys, "v", ["n"], 128, few)
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["k"], r["v"]): r["before_n"] for r in found.collect()} == want


def test_bins_of_rows_in_any_order(spark, monkeypatch):
    """Rare and common values of two scores, ties selected, every table read in another order each time: the bins of a plain ranking."""
    monkeypatch.setattr(rank, "SORTED", 100)
    monkeypatch.setattr(rank, "ACCURACY", 20)
    monkeypatch.setattr(rank, "EVEN", 4)
    monkeypatch.setattr(rank, "written", lambda df, what: rearranged(scratch.written(df, what)))
    scores = F.array(*[F.struct(F.lit(n).alias("s"), v.cast("double").alias("v")) for n, v in (("slot", F.col("id") % 3), ("value", F.col("id") * 1237 % 4001))])
    df = spark.range(4000).select("id", F.explode(scores).alias("t")).select("id", "t.*")
    want = {}
    for s in ("slot", "value"):
        own = sorted((r["v"], r["id"]) for r in df.where(F.col("s") == s).collect())
        want |= {(s, i): j * 16 // 4000 for j, (_, i) in enumerate(own)}
    assert {(r["s"], r["id"]): r["bin"] for r in rank.equal_count_bins(df, ["s"], "v", "id", 16).collect()} == want


@pytest.mark.parametrize("name", ["bat_folders", "bat_tail_curves"])
def test_curves_and_folders_of_rows_in_any_order(spark, monkeypatch, tmp_path, name):
    """Scores with common values, every table of the ranking read in another order each time: the rows of the SQL."""
    monkeypatch.setattr(rank, "SORTED", 100)
    monkeypatch.setattr(rank, "ACCURACY", 20)
    monkeypatch.setattr(rank, "EVEN", 4)
    monkeypatch.setattr(rank, "written", lambda df, what: rearranged(scratch.written(df, what)))
    rng = random.Random(6)
    events = [(i, f"2024-01-02 {rng.randrange(24):02d}:00:00", 7, rng.choice([1.0, 2.0, rng.randrange(9000) / 100]), f'{{"k": {rng.randrange(1, 4)}}}') for i in range(900)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, value double, props string").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "'view' AS event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(sql)
