"""Overlapping spans and chains too long for a task, against plain loops and the window versions."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import talk
from tierlake.operators import rangejoin, scans, tracks, windows


def spans_of(spark, chance, n=80):
    rows = []
    for i in range(n):
        b = round(chance.uniform(0, 50), 2) if chance.random() < 0.9 else float(chance.randint(0, 50))
        rows.append((i, chance.choice("ab"), b, b + chance.choice([0.0, 0.01, 0.5, 3.0, 40.0, 1000.0])))
    rows += [(900, "a", None, 5.0), (901, "a", 3.0, None), (902, None, 0.0, 50.0), (903, "b", 9.0, 8.0)]
    return rows, spark.createDataFrame(rows, "id int, k string, b double, e double")


def points_of(spark, chance, n=150):
    rows = [(i, chance.choice("abc"), float(chance.randint(0, 60)) if chance.random() < 0.5 else round(chance.uniform(-5, 60), 2)) for i in range(n)] + [(900, "a", None), (901, None, 4.0), (3, "a", 7.0), (3, "a", 7.0)]
    return rows, spark.createDataFrame(rows, "p int, k string, t double")


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("pieces", [1, 32])
def test_all_spans_that_contain_a_point(spark, closed, pieces):
    chance = random.Random(pieces)
    spans, s = spans_of(spark, chance)
    points, p = points_of(spark, chance)
    holds = lambda t, b, e: None not in (t, b, e) and b <= t and (t <= e if closed else t < e)
    want = sorted((i, t, n) for i, k, t in points for n, j, b, e in spans if k is not None and k == j and holds(t, b, e))
    got = rangejoin.containing(p, s, ["k"], "t", "b", "e", ["id"], closed, pieces)
    assert sorted((r.p, r.t, r.id) for r in got.collect()) == want and len(want) > 500
    assert rangejoin.containing(p, s.limit(0), ["k"], "t", "b", "e", ["id"]).count() == 0 == rangejoin.containing(p.limit(0), s, ["k"], "t", "b", "e", ["id"]).count()
    # one of them: the one that ends last, then begins last
    last = {}
    for i, k, t in points:
        held = [(e, b, n) for n, j, b, e in spans if k is not None and k == j and holds(t, b, e)]
        last[i, t] = max(held)[2] if held else None
    out = rangejoin.within(p, s, ["k"], "t", "b", "e", ["id"], inner=False, closed=closed).collect()
    assert len(out) == len(points) and all(r.id == last[r.p, r.t] for r in out)
    assert rangejoin.within(p, s, ["k"], "t", "b", "e", ["id"], closed=closed).count() == sum(last[i, t] is not None for i, k, t in points)


def test_no_bin_holds_what_a_long_span_covers(spark):
    """A span over a whole chain meets its points in about `pieces` groups."""
    points = spark.range(10_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"))
    spans = spark.createDataFrame([("k", 0.0, 10_000.0, 1)], "k string, b double, e double, id int")
    met = rangejoin.containing(points, spans, ["k"], "t", "b", "e", ["id"])
    assert met.count() == 10_000
    shuffled = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in shuffled and "_bin" in shuffled and "Cartesian" not in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("busy", [0, 40, rangejoin.BUSY])
def test_spans_that_lie_apart_are_not_copied(spark, busy):
    """Spans that touch, have no length or overlap, points on their borders; chains on both sides of `busy`. Bins are for what isn't free."""
    chance = random.Random(busy)
    spans, at = [], 0.0
    for i in range(120):
        end = at + chance.choice([0.0, 0.0, 1.0, 2.0, 7.0])
        spans.append((i, chance.choice("ab"), at, end))
        at = chance.choice([at, end, end, end + 1.0])
    points = [(i, chance.choice("aab"), float(chance.randint(0, int(at) + 1))) for i in range(120)]
    s, p = spark.createDataFrame(spans, "id int, k string, b double, e double"), spark.createDataFrame(points, "p int, k string, t double")
    for closed in (True, False):
        want = sorted((i, n) for i, k, t in points for n, j, b, e in spans if k == j and b <= t and (t <= e if closed else t < e))
        assert sorted((r.p, r.id) for r in rangejoin.containing(p, s, ["k"], "t", "b", "e", ["id"], closed, busy=busy).collect()) == want
    words = spark.range(1000).select(F.col("id"), F.lit("k").alias("k"), F.col("id").cast("double").alias("b"), (F.col("id") + 1).cast("double").alias("e")).withColumn("_loud", F.lit(None).cast("boolean"))
    own = words.select(F.col("k").alias("_k0"), F.col("b").alias("_b"), F.col("e").alias("_e"), F.struct("id").alias("_m"), "_loud")
    assert rangejoin.apart(own, ["_k0"]).where("not _free").isEmpty()


def test_slices_of_overlapping_tokens(spark):
    tokens = spark.createDataFrame([("a", "k", 0.0, 10.0), ("b", "k", 2.0, 4.0)], "id string, k string, begin double, end double")
    track = spark.createDataFrame([("k", float(t), float(t)) for t in range(12)], "k string, time double, f double")
    got = {(r.id, r.max_f, r.mean_f) for r in tracks.token_statistics(track, tokens, ["k"], "f").collect()}
    assert got == {("a", 10.0, 5.0), ("b", 4.0, 3.0)}


def chain_of(spark, chance, n=700):
    """One chain with most rows, short ones, nulls in times and keys, equal times."""
    rows = [(i, chance.choice(["hot"] * 8 + ["x", "y", None]), None if chance.random() < 0.02 else float(chance.randint(0, 300)), chance.random() < 0.4, round(chance.random() * 4, 2)) for i in range(n)]
    rows = [(i, k, t, p, None if t is None else t + d) for i, k, t, p, d in rows]
    return spark.createDataFrame(rows, "id int, k string, t double, pause boolean, e double")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("pieces", [1, 7, 64])
def test_segmented_scans_equal_windows(spark, pieces):
    df, order = chain_of(spark, random.Random(pieces)), ["t", "id"]
    same(scans.neighbours(df, ["k"], order, ["id", "e"], 3, 2, pieces), windows.neighbours(df, ["k"], order, ["id", "e"], 3, 2))
    same(scans.runs(df, ["k"], order, "pause", pieces), windows.runs(df, ["k"], order, "pause"))
    same(scans.sessions(df, ["k"], order, "t", "e", 1.5, pieces), windows.sessions(df, ["k"], order, "t", "e", 1.5))
    marks = df.where("pause").select("k", "t", F.col("id").alias("mark"))
    for inner in (True, False):
        same(scans.asof(df, marks, ["k"], "t", "t", ["mark"], inner, pieces), rangejoin.asof(df, marks, ["k"], "t", "t", ["mark"], inner))


@pytest.mark.parametrize("closed", [True, False])
def test_segmented_within_equals_the_window(spark, closed):
    chance = random.Random(9)
    _, s = spans_of(spark, chance)
    _, p = points_of(spark, chance)
    for inner in (True, False):
        same(scans.within(p, s, ["k"], "t", "b", "e", ["id"], inner, closed, 7), rangejoin.within(p, s, ["k"], "t", "b", "e", ["id"], inner, closed))


def test_a_corpus_with_cut_chains_answers_alike(spark):
    """Neighbours, pauses, utterances and labels of tracks, chains whole and cut."""

    def answers(pieces):
        c = talk(spark)
        c.pieces = pieces
        c.encode_pauses(["um"])
        c.encode_utterances(0.5, 0.3)
        points = spark.createDataFrame([("walk", "ana", t / 10, float(t)) for t in range(70)], "discourse string, speaker string, time double, f double")
        c.save_acoustic_track("f", points)
        w = c.word
        yield c.query(w).columns(w.id, w.previous.label, w.following.label, w.following.following.begin, w.following_pause.label, w.previous_pause.duration, w.utterance.begin).frame()
        yield c.query(w).filter(w.follows_pause == True).columns(w.id).frame()  # noqa: E712
        yield c.query(c.phone).filter(c.phone.previous.label == "t").columns(c.phone.id, c.phone.word.previous.label).frame()
        yield c.tokens["utterance"]
        yield c.utterance_words(0.5)
        yield c.tracks["f"]

    for whole, cut in zip(answers(0), answers(5)):
        same(whole, cut)


def test_segments_share_a_hot_chain(spark):
    df = spark.range(20_000).select(F.lit("all").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("t"), "id")
    counts = [r["count"] for r in scans.segmented(df, "t", 16).groupBy("k", "_segment").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.3 * 20_000 / 16
    plan = scans.neighbours(df, ["k"], ["t", "id"], ["id"], 1, 0, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k#") - plan.count("_segment#") <= 2
    with pytest.raises(ValueError):
        scans.segmented(df, "t", 0)
