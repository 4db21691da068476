"""Tracks of other tokens, stretches of tracks, SQL over a corpus, coercion, channels and layouts by chain."""

import random
import wave

import pytest
from pyspark.sql import functions as F

from fixtures import talk
from test_store import recording
from tierlake.errors import AttributeMissing, QueryError
from tierlake.operators import tracks, windows
from tierlake.sources.layout import Arranged, arrange
from tierlake.sources.readers import load_corpus


def voiced(spark):
    c = talk(spark)
    rows = [("walk", "ana", round(t / 100, 2), float(t)) for t in range(600)]
    c.save_acoustic_track("f0", spark.createDataFrame(rows, "discourse string, speaker string, time double, hz double"))
    return c, rows


def test_tracks_of_words_above_and_of_neighbours(spark):
    c, rows = voiced(spark)
    p = c.phone
    found = c.query(p).filter(p.discourse.name == "walk", p.speaker.name == "ana").columns(p.id, p.begin, p.end, p.f0.mean.column_name("own"), p.word.f0.max.column_name("word"), p.following.f0.min, p.word.begin.column_name("b"), p.word.end.column_name("e")).all()
    spans = sorted((r.node_phone_begin, r.node_phone_end) for r in found)
    inside = lambda a, b: [v for _, _, t, v in rows if a <= t <= b]
    for r in found:
        own = inside(r.node_phone_begin, r.node_phone_end)
        assert r.own == pytest.approx(sum(own) / len(own)) and r.word == max(inside(r.b, r.e))
        after = [s for s in spans if s[0] > r.node_phone_begin]
        assert r.following_min_f0 == (min(inside(*after[0])) if after else None)
    with pytest.raises(QueryError):
        c.query(c.word).columns(c.word.phone.f0.mean).frame()


def test_stretches_of_a_track(spark):
    c, rows = voiced(spark)
    got = [(r.time, r.hz) for r in c.acoustic_measure("f0", "walk", 0.1, 0.3).orderBy("time").collect()]
    assert got == [(t, v) for _, _, t, v in rows if 0.1 <= t <= 0.3] and len(got) == 21
    tagged = c.acoustic_measure("f0", "walk", 0, 6, phone_label="e", speaker=["ana", "bo"])
    assert {r.hz for r in tagged.collect()} == {r.hz for r in c.tracks["f0"].where("phone_label = 'e'").collect()} and tagged.count() > 0
    parts = c.acoustic_measure("f0", "walk", 5.5, 7.5, num_points=4, relative_time=True).orderBy("time").collect()
    assert [r.time for r in parts] == [0, 0.25, 0.5, 0.75] and parts[0].hz == pytest.approx(574.5) and parts[1].hz is None and parts[3].hz is None
    assert c.acoustic_measure("f0", "rest", 0, 6).count() == 0
    with pytest.raises(AttributeMissing):
        c.acoustic_measure("f0", "walk", 0, 1, mood="x")
    with pytest.raises(QueryError):
        c.acoustic_measure("f0", "walk", 1, 1)
    c.encode_utterances(0.5)
    c.reassess_utterances("f0")
    one = c.tokens["utterance"].where("discourse = 'walk' and speaker = 'ana'").orderBy("begin").first()
    assert c.utterance_acoustics("f0", one.id).count() == sum(one.begin <= t <= one.end for _, _, t, _ in rows)
    assert c.utterance_acoustics("f0", discourse="walk", speaker="ana").count() == 600


def test_sql_over_the_tables(spark):
    c, _ = voiced(spark)
    got = c.sql("SELECT w.label, count(*) AS n FROM {phone} p JOIN {word} w ON p.word_id = w.id GROUP BY w.label").collect()
    assert {r.label: r.n for r in got}["mela"] == 8
    assert c.sql("SELECT max(hz) AS m FROM {track_f0}").first().m == 599.0 and c.sql("SELECT count(*) AS n FROM {speakers}").first().n == 2
    with pytest.raises(AttributeMissing):
        c.sql("SELECT * FROM {nothing}")


def test_values_become_what_the_schema_declares(spark):
    c = talk(spark)
    c.types["word"] = spark.createDataFrame([("mela", 1, 0.5, True, "7"), ("tok", 2, 1.5, False, "8")], "label string, size int, freq double, noun boolean, code string")
    w = c.word
    assert (w.size.value_type, w.freq.value_type, w.noun.value_type, w.code.value_type, w.begin.value_type) == (int, float, bool, str, None)
    n = lambda *f: c.query(c.word).filter(*f).count()
    assert n(w.size == "2") == n(w.size == 2) == 3 and n(w.noun == "true") == 2 and n(w.code == 7) == 2 and n(w.freq > "1") == 3 and n(w.size.in_(["1", 2])) == 5 and n(w.size > 1.5) == 3 and n(w.code != None) == 5  # noqa: E711
    for bad in (lambda: w.size == "two", lambda: w.noun == "maybe", lambda: w.freq.in_([1.0, "x"]), lambda: w.size == True):  # noqa: E712
        with pytest.raises(QueryError):
            bad()


def test_speakers_are_dealt_to_channels(spark, tmp_path):
    for name, channels in (("two", 2), ("one", 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as sound:
            sound.setnchannels(channels)
            sound.setsampwidth(2)
            sound.setframerate(8000)
            sound.writeframes(b"\0" * 3200 * channels)
    for name in ("two", "one", "none"):
        recording(tmp_path, name, ["ab", "c"])
        text = (tmp_path / f"{name}.TextGrid").read_text()
        head, body = text.split("item []:\n")
        tiers = [body.replace('"words"', f'"{s} - words"').replace('"phones"', f'"{s} - phones"') for s in ("zoe", "ann", "mia")]
        (tmp_path / f"{name}.TextGrid").write_text(head.replace("size = 2", "size = 6") + "item []:\n" + "".join(tiers))
    c = load_corpus(spark, str(tmp_path), "t", "mfa", sounds=str(tmp_path))
    got = {(r.discourse, r.speaker): r.channel for r in c.speaks_in.collect()}
    assert got == {**{("two", s): k for s, k in (("zoe", 0), ("ann", 1), ("mia", 1))}, **{(d, s): 0 for d in ("one", "none") for s in ("zoe", "ann", "mia")}}


def test_chains_laid_out_need_no_exchange(spark, tmp_path):
    chance = random.Random(1)
    rows = [(i, f"d{chance.randint(0, 5)}", chance.choice("ab"), round(chance.uniform(0, 1000), 2)) for i in range(2000)] + [(5000, "d1", "a", None)]
    df = spark.createDataFrame(rows, "id int, discourse string, speaker string, begin double")
    keys = ["discourse", "speaker"]
    laid = arrange(df, str(tmp_path / "tokens"), keys, "begin", 4, 100.0)
    points = arrange(df.select(*keys, F.col("begin").alias("time"), "id"), str(tmp_path / "points"), keys, "time", 4, 100.0)
    plan = lambda d: d._jdf.queryExecution().executedPlan()
    near = windows.neighbours(laid.frame(), keys, ["begin", "id"], ["id"])
    assert "Exchange" not in plan(near).toString()
    assert sorted(map(str, near.collect())) == sorted(map(str, windows.neighbours(df, keys, ["begin", "id"], ["id"]).collect()))
    counts = laid.frame().groupBy(*keys).agg(F.count("*").alias("n"))
    per_chain = counts.join(points.frame().groupBy(*keys).agg(F.max("time").alias("last")), keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(per_chain).toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def files(d):
        p = plan(d)
        p.execute().count()
        leaf = p.collectLeaves().head()
        return leaf.metrics().get("numFiles").get().value()

    some = laid.between(200, 299.9)
    assert sorted(r.id for r in some.collect()) == sorted(i for i, _, _, t in rows if t is not None and 200 <= t <= 299.9)
    assert files(some) <= 4 < 40 <= files(laid.frame())
    # another session opens it by its path
    other = Arranged.open(spark.newSession(), str(tmp_path / "tokens"))
    assert other == Arranged(other.spark, laid.path, laid.keys, "begin", 4, 100.0) and other.frame().count() == 2001
    spark.sql(f"DROP TABLE {laid.name}")
    again = Arranged.open(spark, str(tmp_path / "tokens"))
    assert again.frame().count() == 2001 and "Exchange" not in plan(windows.neighbours(again.frame(), keys, ["begin", "id"], ["id"])).toString()


def test_ranges_at_whole_numbers(spark):
    """A sum that isn't exact doesn't decide on which side of a whole number a mean is."""
    df = spark.createDataFrame([("u", v) for v in (39.99999999999999, 40.0, 40.0)], "k string, f double").coalesce(1)
    assert [tuple(r) for r in tracks.speaker_range(df, "f", ["k"], floor=10, ceiling=150).collect()] == [("u", 20, 80)]
