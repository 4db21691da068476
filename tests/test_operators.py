import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierlake.corpus import Corpus
from tierlake.functions.syllables import log_shares, split_at_longest_onset, split_by_probability, syllabify
from tierlake.operators import enrich, formants, measures, pauses, rangejoin, syllables, tracks

from fixtures import NUCLEI, talk


def test_onsets_and_codas(spark):
    words = syllables.phone_lists(talk(spark).tokens["phone"])
    onsets = {tuple(r[0]): r[1] for r in syllables.onsets(words, NUCLEI).collect()}
    codas = {tuple(r[0]): r[1] for r in syllables.codas(words, NUCLEI).collect()}
    assert onsets == {("m",): 2, ("t",): 3, (): 4, ("s", "t", "r"): 2, ("k",): 1, ("l",): 1}
    assert codas == {(): 4, ("k",): 3, ("m",): 4, ("l",): 2}
    for run, at in (("nt", 1), ("lstr", 1), ("xz", 2), ("kt", 1)):
        assert split_at_longest_onset(list(run), set(onsets)) == at
    assert split_by_probability(list("kt"), log_shares(onsets), log_shares(codas)) == 1
    column = syllables.longest_onset_split(F.split("c", ""), [list(x) for x in onsets])
    got = {r.c: r.at for r in spark.createDataFrame([("nt",), ("lstr",), ("xz",)], "c string").select("c", column.alias("at")).collect()}
    assert got == {"nt": 1, "lstr": 1, "xz": 2}


@given(st.lists(st.sampled_from("aeptk"), max_size=12))
def test_syllables_cover_words(phones):
    found = syllabify(phones, {"a", "e"}, {(), ("t",), ("t", "k")})
    places = [i for s in found for i in range(s.first, s.stop)]
    assert places == list(range(len(phones)))
    assert sum(s.nucleus >= 0 for s in found) == sum(p in "ae" for p in phones)


def test_encode_syllables(spark):
    c = talk(spark)
    c.encode_syllables(NUCLEI)
    rows = c.query(c.syllable).columns(c.syllable.label).all()
    assert sorted(r[0] for r in rows) == sorted(["m.e", "l.a"] * 2 + ["t.o.k", "u.m"] * 3 + ["s.t.r.e.l"] * 2 + ["o", "k.a.n", "t.o", "l.e.m"])
    assert c.query(c.phone).filter(c.phone.syllable_position == "onset").count() == 16


def test_words_without_a_nucleus(spark):
    rows = [(f"p{i}", x, i / 10, (i + 1) / 10, "w") for i, x in enumerate("strt")]
    phones = spark.createDataFrame(rows, "id string, label string, begin double, end double, word_id string")
    for method, parts in (("maxonset", "oooc"),):
        found = syllables.encode_syllables(phones, ["a"], method, [["s", "t", "r"], ["s"]]).orderBy("begin", "phone_id").collect()
        assert "".join(r.part[0] for r in sorted(found, key=lambda r: r.phone_id)) == parts


def words(spark, text):
    rows = [(str(i), p[0], float(p[1]), float(p[2]), "d", "s", p[0] == "sil") for i, p in enumerate(x.split() for x in text.split(";"))]
    return spark.createDataFrame(rows, "id string, label string, begin double, end double, discourse string, speaker string, is_pause boolean")


def test_utterances(spark):
    table = words(spark, "a 0 1;sil 1 1.3;b 1.3 2;sil 2 2.5;c 2.5 2.7;sil 2.7 4;d 4 6")
    get = lambda *a: [(r.begin, r.end, r.n_words) for r in pauses.utterances(table, *a).orderBy("begin").collect()]
    assert get(0.0) == [(0, 1, 1), (1.3, 2, 1), (2.5, 2.7, 1), (4, 6, 1)]
    assert get(0.5) == [(0, 2, 2), (2.5, 2.7, 1), (4, 6, 1)]
    assert get(0.5, 0.3) == [(0, 2.7, 3), (4, 6, 1)]
    # nearer to what follows: dropped
    table = words(spark, "a 0 1;c 3 3.1;d 4 6")
    assert [(r.begin, r.end) for r in pauses.utterances(table, 0.5, 0.3).orderBy("begin").collect()] == [(0, 1), (4, 6)]


def test_corpus_utterances_and_rates(spark):
    c = talk(spark)
    c.encode_utterances(0.5)
    got = {(r.discourse, r.speaker, r.begin, round(r.end, 2)) for r in c.tokens["utterance"].collect()}
    assert got == {("walk", "ana", 0.0, 2.1), ("walk", "ana", 4.0, 5.7), ("walk", "bo", 2.5, 3.86), ("rest", "ana", 0.5, 1.56)}
    c.encode_rate("utterance", "word", "speech_rate")
    c.encode_position("utterance", "word", "position_in_utterance")
    rows = c.query(c.word).filter(c.word.speaker.name == "ana", c.word.discourse.name == "walk").columns(c.word.position_in_utterance, c.word.utterance.speech_rate).order_by(c.word.begin).all()
    assert [r[0] for r in rows] == [1, 2, 3, 4, 1, 2, 3] and rows[0][1] == pytest.approx(4 / 2.1)
    c.reset_utterances()
    assert not c.has_utterances


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=8, unique=True))
def test_asof_against_brute_force(spark, points, marks):
    p = spark.createDataFrame([(k, float(t), i) for i, (k, t) in enumerate(points)], "k int, t double, i int")
    m = spark.createDataFrame([(k, float(b), b) for k, b in marks], "k int, b double, mark int")
    got = {r.i: r.mark for r in rangejoin.asof(p, m, ["k"], "t", "b", ["mark"]).collect()}
    assert got == {i: max((b for j, b in marks if j == k and b <= t), default=None) for i, (k, t) in enumerate(points)}


def test_tracks(spark):
    rows = [("d", "s", 4.23 + i / 100, v) for i, v in enumerate([98.0, 100.0, 99.0, 95.8, 95.8])]
    track = spark.createDataFrame(rows, "discourse string, speaker string, time double, f0 double")
    z = [r.f0_relativized for r in tracks.relativise(track, "f0", ["speaker"]).orderBy("time").collect()]
    assert z[0] == pytest.approx((98 - 97.72) / 1.88997, abs=1e-4)
    token = spark.createDataFrame([("x", "d", "s", 4.23, 4.27)], "id string, discourse string, speaker string, begin double, end double")
    got = tracks.interpolated(track, token, ["discourse", "speaker"], "f0", 5).orderBy("place").collect()
    assert [round(r.value, 3) for r in got] == [98.0, 100.0, 99.0, 95.8, 95.8]
    means = tracks.buckets(track, token, ["discourse", "speaker"], "f0", 2).orderBy("bucket").collect()
    assert len(means) == 2 and not math.isnan(means[0]["mean"])
    left = tracks.replace_range(track, track.where("time > 4.245 AND time < 4.255").withColumn("f0", F.lit(1.0)), ["discourse", "speaker"])
    assert left.count() == 5 and left.where("f0 = 1.0").count() == 1


def test_csv_properties(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("Word\tpart of speech\tfreq\tflag\nmela\tnoun\t3\ttrue\ntok\tverb\tNA\tfalse\nmela\tname\t4\ttrue\n")
    table = enrich.read_properties(spark, str(path))
    assert dict(table.dtypes) == {"word": "string", "part_of_speech": "string", "freq": "bigint", "flag": "boolean"}
    rows = {r.word: (r.part_of_speech, r.freq, r.flag) for r in table.collect()}
    assert rows == {"mela": ("name", 4, True), "tok": ("verb", None, False)}


def test_save_and_open(spark, tmp_path):
    c = talk(spark)
    c.encode_pauses(["um"])
    again = Corpus.open(spark, c.save(str(tmp_path), 1))
    assert again.query(again.word).count() == 10 and again.schema.to_json() == c.schema.to_json()
    again.remove_discourse("walk")
    assert again.query(again.word).count() == 2 and [r["name"] for r in again.speakers.collect()] == ["ana"]


def test_refinement_picks_what_fits(spark):
    chance = np.random.default_rng(3)
    rows = []
    for token in range(40):
        good = chance.integers(0, 4)
        for k in range(4):
            x = (500 + chance.normal(0, 10), 1500 + chance.normal(0, 20)) if k == good or k == 1 and token % 3 else (900 + 50 * k, 400 * k)
            rows.append(("s", "a", token, k, float(x[0]), float(x[1])))
    rows += [("s", "b", 100, 1, 1.0, 1.0), ("s", "b", 100, 2, 2.0, 2.0)]
    table = spark.createDataFrame(rows, "speaker string, vowel string, id long, candidate int, f1 double, f2 double")
    given = {("s", "a"): ([500.0, 1500.0], [[100.0, 0.0], [0.0, 400.0]])}
    got = formants.refined(table, ["f1", "f2"], ["speaker", "vowel"], default=1, prototypes_of=given).collect()
    assert len(got) == 41 and all(abs(r.f1 - 500) < 60 for r in got if r.vowel == "a")
    assert [r.candidate for r in got if r.vowel == "b"] == [1]


def test_quantiles_are_exact(spark):
    chance = random.Random(1)
    rows = [(g, float(chance.choice(range(50)) if g == "ties" else chance.random())) for g in ("ties", "free") for _ in range(3000)] + [("one", 4.0), ("one", None), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in measures.quantiles(table, "v", ["g"], [0.0, 0.4, 1.0]).collect()}
    want = {}
    for g in ("ties", "free", "one"):
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = tuple(v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.0, 0.4, 1.0))
    assert got == want


def test_syllable_queries_take_all_words(spark, tmp_path):
    from tierlake import catalog

    rows = [(1, "steel almond"), (2, "banana strand xyz"), (3, None), (4, "abstracted")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("onset_freq") == {("st", 1), ("", 2), ("b", 1), ("str", 1)}
    assert got("coda_freq") == {("l", 1), ("nd", 2), ("", 1), ("d", 1)}
    assert got("maxonset_split") == {("lm", 2), ("n", 0), ("bstr", 3), ("ct", 1)}
