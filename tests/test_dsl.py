"""Queries of a small corpus against loops over the same rows."""

import itertools
import statistics

import pytest

from tierlake.corpus import Corpus
from tierlake.errors import AttributeMissing, QueryError, SubsetMissing
from tierlake.plans.dsl import Average, Count, InterquartileRange, Max, Median, Min, Quantile, Stdev, Sum, and_, or_

from fixtures import NUCLEI, levels, talk

ROWS = levels()
PHONES, WORDS, LINES = ROWS["phone"], ROWS["word"], ROWS["line"]
WORD_OF = {w["id"]: w for w in WORDS}


def below(word):
    return [p for p in PHONES if p["word_id"] == word["id"]]


def chains(rows):
    key = lambda r: (r["discourse"], r["speaker"])
    return [sorted(g, key=lambda r: r["begin"]) for _, g in itertools.groupby(sorted(rows, key=key), key)]


def near(rows, by):
    """id -> the row `by` places further in its chain, or None."""
    return {r["id"]: chain[i + by] if 0 <= i + by < len(chain) else None for chain in chains(rows) for i, r in enumerate(chain)}


def ids(q):
    return sorted(r["id"] for r in q.frame().select("id").collect())


def which(rows, test):
    return sorted(r["id"] for r in rows if test(r))


@pytest.fixture()
def c(spark):
    return talk(spark)


def test_filters(c):
    p = c.phone
    q = lambda *f: ids(c.query(p).filter(*f))
    assert q(p.label == "e") == which(PHONES, lambda r: r["label"] == "e")
    assert q(p.label != "e", p.begin >= 1, p.begin < 4) == which(PHONES, lambda r: r["label"] != "e" and 1 <= r["begin"] < 4)
    assert q(p.label.in_(["e", "k"]), p.duration > 0.13) == which(PHONES, lambda r: r["label"] in "ek" and r["end"] - r["begin"] > 0.13)
    assert q(p.label.not_in_(["e", "k"])) == which(PHONES, lambda r: r["label"] not in "ek")
    assert q(or_(p.label == "o", and_(p.label == "m", p.begin < 1))) == which(PHONES, lambda r: r["label"] == "o" or r["label"] == "m" and r["begin"] < 1)
    assert ids(c.query(c.word).filter(c.word.label.regex("[a-m]e.*"))) == which(WORDS, lambda r: r["label"][0] <= "m" and r["label"][1:2] == "e")
    # a second == on the same attribute replaces the first
    assert ids(c.query(p).filter(p.label == "e").filter(p.label == "k")) == which(PHONES, lambda r: r["label"] == "k")
    assert q(p.speaker.name == "bo", p.discourse.name == "walk", p.label == "m") == which(PHONES, lambda r: r["speaker"] == "bo" and r["label"] == "m")


def test_neighbours(c):
    w, before, after = c.word, near(WORDS, -1), near(WORDS, 1)
    rows = c.query(w).columns(w.id, w.previous.label, w.following.following.label.column_name("two_on")).all()
    two = near(WORDS, 2)
    assert {tuple(r) for r in rows} == {(r["id"], before[r["id"]] and before[r["id"]]["label"], two[r["id"]] and two[r["id"]]["label"]) for r in WORDS}
    assert ids(c.query(w).filter(w.previous.label == w.following.label)) == which(WORDS, lambda r: before[r["id"]] and after[r["id"]] and before[r["id"]]["label"] == after[r["id"]]["label"])
    assert ids(c.query(w).filter(w.following.label == w.label)) == which(WORDS, lambda r: after[r["id"]] and after[r["id"]]["label"] == r["label"])
    # a neighbour that a filter names must exist
    assert ids(c.query(w).filter(w.previous.label != "tok")) == which(WORDS, lambda r: before[r["id"]] and before[r["id"]]["label"] != "tok")
    q = c.query(c.phone).filter(c.phone.word.following.label == "tok").columns(c.phone.id)
    assert sorted(r[0] for r in q.all()) == which(PHONES, lambda r: after[r["word_id"]] and after[r["word_id"]]["label"] == "tok")


def test_levels_above_and_below(c):
    w, p = c.word, c.phone
    assert ids(c.query(p).filter(p.word.label == "mela", p.line.label == "second")) == which(PHONES, lambda r: WORD_OF[r["word_id"]]["label"] == "mela" and r["line_id"] == "second")
    rows = c.query(w).columns(w.id, w.phone.label, w.phone.count, w.phone.rate, w.phone.initial.label, w.phone.final.label, w.phone.penultimate.label, w.phone.antepenultimate.label).all()
    for r in rows:
        own = [x["label"] for x in below(WORD_OF[r[0]])]
        at = lambda i: own[i] if -len(own) <= i < len(own) else None  # noqa: B023, E731
        assert (r[1], r[2], *r[4:]) == (own, len(own), at(0), at(-1), at(-2), at(-3))
        assert r[3] == pytest.approx(len(own) / (WORD_OF[r[0]]["end"] - WORD_OF[r[0]]["begin"]))
    # a filter on tokens below narrows what is shown of them
    rows = c.query(w).filter(w.phone.label.in_(["e", "o"])).columns(w.id, w.phone.label, w.phone.count).all()
    want = {r["id"]: [x["label"] for x in below(r) if x["label"] in "eo"] for r in WORDS}
    assert {r[0]: (r[1], r[2]) for r in rows} == {k: (v, len(v)) for k, v in want.items() if v}


def test_alternatives_with_tokens_below(c):
    w = c.word
    assert ids(c.query(w).filter(or_(w.phone.label == "a", w.label == "nothing"))) == which(WORDS, lambda r: any(x["label"] == "a" for x in below(r)))
    assert ids(c.query(w).filter(or_(w.phone.label == "a", w.label == "um"))) == which(WORDS, lambda r: r["label"] == "um" or any(x["label"] == "a" for x in below(r)))
    assert ids(c.query(c.line).filter(or_(c.line.word.label == "kanto", c.line.label == "third"))) == ["second", "third"]
    # words without phones stay, if another alternative holds
    c.tokens["phone"] = c.tokens["phone"].where("word_id is not null and label <> 'u' and label <> 'm'")
    assert ids(c.query(w).filter(or_(w.phone.label == "a", w.label == "um"))) == which(WORDS, lambda r: r["label"] == "um" or any(x["label"] == "a" for x in below(r)))


def test_tokens_below_against_attributes(c):
    w = c.word
    assert ids(c.query(w).filter(w.phone.label == w.label)) == which(WORDS, lambda r: any(x["label"] == r["label"] for x in below(r)))
    assert ids(c.query(w).filter(w.label == w.phone.label)) == which(WORDS, lambda r: r["label"] == "o")
    rows = c.query(w).filter(w.phone.end < w.end).columns(w.id, w.phone.label, w.phone.count).all()
    want = {r["id"]: [x["label"] for x in below(r) if x["end"] < r["end"]] for r in WORDS}
    assert {r[0]: (r[1], r[2]) for r in rows} == {k: (v, len(v)) for k, v in want.items() if v}
    assert ids(c.query(w).filter(w.contains("phone", "k", "s"))) == which(WORDS, lambda r: any(x["label"] in "ks" for x in below(r)))
    shown = c.query(w).filter(w.contains("phone", "k"), w.label == "tok").columns(w.phone.label).all()
    assert [r[0] for r in shown] == [["t", "o", "k"]] * 3


def test_order_and_subqueries_inside_alternatives(c):
    w = c.word
    chain = lambda r: (r["discourse"], r["speaker"])
    earlier = lambda r: chain(r) == chain(WORD_OF["w3"]) and r["begin"] < WORD_OF["w3"]["begin"]
    assert ids(c.query(w).filter(w.precedes("w3"))) == which(WORDS, earlier)
    assert ids(c.query(w).filter(w.follows("w8"))) == ["w10", "w9"]
    assert ids(c.query(w).filter(w.not_precedes("w3"))) == which(WORDS, lambda r: not earlier(r))
    assert ids(c.query(w).filter(w.not_follows("w8"))) == which(WORDS, lambda r: r["id"] not in ("w9", "w10"))
    assert ids(c.query(w).filter(or_(w.precedes("w3"), w.label == "lem"))) == which(WORDS, lambda r: earlier(r) or r["label"] == "lem")
    inner = lambda: c.query(c.phone).filter(c.phone.label == "k").columns(c.phone.word.id.column_name("word_id"))
    with_k = {x["word_id"] for x in PHONES if x["label"] == "k"}
    assert ids(c.query(w).filter(w.id.in_(inner()))) == sorted(with_k)
    assert ids(c.query(w).filter(w.id.not_in_(inner()))) == which(WORDS, lambda r: r["id"] not in with_k)
    assert ids(c.query(w).filter(or_(w.id.in_(inner()), w.label == "um"))) == which(WORDS, lambda r: r["id"] in with_k or r["label"] == "um")
    assert ids(c.query(w).filter(or_(w.id.not_in_(inner()), w.begin == 0.6))) == which(WORDS, lambda r: r["id"] not in with_k or r["begin"] == 0.6)


def test_alignment(c):
    p = c.phone
    first, last = ({f(below(w), key=lambda x: x["begin"])["id"] for w in WORDS} for f in (min, max))
    assert ids(c.query(p).filter(p.begin == p.word.begin)) == sorted(first)
    assert ids(c.query(p).filter(p.begin != p.word.begin)) == which(PHONES, lambda r: r["id"] not in first)
    assert ids(c.query(p).filter_right_aligned(p.word)) == sorted(last)
    assert ids(c.query(p).filter_not_right_aligned(p.word)) == which(PHONES, lambda r: r["id"] not in last)
    assert ids(c.query(p).filter(or_(p.begin == p.word.begin, p.label == "o"))) == which(PHONES, lambda r: r["id"] in first or r["label"] == "o")
    rows = c.query(p).columns(p.id, p.word.phone.position).all()
    assert {r[0]: r[1] for r in rows} == {x["id"]: i + 1 for w in WORDS for i, x in enumerate(below(w))}


def test_aggregates(c):
    p = c.phone
    q = lambda: c.query(p).filter(p.label == "o")
    durations = [r["end"] - r["begin"] for r in PHONES if r["label"] == "o"]
    begins = sorted(r["begin"] for r in PHONES if r["label"] == "o")
    assert q().aggregate(Count()) == len(begins) and q().aggregate(Min(p.begin)) == begins[0] and q().aggregate(Max(p.begin)) == begins[-1]
    assert q().aggregate(Median(p.begin)) == begins[(len(begins) + 1) // 2 - 1] and q().aggregate(Quantile(p.begin, 0.25)) == begins[-(-len(begins) // 4) - 1]
    assert q().aggregate(Average(p.duration)) == pytest.approx(statistics.mean(durations)) and q().aggregate(Stdev(p.duration)) == pytest.approx(statistics.stdev(durations))
    assert q().aggregate(InterquartileRange(p.begin)) == pytest.approx(begins[-(-3 * len(begins) // 4) - 1] - begins[-(-len(begins) // 4) - 1])
    groups = {}
    after = near(PHONES, 1)
    for r in PHONES:
        if r["label"] == "e" and after[r["id"]]:
            groups.setdefault(after[r["id"]]["label"], []).append(r["end"] - r["begin"])
    rows = c.query(p).filter(p.label == "e").group_by(p.following.label.column_name("next")).aggregate(Average(p.duration), Count()).collect()
    assert {r["next"]: (r["average_duration"], r["count_all"]) for r in rows} == {k: (pytest.approx(statistics.mean(v)), len(v)) for k, v in groups.items()}
    by_label = {}
    for r in WORDS:
        by_label.setdefault(r["label"], []).append(r)
    rows = c.query(c.word).group_by(c.word.label.column_name("l")).filter(Count() >= 2).aggregate(Count()).collect()
    assert {r["l"]: r["count_all"] for r in rows} == {k: len(v) for k, v in by_label.items() if len(v) >= 2}
    rows = c.query(c.word).columns(c.word.id, Sum(c.word.phone.begin).column_name("s"), Average(c.word.phone.duration).column_name("a")).all()
    assert {r[0]: r[1] for r in rows} == {w["id"]: pytest.approx(sum(x["begin"] for x in below(w))) for w in WORDS}
    assert {r[0]: r[2] for r in rows} == {w["id"]: pytest.approx(statistics.mean(x["end"] - x["begin"] for x in below(w))) for w in WORDS}


def test_sorting_and_pages(c):
    q = lambda: c.query(c.word).columns(c.word.id).order_by(c.word.begin, descending=True).order_by(c.word.id)
    order = [r["id"] for r in sorted(sorted(WORDS, key=lambda r: r["id"]), key=lambda r: -r["begin"])]
    assert [r[0] for r in q().offset(1).limit(3).all()] == order[1:4]
    assert [r[0] for r in q().page(1, 5)] == order[5:10] and [r[0] for r in q().rows()] == order
    assert c.query(c.word).union(c.query(c.word)).count() == 2 * len(WORDS)
    with pytest.raises(QueryError):
        c.query(c.word).get()


def test_subsets_and_changes(c):
    c.encode_class(NUCLEI, "syllabic")
    w = c.word
    nuclei = which(PHONES, lambda r: r["label"] in NUCLEI)
    assert ids(c.query(c.phone).filter(c.phone.subset == "syllabic")) == ids(c.query(c.phone.filter_by_subset("syllabic"))) == nuclei
    rows = c.query(w).columns(w.id, w.phone.filter_by_subset("syllabic").label, w.phone.filter_by_subset("syllabic").count).all()
    own = {r["id"]: [x["label"] for x in below(r) if x["label"] in NUCLEI] for r in WORDS}
    assert {r[0]: (r[1], r[2]) for r in rows} == {k: (v, len(v)) for k, v in own.items()}
    assert ids(c.query(w).filter(w.phone.subset == "syllabic", w.label == "lem")) == ["w10"]
    c.query(w).filter(w.label == "um").create_subset("filler")
    assert ids(c.query(w).filter(w.subset == "filler")) == which(WORDS, lambda r: r["label"] == "um")
    c.query(w).filter(w.begin < 1).remove_subset("filler")
    c.query(w).filter(w.label == "um").set_properties(kind="filler", weight=2)
    assert ids(c.query(w).filter(w.kind == "filler", w.weight == 2)) == which(WORDS, lambda r: r["label"] == "um")
    c.query(w).set_properties(kind=None)
    assert "kind" not in c.tokens["word"].columns
    with pytest.raises(AttributeMissing):
        w.kind  # noqa: B018
    c.query(w).filter(w.label == "um").delete()
    assert ids(c.query(w)) == which(WORDS, lambda r: r["label"] != "um")
    c.reset_class("syllabic")
    with pytest.raises(SubsetMissing):
        c.phone.filter_by_subset("syllabic")


def test_pauses(c):
    c.encode_pauses(["um"])
    w, speech = c.word, [r for r in WORDS if r["label"] != "um"]
    assert ids(c.query(w)) == sorted(r["id"] for r in speech) and ids(c.query(c.pause)) == which(WORDS, lambda r: r["label"] == "um")
    before, after = near(WORDS, -1), near(WORDS, 1)
    assert ids(c.query(w).filter(w.follows_pause == True)) == which(speech, lambda r: before[r["id"]] and before[r["id"]]["label"] == "um")  # noqa: E712
    assert ids(c.query(w).filter(w.precedes_pause == True)) == which(speech, lambda r: after[r["id"]] and after[r["id"]]["label"] == "um")  # noqa: E712
    row = c.query(w).filter(w.id == "w7").columns(w.following.label, w.following_pause.label, w.following_pause.duration).get()
    assert (row[0], row[1]) == ("lem", ["um", "um"]) and row[2] == pytest.approx(WORD_OF["w9"]["end"] - WORD_OF["w8"]["begin"])


def test_types_entities_and_metadata(c, spark):
    c.enrich_types("word", spark.createDataFrame([("MELA", 5, "noun"), ("tok", 7, "noun")], "label string, frequency int, part string"))
    assert sorted(r["label"] for r in c.query(c.lexicon_word).filter(c.lexicon_word.frequency > 4).all()) == ["mela", "tok"]
    assert ids(c.query(c.word).filter(c.word.frequency == 5)) == which(WORDS, lambda r: r["label"] == "mela")
    c.enrich_speakers(spark.createDataFrame([("ana", 30), ("bo", 40)], "name string, age int"))
    assert ids(c.query(c.word).filter(c.word.speaker.age > 30)) == which(WORDS, lambda r: r["speaker"] == "bo")
    rows = c.query_speakers().filter(c.speaker.age < 35).columns(c.speaker.name.column_name("name"), c.speaker.discourses.column_name("in_")).all()
    assert [tuple(r) for r in rows] == [("ana", ["rest", "walk"])]
    rows = c.query_discourses().columns(c.discourse.name.column_name("name"), c.discourse.speakers.column_name("who")).all()
    assert sorted(map(tuple, rows)) == [("rest", ["ana"]), ("walk", ["ana", "bo"])]
    c.query_speakers().filter(c.speaker.name == "bo").set_properties(dialect="north")
    assert [r["name"] for r in c.query_speakers().filter(c.speaker.dialect == "north").all()] == ["bo"]
    about = c.query_metadata(c.word)
    assert {"label", "part"} <= set(about.factors()) and {"begin", "end", "frequency"} <= set(about.numerics()) and "label" in about.grouping_factors()
    assert sorted(r[0] for r in about.levels("part").collect()) == ["noun"]
    assert tuple(about.range("begin").first()) == (0.0, max(r["begin"] for r in WORDS))


def test_subannotations_and_preload(c, spark):
    rows = [("a", "p1.0", 0.62, 0.66), ("b", "p1.0", 0.65, 0.61)]
    c.add_subannotations("phone", "vot", spark.createDataFrame(rows, "id string, annotated_id string, begin double, end double"))
    row = c.query(c.phone).filter(c.phone.id == "p1.0").columns(c.phone.vot.duration, Sum(c.phone.vot.begin).column_name("s")).get()
    assert sorted(round(x, 3) for x in row[0]) == [0.04, 0.04] and row[1] == pytest.approx(1.23)
    row = c.query(c.phone).filter(c.phone.id == "p1.0").preload(c.phone.word, c.phone.following).columns(c.phone.label).get()
    assert row["node_phone_word"].label == "tok" and row["node_phone_following"].label == "o" and row["node_phone_label"] == "t"
    with pytest.raises(AttributeMissing):
        c.phone.nothing  # noqa: B018


def test_tracks_are_stored(c, spark, tmp_path):
    values = [("walk", "ana", round(0.01 * i, 2), 100.0 + i % 7) for i in range(80)] + [("walk", "bo", 2.55, 90.0)]
    c.save_acoustic_track("pitch", spark.createDataFrame(values, "discourse string, speaker string, time double, f0 double"))
    inside = lambda r: [v for d, s, t, v in values if d == r["discourse"] and s == r["speaker"] and r["begin"] <= t <= r["end"]]
    row = c.query(c.word).filter(c.word.id == "w1").columns(c.word.pitch.min, c.word.pitch.max, c.word.pitch.mean, c.word.pitch.stdev, c.word.pitch).get()
    own = inside(WORD_OF["w1"])
    assert row[:2] == (min(own), max(own)) and row[2] == pytest.approx(statistics.mean(own)) and row[3] == pytest.approx(statistics.stdev(own)) and len(row[4]) == len(own)
    assert row[4][0]["relative_time"] == pytest.approx(0) and 0 < row[4][-1]["relative_time"] <= 1
    c.encode_acoustic_statistic("pitch", "f0", "mean")
    c.encode_acoustic_statistic("pitch", "f0", "max", level="phone", by_speaker=False)
    c.relativise_track("pitch", "f0", ["speaker"])
    again = Corpus.open(spark, c.save(str(tmp_path), 1))
    assert again.has_acoustics("walk", "pitch") and not again.has_acoustics("rest", "pitch") and again.tracks["pitch"].count() == len(values)
    assert {r["name"]: r["mean_f0"] for r in again.speakers.collect()} == {"ana": pytest.approx(statistics.mean(v[3] for v in values if v[1] == "ana")), "bo": 90.0}
    assert again.query(again.phone).filter(again.phone.max_f0 > 0).count() > 0 and ids(again.query(again.word)) == sorted(WORD_OF)
    assert {r["f0_relativized"] is None for r in again.tracks["pitch"].collect() if r["speaker"] == "bo"} == {True}
    again.reset_relativised_track("pitch", "f0")
    assert "f0_relativized" not in again.tracks["pitch"].columns
    c.encode_utterances(0.3)
    c.reassess_utterances("pitch")
    assert c.tracks["pitch"].where("utterance_id is not null").count() > 0
    c.reset_acoustics()
    assert not c.tracks and not c.schema.tracks


def test_properties_by_time_with_two_speakers(c, spark):
    rows = spark.createDataFrame([("walk", 2.95, "x"), ("walk", 1.45, "y"), ("rest", 0.6, "z")], "discourse string, time double, mark string")
    c.enrich_tokens_at("word", rows)
    got = {r["id"]: r["mark"] for r in c.tokens["word"].collect() if r["mark"]}
    assert got == {"w8": "x", "w3": "y", "w11": "z"}


def test_measures_are_stored(c):
    span = lambda r: r["end"] - r["begin"]
    types, both = {}, {}
    for r in PHONES:
        types.setdefault(r["label"], []).append(span(r))
        both.setdefault((r["label"], r["speaker"]), []).append(span(r))
    assert {r[0]: r[1] for r in c.measure("phone").collect()} == {k: pytest.approx(statistics.mean(v)) for k, v in types.items()}
    c.encode_measure("phone", "stdev", by_speaker=True)
    c.encode_measure("phone", "mean")
    c.encode_baseline("word")
    c.encode_relativized("phone")
    c.encode_relativized("word", by_speaker=True)
    sd = lambda v: statistics.stdev(v) if len(v) > 1 else None
    z = lambda x, v: (x - statistics.mean(v)) / sd(v) if (sd(v) or 0) > 1e-9 else None
    for r in c.query(c.phone).columns(c.phone.id, c.phone.sd_duration_by_speaker, c.phone.mean_duration, c.phone.relativized_duration).all():
        own = next(p for p in PHONES if p["id"] == r[0])
        want = sd(both[own["label"], own["speaker"]])
        assert r[1] == (want if want is None else pytest.approx(want, abs=1e-9)) and r[2] == pytest.approx(statistics.mean(types[own["label"]]))
        if (score := z(span(own), types[own["label"]])) is not None:
            assert r[3] == pytest.approx(score)
    rows = c.query(c.word).columns(c.word.id, c.word.baseline_duration, c.word.relativized_duration_by_speaker).all()
    assert {r[0]: r[1] for r in rows} == {w["id"]: pytest.approx(sum(statistics.mean(types[x["label"]]) for x in below(w))) for w in WORDS}
    c.reset_property("phone", "mean_duration", "relativized_duration")
    assert "relativized_duration" not in c.tokens["phone"].columns and "mean_duration" not in c.types["phone"].columns


def test_utterances_syllables_and_stress(c):
    c.encode_pauses(["um"])
    words = c.utterance_words(0.5).orderBy("discourse", "speaker", "utterance").collect()
    assert [(r["first_id"], r["last_id"]) for r in words] == [("w11", "w12"), ("w0", "w3"), ("w4", "w6"), ("w7", "w7"), ("w10", "w10")]
    c.encode_utterances(0.5)
    c.encode_class(NUCLEI, "syllabic")
    c.encode_utterance_position()
    c.encode_speech_rate("syllabic")
    rates = {(r["discourse"], r["speaker"], r["begin"]): r["speech_rate"] for r in c.tokens["utterance"].collect()}
    assert rates["walk", "ana", 4.0] == pytest.approx(5 / (WORD_OF["w6"]["end"] - 4.0))
    mean = {r[0]: r[1] for r in c.average_speech_rate("phone", "syllabic").collect()}
    assert mean["bo"] == pytest.approx(statistics.mean(v for k, v in rates.items() if k[1] == "bo"))
    assert {r["id"]: r["position_in_utterance"] for r in c.tokens["word"].collect()}["w6"] == 3
    c.reset_utterance_position()
    c.reset_speech_rate()
    assert "position_in_utterance" not in c.tokens["word"].columns and "speech_rate" not in c.tokens["utterance"].columns
    c.encode_position("word", "phone", "vowel_place", "syllabic")
    assert {r["id"]: r["vowel_place"] for r in c.tokens["phone"].collect()}["p0.3"] == 2
    c.encode_syllables(NUCLEI)
    count = {r[0]: r[1] for r in c.tokens["syllable"].groupBy("word_id").count().collect()}
    assert count == {w["id"]: sum(x["label"] in NUCLEI for x in below(w)) for w in WORDS}
    c.query(c.word).filter(c.word.label == "kanto").set_properties(pattern="1-0")
    c.encode_stress_from_word_property("pattern")
    got = {(r["word_id"], r["place"]): r["stress"] for r in c.tokens["syllable"].collect()}
    assert (got["w6", 1], got["w6", 2]) == ("1", "0") and got["w0", 1] is None
    c.reset_syllables()
    assert not c.has_syllables and "syllable_id" not in c.tokens["phone"].columns
