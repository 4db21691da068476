import os

import pytest
from pyspark.sql import functions as F

from tierlake.corpus import list_corpora
from tierlake.errors import ParseFailure, QueryError
from tierlake.sources import readers, sinks, tiers
from tierlake.streaming import windows

GRID = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 0.9
tiers? <exists>
size = 3
item []:
    item [1]:
        class = "IntervalTier"
        name = "anna - words"
        xmin = 0
        xmax = 0.9
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "say ""hi"" 2"
        intervals [2]:
            xmin = 0.5
            xmax = 0.9
            text = ""
    item [2]:
        class = "IntervalTier"
        name = "anna - phones"
        xmin = 0
        xmax = 0.9
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = "s"
    item [3]:
        class = "TextTier"
        name = "tones"
        xmin = 0
        xmax = 0.9
        points: size = 1
        points [1]:
            number = 0.25
            mark = "H*"
"""


def test_textgrid():
    rows = readers.textgrid(GRID)
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [("anna - words", 'say "hi" 2', 0, 0.5), ("anna - words", "", 0.5, 0.9), ("anna - phones", "s", 0, 0.5), ("tones", "H*", 0.25, 0.25)]
    assert readers.textgrid("") == []
    got = readers.ALIGNERS["mfa"].parse(GRID)
    assert [(r[0], r[1], r[2]) for r in got] == [("word", "anna", 'say "hi" 2'), ("word", "anna", "<SIL>"), ("phone", "anna", "s")]
    with pytest.raises(ParseFailure):
        readers.ALIGNERS["maus"].parse(GRID)


def test_other_formats():
    words = "header\n#\n 0.3 122 cats; k ae t s; k ae t s; NNS\n 0.5 122 {B_TRANS}\n 0.9 122 <VOCNOISE>\n"
    phones = "header\n#\n 0.1 122 k\n 0.2 122 ae\n 0.25 122 s\n 0.5 122 {B}\n 0.9 122 UH\n"
    rows = [r for r in readers.buckeye(words, phones) if r[0] == "word"]
    assert rows[0][2:5] == ("cats", 0.0, 0.25) and rows[0][5]["surface"] == "k ae t s"
    rows = readers.timit("1600 3200 she\n3200 4800 had\n", "0 1600 h#\n1600 3200 sh\n3200 6400 ae\n")
    assert [(r[2], r[3], r[4]) for r in rows if r[0] == "word"] == [("<SIL>", 0.0, 0.1), ("she", 0.1, 0.2), ("had", 0.2, 0.3), ("<SIL>", 0.3, 0.4)]
    rows = readers.partitur("SPN: a1\nORT: 0 ja\nKAN: 0 j'a:\nMAU: 0 999 -1 <p:>\nMAU: 1000 2000 0 j\nMAU: 3000 1000 0 a\n")
    assert ("word", "a1", "ja", 0.1, 0.4, {"transcription": "j'a:"}) in rows
    rows = readers.interlinear("cats run\nk.ae.t.s r.ah.n\n\n", ["orthography", "transcription"])
    assert [r[2] for r in rows if r[0] == "word"] == ["cats", "run"]
    with pytest.raises(ParseFailure):
        readers.interlinear("a b\nc\n", ["x", "y"])
    assert readers.split_transcription("tSaj", digraphs=["tS"]) == ["tS", "a", "j"] and readers.split_transcription("k.ae", ".") == ["k", "ae"]


def test_load_guess_and_errors(spark, tmp_path):
    os.mkdir(tmp_path / "anna")
    (tmp_path / "anna" / "one.TextGrid").write_text(GRID)
    (tmp_path / "anna" / "two.TextGrid").write_text("something else")
    loaded = readers.load(spark, str(tmp_path), "mfa")
    assert {(r.discourse, r.speaker, r.tier) for r in loaded.tokens.collect()} == {("one", "anna", "word"), ("one", "anna", "phone")}
    assert [r.path.rsplit("/", 1)[1] for r in loaded.errors.collect()] == ["two.TextGrid"]
    assert set(loaded.tiers()) == {"word", "phone"}
    durations = spark.createDataFrame([("a", "x", 0.0, 0.25), ("b", "y", 0.0, 0.08)], "tier string, label string, begin double, end double")
    assert {r.tier: r.kind for r in readers.guess_tiers(durations).collect()} == {"a": "word", "b": "segment"}
    assert readers.guess_type(spark.createDataFrame([("k.ae",), ("b.a",), ("3",)], "v string"), "v").first()[0] == "transcription"


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "n int, l array<string>, s string")
    sinks.write_csv(df.orderBy("n"), str(tmp_path / "out"), one_file=True)
    text = next(p for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv")).read_text()
    assert text.splitlines()[0] == "n,l,s" and text.splitlines()[1].startswith("1,a/b,")
    track = spark.createDataFrame([("w", [(4.23456, 98.0)])], "word string, track array<struct<time:double,f0:double>>")
    assert tuple(sinks.with_track(track, "track").first()) == ("w", 4.2346, 98.0)
    (tmp_path / "d1.csv").write_text("time,f1\n0.0104,500\n0.02,\n")
    rows = readers.tracks_from_csv(spark, str(tmp_path / "d1.csv")).orderBy("time").collect()
    assert [tuple(r) for r in rows] == [("d1", 0.01, 500.0), ("d1", 0.02, None)]


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts, 1 AS user_id, cast(s AS double) AS value FROM VALUES (0), (10), (100) AS t(s)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.utterances(stream, "30 seconds", "1 minute", "user_id").writeStream.format("memory").queryName("u").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.bucket_means(rows, "value", "60 seconds", "1 minute", "user_id").orderBy("begin").collect()
    assert [(r.n, r["mean"]) for r in batch] == [(2, 5.0), (1, 100.0)]
    assert [r.n for r in windows.utterances(rows, "30 seconds", "1 minute", "user_id").orderBy("begin").collect()] == [2, 1]


def test_tier_specs_and_points(spark, tmp_path):
    rows = [("w", "one", 0.0, 0.5), ("w", "two", 0.5, 1.0), ("p", "a", 0.0, 0.2), ("p", "b", 0.2, 0.5), ("p", "c", 0.5, 1.0), ("tone", "H*", 0.25, 0.25), ("pos", "NN", 0.5, 1.0), ("gloss", "eins", 0.0, 0.5)]
    table = spark.createDataFrame([(*r, "s", "d") for r in rows], "tier string, label string, begin double, end double, speaker string, discourse string")
    spec = tiers.TierSpec
    c = tiers.build(spark, "t", table, [spec("w", "word"), spec("p", "phone"), spec("tone", "word", "subannotation"), spec("pos", "word", "token_property"), spec("gloss", "word", "type_property")], ["phone", "word"])
    got = {r[0]: tuple(r[1:]) for r in c.query(c.word).columns(c.word.label, c.word.pos, c.word.gloss, c.word.tone.label).all()}
    assert got == {"one": (None, "eins", ["H*"]), "two": ("NN", None, None)}
    c.query(c.phone).set_properties(f1=500.0)
    tiers.export_points(c, "phone", ["f1"], str(tmp_path / "points"))
    c.query(c.phone).set_properties(f1=None)
    tiers.import_points(c, "phone", str(tmp_path / "points"), ["f1"])
    assert {r.f1 for r in c.tokens["phone"].collect()} == {500.0}
    c.save(str(tmp_path / "store"), 1)
    assert list_corpora(spark, str(tmp_path / "store")) == ["t"] and list_corpora(spark, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        spec("x", "word", "nothing")


def test_tiers_of_morphemes_transcriptions_and_groups(spark):
    rows = [("w", "redo", 0.0, 0.4), ("w", "ships", 0.5, 1.0), ("m", "re-do", 0.0, 0.4), ("m", "ship=s", 0.5, 1.0), ("t", "r.e.d.o", 0.0, 0.4), ("t", "sh.i.ps", 0.5, 1.0), ("breath", "ignored", 0.0, 1.0)]
    table = spark.createDataFrame([(*r, "s", "d") for r in rows], "tier string, label string, begin double, end double, speaker string, discourse string")
    spec = tiers.TierSpec
    specs = [spec("w", "word"), spec("m", "word", "morphemes"), spec("t", "word", "transcription", "heard", delimiter=".", below="phone"), spec("breath", "breath", "grouping")]
    c = tiers.build(spark, "t", table, specs, ["phone", "word", "breath"])
    got = {r[0]: tuple(r[1:]) for r in c.query(c.word).columns(c.word.label, c.word.morphemes, c.word.heard, c.word.phone.label).all()}
    assert got == {"redo": (["re", "do"], "r.e.d.o", ["r", "e", "d", "o"]), "ships": (["ship", "s"], "sh.i.ps", ["sh", "i", "ps"])}
    assert [round(r.begin, 6) for r in c.tokens["phone"].where("word_id is not null").orderBy("begin").collect()][:4] == [0.0, 0.1, 0.2, 0.3]
    assert c.query(c.phone).filter(c.phone.breath.label == None).count() == 7  # noqa: E711
    with pytest.raises(ValueError, match="level below"):
        spec("t", "word", "transcription")
    with pytest.raises(ValueError, match="tier of its own"):
        tiers.build(spark, "t", table, [*specs, spec("p", "phone")], ["phone", "word", "breath"])


def test_segments_by_the_engine_equal_those_of_one_value(spark):
    values = ["tshan", "a.b..c", "", None, "s h", "(x)y", "ng-ng"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for delimiter, digraphs, ignored in ((None, ("tsh", "sh", "ng"), ""), (".", (), ""), (None, (), "()")):
        got = [r[0] for r in df.select(readers.segments_of(F.col("v"), delimiter, digraphs, ignored)).collect()]
        assert got == [None if v is None else readers.split_transcription(v, delimiter, digraphs, ignored) for v in values]
    assert [r[0] for r in df.select(readers.morphemes_of(F.col("v"))).collect()] == [None if v is None else readers.split_morphemes(v) for v in values]


def test_inspection_and_corpus_of_a_folder(spark, tmp_path):
    (tmp_path / "in" / "anna").mkdir(parents=True)
    for i in range(2):
        (tmp_path / "in" / "anna" / f"d{i}.TextGrid").write_text(GRID)
    (tmp_path / "in" / "anna" / "note.txt").write_text("some words")
    found = readers.inspect_directory(spark, str(tmp_path / "in"))
    assert found == {"mfa": 2, "orthography": 1} and readers.guess_textgrid_format(["ORT", "MAU", "KAN"]) == "maus" and readers.guess_textgrid_format(["a", "b"]) == "textgrid"
    c = readers.load_corpus(spark, str(tmp_path / "in"), "x")
    assert c.schema.contains == {"phone": "word", "word": None} and c.query(c.word).count() == 4 and c.query(c.phone).filter(c.phone.word.label.regex("say.*")).count() == 2
    other = readers.load_corpus(spark, str(tmp_path / "in" / "anna" / "d1.TextGrid"), "y", "mfa")
    with pytest.raises(QueryError):
        c.add(other)
    c.remove_discourse("d1")
    c.add(other)
    assert c.query(c.word).count() == 4 and {r["name"] for r in c.discourses.collect()} == {"d0", "d1"}
    (tmp_path / "in" / "anna" / "bad.TextGrid").write_text('"nothing"')
    with pytest.raises(ParseFailure, match="bad"):
        readers.load_corpus(spark, str(tmp_path / "in"), "x", "mfa")
    with pytest.raises(ParseFailure):
        readers.load_corpus(spark, str(_empty(tmp_path)), "x")


def _empty(tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.unknown").write_text("?")
    return tmp_path / "none"


def test_transcriptions_and_guesses(spark):
    got = readers.parse_transcription("k.a1.n-t.o0", ".", morphemes="-", numbers="stress")
    assert [(r["label"], r["morpheme"], r.get("stress")) for r in got] == [("k", "0", None), ("a", "0", "1"), ("n", "0", None), ("t", "1", None), ("o", "1", "0")]
    assert [r["label"] for r in readers.parse_transcription("tsha2n", digraphs=["tsh"], numbers="tone")] == ["tsh", "a", "n"]
    assert readers.split_morphemes("un-do=ing") == ["un", "do", "ing"]
    table = lambda values: spark.createDataFrame([(v,) for v in values], "v string")
    kind = lambda values: readers.guess_type(table(values), "v").first().kind
    assert kind(["1", "2.5", "x"]) == "numeric" and kind(["H*", "L%", "L-H%"]) == "tobi" and kind(["k.a.t", "d.o"]) == "transcription"
    assert kind(["a", "b"] * 20) == "grouping" and kind([f"word{i}" for i in range(9)]) == "orthography"
    assert readers.guess_delimiter(table(["k;a;t", "d;o", "a.b"]), "v") == ";" and readers.guess_delimiter(table(["kat", None]), "v") is None


def test_sound_headers(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "one.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(2)
        out.setframerate(8000)
        out.writeframes(bytes(4 * 4000))
    (tmp_path / "two.wav").write_bytes(b"no sound")
    got = {r.discourse: (r.sampling_rate, r.n_channels, r.duration) for r in readers.sound_info(spark, str(tmp_path)).collect()}
    assert got == {"one": (8000, 2, 0.5), "two": (None, None, None)}


def test_many_folders_are_listed_by_few_tasks_and_once(spark, tmp_path):
    from tierlake.sources.writers import from_folder

    for i in range(40):
        (tmp_path / f"discourse=d{i}").mkdir()
        (tmp_path / f"discourse=d{i}" / "part.csv").write_text(f"time,f0\n0.5,{i}\n")
    sc = spark.sparkContext
    sc.setJobGroup("lists folders", "")
    try:
        tracks = readers.tracks_from_csv(spark, str(tmp_path), from_folder("discourse"), ["f0"])
        jobs = sc.statusTracker().getJobIdsForGroup("lists folders")
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc._jsc.clearJobGroup()
    assert len(stages) == 1 and stages[0].numTasks <= readers.LISTERS * sc.defaultParallelism
    assert sorted(map(tuple, tracks.collect())) == sorted((f"d{i}", 0.5, float(i)) for i in range(40))
    with pytest.raises(Exception, match="f0"):
        readers.tracks_from_csv(spark, str(tmp_path), measures=["f1"]).collect()
