"""Versions of a corpus: crashes, deletes, additions and incremental loading; every state is compared with the corpus in memory."""

import pathlib

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtures import talk
from tierlake.corpus import Corpus
from tierlake.errors import QueryError
from tierlake.sources.store import Conflict, CorpusStore


def full(spark):
    c = talk(spark)
    c.types["word"] = spark.createDataFrame([("mela", 1), ("tok", 2), ("strel", 3), ("unheard", 4)], "label string, size int")
    c.add_subannotations("word", "mark", c.tokens["word"].select(F.concat(F.lit("s"), "id").alias("id"), F.col("id").alias("annotated_id"), "begin", "end"))
    c.tracks["f"] = spark.createDataFrame([("walk", "ana", 1.0, 2.0), ("rest", "ana", 1.0, 2.0), ("walk", "bo", 3.0, 9.0)], "discourse string, speaker string, time double, f double")
    c.schema.add("type", "word", size="int")
    return c


def contents(c):
    return {n: sorted(map(str, t.select(*sorted(t.columns)).collect())) for n, t in c._tables().items()}


def files(root):
    return {p: p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("*.parquet")}


def test_a_discourse_is_removed_without_rewriting(spark, tmp_path):
    c, store = full(spark), CorpusStore(spark, str(tmp_path), "talk")
    assert store.save(c) == 1 and contents(store.open()) == contents(c)
    before = files(tmp_path)
    assert store.remove_discourses("walk") == 2
    after = files(tmp_path)
    assert all(after[p] == t for p, t in before.items()) and not any("/data/" in str(p) for p in set(after) - set(before))
    gone = full(spark)
    gone.remove_discourse("walk")
    assert contents(store.open()) == contents(gone) and contents(store.open(1)) == contents(c)
    # queries of a version with deletes
    again = store.open()
    assert again.query(again.word).count() == 2 and again.query(again.phone).filter(again.phone.word.label == "tok").count() == 3
    assert store.compact() == 3 and contents(store.open()) == contents(gone)
    assert all(not t["deletes"] for t in store.manifest()["tables"].values())
    assert store.vacuum() > 0 and store.versions() == [3] and contents(store.open()) == contents(gone)


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    c, store = full(spark), CorpusStore(spark, str(tmp_path), "talk")
    store.save(c)
    written = []
    write = store._part

    def dies(tables, run, name, rows):
        if len(written) == 3:
            raise RuntimeError("lost")
        written.append(name)
        write(tables, run, name, rows)

    monkeypatch.setattr(store, "_part", dies)
    with pytest.raises(RuntimeError):
        store.save(c)
    monkeypatch.undo()
    assert store.versions() == [1] and contents(store.open()) == contents(c)
    assert store.vacuum() == 1 and contents(store.open()) == contents(c)
    with pytest.raises(Conflict):
        store._commit(0, "", {})
    with pytest.raises(QueryError):
        CorpusStore(spark, str(tmp_path), "none").open()


def test_discourses_are_added_and_refused(spark, tmp_path):
    c, store = full(spark), CorpusStore(spark, str(tmp_path), "talk")
    parts = {}
    for name in ("walk", "rest"):
        parts[name] = full(spark)
        parts[name].remove_discourse("rest" if name == "walk" else "walk")
    store.append(parts["walk"])
    before = files(tmp_path)
    store.append(parts["rest"])
    assert all(files(tmp_path)[p] == t for p, t in before.items())
    assert contents(store.open()) == contents(c)
    with pytest.raises(QueryError):
        store.append(parts["rest"])
    other = Corpus(spark, "o", parts["rest"].schema.__class__({"word": None}), {"word": parts["rest"].tokens["word"]})
    with pytest.raises(QueryError):
        store.append(other)
    assert len(store.versions()) == 2
    # an edited stretch of a track costs what changed
    new = spark.createDataFrame([("walk", "ana", 1.0, 7.0)], "discourse string, speaker string, time double, f double")
    store.replace("track_f", (F.col("discourse") == "walk") & (F.col("speaker") == "ana"), new)
    assert {(r.discourse, r.speaker): r.f for r in store.table("track_f").collect()} == {("walk", "ana"): 7.0, ("rest", "ana"): 2.0, ("walk", "bo"): 9.0}
    assert store.table("track_f", 2).where("f = 7").count() == 0
    with pytest.raises(QueryError):
        store.replace("track_f", F.lit(False), new.withColumn("f", F.lit("x")))


def recording(folder, name, words):
    """A TextGrid in the plain long format with a tier of words and one of phones."""
    end = len(words)
    tier = lambda n, label, cells: [f"    item [{n}]:", '        class = "IntervalTier"', f'        name = "{label}"', "        xmin = 0", f"        xmax = {end}", f"        intervals: size = {len(cells)}"] + [
        line for i, (a, b, t) in enumerate(cells) for line in (f"        intervals [{i + 1}]:", f"            xmin = {a}", f"            xmax = {b}", f'            text = "{t}"')
    ]
    lines = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {end}", "tiers? <exists>", "size = 2", "item []:"]
    lines += tier(1, "words", [(i, i + 1, w) for i, w in enumerate(words)]) + tier(2, "phones", [(i + k / len(w), i + (k + 1) / len(w), p) for i, w in enumerate(words) for k, p in enumerate(w)])
    (folder / f"{name}.TextGrid").write_text("\n".join(lines) + "\n")


def test_only_new_recordings_are_parsed(spark, tmp_path, monkeypatch):
    import os

    from tierlake.sources import store as module

    folder = tmp_path / "in" / "ana"
    folder.mkdir(parents=True)
    for name, words in (("one", ["mela", "tok"]), ("two", ["tok", "strel"]), ("three", ["kanto"])):
        recording(folder, name, words)
    parsed = []
    load = module.load_corpus
    monkeypatch.setattr(module, "load_corpus", lambda spark, paths, *a, **k: parsed.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or load(spark, paths, *a, **k))
    store = CorpusStore(spark, str(tmp_path / "out"), "talk")
    sync = lambda: store.sync(str(tmp_path / "in"), "mfa")
    words = lambda: sorted((r.discourse, r.label) for r in store.table("token_word").collect())
    assert sync() == {"parsed": 3, "removed": 0} and len(parsed) == 1
    first = words()
    assert first == [("one", "mela"), ("one", "tok"), ("three", "kanto"), ("two", "strel"), ("two", "tok")]
    assert sync() == {"parsed": 0, "removed": 0} and len(parsed) == 1 and store.versions() == [1]
    before = files(tmp_path / "out")
    recording(folder, "two", ["lem", "o", "um"])
    os.utime(folder / "two.TextGrid", (2_000_000_000, 2_000_000_000))
    recording(folder, "four", ["um"])
    assert sync() == {"parsed": 2, "removed": 0} and parsed[1] == ["four.TextGrid", "two.TextGrid"]
    assert words() == [("four", "um"), ("one", "mela"), ("one", "tok"), ("three", "kanto"), ("two", "lem"), ("two", "o"), ("two", "um")]
    assert all(files(tmp_path / "out")[p] == t for p, t in before.items())
    (folder / "one.TextGrid").unlink()
    assert sync() == {"parsed": 0, "removed": 1} and len(parsed) == 2
    assert {d for d, _ in words()} == {"two", "three", "four"} and words() == sorted((r.discourse, r.label) for r in store.open().tokens["word"].collect())
    assert sorted((r.discourse, r.label) for r in store.open(1).tokens["word"].collect()) == first
    assert isinstance(store.open().speakers, DataFrame) and store.table("ledger").count() == 3
