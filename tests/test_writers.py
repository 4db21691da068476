"""Files that writers make, read again; and the text of one."""

import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtures import levels, talk
from tierlake.sources.readers import TOKENS, buckeye, inspect_directory, load, load_corpus
from tierlake.sources.writers import aligner_tiers, buckeye_lines, from_folder, partitur_lines, textgrid_lines, write_lines, write_textgrids


def tokens(spark):
    frames = {}
    for name, rows in levels().items():
        frames[name] = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c in ('begin', 'end') else 'string'}" for c in rows[0]))
    return frames


def plain(df):
    return sorted((r.discourse, r.speaker, r.label, round(r.begin, 6), round(r.end, 6)) for r in df.where("label <> '<SIL>'").collect())


def test_a_textgrid_is_whole(spark, tmp_path):
    rows = [("a b", "x", 'say "so"', 1.0, 2.0), ("a b", "x", None, 2.0, 2.5), ("a b", "y", "é", 0.0, 0.5)]
    df = spark.createDataFrame(rows, "discourse string, tier string, label string, begin double, end double")
    write_textgrids(df, f"{tmp_path}/grids")
    (file,) = pathlib.Path(f"{tmp_path}/grids").rglob("*.txt")
    text = file.read_text()
    assert text.startswith('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0.0\nxmax = 2.5\ntiers? <exists>\nsize = 2\nitem []:\n    item [1]:')
    assert text.count("intervals: size = 3") == 1 and text.count("intervals: size = 2") == 1 and '"say ""so"""' in text
    loaded = load(spark, f"{tmp_path}/grids", "textgrid", discourse=from_folder("discourse"), pattern="*.txt")
    assert loaded.errors.isEmpty()
    found = sorted((r.discourse, r.tier, r.begin, r.end, r.label) for r in loaded.tokens.collect())
    assert found == [("a b", "x", 0.0, 1.0, ""), ("a b", "x", 1.0, 2.0, 'say "so"'), ("a b", "x", 2.0, 2.5, ""), ("a b", "y", 0.0, 0.5, "é"), ("a b", "y", 0.5, 2.5, "")]
    assert textgrid_lines(df.where("false")).isEmpty()


def test_several_speakers_of_a_recording(spark, tmp_path):
    own = tokens(spark)
    write_textgrids(aligner_tiers(own, "mfa"), f"{tmp_path}/mfa")
    assert inspect_directory(spark, f"{tmp_path}/mfa") == {"mfa": 2}
    c = load_corpus(spark, f"{tmp_path}/mfa", "again", discourse=from_folder("discourse"), pattern="*.txt")
    assert plain(c.tokens["word"]) == plain(own["word"]) and plain(c.tokens["phone"]) == plain(own["phone"])
    before = talk(spark)
    assert c.query(c.phone).filter(c.phone.word.label == "tok").count() == before.query(before.phone).filter(before.phone.word.label == "tok").count()


def test_names_of_folders_keep_any_character(spark, tmp_path):
    names = ["a+b", "50%", "x=y", "ü ö", "a:b"]
    lines = spark.createDataFrame([(n, i, f"line {i}") for n in names for i in range(30)], "discourse string, n int, line string")
    write_lines(lines, f"{tmp_path}/out", ["discourse"], ["n"])
    read = spark.read.text(f"{tmp_path}/out", wholetext=True, recursiveFileLookup=True).select(from_folder("discourse")(F.col("_metadata.file_path")).alias("d"), "value")
    got = {r.d: r.value.splitlines() for r in read.collect()}
    assert got == {n: [f"line {i}" for i in range(30)] for n in names}


def test_a_recording_has_one_file(spark, tmp_path):
    """Also where both sides of a union are dealt by recording already, and Spark joins the small partitions of each in its own way."""
    rows = spark.range(30_000).select((F.col("id") % 40).cast("string").alias("discourse"), F.col("id").alias("n"), F.concat(F.lit("line "), "id", F.lit("x" * 400)).alias("line"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("discourse").orderBy("n")))
    heads = rows.select("discourse").distinct().select("discourse", F.lit(-1).alias("n"), F.lit("head").alias("line"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(kept, ("16", "64k", "false")):
            spark.conf.set(k, v)
        write_lines(heads.unionByName(numbered), f"{tmp_path}/out", ["discourse"], ["n"])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = [*pathlib.Path(f"{tmp_path}/out").rglob("*.txt")]
    assert len(files) == 40 and all(f.read_text().startswith("head\nline") for f in files)


def test_a_long_recording_in_order(spark):
    """Words whose phones don't come in order of time find theirs too."""
    words = "#\n" + "\n".join(f"{i + 1} 121 w{i}; a; b" for i in range(4))
    phones = "#\n0.5 121 p\n1.5 121 q\n0.2 121 r\n2.5 121 s\n3.5 121 t"
    spans = [(t[3] + t[4]) / 2 for t in buckeye(words, phones) if t[0] == "phone" and t[2] != "?"]
    assert spans != sorted(spans)
    found = [(t[2], t[3], t[4]) for t in buckeye(words, phones) if t[0] == "word"]
    assert found == [("w0", 0.0, 0.2), ("w1", 0.2, 2.5), ("w2", 2.5, 3.0), ("w3", 3.0, 3.5)]


def test_tokens_leave_the_reader_before_they_are_many(spark, tmp_path):
    """Many files of one task are not gathered: as many tokens as TOKENS go on at once, and one file more."""
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text(" ".join(["word"] * 2000))
    sizes = load(spark, str(tmp_path), "orthography").rows.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= TOKENS + 2001 and load(spark, str(tmp_path), "orthography").tokens.count() == 30 * 2001


def test_buckeye_gaps_and_properties(spark, tmp_path):
    own = tokens(spark)
    for level, tier in (("word", own["word"].withColumn("kind", F.lit("NN"))), ("phone", own["phone"])):
        properties = ["label", "label", "kind"] if level == "word" else []
        write_lines(buckeye_lines(tier.where("speaker = 'ana'"), properties=properties), f"{tmp_path}/{level}", ["discourse"], ["begin"])
    loaded = load(spark, f"{tmp_path}/word", "buckeye", discourse=from_folder("discourse"), speaker=from_folder("discourse"), pattern="*.txt", phones=f"{tmp_path}/phone")
    assert loaded.errors.isEmpty()
    words = loaded.tokens.where("tier = 'word'").collect()
    assert {r.props["category"] for r in words} == {"NN"} and {r.props["surface"] for r in words} == {r.label for r in words}
    kept = lambda df: sorted((r.discourse, r.label, round(r.begin, 6), round(r.end, 6)) for r in df.collect())
    assert kept(loaded.tokens.where("tier = 'word'")) == kept(own["word"].where("speaker = 'ana'")) and kept(loaded.tokens.where("tier = 'phone'")) == kept(own["phone"].where("speaker = 'ana'"))


def tree(root):
    """Folder -> text of all files under it; hidden ones, as of checksums, are files too."""
    found = {}
    for f in pathlib.Path(root).rglob("*"):
        if f.is_file() and f.name != "_SUCCESS" and f.name != "._SUCCESS.crc":
            found.setdefault(str(f.parent.relative_to(root)), []).append(f.read_bytes().decode("utf-8", "replace"))
    return found


def test_mounted_files_are_named_as_by_spark(spark, tmp_path):
    """A recording costs one file and nothing beside it; its folder is the one that Spark's writer gives, for any character and null."""
    names = [f"x{chr(i)}y" for i in (*range(1, 256), 0x4E2D, 0x1F600)] + ["", None]
    rows = [(n, k, i, None if i == 1 else f"{k} ü {i}") for k, n in enumerate(names) for i in range(3)]
    lines = spark.createDataFrame(rows, "discourse string, k int, n int, line string")
    write_lines(lines, f"{tmp_path}/own", ["discourse", "k"], ["n"])
    lines.repartition(4, "k").sortWithinPartitions("discourse", "k", "n").drop("n").write.partitionBy("discourse", "k").text(f"{tmp_path}/spark")
    own, by_spark = tree(f"{tmp_path}/own"), {f: [t for t in texts if not t.startswith("crc")] for f, texts in tree(f"{tmp_path}/spark").items()}
    assert own == by_spark and len(own) == len(names)
    assert own["discourse=xay/k=96"] == ["96 ü 0\n\n96 ü 2\n"]
    with pytest.raises(FileExistsError):
        write_lines(lines, f"{tmp_path}/own", ["discourse", "k"], ["n"])


def test_lines_in_a_store_that_is_not_mounted(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lines.link./in", f"file://{tmp_path}")
    lines = spark.createDataFrame([(d, i, f"{d} {i}") for d in "ab" for i in range(3)], "discourse string, n int, line string")
    write_lines(lines, "viewfs://lines/in/out", ["discourse"], ["n"])
    read = spark.read.text("viewfs://lines/in/out", wholetext=True, recursiveFileLookup=True).select(from_folder("discourse")(F.col("_metadata.file_path")).alias("d"), "value")
    assert {r.d: r.value for r in read.collect()} == {d: f"{d} 0\n{d} 1\n{d} 2\n" for d in "ab"}


def test_a_partitur_has_words_and_phones(spark, tmp_path):
    """Lines of words and of phones come of different joins; a file with one kind alone would have no tokens at all."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        words = spark.range(180).select((F.col("id") % 12).cast("string").alias("discourse"), F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("label"), F.floor(F.col("id") / 12).cast("double").alias("begin"))
        phones = words.select("discourse", F.col("id").alias("word_id"), "begin", F.posexplode(F.split(F.left("label", F.lit(4)), "")).alias("j", "label"))
        phones = phones.select("discourse", "word_id", "label", (F.col("begin") + F.col("j") / 16).alias("begin"), (F.col("begin") + (F.col("j") + 1) / 16).alias("end"))
        write_lines(partitur_lines(words, F.broadcast(phones)), f"{tmp_path}/out", ["discourse"], ["_part", "_place"])
        assert len(list(pathlib.Path(f"{tmp_path}/out").rglob("*.txt"))) == 12
        found = load(spark, f"{tmp_path}/out", "partitur", discourse=from_folder("discourse"), pattern="*.txt").tokens.groupBy("tier").count()
        assert {r["tier"]: r["count"] for r in found.collect()} == {"word": 180, "phone": 720}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_phones_of_a_partitur_are_not_sent_to_the_driver(spark):
    words = spark.range(20).select(F.lit("d").alias("discourse"), F.col("id").cast("string").alias("id"), F.lit("tok").alias("label"), F.col("id").cast("double").alias("begin"))
    phones = words.select(F.col("id").alias("word_id"), F.explode(F.split("label", "")).alias("label"), "begin", (F.col("begin") + 0.5).alias("end"))
    lines = partitur_lines(words, phones)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert {r["_part"]: r["count"] for r in lines.groupBy("_part").count().collect()} == {1: 20, 2: 20, 3: 60}
