"""Annotations as files of common formats, one for each recording: the text is a sorted table of lines, which Spark writes by folders.

No task holds a file's text: lines are dealt by recording, sorted within it and streamed. A
recording's file lies in a folder that names speaker or discourse, as `speaker=ana/discourse=walk/`;
readers take both from there by `from_folder`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.sources.readers import ALIGNERS


def from_folder(name: str):
    """A function of a path: the value that the folder `name=value` gives it."""

    def value(path: Column) -> Column:
        # the name of a folder escapes what paths can't hold, and the path escapes that once more
        plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        return plain(plain(F.regexp_extract(path, rf"/{name}=([^/]*)/", 1)))

    return value


#: Characters that Spark escapes in the name of a folder.
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _folder(by: Sequence[str], values: Sequence[str]) -> str:
    """speaker=ana/discourse=walk, as Spark names the folders of a partition."""
    plain = lambda v: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) or "__HIVE_DEFAULT_PARTITION__"
    return "/".join(f"{plain(c)}={plain(v)}" for c, v in zip(by, values))


def write_lines(lines: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> None:
    """Write `line` of a table as text, a file for each value of `by`, its lines in order.

    Lines are dealt by a hash of `by`, not by `by` itself: Spark leaves out an exchange that a union seems to have made already,
    and then joins small partitions of the union's sides each in its own way, so that a recording would get several files.
    Their number is told, as a file takes its time however short it is, and Spark would give all small ones to one task.
    Files go to their places by task, not one after another by the driver; the folder is new, so none is there before.
    On a file system that is mounted (file:) tasks write them as plain files, see _write_mounted.
    """
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select(*by, *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), "line").repartition(tasks, F.xxhash64(*by))
    keys = [f"_{i}" for i in range(len(order))]
    sorted_ = dealt.sortWithinPartitions(*by, *keys).drop(*keys)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(at).toUri()
    if uri.getScheme() != "file":
        sorted_.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(*by).text(path)
        return
    if fs.exists(at):
        raise FileExistsError(path)
    fs.mkdirs(at)
    _write_mounted(sorted_, uri.getPath(), by)


def _write_mounted(lines: DataFrame, root: str, by: Sequence[str]) -> None:
    """Sorted lines (by, line) as files under a folder that all executors have mounted: `root`/by=value/part-00000.txt.

    Spark's own writer starts a process for each folder, file and checksum that it makes there (chmod, as Hadoop's native
    library is seldom present), four for a recording, which take far longer than its text. A file gets its name when it
    is whole, and the same name however often its task is tried.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, own = f"part-{task.partitionId():05d}.txt", f".part-{task.partitionId():05d}-{task.taskAttemptId()}"
        now, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), name))

        for batch in batches:
            at = 0
            runs = pc.run_end_encode(batch.column(0))
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if key != now:
                    close()
                    folder = os.path.join(root, _folder(by, key.split("\0")))
                    os.makedirs(folder, exist_ok=True)
                    now, out, n = key, open(os.path.join(folder, own), "w", encoding="utf-8", newline=""), n + 1  # noqa: SIM115
                out.writelines(f"{line or ''}\n" for line in batch.column(1).slice(at, end - at).to_pylist())
                at = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    key = F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    lines.select(key.alias("key"), "line").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def _seconds(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def textgrid_lines(tokens: DataFrame, by: Sequence[str] = ("discourse",)) -> DataFrame:
    """by, _tier, _begin, line: TextGrids of tokens (by, tier, label, begin, end in seconds), in the long format.

    Tiers of a recording are numbered by name. Stretches of a tier without tokens become intervals without label, as
    interval tiers have no gaps; tokens of one tier must not overlap. Quotes in labels are doubled, a null label is none.
    """
    tier = [*by, "tier"]
    own = tokens.select(*tier, F.coalesce("label", F.lit("")).alias("label"), F.col("begin").cast("double").alias("begin"), F.col("end").cast("double").alias("end"))
    span = own.groupBy(*by).agg(F.lit(0.0).alias("_from"), F.max("end").alias("_to"), F.countDistinct("tier").alias("_tiers"))
    own = own.join(span.drop("_tiers"), [*by])
    chain = Window.partitionBy(*tier).orderBy("begin", "end")
    own = own.withColumns({"_before": F.coalesce(F.lag("end").over(chain), "_from"), "_last": F.lead("begin").over(chain).isNull()})
    gap = lambda a, b, when: F.when(when & (b > a), F.array(F.struct(F.lit("").alias("label"), a.alias("begin"), b.alias("end"))))
    none = F.expr("cast(array() as array<struct<label:string,begin:double,end:double>>)")
    pieces = F.concat(F.coalesce(gap(F.col("_before"), F.col("begin"), F.lit(True)), none), F.array(F.struct("label", "begin", "end")), F.coalesce(gap(F.col("end"), F.col("_to"), F.col("_last")), none))
    own = own.select(*tier, "_from", "_to", F.explode(pieces).alias("p")).select(*tier, "_from", "_to", "p.*")
    text = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    number = F.row_number().over(Window.partitionBy(*tier).orderBy("begin", "end"))
    interval = F.concat_ws("\n", F.concat(F.lit("        intervals ["), number, F.lit("]:")), F.concat(F.lit("            xmin = "), _seconds("begin")), F.concat(F.lit("            xmax = "), _seconds("end")), F.concat(F.lit("            text = "), text(F.col("label"))))
    intervals = own.select(*by, F.col("tier").alias("_tier"), F.col("begin").alias("_begin"), interval.alias("line"))
    sizes = own.groupBy(*tier).agg(F.count("*").alias("n"), F.first("_to").alias("_to"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("tier"))
    head = F.concat_ws("\n", F.concat(F.lit("    item ["), place, F.lit("]:")), F.lit('        class = "IntervalTier"'), F.concat(F.lit("        name = "), text(F.col("tier"))), F.lit("        xmin = 0.0"), F.concat(F.lit("        xmax = "), _seconds("_to")), F.concat(F.lit("        intervals: size = "), F.col("n")))
    heads = sizes.select(*by, F.col("tier").alias("_tier"), F.lit(-1.0).alias("_begin"), head.alias("line"))
    top = F.concat_ws("\n", F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), F.lit("xmin = 0.0"), F.concat(F.lit("xmax = "), _seconds("_to")), F.lit("tiers? <exists>"), F.concat(F.lit("size = "), F.col("_tiers")), F.lit("item []:"))
    # a null name of a tier sorts before all others
    tops = span.select(*by, F.lit(None).cast("string").alias("_tier"), F.lit(-2.0).alias("_begin"), top.alias("line"))
    return tops.unionByName(heads).unionByName(intervals)


def write_textgrids(tokens: DataFrame, path: str, by: Sequence[str] = ("discourse",)) -> None:
    """A TextGrid for each recording; see textgrid_lines."""
    write_lines(textgrid_lines(tokens, by), path, by, ["_tier", "_begin"])


def aligner_tiers(tokens: dict[str, DataFrame], format: str, speaker: str = "speaker") -> DataFrame:  # noqa: A002
    """The words and phones (tokens["word"], tokens["phone"]) under the tier names that an aligner gives."""
    a = ALIGNERS[format]

    def named(kind: str, name: str) -> DataFrame:
        sides = [F.col(speaker).cast("string"), F.lit(name)]
        tier = F.lit(name.upper()) if a.single else F.concat_ws(" - ", *(sides if a.speaker_first else sides[::-1]))
        return tokens[kind].withColumn("tier", tier)

    return named("word", a.word[0] if a.single else f"{a.word[0]}s" if a.speaker_first else a.word[0]).unionByName(named("phone", a.phone[0] if a.single else f"{a.phone[0]}s" if a.speaker_first else a.phone[0]), allowMissingColumns=True)


def partitur_lines(words: DataFrame, phones: DataFrame, by: Sequence[str] = ("discourse",), unit: float = 10000) -> DataFrame:
    """by, _part, _place, line: ORT and KAN of words (by, id, label, begin), then MAU of phones (by, word_id, label, begin, end)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("begin", "id")) - 1
    numbered = words.select(*by, "id", "label", place.alias("_place"))
    samples = lambda c: F.round(F.col(c) * unit).cast("long")
    heard = phones.select(F.col("word_id").alias("id"), "label", "begin", "end")
    canon = heard.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "label"))), lambda p: p["label"]), " ").alias("canon"))
    row = lambda df, part, line: df.select(*by, F.lit(part).alias("_part"), F.col("_place").cast("double").alias("_place"), line.alias("line"))
    ort = row(numbered, 1, F.concat_ws(" ", F.lit("ORT:"), "_place", "label"))
    # both joins are by shuffles: phones grow with the corpus, and Spark's guess from the size of files would send them to the driver
    kan = row(numbered.join(canon.hint("merge"), "id"), 2, F.concat_ws(" ", F.lit("KAN:"), "_place", "canon"))
    mau = heard.hint("merge").join(numbered.select(*by, "id", "_place"), "id").select(*by, F.lit(3).alias("_part"), F.col("begin").cast("double").alias("_place"), F.concat_ws(" ", F.lit("MAU:"), samples("begin"), samples("end") - samples("begin"), "_place", "label").alias("line"))
    return ort.unionByName(kan).unionByName(mau)


def timit_lines(tokens: DataFrame, rate: int = 16000, by: Sequence[str] = ("discourse",)) -> DataFrame:
    """by, begin, line: first and last sample and label of each token."""
    return tokens.select(*by, "begin", F.concat_ws(" ", F.round(F.col("begin") * rate).cast("long"), F.round(F.col("end") * rate).cast("long"), "label").alias("line"))


def buckeye_lines(tokens: DataFrame, by: Sequence[str] = ("discourse",), properties: Sequence[str] = ()) -> DataFrame:
    """by, begin, line: a header, then end, colour and label of each token with its properties behind semicolons.

    The format tells ends alone, so time without tokens gets a line of its own, marked as silence.
    """
    colour = lambda end, text: F.concat(F.lit("  "), _seconds(end), F.lit(" 121 "), text)
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*by).orderBy("begin", "end")), F.lit(0.0))
    fields = F.concat_ws("; ", "label", *(F.coalesce(F.col(p), F.lit("")) for p in properties))
    line = F.concat_ws("\n", F.when(F.col("begin") > before, colour(F.col("begin"), F.lit("{SIL}"))), colour(F.col("end"), fields))
    head = tokens.select(*by).distinct().select(*by, F.lit(float("-inf")).alias("begin"), F.lit("header\n#").alias("line"))
    return head.unionByName(tokens.withColumns({"begin": F.col("begin").cast("double"), "end": F.col("end").cast("double")}).select(*by, "begin", line.alias("line")))
