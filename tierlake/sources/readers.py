"""Readers of annotated speech: files become rows of (path, speaker, discourse, tier, label, begin, end).

Spark lists and reads the files; a reader is a pure function of one file's text, run in
mapInArrow, so files spread over executors. A file that can't be read yields a row in `errors`
instead of stopping the others. Files of speech annotations are small (a recording each).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierlake.errors import ParseFailure
from tierlake.shared import Rounds

ROW = "path string, speaker string, discourse string, tier string, label string, begin double, end double, props map<string,string>, error string"

Token = tuple  # (tier, speaker or None, label, begin, end, props)


def _number(s: str) -> float:
    return float(s.strip())


def textgrid(text: str) -> list[Token]:
    """Praat's long and short text formats; interval and point tiers. An empty file has no tokens."""
    values = [m[1].replace('""', '"') if m[1] is not None else float(m[2]) if m[2] else m[0] for m in re.finditer(r'"((?:[^"]|"")*)"|(?<![\w\[.])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w\]])|<exists>', text)]
    if not values:
        return []
    if values[:2] != ["ooTextFile", "TextGrid"]:
        raise ParseFailure("textgrid", "not a TextGrid in text format")
    at = next((i for i, v in enumerate(values) if v == "<exists>"), 3) + 2
    out: list[Token] = []
    while at < len(values):
        kind, name, _, _, n = values[at : at + 5]
        at += 5
        for _ in range(int(n)):
            if kind == "IntervalTier":
                a, b, label = values[at : at + 3]
                at += 3
            else:
                a, label = values[at : at + 2]
                b = a
                at += 2
            out.append((name, None, str(label), min(a, b), max(a, b), {}))
    return out


@dataclass(frozen=True)
class Aligner:
    """How a forced aligner names tiers. parts: a tier is 'Speaker - words' (or the other way round); without a separator the speaker is unknown."""

    word: tuple[str, ...]
    phone: tuple[str, ...]
    speaker_first: bool = True
    single: bool = False
    once: bool = False

    def parse(self, text: str) -> list[Token]:
        out, seen, places = [], set(), {}
        for tier, _, label, begin, end, _ in textgrid(text):
            name, speaker = tier, None
            if " - " in tier and not self.single:
                left, right = (x.strip() for x in tier.rsplit(" - ", 1) if x is not None)
                speaker, name = (left, right) if self.speaker_first else (right, left)
            kind = "word" if name.lower().startswith(self.word) else "phone" if name.lower().startswith(self.phone) else None
            if kind is None or (self.once and (kind, speaker, begin, end) in seen):
                continue
            seen.add((kind, speaker, begin, end))
            # speakers in the order of their tiers
            own = {} if speaker is None else {"speaker_place": str(places.setdefault(speaker, len(places)))}
            out.append((kind, speaker, label or "<SIL>", begin, end, own))
        for kind in ("word", "phone"):
            if not any(t[0] == kind for t in out):
                raise ParseFailure("aligner", f"no tier of {kind}s")
        return out


# Tier names of aligners.
ALIGNERS = {
    "mfa": Aligner(("word",), ("phone",)),
    "fave": Aligner(("word",), ("phone",)),
    "maus": Aligner(("ort",), ("mau",), single=True),
    "labbcat": Aligner(("transcript",), ("segment",), speaker_first=False, once=True),
}


def _timed_lines(text: str) -> list[tuple[float, str]]:
    """(end time, the rest without the color) of a Buckeye file's lines after the header."""
    body = text.split("\n#", 1)[-1]
    out = []
    for line in body.splitlines():
        parts = line.split(None, 2)
        if len(parts) >= 2:
            try:
                out.append((float(parts[0]), parts[2] if len(parts) > 2 else ""))
            except ValueError:
                continue
    return out


def buckeye(words: str, phones: str) -> list[Token]:
    """Words and phones that give ends; a word ends where the last phone whose midpoint it holds ends. Marks in braces are no tokens; words without transcription are UH if fillers, and ? if their phones are missing."""
    segments, begin = [], 0.0
    for end, label in _timed_lines(phones):
        label = label.split(";")[0].strip()
        if label and not label.startswith("{"):
            segments.append(("phone", None, label, begin, end, {}))
        begin = end
    out: list[Token] = []
    begin = 0.0
    middles = [(p[3] + p[4]) / 2 for p in segments]
    rising = all(a <= b for a, b in zip(middles, middles[1:]))
    for end, rest in _timed_lines(words):
        fields = [x.strip() for x in rest.split(";")]
        label = fields[0]
        if label.startswith("{"):
            begin = end
            continue
        own = segments[bisect_left(middles, begin) : bisect_left(middles, end)] if rising else [p for p, m in zip(segments, middles) if begin <= m < end]
        filler = label.startswith("<")
        surface = fields[2] if len(fields) > 2 else ("UH" if filler else "?")
        stop = own[-1][4] if own else end
        out.append(("word", None, label, begin, stop, {"underlying": fields[1] if len(fields) > 1 else "", "surface": surface or "?", "category": fields[3] if len(fields) > 3 else ""}))
        if not own and not filler:
            out.append(("phone", None, "?", begin, stop, {}))
        begin = stop if own else end
    return out + segments


def timit(words: str, phones: str, rate: int = 16000) -> list[Token]:
    """Samples as times; gaps between words are <SIL>."""
    read = lambda text: [(int(a) / rate, int(b) / rate, label.strip()) for a, b, label in (line.split(None, 2) for line in text.splitlines() if line.strip())]
    out: list[Token] = [("phone", None, label, a, b, {}) for a, b, label in read(phones)]
    last = max((t[4] for t in out), default=0.0)
    at = 0.0
    for a, b, label in read(words):
        if a > at:
            out.append(("word", None, "<SIL>", at, a, {}))
        out.append(("word", None, label, max(a, at), b, {}))
        at = b
    if last > at:
        out.append(("word", None, "<SIL>", at, last, {}))
    return out


def partitur(text: str, unit: float = 10000) -> list[Token]:
    """BAS Partitur: ORT and KAN give words, MAU their phones with begin and length; words last from their first phone to their last."""
    names: dict[str, str] = {}
    canon: dict[str, str] = {}
    spans: dict[str, list[tuple[float, float]]] = {}
    out: list[Token] = []
    speaker = None
    for line in text.splitlines():
        key, _, rest = line.partition(":")
        fields = rest.split()
        if key == "SPN" and fields:
            speaker = fields[0]
        elif key == "ORT" and len(fields) > 1:
            names[fields[0]] = fields[1]
        elif key == "KAN" and len(fields) > 1:
            canon[fields[0]] = " ".join(fields[1:])
        elif key == "MAU" and len(fields) > 3:
            a = float(fields[0]) / unit
            b = a + float(fields[1]) / unit
            if fields[2] in names or fields[2] == "-1":
                out.append(("phone", speaker, fields[3], a, b, {}))
                if fields[2] != "-1":
                    spans.setdefault(fields[2], []).append((a, b))
    return out + [("word", speaker, names[k], min(a for a, _ in v), max(b for _, b in v), {"transcription": canon.get(k, "")}) for k, v in spans.items()]


def interlinear(text: str, tiers: Sequence[str]) -> list[Token]:
    """Blocks of as many lines as there are tiers, words one under the other; blank lines don't count. Times are places in the text."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    if len(lines) % len(tiers):
        raise ParseFailure("interlinear", f"{len(lines)} lines are no whole number of blocks of {len(tiers)}")
    out: list[Token] = []
    at = 0
    for block in range(0, len(lines), len(tiers)):
        own = lines[block : block + len(tiers)]
        if len({len(x) for x in own}) > 1:
            raise ParseFailure("interlinear", f"the lines from {block + 1} on differ in their number of words: {[len(x) for x in own]}")
        out.append(("line", None, " ".join(own[0]), at, at + len(own[0]), {}))
        for word in zip(*own):
            out.append(("word", None, word[0], at, at + 1, dict(zip(tiers[1:], word[1:]))))
            at += 1
    return out


def running(text: str, ignored: str = "", delimiter: str | None = None) -> list[Token]:
    """Running text: words at white space, times are places; with a delimiter words are transcriptions."""
    out: list[Token] = []
    at = 0
    drop = str.maketrans("", "", ignored)
    for line in text.splitlines():
        words = [w for w in (x.translate(drop) for x in line.split()) if w]
        if words:
            out.append(("line", None, " ".join(words), at, at + len(words), {}))
        for w in words:
            out.append(("word", None, w if delimiter is None else w.replace(delimiter, ""), at, at + 1, {} if delimiter is None else {"transcription": w.replace(delimiter, ".")}))
            at += 1
    return out


def split_transcription(value: str, delimiter: str | None = None, digraphs: Sequence[str] = (), ignored: str = "") -> list[str]:
    """Segments of a transcription: at the delimiter, else longest digraphs first, else characters."""
    value = value.translate(str.maketrans("", "", ignored))
    if delimiter:
        return [x for x in value.split(delimiter) if x]
    options = [*map(re.escape, sorted(digraphs, key=len, reverse=True)), r"\S"]
    return re.findall("|".join(options), value)


def segments_of(value: Column, delimiter: str | None = None, digraphs: Sequence[str] = (), ignored: str = "") -> Column:
    """split_transcription of a column, by the engine; null has no segments."""
    value = F.translate(value, ignored, "") if ignored else value
    if delimiter:
        return F.filter(F.split(value, re.escape(delimiter)), lambda x: x != "")
    options = "|".join([*(re.escape(d) for d in sorted(digraphs, key=len, reverse=True)), r"\S"])
    return F.regexp_extract_all(value, F.lit(options), F.lit(0))


def morphemes_of(value: Column, delimiters: str = "-=") -> Column:
    """split_morphemes of a column, by the engine."""
    return F.filter(F.split(value, f"[{re.escape(delimiters)}]"), lambda x: x != "")


def parse_transcription(value: str, delimiter: str | None = None, digraphs: Sequence[str] = (), ignored: str = "", morphemes: str = "", numbers: str | None = None) -> list[dict[str, str]]:
    """Segments of a transcription with the number of their morpheme and, if numbers is stress or tone, the digits of each segment under that name; the label is without them."""
    out = []
    parts = split_morphemes(value, morphemes) if morphemes else [value]
    for k, part in enumerate(parts):
        for segment in split_transcription(part, delimiter, digraphs, ignored):
            digits = "".join(re.findall(r"\d+", segment)) if numbers else ""
            if numbers and not delimiter and segment.isdigit() and out:
                out[-1][numbers] = out[-1].get(numbers, "") + segment
                continue
            row = {"label": re.sub(r"\d+", "", segment) if numbers else segment, "morpheme": str(k)}
            out.append(row | ({numbers: digits} if digits else {}))
    return out


def split_morphemes(value: str, delimiters: str = "-=") -> list[str]:
    """Morphemes of a word."""
    return [x for x in re.split(f"[{re.escape(delimiters)}]", value) if x]


# -- tables of files ----------------------------------------------------------------------


def speaker_from_name(path: Column, n: int, left: bool = True) -> Column:
    """The first (last) n characters of the file's name without its extension."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.substring(stem, 1, n) if left else F.right(stem, F.lit(n))


def speaker_from_directory(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./,]*(?:,\d)?)?$", 1)


#: Tokens that a reader hands on at once; a file's go together.
TOKENS = 20_000


def _run(files: DataFrame, parse: Callable[..., list[Token]], columns: Sequence[str]) -> DataFrame:
    kinds = [pa.string()] * 5 + [pa.float64()] * 2 + [pa.map_(pa.string(), pa.string()), pa.string()]
    names = [c.split()[0] for c in ROW.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            # one file's text at a time becomes Python's, and tokens leave before they are many
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                try:
                    found = parse(*(row[c] or "" for c in columns))
                    out += [(row["path"], s or row["speaker"], row["discourse"], t, label, float(a), float(b), [(k, str(v)) for k, v in p.items()], None) for t, s, label, a, b, p in found]
                except (ParseFailure, ValueError, IndexError, TypeError) as why:
                    out.append((row["path"], row["speaker"], row["discourse"], None, None, None, None, None, f"{type(why).__name__}: {why}"))
                if len(out) >= TOKENS:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    return files.mapInArrow(run, ROW)


@dataclass
class Loaded:
    """tokens of all files that could be read, and path and error of the others."""

    rows: DataFrame
    tokens: DataFrame = field(init=False)
    errors: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = self.rows.where("error is null").drop("error")
        self.errors = self.rows.where("error is not null").select("path", "error")

    def channels(self, sounds: DataFrame) -> DataFrame:
        """speaker, discourse, channel: where a recording (discourse, n_channels) has several channels its speakers are dealt to them in the order of their tiers, all further ones to the last; 0 otherwise."""
        place = F.coalesce(F.col("props").getItem("speaker_place").cast("int"), F.lit(0))
        own = self.tokens.groupBy("speaker", "discourse").agg(F.min(place).alias("_place")).join(sounds.select("discourse", "n_channels"), "discourse", "left")
        return own.select("speaker", "discourse", F.least("_place", F.coalesce("n_channels", F.lit(1)) - 1).alias("channel"))

    def tiers(self) -> dict[str, DataFrame]:
        """Tier name -> label, begin, end, speaker, discourse."""
        names = [r.tier for r in self.tokens.select("tier").distinct().collect()]
        return {n: self.tokens.where(F.col("tier") == n).select("label", "begin", "end", "speaker", "discourse") for n in names}


#: Tasks that list folders, for each core. Spark's default is one a folder, up to 10,000, and a folder here holds a recording.
LISTERS = 4


def modest_listing(spark: SparkSession) -> None:
    """Folders are listed by LISTERS tasks a core, many to a task, where the session has Spark's default."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(LISTERS * spark.sparkContext.defaultParallelism))


def _files(spark: SparkSession, path: str, pattern: str, speaker: Callable[[Column], Column], discourse: Callable[[Column], Column] = stem) -> DataFrame:
    modest_listing(spark)
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", discourse(F.col("path")).alias("discourse"), speaker(F.col("path")).alias("speaker"), F.regexp_replace("value", "^﻿", "").alias("value"))


def load(spark: SparkSession, path: str, format: str, speaker: Callable[[Column], Column] = speaker_from_directory, discourse: Callable[[Column], Column] = stem, pattern: str | None = None, phones: str | None = None, **options) -> Loaded:  # noqa: A002
    """Read a file or folder. Formats: textgrid, mfa, fave, maus, labbcat, buckeye, timit, partitur, interlinear, orthography, transcription.

    speaker, discourse: what a path tells of them (the folder and the file's name by default). pattern: the names of the files, where
    they aren't the format's. phones: the folder with the phones of buckeye and timit, if they lie apart; the names of both are then `pattern` (all by default).
    """
    paired = {"buckeye": ("*.words", "*.phones"), "timit": ("*.[wW][rR][dD]", "*.[pP][hH][nN]")}
    if format in paired:
        ways = [(path, pattern or "*"), (phones, pattern or "*")] if phones else [(path, p) for p in paired[format]]
        one, two = (_files(spark, where, p, speaker, discourse) for where, p in ways)
        both = one.join(two.select("discourse", "speaker", F.col("value").alias("other")), ["discourse", "speaker"], "left")
        return Loaded(_run(both, buckeye if format == "buckeye" else timit, ["value", "other"]))
    if format in ALIGNERS:
        parse: Callable[[str], list[Token]] = ALIGNERS[format].parse
    else:
        simple = {
            "textgrid": textgrid, "partitur": partitur, "interlinear": lambda t: interlinear(t, options["tiers"]),
            "orthography": lambda t: running(t, options.get("ignored", "")), "transcription": lambda t: running(t, options.get("ignored", ""), options.get("delimiter", ".")),
        }
        if format not in simple:
            raise ValueError(f"unknown format {format!r}")
        parse = simple[format]
    pattern = pattern or {"partitur": "*.par*", "interlinear": "*.txt", "orthography": "*.txt", "transcription": "*.txt"}.get(format, "*.TextGrid")
    return Loaded(_run(_files(spark, path, pattern, speaker, discourse), parse, ["value"]))


#: A format for each file extension; TextGrids are told apart by their tiers, and text by what it holds.
_EXTENSIONS = {"textgrid": "textgrid", "words": "buckeye", "wrd": "timit", "par": "partitur", "par,1": "partitur", "txt": "orthography"}


def guess_textgrid_format(tiers: Sequence[str]) -> str:
    """The aligner whose names of word and phone tiers are among a file's tiers, or textgrid."""
    own = [t.lower() for t in tiers]
    paired = [t for t in own if " - " in t]
    for name, a in ALIGNERS.items():
        if a.single:
            names = own
        else:
            names = [t.rsplit(" - ", 1)[1 if a.speaker_first else 0].strip() for t in paired]
        if all(any(n.startswith(k) for n in names) for k in (a.word, a.phone)):
            # files that carry upper-case tiers are of one kind of aligner, the others of the other
            return name
    return "textgrid"


def inspect_directory(spark: SparkSession, path: str) -> dict[str, int]:
    """How many files of a folder are of each format, the most frequent first."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = []
            for name, value in zip(batch["path"], batch["value"]):
                kind = _EXTENSIONS.get(name.rsplit(".", 1)[-1].lower())
                if kind == "textgrid" or (value or "").startswith('File type = "ooTextFile"'):
                    kind = "textgrid"
                    try:
                        kind = guess_textgrid_format(list(dict.fromkeys(t[0] for t in textgrid(value or ""))))
                    except (ParseFailure, ValueError, IndexError, TypeError):
                        pass
                kinds.append(kind)
            yield pd.DataFrame({"kind": kinds})

    found = _files(spark, path, "*", speaker_from_directory).select("path", "value").mapInPandas(tell, "kind string")
    rows = found.where("kind is not null").groupBy("kind").count().orderBy(F.desc("count"), "kind").collect()
    return {r["kind"]: r["count"] for r in rows}


def load_corpus(spark: SparkSession, path: str, name: str, format: str | None = None, order: Sequence[str] = ("phone", "word", "line"), strict: bool = True, sounds: str | None = None, **options):  # noqa: A002
    """A corpus of a file or folder; without a format, of the one that most of its files have. order: the levels from the lowest on. Files that can't be read are an error that names them, unless not strict. sounds: a folder of recordings, whose channels the speakers are dealt to."""
    from tierlake.corpus import Corpus

    if format is None:
        found = inspect_directory(spark, path)
        if not found:
            raise ParseFailure(path, "no file of a known format")
        format = next(iter(found))  # noqa: A001
    # each file is parsed once: errors, tiers and every level are asked of what is kept
    loaded = Loaded(Rounds(spark, "loaded").keep(load(spark, path, format, **options).rows))
    bad = loaded.errors.limit(20).collect() if strict else []
    if bad:
        raise ParseFailure(path, "; ".join(f"{r.path}: {r.error}" for r in bad))
    tiers = loaded.tiers()
    out = Corpus.from_tiers(spark, name, tiers, [x for x in order if x in tiers])
    if sounds is not None:
        out.speaks_in = loaded.channels(sound_info(spark, sounds))
    return out


def sound_info(spark: SparkSession, path: str) -> DataFrame:
    """discourse (the file's stem), path, sampling_rate, n_channels and duration of WAV files, from their headers; nulls where a header can't be read."""
    import io
    import wave

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    with wave.open(io.BytesIO(bytes(content))) as sound:
                        out.append((where, sound.getframerate(), sound.getnchannels(), sound.getnframes() / sound.getframerate()))
                except (wave.Error, EOFError, ZeroDivisionError):
                    out.append((where, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sampling_rate", "n_channels", "duration"]).astype({"sampling_rate": "Int32", "n_channels": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sampling_rate int, n_channels int, duration double").select(stem(F.col("path")).alias("discourse"), "path", "sampling_rate", "n_channels", "duration")


def tracks_from_csv(spark: SparkSession, path: str, discourse: Callable[[Column], Column] = stem, measures: Sequence[str] | None = None) -> DataFrame:
    """discourse (of the path; the file's stem by default), time and the measures of CSVs with the header time,m1,...

    measures: their names in the order of the files' columns; without them Spark lists all files once more to read a header. A file
    whose header says otherwise is an error then.
    """
    modest_listing(spark)
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    if measures is not None:
        reader = reader.option("enforceSchema", False).schema(StructType([StructField(c, StringType()) for c in ("time", *measures)]))
    raw = reader.csv(path)
    measures = [c for c in raw.columns if c != "time"]
    return raw.select(discourse(F.col("_metadata.file_path")).alias("discourse"), F.round(F.col("time").try_cast("double"), 3).alias("time"), *(F.col(c).try_cast("double").alias(c) for c in measures)).where("time is not null")


# -- guessing -----------------------------------------------------------------------------

# Mean durations of words and segments in seconds, and their deviation.
WORD_MEAN, SEGMENT_MEAN, DEVIATION = 0.2465, 0.0833, 0.0318


def guess_tiers(tokens: DataFrame) -> DataFrame:
    """tier, mean, kind: word or segment, whichever makes the tier's mean duration likelier."""
    mean = F.avg(F.when((F.col("label") != "") & (F.col("end") > F.col("begin")), F.col("end") - F.col("begin")))
    near = lambda m: F.exp(-F.pow(F.col("mean") - m, 2) / (2 * DEVIATION**2))
    return tokens.groupBy("tier").agg(mean.alias("mean")).withColumn("kind", F.when(near(WORD_MEAN) > near(SEGMENT_MEAN), "word").when(F.col("mean").isNotNull(), "segment"))


# Labels of tones and break indices.
_TONES = r"^[*!]?[HL][*%!+\-HL]*$"


def guess_type(values: DataFrame, column: str, delimiters: str = ".;,-") -> DataFrame:
    """One row: numeric, tobi (tones), transcription (values with delimiters), grouping (fewer than a tenth are distinct, and none has white space) or orthography, by the majority of values."""
    c = F.col(column)
    kind = F.when(c.try_cast("double").isNotNull(), "numeric").when(c.rlike(_TONES), "tobi").when(c.rlike(f"[^{re.escape(delimiters)}][{re.escape(delimiters)}][^{re.escape(delimiters)}]"), "transcription").otherwise("orthography")
    found = values.where(c.isNotNull()).agg(F.mode(kind, True).alias("kind"), F.count_distinct(c).alias("_n"), F.count("*").alias("_all"), F.count_if(c.rlike(r"\s")).alias("_spaced"))
    return found.select(F.when((F.col("kind") == "orthography") & (F.col("_n") * 10 < F.col("_all")) & (F.col("_spaced") == 0), "grouping").otherwise(F.col("kind")).alias("kind"))


def guess_delimiter(values: DataFrame, column: str, delimiters: str = ".;,-") -> str | None:
    """The delimiter that stands inside most values, the first of equals; None if none stands in any."""
    counts = values.agg(*(F.count_if(F.col(column).rlike(rf".{re.escape(d)}.")).alias(str(i)) for i, d in enumerate(delimiters))).first()
    best = max(range(len(delimiters)), key=lambda i: (counts[str(i)] or 0, -i))
    return delimiters[best] if counts[str(best)] else None
