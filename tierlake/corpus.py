"""A corpus: token tables by level with a foreign key for each level above, type tables, entities and tracks."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.errors import AttributeMissing, QueryError
from tierlake.operators import enrich, measures, pauses, scans, syllables, tracks, windows
from tierlake.operators.edits import applied
from tierlake.operators.rangejoin import asof, containing, within
from tierlake.schema import TOKEN_COLUMNS, Schema
from tierlake.shared import Rounds

KEYS = ("discourse", "speaker")
_LOG = ("id", "op", "at", "cleared")
Table = DataFrame | Callable[[], DataFrame]


def _identified(level: str, table: DataFrame) -> DataFrame:
    """table with an id from what each token is; tokens that are the same in all of that are numbered."""
    if "id" in table.columns:
        return table
    what = [*KEYS, "begin", "end", "label"]
    again = F.row_number().over(Window.partitionBy(*what).orderBy(F.lit(1)))
    # nothing is added for the first, whose id is what it would be alone
    return table.withColumn("id", F.sha1(F.concat_ws("|", F.lit(level), *what, F.when(again > 1, again))))


def list_corpora(spark: SparkSession, root: str) -> list[str]:
    """Names of the corpora saved under a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


class _Levels(dict):
    """level -> table. A table may be given as a function, which is called when the level is first asked for; opened(level, table) hears of each."""

    def __init__(self, tables: dict, opened: Callable[[str, DataFrame], None]):
        super().__init__(tables)
        self._opened, self._told = opened, set()

    def __getitem__(self, level: str) -> DataFrame:
        table = super().__getitem__(level)
        if callable(table):
            table = table()
            super().__setitem__(level, table)
        if level not in self._told:
            self._told.add(level)
            self._opened(level, table)
        return table

    def get(self, level: str, default=None):
        return self[level] if level in self else default

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]


class _Entities:
    """A table of entities; it may be given as a function, which is called when the table is first asked for."""

    def __set_name__(self, owner, name: str):
        self.name = f"_{name}"

    def __get__(self, corpus, owner=None):
        table = corpus.__dict__[self.name]
        if callable(table):
            table = corpus.__dict__[self.name] = table()
        return table

    def __set__(self, corpus, table) -> None:
        corpus.__dict__[self.name] = table


class Corpus:
    """Tables are lazy; enrichment replaces them by new plans, and save() writes them as a new version.

    tokens: level -> id, label, begin, end, speaker, discourse, <higher>_id ..., properties.
    types: level -> label and properties of its types. Entities have name and properties;
    speaks_in has speaker, discourse, channel. Any table may be given as a function without arguments: it is
    opened when something asks for it, so a query of one level doesn't read the files of the others.
    """

    speakers, discourses, speaks_in = _Entities(), _Entities(), _Entities()

    def __init__(self, spark: SparkSession, name: str, schema: Schema, tokens: dict[str, Table], types: dict[str, Table] | None = None, speakers: Table | None = None, discourses: Table | None = None, speaks_in: Table | None = None):
        self.spark, self.name, self.schema = spark, name, schema
        for level in tokens:
            schema.require(level)
        plain = lambda c: c not in TOKEN_COLUMNS and not c.endswith("_id") and c not in ("is_pause", "subsets")
        self.tokens = _Levels(tokens, lambda level, table: schema.add("token", level, **{c: k for c, k in table.dtypes if plain(c)}))
        self.types = _Levels(types or {}, lambda level, table: schema.add("type", level, **{c: k for c, k in table.dtypes if c not in ("label", "subsets")}))
        low = lambda *columns: self.tokens[schema.lowest].select(*columns).distinct()
        self.speakers = speakers if speakers is not None else lambda: low(F.col("speaker").alias("name"))
        self.discourses = discourses if discourses is not None else lambda: low(F.col("discourse").alias("name"))
        self.speaks_in = speaks_in if speaks_in is not None else lambda: low("speaker", "discourse", F.lit(0).alias("channel"))
        #: Segments of time that chains are cut into, where one chain is too long for a task; 0 leaves them whole. A cut
        #: chain is read several times, so what is scanned is written to the shared folder first.
        self.pieces = 0
        self._rounds: Rounds | None = None
        self.subannotations: dict[tuple[str, str], DataFrame] = {}
        self.tracks: dict[str, DataFrame] = {}

    # -- chains

    def _written(self, table: DataFrame) -> DataFrame:
        """A table that scans of cut chains may read again and again."""
        self._rounds = self._rounds or Rounds(self.spark, "chains")
        return self._rounds.keep(table)

    def _within(self, points: DataFrame, spans: DataFrame, time: str, columns: Sequence[str], inner: bool = True) -> DataFrame:
        """within() by discourse and speaker, over spans from _b to _e, in segments if chains are cut."""
        if self.pieces:
            return scans.within(self._written(points), self._written(spans), KEYS, time, "_b", "_e", columns, inner, pieces=self.pieces)
        return within(points, spans, KEYS, time, "_b", "_e", columns, inner)

    def _asof(self, points: DataFrame, marks: DataFrame, columns: Sequence[str]) -> DataFrame:
        if self.pieces:
            return scans.asof(self._written(points), self._written(marks), KEYS, "time", "_b", columns, pieces=self.pieces)
        return asof(points, marks, KEYS, "time", "_b", columns)

    # -- building

    @classmethod
    def from_tiers(cls, spark: SparkSession, name: str, tiers: dict[str, DataFrame], order: Sequence[str]) -> Corpus:
        """From unlinked tiers, `order` from the lowest level to the highest: a token belongs to the one above that holds its midpoint; of several, to the one that ends last."""
        schema = Schema({level: (order[i + 1] if i + 1 < len(order) else None) for i, level in enumerate(order)})
        tables = {level: _identified(level, tiers[level].withColumns({"begin": F.least("begin", "end"), "end": F.greatest("begin", "end")})) for level in order}
        tokens = {}
        for i, level in enumerate(order):
            table = tables[level].withColumn("_mid", (F.col("begin") + F.col("end")) / 2)
            for up in order[i + 1 :]:
                if f"{up}_id" not in table.columns:
                    spans = tables[up].select(*KEYS, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("id").alias(f"{up}_id"))
                    table = within(table, spans, KEYS, "_mid", "_b", "_e", [f"{up}_id"], inner=False)
            tokens[level] = table.drop("_mid")
        return cls(spark, name, schema, tokens)

    def add(self, other: Corpus) -> None:
        """Take over the discourses of a corpus with the same levels; one that is here already is refused."""
        if other.schema.contains != self.schema.contains:
            raise QueryError("the corpora have other levels")
        twice = self.discourses.select("name").intersect(other.discourses.select("name")).limit(5).collect()
        if twice:
            raise QueryError(f"discourses that are here already: {', '.join(str(r.name) for r in twice)}")
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        self.tokens = {k: both(v, other.tokens[k]) for k, v in self.tokens.items()}
        for mine, theirs in ((self.subannotations, other.subannotations), (self.tracks, other.tracks)):
            mine.update({k: both(mine[k], v) if k in mine else v for k, v in theirs.items()})
        for level, table in other.types.items():
            own = self.types.get(level)
            self.types[level] = table if own is None else both(own, table.join(own.select("label"), "label", "left_anti"))
        self.speakers = both(self.speakers, other.speakers.join(self.speakers.select("name"), "name", "left_anti"))
        self.discourses, self.speaks_in = both(self.discourses, other.discourses), both(self.speaks_in, other.speaks_in)
        self.schema.update(other.schema)

    # -- state

    @property
    def has_pauses(self) -> bool:
        return self.schema.word_name is not None and "is_pause" in self.tokens[self.schema.word_name].columns

    @property
    def has_utterances(self) -> bool:
        return "utterance" in self.schema.contains

    @property
    def has_syllables(self) -> bool:
        return "syllable" in self.schema.contains

    @property
    def has_syllabics(self) -> bool:
        return "syllabic" in self.schema.type_subsets.get(self.schema.phone_name or "", [])

    def labels(self, level: str) -> DataFrame:
        """The distinct labels of a level."""
        self.schema.require(level)
        return self.tokens[level].select("label").where("label is not null").distinct()

    @property
    def words(self) -> DataFrame:
        """The distinct labels of words."""
        return self.labels(self.schema.word_name)

    @property
    def phones(self) -> DataFrame:
        """The distinct labels of phones."""
        return self.labels(self.schema.phone_name)

    def genders(self, name: str = "gender") -> DataFrame:
        """The distinct values of a property of speakers; none, if they don't have it."""
        if name not in self.speakers.columns:
            return self.spark.createDataFrame([], f"{name} string")
        return self.speakers.select(name).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()

    @staticmethod
    def exists(spark: SparkSession, root: str, name: str) -> bool:
        """Whether a corpus of that name is saved under a folder."""
        return name in list_corpora(spark, root)

    def speakers_in(self, discourse: str) -> DataFrame:
        return self.speaks_in.where(F.col("discourse") == discourse).select("speaker").distinct()

    def discourses_of(self, speaker: str) -> DataFrame:
        return self.speaks_in.where(F.col("speaker") == speaker).select("discourse").distinct()

    def channel_of(self, speaker: str, discourse: str) -> DataFrame:
        return self.speaks_in.where((F.col("speaker") == speaker) & (F.col("discourse") == discourse)).select("channel")

    # -- enrichment

    def type_table(self, level: str) -> DataFrame:
        """One row for each label of a level, with the properties known of it."""
        return self.types.get(level, self.labels(level))

    def encode_pauses(self, words: Sequence[str] | str) -> None:
        level = self.schema.word_name
        self.tokens[level] = pauses.encode_pauses(self.tokens[level], words)
        bounds = pauses.speech_bounds(self.tokens[level])
        self.discourses = enrich.enrich(self.discourses, bounds, "name", "discourse")

    def reset_pauses(self) -> None:
        level = self.schema.word_name
        self.tokens[level] = self.tokens[level].drop("is_pause")
        self.discourses = self.discourses.drop("speech_begin", "speech_end")

    def utterance_words(self, shortest_pause: float = 0.5, shortest: float = 0.0) -> DataFrame:
        """discourse, speaker, utterance, begin, end and the ids of the first and last word of each utterance, without a level for them."""
        table = self.tokens[self.schema.word_name]
        table = table if self.has_pauses else table.withColumn("is_pause", F.lit(False))
        found = pauses.utterances(self._written(table) if self.pieces else table, shortest_pause, shortest, KEYS, self.pieces)
        spans = found.select(*KEYS, "utterance", F.col("begin").alias("_b"), F.col("end").alias("_e"))
        inside = self._within(table.where(~F.col("is_pause")).select(*KEYS, "id", "begin"), spans, "begin", ["utterance"])
        ends = inside.groupBy(*KEYS, "utterance").agg(F.min_by("id", F.struct("begin", "id")).alias("first_id"), F.max_by("id", F.struct("begin", "id")).alias("last_id"))
        return found.join(ends, [*KEYS, "utterance"]).select(*KEYS, "utterance", "begin", "end", "first_id", "last_id")

    def encode_utterances(self, shortest_pause: float = 0.5, shortest: float = 0.0) -> None:
        """A level above words; tokens of all levels get the utterance that holds their midpoint."""
        if self.has_utterances:
            self.reset_utterances()
        words = self.schema.word_name
        table = self.tokens[words] if self.has_pauses else self.tokens[words].withColumn("is_pause", F.lit(False))
        found = pauses.utterances(self._written(table) if self.pieces else table, shortest_pause, shortest, KEYS, self.pieces)
        found = found.select(F.sha1(F.concat_ws("|", F.lit("utterance"), *KEYS, "utterance")).alias("id"), F.lit(None).cast("string").alias("label"), "begin", "end", *KEYS)
        spans = found.select(*KEYS, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("id").alias("utterance_id"))
        for level in [words, *self.schema.lower(words)]:
            mid = self.tokens[level].withColumn("_mid", (F.col("begin") + F.col("end")) / 2)
            self.tokens[level] = self._within(mid, spans, "_mid", ["utterance_id"], inner=False).drop("_mid")
        self.schema.add_level("utterance", self.schema.contains[words], words)
        self.tokens["utterance"] = found

    def reset_utterances(self) -> None:
        self._drop_level("utterance")

    def _drop_level(self, level: str) -> None:
        for x in self.schema.lower(level):
            self.tokens[x] = self.tokens[x].drop(f"{level}_id")
        self.schema.remove_level(level)
        self.tokens.pop(level, None)

    def encode_class(self, labels: Sequence[str], name: str, level: str | None = None) -> None:
        """A subset of types by their labels."""
        level = level or self.schema.phone_name
        self.types[level] = enrich.encode_class(self.type_table(level), labels, name)
        self.schema.add_subset("type", level, name)

    def reset_class(self, name: str, level: str | None = None) -> None:
        """Take a subset of types away."""
        level = level or self.schema.phone_name
        if "subsets" in self.type_table(level).columns:
            self.types[level] = enrich.remove_subset(self.types[level], F.lit(True), name)
        self.schema.remove_subset("type", level, name)

    def encode_syllables(self, nuclei: Sequence[str], method: str = "maxonset", custom_onsets: Sequence[Sequence[str]] | None = None) -> None:
        """A level between phones and words."""
        if self.has_syllables:
            self._drop_level("syllable")
        phones, words = self.schema.phone_name, self.schema.word_name
        found = syllables.encode_syllables(self.tokens[phones], nuclei, method, custom_onsets, f"{words}_id")
        ups = [f"{u}_id" for u in self.schema.higher(phones) if f"{u}_id" in self.tokens[phones].columns]
        whole = self.tokens[phones].select(F.col("id").alias("phone_id"), *KEYS, *[u for u in ups if u != f"{words}_id"]).join(found.hint("merge"), "phone_id")  # as many rows as phones, whatever Spark guesses
        self.tokens["syllable"] = whole.groupBy(F.col("syllable_id").alias("id")).agg(*(F.min(c).alias(c) for c in ("label", "begin", "end", *KEYS, *ups, "place")))
        own = found.select(F.col("phone_id").alias("id"), "syllable_id", F.col("part").alias("syllable_position"))
        self.tokens[phones] = self.tokens[phones].join(own.hint("merge"), "id", "left")
        self.schema.add_level("syllable", words, phones)
        self.schema.add("token", phones, syllable_position="string")
        self.schema.add("token", "syllable", place="int")

    def reset_syllables(self) -> None:
        """Take the level of syllables and what phones know of it away."""
        self._drop_level("syllable")
        phones = self.schema.phone_name
        self.tokens[phones] = self.tokens[phones].drop("syllable_position")
        self.schema.remove("token", phones, "syllable_position")

    def encode_stress_to_syllables(self, pattern: str = "[0-9]", clean: bool = True, name: str = "stress") -> None:
        """What the pattern finds in a syllable's nucleus (digits of its label); phones lose it, if clean."""
        phones = self.schema.phone_name
        found, plain = syllables.stress_from_label(F.col("label"), pattern)
        own = self.tokens[phones].where("syllable_position = 'nucleus' and syllable_id is not null").select(F.col("syllable_id").alias("id"), found.alias(name))
        self.tokens["syllable"] = self.tokens["syllable"].drop(name).join(own.groupBy("id").agg(F.max(name).alias(name)), "id", "left")
        if clean:
            self.tokens[phones] = self.tokens[phones].withColumn("label", plain)
            self.tokens["syllable"] = self.tokens["syllable"].withColumn("label", F.regexp_replace("label", pattern, ""))
        self.schema.add("token", "syllable", **{name: "string"})

    def encode_stress_from_word_property(self, prop: str, name: str = "stress") -> None:
        """Each syllable's part of a word property such as 0-1-0, where it has as many parts as the word has syllables."""
        words = self.schema.word_name
        table = self.tokens[words]
        if prop not in table.columns:
            table = table.join(self.type_table(words).select("label", prop), "label", "left")
        own = self.tokens["syllable"]
        sizes = own.groupBy(f"{words}_id").agg(F.count("*").alias("_size"))
        side = own.select("id", f"{words}_id", "place").join(sizes, f"{words}_id").join(table.select(F.col("id").alias(f"{words}_id"), prop), f"{words}_id")
        self.tokens["syllable"] = own.drop(name).join(side.select("id", syllables.stress_from_word_property(side, prop, "place", "_size").alias(name)), "id", "left")
        self.schema.add("token", "syllable", **{name: "string"})

    def _in_subset(self, level: str, subset: str | None) -> Column | None:
        """Whether a token, or its type, is in a subset; tokens of types() come with type_subsets."""
        if subset is None:
            return None
        return F.coalesce(F.array_contains("subsets" if self.schema.subset_part(level, subset) == "token" else "type_subsets", subset), F.lit(False))

    def _with_type_subsets(self, level: str, subset: str | None) -> DataFrame:
        table = self.tokens[level]
        if subset is None or self.schema.subset_part(level, subset) == "token":
            return table
        return table.join(self.types[level].select("label", F.col("subsets").alias("type_subsets")), "label", "left")

    def encode_position(self, higher: str, lower: str, name: str, subset: str | None = None) -> None:
        """1 + the number of tokens (of a subset) that begin earlier in the token above."""
        table = self._with_type_subsets(lower, subset)
        self.tokens[lower] = table.withColumn(name, windows.position([f"{higher}_id"], "begin", self._in_subset(lower, subset)).cast("int")).drop("type_subsets")
        self.schema.add("token", lower, **{name: "int"})

    def encode_utterance_position(self) -> None:
        self.encode_position("utterance", self.schema.word_name, "position_in_utterance")

    def reset_utterance_position(self) -> None:
        self.reset_property(self.schema.word_name, "position_in_utterance")

    def encode_speech_rate(self, subset: str, level: str | None = None) -> None:
        """Tokens of a subset (syllabics) a second of each utterance."""
        self.encode_count("utterance", level or self.schema.phone_name, "speech_rate", as_rate=True, subset=subset)

    def reset_speech_rate(self) -> None:
        self.reset_property("utterance", "speech_rate")

    def reset_property(self, level: str, *names: str) -> None:
        """Take properties of tokens and types away; those that aren't there are no error."""
        self.tokens[level] = self.tokens[level].drop(*names)
        if level in self.types:
            self.types[level] = self.types[level].drop(*names)
        for part in ("token", "type"):
            self.schema.remove(part, level, *names)

    def reset_properties_of(self, table: DataFrame, level: str | None = None, entity: str | None = None) -> list[str]:
        """Take away from a level's tokens and types, or from an entity, all properties that a table (as read from a CSV) gave them: its columns but the first, which is the key; returns their names."""
        if (level is None) == (entity is None):
            raise QueryError("properties belong to a level or to an entity")
        names = table.columns[1:]
        if level is not None:
            self.reset_property(level, *names)
        else:
            self.reset_entity_property(entity, *names)
        return names

    def reset_entity_property(self, entity: str, *names: str) -> None:
        """Take properties of speakers or discourses away."""
        setattr(self, f"{entity}s", getattr(self, f"{entity}s").drop(*names))
        self.schema.remove(entity, None, *names)

    # -- measures

    def _measured(self, level: str, prop: str) -> DataFrame:
        """id, label, speaker, higher ids and _x, a token's value of a property (its duration, unless it has such a property)."""
        table = self.tokens[level]
        value = F.col("end") - F.col("begin") if prop == "duration" and prop not in table.columns else F.col(prop)
        return table.withColumn("_x", value.cast("double"))

    def measure(self, level: str, statistic: str = "mean", prop: str = "duration", by_speaker: bool = False, speaker: str | None = None) -> DataFrame:
        """label (and speaker) and a statistic (mean, stdev, median, min, max, sum, count, ...) of a property over a level's tokens, or those of one speaker."""
        table = self._measured(level, prop)
        table = table.where(F.col("speaker") == speaker) if speaker is not None else table
        return table.groupBy("label", *(["speaker"] if by_speaker else [])).agg(measures.statistic(statistic, "_x").alias(f"{statistic}_{prop}"))

    def encode_measure(self, level: str, statistic: str = "mean", prop: str = "duration", by_speaker: bool = False) -> str:
        """Keep a statistic with the types, or with tokens if it differs by speaker; returns its name."""
        name = f"{'sd' if statistic == 'stdev' else statistic}_{prop}{'_by_speaker' if by_speaker else ''}"
        found = self.measure(level, statistic, prop, by_speaker).withColumnRenamed(f"{statistic}_{prop}", name)
        if by_speaker:
            self.tokens[level] = self.tokens[level].drop(name).join(found, ["label", "speaker"], "left")
        else:
            self.types[level] = self.type_table(level).drop(name).join(found, "label", "left")
        self.schema.add("token" if by_speaker else "type", level, **{name: "double"})
        return name

    def _kept(self, level: str, found: DataFrame, name: str) -> str:
        self.tokens[level] = self.tokens[level].drop(name).join(found.select("id", name), "id", "left")
        self.schema.add("token", level, **{name: "double"})
        return name

    def _type_key(self, by_speaker: bool) -> list[str]:
        return ["label", "speaker"] if by_speaker else ["label"]

    def encode_baseline(self, level: str, prop: str = "duration", by_speaker: bool = False, lower: str | None = None) -> str:
        """For each token of a level the sum of the mean values of its phones' types."""
        lower, name = lower or self.schema.lowest, f"baseline_{prop}{'_by_speaker' if by_speaker else ''}"
        parent = "id" if level == lower else f"{level}_id"
        found = measures.baseline(self._measured(lower, prop).where(F.col(parent).isNotNull()), "_x", self._type_key(by_speaker), [parent], name)
        return self._kept(level, found.withColumnRenamed(parent, "id"), name)

    def encode_relativized(self, level: str, prop: str = "duration", by_speaker: bool = False, lower: str | None = None) -> str:
        """The z-score of a phone within its type; for a higher level the mean of its phones' z-scores."""
        lower, name = lower or self.schema.lowest, f"relativized_{prop}{'_by_speaker' if by_speaker else ''}"
        table = self._measured(lower, prop)
        if level == lower:
            return self._kept(level, measures.relativised(table, "_x", self._type_key(by_speaker), name), name)
        parent = f"{level}_id"
        found = measures.relativised_parent(table.where(F.col(parent).isNotNull()), "_x", self._type_key(by_speaker), [parent], name)
        return self._kept(level, found.withColumnRenamed(parent, "id"), name)

    def average_speech_rate(self, level: str | None = None, subset: str | None = None) -> DataFrame:
        """speaker, average_rate: the mean over a speaker's utterances of tokens (of a subset) a second."""
        level = level or ("syllable" if self.has_syllables else self.schema.word_name)
        rates = self._rated("utterance", level, subset)
        return rates.groupBy("speaker").agg(F.avg("rate").alias("average_rate"))

    def _rated(self, higher: str, lower: str, subset: str | None = None) -> DataFrame:
        below = self._with_type_subsets(lower, subset).where(F.col(f"{higher}_id").isNotNull())
        flag = self._in_subset(lower, subset)
        return pauses.rate(self.tokens[higher], below if flag is None else below.where(flag), "id", f"{higher}_id")

    def encode_count(self, higher: str, lower: str, name: str, as_rate: bool = False, subset: str | None = None) -> None:
        found = self._rated(higher, lower, subset)
        self.tokens[higher] = found.withColumnRenamed("rate" if as_rate else "n", name).drop("n" if as_rate else "rate")
        self.schema.add("token", higher, **{name: "double" if as_rate else "bigint"})

    def encode_rate(self, higher: str, lower: str, name: str, subset: str | None = None) -> None:
        self.encode_count(higher, lower, name, as_rate=True, subset=subset)

    def enrich_types(self, level: str, properties: DataFrame, case_sensitive: bool = False) -> None:
        """Type properties by label; those already present stay."""
        self.types[level] = enrich.enrich(self.type_table(level), properties, "label", case_sensitive=case_sensitive, keep_present=True)
        self.schema.add("type", level, **dict(properties.dtypes[1:]))

    def enrich_speakers(self, properties: DataFrame) -> None:
        self.speakers = enrich.enrich(self.speakers, properties, "name")
        self.schema.add("speaker", None, **dict(properties.dtypes[1:]))

    def enrich_discourses(self, properties: DataFrame) -> None:
        self.discourses = enrich.enrich(self.discourses, properties, "name")
        self.schema.add("discourse", None, **dict(properties.dtypes[1:]))

    def enrich_tokens(self, level: str, properties: DataFrame, key: str = "id") -> None:
        self.tokens[level] = enrich.enrich(self.tokens[level], properties, "id", key)
        self.schema.add("token", level, **{c: k for c, k in properties.dtypes if c != key})

    def enrich_tokens_at(self, level: str, properties: DataFrame, time: str = "time") -> None:
        """Properties of all tokens of a discourse that hold a time, ends included, whoever speaks them; only of the named speaker if properties have a speaker. A token that several rows hit gets the greatest of each property."""
        own = [c for c in properties.columns if c not in (*KEYS, time)]
        spans = self.tokens[level].select(*KEYS, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("id").alias("_id"))
        keys = KEYS if "speaker" in properties.columns else ("discourse",)
        at = containing(properties, spans, keys, time, "_b", "_e", ["_id"]).withColumnRenamed("_id", "id")
        self.enrich_tokens(level, at.groupBy("id").agg(*(F.max(c).alias(c) for c in own)))

    def add_subannotations(self, level: str, name: str, rows: DataFrame) -> None:
        """rows: id, annotated_id, begin, end and properties."""
        self.subannotations[level, name] = rows.withColumns({"begin": F.least("begin", "end"), "end": F.greatest("begin", "end")})
        self.schema.add_subannotation(level, name, **dict(rows.dtypes))

    def edit_tokens(self, level: str, edits: DataFrame) -> None:
        """A log of edits by id (see operators.edits): properties set and cleared, tokens added and deleted; a token whose end would come before its begin has both exchanged."""
        self.tokens[level] = applied(self.tokens[level], edits, span=("begin", "end"))
        self.schema.add("token", level, **{c: k for c, k in edits.dtypes if c not in _LOG})

    def edit_subannotations(self, level: str, name: str, edits: DataFrame, overwrite_edited: bool = True) -> None:
        """A log of edits of subannotations by id, the same; new ones name their token in annotated_id, and those of tokens that aren't there are left out. Without overwrite_edited those whose property `edited` is true stay as they are, as when an analysis is run again over corrected ones."""
        own = {c: k for c, k in edits.dtypes if c not in _LOG[1:]}
        table = self.subannotations.get((level, name))
        if table is None:
            own = {"id": own["id"], **{"annotated_id": dict(self.tokens[level].dtypes)["id"], "begin": "double", "end": "double"}, **own}
            table = self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in own.items()))
        if not overwrite_edited and "edited" in table.columns:
            edits = edits.join(table.where("edited").select("id").distinct(), "id", "left_anti")
        rows = applied(table, edits, span=("begin", "end"))
        self.add_subannotations(level, name, rows.join(self.tokens[level].select(F.col("id").alias("annotated_id")), "annotated_id", "left_semi"))

    # -- tracks

    def save_acoustic_track(self, name: str, points: DataFrame, time: str = "time") -> None:
        """Add points (discourse, speaker, time and measures) to a track; each gets the label of the last phone, word and syllable that began before it."""
        points = points.withColumnRenamed(time, "time")
        for level in (self.schema.phone_name, self.schema.word_name, "syllable"):
            if level in self.tokens:
                names = self.tokens[level].select(*KEYS, F.col("begin").alias("_b"), F.col("label").alias(f"{level}_label"))
                points = self._asof(points, names, [f"{level}_label"])
        if "utterance" in self.tokens:
            points = self._in_utterances(points)
        old = self.tracks.get(name)
        self.tracks[name] = points if old is None else old.unionByName(points, allowMissingColumns=True)
        self.schema.tracks[name] = dict(self.tracks[name].dtypes)

    def _in_utterances(self, points: DataFrame) -> DataFrame:
        spans = self.tokens["utterance"].select(*KEYS, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("id").alias("utterance_id"))
        return self._within(points.drop("utterance_id"), spans, "time", ["utterance_id"], inner=False)

    def reassess_utterances(self, name: str) -> None:
        """Tell the points of a track their utterances anew; null outside of all."""
        self.tracks[name] = self._in_utterances(self.tracks[name])
        self.schema.tracks[name] = dict(self.tracks[name].dtypes)

    def has_acoustics(self, discourse: str, name: str) -> bool:
        """Whether a discourse has a point of a track."""
        return name in self.tracks and bool(self.tracks[name].where(F.col("discourse") == discourse).limit(1).count())

    def reset_acoustics(self, *names: str) -> None:
        """Take tracks away; all, if none is named."""
        for name in names or [*self.tracks]:
            self.tracks.pop(name, None)
            self.schema.tracks.pop(name, None)

    def acoustic_measure(self, name: str, discourse: str, begin: float, end: float, num_points: int = 0, relative_time: bool = False, **tags: object) -> DataFrame:
        """time and the measures of a track in a stretch of a discourse, both ends included to the thousandth; of tokens and speakers with given tags only: columns of the track such as speaker or phone_label, with a value or a list.

        num_points: means of so many equal parts of the stretch instead, at the parts' begins; a part without
        points has nulls. relative_time: from 0 at the begin to 1 at the end.
        """
        table = self.tracks[name]
        unknown = [t for t in tags if t not in table.columns]
        if unknown:
            raise AttributeMissing(f"points of {name} have no {', '.join(unknown)}")
        begin, end = round(float(begin), 3), round(float(end), 3)
        if end <= begin:
            raise QueryError("a stretch ends after it begins")
        hit = (F.col("discourse") == discourse) & F.col("time").between(begin, end)
        for tag, value in tags.items():
            hit = hit & (F.col(tag).isin([*value]) if isinstance(value, (list, tuple, set)) else F.col(tag).isNull() if value is None else F.col(tag) == value)
        measures_of = [c for c, k in table.dtypes if k in ("double", "float", "int", "bigint") and c != "time"]
        points = table.where(hit).select(F.col("time").cast("double").alias("time"), *measures_of)
        if num_points:
            width = (end - begin) / num_points
            part = F.least(F.floor((F.col("time") - begin) / width), F.lit(num_points - 1))
            means = points.groupBy(part.alias("_part")).agg(*(F.avg(m).alias(m) for m in measures_of))
            points = self.spark.range(num_points).withColumnRenamed("id", "_part").join(means, "_part", "left").select((F.col("_part") * width + begin).alias("time"), *measures_of)
        return points.withColumn("time", (F.col("time") - begin) / (end - begin)) if relative_time else points

    def utterance_acoustics(self, name: str, utterance_id: str | None = None, discourse: str | None = None, speaker: str | None = None) -> DataFrame:
        """time and the measures of a track in one utterance, or in all of a discourse or speaker that is named."""
        table = self.tracks[name]
        wanted = {"utterance_id": utterance_id, "discourse": discourse, "speaker": speaker}
        for column, value in wanted.items():
            if value is not None:
                table = table.where(F.col(column) == value)
        return table.select("time", *(c for c, k in table.dtypes if k in ("double", "float", "int", "bigint") and c != "time"))

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables of the corpus, named in braces: {word} and other levels, {types_word}, {speakers}, {discourses}, {speaks_in}, {track_f0}, {word_vot} for subannotations."""
        tables = {k: v for k, v in self._tables().items() if not k.startswith(("token_", "type_", "sub_"))}
        tables |= {**self.tokens, **{f"types_{k}": v for k, v in self.types.items()}, **{f"{a}_{b}": v for (a, b), v in self.subannotations.items()}}
        asked = {n for _, n, _, _ in string.Formatter().parse(text) if n}
        unknown = sorted(asked - {*tables})
        if unknown:
            raise AttributeMissing(f"the corpus has no table {', '.join(unknown)}, only {', '.join(sorted(tables))}")
        return self.spark.sql(text, **{n: tables[n] for n in asked})

    def relativise_track(self, name: str, measure: str, by: Sequence[str] = ("speaker",)) -> None:
        """Add <measure>_relativized to a track: the z-score within the groups of `by`."""
        self.tracks[name] = tracks.relativise(self.tracks[name].drop(f"{measure}_relativized"), measure, by)
        self.schema.tracks[name] = dict(self.tracks[name].dtypes)

    def reset_relativised_track(self, name: str, measure: str) -> None:
        self.tracks[name] = self.tracks[name].drop(f"{measure}_relativized")
        self.schema.tracks[name] = dict(self.tracks[name].dtypes)

    def acoustic_statistic(self, name: str, measure: str, statistic: str = "mean", by: Sequence[str] = ("speaker",)) -> DataFrame:
        """by and a statistic of a track's measure; by holds speaker, or the name of a level's label such as phone_label, or both."""
        return self.tracks[name].groupBy(*by).agg(measures.statistic(statistic, measure).alias(f"{statistic}_{measure}"))

    def encode_acoustic_statistic(self, name: str, measure: str, statistic: str = "mean", level: str | None = None, by_speaker: bool = True) -> str:
        """Keep a statistic of a track with speakers, with a level's types, or with its tokens if by both; returns its name."""
        by = ([f"{level}_label"] if level else []) + (["speaker"] if by_speaker else [])
        column = f"{statistic}_{measure}"
        found = self.acoustic_statistic(name, measure, statistic, by).withColumnRenamed(f"{level}_label", "label")
        kind = dict(found.dtypes)[column]
        if level and by_speaker:
            self.tokens[level] = self.tokens[level].drop(column).join(found, ["label", "speaker"], "left")
            self.schema.add("token", level, **{column: kind})
        elif level:
            self.types[level] = self.type_table(level).drop(column).join(found, "label", "left")
            self.schema.add("type", level, **{column: kind})
        else:
            self.speakers = self.speakers.drop(column).join(found.withColumnRenamed("speaker", "name"), "name", "left")
            self.schema.add("speaker", None, **{column: kind})
        return column

    def remove_discourse(self, discourse: str) -> None:
        """All of a discourse: its tokens with their subannotations, its points of tracks, types that no other token has, and speakers that are in no other."""
        other = lambda df, c: df.where(~F.col(c).eqNullSafe(discourse))
        gone = {level: table.where(F.col("discourse") == discourse) for level, table in self.tokens.items()}
        self.tokens = {k: other(v, "discourse") for k, v in self.tokens.items()}
        for (level, name), rows in self.subannotations.items():
            self.subannotations[level, name] = rows.join(gone[level].select(F.col("id").alias("annotated_id")), "annotated_id", "left_anti")
        for level, table in self.types.items():
            # types that were there without any token stay
            alone = gone[level].select("label").distinct().join(self.tokens[level].select("label").distinct(), "label", "left_anti")
            self.types[level] = table.join(alone, "label", "left_anti")
        self.tracks = {k: other(v, "discourse") for k, v in self.tracks.items()}
        self.speaks_in, self.discourses = other(self.speaks_in, "discourse"), other(self.discourses, "name")
        self.speakers = enrich.orphans_removed(self.speakers, self.speaks_in, "name", "speaker")

    # -- storage

    def _tables(self) -> dict[str, DataFrame]:
        return (
            {f"token_{k}": v for k, v in self.tokens.items()} | {f"type_{k}": v for k, v in self.types.items()} | {f"sub_{a}_{b}": v for (a, b), v in self.subannotations.items()}
            | {f"track_{k}": v for k, v in self.tracks.items()} | {"speakers": self.speakers, "discourses": self.discourses, "speaks_in": self.speaks_in}
        )

    def save(self, root: str, version: int) -> str:
        """Write all tables and the schema to a new folder of root; versions are never overwritten."""
        path = f"{root}/{self.name}/v{version}"
        self.schema.tracks = {k: dict(v.dtypes) for k, v in self.tracks.items()}
        self.schema.type_tables = sorted(self.types)
        for name, table in self._tables().items():
            table.write.parquet(f"{path}/{name}")
        self.spark.createDataFrame([(self.schema.to_json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
        return path

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        schema = Schema.from_json(spark.read.text(f"{path}/schema", wholetext=True).first()[0])
        read = lambda n: spark.read.parquet(f"{path}/{n}")
        types = {level: read(f"type_{level}") for level in schema.type_tables}
        out = cls(spark, path.rstrip("/").split("/")[-2], schema, {k: read(f"token_{k}") for k in schema.contains}, types, read("speakers"), read("discourses"), read("speaks_in"))
        for level, names in schema.subannotations.items():
            for n in names:
                out.subannotations[level, n] = read(f"sub_{level}_{n}")
        for n in schema.tracks:
            out.tracks[n] = read(f"track_{n}")
        return out

    # -- queries

    def __getattr__(self, name: str):
        if name.startswith("_") or "schema" not in self.__dict__:
            raise AttributeError(name)
        from tierlake.plans.dsl import Node

        if name in ("speaker", "discourse"):
            return Node(self, name, entity=True)
        if name == "pause":
            return Node(self, self.schema.word_name, pauses=True)
        if name.startswith("lexicon_"):
            return Node(self, name.removeprefix("lexicon_"), lexicon=True)
        if name in self.schema.contains:
            return Node(self, name)
        if name.rstrip("s") in self.schema.contains:
            return Node(self, name.rstrip("s"))
        raise AttributeMissing(f"the corpus has no {name!r}")

    def query(self, node) -> object:
        """A query over the tokens, types or entities of a node of this corpus."""
        from tierlake.plans.dsl import Node, Query

        if not isinstance(node, Node) or node.corpus is not self:
            raise QueryError("a query needs a level of this corpus")
        return Query(node)

    def query_speakers(self) -> object:
        """A query over speakers: c.speaker.name, their properties, and the discourses they speak in, collected."""
        return self.query(self.speaker)

    def query_discourses(self) -> object:
        return self.query(self.discourse)

    def query_metadata(self, node) -> object:
        """What the columns of a node hold: factors, numerics, levels, ranges."""
        from tierlake.plans.dsl import Metadata

        return Metadata(node)
