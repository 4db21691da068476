"""The query language: nodes and attributes of a corpus, resolved into one lazy DataFrame.

    q = c.query(c.phone).filter(c.phone.label == "aa", c.phone.word.label.regex("c.*"))
    q.columns(c.phone.label, c.phone.following.label, c.phone.word.duration).frame()

A node is the queried level or something reached from it: previous and following tokens, a level
above, the tokens of a level below, the speaker, the discourse, subannotations, the pauses
beside it, a track. Levels above are joined inner even if only shown; neighbours, tokens below
and pauses are joined left if only shown and must exist if a filter that always holds (one not
inside or_) names them. Such a filter on tokens below also narrows what is shown of them.
Neighbours skip pauses. Speakers and discourses can be queried by themselves.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.errors import AttributeMissing, QueryError
from tierlake.operators import enrich, measures, metadata, scans, tracks, windows

KEYS = ["discourse", "speaker"]
_ENDS = {"initial": 1, "final": -1, "penultimate": -2, "antepenultimate": -3}
#: How sort values are written in tokens of pages.
_EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Discrete quantiles by the shares they need; an own share where none is given.
_SHARES = {"quantile": None, "median": (0.5,), "iqr": (0.25, 0.75)}
_STATISTICS = ("min", "max", "mean", "median", "stdev")
#: Collected attributes of an entity: the entities it meets, and their channels.
_BRIDGES = {"speaker": ("discourses", "channels"), "discourse": ("speakers", "channels")}
_MIRRORED = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True, eq=False)
class Node:
    """A place in the graph: the steps that lead there from the queried level."""

    corpus: Any
    root: str
    steps: tuple = ()
    subsets: tuple[str, ...] = ()
    pauses: bool = False
    lexicon: bool = False
    entity: bool = False

    @property
    def node_key(self) -> tuple:
        return self.steps, self.subsets

    @property
    def level(self) -> str:
        for kind, value in reversed(self.steps):
            if kind in ("up", "down"):
                return value
        return self.root

    @property
    def step_kind(self) -> str:
        return self.steps[-1][0] if self.steps else "root"

    def _go(self, kind: str, value: Any = None) -> Node:
        return replace(self, steps=(*self.steps, (kind, value)), subsets=())

    def _shift(self, by: int) -> Node:
        if self.step_kind == "shift":
            return replace(self, steps=(*self.steps[:-1], ("shift", self.steps[-1][1] + by)))
        return self._go("shift", by)

    def filter_by_subset(self, *names: str) -> Node:
        for n in names:
            self.corpus.schema.subset_part(self.level, n)
        return replace(self, subsets=(*self.subsets, *names))

    def precedes(self, token_id: str) -> Clause:
        return Clause("order", (Attribute(self, "begin"), token_id, -1))

    def follows(self, token_id: str) -> Clause:
        return Clause("order", (Attribute(self, "begin"), token_id, 1))

    def not_precedes(self, token_id: str) -> Clause:
        """Tokens that don't precede a token, those of other chains included."""
        return Clause("not order", self.precedes(token_id).parts)

    def not_follows(self, token_id: str) -> Clause:
        return Clause("not order", self.follows(token_id).parts)

    def contains(self, level: str, *labels: str) -> Clause:
        """Tokens with one of the labels below them; nothing that is shown is narrowed."""
        return or_(getattr(self, level).label.in_(labels))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.corpus.schema
        if self.entity:
            known = ("name", *_BRIDGES[self.root], *getattr(schema, f"{self.root}_properties"), *getattr(self.corpus, f"{self.root}s").columns)
            if name not in known:
                raise AttributeMissing(f"{self.root} has no {name!r}")
            return Attribute(self, name)
        if self.step_kind in ("speaker", "discourse"):
            known = {"name": "", **getattr(schema, f"{self.step_kind}_properties")}
            if name not in known and name not in getattr(self.corpus, f"{self.step_kind}s").columns:
                raise AttributeMissing(f"{self.step_kind} has no {name!r}")
            return Attribute(self, name)
        if self.step_kind == "sub" or self.step_kind == "pause_run":
            return Attribute(self, name)
        if self.step_kind == "down" and name in _ENDS:
            return self._go("end", _ENDS[name])
        if self.step_kind == "end":
            return Attribute(self, name)
        if name in ("previous", "following"):
            return self._shift(-1 if name == "previous" else 1)
        if name in ("previous_pause", "following_pause"):
            return self._go("pause_run", -1 if name == "previous_pause" else 1)
        if name in ("speaker", "discourse"):
            return self._go(name)
        for word, by in (("previous_", -1), ("following_", 1)):
            if name.startswith(word):
                return getattr(self._shift(by), name.removeprefix(word))
        if name in schema.contains and name != self.level:
            if name in schema.higher(self.level):
                return self._go("up", name)
            return self._go("down", name)
        if name in schema.subannotations.get(self.level, {}):
            return self._go("sub", name)
        if name in self.corpus.tracks:
            return Track(self, name)
        # what a table has is known once it is open
        self.corpus.types.get(self.level)
        if self.lexicon:
            if name not in ("label", "subset") and not schema.has("type", self.level, name):
                raise AttributeMissing(f"types of {self.level} have no {name!r}")
            return Attribute(self, name)
        if name.endswith("_id") and name.removesuffix("_id") in schema.higher(self.level):
            return Attribute(self, name)
        known = name in ("id", "label", "begin", "end", "duration", "subset", "follows_pause", "precedes_pause", "count", "rate", "position")
        self.corpus.tokens.get(self.level)
        if not known and not schema.has("token", self.level, name) and not schema.has("type", self.level, name):
            raise AttributeMissing(f"{self.level} has no {name!r}")
        return Attribute(self, name)


class _Value:
    """Something that can be compared, shown and aggregated."""

    label: str

    def _compare(self, op: str, other: Any) -> Clause:
        """A comparison; plain values become what the schema declares the property to be."""
        if isinstance(self, Attribute) and op != "regex" and self.name != "subset":
            other = self.coerce(other)
        return Clause(op, (self, other))

    def __eq__(self, other: Any) -> Clause:  # type: ignore[override]
        return self._compare("==", other)

    def __ne__(self, other: Any) -> Clause:  # type: ignore[override]
        return self._compare("!=", other)

    def __lt__(self, other: Any) -> Clause:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Clause:
        return self._compare("<=", other)

    def __gt__(self, other: Any) -> Clause:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Clause:
        return self._compare(">=", other)

    __hash__ = object.__hash__

    def in_(self, values: Any) -> Clause:
        """Membership in a list, or in what a query's first column (or equally named attribute) yields. Nulls are in nothing, and those among the values play no part."""
        return self._compare("in", values)

    def not_in_(self, values: Any) -> Clause:
        """The values known not to be there: a null is neither in nor not in."""
        return self._compare("not in", values)

    def regex(self, pattern: str) -> Clause:
        """A match of the whole string."""
        return self._compare("regex", pattern)

    def column_name(self, label: str) -> _Value:
        self.label = label
        return self


class Attribute(_Value):
    def __init__(self, node: Node, name: str, label: str | None = None):
        self.node, self.name = node, name
        parts = [str(v) if k in ("up", "down", "sub") else {"shift": ("previous" if (v or 0) < 0 else "following") + (f"_{abs(v)}" if isinstance(v, int) and abs(v) > 1 else ""), "end": next((n for n, i in _ENDS.items() if i == v), ""), "pause_run": "previous_pause" if v == -1 else "following_pause"}.get(k, k) for k, v in node.steps]
        self.label = label or "_".join(["node", node.root, *parts, name])

    def __getattr__(self, name: str):
        if name == "duration":
            return Attribute(self.node, f"{self.name}.duration")
        raise AttributeError(name)

    @property
    def value_type(self) -> type | None:
        """The Python type of the property as the schema declares it; None for what isn't declared, such as ids and times."""
        schema, node = self.node.corpus.schema, self.node
        if node.entity or node.step_kind in ("speaker", "discourse"):
            kinds = getattr(schema, f"{node.root if node.entity else node.step_kind}_properties")
        elif node.step_kind == "sub":
            kinds = schema.subannotations.get(replace(node, steps=node.steps[:-1]).level, {}).get(node.steps[-1][1], {})
        else:
            kinds = {**schema.type_properties.get(node.level, {}), **schema.token_properties.get(node.level, {})}
        kind = kinds.get(self.name, "").split("(")[0]
        return {"string": str, "boolean": bool, "double": float, "float": float, "tinyint": int, "smallint": int, "int": int, "bigint": int}.get(kind)

    def coerce(self, value: Any) -> Any:
        """A value (or each of a list) as the declared type of the property; refused if it isn't one."""
        kind = self.value_type
        if isinstance(value, (list, tuple, set, frozenset)):
            return [self.coerce(v) for v in value]
        if value is None or kind is None or isinstance(value, (Query, _Value)) or type(value) is kind:
            return value
        if kind is bool and str(value).lower() in ("true", "false", "t", "f", "1", "0"):
            return str(value).lower() in ("true", "t", "1")
        if kind is int and isinstance(value, (float, Decimal)):
            return value  # a bound between two whole numbers
        if kind in (int, float, str) and isinstance(value, (str, int, float, Decimal)) and not (kind is not str and isinstance(value, bool)):
            try:
                return kind(value)
            except ValueError:
                pass
        raise QueryError(f"{self.name} is {kind.__name__}; {value!r} isn't")


class Track(_Value):
    """A track of the queried tokens, of those above or of neighbours; statistics of its measure."""

    def __init__(self, node: Node, track: str, statistic: str | None = None, measure: str | None = None):
        self.node, self.track, self.statistic, self.measure = node, track, statistic, measure
        place = Attribute(node, "x").label.removeprefix(f"node_{node.root}_").removesuffix("x") if node.steps else ""
        self.label = f"{place}{statistic}_{track}" if statistic else f"{place}{track}"

    def __getattr__(self, name: str) -> Track:
        if name in _STATISTICS:
            return Track(self.node, self.track, name, self.measure)
        if not name.startswith("_"):
            return Track(self.node, self.track, self.statistic, name)
        raise AttributeError(name)


class Aggregate(_Value):
    """An aggregate function; of tokens below, Sum, Average and Count give a value for each row instead. Comparisons of it filter groups."""

    def __init__(self, name: str, value: _Value | None = None, share: float = 0.5):
        self.name, self.value, self.share = name, value, share
        self.label = f"{name}_{value.label.split('_')[-1]}" if value is not None else "count_all"

    def column_name(self, label: str) -> Aggregate:
        self.label = label
        return self

    @property
    def collapses(self) -> bool:
        return not (isinstance(self.value, Attribute) and self.value.node.step_kind in ("down", "sub"))


def _aggregate(name: str) -> Callable[..., Aggregate]:
    return lambda value=None, share=0.5: Aggregate(name, value, share)


Count, Average, Sum, Stdev, Max, Min, Quantile, Median, InterquartileRange = (_aggregate(n) for n in ("count", "average", "sum", "stdev", "max", "min", "quantile", "median", "iqr"))


@dataclass(frozen=True)
class Clause:
    op: str
    parts: tuple

    def values(self) -> Iterator[_Value]:
        for p in self.parts:
            if isinstance(p, Clause):
                yield from p.values()
            elif isinstance(p, _Value):
                yield p


def and_(*clauses: Clause) -> Clause:
    return Clause("and", clauses)


def or_(*clauses: Clause) -> Clause:
    return Clause("or", clauses)


class _Plan:
    """Builds the frame of one query: what each node needs is joined once."""

    def __init__(self, query: Query):
        self.q, self.corpus, self.root = query, query.node.corpus, query.node.root
        values = [v for c in query.clauses for v in c.values() if not isinstance(v, Aggregate)]
        self.wanted = [v for v in (*values, *query.listed()) if v is not None]
        # what a clause names must exist, unless the clause is an alternative
        self.needed = {v.node.node_key for c in query.flat() if c.op != "or" for v in c.values() if not isinstance(v, Aggregate)}
        self.prefixes: dict[tuple, str] = {}
        self.markers = 0
        #: What tells a row that matches, if no row was dropped before.
        self.whole: list[Column] = []
        self.df = self._prefixed(self._frame(()), "n0")
        self.prefixes[()] = "n0"

    def _asked(self, steps: tuple, subsets: tuple[str, ...] | None = None) -> set[str]:
        """Names of the attributes asked of a node; * if something lies beyond it."""
        out: set[str] = set()
        for v in self.wanted:
            if v.node.steps == steps and subsets in (None, v.node.subsets):
                out.add(v.name if isinstance(v, Attribute) else "*")
                out |= {"subset"} if v.node.subsets else set()
            elif v.node.steps[: len(steps)] == steps and len(v.node.steps) > len(steps):
                kind = v.node.steps[len(steps)][0]
                out.add(v.name if kind == "end" and len(v.node.steps) == len(steps) + 1 else "*")
        return out

    def _typed(self, table: DataFrame, level: str, asked: set[str]) -> DataFrame:
        """table with the properties of its types, if any of them is asked for."""
        types = self.corpus.types.get(level)
        if types is None:
            return table
        names = [c for c in types.columns if c != "label" and c not in table.columns or c == "subsets"]
        if not asked & {"*", "subset", *names} and not any(n.split(".")[0] in names for n in asked):
            return table
        side = types.select(F.col("label").alias("_type"), *(F.col(c).alias("type_subsets" if c == "subsets" else c) for c in names))
        return table.join(side, F.col("label") == F.col("_type"), "left").drop("_type")

    def _columns(self, names: set[str], table: DataFrame) -> list[str]:
        """The columns of table that the named attributes are made of; all, if one is none of them."""
        parts = {"duration": ("begin", "end"), "count": (), "rate": (), "subset": ("subsets", "type_subsets")}
        if any(n not in table.columns and n not in parts for n in names):
            return [c for c in table.columns if not c.startswith("_")]
        return [c for c in table.columns if c == "id" or any(c == n or c in parts.get(n, ()) for n in names)]

    @staticmethod
    def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{prefix}__{c}") for c in df.columns))

    def _frame(self, steps: tuple) -> DataFrame:
        """The table of the queried level, or of one above, with type properties, neighbours and what pauses need."""
        node = replace(self.q.node, steps=steps)
        level, schema = node.level, self.corpus.schema
        if self.q.node.entity:
            table, asked = getattr(self.corpus, f"{self.root}s"), self._asked(())
            if asked & {*_BRIDGES[self.root]}:
                # those without a partner drop out
                other, channels = _BRIDGES[self.root]
                met = F.array_sort(F.collect_set(F.struct(F.col(other[:-1]), "channel")))
                bridge = self.corpus.speaks_in.groupBy(F.col(self.root).alias("_name")).agg(met.alias("_met"))
                bridge = bridge.select("_name", F.array_distinct(F.transform("_met", lambda x: x[other[:-1]])).alias(other), F.transform("_met", lambda x: x["channel"]).alias(channels))
                table = table.join(bridge, F.col("name") == F.col("_name")).drop("_name")
            return table
        if self.q.node.lexicon:
            return self.corpus.type_table(level)
        beyond = {n for v in self.wanted if len(v.node.steps) > len(steps) and v.node.steps[: len(steps)] == steps and v.node.steps[len(steps)][0] == "shift" for n in self._asked(v.node.steps[: len(steps) + 1])}
        flagged = {"subset"} if not steps and self.q.node.subsets or any(isinstance(v, Attribute) and v.name == "position" and v.node.subsets for v in self.wanted) else set()
        table = self._typed(self.corpus.tokens[level], level, self._asked(steps) - {"*"} | beyond | flagged | ({"*"} if any(isinstance(v, Attribute) and v.name == "*" and v.node.steps == steps for v in self.wanted) else set()))
        order, pieces = ["begin", "id"], self.corpus.pieces
        if "is_pause" in table.columns and pieces:
            written = self.corpus._written
            table = scans.neighbours(written(scans.runs(written(table), KEYS, order, "is_pause", pieces)), KEYS, order, ["is_pause"], pieces=pieces)
            beside = {"_after_pause": "previous_is_pause", "_before_pause": "following_is_pause"}
            table = table.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in beside.items()}).drop(*beside.values())
        elif "is_pause" in table.columns:
            table = windows.runs(table, KEYS, order, "is_pause")
            table = table.withColumns({"_after_pause": windows.next_to(table, KEYS, order, "is_pause", "after"), "_before_pause": windows.next_to(table, KEYS, order, "is_pause", "before")})
        if "is_pause" in table.columns:
            table = table.where(F.col("is_pause") if self.q.node.pauses and not steps else ~F.col("is_pause"))
        shifts = {v.node.steps[len(steps)][1] for v in self.wanted if len(v.node.steps) > len(steps) and v.node.steps[: len(steps)] == steps and v.node.steps[len(steps)][0] == "shift"}
        beside = {k: self._columns(self._asked((*steps, ("shift", k))), table) for k in sorted(shifts)}
        if pieces and beside:
            plain = table.withColumns({f"_beside_{k}": F.struct(*names) for k, names in beside.items()})
            near = scans.neighbours(self.corpus._written(plain), KEYS, order, [f"_beside_{k}" for k in beside], max(-min(shifts), 0), max(max(shifts), 0), pieces)
            name = lambda k: f"{'previous' if k < 0 else 'following'}_{'' if abs(k) == 1 else f'{abs(k)}_'}_beside_{k}"
            table = near.select(*table.columns, *(F.col(name(k)).alias(f"_shift_{k}") for k in beside))
        else:
            w = windows.chain(KEYS, order)
            table = table.withColumns({f"_shift_{k}": (F.lag if k < 0 else F.lead)(F.struct(*names), abs(k)).over(w) for k, names in beside.items()})
        if not steps:
            ups = [u for u in schema.higher(level) if f"{u}_id" in table.columns]
            for u in ups:
                inside = Window.partitionBy(f"{u}_id")
                aligned = any(c.op in ("left", "right", "not left", "not right") and u in c.parts for c in self.q.leaves())
                if aligned:
                    table = table.withColumns({f"_left_{u}": F.row_number().over(inside.orderBy("begin", "id")) == 1, f"_right_{u}": F.row_number().over(inside.orderBy(F.desc("end"), F.desc("id"))) == 1})
                if any(isinstance(v, Attribute) and v.name == "position" and v.node.steps[:1] == (("up", u),) for v in self.wanted):
                    for v in self.wanted:
                        if isinstance(v, Attribute) and v.name == "position" and v.node.steps[:1] == (("up", u),):
                            flag = self._subset_test(level, v.node.subsets, F.col) if v.node.subsets else None
                            table = table.withColumn(f"_position_{u}_{'_'.join(v.node.subsets)}", windows.position([f"{u}_id"], "begin", flag))
        return table

    def _subset_test(self, level: str, names: tuple[str, ...], col: Callable[[str], Column]) -> Column:
        out = F.lit(True)
        for n in names:
            place = "subsets" if self.corpus.schema.subset_part(level, n) == "token" or self.q.node.lexicon else "type_subsets"
            out = out & F.coalesce(F.array_contains(col(place), n), F.lit(False))
        return out

    def _join(self, steps: tuple, table: DataFrame, on: Callable[[str], Column], how: str) -> str:
        prefix = self.prefixes[steps] = f"n{len(self.prefixes)}"
        self.df = self.df.join(self._prefixed(table, prefix), on(prefix), how)
        return prefix

    def place(self, node: Node) -> Callable[[str], Column]:
        """Makes sure that a node is joined; gives its columns by name."""
        if not node.steps:
            return lambda c: F.col(f"n0__{c}")
        *before, (kind, value) = node.steps
        base = replace(node, steps=tuple(before), subsets=())
        at = self.place(base)
        if kind == "shift":
            return lambda c: at(f"_shift_{value}")[c]
        if kind == "end":
            return lambda c: F.try_element_at(at("_items"), F.lit(value))[c]
        key = (node.steps, node.subsets)
        needed = node.node_key in self.needed
        how = "inner" if needed else "left"
        if key not in self.prefixes:
            if kind == "up":
                prefix = self._join(key, self._frame(node.steps), lambda p: at(f"{value}_id") == F.col(f"{p}__id"), "inner")
            elif kind in ("speaker", "discourse"):
                prefix = self._join(key, getattr(self.corpus, f"{kind}s"), lambda p: at(kind) == F.col(f"{p}__name"), "inner")
            elif kind == "down":
                # a row for each token of the level above: they grow with the corpus, and Spark's guess from the size of files would send them to the driver
                prefix = self._join(key, self._below(node, f"{base.level}_id").hint("merge"), lambda p: at("id") == F.col(f"{p}__parent"), how)
            elif kind == "sub":
                table = self.corpus.subannotations[base.level, value]
                items = table.groupBy(F.col("annotated_id").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("begin", *[c for c in table.columns if c not in ("begin", "annotated_id")]))).alias("_items"))
                prefix = self._join(key, items, lambda p: at("id") == F.col(f"{p}__parent"), how)
            elif kind == "pause_run":
                level = base.level
                numbered = self.corpus._written(scans.runs(self.corpus._written(self.corpus.tokens[level]), KEYS, ["begin", "id"], "is_pause", self.corpus.pieces)) if self.corpus.pieces else None
                runs = windows.flagged_runs(self.corpus.tokens[level], KEYS, ["begin", "id"], "is_pause", "begin", "end", "label", numbered)
                beside = at("_before_pause" if value > 0 else "_after_pause")
                prefix = self._join(key, runs, lambda p: (at("discourse") == F.col(f"{p}__discourse")) & (at("speaker") == F.col(f"{p}__speaker")) & (at("run") + value == F.col(f"{p}__run")) & beside, how)
            else:
                raise QueryError(f"{kind} can't be resolved")
        prefix = self.prefixes[key]
        return lambda c: F.col(f"{prefix}__{c}")

    def _narrows(self, c: Clause) -> bool:
        """Whether a clause on tokens below always holds and needs nothing but the token."""
        first = c.parts[0]
        return c.op in _TESTS and isinstance(first, Attribute) and first.node.step_kind == "down" and first.name not in ("count", "rate") and not any(isinstance(p, _Value) for p in c.parts[1:]) and any(c is d for d in self.q.flat())

    def _item_test(self, c: Clause, at: Callable[[str], Column]) -> Column:
        """A clause on one token below, whose columns at() gives."""
        first, *rest = c.parts
        if first.name == "subset":
            try:
                hit = self._subset_test(first.node.level, (rest[0],), at)
            except QueryError:
                hit = F.lit(False)
            return hit if c.op == "==" else ~hit
        value = at("end") - at("begin") if first.name == "duration" else at(first.name)
        return _TESTS[c.op](value, *(self.column(r) if isinstance(r, _Value) else r for r in rest))

    def _item_filter(self, c: Clause) -> Callable[[Column], Column]:
        return lambda x: self._item_test(c, lambda n: x[n])

    def _below(self, node: Node, foreign: str) -> DataFrame:
        """parent, _n and, if more than their number is asked for, the tokens of a level below in order; narrowed by the filters on them."""
        level, asked = node.level, self._asked(node.steps, node.subsets)
        table = self._typed(self.corpus.tokens[level], level, asked | ({"subset"} if node.subsets else set()))
        test = self._subset_test(level, node.subsets, F.col) & F.col(foreign).isNotNull()
        clauses = [c for c in self.q.leaves() if isinstance(c.parts[0], Attribute) and c.parts[0].node.node_key == node.node_key]
        for c in clauses:
            if self._narrows(c):
                test = test & F.coalesce(self._item_test(c, F.col), F.lit(False))
        # attributes that narrow are needed only if they are shown or tested otherwise as well
        shown = {v.name for v in self.q.listed() if isinstance(v, Attribute) and v.node.node_key == node.node_key}
        names = (asked if asked - {c.parts[0].name for c in clauses} - shown else shown | {c.parts[0].name for c in clauses if not self._narrows(c)}) - {"count", "rate"}
        found = [F.count(F.lit(1)).alias("_n")]
        if names:
            own = [c for c in self._columns(names, table) if c not in ("begin", "id", foreign)]
            found.append(F.array_sort(F.collect_list(F.struct("begin", "id", *own))).alias("_items"))
        return table.where(test).groupBy(F.col(foreign).alias("parent")).agg(*found)

    def _items(self, node: Node) -> Column:
        """The tokens below that are shown: without those that a comparison with something outside refuses."""
        items = self.place(node)("_items")
        for c in self.q.flat():
            first = c.parts[0]
            if c.op in _TESTS and isinstance(first, Attribute) and first.node.node_key == node.node_key and first.name not in ("count", "rate") and not self._narrows(c):
                items = F.filter(items, self._item_filter(c))
        return items

    def marked(self, table: DataFrame, on: Callable[[str], Column]) -> Column:
        """Whether a row meets one of table, whose rows differ in what they are joined by."""
        self.markers += 1
        prefix = f"m{self.markers}"
        self.df = self.df.join(self._prefixed(table.withColumn("hit", F.lit(True)), prefix), on(prefix), "left")
        return F.coalesce(F.col(f"{prefix}__hit"), F.lit(False))

    @staticmethod
    def yielded(value: Any, inner: Query) -> DataFrame:
        """_in: what an inner query yields for an outer attribute."""
        names = [v.label for v in inner.shown]
        table = inner.frame()
        return table.select(F.col(f"`{value.label if value.label in names else table.columns[0]}`").alias("_in")) if names else table.select(F.col(value.name).alias("_in"))

    def anchor(self, c: Clause) -> tuple[DataFrame, Callable[[str], Column]]:
        """The token that a clause of order names, and what its place makes of a row."""
        value, token, side = c.parts
        at = self.place(value.node)
        one = self.corpus.tokens[value.node.level].where(F.col("id") == token).select(F.col("discourse").alias("d"), F.col("speaker").alias("s"), F.col("begin").alias("at")).dropDuplicates(["d", "s"])
        return one, lambda p: (at("discourse") == F.col(f"{p}__d")) & (at("speaker") == F.col(f"{p}__s")) & (at("begin") > F.col(f"{p}__at") if side > 0 else at("begin") < F.col(f"{p}__at"))

    def column(self, value: Any) -> Column:
        if isinstance(value, Track):
            return self._track(value)
        if not isinstance(value, Attribute):
            return F.lit(value)
        node, name = value.node, value.name
        if name == "*":
            if node.step_kind == "shift":
                return self.place(replace(node, steps=node.steps[:-1], subsets=()))(f"_shift_{node.steps[-1][1]}")
            at, prefix = self.place(node), self.prefixes[(node.steps, node.subsets)] if node.steps else "n0"
            names = [c.removeprefix(f"{prefix}__") for c in self.df.columns if c.startswith(f"{prefix}__") and not c.startswith(f"{prefix}___")]
            return F.struct(*(at(n).alias(n) for n in names))
        if name == "position":
            return F.col(f"n0___position_{node.steps[0][1]}_{'_'.join(node.subsets)}")
        at = self.place(node)
        if node.step_kind == "down" or node.step_kind == "sub":
            if name in ("count", "rate"):
                compared = any(isinstance(c.parts[0], Attribute) and c.parts[0].node.node_key == node.node_key and c.parts[0].name not in ("count", "rate") and not self._narrows(c) for c in self.q.flat() if c.op in _TESTS)
                n = F.coalesce(F.size(self._items(node)).cast("long") if compared or node.step_kind == "sub" else at("_n"), F.lit(0).cast("long"))
                if name == "count":
                    return n
                parent = self.place(replace(node, steps=node.steps[:-1], subsets=()))
                return F.try_divide(n.cast("double"), parent("end") - parent("begin"))
            items = self._items(node)
            if name == "duration":
                return F.transform(items, lambda x: x["end"] - x["begin"])
            return F.transform(items, lambda x: x[name])
        if node.step_kind == "pause_run":
            return at({"label": "labels", "duration": "run_duration", "begin": "run_begin", "end": "run_end", "count": "size"}.get(name, name))
        if name == "duration" and "duration" not in self.corpus.schema.token_properties.get(node.level, {}):
            return at("end") - at("begin")
        if name in ("follows_pause", "precedes_pause"):
            return at("_after_pause" if name == "follows_pause" else "_before_pause")
        return at(name)

    def _track(self, value: Track) -> Column:
        node = value.node
        if node.step_kind not in ("root", "up", "shift"):
            raise QueryError("a track needs one token: the queried one, one above or a neighbour")
        table = self.corpus.tracks[value.track]
        measure = value.measure or next(c for c, k in table.dtypes if k == "double" and c != "time")
        key = (("track", node.node_key, value.track, measure, value.statistic or ""),)
        if key not in self.prefixes:
            tokens, at = self.corpus.tokens[node.level], self.place(replace(node, subsets=()))
            if value.statistic:
                side = tracks.token_statistics(table, tokens, KEYS, measure)
            else:
                side = tracks.collected(tracks.slices(table, tokens, KEYS), "id", [measure], tokens=tokens)
            self._join(key, side, lambda p: at("id") == F.col(f"{p}__id"), "left")
        return F.col(f"{self.prefixes[key]}__{f'{value.statistic}_{measure}' if value.statistic else 'track'}")

    def test(self, c: Clause) -> Column:
        if c.op in ("and", "or"):
            out = None
            for p in c.parts:
                one = F.coalesce(self.test(p), F.lit(False)) if c.op == "or" else self.test(p)
                out = one if out is None else (out & one if c.op == "and" else out | one)
            return out if out is not None else F.lit(True)
        if c.op in ("left", "right", "not left", "not right"):
            hit = F.col(f"n0___{c.op.split()[-1]}_{c.parts[0]}") & F.col(f"n0__{c.parts[0]}_id").isNotNull()
            return F.col(f"n0__{c.parts[0]}_id").isNotNull() & ~hit if c.op.startswith("not") else hit
        if c.op == "who":
            names, among = c.parts
            hit = F.coalesce(F.col("n0__speaker").cast("string").isin([str(n) for n in names]), F.lit(False))
            return hit if among else ~hit
        if c.op in ("order", "not order"):
            one, on = self.anchor(c)
            hit = self.marked(one, on)
            return ~hit if c.op.startswith("not") else hit
        first, *rest = c.parts
        if c.op in ("in", "not in") and isinstance(rest[0], Query):
            value = self.column(first)
            hit = self.marked(self.yielded(first, rest[0]).distinct(), lambda p: value == F.col(f"{p}___in"))
            return ~hit & value.isNotNull() if c.op == "not in" else hit
        if isinstance(first, Attribute) and first.node.step_kind == "down" and first.name not in ("count", "rate"):
            if self._narrows(c):
                return F.coalesce(self.place(first.node)("_n") > 0, F.lit(False))
            return F.coalesce(F.exists(self.place(first.node)("_items"), self._item_filter(c)), F.lit(False))
        if isinstance(first, Attribute) and first.name == "subset":
            at = self.place(first.node)
            try:
                hit = self._subset_test(first.node.level, (rest[0],), at)
            except QueryError:
                return F.lit(False)
            return hit if c.op == "==" else ~hit
        if isinstance(first, Attribute) and first.name.endswith("s_pause") and first.node.step_kind != "pause_run":
            if not isinstance(rest[0], bool):
                raise ValueError("pause tests compare with True or False")
            return self.column(first) == F.lit(rest[0] if c.op == "==" else not rest[0])
        exists = F.lit(True)
        for v in c.values():
            if isinstance(v, Attribute) and v.node.step_kind == "shift":
                before = self.place(replace(v.node, steps=v.node.steps[:-1]))
                exists = exists & before(f"_shift_{v.node.steps[-1][1]}").isNotNull()
        return exists & _TESTS[c.op](self.column(first), *(self.column(r) if isinstance(r, _Value) else r for r in rest))


_TESTS: dict[str, Callable[..., Column]] = {
    "==": lambda a, b: a.isNull() if b is None else a == b,
    "!=": lambda a, b: a.isNotNull() if b is None else a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a.isin([v for v in b if v is not None]),
    "not in": lambda a, b: a.isNotNull() & ~a.isin([v for v in b if v is not None]),
    "regex": lambda a, b: a.rlike(rf"\A(?:{b})\z"),
}


class Query:
    """A lazy query; filter, columns, order_by, ... add to it and return it."""

    def __init__(self, node: Node):
        self.node = node
        self.clauses: list[Clause] = []
        self.shown: list = []
        self.groups: list = []
        self.aggregates: list[Aggregate] = []
        self.order: list[tuple[Any, bool]] = []
        self._limit: int | None = None
        self._offset = 0
        self._having: list[Clause] = []

    def leaves(self, clauses: Any = None) -> Iterator[Clause]:
        """All clauses that are neither and_ nor or_."""
        for c in self.clauses if clauses is None else clauses:
            if c.op in ("and", "or"):
                yield from self.leaves(c.parts)
            else:
                yield c

    def listed(self) -> list:
        """All that is shown, grouped by, aggregated or sorted by."""
        return [v.value if isinstance(v, Aggregate) else v for v in (*self.shown, *self.groups, *self.aggregates, *(v for v, _ in self.order))]

    def flat(self, clauses: list[Clause] | None = None) -> Iterator[Clause]:
        for c in self.clauses if clauses is None else clauses:
            if c.op == "and":
                yield from self.flat(list(c.parts))
            else:
                yield c

    def filter(self, *clauses: Clause) -> Query:
        """All must hold; a further == on an attribute replaces the earlier one, and equal begins or ends of a token and one above are alignment. Comparisons of aggregates apply to the groups."""
        for c in clauses:
            c = self._normal(c)
            if c.parts and isinstance(c.parts[0], Aggregate):
                self._having.append(c)
                continue
            if c.op == "==" and isinstance(c.parts[0], Attribute):
                same = lambda d: d.op == "==" and isinstance(d.parts[0], Attribute) and (d.parts[0].node.node_key, d.parts[0].name) == (c.parts[0].node.node_key, c.parts[0].name)  # noqa: B023, E731
                self.clauses = [d for d in self.clauses if not same(d)]
            self.clauses.append(c)
        return self

    def of_speakers(self, *names: str) -> Query:
        """Only tokens of these speakers."""
        return self.filter(Clause("who", (tuple(names), True)))

    def without_speakers(self, *names: str) -> Query:
        """Only tokens of other speakers; those of no speaker stay."""
        return self.filter(Clause("who", (tuple(names), False)))

    def _normal(self, c: Clause) -> Clause:
        """Alignment is named as such, and tokens below stand on the left of a comparison."""
        if c.op in ("and", "or"):
            return Clause(c.op, tuple(self._normal(p) for p in c.parts))
        below = lambda p: isinstance(p, Attribute) and p.node.step_kind == "down" and p.name not in ("count", "rate")
        if c.op in _MIRRORED and below(c.parts[1]) and not below(c.parts[0]):
            return Clause(_MIRRORED[c.op], (c.parts[1], c.parts[0]))
        return self._aligned(c)

    def _aligned(self, c: Clause) -> Clause:
        if c.op in ("==", "!=") and len(c.parts) == 2 and all(isinstance(p, Attribute) for p in c.parts):
            a, b = c.parts
            if a.name == b.name and a.name in ("begin", "end") and not a.node.steps and len(b.node.steps) == 1 and b.node.step_kind == "up":
                return Clause(("not " if c.op == "!=" else "") + ("left" if a.name == "begin" else "right"), (b.node.level,))
        return c

    def filter_left_aligned(self, node: Node) -> Query:
        return self.filter(Clause("left", (node.level,)))

    def filter_right_aligned(self, node: Node) -> Query:
        return self.filter(Clause("right", (node.level,)))

    def filter_not_left_aligned(self, node: Node) -> Query:
        return self.filter(Clause("not left", (node.level,)))

    def filter_not_right_aligned(self, node: Node) -> Query:
        return self.filter(Clause("not right", (node.level,)))

    def columns(self, *values: Any) -> Query:
        self.shown += values
        return self

    def preload(self, *nodes: Node) -> Query:
        """Show whole neighbours, levels above or entities as structs, under their place's name."""
        return self.columns(*(Attribute(n, "*", Attribute(n, "*").label.removesuffix("_*")) for n in nodes))

    def clear_columns(self) -> Query:
        self.shown = []
        return self

    def group_by(self, *values: _Value) -> Query:
        self.groups += values
        return self

    def order_by(self, value: _Value, descending: bool = False) -> Query:
        self.order.append((value, descending))
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    # -- resolution

    def _matched(self) -> tuple[_Plan, DataFrame]:
        plan = _Plan(self)
        # where a clause always holds a semi-join says it; alternatives are marked in plan.test
        semis = [c for c in self.clauses if c.op == "order" or c.op in ("in", "not in") and isinstance(c.parts[1], Query)]
        conditions = [plan.test(c) for c in self.clauses if not any(c is d for d in semis)]
        for v in plan.wanted:
            plan.column(v)
        if not semis and not self.node.subsets and not plan.markers and "is_pause" not in self._table().columns:
            every = F.lit(True)
            for c in conditions:
                every = every & F.coalesce(c, F.lit(False))
            plan.whole.append(every)
        orders = [plan.anchor(c) for c in semis if c.op == "order"]
        df = plan.df
        for k, (one, on) in enumerate(orders):
            df = df.join(plan._prefixed(one, f"o{k}"), on(f"o{k}"), "left_semi")
        if self.node.subsets:
            df = df.where(plan._subset_test(self.node.root, self.node.subsets, lambda c: F.col(f"n0__{c}")))
        for c in conditions:
            df = df.where(c)
        for c in semis:
            if c.op != "order":
                value, inner = c.parts
                x = plan.column(value)
                df = (df if c.op == "in" else df.where(x.isNotNull())).join(plan.yielded(value, inner), x == F.col("_in"), "left_semi" if c.op == "in" else "left_anti")
        return plan, df

    def _agg(self, plan: _Plan, a: Aggregate) -> Column:
        if a.value is None:
            return F.count(F.lit(1))
        x = plan.column(a.value)
        if not a.collapses:
            total = F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double"))
            return {"sum": total, "count": F.size(x), "average": F.try_divide(total, F.size(x))}[a.name]
        return {"count": F.count, "average": F.avg, "sum": F.sum, "stdev": F.stddev_samp, "max": F.max, "min": F.min}[a.name](x)

    def _quantiles(self, df: DataFrame, named: dict[str, Aggregate], keys: list[str]) -> Iterator[tuple[DataFrame, list[str]]]:
        """(keys and columns, names of the columns): the discrete quantiles among the named aggregates, those of one value together."""
        asked: dict[str, tuple[str, dict]] = {}
        for name, a in named.items():
            if a.name in _SHARES:
                value = {k: v for k, v in _data(a.value).items() if k != "label"}
                asked.setdefault(str(value), (f"_v_{a.label}", {}))[1][name] = _SHARES[a.name] or (a.share,)
        for column, wanted in asked.values():
            shares = sorted({p for ps in wanted.values() for p in ps})
            at = {p: F.col(f"q{i}") for i, p in enumerate(shares)}
            found = measures.quantiles(df.select(*keys, F.col(f"`{column}`").alias("_x")), "_x", keys, shares)
            yield found.select(*keys, *((at[ps[-1]] - at[ps[0]] if len(ps) > 1 else at[ps[0]]).alias(name) for name, ps in wanted.items())), [*wanted]

    def _table(self) -> DataFrame:
        """The table that the query is about."""
        corpus, level = self.node.corpus, self.node.root
        if self.node.entity:
            return getattr(corpus, f"{level}s")
        return corpus.type_table(level) if self.node.lexicon else corpus.tokens[level]

    def frame(self) -> DataFrame:
        """The result as a DataFrame; of groups and aggregates, if aggregates are all that is shown."""
        if self.shown and all(isinstance(v, Aggregate) and v.collapses for v in self.shown):
            return self._grouped(self.shown)
        _, df = self._ordered()
        keys = [F.desc(f"_o{i}") if down else F.asc(f"_o{i}") for i, (_, down) in enumerate(self.order)]
        df = (df.orderBy(*keys) if keys else df).drop("_id", *(f"_o{i}" for i in range(len(self.order))))
        if self._offset:
            df = df.offset(self._offset)
        return df.limit(self._limit) if self._limit is not None else df

    def aggregate(self, *aggregates: Aggregate):
        """A value, a row for several aggregates, or a DataFrame in order of the first group."""
        out = self._grouped(aggregates)
        if self.groups:
            return out.orderBy(F.col(f"`{self.groups[0].label}`"))
        row = out.first()
        return (row[0] if len(aggregates) == 1 else row) if row else None

    def _grouped(self, aggregates: Any) -> DataFrame:
        """A row for each group that the comparisons of aggregates leave."""
        tested = [c.parts[0] for c in self._having]
        self.aggregates = [*aggregates, *tested]
        plan, df = self._matched()
        keys = [f"_g{i}" for i in range(len(self.groups))]
        df = df.withColumns({**{f"_v_{a.label}": plan.column(a.value) for a in self.aggregates if a.value is not None}, **{k: plan.column(v) for k, v in zip(keys, self.groups)}})
        every = {**{f"_a{i}": a for i, a in enumerate(aggregates)}, **{f"_h{i}": a for i, a in enumerate(tested)}}
        # a count keeps groups whose values are all null
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *(self._agg(plan, a).alias(n) for n, a in every.items() if a.name not in _SHARES))
        for ranked, names in self._quantiles(df, every, keys):
            out = enrich.equal_join(out, ranked, keys, names, "left")
        out = out.select(*(F.col(k).alias(v.label) for k, v in zip(keys, self.groups)), *(F.col(n).alias(a.label) for n, a in zip(every, aggregates)), *(f"_h{i}" for i in range(len(tested))))
        for i, c in enumerate(self._having):
            out = out.where(_TESTS[c.op](F.col(f"_h{i}"), *c.parts[1:]))
        return out.drop(*(f"_h{i}" for i in range(len(tested))))

    def count(self) -> int:
        return self._matched()[1].count()

    def all(self) -> list[Row]:
        return self.frame().collect()

    def rows(self) -> Iterator[Row]:
        """Row by row, without holding all of them."""
        return self.frame().toLocalIterator()

    def page(self, number: int, size: int = 10) -> list[Row]:
        """The rows of one page, counted from 0, in the query's order."""
        return self.frame().offset(number * size).limit(size).collect()

    def cursor(self, size: int = 10, token: str | None = None, back: bool = False) -> Page:
        """A page of `size` rows in the query's order, ties by id: the first (the last, if back), or that after (before) the row which a token stands for.

        A token is a page's first or last sort values; a page is found by a condition on them and the first
        rows after that, so no row before it is sorted, counted or kept, and rows that are added or removed elsewhere
        don't move it. Rows need an id (or a name or label, of entities and types) of their own.
        """
        if self._limit is not None or self._offset:
            raise QueryError("a query with limit or offset has no pages")
        plan, out = self._ordered()
        keys = [(f"_o{i}", down) for i, (_, down) in enumerate(self.order)] + [("_id", False)]
        df = out
        if token is not None:
            kind = out.select(*(k for k, _ in keys)).schema.simpleString()
            at = F.from_json(F.lit(token), kind, _EXACT)
            df = df.where(_beyond(keys, at, back))
        # one row more tells whether there is another page
        way = [F.desc_nulls_last(k) if down != back else F.asc_nulls_first(k) for k, down in keys]
        found = df.withColumn("_at", F.to_json(F.struct(*(k for k, _ in keys)), _EXACT)).orderBy(*way).limit(size + 1).collect()
        more, found = len(found) > size, found[:size]
        return Page(self, size, found[::-1] if back else found, token, more, back)

    def _ordered(self) -> tuple[_Plan, DataFrame]:
        """What is shown, with the sort values as _o0, _o1, ... and _id."""
        plan, df = self._matched()
        out = [F.col(f"n0__{c}").alias(c) for c in self._table().columns] if not self.shown else [(self._agg(plan, v) if isinstance(v, Aggregate) else plan.column(v)).alias(v.label) for v in self.shown]
        key = "name" if self.node.entity else "label" if self.node.lexicon else "id"
        return plan, df.select(*out, *(plan.column(v).alias(f"_o{i}") for i, (v, _) in enumerate(self.order)), F.col(f"n0__{key}").alias("_id"))

    def union(self, other: Query) -> DataFrame:
        """The rows of two queries with the same columns, repeated ones included."""
        return self.frame().unionByName(other.frame())

    def get(self) -> Row:
        """The only row; anything else is an error."""
        found = self.frame().limit(2).collect()
        if len(found) != 1:
            raise QueryError(f"one row was expected, not {'none' if not found else 'several'}")
        return found[0]

    def to_csv(self, path: str) -> None:
        """One file folder of CSV; with a track among the columns a row for each of its points, times rounded to four places."""
        from tierlake.sources.sinks import write_csv

        shown = [v.label for v in self.shown if isinstance(v, Track) and not v.statistic]
        write_csv(self.frame(), path, shown[0] if shown else None)

    def to_json(self) -> DataFrame:
        return self.frame().select(F.to_json(F.struct("*")).alias("value"))

    # -- as data

    def plan_json(self) -> str:
        """The query itself as JSON in one form: equal queries give equal text."""
        pairs = [[_data(v), down] for v, down in self.order]
        whole = {"node": _data(self.node), "clauses": _data(self.clauses), "having": _data(self._having), "columns": _data(self.shown), "groups": _data(self.groups), "aggregates": _data(self.aggregates), "order": pairs, "limit": self._limit, "offset": self._offset}
        return json.dumps(whole, sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_plan(cls, corpus: Any, text: str) -> Query:
        """The query that plan_json wrote, asked of a corpus; names are looked up in it as if typed."""
        plan = json.loads(text)
        out = cls(_undata(corpus, plan["node"]))
        out.clauses, out._having, out.shown, out.groups, out.aggregates = (_undata(corpus, plan[k]) for k in ("clauses", "having", "columns", "groups", "aggregates"))
        out.order = [(_undata(corpus, v), down) for v, down in plan["order"]]
        out._limit, out._offset = plan["limit"], plan["offset"]
        return out

    def fingerprint(self) -> str:
        """A digest of plan_json, for caches and logs."""
        return hashlib.sha256(self.plan_json().encode()).hexdigest()

    # -- changes; each replaces the corpus's table by a new plan

    def _change(self, f: Callable[[DataFrame, Column], DataFrame]) -> None:
        plan, df = self._matched()
        corpus, level, table = self.node.corpus, self.node.root, self._table()
        if len(plan.prefixes) == 1 and plan.whole:
            # nothing but the rows' own columns decides
            marked = plan.df.select(*(F.col(f"n0__{c}").alias(c) for c in table.columns), plan.whole[0].alias("_hit"))
            new = f(marked, F.col("_hit")).drop("_hit")
        else:
            key = "name" if self.node.entity else "label" if self.node.lexicon else "id"
            hits = df.select(F.col(f"n0__{key}").alias("_hit")).distinct()
            marked = table.join(hits, F.col(key) == F.col("_hit"), "left")
            new = f(marked, F.col("_hit").isNotNull()).drop("_hit")
        if self.node.entity:
            setattr(corpus, f"{level}s", new)
        else:
            (corpus.types if self.node.lexicon else corpus.tokens)[level] = new

    def set_properties(self, **values: Any) -> None:
        """New values for what matches; None takes a property away from all and from the schema."""
        kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
        new = {n: v for n, v in values.items() if v is not None}
        gone = [n for n, v in values.items() if v is None]
        self._change(lambda t, hit: enrich.update(t, hit, **{n: F.lit(v).cast(kinds[type(v)]) for n, v in new.items()}).drop(*gone))
        schema = self.node.corpus.schema
        part, level = (self.node.root, None) if self.node.entity else ("type" if self.node.lexicon else "token", self.node.root)
        schema.remove(part, level, *gone)
        schema.add(part, level, **{n: kinds[type(v)] for n, v in new.items()})

    def create_subset(self, name: str) -> None:
        self._change(lambda t, hit: enrich.add_subset(t, hit, name))
        self.node.corpus.schema.add_subset("type" if self.node.lexicon else "token", self.node.root, name)

    def remove_subset(self, name: str) -> None:
        if "subsets" in self._table().columns:
            self._change(lambda t, hit: enrich.remove_subset(t, hit, name))

    def delete(self) -> None:
        self._change(enrich.delete)

    def set_pause(self) -> None:
        old = "is_pause" in self.node.corpus.tokens[self.node.root].columns
        self._change(lambda t, hit: t.withColumn("is_pause", hit | F.col("is_pause") if old else hit))

    def cache(self, *values: Attribute) -> None:
        """Keep computed values as token properties under their labels."""
        plan, df = self._matched()
        corpus, level = self.node.corpus, self.node.root
        side = df.select(F.col("n0__id").alias("id"), *(plan.column(v).alias(v.label) for v in values)).dropDuplicates(["id"])
        corpus.tokens[level] = enrich.enrich(corpus.tokens[level], side, "id", "id")
        corpus.schema.add("token", level, **dict(side.dtypes[1:]))


def _data(x: Any) -> Any:
    """A part of a query as JSON data."""
    if isinstance(x, Node):
        return {"is": "node", "root": x.root, "steps": [list(s) for s in x.steps], **{k: v for k in ("subsets", "pauses", "lexicon", "entity") if (v := getattr(x, k))}}
    if isinstance(x, Attribute):
        return {"is": "attribute", "node": _data(x.node), "name": x.name, "label": x.label}
    if isinstance(x, Track):
        return {"is": "track", "node": _data(x.node), "name": x.track, "statistic": x.statistic, "measure": x.measure, "label": x.label}
    if isinstance(x, Aggregate):
        return {"is": "aggregate", "name": x.name, "value": _data(x.value), "share": x.share, "label": x.label}
    if isinstance(x, Clause):
        return {"is": "clause", "op": x.op, "parts": [_data(p) for p in x.parts]}
    if isinstance(x, Query):
        return {"is": "query", "plan": json.loads(x.plan_json())}
    if isinstance(x, (list, tuple)):
        return [_data(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((_data(v) for v in x), key=repr)
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, (datetime.date, Decimal)):  # and datetimes
        return {"is": type(x).__name__, "text": str(x) if isinstance(x, Decimal) else x.isoformat()}
    raise QueryError(f"a {type(x).__name__} has no place in a query's JSON")


def _undata(corpus: Any, x: Any) -> Any:
    """What _data wrote, with its nodes in a corpus."""
    if isinstance(x, list):
        return [_undata(corpus, v) for v in x]
    if not isinstance(x, dict):
        return x
    kind = x["is"]
    if kind == "node":
        for level in [*([] if x.get("entity") else [x["root"]]), *(s[1] for s in x["steps"] if s[0] in ("up", "down"))]:
            corpus.schema.require(level)
        return Node(corpus, x["root"], tuple(tuple(s) for s in x["steps"]), tuple(x.get("subsets", ())), *(x.get(k, False) for k in ("pauses", "lexicon", "entity")))
    if kind == "attribute":
        node = _undata(corpus, x["node"])
        if "." not in x["name"] and x["name"] != "*":
            getattr(node, x["name"])  # an unknown name is an error here, as it is where a query is written
        return Attribute(node, x["name"], x["label"])
    if kind == "track":
        out = Track(_undata(corpus, x["node"]), x["name"], x["statistic"], x["measure"])
        return out.column_name(x["label"])
    if kind == "aggregate":
        return Aggregate(x["name"], _undata(corpus, x["value"]), x["share"]).column_name(x["label"])
    if kind == "clause":
        return Clause(x["op"], tuple(_undata(corpus, p) for p in x["parts"]))
    if kind == "query":
        return Query.from_plan(corpus, json.dumps(x["plan"]))
    return {"Decimal": Decimal, "date": datetime.date.fromisoformat, "datetime": datetime.datetime.fromisoformat}[kind](x["text"])


def _beyond(keys: list[tuple[str, bool]], at: Column, back: bool) -> Column:
    """Whether a row comes after the sort values `at` (before, if back): nulls first in rising order, last in falling order."""
    out, equal = F.lit(False), F.lit(True)
    for name, down in keys:
        x, v = F.col(name), at[name]
        if down != back:  # values fall on the way
            step = F.when(v.isNull(), F.lit(False)).otherwise(x.isNull() | (x < v))
        else:
            step = F.when(v.isNull(), x.isNotNull()).otherwise(F.coalesce(x > v, F.lit(False)))
        out = out | (equal & step)
        equal = equal & x.eqNullSafe(v)
    return out


class Page:
    """Some rows of a query in its order, and the way to those before and after them."""

    def __init__(self, query: Query, size: int, found: list[Row], token: str | None, more: bool, back: bool):
        hidden = {"_at", "_id", *(f"_o{i}" for i in range(len(query.order)))}
        self.query, self.size, self._token, self._more, self._back = query, size, token, more, back
        self._ends = (found[0]["_at"], found[-1]["_at"]) if found else (token, token)
        self.rows = [Row(**{k: v for k, v in r.asDict().items() if k not in hidden}) for r in found]

    @property
    def first(self) -> str | None:
        """A token of the first row."""
        return self._ends[0]

    @property
    def last(self) -> str | None:
        return self._ends[1]

    @property
    def has_next(self) -> bool:
        return self._more if not self._back else self._token is not None

    @property
    def has_previous(self) -> bool:
        return self._more if self._back else self._token is not None

    def next(self) -> Page:
        return self.query.cursor(self.size, self.last)

    def previous(self) -> Page:
        return self.query.cursor(self.size, self.first, back=True)


class Metadata:
    """What the columns of a node hold: strings are factors, numbers numerics; factors with more than one value but fewer than rows group."""

    def __init__(self, node: Node):
        corpus = node.corpus
        self.table = Query(node)._table()
        if not node.entity and not node.lexicon and node.root in corpus.types:
            types = corpus.types[node.root]
            names = [c for c in types.columns if c not in self.table.columns]
            self.table = self.table.join(types.select("label", *names), "label", "left")

    def factors(self) -> list[str]:
        return metadata.factors(self.table)

    def numerics(self) -> list[str]:
        return metadata.numerics(self.table)

    def levels(self, name: str) -> DataFrame:
        return metadata.levels(self.table, name)

    def range(self, name: str) -> DataFrame:
        return metadata.value_range(self.table, name)

    def grouping_factors(self) -> list[str]:
        return metadata.grouping_factors(self.table)


__all__ = ["Metadata", "Aggregate", "Attribute", "Average", "Clause", "Count", "InterquartileRange", "Max", "Median", "Min", "Node", "Page", "Quantile", "Query", "Stdev", "Sum", "Track", "and_", "or_"]
