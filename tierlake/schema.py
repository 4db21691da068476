"""The schema of a corpus: levels, properties, subsets, subannotations and tracks, kept beside its tables as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from tierlake.errors import AttributeMissing, SubsetMissing

#: What every token has.
TOKEN_COLUMNS = ("id", "label", "begin", "end", "speaker", "discourse")


@dataclass
class Schema:
    """contains maps each level to the one right above it (None for the highest)."""

    contains: dict[str, str | None] = field(default_factory=dict)
    token_properties: dict[str, dict[str, str]] = field(default_factory=dict)
    type_properties: dict[str, dict[str, str]] = field(default_factory=dict)
    token_subsets: dict[str, list[str]] = field(default_factory=dict)
    type_subsets: dict[str, list[str]] = field(default_factory=dict)
    subannotations: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    speaker_properties: dict[str, str] = field(default_factory=dict)
    discourse_properties: dict[str, str] = field(default_factory=dict)
    tracks: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Levels that have a table of types.
    type_tables: list[str] = field(default_factory=list)

    # -- levels

    def higher(self, level: str) -> list[str]:
        """Levels above, the nearest first."""
        self.require(level)
        out, at = [], self.contains[level]
        while at is not None:
            out.append(at)
            at = self.contains.get(at)
        return out

    def lower(self, level: str) -> list[str]:
        """Levels below, the nearest first."""
        below = [x for x in self.contains if level in self.higher(x)]
        return sorted(below, key=lambda x: self.higher(x).index(level))

    @property
    def lowest_to_highest(self) -> list[str]:
        return sorted(self.contains, key=lambda x: -len(self.higher(x)))

    @property
    def highest_to_lowest(self) -> list[str]:
        return self.lowest_to_highest[::-1]

    @property
    def lowest(self) -> str:
        return self.lowest_to_highest[0]

    @property
    def highest(self) -> str:
        return self.lowest_to_highest[-1]

    @property
    def word_name(self) -> str | None:
        return next((x for x in self.contains if x.startswith("word")), None)

    @property
    def phone_name(self) -> str | None:
        return next((x for x in self.contains if x.startswith(("phone", "segment"))), None)

    def require(self, level: str) -> None:
        if level not in self.contains:
            raise AttributeMissing(f"there is no level {level!r}, only {', '.join(self.contains)}")

    def add_level(self, level: str, above: str | None, below: str | None = None) -> None:
        self.contains[level] = above
        if below:
            self.contains[below] = level

    def remove_level(self, level: str) -> None:
        above = self.contains.pop(level)
        for x, a in self.contains.items():
            if a == level:
                self.contains[x] = above
        for part in (self.token_properties, self.type_properties, self.token_subsets, self.type_subsets, self.subannotations):
            part.pop(level, None)

    # -- properties and subsets

    def add(self, part: str, level: str | None, /, **kinds: str) -> None:
        """Properties by name and type; part is token, type, speaker, discourse."""
        place = getattr(self, f"{part}_properties")
        (place if level is None else place.setdefault(level, {})).update(kinds)

    def remove(self, part: str, level: str | None, *names: str) -> None:
        place = getattr(self, f"{part}_properties")
        for n in names:
            (place if level is None else place.get(level, {})).pop(n, None)

    def has(self, part: str, level: str | None, name: str) -> bool:
        place = getattr(self, f"{part}_properties")
        return name in (place if level is None else place.get(level, {}))

    def add_subset(self, part: str, level: str, *names: str) -> None:
        place = getattr(self, f"{part}_subsets").setdefault(level, [])
        place += [n for n in names if n not in place]

    def remove_subset(self, part: str, level: str, *names: str) -> None:
        place = getattr(self, f"{part}_subsets")
        place[level] = [n for n in place.get(level, []) if n not in names]

    def subset_part(self, level: str, name: str) -> str:
        """Whether a subset is one of tokens or of types; tokens first."""
        for part in ("token", "type"):
            if name in getattr(self, f"{part}_subsets").get(level, []):
                return part
        raise SubsetMissing(f"{level} has no subset {name!r}")

    def add_subannotation(self, level: str, name: str, /, **kinds: str) -> None:
        self.subannotations.setdefault(level, {}).setdefault(name, {}).update(kinds)

    def remove_subannotation(self, level: str, name: str) -> None:
        self.subannotations.get(level, {}).pop(name, None)

    def update(self, other: Schema) -> None:
        """Take over all that another schema has."""
        self.contains.update(other.contains)
        for part in ("token_properties", "type_properties", "subannotations"):
            for level, kinds in getattr(other, part).items():
                getattr(self, part).setdefault(level, {}).update(kinds)
        for part in ("token_subsets", "type_subsets"):
            for level, names in getattr(other, part).items():
                self.add_subset(part.split("_")[0], level, *names)
        for part in ("speaker_properties", "discourse_properties", "tracks"):
            getattr(self, part).update(getattr(other, part))

    # -- persistence

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls(**json.loads(text))
