"""The registry: what sources there are, what they know, and how their columns map onto the shared schema. Driver-side metadata."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

#: The stored attributes every registry has; more may be added, none taken away.
STORED = (
    "plate_number", "owner_name", "vehicle_make", "vehicle_model", "vehicle_colour", "registration_date", "registration_status", "insurer_name", "policy_type",
    "insurance_start", "insurance_expiry", "last_incident_date", "case_status", "stolen_status", "last_seen_time", "last_seen_location", "observed_make", "observed_model", "observed_colour",
)
DERIVED = {"insurance_status": ("insurance_expiry",), "stolen_status": ("stolen_flag", "recovered_flag")}
#: Inputs of derived attributes that are no part of the shared schema themselves.
FLAGS = ("stolen_flag", "recovered_flag")
NEEDS_IDENTITY = ("insurance_start", "insurance_expiry", "insurance_status")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class RegistryError(ValueError):
    """A registry that can't be used; the message says why."""


@dataclass(frozen=True)
class Mapping:
    table: str
    column: str
    attribute: str
    transform: str | None = None
    #: This column's transformed value orders the key's rows; the latest wins.
    latest: bool = False

    def __post_init__(self):
        for name in (self.table, self.column, self.attribute):
            if not _NAME.match(name):
                raise RegistryError(f"not an identifier: {name!r}")


@dataclass(frozen=True)
class Lookup:
    """A left join of a table onto another by one column each, so that an orphan hides nothing."""

    left: str
    left_column: str
    right: str
    right_column: str


@dataclass(frozen=True)
class Source:
    id: str
    main: str
    mappings: tuple[Mapping, ...]
    joins: tuple[Lookup, ...] = ()
    authority: str = "official"
    trust: float = 1.0
    identity: bool = False
    timeout_s: float = 1.5
    #: A column that settles ties between rows of one key.
    tie: str | None = None

    def __post_init__(self):
        if not 0 <= self.trust <= 1:
            raise RegistryError(f"{self.id}: trust {self.trust} isn't within 0 and 1")
        if self.timeout_s <= 0:
            raise RegistryError(f"{self.id}: the timeout must be over 0")
        if self.authority not in ("official", "observational"):
            raise RegistryError(f"{self.id}: unknown authority {self.authority!r}")
        if not any(m.attribute == "plate_number" and m.table == self.main for m in self.mappings):
            raise RegistryError(f"{self.id}: its main table maps no key")
        reached = {self.main}
        for j in self.joins:
            if j.left not in reached:
                raise RegistryError(f"{self.id}: {j.left} isn't joined before {j.right}")
            reached.add(j.right)
        if lost := {m.table for m in self.mappings} - reached:
            raise RegistryError(f"{self.id}: no join reaches {sorted(lost)}")
        if len({(m.table, m.column, m.attribute) for m in self.mappings}) < len(self.mappings):
            raise RegistryError(f"{self.id}: a mapping stands twice")

    @property
    def covers(self) -> frozenset[str]:
        return frozenset(m.attribute for m in self.mappings)


@dataclass(frozen=True)
class Registry:
    sources: tuple[Source, ...]
    extra: tuple[str, ...] = ()
    derived: dict = field(default_factory=lambda: dict(DERIVED))

    def __post_init__(self):
        ids = [s.id for s in self.sources]
        if len(set(ids)) < len(ids):
            raise RegistryError("two sources have one id")
        known = {*STORED, *FLAGS, *self.extra}
        for s in self.sources:
            if unknown := s.covers - known:
                raise RegistryError(f"{s.id}: unknown attributes {sorted(unknown)}")
        for name, needs in self.derived.items():
            if lost := set(needs) - known:
                raise RegistryError(f"{name} needs unknown attributes {sorted(lost)}")

    def source(self, name: str) -> Source:
        return next(s for s in self.sources if s.id == name)

    def inputs(self, attributes) -> set[str]:
        """Derived attributes replaced by what they're derived from."""
        known = {*STORED, *FLAGS, *self.extra, *self.derived}
        if unknown := set(attributes) - known:
            raise RegistryError(f"unknown attributes {sorted(unknown)}")
        return {i for a in attributes for i in self.derived.get(a, (a,))}

    def coverage(self) -> list[tuple[str, str]]:
        return sorted((a, s.id) for s in self.sources for a in s.covers)


def _share(value) -> float:
    """Trust as a share; 1 to 100 are percentages."""
    v = float(value)
    return v / 100 if v > 1 else v


def load(path: str | Path) -> Registry:
    """A registry from JSON: ``sources`` as a list, or as objects by id; other names for a field are understood, unknown rows of mappings ignored."""
    raw = json.loads(Path(path).read_text())
    entries = raw["sources"] if "sources" in raw else raw
    if isinstance(entries, dict):
        entries = [{"id": k, **v} for k, v in entries.items()]
    sources = []
    for e in entries:
        rows = [m for m in e.get("mappings") or e.get("attribute_map") or [] if m.get("attribute") or m.get("global_attr")]
        maps = tuple(Mapping(m.get("table") or m.get("source_table"), m.get("column") or m.get("source_attr"), m.get("attribute") or m.get("global_attr"), m.get("transform") or m.get("transform_fn"), str(m.get("aggregate", "")).startswith("latest_by")) for m in rows)
        joins = tuple(Lookup(*j) if isinstance(j, list) else Lookup(**j) for j in e.get("joins", []))
        kind = str(e.get("authority", "official")).lower()
        sources.append(Source(e.get("id") or e.get("source_id"), e.get("main") or maps[0].table, maps, joins, "observational" if kind.startswith("obs") else "official", _share(e.get("trust", 1)), bool(e.get("identity") or e.get("identity_authority")), float(e.get("timeout_s", 1.5)), e.get("tie")))
    return Registry(tuple(sources), tuple(raw.get("extra", ())) if isinstance(raw, dict) else ())
