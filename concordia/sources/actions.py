"""Named writes: what an authority does to its tables, for any number of requests at once, each with its inverse.

A request is a row with ``plate`` and, as far as it says more than the action's defaults, columns named like those of the table. An action
changes one table or several together, and returns the rows that it removed and added; that is all that undo() needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.transforms import norm_plate
from concordia.operators.repair import kept

Tables = dict[str, DataFrame]


def spelled(groups: tuple[int, ...] = (), separator: str = "", lower: bool = False) -> Callable[[Column], Column]:
    """How a source spells keys: groups of so many signs, the last with the rest."""

    def spell(plate: Column) -> Column:
        p, parts, at = norm_plate(plate), [], 1
        for n in groups:
            parts.append(F.substring(p, at, n))
            at += n
        out = F.concat_ws(separator, *parts, F.expr("null").cast("string") if not groups else F.nullif(F.substring(p, at, 1000), F.lit(""))) if groups else p
        return F.lower(out) if lower else out

    return spell


@dataclass(frozen=True)
class Add:
    """One new row for each request, with an id of its own. values: column and default, a literal or a Column of the request."""

    table: str
    id: str
    key: str | None = None
    spell: Callable[[Column], Column] = spelled()
    values: dict = field(default_factory=dict)
    #: A column that takes the id that another table's row of the same request got.
    refers: tuple[str, str] | None = None


@dataclass(frozen=True)
class Change:
    table: str
    id: str
    key: str
    values: dict


@dataclass(frozen=True)
class Remove:
    """Rows of the key, and of ``parent`` (table, its id, the column that names it) those that no row names any more but a removed one did."""

    table: str
    id: str
    key: str
    parent: tuple[str, str, str] | None = None
    only: str | None = None


@dataclass
class Write:
    """What an action removed and added, by table, and each table's id."""

    removed: Tables
    added: Tables
    ids: dict[str, str]

    def apply(self, tables: Tables) -> Tables:
        """tables without what was removed and with what was added."""
        return {**tables, **{t: _swap(tables[t], self.removed[t], self.added[t], i) for t, i in self.ids.items()}}

    def undo(self, tables: Tables) -> Tables:
        """tables as before; a row that was changed again since is left as it is."""
        out = dict(tables)
        for t, i in self.ids.items():
            now = tables[t]
            same = now.select(F.col(i).alias("_i"), F.struct(*now.columns).alias("_now")).join(self.added[t].select(F.col(i).alias("_i"), F.struct(*now.columns).alias("_then")), "_i")
            held = same.filter(F.col("_now").eqNullSafe(F.col("_then"))).select(F.col("_i").alias(i))
            other = same.filter(~F.col("_now").eqNullSafe(F.col("_then"))).select(F.col("_i").alias(i))
            gone = self.removed[t].join(self.added[t].select(i), i, "left_anti").join(now.select(i), i, "left_anti").select(i)
            back = self.removed[t].join(held.unionByName(gone), i, "left_semi").join(other, i, "left_anti")
            out[t] = now.join(held, i, "left_anti").unionByName(back.select(*now.columns))
        return out


def _swap(table: DataFrame, removed: DataFrame, added: DataFrame, id_col: str) -> DataFrame:
    return table.join(removed.select(id_col), id_col, "left_anti").select(*table.columns).unionByName(added.select(*table.columns))


def numbered(rows: DataFrame, order: str, first: int, name: str) -> DataFrame:
    """rows with dense numbers from ``first`` in an order: each partition counts its own, and begins where those before it end. No task sees all rows."""
    own = kept(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return own.withColumn("_at", at).join(F.broadcast(begins), "_part").withColumn(name, F.lit(first - 1) + F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")


# Defaults of the actions.
_MADE = {"make": "Maruti Suzuki", "model": "Swift", "colour": "White"}
ACTIONS: dict[str, tuple] = {
    "register": (Add("OWNERS", "owner_id", values={"full_name": "Live Demo Owner"}), Add("VEHICLE", "registration_id", "registration_no", values={**_MADE, "registered_on": F.current_date, "reg_status": "ACT", "rto_code": lambda: F.substring("plate", 1, 4)}, refers=("owner_id", "OWNERS"))),
    "set_status": (Change("VEHICLE", "registration_id", "registration_no", {"reg_status": "ACT"}),),
    "unregister": (Remove("VEHICLE", "registration_id", "registration_no", ("OWNERS", "owner_id", "owner_id")),),
    "renew": (Change("POLICY", "policy_id", "vehicle_reg", {"policy_until": "31/12/2027", "is_active": 1}),),
    "expire": (Change("POLICY", "policy_id", "vehicle_reg", {"policy_until": "10/01/2026", "is_active": 0}),),
    "add_policy": (Add("POLICY", "policy_id", "vehicle_reg", spelled((2, 2, 2), "-"), {"policy_type": "COMPREHENSIVE", "policy_start": lambda: F.date_format(F.current_date(), "dd/MM/yyyy"), "policy_until": "31/12/2027", "is_active": 1, "premium_inr": 15000.0}),),
    "delete_policies": (Remove("POLICY", "policy_id", "vehicle_reg"),),
    "steal": (Add("CRIME", "incident_id", "vehicle_number", spelled((2, 2, 2), " ", True), {"reported_date": lambda: F.unix_timestamp(), "incident_type": "THEFT", "stolen_flag": "Y", "recovered_flag": "N", "case_status": "open"}),),
    "clear": (Remove("CRIME", "incident_id", "vehicle_number", only="incident_type = 'THEFT'"),),
    "shred": (Add("CRIME", "incident_id", "vehicle_number", spelled((2, 2, 2), " ", True), {"reported_date": lambda: F.unix_timestamp(), "incident_type": "SHREDDING", "stolen_flag": "N", "recovered_flag": "N", "case_status": "CLOSED"}),),
    "delete_incidents": (Remove("CRIME", "incident_id", "vehicle_number"),),
    "sight": (Add("CAPTURES", "capture_id", "plate_id", values={"captured_at": lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "observed_make": "Maruti Suzuki", "observed_model": "Swift", "observed_colour": "White", "ocr_confidence": 0.95}),),
    "delete_sightings": (Remove("CAPTURES", "capture_id", "plate_id"),),
    "issue": (Add("CERTS", "cert_no", "regn_number", values={"valid_upto": lambda: F.add_months(F.current_date(), 12), "tested_at": "Live Demo Test Centre", "emission_norm": "BS-VI"}),),
    "revoke": (Remove("CERTS", "cert_no", "regn_number"),),
}


def _value(requests: DataFrame, column: str, default) -> Column:
    own = F.col(column) if column in requests.columns else F.lit(None)
    return F.coalesce(own, default() if callable(default) else F.lit(default))


def perform(action: str, tables: Tables, requests: DataFrame) -> Write:
    """What a named action does for some requests; nothing is written until Write.apply().

    Plates are normalised; requests without one do nothing. Of several changes asked for one plate the smallest (by its columns)
    counts; each asks for a row of its own where rows are added. Ids of new rows go on from the largest that the table has.
    """
    if action not in ACTIONS:
        raise ValueError(f"no action {action!r}; known are {', '.join(ACTIONS)}")
    asked = requests.withColumn("plate", norm_plate(F.col("plate"))).filter("plate <> ''")
    rest = [c for c in asked.columns if c != "plate"]
    once = asked.groupBy("plate").agg(F.min(F.struct(*rest)).alias("_r")).select("plate", "_r.*") if rest else asked.distinct()
    out = Write({}, {}, {})
    new = asked
    for step in ACTIONS[action]:
        t = tables[step.table]
        out.ids[step.table] = step.id
        kind = {f.name: f.dataType for f in t.schema}
        if isinstance(step, Add):
            high = t.agg(F.max(step.id)).first()[0] or 0
            new = kept(numbered(new, "plate", int(high) + 1, f"_{step.table}"))
            own = {step.id: F.col(f"_{step.table}"), **({step.key: step.spell(F.col("plate"))} if step.key else {}), **({step.refers[0]: F.col(f"_{step.refers[1]}")} if step.refers else {})}
            columns = {c: own[c] if c in own else _value(new, c, step.values.get(c)) for c in t.columns}
            out.removed[step.table], out.added[step.table] = t.limit(0), new.select(*(v.cast(kind[c]).alias(c) for c, v in columns.items()))
            continue
        hit = t.withColumn("_plate", norm_plate(F.col(step.key))).filter(step.only if isinstance(step, Remove) and step.only else F.lit(True))
        if isinstance(step, Change):
            both = kept(hit.join(once.select(F.col("plate").alias("_plate"), *(_value(once, c, v).alias(f"_new_{c}") for c, v in step.values.items())), "_plate"))
            out.removed[step.table] = both.select(*t.columns)
            out.added[step.table] = both.select(*(F.col(f"_new_{c}").cast(kind[c]).alias(c) if c in step.values else F.col(c) for c in t.columns))
            continue
        gone = kept(hit.join(once.select(F.col("plate").alias("_plate")), "_plate", "left_semi").select(*t.columns))
        out.removed[step.table], out.added[step.table] = gone, t.limit(0)
        if step.parent:
            parent, its_id, named = step.parent
            p = tables[parent]
            still = t.join(gone.select(step.id), step.id, "left_anti").select(F.col(named).alias(its_id))
            lone = gone.select(F.col(named).alias(its_id)).filter(F.col(its_id).isNotNull()).distinct().join(still, its_id, "left_anti")
            out.ids[parent], out.removed[parent], out.added[parent] = its_id, kept(p.join(lone, its_id, "left_semi").select(*p.columns)), p.limit(0)
    return out
