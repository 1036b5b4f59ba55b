"""A question over the shared schema: choose sources, unfold each into one plan, merge by key, decide, score.

A request is a DataFrame of keys (or all keys); a single lookup is the same plan with a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.transforms import norm_plate, transform
from concordia.sources.registry import NEEDS_IDENTITY, Registry, Source
from concordia.sources.tables import probes

# Decisions, points and bounds.
CORE = ("REG", "INS", "THEFT", "CAM")
FAILED = ("DOWN", "TIMEOUT", "ERROR")
ADVISORY_DAYS, WARNING_DAYS = 15, 30
BASE_POINTS = (("STOLEN", 90), ("SCRAPPED", 90), ("SHREDDED", 90), ("UNINSURED", 70), ("REGISTRATION INVALID", 60), ("UNREGISTERED", 50), ("SUSPICIOUS", 55), ("UNKNOWN VEHICLE", 40), ("CLEAR", 5))
DEFAULT_BASE = 30
LEVELS = (("LOW", 25), ("MEDIUM", 55), ("HIGH", 80))
ALERT_PREFIXES = ("STOLEN", "SCRAPPED", "SHREDDED")


def choose(registry: Registry, attributes) -> tuple[list[str], dict[str, str]]:
    """Ids of the sources that a question needs, in the registry's order, and why each of the others isn't asked."""
    wanted = registry.inputs(attributes)
    asked, skipped = [], {}
    for s in registry.sources:
        if s.covers & wanted - {"plate_number"} or s.identity and any(a in NEEDS_IDENTITY for a in attributes):
            asked.append(s.id)
        else:
            skipped[s.id] = "covers none of the attributes"
    return asked, skipped


def unfold(source: Source, tables: dict[str, DataFrame], attributes=None, keys: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The source's rows as shared attributes: key and one column each; of a key's rows the latest, where one is declared, or all (``every``).

    Only joins that a wanted attribute needs are made, and they keep rows without a partner. A column is always
    meant with its table, so equal names don't mix.
    """
    maps = [m for m in source.mappings if m.attribute == "plate_number" or attributes is None or m.attribute in attributes or m.latest]
    needed = {m.table for m in maps}
    for j in reversed(source.joins):
        if j.right in needed:
            needed.add(j.left)
    columns: dict[str, set[str]] = {}
    for m in maps:
        columns.setdefault(m.table, set()).add(m.column)
    if source.tie:
        columns.setdefault(source.main, set()).add(source.tie)
    for j in source.joins:
        if j.right in needed:
            columns.setdefault(j.left, set()).add(j.left_column)
            columns.setdefault(j.right, set()).add(j.right_column)
    part = {t: tables[t].select(*(F.col(c).alias(f"{t}__{c}") for c in sorted(cs))) for t, cs in columns.items()}
    out = part[source.main]
    for j in source.joins:
        if j.right in needed:
            out = out.join(part[j.right], F.col(f"{j.left}__{j.left_column}") == F.col(f"{j.right}__{j.right_column}"), "left")
    key = next(m for m in maps if m.attribute == "plate_number")
    value = {m.attribute: transform(m.transform)(F.col(f"{m.table}__{m.column}")).alias(m.attribute) for m in maps if m.attribute != "plate_number"}
    latest = next((m.attribute for m in maps if m.latest), None)
    extra = [F.col(f"{source.main}__{source.tie}").alias("_tie")] if source.tie else []
    out = out.select(norm_plate(F.col(f"{key.table}__{key.column}")).alias("key"), *value.values(), *extra).filter("key <> ''")
    if keys is not None:
        out = out.join(keys.select(norm_plate(F.col("key")).alias("key")).distinct(), "key", "left_semi")
    if not every:
        order = ([F.desc_nulls_last(latest)] if latest else []) + ([F.asc("_tie")] if source.tie else [F.lit(0)])
        out = out.withColumn("_at", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("_at = 1").drop("_at")
    out = out.drop("_tie")
    return out if attributes is None else out.select("key", *(a for a in value if a in attributes))


def failures(registry: Registry, status: dict[str, str]) -> list[str]:
    """Ids of the sources whose silence forbids a conclusion: failed, and not merely observing."""
    return sorted(s.id for s in registry.sources if status.get(s.id, "OK") in FAILED and s.authority != "observational")


def corroboration(frames: dict[str, DataFrame], registry: Registry) -> DataFrame:
    """(key, sources): how many sources that don't merely observe hold each key."""
    held = [frames[s.id].select("key", F.lit(s.id).alias("s")) for s in registry.sources if s.id in frames and s.authority != "observational"]
    return reduce(DataFrame.unionByName, held).groupBy("key").agg(F.count_distinct("s").alias("sources"))


def coverage(frames: dict[str, DataFrame]) -> DataFrame:
    """(attribute, source, n): how many keys each source has a value of each attribute for; one aggregation a source, whatever the attributes."""
    parts = []
    for s, df in frames.items():
        names = [c for c in df.columns if c != "key"]
        counted = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in names))
        parts.append(counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.lit(s).alias("source"), F.col(f"`{c}`").alias("n")) for c in names))).alias("_c")).select("_c.*"))
    return reduce(DataFrame.unionByName, parts)


def integrate(frames: dict[str, DataFrame], registry: Registry, status: dict[str, str], keys: DataFrame | None = None) -> DataFrame:
    """One row per key: each attribute from the last source that has it, provenance, conflicts, availability.

    One union and one aggregation by key, whatever the number of sources; a source that failed adds no rows and its status.
    """
    order = [s.id for s in registry.sources if s.id in frames]
    live = [s for s in order if status.get(s, "OK") == "OK"]
    parts = [frames[s].select("key", F.struct(*(c for c in frames[s].columns if c != "key")).alias(s)) for s in live]
    if keys is not None:
        parts.append(keys.select(norm_plate(F.col("key")).alias("key")).distinct())
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = both.groupBy("key").agg(*(F.first(s, ignorenulls=True).alias(s) for s in live))
    attributes = list(dict.fromkeys(m.attribute for s in order for m in registry.source(s).mappings if m.attribute != "plate_number" and (s not in live or m.attribute in frames[s].columns)))

    def held(a: str) -> list[str]:
        return [s for s in live if a in frames[s].columns]

    def merge(a: str) -> Column:
        return F.coalesce(*(F.col(f"{s}.{a}") for s in reversed(held(a)))) if held(a) else F.lit(None).cast("string")

    def origin(a: str) -> Column:
        who = F.coalesce(*(F.when(F.col(f"{s}.{a}").isNotNull(), F.struct(F.lit(s).alias("source"), F.lit(registry.source(s).authority).alias("authority"), F.lit(registry.source(s).trust).alias("trust"))) for s in reversed(held(a))))
        return F.struct(F.lit(a).alias("key"), who.alias("value"))

    known = [a for a in attributes if held(a)]
    provenance = F.map_from_entries(F.filter(F.array(*map(origin, known)), lambda e: e["value"].isNotNull()))
    out = merged.select("key", *(merge(a).alias(a) for a in attributes), provenance.alias("provenance"))
    pairs = [(a, b) for a, b in (("vehicle_make", "observed_make"), ("vehicle_model", "observed_model"), ("vehicle_colour", "observed_colour")) if a in attributes and b in attributes]
    clash = lambda a, b: F.when(F.lower(F.trim(a)) != F.lower(F.trim(b)), F.struct(F.lit(a).alias("attribute"), F.col(a).alias("official"), F.col(b).alias("observed")))
    conflicts = F.filter(F.array(*(clash(a, b) for a, b in pairs)), lambda c: c.isNotNull()) if pairs else F.array()
    stated = F.create_map(*(x for s in order for x in (F.lit(s), F.lit(status.get(s, "OK"))))) if order else F.create_map()
    return out.withColumns({"conflicts": conflicts, "availability": stated})


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def derive(profile: DataFrame, asked, status: dict[str, str], today: str) -> DataFrame:
    """insurance_status and stolen_status. Not asked: null. Asked but failed: UNKNOWN. Absence only counts from a source that answered."""

    def told(s: str, value: Column) -> Column:
        return F.lit(None).cast("string") if s not in asked else F.lit("UNKNOWN") if status.get(s, "OK") != "OK" else value

    expiry, stolen, recovered = _has(profile, "insurance_expiry", "date"), _has(profile, "stolen_flag", "boolean"), _has(profile, "recovered_flag", "boolean")
    policy = F.coalesce(_has(profile, "policy_type").cast("string"), _has(profile, "insurer_name"), _has(profile, "insurance_start", "date").cast("string"))
    insured = F.when(expiry >= F.lit(today).cast("date"), "VALID").when(expiry.isNotNull(), "EXPIRED").when(policy.isNotNull(), "UNKNOWN").otherwise("NONE")
    theft = F.when(recovered & stolen, "RECOVERED").when(stolen, "STOLEN").otherwise("NOT_REPORTED")
    return profile.withColumns({"insurance_status": told("INS", insured), "stolen_status": told("THEFT", theft)})


def decide(profile: DataFrame, asked, status: dict[str, str], today: str) -> DataFrame:
    """decision, confidence and reasons, by ordered rules: the first that fires. A source that failed is never read as an absence."""
    col = lambda n, kind="string": _has(profile, n, kind)
    ok = lambda s: s in asked and status.get(s, "OK") == "OK"
    seen, registered = col("last_seen_time").isNotNull(), col("registration_status").isNotNull()
    scrapped = F.coalesce(F.upper(F.trim(col("incident_type"))) == "SHREDDING", F.lit(False))
    empty = col("last_incident_date").isNull() & col("case_status").isNull() & col("insurance_expiry").isNull() & col("insurer_name").isNull()
    differ = [F.when((F.trim(col(a)) != "") & (F.trim(col(b)) != "") & (F.lower(F.trim(col(a))) != F.lower(F.trim(col(b)))), 1).otherwise(0) for a, b in (("vehicle_make", "observed_make"), ("vehicle_model", "observed_model"), ("vehicle_colour", "observed_colour"))]
    mismatches = sum(differ, F.lit(0))
    lapsed = F.date_diff(F.lit(today).cast("date"), col("insurance_expiry", "date"))
    expired = F.coalesce(col("insurance_status") == "EXPIRED", F.lit(False))

    def rule(name: str, confidence: str | Column, *why) -> Column:
        return F.struct(F.lit(name).alias("decision"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), F.filter(F.array(*(w if isinstance(w, Column) else F.lit(w) for w in why)), lambda r: r.isNotNull()).alias("reasons"))

    rules = [(F.lit(s in asked and status.get(s) in FAILED), rule("UNDETERMINED", "LOW", f"source {s} is {status.get(s)}")) for s in ("THEFT", "INS")]
    rules += [
        ((col("stolen_status") == "STOLEN") & (col("case_status") == "OPEN"), rule("STOLEN — ALERT POLICE", "HIGH", F.concat(F.lit("reported stolen on "), col("last_incident_date").cast("string")))),
        (scrapped & seen, rule("SCRAPPED — ALERT POLICE", "HIGH", "scrapped, but its plate was sighted")),
        (scrapped, rule("SCRAPPED — REGISTRATION VOID", "HIGH", "scrapped; registration void")),
        (seen & ~registered & F.lit("REG" in asked and not ok("REG")), rule("UNDETERMINED", "LOW", "the registration source did not answer")),
        (seen & ~registered & F.lit(ok("REG")), rule("UNREGISTERED / SUSPICIOUS", "MEDIUM", "sighted without a registration record")),
        (~seen & ~registered & empty & F.lit(ok("REG")), rule("UNKNOWN VEHICLE — NOT REGISTERED", "MEDIUM", "no record in any asked source")),
        (mismatches >= 2, rule("SUSPICIOUS — POSSIBLE CLONED PLATE", "MEDIUM", F.concat(mismatches.cast("string"), F.lit(" attributes differ")))),
        (col("insurance_status") == "NONE", rule("UNINSURED — REPORT", "HIGH", "no policy on record")),
        (expired & lapsed.between(1, ADVISORY_DAYS), rule("UNINSURED — ADVISORY", "MEDIUM", F.concat(F.lit("lapsed days: "), lapsed.cast("string")))),
        (expired & lapsed.between(ADVISORY_DAYS + 1, WARNING_DAYS), rule("UNINSURED — WARNING", "HIGH", F.concat(F.lit("lapsed days: "), lapsed.cast("string")))),
        (expired, rule("UNINSURED — REPORT", "HIGH", F.concat(F.lit("lapsed days: "), lapsed.cast("string")))),
        (registered & (col("registration_status") != "ACTIVE"), rule("REGISTRATION INVALID — REPORT", "HIGH", F.concat(F.lit("status "), col("registration_status")))),
    ]
    full = F.when(seen & F.lit(all(map(ok, CORE))), "HIGH").otherwise("MEDIUM")
    missing = [s for s in CORE if s not in asked]
    clear = rule("CLEAR", full, F.when(col("registration_status") == "ACTIVE", "registration ACTIVE"), F.when(col("insurance_status") == "VALID", "insurance VALID"), F.when(col("stolen_status").isin("NOT_REPORTED", "RECOVERED"), F.concat(F.lit("theft status "), col("stolen_status"))), F.when(F.lit("CAM" in asked) & ~seen, "no sighting"), *([f"not checked: {', '.join(missing)}"] if missing else []))
    out = clear
    for when, then in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), then).otherwise(out)
    return profile.withColumn("_d", out).select(*profile.columns, "_d.decision", "_d.confidence", "_d.reasons")


# The name of the rule behind a decision, by a part of its text; the first that fits counts.
RULE_NAMES = (
    ("UNINSURED — ADVISORY", "Rule 5a: insurance lapsed 1-15 days (advisory)"),
    ("UNINSURED — WARNING", "Rule 5b: insurance lapsed 16-30 days (warning)"),
    ("UNINSURED — REPORT", "Rule 5: no policy on record, or lapsed >30 days"),
    ("STOLEN", "Rule 2: reported stolen and police case is OPEN"),
    ("SCRAPPED", "Rule 2b: vehicle officially scrapped/shredded"),
    ("UNKNOWN VEHICLE", "Rule 3b: no record for this plate in any asked source"),
    ("UNREGISTERED", "Rule 3: camera-sighted but no registration record"),
    ("SUSPICIOUS", "Rule 4: visual identity mismatch (possible cloned plate)"),
    ("REGISTRATION INVALID", "Rule 6: registration status is not ACTIVE"),
    ("CLEAR", "Rule 7: all checked sources are clear"),
    ("UNDETERMINED", "Rule 1: a required source is unavailable"),
)


def rule_fired(decision: Column) -> Column:
    """The name of the rule that a decision comes from; null and unknown decisions have none."""
    text = F.upper(F.coalesce(decision, F.lit("")))
    return F.coalesce(*(F.when(text.contains(part), name) for part, name in RULE_NAMES), F.lit("Unmapped decision rule"))


def risk(decided: DataFrame, asked, status: dict[str, str], today: str) -> DataFrame:
    """risk (0 to 100), risk_level and the named factors that add up to it."""
    day = F.lit(today).cast("date")
    base = F.lit(DEFAULT_BASE)
    for needle, points in reversed(BASE_POINTS):
        base = F.when(F.upper("decision").contains(needle), points).otherwise(base)
    left = F.date_diff(_has(decided, "insurance_expiry", "date"), day)
    age = F.date_diff(day, _has(decided, "last_seen_time", "timestamp_ntz").cast("date"))
    trusts = F.transform(F.map_values("provenance"), lambda p: p["trust"])
    mean = F.aggregate(trusts, F.lit(0.0), lambda a, t: a + t) / F.greatest(F.size(trusts), F.lit(1))
    factors = [
        ("Decision", base),
        ("Attribute conflicts", F.when(F.size("conflicts") > 0, F.least(F.size("conflicts") * 5, F.lit(15)))),
        ("Policy expiring soon", F.when(left.between(0, 30), 10)),
        ("Stale camera evidence", F.when(F.lit("CAM" in asked) & (age.isNull() | (age > 60)), 5)),
        ("Incomplete evidence", F.when(F.lit(any(s in asked and status.get(s) in FAILED for s in CORE)), 10)),
        ("Low source trust", F.when((F.size(trusts) > 0) & (mean < 0.8), 5)),
    ]
    named = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), p.cast("int").alias("points")) for n, p in factors)), lambda f: f["points"].isNotNull())
    out = decided.withColumn("factors", named)
    total = F.aggregate("factors", F.lit(0), lambda a, f: a + f["points"])
    out = out.withColumn("risk", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    return out.withColumn("risk_level", level("risk"))


def level(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    out = F.lit("CRITICAL")
    for name, below in reversed(LEVELS):
        out = F.when(c < below, name).otherwise(out)
    return out


def alerts(decided: DataFrame, watched: DataFrame) -> DataFrame:
    """(key, kind): keys on the watchlist, and keys whose decision is a hot one; a key may have both."""
    hot = F.lit(False)
    for p in ALERT_PREFIXES:
        hot = hot | F.upper("decision").startswith(p)
    listed = watched.select(norm_plate(F.col("key")).alias("key"), F.lit(True).alias("_listed")).distinct()
    kinds = F.array(F.when(F.col("_listed"), "WATCHLIST"), F.when(hot, "HOTLIST"))
    return decided.select("key", "decision").join(listed, "key", "left").select("key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def ask(registry: Registry, tables: dict[str, DataFrame], attributes, today: str, keys: DataFrame | None = None, status: dict[str, str] | None = None, deadline: float | None = None) -> DataFrame:
    """The whole question: profile, derived statuses, decision, risk.

    With a ``deadline`` in seconds the sources asked are probed first, all at once; those that are late, down or fail are left out, with
    their status. Tables may then be functions that make a DataFrame.
    """
    status = dict(status or {})
    asked, _ = choose(registry, attributes)
    wanted = registry.inputs(attributes)
    needs = {s: {registry.source(s).main, *(j.right for j in registry.source(s).joins)} for s in asked}
    if deadline is not None:
        own = set().union(*needs.values()) if needs else set()
        found = probes({t: tables[t] for t in sorted(own)}, deadline)
        for s in asked:
            failed = [found[t] for t in sorted(needs[s]) if found[t] != "OK"]
            if failed and status.get(s, "OK") == "OK":
                status[s] = failed[0]
    live = {t for s in asked if status.get(s, "OK") == "OK" or deadline is None for t in needs[s]}
    tables = {t: df() if callable(df) and not isinstance(df, DataFrame) else df for t, df in tables.items() if t in live}
    frames = {s: unfold(registry.source(s), tables, wanted | ({"registration_status"} if registry.source(s).identity else set()), keys) if needs[s] <= live else None for s in asked}
    profile = derive(integrate(frames, registry, status, keys), asked, status, today)
    return risk(decide(profile, asked, status, today), asked, status, today)
