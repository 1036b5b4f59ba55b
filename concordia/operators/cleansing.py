"""Finding and repairing wrong records: lexicons, anomalies, duplicates, impossible journeys, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.transforms import haversine_km, norm_key, parse_ts

from .blocking import deletes

# Fixed values.
CONFIDENCE_FLOOR, MAX_KMH, CLOCK_TOLERANCE_MIN = 0.70, 160.0, 10.0


def mine(df: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(key, canonical, support): of each folded word its most frequent spelling (ties alphabetical), seen at least ``least`` times."""
    spelled = df.filter(F.trim(F.col(column)) != "").groupBy(norm_key(F.col(column)).alias("key"), F.trim(F.col(column)).alias("canonical")).agg(F.count("*").alias("n")).filter("key <> ''")
    w = Window.partitionBy("key").orderBy(F.desc("n"), "canonical")
    ranked = spelled.withColumns({"at": F.row_number().over(w), "support": F.sum("n").over(Window.partitionBy("key"))})
    return ranked.filter((F.col("at") == 1) & (F.col("support") >= least)).select("key", "canonical", "support")


def lookup(values: DataFrame, column: str, lexicon: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(column, canonical, kind) of each different value: exact, surface, alias, prefix, abbreviation, edit, or null.

    A prefix or abbreviation must be the only one, an edit the nearest alone; keys with digits aren't guessed. Different
    values, not rows, meet the lexicon: by what it begins with, by three signs in order, and by versions with characters left out.
    """
    v = values.select(F.col(column).alias("value")).filter(F.trim(F.col("value")) != "").distinct().withColumn("k", norm_key(F.col("value")))
    lex = lexicon.select("key", "canonical")
    same = v.join(lex, v["k"] == lex["key"]).select("value", "canonical", F.when(F.trim("value") == F.col("canonical"), "exact").otherwise("surface").alias("kind"))
    found = same
    if aliases is not None:
        rest = v.join(found.select("value"), "value", "left_anti")
        found = found.unionByName(rest.join(aliases.select(F.col("alias").alias("k"), "canonical"), "k").select("value", "canonical", F.lit("alias").alias("kind")))
    rest = v.join(found.select("value"), "value", "left_anti").filter(~F.col("k").rlike("[0-9]") & (F.length("k") >= 3))
    only = lambda df, kind: df.groupBy("value").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).filter("n = 1").select("value", "canonical", F.lit(kind).alias("kind"))
    starts = only(rest.join(lex.withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n)))), F.col("k") == F.col("part")), "prefix")
    # an abbreviation's first three signs stand in the word in that order, the first in front: words are met by all such triples of theirs
    follow = lambda text: F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    word, after = F.col("key"), lambda c: F.substring(F.col("key"), F.call_function("locate", c, F.col("key"), F.lit(2)) + 1, F.length("key"))
    triples = F.flatten(F.transform(follow(F.substring(word, F.lit(2), F.length(word))), lambda c: F.transform(follow(after(c)), lambda e: F.concat(F.substring(word, 1, 1), c, e))))
    first = rest.withColumn("part", F.substring("k", 1, 3)).join(lex.withColumn("part", F.explode(triples)), "part").filter(F.length("k") < F.length("key"))
    short = only(first.filter(F.expr("key rlike array_join(split(k, ''), '.*')")), "abbreviation").join(starts.select("value"), "value", "left_anti")
    guessed = starts.unionByName(short)
    last = rest.join(guessed.select("value"), "value", "left_anti")
    # words within two edits share a version with up to two characters less
    near = last.withColumn("less", F.explode(deletes(F.col("k"), 2))).join(lex.withColumn("less", F.explode(deletes(F.col("key"), 2))), "less")
    near = near.select("value", "k", "key", "canonical").distinct().withColumn("d", F.levenshtein("k", "key"))
    w = Window.partitionBy("value").orderBy("d", "canonical")
    near = near.withColumns({"at": F.row_number().over(w), "second": F.lead("d").over(w)}).filter("at = 1")
    edits = near.filter((F.col("d") <= F.when(F.length("k") <= 5, 1).otherwise(2)) & (F.col("second").isNull() | (F.col("second") > F.col("d")))).select("value", "canonical", F.lit("edit").alias("kind"))
    found = found.unionByName(guessed).unionByName(edits)
    return v.select("value").join(found, "value", "left").select(F.col("value").alias(column), "canonical", "kind")


def duplicates(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df with duplicate_of: the smallest other id of the same place, time and key (nulls are equal), null for the first."""
    first = F.min(order).over(Window.partitionBy(*by))
    return df.withColumn("duplicate_of", F.when(first < F.col(order), first))


def legs(sightings: DataFrame, key: str, at: str, tie: str, lat: str = "lat", lon: str = "lon", tolerance_min: float = 0.0) -> DataFrame:
    """Each sighting with the one before it: km, minutes, kmh, impossible. Legs of no time (with the tolerance) have no speed."""
    w = Window.partitionBy(key).orderBy(at, tie)
    back = {f"from_{c}": F.lag(c).over(w) for c in (lat, lon, at, tie)}
    out = sightings.withColumns(back).filter(F.col(f"from_{tie}").isNotNull())
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = out.withColumn("km", haversine_km(F.col(f"from_{lat}"), F.col(f"from_{lon}"), F.col(lat), F.col(lon)))
    out = out.withColumn("minutes", (micros(at) - micros(f"from_{at}")) / 60e6)
    span = F.col("minutes") + tolerance_min
    out = out.withColumn("kmh", F.when(span > 0, F.col("km") / (span / 60)))
    return out.withColumn("impossible", F.coalesce(F.col("kmh") > MAX_KMH, F.lit(False)))


def detect(df: DataFrame, horizon: str, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """df with anomalies, an array of codes. Of its columns those are used that it has: registered, shape_ok, ocr_confidence,

    corroborated (a low confidence then doesn't count), captured_at (text) or what parse_ts() read from it as moment and form, duplicate_of, travel_conflict, and for make, model and colour in_lexicon and agrees.
    """
    has = {*df.columns}
    when = lambda need, condition, code: [F.when(condition, code)] if {*need} <= has else []
    ts = {"moment": F.col("moment"), "format": F.col("form")} if {"moment", "form"} <= has else parse_ts(F.col("captured_at")) if "captured_at" in has else None
    codes = when(["registered"], ~F.col("registered") if "registered" in has else None, "PLATE_NOT_REGISTERED")
    codes += when(["shape_ok"], ~F.col("shape_ok") if "shape_ok" in has else None, "PLATE_SHAPE_INVALID")
    for a in ("make", "model", "colour"):
        codes += when([f"{a}_in_lexicon"], F.col(f"{a}_in_lexicon") == F.lit(False) if f"{a}_in_lexicon" in has else None, f"{a.upper()}_NOT_IN_LEXICON")
        codes += when([f"{a}_agrees"], F.col(f"{a}_agrees") == F.lit(False) if f"{a}_agrees" in has else None, f"{a.upper()}_DISAGREES_REGISTRATION")
    backed = F.col("corroborated") if "corroborated" in has else F.lit(False)
    codes += when(["ocr_confidence"], (F.col("ocr_confidence") < floor) & ~backed if "ocr_confidence" in has else None, "LOW_OCR_CONFIDENCE")
    if ts is not None:
        moment, name = ts["moment"], ts["format"]
        codes += [F.when(moment.isNull(), "TIMESTAMP_UNPARSEABLE"), F.when(moment > F.lit(horizon).cast("timestamp_ntz"), "TIMESTAMP_FUTURE"), F.when(name != "iso", "TIMESTAMP_NONSTANDARD")]
    codes += when(["duplicate_of"], F.col("duplicate_of").isNotNull() if "duplicate_of" in has else None, "DUPLICATE_CAPTURE")
    codes += when(["travel_conflict"], F.col("travel_conflict") if "travel_conflict" in has else None, "IMPOSSIBLE_TRAVEL")
    return df.withColumn("anomalies", F.filter(F.array(*codes), lambda c: c.isNotNull()))


def rollup(detected: DataFrame) -> DataFrame:
    return detected.select(F.explode("anomalies").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def disposition(before: Column, after: Column) -> Column:
    """What became of a record: clean, repaired, partly repaired or open, by its codes before and after."""
    return F.when(F.size(before) == 0, "CLEAN").when(F.size(after) == 0, "REPAIRED").when(F.size(after) < F.size(before), "PARTIAL").otherwise("OPEN")


def propose(cases: DataFrame, tree) -> DataFrame:
    """Rule conclusions held to two invariants: a key is only set on an accepted match, and nothing is set to null."""
    out = tree.infer(cases)
    unsafe = (F.col("action") == "set") & (F.col("set_to").isNull() | (F.col("field") == "plate_number") & ~F.coalesce(F.col("match_decision") == "ACCEPT", F.lit(False)))
    return out.withColumn("action", F.when(unsafe, "quarantine").otherwise(F.col("action")))


def suggest(codes: Column, candidates: Column) -> Column:
    """(decision, reason) that a person may take on the anomalies still open; null if none are.

    candidates: an array of (key, decision, p) in order of rank, empty or null without any. In order: what speaks of two cars under one plate, then
    the plate, a copy, the time, the confidence; anything else is small.
    """
    has = lambda *names: F.arrays_overlap(codes, F.array(*map(F.lit, names)))
    found = F.coalesce(candidates, F.array().cast("array<struct<key:string,decision:string,p:double>>"))
    likely, nearest = F.get(F.filter(found, lambda c: c["decision"].isin("ACCEPT", "REVIEW")), F.lit(0)), F.get(found, F.lit(0))
    say = lambda decision, *why: F.struct(F.lit(decision).alias("decision"), F.concat(*(F.lit(w) if isinstance(w, str) else w for w in why)).alias("reason"))
    named = F.concat(likely["key"], F.lit(" (p="), F.format_number(likely["p"], 3), F.lit(")"))
    plate = (
        F.when(likely["decision"] == "ACCEPT", say("accept_candidate", "the match with ", named, " is sure, but what was seen differs from that car: correct only if the picture shows it"))
        .when(likely.isNotNull(), say("accept_candidate", "it may be ", named, ", which is not sure enough to correct without a person"))
        .when(~has("PLATE_SHAPE_INVALID"), say("dismiss", "a valid plate that this register lacks: keep the record"))
        .when(nearest.isNotNull(), say("dismiss", "close to ", nearest["key"], ", but another car was seen: keep it as evidence"))
        .otherwise(say("delete_record", "no valid plate, and none that is registered is near"))
    )
    return (
        F.when(codes.isNull() | (F.size(codes) == 0), None)
        .when(has("IMPOSSIBLE_TRAVEL"), say("confirm_clone", "seen at two places too far apart for the time between"))
        .when(F.exists(codes, lambda c: c.endswith("_DISAGREES_REGISTRATION")), say("confirm_clone", "another car was seen than is registered under the plate"))
        .when(has("PLATE_NOT_REGISTERED", "PLATE_SHAPE_INVALID"), plate)
        .when(has("DUPLICATE_CAPTURE"), say("delete_record", "a copy of another record"))
        .when(has("TIMESTAMP_UNPARSEABLE", "TIMESTAMP_FUTURE"), say("delete_record", "its time can't be trusted"))
        .when(has("LOW_OCR_CONFIDENCE"), say("dismiss", "the read is a registered plate that nothing contradicts"))
        .otherwise(say("dismiss", "only something small is left"))
    )


def active_resolutions(log: DataFrame) -> DataFrame:
    """Per record the codes that its resolutions not undone cover, and the newest one's decision."""
    live = log.filter("undone_at is null")
    return live.groupBy("source_id", "record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.max_by("decision", "log_id").alias("decision"))


def modes(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, column and n: the most frequent value of each group, ties to the smallest."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), column)
    return counted.withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def dominant_format(df: DataFrame, column: str) -> DataFrame:
    """The format that most of a column's timestamps have: one row, format and n."""
    named = df.select(parse_ts(F.col(column))["format"].alias("format"))
    return named.filter("format is not null").groupBy("format").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "format").limit(1)


def tally(log: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """By actor: records changed, and those where the logged value still stands (now: key, field, value)."""
    still = log.join(now, (F.col("record_id") == F.col(key)) & (log["field"] == now["field"]), "left")
    holds = F.col("value").eqNullSafe(F.col("after_value")) & F.col(key).isNotNull()
    return still.groupBy("actor").agg(F.count_distinct("record_id").alias("records"), F.count_distinct(F.when(holds, F.col("record_id"))).alias("holding"))


# Kinds of injected damage.
KINDS = ("plate_misread", "plate_shape", "colour_typo", "time_format", "duplicate", "control")


def inject(records: DataFrame, key: str, seed: int = 20261017) -> DataFrame:
    """Clean records with damage of a known kind, chosen by a hash of their key: kind and the damaged plate_id, colour, captured_at."""
    roll = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(len(KINDS))).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), roll + 1)
    out = records.withColumn("kind", kind)
    swap = F.translate(F.substring("plate_id", 3, 2), "01258", "OIZSB")
    return out.withColumns({
        "true_plate": F.col("plate_id"),
        "plate_id": F.when(F.col("kind") == "plate_misread", F.concat(F.substring("plate_id", 1, 2), swap, F.substring("plate_id", 5, 20))).when(F.col("kind") == "plate_shape", F.substring("plate_id", 1, 6)).otherwise(F.col("plate_id")),
        "observed_colour": F.when(F.col("kind") == "colour_typo", F.concat(F.substring("observed_colour", 1, 2), F.lit("x"), F.substring("observed_colour", 3, 20))).otherwise(F.col("observed_colour")),
        "captured_at": F.when(F.col("kind") == "time_format", F.date_format(F.col("captured_at").cast("timestamp_ntz"), "dd/MM/yyyy HH:mm:ss")).otherwise(F.col("captured_at")),
    })


def detection(scored: DataFrame) -> DataFrame:
    """By kind: records, and how many have an anomaly (of controls: false alarms)."""
    return scored.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.when(F.size("anomalies") > 0, 1).otherwise(0)).alias("found"))
