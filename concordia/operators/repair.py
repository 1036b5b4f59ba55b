"""Records screened, repaired and screened again: features of each field, rule conclusions, patches, and what remains.

A record is a row: record_id, plate_number, observed_make, observed_model, observed_colour, last_seen_time (a text), location, lat, lon and
ocr_confidence. enrich() joins what is known of it, fields() makes a row of each of its fields with the features that rules ask
about, cleansing.propose() concludes, patch() applies. repair() repeats that until nothing changes.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions.transforms import norm_plate, parse_ts

from . import blocking, cleansing, matching, open_world, timeline
from .cleansing import CLOCK_TOLERANCE_MIN, CONFIDENCE_FLOOR, MAX_KMH
from .rules import Tree, default_tree

TEXTS = {"observed_make": "make", "observed_model": "model", "observed_colour": "colour"}
#: The field that an anomaly is about; rules speak of fields.
FIELD_OF = {"PLATE_NOT_REGISTERED": "plate_number", "PLATE_SHAPE_INVALID": "plate_number", "LOW_OCR_CONFIDENCE": "plate_number", "TIMESTAMP_UNPARSEABLE": "last_seen_time", "TIMESTAMP_FUTURE": "last_seen_time", "TIMESTAMP_NONSTANDARD": "last_seen_time", "DUPLICATE_CAPTURE": "record", "IMPOSSIBLE_TRAVEL": "record"} | {f"{a.upper()}_{w}": f for f, a in TEXTS.items() for w in ("NOT_IN_LEXICON", "DISAGREES_REGISTRATION")}
#: How a repaired time is written, and the name that parse_ts() has for that form.
TIME_FORM, TIME_NAME = "yyyy-MM-dd'T'HH:mm:ss", "iso"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only in local mode, and where it is unset, a temporary folder takes its place."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(home)
    return home.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass
class Known:
    """What records are held against: registered vehicles (key, make, model, colour, a row a key), a lexicon (key, canonical) for each attribute, the newest time that is possible."""

    registered: DataFrame
    lexicons: dict[str, DataFrame]
    horizon: str


def known(registered: DataFrame, horizon: str, least: int = 2) -> Known:
    """Lexicons are mined from the registered values themselves, those seen at least ``least`` times."""
    return Known(registered, {a: kept(cleansing.mine(registered, a, least)) for a in TEXTS.values()}, horizon)


def enrich(records: DataFrame, of: Known) -> DataFrame:
    """records with all that detect() and fields() look at. Values meet the lexicons once for each different one; journeys and copies are by normalised plate.

    What the lexicons say of the different values is found first, so that it isn't part of the plan of all that follows.
    """
    # looked at several times, whatever it comes from: plates and times are read once, by as many tasks as the journeys have
    own = kept(blocking.dealt(records, "record_id").withColumns({"plate": F.coalesce(norm_plate(F.col("plate_number")), F.lit("")), "_ts": parse_ts(F.col("last_seen_time"))}))
    own = own.withColumns({"moment": F.col("_ts.moment"), "form": F.col("_ts.format")}).drop("_ts")
    held = of.registered.select(F.col("key").alias("plate"), *(F.col(a).alias(f"registered_{a}") for a in TEXTS.values()), F.lit(True).alias("_held"))
    r = own.join(held, "plate", "left").withColumn("registered", F.coalesce("_held", F.lit(False))).drop("_held")
    for field, a in TEXTS.items():
        values = kept(own.select(field).filter(F.col(field).isNotNull()).distinct())
        found = kept(cleansing.lookup(values, field, of.lexicons[a])).select(F.col(field).alias("_v"), F.col("canonical").alias(f"{a}_canonical"), F.col("kind").alias(f"{a}_kind"))
        r = r.join(found, F.col(field) == F.col("_v"), "left").drop("_v")
    for field, a in TEXTS.items():
        same = matching.agree(F.col(f"{a}_canonical"), F.col(f"registered_{a}"))
        seen = matching.agree(F.col(field), F.col(f"registered_{a}"))
        r = r.withColumns({f"{a}_in_lexicon": F.when(F.col(field).isNotNull(), F.coalesce(F.col(f"{a}_kind") == "exact", F.lit(False))), f"{a}_agrees": F.when(same != 0, same > 0), f"_{a}_seen": seen == 1})
    r = r.withColumns({"shape_ok": open_world.is_valid(F.col("plate")), "corroborated": F.col("_make_seen") | F.col("_colour_seen"), "below_floor": F.coalesce(F.col("ocr_confidence") < CONFIDENCE_FLOOR, F.lit(False)), "captured_at": F.col("last_seen_time")})
    r = r.drop(*(f"_{a}_seen" for a in TEXTS.values()))
    # journeys and copies are found from the few columns that tell them
    legs = timeline.journeys(own.filter("plate <> ''").select("record_id", "plate", "moment", "lat", "lon"), "plate", "moment", "record_id", MAX_KMH, CLOCK_TOLERANCE_MIN).filter("impossible")
    ends = legs.select(F.explode(F.array("record_id", "from_id")).alias("record_id")).distinct().withColumn("travel_conflict", F.lit(True))
    r = r.join(ends, "record_id", "left").withColumn("travel_conflict", F.coalesce("travel_conflict", F.lit(False)))
    twin = ("plate", "location", "last_seen_time")
    first = own.groupBy(*(F.col(c).alias(f"_{c}") for c in twin)).agg(F.min("record_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in twin]
    r = r.join(first, alike[0] & alike[1] & alike[2], "left").withColumn("duplicate_of", F.when(F.col("_first") < F.col("record_id"), F.col("_first")))
    return r.drop("_first", *(f"_{c}" for c in twin))


def matched(enriched: DataFrame, of: Known, **options) -> DataFrame:
    """(record_id, match_decision, match_best, match_best_colour_agrees, match_best_model_agrees) of the records whose plate isn't registered. options: of matching.match()."""
    open_ = enriched.filter("not registered").select(F.col("record_id").alias("case_id"), F.col("plate").alias("read"), *TEXTS, "ocr_confidence")
    best = matching.match(open_, of.registered, top=1, **options)
    agrees = lambda a: F.when(F.col(f"{a}_agree") != 0, F.col(f"{a}_agree") > 0).alias(f"match_best_{a}_agrees")
    return best.select(F.col("case_id").alias("record_id"), F.col("decision").alias("match_decision"), F.col("key").alias("match_best"), agrees("colour"), agrees("model"))


def fields(enriched: DataFrame, of: Known, matches: DataFrame | None = None) -> DataFrame:
    """A row for each field of each record, with the features that its rules ask about; what a field doesn't have is null. One pass, six rows a record.

    Without matches no plate has a candidate, and none is proposed.
    """
    none = {"value": "string", "canonical": "string", "lexicon_kind": "string", "in_lexicon": "boolean", "registered_value": "string", "agrees_registration": "boolean", "below_floor": "boolean", "corroborated": "boolean", "match_decision": "string", "match_best": "string", "match_best_colour_agrees": "boolean", "match_best_model_agrees": "boolean", "ts_parsed": "boolean", "ts_ok": "boolean", "ts_future": "boolean", "ts_normalised": "string", "duplicate_of": "string", "travel_conflict": "boolean"}
    if matches is not None:
        enriched = enriched.join(matches, "record_id", "left")
    has = lambda c: F.col(c) if c in enriched.columns else F.lit(None)

    def row(field: str, **own):
        return F.struct(F.lit(field).alias("field"), *(own.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()))

    texts = [row(f, value=F.col(f), canonical=F.col(f"{a}_canonical"), lexicon_kind=F.col(f"{a}_kind"), in_lexicon=F.col(f"{a}_in_lexicon"), registered_value=F.col(f"registered_{a}"), agrees_registration=F.col(f"{a}_agrees")) for f, a in TEXTS.items()]
    plate = row("plate_number", value=F.col("plate_number"), **{c: has(c) for c in ("below_floor", "corroborated", "match_decision", "match_best", "match_best_colour_agrees", "match_best_model_agrees")})
    parsed = F.col("moment").isNotNull()
    time = row("last_seen_time", value=F.col("last_seen_time"), ts_parsed=parsed, ts_ok=parsed & (F.col("form") == TIME_NAME), ts_future=F.coalesce(F.col("moment") > F.lit(of.horizon).cast("timestamp_ntz"), F.lit(False)), ts_normalised=F.date_format("moment", TIME_FORM))
    whole = row("record", duplicate_of=F.col("duplicate_of"), travel_conflict=F.col("travel_conflict"))
    return enriched.select("record_id", "registered", F.explode(F.array(*texts, plate, time, whole)).alias("_f")).select("record_id", "registered", "_f.*")


def screened(enriched: DataFrame, of: Known) -> DataFrame:
    """(record_id, anomalies) of every record; a plate below the floor counts only if nothing that was seen backs it."""
    return cleansing.detect(enriched, of.horizon).select("record_id", "anomalies")


def patch(records: DataFrame, proposals: DataFrame) -> DataFrame:
    """records without those that a proposal deletes, and with what proposals set: of several values of a field the largest. Rows of one id are changed alike."""
    names = ("plate_number", *TEXTS, "last_seen_time")
    sets = [F.max(F.when((F.col("action") == "set") & (F.col("field") == f), F.col("set_to"))).alias(f"_set_{f}") for f in names]
    own = proposals.filter("action in ('set', 'delete')").groupBy("record_id").agg(*sets, F.max(F.col("action") == "delete").alias("_gone"))
    out = records.join(own, "record_id", "left").filter("_gone is null or not _gone")
    return out.withColumns({f: F.coalesce(f"_set_{f}", f) for f in names}).select(*records.columns)


@dataclass
class Repaired:
    """records as they are in the end, proposals of all rounds (round from 1), and the anomalies before and after, by record."""

    records: DataFrame
    proposals: DataFrame
    before: DataFrame
    after: DataFrame
    rounds: int


def repair(records: DataFrame, of: Known, tree: Tree | None = None, match: dict | None = None, most: int = 5) -> Repaired:
    """Screens, proposes and patches until a round changes nothing, ``most`` times at most. match: options of the matcher; None leaves plates alone.

    A set that would write what is there is no change. Deleted records have no anomalies after.
    """
    tree, rounds, all_ = tree or default_tree(), 0, None
    while True:
        enriched = kept(enrich(records, of))
        found = screened(enriched, of)
        before = kept(found) if not rounds else before
        cases = fields(enriched, of, None if match is None else matched(enriched, of, **match))
        own = cleansing.propose(cases, tree).select("record_id", "field", "value", "rule", "action", "set_to", F.lit(rounds + 1).alias("round"))
        # what the last screening proposes is only made if it is asked for
        own = own if rounds == most else kept(own)
        all_ = own if all_ is None else all_.unionByName(own)
        changes = own.filter("action = 'delete' or action = 'set' and not value <=> set_to")
        if rounds == most or changes.isEmpty():
            return Repaired(records, all_, before, found, rounds)
        records, rounds = kept(patch(records, changes)), rounds + 1


def rollup(done: Repaired) -> DataFrame:
    """(part, code, n): anomalies before and after by code, and what was proposed in the first round by action."""
    count = lambda df, part: cleansing.rollup(df).select(F.lit(part).alias("part"), "code", "n")
    actions = done.proposals.filter("round = 1 and action <> 'keep'").groupBy(F.col("action").alias("code")).agg(F.count("*").alias("n"))
    return count(done.before, "before").unionByName(count(done.after, "after")).unionByName(actions.select(F.lit("proposed").alias("part"), "code", "n"))


def dispositions(done: Repaired, resolutions: DataFrame | None = None) -> DataFrame:
    """(record_id, code, disposition) of each anomaly that remains: flagged as evidence, quarantined for a person, unhandled; or resolved, if a resolution (record_id, codes) covers it."""
    field = F.create_map(*(F.lit(x) for pair in FIELD_OF.items() for x in pair))
    left = done.after.select("record_id", F.explode("anomalies").alias("code")).withColumn("field", field[F.col("code")])
    # the last round screened all records that remain; an anomaly is counted with each row of its id
    last = done.proposals.filter(F.col("round") == done.rounds + 1).select("record_id", "field", "action")
    out = left.join(last, ["record_id", "field"], "left")
    done_by = F.lit(False)
    if resolutions is not None:
        out = out.join(resolutions.groupBy("record_id").agg(F.flatten(F.collect_list("codes")).alias("codes")), "record_id", "left")
        done_by = F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False))
    kind = F.when(done_by, "resolved").when(F.col("action") == "flag", "flagged").when(F.col("action") == "quarantine", "quarantined").otherwise("unhandled")
    return out.select("record_id", "code", kind.alias("disposition"))
