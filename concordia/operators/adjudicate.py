"""Fines: six ordered checks over a case's evidence, and the cases' life as a fold of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import matching, timeline
from .cleansing import MAX_KMH

# Fixed values.
FINE_FIRST_INR, FINE_REPEAT_INR = 2000, 4000
STATUS = {"ISSUE": "ISSUED", "HOLD": "HOLD", "REJECT": "REJECTED"}


def insured_on(start: Column, expiry: Column, day: Column) -> Column:
    """Both ends count; a missing start is before everything, a missing expiry is no policy."""
    return F.coalesce((expiry >= day) & (start.isNull() | (start <= day)), F.lit(False))


def verify(cases: DataFrame) -> DataFrame:
    """verdict, reason and amount of cases with evidence joined: sources_failed (official ones), outcome, impossible_legs,

    stolen_status, last_incident_date, registration_status, insurance_start, insurance_expiry, captured_on, resolved.
    A fine is 4000 once the same key has an issued case before it in the queue, else 2000.
    """
    from .repair import kept

    day = F.col("captured_on")
    steps = [
        (F.col("sources_failed") > 0, "HOLD", "sources unreachable"),
        (F.col("outcome") == "NONE", "REJECT", "no registered match"),
        (F.col("outcome") == "AMBIGUOUS", "HOLD", "ambiguous identity"),
        (F.col("impossible_legs") > 0, "HOLD", "impossible travel"),
        ((F.col("stolen_status") == "STOLEN") & (F.col("last_incident_date").isNull() | (F.col("last_incident_date") <= day)), "REJECT", "stolen before sighting"),
        (F.col("registration_status") != "ACTIVE", "REJECT", "registration offence"),
        (insured_on(F.col("insurance_start"), F.col("insurance_expiry"), day), "REJECT", "insured on the day"),
    ]
    result = F.struct(F.lit("ISSUE").alias("verdict"), F.lit("uninsured on the day").alias("reason"))
    for when, verdict, reason in reversed(steps):
        result = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))).otherwise(result)
    # the keys' first issued cases are looked up in the cases themselves: the evidence is joined once
    out = kept(cases.withColumn("_r", result).select(*cases.columns, "_r.verdict", "_r.reason"))
    first = out.filter("verdict = 'ISSUE'").groupBy(F.col("resolved").alias("_key")).agg(F.min("case_id").alias("_first"))
    out = out.join(first, F.col("resolved") == F.col("_key"), "left")
    fine = F.when(F.col("case_id") > F.col("_first"), FINE_REPEAT_INR).otherwise(FINE_FIRST_INR)
    return out.withColumn("amount_inr", F.when(F.col("verdict") == "ISSUE", fine)).drop("_key", "_first")


def evidence(cases: DataFrame, official: DataFrame, thefts: DataFrame, policies: DataFrame, failed: list[str] = ()) -> DataFrame:
    """cases (case_id, read, observed_make, observed_colour, at, lat, lon) with all that verify() asks about, joined from the sources.

    official: key, vehicle_make, vehicle_colour, registration_status; thefts: key, stolen_status, last_incident_date; a row a key.
    policies: key, insurance_start, insurance_expiry, all of a key's. failed: authoritative sources that did not answer.
    The read is resolved to a registered key, by all its variants; the journeys are those between all cases of one resolved key; the policy is
    that in force on the day. A case of unknown identity has no such evidence.
    """
    from .repair import kept

    # each is looked at several times: reads are resolved, and the sources' texts parsed, once
    official, policies = kept(official.select("key", "vehicle_make", "vehicle_colour", "registration_status")), kept(policies.select("key", "insurance_start", "insurance_expiry"))
    known = official.select("key", F.col("vehicle_make").alias("make"), F.col("vehicle_colour").alias("colour"))
    own = kept(matching.resolve(cases, known.select("key", "make", "colour"), None).drop("make", "colour").withColumn("captured_on", F.to_date("at")))
    legs = timeline.journeys(own, "resolved", "at", "case_id", MAX_KMH).filter("impossible").groupBy(F.col("resolved").alias("key")).agg(F.count("*").alias("impossible_legs"))
    out = timeline.in_force(own.withColumn("key", F.col("resolved")), "key", "captured_on", policies.withColumnsRenamed({"insurance_start": "start", "insurance_expiry": "expiry"}))
    out = out.withColumnsRenamed({"start": "insurance_start", "expiry": "insurance_expiry"})
    out = out.join(legs, "key", "left").join(official.select("key", "registration_status"), "key", "left").join(thefts.select("key", "stolen_status", "last_incident_date"), "key", "left")
    return out.withColumns({"impossible_legs": F.coalesce("impossible_legs", F.lit(0)), "sources_failed": F.lit(len(failed))}).drop("key")


def fold(events: DataFrame) -> DataFrame:
    """Each case's status after its events (case_id, seq, event): the last that is allowed where it stands.

    NEW, ISSUE, HOLD and REJECT always take; DISPUTE_UPHELD and DISPUTE_CANCELLED only on an issued or upheld case.
    """
    ordered = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("e"))
    direct = F.create_map(*(F.lit(x) for k, v in {"NEW": "CANDIDATE", **STATUS}.items() for x in (k, v)))
    disputes = F.create_map(*(F.lit(x) for x in ("DISPUTE_UPHELD", "UPHELD", "DISPUTE_CANCELLED", "CANCELLED")))
    open_case = lambda s: s.isin("ISSUED", "UPHELD")
    step = lambda s, e: F.coalesce(F.try_element_at(direct, e["event"]), F.when(open_case(s), F.try_element_at(disputes, e["event"])), s)
    return ordered.select("case_id", F.aggregate("e", F.lit(None).cast("string"), step).alias("status"))


def prevented(cases: DataFrame) -> DataFrame:
    """(status, n) of each status of some cases, and PREVENTED: those rejected or cancelled."""
    counted = cases.groupBy("status").agg(F.count("*").alias("n"))
    return counted.unionByName(counted.agg(F.lit("PREVENTED").alias("status"), F.coalesce(F.sum(F.when(F.col("status").isin("REJECTED", "CANCELLED"), F.col("n"))), F.lit(0)).alias("n")))


def summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("verdict").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount_inr"), F.lit(0)).alias("total_inr"))
