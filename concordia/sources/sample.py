"""Four vehicle sources over the driver's tables, each with its own key spelling and encodings, and the registry that describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Lookup, Mapping, Registry, Source

TODAY = "2000-06-15"
COLOURS = ("Red", "Blue", "Grey", "White", "Black")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def plate(n) -> F.Column:
    """A plate of a number: two letters, two digits, two letters, four digits."""
    return F.concat(F.lit("DL"), F.lpad((F.floor(n / 10_000) % 100).cast("string"), 2, "0"), F.lit("AB"), F.lpad((n % 10_000).cast("string"), 4, "0"))


def dashed(c, sep: str) -> F.Column:
    return F.concat_ws(sep, F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 2), F.substring(c, 7, 4))


def colour(n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, COLOURS)), (n % 5 + 1).cast("int"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer, nation, region, orders, events = load(spark, sf_dir, "customer", "nation", "region", "orders", "events")
    k = F.col("c_custkey")
    vehicle = customer.select(k.alias("registration_id"), plate(k).alias("registration_no"), F.col("c_nationkey").alias("owner_id"), F.col("c_mktsegment").alias("make"), F.concat(F.lit("model "), (k % 7).cast("string")).alias("model"), colour(k).alias("colour"), F.date_add(F.lit("1990-01-01").cast("date"), (k % 3000).cast("int")).alias("registered_on"), F.when(F.col("c_acctbal") < 0, "SUSP").otherwise("ACT").alias("reg_status"), F.substring(plate(k), 1, 4).alias("rto_code"))
    owner = nation.select(F.col("n_nationkey").alias("owner_id"), F.lower("n_name").alias("full_name"), F.col("n_regionkey").alias("region_id"))
    place = region.select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("city"))
    policy = orders.select(F.col("o_orderkey").alias("policy_id"), dashed(plate(F.col("o_custkey")), "-").alias("vehicle_reg"), F.col("o_orderpriority").alias("policy_type"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("policy_start"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 365), "dd/MM/yyyy").alias("policy_until"), F.lit(1).alias("is_active"), F.col("o_totalprice").alias("premium_inr"))
    e = F.col("event_id")
    crime = events.filter("event_type = 'error' and value > 60").select(e.alias("incident_id"), F.lower(dashed(plate(F.col("user_id")), " ")).alias("vehicle_number"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("reported_date"), F.when(e % 11 == 0, "SHREDDING").otherwise("THEFT").alias("incident_type"), F.lit("Y").alias("stolen_flag"), F.when(e % 3 == 0, "Y").otherwise("N").alias("recovered_flag"), F.when(e % 2 == 0, "open").otherwise("CLOSED").alias("case_status"))
    seen = F.when(e % 10 == 0, F.translate(plate(F.col("user_id") + 20), "0", "O")).otherwise(plate(F.col("user_id") + 20))
    capture = events.filter("event_type in ('view', 'click', 'purchase')").select(e.alias("capture_id"), seen.alias("plate_id"), (e % 7).cast("int").alias("camera_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"), F.when(e % 4 == 0, "TRUCK").otherwise(F.lit(None)).alias("observed_make"), F.concat(F.lit("model "), ((F.col("user_id") + 20) % 7).cast("string")).alias("observed_model"), colour(F.col("user_id") + 20 + F.when(e % 4 == 0, 1).otherwise(0)).alias("observed_colour"), F.round(F.least(F.lit(1.0), F.col("value") / 100), 3).alias("ocr_confidence"))
    c = F.col("id")
    camera = spark.range(7).select(c.cast("int").alias("camera_id"), F.concat(F.lit("junction "), c.cast("string")).alias("location_name"), (28 + c * 0.35).alias("lat"), (77 + c * 0.25).alias("lon"))
    return {"VEHICLE": vehicle, "OWNERS": owner, "PLACES": place, "POLICY": policy, "CRIME": crime, "CAPTURES": capture, "CAMERAS": camera}


def registry() -> Registry:
    m = Mapping
    reg = Source("REG", "VEHICLE", (m("VEHICLE", "registration_no", "plate_number"), m("OWNERS", "full_name", "owner_name", "title_case"), m("PLACES", "city", "owner_city"), m("VEHICLE", "make", "vehicle_make", "title_case"), m("VEHICLE", "model", "vehicle_model", "title_case"), m("VEHICLE", "colour", "vehicle_colour", "title_case"), m("VEHICLE", "registered_on", "registration_date"), m("VEHICLE", "reg_status", "registration_status", "status_map"), m("VEHICLE", "rto_code", "rto_code")), (Lookup("VEHICLE", "owner_id", "OWNERS", "owner_id"), Lookup("OWNERS", "region_id", "PLACES", "region_id")), trust=0.95, identity=True, tie="registration_id")
    ins = Source("INS", "POLICY", (m("POLICY", "vehicle_reg", "plate_number"), m("POLICY", "policy_type", "policy_type"), m("POLICY", "policy_start", "insurance_start", "parse_ddmmyyyy"), m("POLICY", "policy_until", "insurance_expiry", "parse_ddmmyyyy", True), m("POLICY", "premium_inr", "premium_inr")), trust=0.90, tie="policy_id")
    theft = Source("THEFT", "CRIME", (m("CRIME", "vehicle_number", "plate_number"), m("CRIME", "reported_date", "last_incident_date", "epoch_to_date", True), m("CRIME", "case_status", "case_status", "status_map"), m("CRIME", "stolen_flag", "stolen_flag", "yn_to_bool"), m("CRIME", "recovered_flag", "recovered_flag", "yn_to_bool"), m("CRIME", "incident_type", "incident_type")), trust=0.90, tie="incident_id")
    cam = Source("CAM", "CAPTURES", (m("CAPTURES", "plate_id", "plate_number"), m("CAPTURES", "captured_at", "last_seen_time", "iso_moment", True), m("CAMERAS", "location_name", "last_seen_location", "title_case"), m("CAPTURES", "observed_make", "observed_make", "title_case"), m("CAPTURES", "observed_model", "observed_model", "title_case"), m("CAPTURES", "observed_colour", "observed_colour", "title_case"), m("CAPTURES", "ocr_confidence", "ocr_confidence")), (Lookup("CAPTURES", "camera_id", "CAMERAS", "camera_id"),), "observational", 0.60, tie="capture_id")
    return Registry((reg, ins, theft, cam), ("owner_city", "rto_code", "premium_inr", "stolen_flag", "recovered_flag", "incident_type", "ocr_confidence"))


ATTRIBUTES = ("owner_name", "owner_city", "vehicle_make", "vehicle_model", "vehicle_colour", "registration_status", "policy_type", "insurance_start", "insurance_expiry", "insurance_status", "stolen_status", "last_incident_date", "case_status", "incident_type", "last_seen_time", "last_seen_location", "observed_make", "observed_model", "observed_colour", "ocr_confidence")
