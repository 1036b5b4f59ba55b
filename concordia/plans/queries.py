"""The registered queries of the engine's own operators, and their SQL. SQL stands in concordia.plans.oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from concordia.functions import similarity as S
from concordia.functions import transforms as T
from concordia.operators import adjudicate, blocking, cleansing, evaluate, matching, rules, schema_match
from concordia.operators import open_world as open_world_
from concordia.plans import console, mediate
from concordia.sources import sample
from concordia.sources import tables as sinks
from concordia.sources.sample import TODAY, load

from . import casework
from .oracle import ORACLE_SQL as _SQL

QUERIES: dict = dict(casework.QUERIES)
ORACLE_SQL: dict[str, str] = {**_SQL, **casework.ORACLE_SQL}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(c, n: int = 6):
    return F.round(c, n)


# ------------------------------------------------------------------ mediation


@query
def source_lookup_left(spark, d):
    rows = mediate.unfold(sample.registry().source("REG"), sample.tables(spark, d), {"owner_name", "owner_city", "rto_code"})
    return rows.select("key", "owner_name", "owner_city", "rto_code")


@query
def canonical_key(spark, d):
    (c,) = load(spark, d, "customer")
    return c.select("c_custkey", T.norm_plate(F.col("c_name")).alias("key"))


@query
def ocr_fold_match(spark, d):
    t = sample.tables(spark, d)
    reads = t["CAPTURES"].select("capture_id", T.ocr_key(F.col("plate_id")).alias("k"))
    known = t["VEHICLE"].select("registration_no", T.ocr_key(F.col("registration_no")).alias("k"))
    return reads.join(known, "k", "left").select("capture_id", "registration_no")


@query
def render_key(spark, d):
    v = sample.tables(spark, d)["VEHICLE"]
    k = F.col("registration_no")
    return v.select("registration_id", T.render_plate(k, separator="-").alias("dashed"), T.render_plate(k, (2, 2, 2, 4), " ", True).alias("spaced"))


@query
def variants_in_list(spark, d):
    """The versions of every plate, its noughts read as letters, that a source is asked for."""
    v = sample.tables(spark, d)["VEHICLE"]
    tried = v.select("registration_no", F.explode(blocking.readings(F.translate("registration_no", "0", "O"))).alias("k"))
    return tried.groupBy("registration_no").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))


@query
def latest_wins(spark, d):
    rows = mediate.unfold(sample.registry().source("INS"), sample.tables(spark, d), {"insurance_expiry", "insurance_start", "policy_type", "premium_inr"})
    return rows.select("key", *(F.col(c).cast("string").alias(c) for c in ("insurance_start", "insurance_expiry")), "policy_type", "premium_inr")


def _answer(spark, d, status=None, attributes=sample.ATTRIBUTES):
    return mediate.ask(sample.registry(), sample.tables(spark, d), attributes, TODAY, status=status)


@query
def mediated_profile(spark, d):
    p = _answer(spark, d)
    return p.select("key", "owner_name", "vehicle_make", "registration_status", F.col("insurance_expiry").cast("string").alias("insurance_expiry"), "case_status", F.date_format("last_seen_time", "yyyy-MM-dd HH:mm:ss").alias("seen"), "last_seen_location", "observed_colour")


@query
def derived_status(spark, d):
    return _answer(spark, d).groupBy("insurance_status", "stolen_status").agg(F.count("*").alias("n"))


@query
def provenance(spark, d):
    p = _answer(spark, d).select("key", F.explode("provenance").alias("attribute", "o"))
    return p.groupBy("attribute", F.col("o.source").alias("source"), F.col("o.trust").alias("trust")).agg(F.count("*").alias("n"))


@query
def conflicts(spark, d):
    return _answer(spark, d).select("key", F.explode("conflicts").alias("c")).select("key", "c.attribute", "c.official", "c.observed")


@query
def decision(spark, d):
    return _answer(spark, d).select("key", "decision", "confidence", F.size("reasons").cast("long").alias("n_reasons"))


@query
def decision_source_down(spark, d):
    return _answer(spark, d, {"REG": "TIMEOUT"}).groupBy("decision", "confidence").agg(F.count("*").alias("n"))


@query
def decision_theft_down(spark, d):
    return _answer(spark, d, {"THEFT": "DOWN"}).groupBy("decision", "confidence", "stolen_status").agg(F.count("*").alias("n"))


@query
def narrow_question(spark, d):
    """Only insurance: the registration source is asked too, the others aren't."""
    p = mediate.ask(sample.registry(), sample.tables(spark, d), ("insurance_status",), TODAY)
    return p.groupBy("decision", "confidence", F.map_keys("availability").cast("string").alias("asked")).agg(F.count("*").alias("n"))


@query
def lapse_ladder(spark, d):
    p = _answer(spark, d).filter("decision like 'UNINSURED%'")
    return p.select("key", "decision", F.date_diff(F.lit(TODAY).cast("date"), "insurance_expiry").cast("long").alias("days"))


@query
def risk_score(spark, d):
    return _answer(spark, d).select("key", F.col("risk").cast("long").alias("risk"), "risk_level", F.size("factors").cast("long").alias("n_factors"))


@query
def risk_levels(spark, d):
    return _answer(spark, d).groupBy("risk_level").agg(F.count("*").alias("n"), F.sum("risk").cast("long").alias("points"))


@query
def watchlist_alerts(spark, d):
    watched = sample.tables(spark, d)["VEHICLE"].filter("registration_id % 9 = 0").select(F.col("registration_no").alias("key"))
    return mediate.alerts(_answer(spark, d), watched)


@query
def universe(spark, d):
    t = sample.tables(spark, d)
    keys = [(s, t[s].select(T.norm_plate(F.col(c)).alias("key"))) for s, c in (("VEHICLE", "registration_no"), ("POLICY", "vehicle_reg"), ("CRIME", "vehicle_number"), ("CAPTURES", "plate_id"))]
    out = None
    for s, k in keys:
        k = k.withColumn("source", F.lit(s))
        out = k if out is None else out.unionByName(k)
    return out.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.when(F.col("source") == "CAPTURES", 1)).alias("sightings"))


@query
def majority_value(spark, d):
    cam = sample.tables(spark, d)["CAPTURES"].filter("observed_colour is not null")
    counted = cam.groupBy("plate_id", "observed_colour").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("plate_id"))
    return counted.withColumn("total", total).filter("n * 2 > total").select("plate_id", "observed_colour", "n", "total")


@query
def coverage_matrix(spark, d):
    """By attribute, how many keys each source has a value for."""
    reg, t = sample.registry(), sample.tables(spark, d)
    found = mediate.coverage({s.id: mediate.unfold(s, t) for s in reg.sources})
    return found.groupBy("attribute").pivot("source", ["REG", "INS", "THEFT", "CAM"]).agg(F.sum("n")).fillna(0)


@query
def schema_discovery(spark, d):
    (o,) = load(spark, d, "orders")
    return sinks.describe(o).select("column", "type", F.size("samples").cast("long").alias("n_samples"), F.get("samples", F.lit(0)).alias("first_sample"))


@query
def schema_matching(spark, d):
    kinds = {"plate_number": "string", "owner_name": "string", "vehicle_make": "string", "vehicle_model": "string", "vehicle_colour": "string", "registration_date": "date", "registration_status": "string", "insurance_start": "date", "insurance_expiry": "date", "last_seen_time": "datetime", "last_seen_location": "string", "observed_colour": "string", "case_status": "string"}
    t = sample.tables(spark, d)
    found = [(n, *row) for n in ("VEHICLE", "OWNERS", "POLICY", "CRIME", "CAPTURES", "CAMERAS") for row in schema_match.match(t[n], n, kinds)]
    return spark.createDataFrame(found, "table_name string, column_name string, attribute string, score double")


@query
def upsert_latest(spark, d):
    (o,) = load(spark, d, "orders")
    old = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    new = o.filter("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    base = sinks.upsert(old.limit(0), old, ["k"], "o_orderkey")
    return sinks.upsert(base, new, ["k"], "o_orderkey")


@query
def write_overlay(spark, d):
    """Set a status, delete policies of a key, then owners left without a vehicle."""
    t = sample.tables(spark, d)
    v = sinks.update(t["VEHICLE"], F.col("colour") == "Red", reg_status=F.lit("CANC"))
    v = sinks.delete(v, F.col("owner_id") < 5)
    owners = sinks.delete_orphans(t["OWNERS"], v, "owner_id", "owner_id")
    return v.join(owners, "owner_id").groupBy("full_name", "reg_status").agg(F.count("*").alias("n"))


@query
def patch_and_undo(spark, d):
    v = sample.tables(spark, d)["VEHICLE"].select("registration_id", "colour", "make")
    i = F.col("registration_id")
    log = v.filter("registration_id % 5 = 0").select(i.alias("log_id"), i.alias("record_id"), F.lit("colour").alias("field"), F.col("colour").alias("before_value"), F.lit("Green").alias("after_value"))
    stale = v.filter("registration_id % 5 = 1").select(i.alias("log_id"), i.alias("record_id"), F.lit("make").alias("field"), F.lit("not this").alias("before_value"), F.lit("LOST").alias("after_value"))
    done = sinks.patch(v, log.unionByName(stale), "registration_id")
    back = sinks.patch(done, log, "registration_id", undo=True)
    return done.select("registration_id", F.col("colour").alias("patched"), "make").join(back.select("registration_id", F.col("colour").alias("undone")), "registration_id")


# ------------------------------------------------------------------ scalar functions


@query
def value_transforms(spark, d):
    (c,) = load(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey", T.title_case(F.concat(F.lower("c_mktsegment"), F.lit("-o'neil 3rd"))).alias("title"), T.fix_make(F.when(k % 3 == 0, "hundai").when(k % 3 == 1, " MARUTI ").otherwise("tesla x")).alias("make"),
        T.status_map(F.when(k % 4 == 0, "act").when(k % 4 == 1, "SUSP").when(k % 4 == 2, "canc").otherwise("other")).alias("status"),
        T.yn_to_bool(F.when(k % 3 == 0, "y").when(k % 3 == 1, "No").otherwise("?")).cast("string").alias("flag"), T.epoch_to_date(F.when(k % 5 == 0, "x").otherwise((k * 86_399).cast("string"))).cast("string").alias("day"), T.mask_plate(F.col("c_name")).alias("masked"),
    )


@query
def parse_timestamps(spark, d):
    (e,) = load(spark, d, "events")
    at, i = F.col("ts"), F.col("event_id")
    text = F.when(i % 5 == 0, F.date_format(at, "dd/MM/yyyy HH:mm:ss")).when(i % 5 == 1, F.date_format(at, "dd-MM-yyyy HH:mm")).when(i % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(i % 5 == 3, F.unix_seconds(at.cast("timestamp")).cast("string")).otherwise("no time")
    p = T.parse_ts(text)
    return e.select("event_id", F.date_format(p["moment"], "yyyy-MM-dd HH:mm:ss").alias("moment"), p["format"].alias("format"))


@query
def shape_pattern(spark, d):
    v = sample.tables(spark, d)["VEHICLE"]
    mixed = F.when(F.col("registration_id") % 6 == 0, F.concat(F.lit("XY"), F.substring("registration_no", 3, 20))).otherwise(F.col("registration_no"))
    return v.groupBy(T.shape(mixed).alias("shape"), T.pattern(mixed, ["DL", "HR"]).alias("pattern")).agg(F.count("*").alias("n"))


@query
def extract_key(spark, d):
    (p,) = load(spark, d, "pages")
    return p.select("page_id", T.extract_key(F.concat(F.lit("select 1 where k = '"), F.substring(F.regexp_replace("url", "[^a-z]", ""), 1, 9), F.lit("'"))).alias("key"))


def _names(spark, d):
    (p,) = load(spark, d, "part")
    n = p.select(F.col("p_name").alias("name")).distinct()
    return n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("a") <= F.col("b")))


@query
def edit_similarity(spark, d):
    return _names(spark, d).select("a", "b", S.levenshtein(F.col("a"), F.col("b")).cast("long").alias("distance"), _r(S.edit(F.col("a"), F.col("b"))).alias("similarity"))


@query
def qgram_similarity(spark, d):
    a, b = F.col("a"), F.col("b")
    return _names(spark, d).select("a", "b", S.overlap_count(a, b).cast("long").alias("common"), _r(S.overlap(a, b)).alias("overlap"), _r(S.jaccard(a, b)).alias("jaccard"))


@query
def soundex_reference(spark, d):
    a, b = F.col("a"), F.col("b")
    return _names(spark, d).select("a", "b", S.soundex_code(a).alias("code_a"), S.soundex(a, b).alias("same"))


@query
def udf_similarity(spark, d):
    a, b = F.col("a"), F.col("b")
    return _names(spark, d).select("a", "b", *(_r(S.MEASURES[n](a, b)).alias(n) for n in ("jaro", "jaro_winkler", "ratcliff", "ocr_edit")))


@query
def tfidf(spark, d):
    """Cosine of part names by words, weighted by log(N / df). Equal sets of words are compared once, and then every part of the query set with every part."""
    (p,) = load(spark, d, "part")
    parts = p.filter("p_name is not null").groupBy("p_partkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))).alias("ws"))
    parts = parts.select("p_partkey", F.array_join("ws", " ").alias("c"))
    docs = parts.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", F.explode(F.split("c", " ")).alias("w"))
    n = p.select(F.count("*").alias("total"))
    df = docs.groupBy("w").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(n)).select("w", F.log(F.col("total") / F.col("df")).alias("idf"))
    weighted = docs.join(df, "w").select("c", "w", "idf")
    norms = weighted.groupBy("c").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    asked = parts.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q"), F.col("c").alias("cq"))
    probe = weighted.join(asked.select(F.col("cq").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("cq"), "w", F.col("idf").alias("iq"))
    dots = probe.join(weighted, "w").groupBy("cq", "c").agg(F.sum(F.col("iq") * F.col("idf")).alias("dot"))
    both = dots.join(norms, "c").join(norms.select(F.col("c").alias("cq"), F.col("norm").alias("nq")), "cq")
    alike = both.select("cq", "c", _r(F.col("dot") / (F.col("norm") * F.col("nq")), 4).alias("cosine"))
    # a name that many parts have is dealt over 16 tasks, and the number of tasks is told: few bytes here make many rows. Those asked for go there
    # as lists of at most 4,096 by name, not as a row for each, name and task
    salts, tasks, most = 16, max(64, 4 * spark.sparkContext.defaultParallelism), 4096
    lists = asked.groupBy("cq", F.floor(F.col("q") / (50 * most)).alias("_b")).agg(F.collect_list("q").alias("qs")).select("cq", "qs")
    left = lists.hint("merge").join(alike, "cq").select("c", "qs", "cosine").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(tasks, "c", "salt")
    right = parts.filter("p_partkey is not null").withColumn("salt", F.pmod(F.xxhash64("p_partkey"), F.lit(salts)).cast("int")).repartition(tasks, "c", "salt")
    return left.hint("merge").join(right, ["c", "salt"]).select(F.explode("qs").alias("q"), "p_partkey", "cosine")


# ------------------------------------------------------------------ blocking and matching


def _noisy(spark, d, every: int = 50):
    """Reads of the vehicles whose id is divisible by 50, the query set of searches, with one digit misread; and all registered plates."""
    v = sample.tables(spark, d)["VEHICLE"].select(F.col("registration_no").alias("key"), "registration_id", "make", "model", "colour")
    reads = v.filter(f"registration_id % {every} = 0").select(F.concat(F.substring("key", 1, 8), F.lit("7"), F.substring("key", 10, 1)).alias("read"), F.col("registration_id").alias("case_id"), F.col("key").alias("truth"), F.col("make").alias("observed_make"), F.col("colour").alias("observed_colour"))
    return reads, v


@query
def block_index(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.candidates(reads, "read", v, "key", "index", min_overlap=8)


@query
def block_size(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.candidates(reads, "read", v, "key", "size", edits=1)


@query
def block_prefix(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.candidates(reads, "read", v, "key", "prefix", edits=1)


@query
def block_position(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.candidates(reads, "read", v, "key", "position", edits=1)


@query
def blocking_quality(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.quality(blocking.candidates(reads, "read", v, "key", "position", edits=1), reads.select("read", F.col("truth").alias("key")).distinct()).select(_r("recall").alias("recall"), _r("mean_candidates").alias("mean_candidates"))


@query
def symspell(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.by_deletes(reads, "read", v, "key")


@query
def symspell_two(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.by_deletes(reads, "read", v, "key", 2)


@query
def block_none(spark, d):
    """The query set against all plates: what the other strategies are measured by."""
    reads, v = _noisy(spark, d)
    return blocking.candidates(reads, "read", v, "key", "none")


@query
def recommended_overlap(spark, d):
    reads, v = _noisy(spark, d)
    return blocking.recommended_overlap(reads, "read", v, "key", edits=2)


@query
def valid_plates(spark, d):
    c = sample.tables(spark, d)["CAPTURES"]
    other = F.when(F.col("capture_id") % 3 == 0, F.concat(F.lit("XX"), F.substring("plate_id", 3, 20))).when(F.col("capture_id") % 3 == 1, F.concat(F.lit("21BH"), F.substring("plate_id", 7, 4), F.lit("AA"))).otherwise(F.col("plate_id"))
    return c.select("capture_id", open_world_.is_valid(other).alias("valid"), open_world_.shape_of(other).alias("shape"))


@query
def value_shares(spark, d):
    v = sample.tables(spark, d)["VEHICLE"]
    return open_world_.value_shares(v, ["make", "model", "colour"]).select("attribute", "value", _r("share").alias("share"))


@query
def match_reads(spark, d):
    reads, v = _noisy(spark, d)
    out = matching.match(reads.withColumn("observed_model", F.lit(None).cast("string")), v, edits=1, top=3)
    return out.select("case_id", "read", "key", "rank", _r("p").alias("p"), _r("p_unknown").alias("p_unknown"), "decision")


@query
def reverse_match(spark, d):
    """Captures of all vehicles that a plate of the query set may claim: only where the forward ranking of the capture contains it."""
    reads, v = _noisy(spark, d, 1)
    plates = v.filter("registration_id % 50 = 0")
    back = blocking.candidates(plates, "key", reads.select(F.col("read").alias("key")), "key", "position", edits=1).select(F.col("read").alias("key"), F.col("key").alias("read"))
    asked = reads.withColumn("observed_model", F.lit(None).cast("string")).join(back.select("read").distinct(), "read", "left_semi")
    forward = matching.match(asked, v, edits=1, top=5).select("case_id", "read", "key", "rank")
    return back.select("key", "read").join(forward, ["read", "key"])


@query
def resolve_identity(spark, d):
    reads, v = _noisy(spark, d)
    r = reads.withColumn("read", F.translate("truth", "0", "O"))
    fix = F.concat(F.lit("DL"), F.substring("truth", 3, 7), F.when(F.substring("truth", 10, 1) == "0", "O").otherwise(F.substring("truth", 10, 1)))
    return matching.resolve(r.withColumn("read", fix), v).select("case_id", "resolved", F.col("score"), "outcome")


@query
def open_world(spark, d):
    reads, v = _noisy(spark, d)
    few = reads.withColumn("ocr_confidence", F.lit(0.85))
    pairs = blocking.candidates(few, "read", v, "key", "position", edits=1).join(few.select("read", "ocr_confidence").distinct(), "read")
    return open_world_.open_world(pairs).select("read", "key", _r("p_unknown").alias("p_unknown"))


# ------------------------------------------------------------------ cleansing


@query
def lexicon_mine(spark, d):
    p = load(spark, d, "part")[0].select(F.when(F.col("p_partkey") % 9 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("t"))
    return cleansing.mine(p, "t", 3)


def _typos(spark, d):
    (p,) = load(spark, d, "part")
    i, t = F.col("p_partkey"), F.col("p_type")
    return p.select(F.when(i % 7 == 0, F.concat(F.substring(t, 1, 4), F.lit("x"), F.substring(t, 5, 20))).when(i % 7 == 1, F.substring(t, 1, 3)).when(i % 7 == 2, F.lower(t)).otherwise(t).alias("value")), cleansing.mine(p, "p_type", 3)


@query
def lexicon_lookup(spark, d):
    values, lexicon = _typos(spark, d)
    return cleansing.lookup(values, "value", lexicon)


def _cases(spark, d):
    (o,) = load(spark, d, "orders")
    i = F.col("o_orderkey")
    nil = F.lit(None)
    return o.select(
        i.alias("case_id"), F.when(i % 6 == 0, "plate_number").when(i % 6 == 1, "last_seen_time").when(i % 6 == 2, "record").otherwise("observed_colour").alias("field"), F.when(i % 13 != 0, F.col("o_orderpriority")).alias("value"),
        F.when(i % 5 != 0, F.col("o_orderstatus")).alias("canonical"), (i % 4 == 0).alias("in_lexicon"), F.when(i % 7 == 0, "edit").otherwise("exact").alias("lexicon_kind"), F.when(i % 3 != 2, i % 3 == 0).alias("agrees_registration"), F.when(i % 11 != 0, F.lit("REGVAL")).alias("registered_value"),
        (i % 8 != 0).alias("registered"), F.when(i % 16 == 0, "ACCEPT").otherwise("REVIEW").alias("match_decision"), F.lit("BEST").alias("match_best"), (i % 32 == 0).alias("match_best_colour_agrees"), nil.cast("boolean").alias("match_best_model_agrees"),
        (i % 9 == 0).alias("below_floor"), (i % 18 == 0).alias("corroborated"), (i % 10 != 1).alias("ts_parsed"), (i % 4 == 3).alias("ts_ok"), (i % 14 == 1).alias("ts_future"), F.lit("NORMAL").alias("ts_normalised"), F.when(i % 12 == 2, i - 1).alias("duplicate_of"), (i % 15 == 2).alias("travel_conflict"),
    )


@query
def rdr_infer(spark, d):
    return rules.default_tree().infer(_cases(spark, d)).select("case_id", "rule", "action", "set_to")


@query
def cleansing_proposals(spark, d):
    return cleansing.propose(_cases(spark, d), rules.default_tree()).groupBy("field", "rule", "action").agg(F.count("*").alias("n"))


def _captures(spark, d):
    t = sample.tables(spark, d)
    cam = t["CAPTURES"].join(F.broadcast(t["CAMERAS"]), "camera_id").withColumn("at", F.col("captured_at").cast("timestamp_ntz"))
    return cam, t


@query
def duplicates(spark, d):
    cam, _ = _captures(spark, d)
    twice = cam.filter("capture_id % 20 = 0").withColumn("capture_id", F.col("capture_id") + 1_000_000)
    both = cam.unionByName(twice)
    return cleansing.duplicates(both, ["plate_id", "location_name", "captured_at"], "capture_id").filter("duplicate_of is not null").select("capture_id", "duplicate_of")


@query
def travel_legs(spark, d):
    cam, _ = _captures(spark, d)
    out = cleansing.legs(cam, "plate_id", "at", "capture_id", tolerance_min=10.0)
    return out.select("capture_id", F.col("from_capture_id").alias("from_id"), _r("km", 4).alias("km"), _r("minutes", 4).alias("minutes"), "impossible")


def _detected(spark, d):
    cam, t = _captures(spark, d)
    reg = t["VEHICLE"].select(F.col("registration_no").alias("plate_id"), F.col("colour"))
    out = cam.join(reg, "plate_id", "left").withColumns({
        "registered": F.col("colour").isNotNull(), "shape_ok": F.col("plate_id").rlike("^[A-Z]{2}[0-9]{2}[A-Z]{1,3}[0-9]{4}$"), "colour_agrees": F.lower("colour") == F.lower("observed_colour"),
        "captured_at": F.when(F.col("capture_id") % 17 == 0, "??").when(F.col("capture_id") % 17 == 1, F.date_format("at", "dd/MM/yyyy HH:mm")).otherwise(F.col("captured_at"))})
    return cleansing.detect(out, "2024-01-28 00:00:00")


@query
def anomaly_rollup(spark, d):
    return cleansing.rollup(_detected(spark, d))


@query
def dispositions(spark, d):
    """Times that can be read are written in the standard form, and the repaired records are screened again."""
    found = _detected(spark, d).withColumnRenamed("anomalies", "before")
    read = F.date_format(T.parse_ts(F.col("captured_at"))["moment"], "yyyy-MM-dd HH:mm:ss")
    again = cleansing.detect(found.withColumn("captured_at", F.coalesce(read, "captured_at")), "2024-01-28 00:00:00")
    return again.groupBy(cleansing.disposition(F.col("before"), F.col("anomalies")).alias("disposition")).agg(F.count("*").alias("n"))


@query
def active_resolutions(spark, d):
    (e,) = load(spark, d, "events")
    log = e.select(F.col("event_id").alias("log_id"), F.lit("CAM").alias("source_id"), F.col("user_id").alias("record_id"), F.array("event_type").alias("codes"), F.col("event_type").alias("decision"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("undone_at"))
    out = cleansing.active_resolutions(log)
    return out.select("record_id", F.array_join("codes", ",").alias("codes"), "decision")


# ------------------------------------------------------------------ adjudication and logs


@query
def case_life(spark, d):
    (e,) = load(spark, d, "events")
    names = F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "view", "ISSUE").when(F.col("event_type") == "click", "HOLD").when(F.col("event_type") == "purchase", "DISPUTE_UPHELD").otherwise("DISPUTE_CANCELLED")
    return adjudicate.fold(e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), names.alias("event")))


@query
def prior_count(spark, d):
    (o,) = load(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("prior"))


@query
def repeat_running(spark, d):
    (o,) = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return o.select("o_orderkey", F.coalesce(F.sum((F.col("o_orderstatus") == "F").cast("int")).over(w), F.lit(0)).alias("before"))


@query
def log_topn(spark, d):
    (e,) = load(spark, d, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "event_type")


@query
def audit_union(spark, d):
    e, o = load(spark, d, "events", "orders")
    a = e.filter("event_type = 'error'").select(F.lit("EVENT").alias("log"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    b = o.filter("o_orderstatus = 'P'").select(F.lit("ORDER").alias("log"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return a.unionByName(b).orderBy(F.desc("at"), "log", "id").limit(100).select("log", "id")


@query
def diff_rows(spark, d):
    """Which fields of which rows differ between two versions of a table; rows on one side only count as all fields."""
    (c,) = load(spark, d, "customer")
    fields = lambda t: t.select("c_custkey", F.explode(F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("field", "v"))
    new = c.filter("c_custkey % 100 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 30 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    both = fields(c).withColumnRenamed("v", "before").join(fields(new).withColumnRenamed("v", "after"), ["c_custkey", "field"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


@query
def sql_console(spark, d):
    return console.query(spark, "WITH t AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT r_name, n, 'drop; --' AS note FROM t WHERE n > 0", dict(zip(("nation", "region"), load(spark, d, "nation", "region"))))


# ------------------------------------------------------------------ evaluation


def _scored(spark, d):
    (x,) = load(spark, d, "labels")
    return x.select("doc_id", "quality", "toxic", ((F.col("doc_id") * 37 % 101) / 101.0).alias("p"), (F.col("doc_id") * 37 % 101 > 40).cast("int").alias("guess"))


@query
def eval_metrics(spark, d):
    e = evaluate.ratios(_scored(spark, d), "guess", "quality")
    return e.select("tp", "fp", "fn", *(_r(c).alias(c) for c in ("precision", "recall", "f1")))


@query
def ranking_metrics(spark, d):
    x = _scored(spark, d).select(F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 6).alias("rank"))
    return evaluate.ranking(x).select(*(_r(c).alias(c) for c in ("top1", "top5", "mrr")))


@query
def ece(spark, d):
    return evaluate.ece(_scored(spark, d), "p", "quality").select(_r("ece").alias("ece"))


@query
def mcnemar(spark, d):
    return evaluate.mcnemar(_scored(spark, d), "guess", "quality").select("b01", "b10", _r("p_value").alias("p_value"))


@query
def precision_threshold(spark, d):
    return evaluate.threshold(_scored(spark, d), "p", "quality", 0.85).select(_r("threshold").alias("threshold"))


@query
def bucket_pivot(spark, d):
    (o,) = load(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


@query
def confusion_counts(spark, d):
    reads, _ = _noisy(spark, d, 1)
    return evaluate.confusions(reads, "truth", "read")


@query
def learned_cost(spark, d):
    reads, _ = _noisy(spark, d, 1)
    return evaluate.learned_costs(evaluate.confusions(reads, "truth", "read")).select("a", "b", _r("cost").alias("cost"))


@query
def stratified_sample(spark, d):
    (o,) = load(spark, d, "orders")
    return evaluate.stratified(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 40)


@query
def hash_split(spark, d):
    """60/20/20 by a hash of the key, the same for all rows of a key."""
    v = sample.tables(spark, d)["VEHICLE"]
    bucket = F.conv(F.substring(F.md5("registration_no"), 1, 4), 16, 10).cast("int") % 100
    return v.groupBy(F.when(bucket < 60, "train").when(bucket < 80, "validation").otherwise("test").alias("part")).agg(F.count("*").alias("n"))


@query
def percentiles(spark, d):
    (e,) = load(spark, d, "events")
    return evaluate.percentiles(e, "value").select(_r("p50").alias("p50"), _r("p95").alias("p95"))


@query
def bootstrap_interval(spark, d):
    return evaluate.bootstrap(_scored(spark, d), "quality", "doc_id").select(_r("low").alias("low"), _r("high").alias("high"))


@query
def mode_per_group(spark, d):
    (p,) = load(spark, d, "part")
    return cleansing.modes(p, ["p_brand"], "p_type")


@query
def dominant_format(spark, d):
    cam, _ = _captures(spark, d)
    text = F.when(F.col("capture_id") % 3 == 0, F.date_format("at", "dd/MM/yyyy HH:mm")).otherwise(F.col("captured_at"))
    return cleansing.dominant_format(cam.withColumn("t", text), "t")


@query
def operator_tally(spark, d):
    (o,) = load(spark, d, "orders")
    i = F.col("o_orderkey")
    log = o.filter("o_orderkey % 3 = 0").select(i.alias("record_id"), F.lit("status").alias("field"), F.lit("F").alias("after_value"), F.col("o_orderpriority").alias("actor"))
    now = o.select(i.alias("k"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    return cleansing.tally(log, now, "k")


@query
def noise_detection(spark, d):
    """Clean captures, damaged in known ways, and how many of each kind are noticed."""
    cam, t = _captures(spark, d)
    reg = t["VEHICLE"].select(F.col("registration_no").alias("true"), F.lit(True).alias("known"))
    clean = cam.filter("capture_id % 10 <> 0 and ocr_confidence >= 0.7").select("capture_id", "plate_id", "observed_colour", "captured_at")
    noisy = cleansing.inject(clean, "capture_id")
    full = noisy.join(F.broadcast(spark.createDataFrame([(c,) for c in sample.COLOURS], "c string")), F.col("c") == F.col("observed_colour"), "left").join(reg, F.col("true") == F.col("plate_id"), "left")
    full = full.withColumns({"registered": F.coalesce("known", F.lit(False)), "shape_ok": F.col("plate_id").rlike("^[A-Z]{2}[0-9]{2}[A-Z]{1,3}[0-9]{4}$"), "colour_in_lexicon": F.col("c").isNotNull()})
    return cleansing.detection(cleansing.detect(full, "2026-01-01 00:00:00"))


@query
def key_shapes(spark, d):
    """Support of each shape of the recorded keys, and whether a read of that shape is plausible."""
    cam, _ = _captures(spark, d)
    return cam.groupBy(T.shape(F.col("plate_id")).alias("shape")).agg(F.count("*").alias("support")).withColumn("plausible", F.col("support") >= 2)


@query
def pages_by_host(spark, d):
    (p,) = load(spark, d, "pages")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.max("page_id").alias("last"))


@query
def report_story(spark, d):
    """The lines of a report on each hot key, in order, as one text."""
    p = _answer(spark, d).filter("decision like 'STOLEN%' or decision like 'SCRAPPED%'")
    nil = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not checked"))
    return p.select("key", F.concat_ws("\n", F.concat(F.lit("Vehicle: "), F.col("key")), F.concat(F.lit("Decision: "), F.col("decision")), F.concat(F.lit("Case: "), nil("case_status")), F.concat(F.lit("Last seen: "), nil("last_seen_location"))).alias("story"))


@query
def disputes_union(spark, d):
    """Keys of both hot and watched lists once, those of either alone, by set operations."""
    a = sample.tables(spark, d)["VEHICLE"]
    red, few = (a.filter(c).select("registration_no") for c in ("colour = 'Red'", "registration_id % 4 = 0"))
    both, any_, only = red.intersect(few), red.union(few).distinct(), red.exceptAll(few)
    return both.select("registration_no", F.lit("both").alias("part")).unionByName(only.select("registration_no", F.lit("red").alias("part"))).unionByName(any_.join(red, "registration_no", "left_anti").select("registration_no", F.lit("few").alias("part")))
