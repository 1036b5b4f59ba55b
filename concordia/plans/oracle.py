"""The same queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

TODAY = "2000-06-15"


def _plate(n: str) -> str:
    return f"('DL' || lpad(((({n}) // 10000) % 100)::varchar, 2, '0') || 'AB' || lpad((({n}) % 10000)::varchar, 4, '0'))"


def _colour(n: str) -> str:
    return f"(['Red','Blue','Grey','White','Black'])[(({n}) % 5 + 1)::int]"


def _norm(c: str) -> str:
    return f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"


def _title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '')"


TABLES = f"""
vehicle AS (SELECT c_custkey AS registration_id, {_plate('c_custkey')} AS registration_no, c_nationkey AS owner_id, c_mktsegment AS make, 'model ' || (c_custkey % 7) AS model, {_colour('c_custkey')} AS colour,
  CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status, left({_plate('c_custkey')}, 4) AS rto_code FROM customer),
policy AS (SELECT o_orderkey AS policy_id, {_plate('o_custkey')} AS key, o_orderpriority AS policy_type, o_orderdate::date AS start, (o_orderdate::date + 365)::date AS expiry, o_totalprice AS premium_inr FROM orders),
crime AS (SELECT event_id, {_plate('user_id')} AS key, ts::date AS day, CASE WHEN event_id % 11 = 0 THEN 'SHREDDING' ELSE 'THEFT' END AS incident_type, event_id % 3 = 0 AS recovered, CASE WHEN event_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS case_status FROM events WHERE event_type = 'error' AND value > 60),
captures AS (SELECT event_id AS capture_id, CASE WHEN event_id % 10 = 0 THEN replace({_plate('user_id + 20')}, '0', 'O') ELSE {_plate('user_id + 20')} END AS plate_id, event_id % 7 AS camera_id, date_trunc('second', ts) AS seen_at,
  CASE WHEN event_id % 4 = 0 THEN 'TRUCK' END AS observed_make, 'model ' || ((user_id + 20) % 7) AS observed_model, {_colour('user_id + 20 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END')} AS observed_colour, round(least(1.0, value / 100), 3) AS ocr_confidence
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
reg AS (SELECT registration_no AS key, {_title('lower(n_name)')} AS owner_name, r_name AS owner_city, {_title('make')} AS vehicle_make, {_title('model')} AS vehicle_model, colour AS vehicle_colour, status AS registration_status, rto_code
  FROM vehicle LEFT JOIN nation ON owner_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey QUALIFY row_number() OVER (PARTITION BY registration_no ORDER BY registration_id) = 1),
ins AS (SELECT * FROM policy QUALIFY row_number() OVER (PARTITION BY key ORDER BY expiry DESC, policy_id) = 1),
theft AS (SELECT * FROM crime QUALIFY row_number() OVER (PARTITION BY key ORDER BY day DESC, event_id) = 1),
cam AS (SELECT plate_id AS key, seen_at, {_title("'junction ' || camera_id")} AS location, {_title('observed_make')} AS observed_make, {_title('observed_model')} AS observed_model, observed_colour, ocr_confidence FROM captures QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY seen_at DESC, capture_id) = 1)"""


def _profile(reg: str = "OK", theft: str = "OK") -> str:
    """The decided profile, with sources REG and THEFT in some state."""
    on = lambda s: "true" if s == "OK" else "false"
    return f"""WITH {TABLES},
live_reg AS (SELECT * FROM reg WHERE {on(reg)}), live_theft AS (SELECT * FROM theft WHERE {on(theft)}),
joined AS (SELECT coalesce(r.key, i.key, t.key, c.key) AS key, r.* EXCLUDE (key), i.policy_type, i.start AS insurance_start, i.expiry AS insurance_expiry, i.premium_inr, t.day AS last_incident_date, t.case_status, t.key IS NOT NULL AS stolen, t.recovered, t.incident_type,
  c.seen_at, c.location, c.observed_make, c.observed_model, c.observed_colour, c.ocr_confidence
  FROM live_reg r FULL JOIN ins i ON r.key = i.key FULL JOIN live_theft t ON coalesce(r.key, i.key) = t.key FULL JOIN cam c ON coalesce(r.key, i.key, t.key) = c.key),
derived AS (SELECT *, CASE WHEN insurance_expiry >= DATE '{TODAY}' THEN 'VALID' WHEN insurance_expiry IS NOT NULL THEN 'EXPIRED' ELSE 'NONE' END AS insurance_status,
  CASE WHEN {on(theft)} THEN CASE WHEN stolen AND recovered THEN 'RECOVERED' WHEN stolen THEN 'STOLEN' ELSE 'NOT_REPORTED' END ELSE 'UNKNOWN' END AS stolen_status,
  coalesce((lower(vehicle_make) <> lower(observed_make))::int, 0) AS m1, coalesce((lower(vehicle_model) <> lower(observed_model))::int, 0) AS m2, coalesce((lower(vehicle_colour) <> lower(observed_colour))::int, 0) AS m3, date_diff('day', insurance_expiry, DATE '{TODAY}') AS lapsed FROM joined),
ruled AS (SELECT *, CASE
  WHEN NOT {on(theft)} THEN 'UNDETERMINED|LOW|1'
  WHEN stolen_status = 'STOLEN' AND case_status = 'OPEN' THEN 'STOLEN — ALERT POLICE|HIGH|1'
  WHEN incident_type = 'SHREDDING' AND seen_at IS NOT NULL THEN 'SCRAPPED — ALERT POLICE|HIGH|1'
  WHEN incident_type = 'SHREDDING' THEN 'SCRAPPED — REGISTRATION VOID|HIGH|1'
  WHEN seen_at IS NOT NULL AND registration_status IS NULL AND NOT {on(reg)} THEN 'UNDETERMINED|LOW|1'
  WHEN seen_at IS NOT NULL AND registration_status IS NULL THEN 'UNREGISTERED / SUSPICIOUS|MEDIUM|1'
  WHEN {on(reg)} AND seen_at IS NULL AND registration_status IS NULL AND last_incident_date IS NULL AND case_status IS NULL AND insurance_expiry IS NULL THEN 'UNKNOWN VEHICLE — NOT REGISTERED|MEDIUM|1'
  WHEN m1 + m2 + m3 >= 2 THEN 'SUSPICIOUS — POSSIBLE CLONED PLATE|MEDIUM|1'
  WHEN insurance_status = 'NONE' THEN 'UNINSURED — REPORT|HIGH|1'
  WHEN insurance_status = 'EXPIRED' AND lapsed BETWEEN 1 AND 15 THEN 'UNINSURED — ADVISORY|MEDIUM|1'
  WHEN insurance_status = 'EXPIRED' AND lapsed BETWEEN 16 AND 30 THEN 'UNINSURED — WARNING|HIGH|1'
  WHEN insurance_status = 'EXPIRED' THEN 'UNINSURED — REPORT|HIGH|1'
  WHEN registration_status <> 'ACTIVE' THEN 'REGISTRATION INVALID — REPORT|HIGH|1'
  ELSE 'CLEAR|' || CASE WHEN seen_at IS NOT NULL AND {on(reg)} THEN 'HIGH' ELSE 'MEDIUM' END || '|' || (coalesce((registration_status = 'ACTIVE')::int, 0) + 1 + (stolen_status IN ('NOT_REPORTED', 'RECOVERED'))::int + (seen_at IS NULL)::int) END AS rule FROM derived),
p AS (SELECT *, split_part(rule, '|', 1) AS decision, split_part(rule, '|', 2) AS confidence, split_part(rule, '|', 3)::bigint AS n_reasons FROM ruled),
scored AS (SELECT *, CASE WHEN decision LIKE '%STOLEN%' THEN 90 WHEN decision LIKE '%SCRAPPED%' THEN 90 WHEN decision LIKE '%UNINSURED%' THEN 70 WHEN decision LIKE '%REGISTRATION INVALID%' THEN 60 WHEN decision LIKE '%UNREGISTERED%' THEN 50 WHEN decision LIKE '%SUSPICIOUS%' THEN 55 WHEN decision LIKE '%UNKNOWN VEHICLE%' THEN 40 WHEN decision LIKE '%CLEAR%' THEN 5 ELSE 30 END AS f0,
  least(15, 5 * (m1 + m2 + m3)) AS f1, coalesce((date_diff('day', DATE '{TODAY}', insurance_expiry) BETWEEN 0 AND 30)::int, 0) * 10 AS f2, coalesce((date_diff('day', seen_at::date, DATE '{TODAY}') > 60)::int, 1) * 5 AS f3,
  (registration_status IS NOT NULL)::int * 6 AS nr, (key IN (SELECT key FROM ins))::int * 3 AS ni, (stolen)::int * 5 AS nt, (seen_at IS NOT NULL)::int * (4 + (observed_make IS NOT NULL)::int + 1) AS nc FROM p),
risked AS (SELECT *, least(100, f0 + f1 + f2 + f3 + low * 5) AS risk, 1 + (f1 > 0)::int + (f2 > 0)::int + (f3 > 0)::int + low AS n_factors FROM (SELECT *, coalesce(((nr * 0.95::double + (ni + nt) * 0.9::double + nc * 0.6::double) / nullif(nr + ni + nt + nc, 0) < 0.8)::int, 0) AS low FROM scored)),
final AS (SELECT *, CASE WHEN risk < 25 THEN 'LOW' WHEN risk < 55 THEN 'MEDIUM' WHEN risk < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM risked)
"""


def _grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: ('#' || upper({c}) || '#')[i:i+1]))"


NAMES = "WITH n AS (SELECT DISTINCT p_name AS name FROM part), pairs AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name[1] = y.name[1] AND x.name <= y.name)"


def _soundex(c: str) -> str:
    x = f"translate(regexp_replace(regexp_replace(upper({c}), '[^A-Z]', '', 'g')[2:], '[WH]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    for i in range(1, 7):
        x = f"regexp_replace({x}, '{i}+', '{i}', 'g')"
    return f"left(regexp_replace(upper({c}), '[^A-Z]', '', 'g')[1:1] || regexp_replace({x}, '[^0-9]', '', 'g') || '000', 4)"


NOISY = f"WITH v AS (SELECT c_custkey AS registration_id, {_plate('c_custkey')} AS key FROM customer), reads AS (SELECT DISTINCT key[1:8] || '7' || key[10:10] AS read, key AS truth, registration_id AS case_id FROM v WHERE registration_id % 50 = 0)"
ALL_NOISY = NOISY.replace(" WHERE registration_id % 50 = 0", "")
BLOCKS = f"""{NOISY}, rt AS (SELECT DISTINCT read, unnest({_grams('read')}) AS token FROM reads), kt AS (SELECT key, unnest({_grams('key')}) AS token FROM v),
rn AS (SELECT read, count(*) AS nx FROM rt GROUP BY 1), kn AS (SELECT key, count(*) AS ny FROM kt GROUP BY 1), c AS (SELECT read, key, count(*) AS shared FROM rt JOIN kt USING (token) GROUP BY ALL)"""
WITHIN_ONLY = "SELECT read, key, shared FROM c JOIN rn USING (read) JOIN kn USING (key) WHERE abs(nx - ny) <= 2 AND shared >= greatest(1, greatest(nx, ny) - 2)"
WITHIN = f"{BLOCKS} {WITHIN_ONLY}"

CASES = """WITH c AS (SELECT o_orderkey AS i, CASE i % 6 WHEN 0 THEN 'plate_number' WHEN 1 THEN 'last_seen_time' WHEN 2 THEN 'record' ELSE 'observed_colour' END AS field, CASE WHEN i % 13 <> 0 THEN o_orderpriority END AS value, CASE WHEN i % 5 <> 0 THEN o_orderstatus END AS canonical, i % 4 = 0 AS in_lexicon,
  i % 7 = 0 AS by_edit, CASE WHEN i % 3 <> 2 THEN i % 3 = 0 END AS agrees, CASE WHEN i % 11 <> 0 THEN 'REGVAL' END AS registered_value, i % 16 = 0 AS accepted FROM orders),
r AS (SELECT *, CASE WHEN field = 'observed_colour' AND canonical IS NOT NULL AND NOT in_lexicon THEN CASE WHEN by_edit AND agrees = false THEN 'R2' ELSE 'R1' END
  WHEN field = 'observed_colour' AND value IS NOT NULL AND canonical IS NULL AND registered_value IS NOT NULL THEN 'R3'
  WHEN (field = 'observed_colour' AND in_lexicon AND agrees = false) OR (field = 'record' AND i % 15 = 2) THEN 'R4'
  WHEN field = 'plate_number' AND i % 8 = 0 AND accepted THEN CASE WHEN i % 32 <> 0 THEN 'R12' ELSE 'R5' END
  WHEN field = 'plate_number' AND i % 8 = 0 THEN 'R6'
  WHEN field = 'plate_number' AND i % 9 = 0 THEN CASE WHEN i % 18 = 0 THEN 'R8' ELSE 'R7' END
  WHEN field = 'last_seen_time' AND i % 10 <> 1 AND i % 4 <> 3 AND i % 14 <> 1 THEN 'R9'
  WHEN field = 'last_seen_time' AND (i % 10 = 1 OR i % 14 = 1) THEN 'R10'
  WHEN field = 'record' AND i % 12 = 2 THEN 'R11' ELSE 'R0' END AS rule FROM c),
inferred AS (SELECT i AS case_id, field, rule, CASE rule WHEN 'R0' THEN 'keep' WHEN 'R1' THEN 'set' WHEN 'R2' THEN 'quarantine' WHEN 'R3' THEN 'set' WHEN 'R4' THEN 'flag' WHEN 'R5' THEN 'set' WHEN 'R6' THEN 'quarantine' WHEN 'R7' THEN 'quarantine' WHEN 'R8' THEN 'keep' WHEN 'R9' THEN 'set' WHEN 'R10' THEN 'quarantine' WHEN 'R11' THEN 'delete' WHEN 'R12' THEN 'quarantine' END AS action,
  CASE rule WHEN 'R1' THEN canonical WHEN 'R3' THEN registered_value WHEN 'R4' THEN 'CLONE_SUSPECT' WHEN 'R5' THEN 'BEST' WHEN 'R9' THEN 'NORMAL' END AS value FROM r)"""

DETECTED = f"""WITH {TABLES}, d AS (SELECT c.*, v.colour, CASE WHEN capture_id % 17 = 0 THEN 'bad' WHEN capture_id % 17 = 1 THEN 'other' ELSE 'iso' END AS fmt, CASE WHEN capture_id % 17 = 1 THEN date_trunc('minute', seen_at) ELSE seen_at END AS moment FROM captures c LEFT JOIN vehicle v ON plate_id = registration_no),
a AS (SELECT capture_id, list_filter([CASE WHEN colour IS NULL THEN 'PLATE_NOT_REGISTERED' END, CASE WHEN NOT regexp_full_match(plate_id, '[A-Z]{{2}}[0-9]{{2}}[A-Z]{{1,3}}[0-9]{{4}}') THEN 'PLATE_SHAPE_INVALID' END, CASE WHEN colour <> observed_colour THEN 'COLOUR_DISAGREES_REGISTRATION' END, CASE WHEN ocr_confidence < 0.7 THEN 'LOW_OCR_CONFIDENCE' END,
  CASE WHEN fmt = 'bad' THEN 'TIMESTAMP_UNPARSEABLE' END, CASE WHEN fmt <> 'bad' AND moment > TIMESTAMP '2024-01-28 00:00:00' THEN 'TIMESTAMP_FUTURE' END, CASE WHEN fmt = 'other' THEN 'TIMESTAMP_NONSTANDARD' END], lambda x: x IS NOT NULL) AS codes FROM d)"""

SCORED = "WITH s AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 101) / 101.0::double AS p, (doc_id * 37 % 101 > 40)::int AS guess FROM labels)"

_HELD = {
    "REG": ("reg", 0.95, {a: a for a in ("owner_name", "owner_city", "vehicle_make", "vehicle_model", "vehicle_colour", "registration_status")}), "INS": ("ins", 0.9, {"policy_type": "policy_type", "insurance_start": "start", "insurance_expiry": "expiry"}),
    "THEFT": ("theft", 0.9, {"last_incident_date": "day", "case_status": "case_status", "stolen_flag": "key", "recovered_flag": "recovered", "incident_type": "incident_type"}),
    "CAM": ("cam", 0.6, {"last_seen_time": "seen_at", "last_seen_location": "location", "observed_make": "observed_make", "observed_model": "observed_model", "observed_colour": "observed_colour", "ocr_confidence": "ocr_confidence"}),
}
_MORE = {"REG": {"registration_date": "key", "rto_code": "rto_code"}, "INS": {"premium_inr": "premium_inr"}}
_PROVENANCE = " UNION ALL ".join(f"SELECT '{a}' AS attribute, '{s}' AS source, {trust}::double AS trust, count({c}) AS n FROM {t}" for s, (t, trust, own) in _HELD.items() for a, c in own.items())
_COVERED = " UNION ALL ".join(f"SELECT '{a}' AS attribute, " + ", ".join(f"count({c}) AS {x}" if x == s else f"0 AS {x}" for x in _HELD) + f" FROM {t}" for s, (t, _, own) in _HELD.items() for a, c in {**own, **_MORE.get(s, {})}.items())
_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))
_CONFUSED = "CASE read[i:i] WHEN '0' THEN ['O', 'D'] WHEN 'O' THEN ['0', 'D'] WHEN 'D' THEN ['0', 'O'] WHEN '1' THEN ['I'] WHEN 'I' THEN ['1'] WHEN '8' THEN ['B'] WHEN 'B' THEN ['8'] WHEN '5' THEN ['S'] WHEN 'S' THEN ['5'] WHEN '2' THEN ['Z'] WHEN 'Z' THEN ['2'] WHEN '6' THEN ['G'] WHEN 'G' THEN ['6'] ELSE [] END"

_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "lexicon_lookup": f"""WITH sp AS (SELECT {_KEY.format('p_type')} AS key, trim(p_type) AS c, count(*) AS n FROM part GROUP BY 1, 2), lex AS (SELECT key, c AS canonical FROM sp QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, c) = 1 AND sum(n) OVER (PARTITION BY key) >= 3),
v AS (SELECT value, {_KEY.format('value')} AS k FROM (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN p_type[1:4] || 'x' || p_type[5:24] WHEN 1 THEN p_type[1:3] WHEN 2 THEN lower(p_type) ELSE p_type END AS value FROM part) WHERE trim(value) <> ''),
same AS (SELECT value, canonical, CASE WHEN trim(value) = canonical THEN 'exact' ELSE 'surface' END AS kind FROM v JOIN lex ON k = key), rest AS (SELECT * FROM v WHERE value NOT IN (SELECT value FROM same) AND length(k) >= 3 AND NOT regexp_matches(k, '[0-9]')),
starts AS (SELECT value, min(canonical) AS canonical, 'prefix' AS kind FROM rest JOIN lex ON starts_with(key, k) GROUP BY value HAVING count(*) = 1),
short AS (SELECT value, min(canonical) AS canonical, 'abbreviation' AS kind FROM rest JOIN lex ON k[1:1] = key[1:1] AND length(k) < length(key) AND regexp_matches(key, array_to_string(string_split(k, ''), '.*')) GROUP BY value HAVING count(*) = 1),
guessed AS (SELECT * FROM starts UNION ALL SELECT * FROM short WHERE value NOT IN (SELECT value FROM starts)),
near AS (SELECT value, canonical, k, levenshtein(k, key) AS d, row_number() OVER w AS place, lead(levenshtein(k, key)) OVER w AS second FROM rest JOIN lex ON levenshtein(k, key) <= 2 WHERE value NOT IN (SELECT value FROM guessed) WINDOW w AS (PARTITION BY value ORDER BY levenshtein(k, key), canonical)),
found AS (SELECT * FROM same UNION ALL SELECT * FROM guessed UNION ALL SELECT value, canonical, 'edit' FROM near WHERE place = 1 AND d <= CASE WHEN length(k) <= 5 THEN 1 ELSE 2 END AND (second IS NULL OR second > d))
SELECT v.value, canonical, kind FROM v LEFT JOIN found USING (value)""",
    "provenance": f"WITH {TABLES} {_PROVENANCE}",
    "coverage_matrix": f"WITH {TABLES} {_COVERED}",
    "schema_discovery": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, least(20, count(DISTINCT {c})) AS n_samples, min({c}::varchar) AS first_sample FROM orders" for c, t in _COLUMNS),
    "narrow_question": f"""WITH {TABLES}, k AS (SELECT coalesce(r.key, i.key) AS key, r.key IS NOT NULL AS registered, registration_status AS s, i.expiry, date_diff('day', i.expiry, DATE '{TODAY}') AS lapsed FROM reg r FULL JOIN ins i USING (key)),
d AS (SELECT CASE WHEN NOT registered AND expiry IS NULL THEN 'UNKNOWN VEHICLE — NOT REGISTERED|MEDIUM' WHEN expiry IS NULL THEN 'UNINSURED — REPORT|HIGH' WHEN lapsed BETWEEN 1 AND 15 THEN 'UNINSURED — ADVISORY|MEDIUM' WHEN lapsed BETWEEN 16 AND 30 THEN 'UNINSURED — WARNING|HIGH' WHEN lapsed > 30 THEN 'UNINSURED — REPORT|HIGH' WHEN s <> 'ACTIVE' THEN 'REGISTRATION INVALID — REPORT|HIGH' ELSE 'CLEAR|MEDIUM' END AS d FROM k)
SELECT split_part(d, '|', 1) AS decision, split_part(d, '|', 2) AS confidence, '[REG, INS]' AS asked, count(*) AS n FROM d GROUP BY ALL""",
    "resolve_identity": f"""WITH v AS (SELECT c_custkey AS case_id, {_plate('c_custkey')} AS key, c_mktsegment AS make, {_colour('c_custkey')} AS colour FROM customer),
r AS (SELECT case_id, 'DL' || key[3:9] || CASE WHEN key[10:10] = '0' THEN 'O' ELSE key[10:10] END AS read, make AS om, colour AS oc FROM v WHERE case_id % 50 = 0),
t AS (SELECT r.*, unnest(list_concat([read], flatten(list_transform(range(1, length(read) + 1), lambda i: list_transform({_CONFUSED}, lambda o: read[1:i - 1] || o || read[i + 1:]))))[1:12]) AS key FROM r),
s AS (SELECT t.case_id, t.key, read, round((lower(om) = lower(make))::int * 0.5::double + (lower(oc) = lower(colour))::int * 0.3::double + (t.key = read)::int * 0.2::double, 3) AS score FROM t JOIN v USING (key)),
k AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, key <> read, key))
SELECT r.case_id, k.key AS resolved, coalesce(score, 0.0::double) AS score, CASE WHEN k.key IS NULL THEN 'NONE' WHEN (next IS NULL OR round(score - next, 3) >= 0.2) AND (k.key = r.read OR score >= 0.5) THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS outcome FROM r LEFT JOIN k ON k.case_id = r.case_id AND place = 1""",
    "source_lookup_left": f"WITH {TABLES} SELECT key, owner_name, owner_city, rto_code FROM reg",
    "canonical_key": f"SELECT c_custkey, {_norm('c_name')} AS key FROM customer",
    "ocr_fold_match": f"WITH {TABLES} SELECT capture_id, registration_no FROM captures LEFT JOIN vehicle ON translate(plate_id, 'OI', '01') = translate(registration_no, 'OI', '01')",
    "render_key": f"WITH {TABLES} SELECT registration_id, k[1:2] || '-' || k[3:4] || '-' || k[5:6] || '-' || k[7:] AS dashed, lower(k[1:2] || ' ' || k[3:4] || ' ' || k[5:6] || ' ' || k[7:]) AS spaced FROM (SELECT registration_id, registration_no AS k FROM vehicle)",
    "variants_in_list": f"""WITH RECURSIVE {TABLES}, o AS (SELECT registration_no, replace(registration_no, '0', 'O') AS k FROM vehicle), m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{c}', {i})" for k, v in {"0": "OD", "O": "0D", "D": "0O", "1": "I", "I": "1", "8": "B", "B": "8", "5": "S", "S": "5", "2": "Z", "Z": "2", "6": "G", "G": "6"}.items() for i, c in enumerate(v))}) t(a, b, o)),
 g AS (SELECT registration_no, k, 0 AS last, []::bigint[] AS path FROM o UNION ALL SELECT registration_no, k[1:i-1] || b || k[i+1:], i, list_append(path, i * 10 + m.o) FROM g, unnest(range(1, 11)) r(i), m WHERE i > last AND k[i:i] = a AND len(path) < 3),
 f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY registration_no ORDER BY len(path), path) <= 64) SELECT registration_no, count(*) AS n, min(k) AS least, max(k) AS most FROM f GROUP BY 1""",
    "latest_wins": f"WITH {TABLES} SELECT key, start::varchar AS insurance_start, expiry::varchar AS insurance_expiry, policy_type, premium_inr FROM ins",
    "mediated_profile": _profile() + "SELECT key, owner_name, vehicle_make, registration_status, insurance_expiry::varchar AS insurance_expiry, case_status, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen, location AS last_seen_location, observed_colour FROM p",
    "derived_status": _profile() + "SELECT insurance_status, stolen_status, count(*) AS n FROM p GROUP BY 1, 2",
    "conflicts": _profile() + "SELECT key, attribute, official, observed FROM (SELECT key, unnest(['vehicle_make', 'vehicle_model', 'vehicle_colour']) AS attribute, unnest([vehicle_make, vehicle_model, vehicle_colour]) AS official, unnest([observed_make, observed_model, observed_colour]) AS observed, unnest([m1, m2, m3]) AS m FROM p) WHERE m = 1",
    "decision": _profile() + "SELECT key, decision, confidence, n_reasons FROM p",
    "decision_source_down": _profile(reg="TIMEOUT") + "SELECT decision, confidence, count(*) AS n FROM p GROUP BY 1, 2",
    "decision_theft_down": _profile(theft="DOWN") + "SELECT decision, confidence, stolen_status, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "lapse_ladder": _profile() + "SELECT key, decision, lapsed AS days FROM p WHERE decision LIKE 'UNINSURED%'",
    "risk_score": _profile() + "SELECT key, risk, risk_level, n_factors FROM final",
    "risk_levels": _profile() + "SELECT risk_level, count(*) AS n, sum(risk) AS points FROM final GROUP BY 1",
    "watchlist_alerts": _profile() + "SELECT key, 'WATCHLIST' AS kind FROM p WHERE key IN (SELECT registration_no FROM vehicle WHERE registration_id % 9 = 0) UNION ALL SELECT key, 'HOTLIST' FROM p WHERE decision LIKE 'STOLEN%' OR decision LIKE 'SCRAPPED%' OR decision LIKE 'SHREDDED%'",
    "universe": f"WITH {TABLES}, u AS (SELECT registration_no AS key, 'VEHICLE' AS s FROM vehicle UNION ALL SELECT key, 'POLICY' FROM policy UNION ALL SELECT key, 'CRIME' FROM crime UNION ALL SELECT plate_id, 'CAPTURES' FROM captures) SELECT key, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, count(*) FILTER (s = 'CAPTURES') AS sightings FROM u GROUP BY 1",
    "majority_value": f"WITH {TABLES}, n AS (SELECT plate_id, observed_colour, count(*) AS n, sum(count(*)) OVER (PARTITION BY plate_id) AS total FROM captures GROUP BY 1, 2) SELECT * FROM n WHERE n * 2 > total",
    "upsert_latest": "WITH r AS (SELECT o_custkey AS k, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) = 1) SELECT * FROM r",
    "write_overlay": f"WITH {TABLES}, v AS (SELECT owner_id, CASE WHEN colour = 'Red' THEN 'CANC' WHEN status = 'ACTIVE' THEN 'ACT' ELSE 'SUSP' END AS reg_status FROM vehicle WHERE owner_id >= 5) SELECT lower(n_name) AS full_name, reg_status, count(*) AS n FROM v JOIN nation ON owner_id = n_nationkey GROUP BY 1, 2",
    "patch_and_undo": f"WITH {TABLES} SELECT registration_id, CASE WHEN registration_id % 5 = 0 THEN 'Green' ELSE colour END AS patched, make, colour AS undone FROM vehicle",
    "value_transforms": f"""WITH c AS (SELECT *, c_custkey AS k FROM customer) SELECT c_custkey, {_title("lower(c_mktsegment) || '-o''neil 3rd'")} AS title, CASE k % 3 WHEN 0 THEN 'Hyundai' WHEN 1 THEN 'Maruti Suzuki' ELSE 'Tesla X' END AS make, CASE k % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SUSPENDED' WHEN 2 THEN 'CANCELLED' ELSE 'OTHER' END AS status,
CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS flag, (CASE WHEN k % 5 <> 0 THEN (DATE '1970-01-01' + (k * 86399 // 86400)::int)::date END)::varchar AS day, c_name[1:2] || repeat('*', length(c_name) - 4) || c_name[-2:] AS masked FROM c""",
    "parse_timestamps": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment, CASE event_id % 5 WHEN 0 THEN '%d/%m/%Y %H:%M:%S' WHEN 1 THEN '%d-%m-%Y %H:%M' WHEN 2 THEN 'iso' WHEN 3 THEN 'epoch' END AS format FROM events""",
    "shape_pattern": f"WITH {TABLES} SELECT 'LLDDLLDDDD' AS shape, CASE WHEN registration_id % 6 = 0 THEN '+^+^' ELSE 'S^+^' END AS pattern, count(*) AS n FROM vehicle GROUP BY 1, 2",
    "extract_key": "SELECT page_id, CASE WHEN length(k) >= 4 THEN upper(k) END AS key FROM (SELECT page_id, left(regexp_replace(url, '[^a-z]', '', 'g'), 9) AS k FROM pages)",
    "edit_similarity": NAMES + " SELECT a, b, levenshtein(upper(a), upper(b)) AS distance, round(1 - levenshtein(upper(a), upper(b)) / greatest(length(a), length(b))::double, 6) AS similarity FROM pairs",
    "qgram_similarity": NAMES + f", g AS (SELECT a, b, {_grams('a')} AS x, {_grams('b')} AS y FROM pairs) SELECT a, b, len(list_intersect(x, y)) AS common, round(len(list_intersect(x, y)) / least(len(x), len(y))::double, 6) AS overlap, round(len(list_intersect(x, y)) / len(list_distinct(x || y))::double, 6) AS jaccard FROM g",
    "soundex_reference": NAMES + f" SELECT a, b, {_soundex('a')} AS code_a, ({_soundex('a')} = {_soundex('b')})::int::double AS same FROM pairs",
    "tfidf": """WITH d AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), f AS (SELECT w, ln((SELECT count(*) FROM part)::double / count(*)) AS idf FROM d GROUP BY 1), x AS (SELECT p_partkey, w, idf FROM d JOIN f USING (w)), n AS (SELECT p_partkey, sqrt(sum(idf * idf)) AS norm FROM x GROUP BY 1),
dots AS (SELECT a.p_partkey AS q, b.p_partkey, sum(a.idf * b.idf) AS dot FROM x a JOIN x b USING (w) WHERE a.p_partkey % 50 = 0 GROUP BY ALL) SELECT q, dots.p_partkey, round(dot / (n.norm * m.norm), 4) AS cosine FROM dots JOIN n USING (p_partkey) JOIN n m ON m.p_partkey = q""",
    "block_index": BLOCKS + " SELECT read, key, shared FROM c WHERE shared >= 8",
    "block_size": WITHIN, "block_prefix": WITHIN, "block_position": WITHIN,
    "blocking_quality": BLOCKS + f", w AS ({WITHIN_ONLY}) SELECT round((SELECT avg((w.key IS NOT NULL)::int) FROM (SELECT DISTINCT read, truth FROM reads) r LEFT JOIN w ON w.read = r.read AND w.key = r.truth), 6) AS recall, round((SELECT count(*) FROM w)::double / (SELECT count(DISTINCT read) FROM reads), 6) AS mean_candidates",
    "block_none": BLOCKS + " SELECT r.read, v.key, coalesce(shared, 0) AS shared FROM (SELECT DISTINCT read FROM reads) r CROSS JOIN (SELECT DISTINCT key FROM v) v LEFT JOIN c ON c.read = r.read AND c.key = v.key",
    "recommended_overlap": BLOCKS + " SELECT read, greatest(1, coalesce(min(ny), min(nx)) - 4) AS k FROM rn LEFT JOIN (SELECT DISTINCT ny FROM kn) s ON abs(nx - ny) <= 4 GROUP BY read",
    "symspell_two": NOISY + """, sides AS (SELECT 'r' AS side, read AS t FROM reads UNION SELECT 'k', key FROM v), one AS (SELECT side, t, t AS d FROM sides UNION SELECT side, t, t[1:i-1] || t[i+1:] FROM sides, unnest(range(1, 11)) u(i)), two AS (SELECT side, t, d FROM one UNION SELECT side, t, d[1:i-1] || d[i+1:] FROM one, unnest(range(1, 11)) u(i) WHERE i <= length(d))
 SELECT DISTINCT a.t AS read, b.t AS key FROM two a JOIN two b USING (d) WHERE a.side = 'r' AND b.side = 'k'""",
    "valid_plates": f"""WITH {TABLES}, p AS (SELECT capture_id, CASE capture_id % 3 WHEN 0 THEN 'XX' || plate_id[3:] WHEN 1 THEN '21BH' || plate_id[7:10] || 'AA' ELSE plate_id END AS p FROM captures),
 s AS (SELECT capture_id, CASE WHEN regexp_full_match(p, '[A-Z]{{2}}[0-9]{{2}}[A-Z]{{1,3}}[0-9]{{4}}') AND p[1:2] = 'DL' THEN 'SDD' || repeat('L', length(p) - 8) || 'DDDD' WHEN regexp_full_match(p, '[0-9]{{2}}BH[0-9]{{4}}[A-Z]{{1,2}}') THEN 'DDBHDDDD' || repeat('L', length(p) - 8) END AS shape FROM p) SELECT capture_id, shape IS NOT NULL AS valid, shape FROM s""",
    "value_shares": f"WITH {TABLES}, u AS (SELECT unnest(['make', 'model', 'colour']) AS attribute, lower(unnest([make, model, colour])) AS value FROM vehicle), n AS (SELECT attribute, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2) SELECT attribute, value, round(n / sum(n) OVER (PARTITION BY attribute), 6) AS share FROM n",
    "case_life": """WITH e AS (SELECT user_id AS case_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'CANDIDATE' WHEN 'view' THEN 'ISSUED' WHEN 'click' THEN 'HOLD' WHEN 'purchase' THEN 'UPHELD' ELSE 'CANCELLED' END AS ev FROM events), l AS (SELECT case_id, list_prepend('', list(ev ORDER BY seq)) AS evs FROM e GROUP BY 1)
 SELECT case_id, nullif(list_reduce(evs, lambda s, e: CASE WHEN e IN ('CANDIDATE', 'ISSUED', 'HOLD') THEN e WHEN s IN ('ISSUED', 'UPHELD') THEN e ELSE s END), '') AS status FROM l""",
    "symspell": NOISY + ", a AS (SELECT DISTINCT read, unnest(list_append(list_transform(range(1, length(read) + 1), lambda i: read[1:i-1] || read[i+1:]), read)) AS d FROM reads), b AS (SELECT DISTINCT key, unnest(list_append(list_transform(range(1, length(key) + 1), lambda i: key[1:i-1] || key[i+1:]), key)) AS d FROM v) SELECT DISTINCT read, key FROM a JOIN b USING (d)",
    "lexicon_mine": "WITH t AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN lower(p_type) ELSE p_type END AS t FROM part), n AS (SELECT regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS key, t AS canonical, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, canonical) AS seen_at, sum(n) OVER (PARTITION BY key) AS support FROM n) SELECT key, canonical, support FROM r WHERE seen_at = 1 AND support >= 3",
    "rdr_infer": CASES + " SELECT case_id, rule, action, value AS set_to FROM inferred",
    "cleansing_proposals": CASES + " SELECT field, rule, action, count(*) AS n FROM (SELECT field, rule, CASE WHEN action = 'set' AND value IS NULL THEN 'quarantine' ELSE action END AS action FROM inferred) GROUP BY 1, 2, 3",
    "duplicates": f"WITH {TABLES}, b AS (SELECT capture_id, plate_id, camera_id, seen_at FROM captures UNION ALL SELECT capture_id + 1000000, plate_id, camera_id, seen_at FROM captures WHERE capture_id % 20 = 0), m AS (SELECT capture_id, min(capture_id) OVER (PARTITION BY plate_id, camera_id, seen_at) AS duplicate_of FROM b) SELECT * FROM m WHERE duplicate_of < capture_id",
    "travel_legs": f"""WITH {TABLES}, s AS (SELECT *, 28 + camera_id * 0.35::double AS lat, 77 + camera_id * 0.25::double AS lon FROM captures), l AS (SELECT *, lag(capture_id) OVER w AS from_id, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(seen_at) OVER w AS at0 FROM s WINDOW w AS (PARTITION BY plate_id ORDER BY seen_at, capture_id)),
k AS (SELECT capture_id, from_id, 2 * 6371.0088::double * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))) AS km, date_diff('second', at0, seen_at) / 60.0::double AS minutes FROM l WHERE from_id IS NOT NULL)
SELECT capture_id, from_id, round(km, 4) AS km, round(minutes, 4) AS minutes, coalesce(km / ((minutes + 10) / 60) > 160, false) AS impossible FROM k""",
    "anomaly_rollup": DETECTED + " SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM a) GROUP BY 1",
    "dispositions": DETECTED + ", b AS (SELECT len(codes) AS x, len(list_filter(codes, lambda c: c <> 'TIMESTAMP_NONSTANDARD')) AS y FROM a) SELECT CASE WHEN x = 0 THEN 'CLEAN' WHEN y = 0 THEN 'REPAIRED' WHEN y < x THEN 'PARTIAL' ELSE 'OPEN' END AS disposition, count(*) AS n FROM b GROUP BY 1",
    "active_resolutions": "SELECT user_id AS record_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes, arg_max(event_type, event_id) AS decision FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "prior_count": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS prior FROM orders GROUP BY 1",
    "repeat_running": "SELECT o_orderkey, coalesce(sum((o_orderstatus = 'F')::int) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders",
    "log_topn": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "audit_union": "SELECT log, id FROM (SELECT 'EVENT' AS log, event_id AS id, ts AS seen_at FROM events WHERE event_type = 'error' UNION ALL SELECT 'ORDER', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P') ORDER BY seen_at DESC, log, id LIMIT 100",
    "diff_rows": "SELECT c_custkey, field, before, after FROM (SELECT c_custkey, 'seg' AS field, c_mktsegment AS before, CASE WHEN c_custkey % 100 = 0 THEN NULL WHEN c_custkey % 30 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS after FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::varchar, CASE WHEN c_custkey % 100 <> 0 THEN c_nationkey::varchar END FROM customer) WHERE before IS DISTINCT FROM after",
    "sql_console": "SELECT r_name, count(*) AS n, 'drop; --' AS note FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "eval_metrics": SCORED + ", c AS (SELECT count(*) FILTER (guess = 1 AND quality = 1) AS tp, count(*) FILTER (guess = 1 AND quality <> 1) AS fp, count(*) FILTER (guess <> 1 AND quality = 1) AS fn FROM s) SELECT *, round(tp / (tp + fp)::double, 6) AS precision, round(tp / (tp + fn)::double, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1 FROM c",
    "ranking_metrics": "WITH r AS (SELECT CASE WHEN doc_id % 6 <> 0 THEN doc_id % 6 END AS r FROM labels) SELECT round(avg(coalesce((r = 1)::int, 0)), 6) AS top1, round(avg(coalesce((r <= 5)::int, 0)), 6) AS top5, round(avg(coalesce(1 / r::double, 0)), 6) AS mrr FROM r",
    "ece": SCORED + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(quality) AS q FROM s GROUP BY 1) SELECT round(sum(n * abs(m - q)) / sum(n), 6) AS ece FROM b",
    "mcnemar": SCORED + ", c AS (SELECT count(*) FILTER (guess = 0 AND quality = 1) AS b01, count(*) FILTER (guess = 1 AND quality = 0) AS b10 FROM s) SELECT b01, b10, round(least(1.0::double, 2 * list_sum(list_transform(range(0, least(b01, b10) + 1), lambda i: exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2))))), 6) AS p_value FROM c",
    "precision_threshold": SCORED + ", b AS (SELECT p, count(*) AS n, sum(quality) AS g FROM s GROUP BY 1), r AS (SELECT p, sum(g) OVER w / sum(n) OVER w AS pr FROM b WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT round(min(p), 6) AS threshold FROM r WHERE pr >= 0.85",
    "bucket_pivot": "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1",
    "confusion_counts": ALL_NOISY + ", z AS (SELECT read[i:i] AS x, truth[i:i] AS y FROM (SELECT read, truth, unnest(range(1, 11)) AS i FROM reads)) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM z WHERE x <> y GROUP BY 1, 2",
    "learned_cost": ALL_NOISY + ", z AS (SELECT read[i:i] AS x, truth[i:i] AS y FROM (SELECT read, truth, unnest(range(1, 11)) AS i FROM reads)), c AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM z WHERE x <> y GROUP BY 1, 2) SELECT a, b, round(greatest(0.1::double, 1 - ln(1 + n) / ln(1 + max(n) OVER ())), 6) AS cost FROM c",
    "stratified_sample": "WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (w ORDER BY o_orderkey) AS turn, min(o_orderkey) OVER w AS class_first FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority)) SELECT * FROM r ORDER BY turn, class_first LIMIT 40",
    "hash_split": f"WITH {TABLES}, b AS (SELECT ('0x' || md5(registration_no)[1:4])::int % 100 AS b FROM vehicle) SELECT CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM b GROUP BY 1",
    "percentiles": "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events",
    "mode_per_group": "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r = 1",
    "dominant_format": f"WITH {TABLES} SELECT CASE WHEN capture_id % 3 = 0 THEN '%d/%m/%Y %H:%M' ELSE 'iso' END AS format, count(*) AS n FROM captures GROUP BY 1 ORDER BY n DESC, format LIMIT 1",
    "operator_tally": "SELECT o_orderpriority AS actor, count(*) AS records, count(*) FILTER (o_orderstatus = 'F') AS holding FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1",
    "key_shapes": f"WITH {TABLES}, s AS (SELECT regexp_replace(regexp_replace(plate_id, '[A-Za-z]', 'L', 'g'), '[0-9]', 'D', 'g') AS shape, count(*) AS support FROM captures GROUP BY 1) SELECT *, support >= 2 AS plausible FROM s",
    "pages_by_host": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, max(page_id) AS last FROM pages GROUP BY 1",
    "report_story": _profile() + "SELECT key, 'Vehicle: ' || key || chr(10) || 'Decision: ' || decision || chr(10) || 'Case: ' || coalesce(case_status, 'not checked') || chr(10) || 'Last seen: ' || coalesce(location, 'not checked') AS story FROM p WHERE decision LIKE 'STOLEN%' OR decision LIKE 'SCRAPPED%'",
    "disputes_union": f"WITH {TABLES}, x AS (SELECT registration_no, colour = 'Red' AS r, registration_id % 4 = 0 AS f FROM vehicle) SELECT registration_no, CASE WHEN r AND f THEN 'both' WHEN r THEN 'red' ELSE 'few' END AS part FROM x WHERE r OR f",
}
