"""The registered queries of this package: each applies its operator to its whole table and keeps to its result's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, curriculum, divergence, importance, language_id, license_scan, packing, passages, quality_rules, simhash, syncmers, url_filter
from .common import kept, table


def op1_language_id(spark, sf_dir):
    """Profiles are learned from documents whose crc32 of the id, modulo 5, isn't 0; every document is identified."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    learned = kept(language_id.profiles(docs.filter((fold != 0) & F.col("lang").isNotNull()), "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), learned, ["doc_id"])
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_suffix_array_dedup(spark, sf_dir):
    found = passages.repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op3_substring_dedup(spark, sf_dir):
    found = passages.repeated_words(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op4_quality_rules(spark, sf_dir):
    """Limits are fitted to all labelled rows; every document is judged."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.compression_bands(docs, bands=quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_best_fit_packing(spark, sf_dir):
    placed = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark, sf_dir):
    mixed = curriculum.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("int"))


def op12_url_filter(spark, sf_dir):
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_array_dedup, op3_substring_dedup, op4_quality_rules, op5_syncmer_fingerprints, op6_simhash_near_dedup, op7_best_fit_packing, op8_importance_resampling, op9_source_mixing, op10_license_scan, op11_source_divergence, op12_url_filter, op13_phrase_collocations)}

_WORDS = "[^\\x20\\x09-\\x0D]+"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
_ORDER = "ORDER BY 3 * source_size / weight, weight, source NULLS LAST"

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    """The rules, and the models level by level: contexts, back-off, and the mean weight of a URL."""
    order, unit, bins = url_filter.ORDER, url_filter.UNIT, url_filter.BINS
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_filter.RULES.items())
    parts = url_filter._PARTS
    out = f"""WITH rules(rule, h, p, said) AS (VALUES {rules}),
r AS MATERIALIZED (SELECT page_id, url, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), {_LOW}) AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
s AS MATERIALIZED (SELECT r.*, (SELECT max_by(struct_pack(rule := rule, said := said), len(rule)) FROM rules WHERE (r.host = h OR ends_with(r.host, '.' || h)) AND starts_with(r.path, p)) AS fit FROM r),
u AS MATERIALIZED (SELECT DISTINCT url, coalesce(CASE WHEN contains(url, '://') THEN host || substring(url, instr(url, '://') + 3 + length(host)) ELSE url END, '') AS text, fit.said = 'allow' AS label, coalesce(md5(url)[1] IN ('0', '1', '2', '3'), true) AS held FROM s),
places AS MATERIALIZED (SELECT url, label, held, substring(text, greatest(1, i - {order}), least(i, {order + 1})) AS gram FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM u)),
g AS MATERIALIZED (SELECT gram, count(*) FILTER (label AND NOT held) AS a, count(*) FILTER (NOT label AND NOT held) AS b FROM places GROUP BY 1)"""
    for k in range(order, -1, -1):
        more = "" if k == order else f" UNION ALL SELECT substring(gram, 2), a, b FROM l{k + 1}"
        out += f",\nl{k} AS MATERIALIZED (SELECT gram, sum(a) AS a, sum(b) AS b FROM (SELECT * FROM g WHERE length(gram) = {k + 1}{more}) GROUP BY 1)"
    for k in range(order + 1):
        q = [f"1.0::double / {url_filter.ALPHABET}"] * 2 if not k else ["q.pa", "q.pb"]
        mixed = ", ".join(f"CASE WHEN n{m} > 0 THEN ({m} + k{m} * {s}) / (n{m} + k{m}) ELSE {s} END AS p{m}" for m, s in zip("ab", q))
        out += f""",\np{k} AS MATERIALIZED (SELECT l.gram, {mixed} FROM l{k} l JOIN (SELECT left(gram, {k}) AS before, sum(a)::double AS na, count(*) FILTER (a > 0) AS ka, sum(b)::double AS nb, count(*) FILTER (b > 0) AS kb FROM l{k} GROUP BY 1) c ON left(l.gram, {k}) = c.before{f" JOIN p{k - 1} q ON substring(l.gram, 2) = q.gram" if k else ""})"""
    union = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(order + 1))
    return f"""{out},
w AS MATERIALIZED (SELECT gram, round({unit} * (ln(pa) - ln(pb)))::bigint AS weight FROM ({union})),
score AS MATERIALIZED (SELECT url, label, sum(weight)::double / count(*)::double / {unit} AS score FROM places JOIN w USING (gram) WHERE label IS NULL OR held GROUP BY 1, 2),
bins AS MATERIALIZED (SELECT greatest({-20 * bins}, least({20 * bins}, floor(score * {bins})))::bigint AS bin, count(*) FILTER (label) AS good, count(*) FILTER (NOT label) AS bad FROM score WHERE label IS NOT NULL GROUP BY 1),
run AS (SELECT bin, sum(good) OVER (ORDER BY bin DESC) AS above, coalesce(sum(bad) OVER (ORDER BY bin {_BEFORE}), 0) AS under, sum(good) OVER () AS good, sum(bad) OVER () AS bad FROM bins),
t AS MATERIALIZED (SELECT coalesce((SELECT bin FROM run WHERE good > 0 AND bad > 0 ORDER BY above * bad + under * good DESC, abs(bin), bin LIMIT 1), 0) / {bins}::double AS least, (SELECT count(*) > 0 FROM u WHERE label AND NOT held) AND (SELECT count(*) > 0 FROM u WHERE NOT label AND NOT held) AS taught)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.said, CASE WHEN NOT taught OR coalesce(score, 0) >= CASE WHEN score IS NULL THEN 0 ELSE least END THEN 'allow' ELSE 'block' END) AS verdict,
CASE WHEN fit.said IS NULL THEN round(CASE WHEN taught THEN coalesce(score, 0.0::double) ELSE 0.0::double END, 6) END AS score FROM s CROSS JOIN t LEFT JOIN score ON score.url = s.url AND score.label IS NULL"""


_TERMS = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_RANKED = "(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::integer AS rank"
_PHRASES = " UNION ALL ".join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i+{m - 1}], ' '))) AS phrase FROM p" for m in range(1, 5))

#: What SQL can express; the others are held against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op9_source_mixing": f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[place] AS weight, ([1.5::double, 1.0::double, 0.5::double])[place] AS a, ([0.5::double, 1.0::double, 1.5::double])[place] AS b FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER ({_ORDER} {_BEFORE}), 0))::double / (sum(weight) OVER () - coalesce(sum(weight) OVER ({_ORDER} {_BEFORE}), 0))::double AS level FROM w),
t AS (SELECT *, least((3 * source_size)::double, max(level) OVER () * weight) AS target FROM l),
g AS (SELECT *, round(target)::bigint AS goal, round(target)::bigint // greatest(source_size, 1) AS passes FROM t),
o AS (SELECT d.doc_id, d.size, g.* EXCLUDE (source), coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::varchar), d.doc_id {_BEFORE}), 0)::bigint AS ahead FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (a + b) / 2 * least((ahead + size / 2) / greatest(goal, 1), 1.0::double) AS area, (b - a) / 2 AS bend FROM o)
SELECT doc_id, size, source_size, target, passes * size + greatest(0, least(size, goal - passes * source_size - ahead)) AS taken,
round(CASE WHEN area <= 0 THEN 0.0::double ELSE least(1.0::double, 2 * area / (a + sqrt(greatest(a * a + 4 * bend * area, 0.0::double)))) END, 6) AS first_position FROM p""",
    "op10_license_scan": f"""WITH t(license, body) AS (VALUES {_TEMPLATES}),
tw AS (SELECT license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM t), ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM tw),
n AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY 1), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM dw),
f AS (SELECT doc_id, license, count(*) AS n_found FROM ds JOIN ts USING (s) GROUP BY 1, 2) SELECT doc_id, license, n_found / n_shingles AS containment, n_found, n_shingles FROM f JOIN n USING (license) WHERE n_found / n_shingles >= 0.8""",
    "op11_source_divergence": f"""WITH r AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, {_LOW}), '{_TERMS}')) AS term FROM r),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT a.lang, a.source, coalesce(v.v, 0)::hugeint AS v, coalesce(v.n, 0)::hugeint AS nl, coalesce(s.n, 0)::hugeint AS n FROM (SELECT DISTINCT lang, source FROM r) a LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p, 1 + 1000000000::hugeint * (k.n + 1) // (g.nl + g.v) AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, {_RANKED} FROM f QUALIFY part = 'pair' OR rank <= 200""",
    "op12_url_filter": _url_sql(),
    "op13_phrase_collocations": f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOW}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS n FROM ({_PHRASES}) GROUP BY ALL),
n AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 30),
o AS (SELECT lang, phrase, max(n) AS over FROM (SELECT lang, n, unnest(list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase FROM c, (VALUES (2), (3)) t(k) WHERE k < m) GROUP BY ALL),
x AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN o USING (lang, phrase) WHERE coalesce(100::hugeint * over < 80::hugeint * n, true)),
y AS MATERIALIZED (SELECT x.lang, x.phrase, x.n AS a, x.k, array_to_string(x.w[x.k+1:], ' ') AS rest, f.n AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = array_to_string(x.w[1:x.k], ' ')),
s AS MATERIALIZED (SELECT y.*, f.n AS r, 2000000::hugeint * a // (l + f.n) AS score FROM y JOIN f ON f.lang = y.lang AND f.phrase = y.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n::bigint AS n, score::bigint AS score FROM b JOIN n USING (lang) QUALIFY rank <= 2000""",
}
