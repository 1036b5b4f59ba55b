"""URLs judged by rules of hosts and paths, and by two character language models where no rule fits.

Accepted and rejected URLs, those that rules decide, each train a Markov model of variable order: a character's probability after
up to ``order`` characters is mixed, by Witten and Bell, with that after one character less, and a context that was never
seen leaves it as it is. A URL's score is the mean, over its characters, of the logarithm of the two models' ratio. It's allowed at
or above a threshold that parts accepted from rejected URLs best which the models haven't seen.

The models are tables of character n-grams that grow with the corpus and are never brought to one place: contexts,
back-off and scores are joins and sums. No n-gram of a level has more neighbours in these joins than there are characters; n-grams
that very many URLs have are looked up in a table of bounded size (common.looked_up).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored

#: Host and path, as one string, and the verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ORDER = 5
#: Characters that the shortest context takes to be equally likely before any is seen.
ALPHABET = 128
#: First hexadecimal digits of a URL's md5 that keep it out of training, for the threshold.
HELD_OUT = "0123"
#: Weights are whole millionths of a nat, so that sums don't depend on their order; thresholds are thousandths.
UNIT, BINS = 1_000_000, 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What stands after the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is this one or a domain above it, and whose path this path starts with; null if none is."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(order: int, by_url: bool):
    """The n-gram that ends at each character, with up to ``order`` before it: by URL, or counted for each of the models (labels True and False, else neither)."""
    names = ["id", "gram", "n"] if by_url else ["gram", "accepted", "rejected"]
    kinds = [pa.int64(), pa.string(), pa.int64()] if by_url else [pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 3, kinds)], names=names)

    def run(batches):
        counted: dict = {None: Counter(), True: Counter(), False: Counter()}
        rows: list[tuple] = []
        for b in batches:
            for i, text, label in zip(*(c.to_pylist() for c in b.columns)):
                found = [text[max(0, k - order) : k + 1] for k in range(len(text))]
                if by_url:
                    rows += [(i, g, n) for g, n in Counter(found).items()]
                else:
                    counted[label].update(found)
                if len(rows) > 1 << 16:
                    yield batch(rows)
                    rows = []
                elif sum(map(len, counted.values())) > 1 << 18:
                    yield from (batch([(g, n if x else 0, n if x is False else 0) for g, n in c.items()]) for x, c in counted.items())
                    counted = {x: Counter() for x in counted}
        yield batch(rows)
        if not by_url:
            yield from (batch([(g, n if x else 0, n if x is False else 0) for g, n in c.items()]) for x, c in counted.items())

    return run


def weights(grams: DataFrame, order: int) -> DataFrame:
    """(gram, weight) of every n-gram of grams (gram, accepted, rejected): the logarithm of the models' ratio at its last character, in UNITs."""
    models = ("accepted", "rejected")
    grams = stored(grams.groupBy("gram").agg(*(F.sum(m).alias(m) for m in models)))
    levels, above = [], None
    for k in range(order, -1, -1):
        own = grams.filter(F.char_length("gram") == k + 1)
        if above is not None:
            own = own.unionByName(above.withColumn("gram", F.expr("substring(gram, 2)"))).groupBy("gram").agg(*(F.sum(m).alias(m) for m in models))
        above = stored(own)
        levels.append(above)
    known, out = None, None
    for k, level in enumerate(reversed(levels)):
        before = F.expr(f"left(gram, {k})")
        seen = level.groupBy(before.alias("before")).agg(*(f(m).alias(f"{m}_{c}") for m in models for c, f in (("n", F.sum), ("kinds", lambda m: F.count_if(F.col(m) > 0)))))
        level = level.join(seen.withColumnRenamed("before", "_before"), before == F.col("_before"))
        shorter = {m: F.lit(1.0 / ALPHABET) for m in models}
        if known is not None:
            level = level.join(known.select(F.col("gram").alias("_shorter"), *(F.col(f"p_{m}").alias(f"q_{m}") for m in models)), F.expr("substring(gram, 2)") == F.col("_shorter"))
            shorter = {m: F.col(f"q_{m}") for m in models}
        mixed = lambda m: (F.col(m) + F.col(f"{m}_kinds") * shorter[m]) / (F.col(f"{m}_n") + F.col(f"{m}_kinds"))
        known = stored(level.select("gram", *(F.when(F.col(f"{m}_n") > 0, mixed(m)).otherwise(shorter[m]).alias(f"p_{m}") for m in models)))
        out = known if out is None else out.unionByName(known)
    return out.select("gram", F.round(UNIT * (F.ln("p_accepted") - F.ln("p_rejected"))).cast("long").alias("weight"))


def threshold(scored: DataFrame) -> float:
    """The threshold for which the shares of accepted URLs (label true) at or above it and of rejected ones below it have the largest sum.

    Of equal ones that nearest to 0 is taken, then the smaller; 0 if there are none of either. Scores are taken in thousandths, within
    20 of 0, so what is ordered in one task is at most 40,001 rows.
    """
    binned = scored.groupBy(F.greatest(F.lit(-20 * BINS), F.least(F.lit(20 * BINS), F.floor(F.col("score") * BINS))).alias("bin"))
    binned = binned.agg(F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad"))
    binned.createOrReplaceTempView(view := f"bins_{id(binned)}")
    best = binned.sparkSession.sql(f"""WITH r AS (SELECT bin, sum(good) OVER (ORDER BY bin DESC) AS right, coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
        sum(good) OVER () AS good, sum(bad) OVER () AS bad FROM {view}) SELECT bin FROM r WHERE good > 0 AND bad > 0 ORDER BY right * bad + under * good DESC, abs(bin), bin LIMIT 1""").first()
    binned.sparkSession.catalog.dropTempView(view)
    return best[0] / BINS if best else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None, order: int = ORDER) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict (allow or block) and score (null where a rule decides).

    ``rules`` are a short list, host and path, and what they say; a rule fits its host and all subdomains where the path starts with its own,
    and the longest wins. All URLs that rules decide, each once however many rows have it, train the models or set the threshold.
    Null URLs and such without :// have neither host nor path; their characters are judged all the same. An empty or null URL,
    and every URL that no rule decides if one of the models has nothing to learn from, is allowed with score 0. No table, no rows.
    What other columns pages has makes no difference.
    """
    rules = RULES if rules is None else rules
    url = F.col(f"`{url_col}`")
    says = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else None
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", says[F.col("rule")] if rules else F.lit(None).cast("string"))

    urls = rows.groupBy("url").agg(F.first("host").alias("host"), F.first("said").alias("said"))
    text = F.concat("host", F.expr("substring(url, instr(url, '://') + 3 + char_length(host))"))
    urls = urls.withColumn("text", F.coalesce(F.when(F.contains("url", F.lit("://")), text).otherwise(F.col("url")), F.lit("")))
    held = F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    urls = urls.select(F.monotonically_increasing_id().alias("id"), "url", "text", (F.col("said") == "allow").alias("label"), F.coalesce(held, F.lit(True)).alias("held"))
    urls = stored(urls)
    taught = urls.filter("not held").agg(F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad")).first()
    judged = urls.filter("label is null or held")
    learned = F.when(F.col("held"), F.lit(None)).otherwise(F.col("label"))
    model = stored(weights(urls.select("id", "text", learned.alias("label")).mapInArrow(_grams(order, False), "gram string, accepted long, rejected long"), order))
    places = stored(judged.select("id", "text", "label").mapInArrow(_grams(order, True), "id long, gram string, n long"))
    score = looked_up(places, "gram", model).groupBy("id").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n") / UNIT).alias("score"))
    scored = stored(judged.select("id", "url", "label").join(score, "id"))
    least = threshold(scored.filter("label is not null")) if taught["good"] and taught["bad"] else None

    open_ = scored.filter("label is null").select("url", "score")
    if least is None:
        open_ = open_.filter("false")
    none = F.when(F.col("said").isNull(), F.coalesce("score", F.lit(0.0)))
    allowed = F.coalesce(F.col("score") >= F.lit(least or 0.0), F.lit(True))
    verdict = F.coalesce("said", F.when(allowed, F.lit("allow")).otherwise(F.lit("block")))
    found = looked_up(rows.withColumn("open", F.when(F.col("said").isNull(), F.col("url"))), "open", open_.withColumnRenamed("url", "open"))
    return found.select("id", "host", "path", "rule", verdict.alias("verdict"), F.round(none, 6).alias("score"))
