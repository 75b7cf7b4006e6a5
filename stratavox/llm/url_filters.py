"""URL filters: explicit host and path rules, then association rules that FP-growth mines from labelled URLs.

A URL's tokens are its host, its domain (last two labels), the labels before the domain, the words of its path that aren't mere numbers, its
query keys and whether it has a fragment; all of them count, in mining and in matching. FP-growth runs over the token sets of labelled URLs with
one more item for a bad label. Before that, tokens under the support go, and of tokens that always stand together the least stands for all, which loses no
rule: what holds of one holds of the others. A rule "tokens -> bad" stays if its support and confidence reach the limits, if its confidence lies
``DEVIATIONS`` standard deviations or more above the share of bad URLs (so chance finds none among very many itemsets), and if no rule with a part of its tokens
is as confident.

Rules are found by an inverted index on each rule's rarest token, and a hit is confirmed by the rule's whole token set. Matching runs over
distinct token sets; sets of very many pages meet them by a broadcast of proven size, the others by a shuffle.

Everything is DataFrame operations and Spark's own FP-growth.

Defined results: a null URL or one without "://" has an empty host and path, no explicit rule and no association rule; its verdict is
allow. Repeated rows are judged alike; an empty table gives an empty result; URLs of any length are read whole.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.plans.checkpoints import cut
from stratavox.plans.skew import attach

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BAD = "=bad"
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.5
DEVIATIONS = 5.0
#: Rules of at most so many rows and bytes are broadcast; more meet the tokens by a shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 20_000, 8 << 20
_NEW = ["host", "path", "rule", "verdict", "learned"]


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted."""
    empty = F.array().cast("array<string>")
    labels = F.split(host(url), r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    sub = F.when(F.size(labels) > 2, F.slice(labels, F.lit(1), F.size(labels) - 2)).otherwise(empty)
    words = F.filter(F.split(path(url), "[/._-]+"), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda s: F.regexp_extract(s, "(?s)^([^=]*)", 1)), lambda s: s != "")
    mark = lambda kind, xs: F.transform(xs, lambda s: F.concat(F.lit(kind), s))
    all_of = F.concat(
        F.array(F.concat(F.lit("host:"), host(url)), F.concat(F.lit("domain:"), domain)), mark("label:", sub), mark("path:", words), mark("query:", keys),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(empty),
    )
    return F.when(host(url) == "", empty).otherwise(F.array_sort(F.array_distinct(all_of)))


def explicit_rule(url: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, nulls if none does."""
    h, p = host(url), path(url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _as_key(xs: str) -> Column:
    return F.array_join(xs, "\x1f")


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, deviations: float = DEVIATIONS) -> DataFrame:
    """Rules (antecedent, confidence, support) from rows (url, bad boolean)."""
    read = cut(labelled.select(tokens(F.col("url")).alias("tokens"), F.xxhash64("url").cast("decimal(38,0)").alias("of"), F.col("bad").cast("int").alias("bad")).where("size(tokens) > 0 and bad is not null"))
    rows, bad = read.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = bad / rows if rows else 0.0
    # tokens of the same rows are one: equal counts, and equal sums of the rows' hashes
    tally = read.select(F.explode("tokens").alias("token"), "of", "bad").groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), F.sum("of").alias("mark"))
    frequent = tally.where(F.col("n_bad") >= support * rows).groupBy("n", "n_bad", "mark").agg(F.min("token").alias("token")).select("token")
    frequent = cut(frequent)  # a bad row gives its tokens to this table in proportion to the support: at most tokens a URL / support rows
    numbered = read.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")
    kept = numbered.select("row", F.explode("tokens").alias("token"), "bad").join(frequent, "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    baskets = kept.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    # rows that hold none of these tokens still count in the support's base
    share = baskets.count() / rows if rows else 1.0
    sets = cut(FPGrowth(itemsCol="items", minSupport=min(1.0, support / share if share else 1.0)).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("both"))
    alone = sets.where(~F.array_contains("items", BAD)).select(_as_key("items").alias("rule_key"), "freq")
    found = with_bad.withColumn("rule_key", _as_key("antecedent")).join(alone, "rule_key").withColumn("confidence", F.col("both") / F.col("freq"))
    spread = (base * (1 - base)) ** 0.5
    strong = found.where((F.col("confidence") >= confidence) & (F.col("confidence") - base >= deviations * spread / F.sqrt("freq")))
    return without_covered(cut(strong.select("rule_key", "antecedent", "confidence", (F.col("both") / F.lit(float(max(rows, 1)))).alias("support")))).drop("rule_key")


def without_covered(rules: DataFrame) -> DataFrame:
    """The rules (rule_key, antecedent, confidence, ...) without those of which a shorter one, as confident or more, has a part of the tokens."""
    short = rules.select(F.col("antecedent")[0].alias("token"), F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    longer = rules.select("rule_key", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    met = longer.join(short, "token").where((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(met.select("rule_key").distinct(), "rule_key", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (key, n, matched) of the distinct token sets (key, tokens, n) that some rule covers; matched is the most confident rule's tokens."""
    rarity = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    numbered = rules.select("antecedent", "confidence", _as_key("antecedent").alias("rule_key"))
    parts = numbered.select("rule_key", F.explode("antecedent").alias("token")).join(rarity, "token", "left")
    rarest = parts.groupBy("rule_key").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = cut(numbered.join(rarest, "rule_key").select("token", "antecedent", "confidence", "rule_key"))
    count, size = index.agg(F.count("*"), F.coalesce(F.sum(2 * F.octet_length("rule_key") + 64), F.lit(0))).first()
    small = count <= BROADCAST_RULES and size <= BROADCAST_BYTES
    candidates = sets.select("key", "tokens", "n", F.explode("tokens").alias("token")).join(F.broadcast(index) if small else index, "token")
    held = candidates.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return held.groupBy("key").agg(F.first("n").alias("n"), F.max_by("rule_key", F.struct("confidence", "rule_key")).alias("matched"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of pages (with a column url) and host, path, rule, verdict, learned; columns of these names are replaced."""
    pages = pages.select(*(c for c in pages.columns if c not in (*_NEW, "__key")))
    keyed = pages.withColumn("__key", F.md5(_as_key(tokens(F.col("url")))))
    sets = cut(pages.select(tokens(F.col("url")).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n")).select(F.md5(_as_key("tokens")).alias("key"), "tokens", "n"))
    found = sets.select("key", "n").join(match(sets, rules).select("key", "matched"), "key", "left")
    found = cut(found.select(F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("matched").alias("learned")))
    rule, verdict = explicit_rule(F.col("url"))
    said = F.coalesce(verdict, F.when(F.col("learned").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    known = attach(keyed, found, ["__key"], "__n").drop("__key", "__n")
    return known.select(*pages.columns, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule.alias("rule"), said.alias("verdict"), "learned")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Labels belong to documents; a page shows the document whose id is the first number in its path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of = F.regexp_extract(path(F.col("url")), r"/(\d{1,18})", 1)
    numbered = pages.select("url", F.when(of != "", of).cast("long").alias("doc_id"))
    labelled = numbered.join(labels, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
    return judge(pages, mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "learned")


def url_rules(spark, sf_dir: str) -> DataFrame:
    """Host, path and explicit rule of every page, and the verdict of that rule (null without one)."""
    rule, verdict = explicit_rule(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule.alias("rule"), verdict.alias("said"))


QUERIES = {"op8_url_filters": op8_url_filters, "url_rules": url_rules}

ORACLE_SQL = {
    "url_rules": r"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS m FROM pages),
u AS (SELECT page_id, translate(m.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, m.p AS path FROM p),
r(say, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || r.p, length(h || r.p)) FILTER (WHERE h IS NOT NULL) AS rule, arg_max(say, length(h || r.p)) FILTER (WHERE h IS NOT NULL) AS said
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id
"""
}
