"""URL filtering with association rules.

A url's tokens are its host labels (and their hyphen parts), path segments,
file ending and query keys, with digits masked. Spark's FP-growth mines token
combinations over the labelled urls. A combination of at most ``MAX_TOKENS``
becomes a rule when it

* is seen on bad urls ``MIN_COUNT`` times and on ``MIN_SUPPORT`` of all,
* implies the bad label with ``MIN_CONFIDENCE``, and
* stands out from chance: its share of bad urls is ``MIN_DEVIATIONS`` standard
  deviations above the share among all labelled urls;

and a rule goes when one with some of its tokens is at least as confident.
What cannot be in a rule is left out before: tokens on too few bad urls. Tokens
that stand on exactly the same labelled urls are one item, met by any of them
(else n segments of one much-copied url would make 2**n combinations). FP-growth
has no bound on the size of a combination, so n items of a url can make 2**n;
where a url has more than ``FP_ITEMS``, combinations of one item, of two and so on
up to ``MAX_TOKENS`` are counted instead, each size from the frequent ones before
it: the same rules, from every item of every url. Rules match through an inverted
index: url tokens join rule tokens, and a rule holds when all its items were met.
Explicit host/path rules override the mined ones.

DataFrame functions only. Null urls and urls without ``://`` have empty host
and path, no tokens and the verdict allow. Without labelled urls, or without a
rule that passes, everything that no explicit rule blocks is allowed.
Repeated rows are judged each.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import materialize

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_DEVIATIONS = 0.002, 30, 0.6, 4.0
MAX_TOKENS, FP_ITEMS = 3, 12
BAD = "label:block"
# FIXED VALUES: the explicit rules of the contract, (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url; empty for null and host-less urls."""

    def tagged(tag: str, items: Column) -> Column:
        masked = F.transform(items, lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#"))
        return F.transform(F.filter(masked, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    host, path = url_host(url), url_path(url)
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    return F.array_distinct(F.concat(
        tagged("host:", labels),
        tagged("word:", F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))),
        tagged("path:", F.split(path, "/")),
        tagged("file:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        tagged("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
    ))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule whose host (or a subdomain of it) and path prefix fit, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _deviations(n: Column, n_bad: Column, base: float) -> Column:
    """How many standard deviations the share n_bad / n lies above ``base``."""
    return F.when(F.lit(0 < base < 1), (n_bad / n - base) / F.sqrt(F.lit(base * (1 - base)) / n)).otherwise(F.lit(0.0))


def _no_rules(spark) -> DataFrame:
    return spark.createDataFrame([], "rule_id long, tokens array<string>, alike array<array<string>>, confidence double, support double")


def _grown_sets(baskets: DataFrame, least: int, sure: Column) -> DataFrame:
    """(tokens, freq, n_bad) of the sets of at most MAX_TOKENS items on ``least`` bad urls, counted size by size.

    Sets that begin with a ``sure`` one, a rule that no larger one can be more confident than, are left out.
    """
    rows = baskets.groupBy(F.col("found").alias("rest")).agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("n_bad"))  # like urls count once
    rows, sets = rows.withColumn("tokens", F.array().cast("array<string>")), None
    for size in range(1, MAX_TOKENS + 1):
        one = rows.select("tokens", "rest", "freq", "n_bad", F.posexplode("rest").alias("place", "item"))
        rows = one.select(F.concat("tokens", F.array("item")).alias("tokens"), F.slice("rest", F.col("place") + 2, F.size("rest")).alias("rest"), "freq", "n_bad")
        level = materialize(rows.groupBy("tokens").agg(F.sum("freq").alias("freq"), F.sum("n_bad").alias("n_bad")).where(F.col("n_bad") >= least), f"url-sets-{size}")
        sets = level if sets is None else sets.unionByName(level)
        rows = rows.join(level.where(~sure).select("tokens"), "tokens", "left_semi")
    return sets


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_deviations: float = MIN_DEVIATIONS) -> DataFrame:
    """(rule_id, tokens, alike, confidence, support) from rows of ``url`` and boolean ``bad``; nulls are left out.

    ``alike`` has for each of the rule's tokens all that stand on the same labelled urls; any of them meets it.
    """
    known = labelled.where(F.col("bad").isNotNull() & F.col("url").isNotNull())
    urls = materialize(known.select(F.monotonically_increasing_id().alias("id"), "bad", url_tokens(F.col("url")).alias("tokens")), "labelled-urls")
    total, bad = urls.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not bad or bad == total:
        return _no_rules(labelled.sparkSession)
    base, least = bad / total, max(min_count, math.ceil(min_support * total), 1)
    flat = urls.select("id", "bad", F.explode("tokens").alias("token"))
    counts = flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"),
                                       F.bit_xor(F.xxhash64("id")).alias("urls_1"), F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("urls_2"))
    # at most (tokens of all urls) / least of them
    able = materialize(counts.where(F.col("n_bad") >= least), "url-tokens")
    groups = materialize(able.groupBy("n", "n_bad", "urls_1", "urls_2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("alike")), "url-items")
    per_url = flat.join(groups.select("item"), F.col("token") == F.col("item")).groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("found"))
    no_tokens = F.array().cast("array<string>")
    baskets = materialize(urls.join(per_url, "id", "left").select("bad", F.coalesce("found", no_tokens).alias("found")), "url-baskets")
    if baskets.agg(F.max(F.size("found"))).first()[0] > FP_ITEMS:
        sure = (F.col("freq") == F.col("n_bad")) & (_deviations(F.col("freq"), F.col("n_bad"), base) >= min_deviations)
        both = _grown_sets(baskets, least, sure)
    else:
        items = baskets.select(F.concat("found", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(no_tokens)).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(items)
        sets = materialize(model.freqItemsets.where(F.size("items") <= MAX_TOKENS + 1).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("with_bad"), "freq"), "url-itemsets")
        on_bad = sets.where(F.col("with_bad")).select("tokens", F.col("freq").alias("n_bad"))
        both = sets.where(~F.col("with_bad") & F.size("tokens").between(1, MAX_TOKENS)).join(on_bad, "tokens")
    confidence = F.col("n_bad") / F.col("freq")
    passing = both.where((confidence >= min_confidence) & (_deviations(F.col("freq"), F.col("n_bad"), base) >= min_deviations))
    rules = materialize(passing.select(F.xxhash64("tokens").alias("rule_id"), "tokens", confidence.alias("confidence"), (F.col("n_bad") / F.lit(total)).alias("support")), "url-rules")
    # rules with some of whose tokens alone another is at least as confident: at most 2**MAX_TOKENS subsets each
    t = F.col("tokens")
    pairs = F.when(F.size(t) > 2, F.flatten(F.transform(t, lambda x: F.transform(F.filter(t, lambda y: y > x), lambda y: F.array(x, y))))).otherwise(F.array().cast("array<array<string>>"))
    singles = F.when(F.size(t) > 1, F.transform(t, lambda x: F.array(x))).otherwise(F.array().cast("array<array<string>>"))
    smaller = rules.select("rule_id", F.col("confidence").alias("own"), F.explode(F.concat(singles, pairs)).alias("tokens"))
    implied = smaller.join(rules.select("tokens", "confidence"), "tokens").where(F.col("confidence") >= F.col("own")).select("rule_id").distinct()
    left = rules.join(implied, "rule_id", "left_anti")
    alike = left.select("rule_id", F.posexplode("tokens").alias("place", "item")).join(groups.select("item", "alike"), "item")
    alike = alike.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alike"))), lambda x: x["alike"]).alias("alike"))
    return left.join(alike, "rule_id").select("rule_id", "tokens", "alike", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (``tokens``) of ``urls.tokens`` in which some rule holds, with the best confidence."""
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("n"), F.posexplode("alike").alias("place", "alike")).select("rule_id", "confidence", "n", "place", F.explode("alike").alias("token"))
    sets = urls.select("tokens").distinct()
    return (
        sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("tokens", "rule_id", "n", "confidence").agg(F.count_distinct("place").alias("met")).where(F.col("met") == F.col("n"))
        .groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    )


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, **limits) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for every row of ``pages``; ``confidence`` is that of the mined rule met, if any.

    ``limits`` are those of ``mine``.
    """
    mined = materialize(mine(labelled, **limits), "url-rules-kept")
    urls = pages.select("page_id", "url").withColumn("tokens", url_tokens(F.col("url")))
    hits = materialize(matched(urls, mined), "url-hits")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    return (
        urls.join(hits, "tokens", "left").withColumns({"host": host, "path": path})
        .select("page_id", "host", "path", rule.alias("rule"),
                F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "confidence")
    )


def label_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page is the document whose number ends its path; bad means toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]+)(?:[.][A-Za-z]+)?/?(?:[?#]|$)', 1) as bigint)")
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad")
    )
    return pages.select("url", number.alias("number")).join(bad, F.col("number") == F.col("doc_id")).select("url", "bad")
