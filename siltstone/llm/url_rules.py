"""URL filters by association rules.

FP-growth mines the token combinations of labelled URLs that go with the bad label. A rule is pruned
where its support is too low, or where its confidence is no better than that of all labelled URLs: it
must be above their share of bad ones by more than chance gives any of the combinations that were
looked at (a one-sided test, corrected for their number). Wider rules are kept only where they are
more confident than each rule within them. The rest match through an inverted index: tokens of a URL
meet tokens of rules, and a rule matches where all of its tokens were met.

Tokens are the host's labels, the path's segments with numbers as one token, the pairs of the query
string, the scheme, and whether there is a fragment.

Defined results
* a null or empty URL has no tokens; it matches nothing and teaches nothing.
* tokens count once for each URL; repeated rows count each, and are matched each.
* a page of several labels is bad if one of them is; a null label says nothing; unlabelled pages teach nothing.
* ties at the least support are kept; rules as confident as one within them are not; without rules, or
  pages, nothing matches.
* further columns are ignored; a null page_id is carried along.
"""

from __future__ import annotations

from statistics import NormalDist

import pyspark.sql.functions as F
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame

from siltstone.llm.common import cut, loose, only

#: Least share of labelled URLs that hold a rule's tokens and are bad.
SUPPORT = 0.001
#: Chance that any combination at all is taken for a rule where labels say nothing about URLs.
ALPHA = 0.05
#: Most entries of the index that are sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BAD = "\x00bad"
#: Tokens in a rule, at most.
WIDTH = 4


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; empty for null."""
    low = F.lower(F.trim(url))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    every = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(pairs, lambda x: F.concat(F.lit("q:"), x)),
        F.when(scheme != "", F.array(F.concat(F.lit("scheme:"), scheme))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(rule, items, confidence, support) from (url, bad), numbered by hash."""
    items = labelled.select(tokens(F.col("url")).alias("items"), F.col("bad")).filter(F.size("items") > 0)
    taught = cut(items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    n, bad = taught.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BAD))).first()
    if not bad or bad == n:  # nothing to tell apart
        return labelled.sparkSession.createDataFrame([], "rule bigint, items array<string>, confidence double, support double")
    share = bad / n
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=share).fit(taught)
    seen = model.freqItemsets.filter(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.size("items") <= WIDTH + 1))
    looked = seen.count()
    z = NormalDist().inv_cdf(1 - alpha / max(looked, 1))
    # bad URLs among those with the tokens, against what the share of all would give, in standard deviations
    holders = F.col("bad_urls") / F.col("confidence")
    beyond = (F.col("confidence") - share) / F.sqrt(share * (1 - share) / holders)
    rules = cut(
        model.associationRules.filter(F.array_contains("consequent", BAD) & (F.size("consequent") == 1) & (F.size("antecedent") <= WIDTH))
        .withColumn("bad_urls", F.col("support") * n).filter(beyond > z)
        .select(F.xxhash64(F.sort_array("antecedent")).alias("rule"), F.sort_array("antecedent").alias("items"), "confidence", "support")
    )
    # rules within a rule are sets of its tokens, few by its width: met by their number
    inner = rules.select(F.col("rule").alias("wide"), F.col("confidence").alias("c"), F.explode(subsets(F.col("items"))).alias("items")).select("wide", "c", F.xxhash64("items").alias("rule"))
    beaten = inner.join(rules.select("rule", "confidence"), "rule").filter("confidence >= c").select(F.col("wide").alias("rule")).distinct()
    return cut(rules.join(beaten, "rule", "left_anti"))


def subsets(items: Column) -> Column:
    """The proper subsets of at most ``WIDTH`` sorted items that aren't empty."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(items)) - 2)
    return F.when(
        F.size(items) > 1,
        F.transform(masks, lambda m: F.filter(items, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1)),
    ).otherwise(F.array().cast("array<array<string>>"))


def match(pages: DataFrame, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, n_rules, confidence) of the pages that match a rule: how many, and the best confidence."""
    judged = judge(pages, rules, broadcast_rows)
    return judged.filter("n_rules > 0")


def judge(pages: DataFrame, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, n_rules, confidence) of every page: the rules that it matches, and the best confidence, or null."""
    pages = only(pages, "page_id", "url")
    index = rules.select("rule", F.size("items").alias("n"), F.col("confidence").alias("c"), F.explode("items").alias("token"))
    # URLs that are equal match alike, and are looked up once
    urls = pages.select("url").filter("url is not null").distinct()
    met = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    if index.count() <= broadcast_rows:
        index = F.broadcast(index)
    found = (
        met.join(index, "token")
        .groupBy("url", "rule").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("c").alias("c"))
        .filter("k = n")
        .groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"), F.round(F.max("c"), 6).alias("confidence"))
    )
    found = found.withColumn("url", F.concat("url", F.lit("")))  # shuffled anew, so that Spark splits URLs with very many pages
    return pages.join(found, "url", "left").select("page_id", "url", F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"), "confidence")


def document_of(url: Column) -> Column:
    """The document that a page shows: the number that ends its URL's path. Null where there is none."""
    number = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([0-9]{1,18})(\.html?)?/?$", 1)
    return F.nullif(number, F.lit("")).cast("bigint")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document has a label: bad where its quality is 0 or it is toxic."""
    bad = (
        labels.select(labels["doc_id"].alias("own"), ((F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)).alias("bad"))
        .filter(labels["quality"].isNotNull() | labels["toxic"].isNotNull()).filter("own is not null").groupBy("own").agg(F.max("bad").alias("bad"))
    )
    return pages.select(pages["url"], document_of(pages["url"]).alias("own")).join(loose(bad, "own"), "own").select("url", "bad")
