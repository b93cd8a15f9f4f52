"""URL filters (3): FP-growth mines token combinations of labelled urls; pruned rules match by an inverted index.

Only DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Bad rows that a combination needs at least, whatever its share: fewer are no evidence.
LEAST_ROWS = 20
#: Repeats of one set of tokens that one row is unfolded to at a time.
UNFOLD = 4096

#: (action, rule): a rule is a host, then the start of a path.
Rules = list[tuple[str, str]]


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """`pages` with host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rest = F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) ELSE '' END")
    return (
        pages.withColumn("_url", F.col(url_col))
        .withColumn("_rest", rest)
        .withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_url", "_rest")
    )


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def listed(rules: Rules) -> Column:
    """struct(rule, action) of the longest rule that fits host and path, or null; a list of a few rules, given in code."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, path = _split(rule)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a url: host, host labels and their words, path segments without digits, extension, query keys, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    ends = F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)), lambda x: x != "")
    keys = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    part = F.filter(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"#(.*)$", 1)), lambda x: x != "")
    mark = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind + ":"), x))
    of = F.concat(
        F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("host:"), host))),
        mark("label", labels), mark("word", words), mark("dir", segments), mark("ext", ends), mark("key", keys), mark("part", part),
    )
    return F.array_distinct(of)


def matches(items: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, rule_id) where every token of the rule is among the row's `tokens`.

    An inverted index lists each rule under one token, that with the fewest rules;
    a row meets only the rules listed under its tokens. The join is a plain
    equi-join, so that a common token is split when it is skewed.
    """
    listed_under = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    load = listed_under.groupBy("token").agg(F.count("*").alias("load"))
    anchor = listed_under.join(load, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("load", "token")).alias("token"), F.first("antecedent").alias("antecedent"))
    found = items.select(id_col, "tokens", F.explode("tokens").alias("token")).join(anchor, "token")
    return found.filter(F.size(F.array_except("antecedent", "tokens")) == 0).select(id_col, "rule_id")


def mine(labelled: DataFrame, min_support: float, min_confidence: float, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rules antecedent => bad from `labelled` (tokens array, bad boolean): rule_id, antecedent, support, confidence.

    FP-growth runs over the bad rows; a combination's support is its share of all
    labelled rows that are bad and hold it, its confidence the share of bad among
    the rows that hold it; fewer than `least_rows` bad rows are no evidence. A
    combination is dropped if a part of it is a rule with at least its confidence.
    Two steps keep the mining small and lose no rule: of tokens that stand in the
    same rows, always together, the least by order stands for all; and a token that
    only bad rows hold is a rule by itself, which no larger one can beat, so it
    enters no combination. No bad rows give no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.size("tokens") > 0)
    shapes = written(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")).withColumn("shape", F.monotonically_increasing_id()))
    n, bad = shapes.agg(F.sum("n"), F.sum("b")).first()
    schema = "rule_id string, antecedent array<string>, support double, confidence double"
    if not bad:
        return spark.createDataFrame([], schema)
    least_bad = math.ceil(max(min_support * n, least_rows) - 1e-9)
    if least_bad > bad:
        return spark.createDataFrame([], schema)
    each = shapes.select("shape", "n", "b", F.explode("tokens").alias("token"))
    mark = lambda seed: F.sum(F.xxhash64("shape", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}")
    seen = each.groupBy("token").agg(F.sum("n").alias("held"), F.sum("b").alias("b"), mark(1), mark(2)).filter(F.col("b") >= least_bad)
    alone = written(seen.groupBy("held", "b", "s1", "s2").agg(F.min("token").alias("token")).select("token", "held", "b"))
    # a broadcast of bounded size: with t tokens in a url on average, at most t / min_support tokens are this frequent
    baskets = each.filter("b > 0").join(F.broadcast(alone.filter("b < held").select("token")), "token").groupBy("shape", "b").agg(F.collect_list("token").alias("items"))
    baskets = written(baskets)
    total = baskets.agg(F.sum("b")).first()[0] or 0
    rules = alone.select(F.array("token").alias("antecedent"))
    if total >= least_bad:
        lots = baskets.select("items", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - 1) / UNFOLD))).alias("k"))
        every = lots.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(UNFOLD), F.col("b") - F.col("k") * UNFOLD))).alias("_")).select("items")
        sets = FPGrowth(itemsCol="items", minSupport=(least_bad - 0.5) / total, minConfidence=1.0).fit(every).freqItemsets
        rules = rules.union(sets.filter(F.size("items") > 1).select(F.array_sort("items")))
    rules = written(rules.withColumn("rule_id", F.array_join("antecedent", " ")))
    held = matches(shapes, rules, "shape").join(shapes.select("shape", "n", "b"), "shape").groupBy("rule_id").agg(F.sum("n").alias("held"), F.sum("b").alias("b"))
    good = held.withColumn("confidence", F.col("b") / F.col("held")).withColumn("support", F.col("b") / F.lit(float(n))).filter((F.col("confidence") >= min_confidence) & (F.col("b") >= least_bad))
    good = written(rules.join(good, "rule_id").select("rule_id", "antecedent", "support", "confidence"))
    parts = matches(good.select("rule_id", F.col("antecedent").alias("tokens")).withColumnRenamed("rule_id", "whole"), good, "whole").filter("whole <> rule_id")
    better = parts.join(good.select("rule_id", F.col("confidence").alias("part_confidence")), "rule_id").join(good.select(F.col("rule_id").alias("whole"), "confidence"), "whole").filter("part_confidence >= confidence")
    return written(good.join(better.select(F.col("whole").alias("rule_id")).distinct(), "rule_id", "left_anti").select("rule_id", "antecedent", "support", "confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Rules, min_support: float = 0.001, min_confidence: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, mined (the mined rules that fit, sorted), confidence.

    Labels reach a url through the document number that ends its path; a labelled
    url is bad if its quality is 0 or it is toxic. A listed rule decides; else a
    mined rule that fits blocks; else the url is allowed. Null urls and urls
    without `://` have empty parts and meet no rule. Urls are read whole, however
    long. Repeated pages stay repeated, null ids too. Without labels nothing is mined. Columns of either
    table beyond those named are not read.
    """
    urls = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = with_host_path(written(urls)).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    marked = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).filter("bad is not null").groupBy("doc_id").agg(F.bool_or("bad").alias("bad"))
    labelled = urls.withColumn("doc_id", F.when(number != "", number).cast("long")).join(marked, "doc_id").select("tokens", "bad")
    mined = mine(labelled, min_support, min_confidence)
    hits = matches(urls, mined, "_row").join(mined.select("rule_id", "confidence"), "rule_id").groupBy("_row").agg(F.array_sort(F.collect_set("rule_id")).alias("mined"), F.max("confidence").alias("confidence"))
    out = urls.join(hits, "_row", "left").withColumn("_by", listed(rules))
    verdict = F.coalesce(F.col("_by.action"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_by.rule").alias("rule"), verdict.alias("verdict"), "mined", "confidence")


def oracle(rules: Rules, min_support: float = 0.001, min_confidence: float = 0.5) -> str:
    """judge() in DuckDB's SQL, growing every combination of the bad urls' tokens; for small tables and ids that do not repeat."""
    cases, names = [], []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = _split(rule)
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases.append(f"WHEN {fits} THEN '{action}'")
        names.append(f"WHEN {fits} THEN '{rule}'")
    by, name = (f"CASE {' '.join(c)} END" if c else "CAST(NULL AS VARCHAR)" for c in (cases, names))
    mark = lambda kind, a: f"list_transform({a}, lambda x: '{kind}:' || x)"
    some = lambda a: f"list_filter({a}, lambda x: x <> '')"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
tk AS (SELECT *, list_distinct(flatten([
    CASE WHEN host = '' THEN []::VARCHAR[] ELSE ['host:' || host] END, {mark("label", some("string_split(host, '.')"))},
    {mark("word", some("flatten(list_transform(string_split(host, '.'), lambda x: string_split(x, '-')))"))},
    {mark("dir", "list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]'))")},
    {mark("ext", some("[regexp_extract(path, '[.]([A-Za-z]{1,5})$', 1)]"))},
    {mark("key", "regexp_extract_all(coalesce(regexp_extract(url, '[?]([^#]*)', 1), ''), '(?:^|&)([^=&]+)', 1)")},
    {mark("part", some("[regexp_extract(coalesce(url, ''), '#(.*)$', 1)]"))}])) AS tokens FROM hp),
marked AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
lab AS (SELECT t.page_id, t.tokens, m.bad FROM tk t JOIN marked m ON m.doc_id = try_cast(regexp_extract(t.path, '/([0-9]{{1,18}})(?:[.][A-Za-z]+)?/?$', 1) AS BIGINT) WHERE len(t.tokens) > 0),
least AS (SELECT greatest({min_support} * count(*), {LEAST_ROWS}) AS bad FROM lab),
seen AS (SELECT token, list_sort(list(page_id)) AS held_by FROM (SELECT page_id, unnest(tokens) AS token FROM lab) t GROUP BY token),
alone AS (SELECT min(token) AS token FROM seen GROUP BY held_by),
bad_tok AS (SELECT page_id, token FROM (SELECT page_id, unnest(tokens) AS token FROM lab WHERE bad) t SEMI JOIN alone USING (token)),
tok AS MATERIALIZED (SELECT * FROM bad_tok SEMI JOIN (SELECT token FROM bad_tok GROUP BY token HAVING count(*) >= (SELECT bad FROM least)) c USING (token)),
grown(page_id, items, last) AS (SELECT page_id, [token], token FROM tok UNION ALL SELECT g.page_id, list_append(g.items, t.token), t.token FROM grown g JOIN tok t ON t.page_id = g.page_id AND t.token > g.last),
sets AS (SELECT items, count(*) AS b FROM grown GROUP BY items HAVING count(*) >= (SELECT bad FROM least)),
good AS (SELECT s.items, s.b, count(*) AS held, s.b / count(*) AS confidence FROM sets s JOIN lab l ON list_has_all(l.tokens, s.items) GROUP BY s.items, s.b HAVING s.b / count(*) >= {min_confidence}),
mined AS (SELECT items, confidence, array_to_string(items, ' ') AS rule_id FROM good g WHERE NOT EXISTS (SELECT 1 FROM good p WHERE len(p.items) < len(g.items) AND list_has_all(g.items, p.items) AND p.confidence >= g.confidence)),
hits AS (SELECT t.page_id, list_sort(list(DISTINCT m.rule_id)) AS mined, max(m.confidence) AS confidence FROM tk t JOIN mined m ON list_has_all(t.tokens, m.items) GROUP BY t.page_id)
SELECT page_id, host, path, {name} AS rule, coalesce({by}, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined, confidence FROM tk LEFT JOIN hits USING (page_id)"""
