"""Benchmark decontamination (10): template windows joined by hash, then slot consistency.

Numbers, names and units become typed placeholders, so a question asked again
with other values keeps its template. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without_ids, written

#: Unit words that count as units after a number.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year hz khz mhz ghz kb mb gb tb w kw kwh v a ohm pa kpa bar j kj cal kcal n k c f usd eur gbp dollars dollar euros euro cents cent percent degrees degree meters metres meter metre kilometers kilometres miles mile grams kilograms liters litres liter litre"
WORD = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}_]+"
NUMBER, UNIT, NAME = "#num", "#unit", "#name"
#: With at most so many template windows the benchmark side is broadcast (about 100 MB); with more both sides are shuffled.
BROADCAST_WINDOWS = 500_000


def raw_words(text: Column) -> Column:
    """The words and numbers of a text as they stand; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def template(words: Column, keep_first: bool = False) -> Column:
    """Words as a template string array: numbers, units after numbers and capitalised words are placeholders, others lower case.

    keep_first leaves capitals that open the text as plain words.
    """
    t = F.array_join(words, " ")
    names = r"(?<= )\p{Lu}[^ ]*" if keep_first else r"(?<![^ ])\p{Lu}[^ ]*"
    t = F.lower(F.regexp_replace(t, names, NAME))
    t = F.regexp_replace(t, r"(?<![^ ])[0-9][^ ]*", NUMBER)
    t = F.regexp_replace(t, rf"(?<={NUMBER} )(?:{'|'.join(UNITS.split())})(?![^ ])", UNIT)
    return F.split(t, " ")


def _windows(df: DataFrame, words: str, window: int) -> DataFrame:
    """A row for each window of the array `words`: pos (from 1), w (the window's words), key; a shorter array is one window."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    out = df.filter(F.col(words)[0] != "").select("*", F.explode(starts).alias("pos"))
    return out.withColumn("key", F.xxhash64(F.slice(words, F.col("pos"), F.lit(window))))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Template windows of the items: item_id, ipos, n_words, iwords (as they stand), itemplate, key.

    Capitals that open a sentence may be written small in a copy, so each item is
    templated with them as names and as plain words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    opened = F.regexp_replace(text, r"(^|[.!?]\s+|\n\s*)(\p{Lu})", "$1\u0001$2")
    small = F.expr("array_join(transform(split(_o, '\u0001'), (x, i) -> if(i = 0, x, concat(lower(substring(x, 1, 1)), substring(x, 2)))), '')")
    items = benchmark.select("item_id", text.alias("_t"), opened.alias("_o")).withColumn("_s", small)
    items = items.select("item_id", raw_words(F.col("_t")).alias("raw"), F.explode(F.array("_t", "_s")).alias("_v"))
    items = items.withColumn("tpl", template(raw_words(F.col("_v")))).withColumn("n_words", F.size("raw"))
    return _windows(items, "tpl", window).select("item_id", F.col("pos").alias("ipos"), "n_words", F.slice("raw", F.col("pos"), F.lit(window)).alias("iwords"), F.slice("tpl", F.col("pos"), F.lit(window)).alias("itemplate"), "key").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matched windows: doc_id, item_id, pos, ipos, n_words, dwords, iwords, itemplate."""
    items = benchmark_windows(benchmark, window)
    n = items.count()
    read = docs.select(F.col(id_col).alias("doc_id"), raw_words(F.col(text_col)).alias("raw"))
    read = _windows(read.withColumn("tpl", template(F.col("raw"))), "tpl", window)
    side = F.broadcast(items) if n <= BROADCAST_WINDOWS else items
    met = read.join(side, "key").filter(F.slice("tpl", F.col("pos"), F.lit(window)) == F.col("itemplate"))
    return met.select("doc_id", "item_id", "pos", "ipos", "n_words", F.slice("raw", F.col("pos"), F.lit(window)).alias("dwords"), "iwords", "itemplate")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, inconsistent: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed) for documents that hold at least `share` of an item's words in matched windows.

    Windows count by diagonal (place in the document less place in the item). On
    a diagonal the placeholders' values must map one to one from item to
    document, up to `inconsistent` of the pairs; else its windows do not count.
    changed is the number of slot pairs whose values differ: 0 for a copy, more
    for a re-parameterised question. A text shorter than a window is one window,
    so a short item matches only a text that is it. Repeated ids are one
    document; a null id is a document of its own group; blank items match
    nothing; empty tables give no rows.
    """
    met = matches(docs, benchmark, window, id_col, text_col).withColumn("diagonal", F.col("pos") - F.col("ipos"))
    slots = F.expr(
        "filter(transform(itemplate, (t, k) -> named_struct('at', ipos + k, 'kind', t, 'i', lower(iwords[k]), 'd', lower(dwords[k]))), x -> startswith(x.kind, '#'))"
    )
    at = ["doc_id", "item_id", "diagonal"]
    lines = met.groupBy(*at).agg(F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"), F.collect_set("ipos").alias("starts"), F.first("n_words").alias("n_words"))
    pairs = F.expr("array_distinct(transform(slots, x -> struct(x.kind, x.i, x.d)))")
    lines = lines.withColumn("pairs", pairs).withColumn("sources", F.expr("size(array_distinct(transform(pairs, x -> struct(x.kind, x.i))))")).withColumn("goals", F.expr("size(array_distinct(transform(pairs, x -> struct(x.kind, x.d))))"))
    good = lines.filter(F.size("pairs") - F.least("sources", "goals") <= inconsistent * F.size("pairs"))
    held = good.groupBy("doc_id", "item_id").agg(
        F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr(f"flatten(transform(starts, s -> sequence(s, least(s + {window - 1}, n_words))))"))))).alias("covered"),
        F.sum(F.size("slots")).alias("slots"),
        F.sum(F.expr("size(filter(slots, x -> x.i <> x.d))")).alias("changed"),
    )
    held = held.withColumn("coverage", F.col("covered") / F.col("n_words"))
    return held.filter(F.col("coverage") >= share).select("doc_id", "item_id", "coverage", "slots", "changed")


def flagged(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, contaminated, items sorted, coverage, changed); see contamination()."""
    found = contamination(docs, benchmark, window, share, id_col=id_col, text_col=text_col)
    by_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.min("changed").alias("changed"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(f"array<{found.schema['item_id'].dataType.simpleString()}>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed", F.lit(0)).alias("changed"))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with their columns; rows with a null id always stay."""
    found = written(contamination(docs.filter(F.col(id_col).isNotNull()), benchmark, window, share, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__benchmark_leak")).distinct())
    return without_ids(docs, id_col, found)


def oracle(window: int = 5, share: float = 0.8, inconsistent: float = 0.2) -> str:
    """flagged() in DuckDB's SQL, token by token, for small tables and ids that do not repeat."""
    word = WORD.replace("'", "''")
    units = ", ".join(f"'{u}'" for u in UNITS.split())

    def templated(raw: str) -> str:
        return (
            f"list_transform(range(1, len({raw}) + 1), lambda i: CASE WHEN regexp_matches({raw}[i], '^\\p{{Lu}}') THEN '{NAME}' WHEN regexp_matches({raw}[i], '^[0-9]') THEN '{NUMBER}' "
            f"WHEN i > 1 AND regexp_matches({raw}[i - 1], '^[0-9]') AND lower({raw}[i]) IN ({units}) THEN '{UNIT}' ELSE lower({raw}[i]) END)"
        )

    last = window - 1
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS raw FROM documents),
dt AS (SELECT doc_id, raw, {templated("raw")} AS tpl FROM d WHERE len(raw) > 0),
dw AS (SELECT doc_id, raw, tpl, unnest(range(1, greatest(len(tpl) - {last}, 1) + 1)) AS pos FROM dt),
dk AS (SELECT doc_id, pos, raw[pos:pos + {last}] AS dwords, tpl[pos:pos + {last}] AS t FROM dw),
b AS (SELECT item_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '(^|[.!?]\\s+|\\n\\s*)(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g') AS opened FROM benchmark),
bs AS (SELECT item_id, regexp_extract_all(text, '{word}') AS raw, unnest([text, array_to_string(list_transform(string_split(opened, chr(1)), lambda x, i: CASE WHEN i = 1 THEN x ELSE lower(left(x, 1)) || substring(x, 2) END), '')]) AS v FROM b),
bv AS (SELECT item_id, raw, regexp_extract_all(v, '{word}') AS vr FROM bs),
bt AS (SELECT item_id, raw, {templated("vr")} AS tpl FROM bv WHERE len(vr) > 0),
bw AS (SELECT item_id, raw, tpl, unnest(range(1, greatest(len(tpl) - {last}, 1) + 1)) AS ipos FROM bt),
bk AS (SELECT DISTINCT item_id, ipos, len(raw) AS n_words, raw[ipos:ipos + {last}] AS iwords, tpl[ipos:ipos + {last}] AS t FROM bw),
met AS (SELECT doc_id, item_id, pos, ipos, pos - ipos AS diagonal, n_words, dwords, iwords, t FROM dk JOIN bk USING (t)),
slots AS (SELECT DISTINCT doc_id, item_id, diagonal, ipos + k - 1 AS place, t[k] AS kind, lower(iwords[k]) AS i, lower(dwords[k]) AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM met) x WHERE starts_with(t[k], '#')),
per AS (SELECT doc_id, item_id, diagonal, count(DISTINCT (kind, i, w)) AS pairs, count(DISTINCT (kind, i)) AS sources, count(DISTINCT (kind, w)) AS goals, count(*) AS slots, count(*) FILTER (i <> w) AS changed FROM slots GROUP BY ALL),
good AS (SELECT DISTINCT m.doc_id, m.item_id, m.diagonal, coalesce(p.changed, 0) AS changed FROM met m LEFT JOIN per p USING (doc_id, item_id, diagonal) WHERE p.pairs IS NULL OR p.pairs - least(p.sources, p.goals) <= {inconsistent} * p.pairs),
covered AS (SELECT doc_id, item_id, any_value(n_words) AS n_words, count(DISTINCT place) AS n FROM (SELECT m.doc_id, m.item_id, m.n_words, unnest(range(m.ipos, least(m.ipos + {last}, m.n_words) + 1)) AS place FROM met m JOIN good USING (doc_id, item_id, diagonal)) x GROUP BY doc_id, item_id),
held AS (SELECT c.doc_id, c.item_id, CAST(c.n AS DOUBLE) / c.n_words AS coverage, (SELECT sum(changed) FROM good g WHERE g.doc_id = c.doc_id AND g.item_id = c.item_id) AS changed FROM covered c WHERE CAST(c.n AS DOUBLE) / c.n_words >= {share}),
by_doc AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(coverage) AS coverage, CAST(min(changed) AS BIGINT) AS changed FROM held GROUP BY doc_id)
SELECT d.doc_id, b.doc_id IS NOT NULL AS contaminated, coalesce(b.items, []) AS items, coalesce(b.coverage, 0.0::DOUBLE) AS coverage, coalesce(b.changed, 0) AS changed FROM documents d LEFT JOIN by_doc b USING (doc_id)"""
