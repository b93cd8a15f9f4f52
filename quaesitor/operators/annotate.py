"""The rule engine: tokens, rule windows, affixes, the question-answer rule and the classifier's two outputs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules

SIGNAL = ["signal_id", "text_unit_id", "layer", "category", "subcategory", "surface_form", "span_start", "span_end", "rule_id", "rule_version", "weight", "status", "lemma", "pos", "polarity"]
MATCH = "span_start int, surface_form string, rule_id string, layer string, category string, subcategory string, weight double, status string, lemma string, pos string, polarity string"
RULE = ["rule_id", "layer", "category", "subcategory", "weight", "status", "lemma", "pos", "polarity"]
QA_RULE = "morph.syn.question_answer"
SENTENCE = r"[^.!?]+[.!?]*"


#: Tokens between two stored offsets: a place costs at most so many pieces to reach.
STRIDE = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row however often body reads it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _upto(p: Column) -> Column:
    """The characters before each STRIDE-th of the pieces p of a text."""
    blocks = F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRIDE).cast("int")), lambda k: F.length(F.array_join(F.slice(p, k * STRIDE + 1, F.lit(STRIDE)), ""))))
    return F.aggregate(F.coalesce(blocks, F.array().cast("array<int>")), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, F.lit(-1)) + n))


def _bare(piece: Column) -> Column:
    return F.ltrim(piece, F.lit(T.BLANKS))


def _start(i: Column, piece: Column) -> Column:
    """The character at which the token of piece i (from 0) of a row's p begins."""
    block = F.floor(i / STRIDE).cast("int")
    before = F.col("upto")[block] + F.length(F.array_join(F.slice("p", block * STRIDE + 1, i - block * STRIDE), ""))
    return (before + F.length(piece) - F.length(_bare(piece))).cast("int")


def _placed(units: DataFrame) -> DataFrame:
    """One row per piece: text_unit_id, i (from 0), piece, and p and upto of its text; after what keeps few rows, take what is needed of p and drop it.

    The rows are made, filtered and cut down in one generated loop over the
    text's pieces, in which p is a reference: it is copied for no row.
    """
    t = units.select("text_unit_id", T.pieces(F.col("text")).alias("p"))
    t = t.select("text_unit_id", "p", _upto(F.col("p")).alias("upto"))
    return t.select("text_unit_id", "p", "upto", F.posexplode_outer("p").alias("i", "piece")).filter("piece IS NOT NULL")  # a plain explode would have its condition pushed below and all pieces made twice


def token_table(units: DataFrame) -> DataFrame:
    """One row per token: text_unit_id, pos (from 0), token, lower, span_start, span_end.

    Offsets are running sums of the pieces' lengths within the row: no shuffle,
    and a long text costs little more than its tokens.
    """
    t = _placed(units).select("text_unit_id", F.col("i").alias("pos"), _bare(F.col("piece")).alias("token"), _start(F.col("i"), F.col("piece")).alias("span_start"))
    return t.select("text_unit_id", "pos", "token", F.lower("token").alias("lower"), "span_start", (F.col("span_start") + F.length("token")).cast("int").alias("span_end"))


def bigrams(units: DataFrame) -> DataFrame:
    """One row per pair of neighbouring tokens: text_unit_id, first, second (lower case); no shuffle."""
    t = units.select("text_unit_id", T.pieces(F.col("text")).alias("p"))
    t = t.select("text_unit_id", "p", F.posexplode_outer("p").alias("i", "piece")).filter(F.col("i") + 1 < F.size("p"))
    return t.select("text_unit_id", F.lower(_bare(F.col("piece"))).alias("first"), F.lower(_bare(F.get("p", F.col("i") + 1))).alias("second"))


def alternative_table(spark: SparkSession, version: str) -> DataFrame:
    """The compiled rules by first word: (key, alts), each word's alternatives by rule, the shortest first. The rule set bounds it: a few hundred rows."""
    rows = [(k, a.rule_id, a.layer, a.category, a.subcategory, a.weight, a.status, a.lemma, a.pos, a.polarity, len(a.slots), [list(s) for s in a.slots], list(a.before_in), list(a.before_not), a.word_after, a.cased) for k, a in enumerate(rules.alternatives(version))]
    schema = "k int, rule_id string, layer string, category string, subcategory string, weight double, status string, lemma string, pos string, polarity string, n int, slots array<array<string>>, before_in array<string>, before_not array<string>, word_after boolean, cased boolean"
    alt = F.struct("rule_id", "n", "k", *[c for c in ("layer", "category", "subcategory", "weight", "status", "lemma", "pos", "polarity", "slots", "before_in", "before_not", "word_after", "cased")])
    return spark.createDataFrame(rows, schema).select(F.explode(F.col("slots")[0]).alias("key"), alt.alias("alt")).groupBy("key").agg(F.array_sort(F.collect_list("alt")).alias("alts"))


def _hits(alts: Column, window: Column, before: Column) -> Column:
    """The alternatives that fit a window of pieces; of one rule the shortest."""

    def fits(low: Column) -> Column:
        def ok(a: Column) -> Column:
            slot = lambda words, k: F.when(k + 1 > F.size(low), False).when(F.size(words) == 0, low[k].rlike(r"^\p{L}")).otherwise(F.array_contains(words, low[k]))
            raw = _bare(window[0])
            return (
                ((F.size(a["before_in"]) == 0) | F.array_contains(a["before_in"], before))
                & ~F.array_contains(a["before_not"], before)
                & (~a["cased"] | (raw == F.upper(raw)))
                & F.forall(F.transform(a["slots"], slot), lambda x: x)
                & (~a["word_after"] | F.coalesce(F.get(low, a["n"]).rlike(r"^\p{L}"), F.lit(False)))
            )

        return F.filter(alts, ok)

    found = _let(F.transform(window, lambda p: F.lower(_bare(p))), fits)
    return _let(found, lambda f: F.filter(f, lambda h, i: (i == 0) | (F.get(f, i - 1)["rule_id"] != h["rule_id"])))


def _may_begin(low: Column, after: Column, alternatives: tuple[rules.Alternative, ...]) -> Column:
    """Whether some alternative can begin with the word: its first slot, and the second where that names words."""
    firsts = sorted({w for a in alternatives for w in a.slots[0]})
    loose = sorted({w for a in alternatives if len(a.slots) == 1 or not a.slots[1] for w in a.slots[0]})
    pairs = sorted({f"{x} {y}" for a in alternatives if len(a.slots) > 1 for x in a.slots[0] for y in a.slots[1]})
    return low.isin(*firsts) & (low.isin(*loose) | F.concat(low, F.lit(" "), after).isin(*pairs))


def _may_have_affix(low: Column, specs: tuple[rules.Affix, ...]) -> Column:
    """Whether the word has an affix of the rules and the length they ask for; most words are told apart by as many of their first and last letters as the shortest affix has."""
    out = F.lit(False)
    for kind, end in (("prefix", F.left), ("suffix", F.right)):
        mine = [a for a in specs if a.kind == kind]
        if mine:
            n = min(len(a.affix) for a in mine)
            ends = sorted({a.affix[:n] if kind == "prefix" else a.affix[-n:] for a in mine})
            out = out | (end(low, F.lit(n)).isin(*ends) & reduce(Column.__or__, [affix_shape(a, low) for a in mine]))
    return out


def word_signals(units: DataFrame, version: str = "0.2", alternatives: tuple[rules.Alternative, ...] | None = None, specs: tuple[rules.Affix, ...] | None = None) -> DataFrame:
    """Matches of the rules (all windows, one per rule and start, the shortest) and of the affix rules, in one pass over the pieces of each text.

    A text gives a row with a small window for each token that may begin some
    alternative or has some affix; the row meets the broadcast rule set by its
    first word and is checked by itself. Nothing is shuffled, and no window
    carries the text.
    """
    alternatives = rules.alternatives(version) if alternatives is None else alternatives
    specs = rules.affixes(version) if specs is None else specs
    if not alternatives and not specs:
        return _signals(units.sparkSession.createDataFrame([], f"text_unit_id string, {MATCH}"), version)
    i, piece = F.col("i"), F.col("piece")
    low = lambda x: F.lower(_bare(x))
    wide = max((len(a.slots) for a in alternatives), default=0) + 1
    keep = _may_have_affix(low(piece), specs) if specs else F.lit(False)
    if alternatives:
        keep = _may_begin(low(piece), low(F.get("p", i + 1)), alternatives) | keep
    t = _placed(units).filter(keep).select("text_unit_id", _start(i, piece).alias("span_start"), F.slice("p", i + 1, F.lit(wide)).alias("window"), F.when(i == 0, "").otherwise(low(F.get("p", i - 1))).alias("before"), low(piece).alias("word"))
    hits = []
    if alternatives:
        t = t.join(F.broadcast(alternative_table(units.sparkSession, version).withColumnRenamed("key", "word")), "word", "left" if specs else "inner")
        surface = lambda n: F.concat(_bare(F.col("window")[0]), F.array_join(F.slice("window", F.lit(2), n - 1), ""))
        hits.append(F.transform(_hits(F.col("alts"), F.col("window"), F.col("before")), lambda h: F.struct(surface(h["n"]).alias("surface_form"), *[h[c].alias(c) for c in RULE])))
    if specs:
        fired = F.array(*[F.when(affix_hit(a, F.col("word")), F.struct(_bare(F.col("window")[0]).alias("surface_form"), *_affix_fields(a))) for a in specs])
        hits.append(F.when(F.col("word").rlike(r"^\p{L}+$"), F.filter(fired, lambda x: x.isNotNull())))
    none = F.array().cast(f"array<struct<{MATCH.removeprefix('span_start int, ')}>>".replace(" string", ": string").replace(" double", ": double"))
    found = F.concat(*[F.coalesce(h, none) for h in hits])
    return _signals(t.select("text_unit_id", "span_start", F.explode(found).alias("h")).select("text_unit_id", "span_start", "h.*"), version)


def rule_signals(units: DataFrame, version: str = "0.2") -> DataFrame:
    """Matches of the lexical, token and figure rules."""
    return word_signals(units, version, specs=())


def _signals(df: DataFrame, version: str) -> DataFrame:
    """Adds the id, the end and the version to matches with their surface, and orders the columns."""
    return df.withColumns(
        {
            "signal_id": signal_id(F.col("text_unit_id"), F.col("rule_id"), F.col("span_start")),
            "span_end": (F.col("span_start") + F.length("surface_form")).cast("int"),
            "rule_version": F.lit(version),
        }
    ).select(*SIGNAL)


def signal_id(unit: Column, rule: Column, start: Column) -> Column:
    return F.concat_ws("::", unit, rule, start.cast("string"))


def affix_shape(a: rules.Affix, word: Column) -> Column:
    """Whether a word has the affix and the length that an affix rule asks for."""
    if a.kind == "prefix":
        return word.startswith(a.affix) & (F.length(word) - len(a.affix) >= a.least)
    return word.endswith(a.affix) & (F.length(word) >= a.least)


def affix_hit(a: rules.Affix, word: Column) -> Column:
    """Whether a lower-case word fires an affix rule: the allowed words beat the blocked ones."""
    allowed = F.lit(False) if not a.allowed else word.isin(*a.allowed)
    shape, blocked = affix_shape(a, word), F.lit(False)
    if a.kind == "prefix":
        for b in a.blocked:  # a longer entry blocks all words it begins
            blocked = blocked | (word.startswith(b) if len(b) > len(a.affix) else word == b)
    elif a.blocked:
        blocked = word.isin(*a.blocked)
    if a.listed_only:
        return shape & allowed
    return shape & (allowed | ~blocked)


def _affix_fields(a: rules.Affix) -> list[Column]:
    """The fields of RULE for a word that fires an affix rule."""
    values = {"rule_id": a.rule_id, "layer": "word_formation", "category": a.category, "subcategory": a.subcategory, "weight": a.weight, "status": a.status, "lemma": F.col("word"), "pos": None, "polarity": a.polarity}
    return [(v if isinstance(v, Column) else F.lit(v).cast("double" if c == "weight" else "string")).alias(c) for c, v in values.items()]


def affix_signals(units: DataFrame, version: str = "0.2") -> DataFrame:
    """Signals of the affix rules over word tokens; only tokens with some rule's affix leave their row."""
    return word_signals(units, version, alternatives=())


def question_answer_signals(units: DataFrame, version: str = "0.2") -> DataFrame:
    """One signal for a unit with a sentence that asks and a sentence that does not."""
    s = F.filter(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda x: T.strip_ends(x) != "")
    ok = _let(s, lambda s: F.exists(s, lambda x: x.contains("?")) & F.exists(s, lambda x: ~x.contains("?")))
    none = F.lit(None).cast("string")
    cols = {"layer": F.lit("morpho_syntactic"), "category": F.lit("syntactic_pattern"), "subcategory": F.lit("question_answer"), "rule_id": F.lit(QA_RULE), "weight": F.lit(0.5), "status": F.lit("active"), "lemma": none, "pos": none, "polarity": none, "span_start": F.lit(0), "surface_form": F.col("text")}
    return _signals(units.select("text_unit_id", "text").filter(ok).withColumns(cols), version)


def unit_page(units: DataFrame, after: str | None, size: int) -> DataFrame:
    """The next `size` units behind an id, in order, with nothing but id and text: a scan that can be taken up where it ended."""
    rows = units.select("text_unit_id", "text")
    return (rows if after is None else rows.filter(F.col("text_unit_id") > after)).orderBy("text_unit_id").limit(size)


class Annotator(Protocol):
    """A layer: reads units (text_unit_id, text) and returns signals; it must not fail on any text."""

    def __call__(self, units: DataFrame, version: str) -> DataFrame: ...


LAYERS: dict[str, Annotator] = {"rules": rule_signals, "affixes": affix_signals, "question_answer": question_answer_signals}


def signals(units: DataFrame, version: str = "0.2", layers: dict[str, Annotator] | None = None) -> DataFrame:
    """The union of all layers' signals; the rules and the affixes share one pass over the pieces. A layer that can't be planned is logged and left out; the others stay."""
    planned, todo = [], dict(layers or LAYERS)
    if todo.get("rules") is rule_signals and todo.get("affixes") is affix_signals:
        try:
            planned.append(word_signals(units, version).select(*SIGNAL))
            del todo["rules"], todo["affixes"]
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).exception("layers rules and affixes not in one pass")
    for name, layer in todo.items():
        try:
            planned.append(layer(units, version).select(*SIGNAL))
        except Exception:  # noqa: BLE001  whatever a plugged-in layer raises
            logging.getLogger(__name__).exception("layer %s left out", name)
    if not planned:
        return _signals(units.sparkSession.createDataFrame([], f"text_unit_id string, {MATCH}"), version)
    return reduce(DataFrame.unionByName, planned)


class Classifier(Protocol):
    """predict(texts) -> [(label, confidence)], called on Arrow batches."""

    def __call__(self, texts: list[str]) -> list[tuple[int, float]]: ...


def stand_in(texts: list[str]) -> list[tuple[int, float]]:
    """A deterministic stand-in where no model is at hand: cue words push the score."""
    cues = ("not sure", "unclear", "unknown", "no idea", "maybe", "perhaps", "might", "?")
    out = []
    for t in texts:
        n = sum(c in (t or "").lower() for c in cues)
        out.append((int(n > 0), 0.5 + 0.5 * n / (n + 1)))
    return out


def verdicts(units: DataFrame, predict: Classifier = stand_in, model_id: str = "stand-in", model_version: str = "1") -> DataFrame:
    """One verdict per unit: text_unit_id, model_id, model_version, label, confidence."""

    @F.pandas_udf("label int, confidence double")
    def run(texts):
        import pandas as pd

        return pd.DataFrame(predict(texts.tolist()), columns=["label", "confidence"])

    return units.select("text_unit_id", F.lit(model_id).alias("model_id"), F.lit(model_version).alias("model_version"), run("text").alias("p")).select("text_unit_id", "model_id", "model_version", "p.label", "p.confidence")


def verdict_signals(v: DataFrame) -> DataFrame:
    """The classifier's signals, emitted beside its verdicts."""
    return v.select(F.concat_ws("::", "text_unit_id", F.lit("clf.roberta_binary"), F.lit("0")).alias("signal_id"), "text_unit_id", F.lit("classifier").alias("layer"), F.when(F.col("label") == 1, "nk_positive").otherwise("nk_negative").alias("category"), F.lit("clf.roberta_binary").alias("rule_id"), "confidence", F.lit("active").alias("status"))


def payload_json(payload: Column) -> Column:
    """A payload as JSON without its private keys."""
    return F.to_json(F.map_filter(payload, lambda k, v: ~k.startswith("__")))


def is_evidence(version: str = "0.2") -> Column:
    """Active signals that count: not the classifier's, and not of a certainty subcategory."""
    return (F.col("layer") != "classifier") & (F.col("status") == "active") & ~F.coalesce(F.col("subcategory"), F.lit("")).isin(*rules.certainty_subcategories(version))


def rules_as_json(version: str = "0.2") -> str:
    """The compiled rules, for inspection and for other engines."""
    return json.dumps([a.__dict__ for a in rules.alternatives(version)])
