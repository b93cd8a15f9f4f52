"""The rule engine: golden sentences, affix truth tables, rule integrity."""

import pytest

from quaesitor.operators import annotate, rules

GOLDEN = {
    "A lasting doubt hangs over the retry path.": ({"lex.doubt_n"}, {"lex.doubt_v"}),
    "I doubt that patch.": ({"lex.doubt_v"}, {"lex.doubt_n"}),
    "Who set the flag is unknown.": ({"lex.unknown"}, set()),
    "Both clauses are vague and ambiguous.": ({"lex.ambiguous", "lex.vague"}, set()),
    "Error paths are one blind spot here.": ({"lex.blind_spot", "rhetor.metaphor.visibility.blind_spot"}, set()),
    "Our notes have a knowledge gap.": ({"lex.knowledge_gap", "rhetor.metaphor.gap.knowledge_gap"}, set()),
    "Two conflicts stay unresolved.": ({"lex.unresolved"}, set()),
    "We see a lack of examples.": ({"lex.lack_of"}, set()),
    "On arm we can't reproduce it.": ({"lex.cannot_reproduce", "morph.neg.bare_modifier"}, set()),
    "It never hung on the old kernel.": ({"morph.neg.bare_modifier"}, set()),
    "A stale lock might explain it.": ({"morph.mod.epistemic_maymight"}, set()),
    "You should pin that version.": ({"morph.mod.deontic"}, set()),
    "It seems to need heavy traffic.": ({"morph.evid.inferential_seem"}, set()),
    "Perhaps a larger buffer helps.": ({"morph.hedge.adverbial_perhaps"}, set()),
    "The log is kind of noisy.": ({"morph.hedge.approximator_kind_of"}, set()),
    "The patch applies but the build hangs.": ({"morph.syn.adversative"}, set()),
    "Which node wrote it? The third one had the lease.": ({"morph.syn.question_answer"}, set()),
    "That flag is unclear and unreliable.": ({"affix.prefix.un"}, set()),
    "On-call was helpless that night.": ({"affix.suffix.less"}, set()),
    "What a questionable default.": ({"affix.suffix.able"}, set()),
    "Our interface stays.": (set(), {"affix.prefix.in"}),
    "An internal input index stays.": (set(), {"affix.prefix.in"}),
    "Beyond that it is uncharted ground.": ({"rhetor.metaphor.spatial.uncharted"}, set()),
    "It feels like starvation.": ({"rhetor.comparison.something_like"}, set()),
    "I do not fully understand that lock.": ({"morph.epi.neg_cognition"}, set()),
    "I think the lexer broke.": ({"morph.hedge.shield_think"}, set()),
    "Their patch has not shipped yet.": ({"morph.tense.past_nk_notyet"}, set()),
    "TODO here": ({"lex.todo"}, set()),
    "todo here": (set(), {"lex.todo"}),
    "don't know": ({"lex.dont_know"}, set()),
}
SILENT = ["The port runs well.", "The nightly build went green.", "The revert went into the stable line."]


@pytest.fixture(scope="module")
def fired(spark):
    texts = [*GOLDEN, *SILENT, "", " ", "?" * 50, "word " * 3000]
    units = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "text_unit_id string, text string")
    rows = annotate.signals(units).collect()
    out = {t: [] for t in texts}
    for r in rows:
        text = texts[int(r.text_unit_id)]
        assert text[r.span_start : r.span_end] == r.surface_form
        out[text].append(r)
    assert len({r.signal_id for r in rows}) == len(rows)
    return out


@pytest.mark.parametrize("text", GOLDEN)
def test_golden(fired, text):
    got = {r.rule_id for r in fired[text]}
    must, never = GOLDEN[text]
    assert must <= got and not never & got


def test_silent(fired):
    assert not any(r.layer in ("lexical", "rhetorical") for t in SILENT for r in fired[t])


def test_affix_table(spark):
    un, inn = next(a for a in rules.affixes() if a.affix == "un"), next(a for a in rules.affixes() if a.affix == "in")
    from pyspark.sql import functions as F

    def hits(a, words):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        return {r.w for r in df.filter(annotate.affix_hit(a, F.col("w"))).collect()}

    assert hits(inn, "income index initial input interface instance inaccurate incomplete".split()) == {"inaccurate", "incomplete"}
    assert hits(un, "underspecified understand until unclear unreliable unit".split()) == {"unclear", "unreliable"}


@pytest.mark.parametrize("version, lexical, patterns, figures, affixes", [("0.2", 72, 27, 16, 9), ("0.1", 20, 19, 11, 6)])
def test_integrity(version, lexical, patterns, figures, affixes):
    by = {}
    for a in rules.alternatives(version):
        by.setdefault(a.layer, set()).add(a.rule_id)
        assert 1 <= len(a.slots) <= rules.SLOTS and a.slots[0]
    assert (len(by["lexical"]), len(by["morpho_syntactic"]), len(by["rhetorical"]), len(rules.affixes(version))) == (lexical, patterns, figures, affixes)
    assert ("rhetor.comparison.kind_of" in by["rhetorical"]) == (version == "0.1") and "rhetor.comparison.something_like" in by["rhetorical"]


def test_plug_in_layer(spark):
    units = spark.createDataFrame([("1", "maybe")], "text_unit_id string, text string")
    mine = lambda u, version: annotate.rule_signals(u, version).limit(0)
    assert annotate.signals(units, layers={"mine": mine}).count() == 0


def test_classifier_protocol(spark):
    units = spark.createDataFrame([("1", "maybe"), ("2", "fine"), ("3", "")], "text_unit_id string, text string")
    v = {r.text_unit_id: r.label for r in annotate.verdicts(units).collect()}
    assert v == {"1": 1, "2": 0, "3": 0}
    assert annotate.verdicts(units, lambda texts: [(1, 0.9)] * len(texts), "m").filter("label = 1 AND model_id = 'm'").count() == 3


def test_one_pass_over_the_pieces(spark):
    """The rules and the affixes read a text's pieces once, only what may match is placed, and the matches are those of each alone."""
    texts = ["I don't know, CANNOT tell; we can't, of course.", "It is in use, into it, incomplete and useless, a kind of input.", "", "of", "n't unclear n'tn't", "x " * 400 + "in accord, incorrect; no idea"]
    units = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "text_unit_id string, text string")
    both = annotate.signals(units, layers={k: annotate.LAYERS[k] for k in ("rules", "affixes")})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1
    rows = lambda df: sorted(str(r) for r in df.collect())
    apart = annotate.rule_signals(units).unionByName(annotate.affix_signals(units))
    assert rows(both) == rows(apart) and both.count() > 10
    text = dict(enumerate(texts))
    assert all(text[int(r.text_unit_id)][r.span_start : r.span_end] == r.surface_form for r in both.collect())
