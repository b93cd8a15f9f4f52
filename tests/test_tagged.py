"""Rules over hand-tagged sentences: lemmas, parts of speech and dependencies."""

import pytest

from quaesitor.operators import annotate, rules, rulesets, tagged


def tag(sentence):
    """(text, tokens) of `word/lemma/POS/TAG/dep/head` entries; words are parted by one space unless they begin with `_`."""
    text, tokens = "", []
    for entry in sentence.split():
        word, lemma, pos, kind, dep, head = entry.split("/")
        glued, word = word.startswith("_"), word.removeprefix("_")
        text += "" if glued or not text else " "
        tokens.append({"text": word, "lemma": lemma, "pos": pos, "tag": kind, "dep": dep, "head": int(head), "start": len(text), "end": len(text) + len(word)})
        text += word
    return text, tokens


SENTENCES = {
    "noun": "A/a/DET/DT/det/1 doubt/doubt/NOUN/NN/nsubj/2 stays/stay/VERB/VBZ/ROOT/2",
    "verb": "I/I/PRON/PRP/nsubj/1 doubt/doubt/VERB/VBP/ROOT/1 it/it/PRON/PRP/dobj/1",
    "far": "I/I/PRON/PRP/nsubj/5 honestly/honestly/ADV/RB/advmod/5 do/do/AUX/VBP/aux/5 not/not/PART/RB/neg/5 even/even/ADV/RB/advmod/5 know/know/VERB/VB/ROOT/5",
    "they": "They/they/PRON/PRP/nsubj/3 do/do/AUX/VBP/aux/3 not/not/PART/RB/neg/3 know/know/VERB/VB/ROOT/3",
    "modal": "You/you/PRON/PRP/nsubj/3 ca/can/AUX/MD/aux/3 _n't/not/PART/RB/neg/3 tell/tell/VERB/VB/ROOT/3",
    "shield": "I/I/PRON/PRP/nsubj/1 think/think/VERB/VBP/ROOT/1 the/the/DET/DT/det/3 lexer/lexer/NOUN/NN/nsubj/4 broke/break/VERB/VBD/ccomp/1",
    "bare": "I/I/PRON/PRP/nsubj/1 think/think/VERB/VBP/ROOT/1",
    "yet": "It/it/PRON/PRP/nsubj/3 has/have/AUX/VBZ/aux/3 not/not/PART/RB/neg/3 shipped/ship/VERB/VBN/ROOT/3 to/to/ADP/IN/prep/3 anyone/anyone/PRON/NN/pobj/4 yet/yet/ADV/RB/advmod/5",
    "idea": "No/no/DET/DT/det/1 idea/idea/NOUN/NN/ROOT/1",
    "affix": "unclear/unclear/ADJ/JJ/ROOT/0 Unger/Unger/PROPN/NNP/appos/0",
    "outside": "doubt/doubt/NOUN/NN/ROOT/99",
    "none": "",
}


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(name, *tag(s)) for name, s in SENTENCES.items()] + [("null", None, None)]
    out = tagged.signals(spark.createDataFrame(rows, f"text_unit_id string, text string, tokens {tagged.TOKENS}"))
    assert out.columns == annotate.SIGNAL
    got = {}
    for r in out.collect():
        assert tag(SENTENCES[r.text_unit_id])[0][r.span_start : r.span_end] == r.surface_form
        got.setdefault(r.text_unit_id, {})[r.rule_id] = r.surface_form
    return got


@pytest.mark.parametrize(
    "name, rule, surface",
    [
        ("noun", "lex.doubt_n", "doubt"), ("verb", "lex.doubt_v", "doubt"), ("outside", "lex.doubt_n", "doubt"),
        ("far", "morph.epi.neg_cognition", "I honestly do not even know"), ("modal", "morph.epi.neg_cognition_modal", "can't tell"),
        ("shield", "morph.hedge.shield_think", "I think the lexer broke"), ("yet", "morph.tense.past_nk_notyet", "not shipped to anyone yet"),
        ("idea", "morph.neg.scoped_epistemic", "No idea"), ("affix", "affix.prefix.un", "unclear"),
    ],
)
def test_fires(fired, name, rule, surface):
    assert fired[name][rule] == surface


@pytest.mark.parametrize("name, rule", [("noun", "lex.doubt_v"), ("verb", "lex.doubt_n"), ("they", "morph.epi.neg_cognition"), ("bare", "morph.hedge.shield_think")])
def test_stays_silent(fired, name, rule):
    assert rule not in fired.get(name, {})


def test_edges(fired):
    assert "none" not in fired and "null" not in fired and list(v for k, v in fired["affix"].items() if k == "affix.prefix.un") == ["unclear"]


def test_patterns_are_well_formed():
    given = dict(line.split(" | ") for line in tagged.DEPENDENCIES.strip().splitlines())
    assert sorted(given) == sorted(rules.scoped_rules())
    for text in given.values():
        nodes = tagged.dependency(text)
        assert nodes[0][0] == -1 and all(0 <= g < k and r in (">", ">>") and a for k, (g, r, a) in enumerate(nodes) if k)
    for bad in ("a LOWER=x ; b > c DEP=neg", "a LOWER=x ; c DEP=neg"):
        with pytest.raises(ValueError):
            tagged.dependency(bad)
    for version in ("0.1", "0.2"):
        assert all(tagged.sequence(r[1]) for r in rulesets.table("PATTERNS", version) if r[1] != "DEP")


def test_cycles_end():
    tokens = [{"text": w, "lemma": w, "pos": "VERB", "tag": "", "dep": d, "head": h, "start": 0, "end": 1} for w, d, h in (("go", "x", 1), ("not", "neg", 0), ("yet", "x", 1))]
    assert list(tagged.find_dependency(tokens, tagged.dependency("verb LOWER=go ; verb > neg DEP=neg ; verb >> yet LOWER=yet"))) == [(0, 2)]
