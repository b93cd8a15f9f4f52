"""Compiles rule sets to fixed-length alternatives over token windows."""

from __future__ import annotations

import functools
import itertools
import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from . import rulesets

SLOTS = 8  # longest alternative

#: Irregular forms of lemmas that the rules name.
IRREGULAR = {
    "be": "be am is are was were been being", "have": "have has had having 've", "know": "know knows knew known knowing", "do": "do does did doing done",
    "understand": "understand understands understood understanding", "tell": "tell tells told telling", "get": "get gets got gotten getting",
    "think": "think thinks thought thinking", "say": "say says said saying", "find": "find finds found finding", "overlook": "overlook overlooks overlooked overlooking",
    "can": "can ca", "not": "not n't", "ca": "ca can", "n't": "n't not", "my": "my", "who": "who",
}
VERB_BEFORE = "i we you they he she it to not n't never would might could can will do does did should may must really still".split()
DETERMINERS = "a an the this that these those my your his her its our their no any some every each".split()
VERB_FORMS = {
    "cognition": "know understand tell figure grasp recall remember get follow comprehend",
    "modal_cognition": "tell figure know say determine explain understand",
    "thinking": "think believe guess suppose assume suspect reckon imagine",
    "heads": "idea clue evidence reason explanation way knowledge sure clear certain obvious",
}


def forms(lemma: str) -> list[str]:
    """Inflected forms of a lemma, itself first."""
    if lemma in IRREGULAR:
        return IRREGULAR[lemma].split()
    if not lemma.isalpha():
        return [lemma]
    stem = lemma[:-1] if lemma.endswith("e") else lemma
    plural = lemma[:-1] + "ies" if lemma.endswith("y") and lemma[-2] not in "aeiou" else lemma + ("es" if lemma[-1] in "sxz" or lemma[-2:] in ("ch", "sh") else "s")
    past = lemma[:-1] + "ied" if lemma.endswith("y") and lemma[-2] not in "aeiou" else stem + "ed"
    return list(dict.fromkeys([lemma, plural, past, stem + "ing"]))


def any_form(lemmas: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for lemma in lemmas.split() for f in forms(lemma)))


@dataclass(frozen=True)
class Alternative:
    """One fixed-length window of a rule: words by slot, an empty slot being any word; and what may stand beside it."""

    rule_id: str
    layer: str
    category: str
    subcategory: str | None
    weight: float | None
    status: str
    lemma: str | None
    pos: str | None
    polarity: str | None
    slots: tuple[tuple[str, ...], ...]
    before_in: tuple[str, ...] = ()
    before_not: tuple[str, ...] = ()
    word_after: bool = False
    cased: bool = False


def _number(x: str | None) -> float | None:
    return None if x is None else float(x)


def _phrase(lemma: str) -> tuple[tuple[str, ...], ...]:
    """The slots of a phrase: split as tokens are, each word in any form."""
    out: list[tuple[str, ...]] = []
    for word in lemma.lower().split():
        if word.endswith("n't"):
            parts = [word[:-3], "n't"]
        elif word == "cannot":
            parts = ["can", "not"]
        else:
            parts = [p for q in word.split("-") for p in (q, "-")][:-1]
        for part in parts:
            base = {"works": "work", "knows": "know"}.get(part, part)
            out.append((part,) if not part.isalpha() and part != "n't" else tuple(forms(base)))
    return tuple(out)


def _pattern(text: str) -> list[tuple[tuple[tuple[str, ...], ...], dict]]:
    """The alternatives of a token pattern, optional slots taken and left, with their context."""
    choices, context = [], {}
    for raw in text.split():
        optional = raw != "?" and raw.endswith("?")
        parts = (raw[:-1] if optional else raw).split("&")
        words: tuple[str, ...] = ()
        for part in parts:
            if part.startswith("~"):
                words = any_form(part[1:].replace("/", " "))
            elif part == "@VERB":
                context["before_not"] = tuple(DETERMINERS)
            elif part == "@DET":
                context["word_after"] = True
            elif part.startswith("@"):
                pass
            elif "n't" in part.split("/") or raw == "/":
                words = tuple(w for w in part.split("/") for w in ((w,) if w != "can't" and w != "won't" else (w,)))
            else:
                words = tuple(part.split("/"))
        choices.append([words, None] if optional else [words])
    return [(tuple(w for w in picked if w is not None), context) for picked in itertools.product(*choices)]


def _gap(least: int, most: int) -> list[tuple[tuple[str, ...], ...]]:
    return [((),) * n for n in range(least, most + 1)]


def _windows(rule_id: str) -> list[tuple[tuple[tuple[str, ...], ...], dict]]:
    """Surface windows within a sentence that stand for the dependency patterns; no punctuation stands in a gap."""
    one = lambda *groups: list(itertools.product(*groups))
    flat = lambda parts: tuple(s for p in parts for s in p)
    fixed = lambda words: [(tuple(words.split()),)]
    verbs = lambda name: [(any_form(VERB_FORMS[name]),)]
    made = {
        "morph.epi.neg_cognition": one(fixed("i we"), _gap(0, 2), fixed("not n't"), _gap(0, 2), verbs("cognition")),
        "morph.epi.neg_cognition_modal": one(fixed("ca can could wo would"), fixed("not n't"), _gap(0, 2), verbs("modal_cognition")),
        "morph.hedge.shield_think": one(fixed("i"), _gap(0, 2), verbs("thinking")),
        "morph.neg.scoped_epistemic": one(fixed("no not n't never"), _gap(0, 3), verbs("heads")),
        "morph.tense.past_nk_notyet": one(fixed("not n't never"), _gap(1, 4), fixed("yet")),
    }[rule_id]
    return [(flat(m), {"word_after": True} if rule_id.endswith("shield_think") else {}) for m in made]


def _read(kind: str, version: str, make: Callable[..., list]) -> list:
    """make(*row) over the rows of a part; a row that cannot be read is logged and left out, the others stay."""
    out = []
    for row in rulesets.table(kind, version):
        try:
            out += make(*row)
        except (ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
            logging.getLogger(__name__).warning("%s rule %r of version %s left out: %s", kind, row[:1], version, e)
    return out


def _lexical(rule_id, lemma, pos, category, sub, polarity, weight, status) -> list[Alternative]:
    base = Alternative(rule_id if rule_id.startswith("lex.") else f"lex.{rule_id}", "lexical", category, sub, _number(weight), status or "active", lemma, pos, polarity, _phrase(lemma), cased=lemma.isupper())
    if rule_id.endswith("doubt_v"):
        base = replace(base, before_in=tuple(VERB_BEFORE))
    elif rule_id.endswith("doubt_n"):
        base = replace(base, before_not=tuple(VERB_BEFORE))
    elif pos == "VERB":
        base = replace(base, before_not=tuple(DETERMINERS))
    return [base]


def _construction(rule_id, text, category, sub, weight, status) -> list[Alternative]:
    made = _windows(rule_id) if text == "DEP" else _pattern(text)
    return [Alternative(rule_id, "morpho_syntactic", category, sub, _number(weight), status or "active", None, None, None, slots, **context) for slots, context in made]


def _figure(rule_id, family, subtype, texts, weight, status) -> list[Alternative]:
    return [Alternative(rule_id, "rhetorical", family, subtype, _number(weight), status or "active", None, None, None, slots, **context) for text in texts.split(" ; ") for slots, context in _pattern(text)]


@functools.cache
def alternatives(version: str = "0.2") -> tuple[Alternative, ...]:
    """All alternatives of a version, in rule order. Rules that cannot be read are left out and the others stay."""
    return tuple(_read("LEXICON", version, _lexical) + _read("PATTERNS", version, _construction) + _read("FIGURES", version, _figure))


@dataclass(frozen=True)
class Affix:
    kind: str
    affix: str
    rule_id: str
    category: str
    subcategory: str
    least: int
    listed_only: bool
    polarity: str | None
    allowed: tuple[str, ...]
    blocked: tuple[str, ...]
    weight: float | None
    status: str


def _affix(kind, affix, rule_id, category, sub, least, mode, polarity, allowed, blocked, weight, status) -> list[Affix]:
    if kind not in ("prefix", "suffix"):
        raise ValueError(f"no such kind of affix: {kind}")
    return [Affix(kind, affix, rule_id, category, sub, int(least), mode == "allowlist_only", polarity, tuple((allowed or "").split()), tuple((blocked or "").split()), _number(weight), status or "active")]


@functools.cache
def affixes(version: str = "0.2") -> tuple[Affix, ...]:
    """All affix rules of a version, in order; those that cannot be read are left out."""
    return tuple(_read("AFFIXES", version, _affix))


def scoped_rules(version: str = "0.2") -> list[str]:
    return [r[0] for r in rulesets.table("PATTERNS", version) if r[1] == "DEP"]


def certainty_subcategories(version: str = "0.2") -> list[str]:
    """Subcategories whose polarity is certainty: never counted as evidence."""
    return sorted({r[4] for r in rulesets.table("LEXICON", version) if r[5] == "certainty"} | {a.subcategory for a in affixes(version) if a.polarity == "certainty"})
