"""The rule sets over text that a tagger and a parser have read: predicates on lemmas, parts of speech and dependencies.

A unit has `tokens`, an array of struct<text, lemma, pos, tag, dep, head, start, end>;
head is the place of the governing token (its own for a root). Trees are walked
per unit in Arrow batches: no shuffle, and a unit is all that a match can see.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import annotate, rules, rulesets

#: The dependency rules. Nodes are parted by `;`: a name and what its token must be, after the first with a governor and `>` (child) or `>>` (below it).
DEPENDENCIES = """
morph.epi.neg_cognition | verb LEMMA=know/understand/tell/figure/grasp/recall/remember/get/follow/comprehend ; verb > neg DEP=neg ; verb > subj LOWER=i/we DEP=nsubj
morph.epi.neg_cognition_modal | verb LEMMA=tell/figure/know/say/determine/explain/understand ; verb > aux LOWER=ca/could/can/wo/would TAG=MD ; verb > neg DEP=neg
morph.hedge.shield_think | verb LEMMA=think/believe/guess/suppose/assume/suspect/reckon/imagine POS=VERB ; verb > subj LOWER=i DEP=nsubj ; verb > comp DEP=ccomp/xcomp/acomp
morph.neg.scoped_epistemic | head LEMMA=idea/clue/evidence/reason/explanation/way/knowledge/sure/clear/certain/obvious ; head > neg LOWER=no/not/n't/never
morph.tense.past_nk_notyet | verb POS=VERB/AUX ; verb > neg DEP=neg ; verb >> yet LOWER=yet
"""
#: Parts of speech that affixes are looked for in, and entries whose part of speech is not asked for.
AFFIX_POS = frozenset(("ADJ", "NOUN", "VERB", "ADV"))
ANY_POS = frozenset(("PHRASE", "X"))
TOKENS = "array<struct<text:string,lemma:string,pos:string,tag:string,dep:string,head:int,start:int,end:int>>"

Attributes = dict[str, frozenset[str]]


def attributes(words: list[str]) -> Attributes:
    return {k: frozenset(v.split("/")) for k, _, v in (w.partition("=") for w in words)}


def dependency(text: str) -> list[tuple[int, str, Attributes]]:
    """(place of the governor or -1, relation, attributes) of each node; a relation that is unknown or a governor that is not named raises ValueError."""
    at: dict[str, int] = {}
    out = []
    for part in text.split(" ; "):
        words = part.split()
        if len(words) > 2 and words[1] in (">", ">>"):
            if words[0] not in at:
                raise ValueError(f"no node {words[0]} before {part}")
            governor, relation, name, rest = at[words[0]], words[1], words[2], words[3:]
        else:
            governor, relation, name, rest = -1, "", words[0], words[1:]
            if out:
                raise ValueError(f"a second root: {part}")
        at[name] = len(out)
        out.append((governor, relation, attributes(rest)))
    return out


def sequence(text: str) -> list[list[Attributes]]:
    """The token predicates of a pattern of the rule set, optional slots taken and left."""
    choices = []
    for raw in text.split():
        optional = raw != "?" and raw.endswith("?")
        slot: Attributes = {}
        for part in (raw[:-1] if optional else raw).split("&"):
            if part.startswith("~"):
                slot["LEMMA"] = frozenset(part[1:].split("/"))
            elif part.startswith("@"):
                slot["POS"] = frozenset(part[1:].split("/"))
            else:
                slot["LOWER"] = frozenset((part,) if part == "/" else part.split("/"))
        choices.append([slot, None] if optional else [slot])
    return [[s for s in picked if s is not None] for picked in itertools.product(*choices)]


def value(token: dict, key: str) -> str | None:
    return (token["text"] or "").lower() if key == "LOWER" else token[key.lower()]


def fits(token: dict, attrs: Attributes) -> bool:
    return all(value(token, k) in allowed for k, allowed in attrs.items())


def find_sequence(tokens: list[dict], slots: list[Attributes]) -> Iterator[tuple[int, int]]:
    """(first, last) of each place where the slots fit neighbouring tokens."""
    for i in range(len(tokens) - len(slots) + 1):
        if slots and all(fits(tokens[i + k], s) for k, s in enumerate(slots)):
            yield i, i + len(slots) - 1


def find_dependency(tokens: list[dict], nodes: list[tuple[int, str, Attributes]]) -> Iterator[tuple[int, int]]:
    """(first, last) of the tokens of each way to place the nodes on the tree, all different."""
    below: list[list[int]] = [[] for _ in tokens]
    for k, t in enumerate(tokens):
        if t["head"] is not None and t["head"] != k and 0 <= t["head"] < len(tokens):
            below[t["head"]].append(k)

    def reached(k: int, relation: str) -> list[int]:
        if relation == ">":
            return below[k]
        seen, todo = {k}, list(below[k])
        for j in todo:  # grows while it is read
            if j not in seen:
                seen.add(j)
                todo += below[j]
        return sorted(seen - {k})

    def place(chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(chosen) == len(nodes):
            yield chosen
            return
        governor, relation, attrs = nodes[len(chosen)]
        for j in range(len(tokens)) if governor < 0 else reached(chosen[governor], relation):
            if j not in chosen and fits(tokens[j], attrs):
                yield from place((*chosen, j))

    for chosen in place(()):
        yield min(chosen), max(chosen)


def root_of(tokens: list[dict], first: int, last: int) -> dict:
    """The first token of a span that is governed from outside it, or is a root."""
    return next((t for k, t in enumerate(tokens[first : last + 1], first) if t["head"] is None or t["head"] == k or not first <= t["head"] <= last), tokens[first])


def affix_fires(a: rules.Affix, word: str) -> bool:
    """Whether a lower-case word fires an affix rule: the allowed words beat the blocked ones."""
    if a.kind == "prefix":
        shape, blocked = word.startswith(a.affix) and len(word) - len(a.affix) >= a.least, any(word.startswith(b) if len(b) > len(a.affix) else word == b for b in a.blocked)
    else:
        shape, blocked = word.endswith(a.affix) and len(word) >= a.least, word in a.blocked
    return shape and (word in a.allowed or not (a.listed_only or blocked))


def matches(tokens: list[dict], version: str = "0.2") -> list[tuple]:
    """(first, last, rule_id, layer, category, subcategory, weight, status, lemma, pos, polarity) of all rules in one unit."""
    out = []
    for rule_id, lemma, pos, category, sub, polarity, weight, status in rulesets.table("LEXICON", version):
        name = rule_id if rule_id.startswith("lex.") else f"lex.{rule_id}"
        words = [slot[0] for slot in rules._phrase(lemma)]
        for i in range(len(tokens) - len(words) + 1):
            if all(w in (tokens[i + k]["lemma"], (tokens[i + k]["text"] or "").lower()) for k, w in enumerate(words)):
                if (pos or "") in ANY_POS or root_of(tokens, i, i + len(words) - 1)["pos"] == pos:
                    out.append((i, i + len(words) - 1, name, "lexical", category, sub, rules._number(weight), status or "active", lemma, pos, polarity))
    trees = dict(line.split(" | ") for line in DEPENDENCIES.strip().splitlines())
    for rule_id, text, category, sub, weight, status in rulesets.table("PATTERNS", version):
        spans = find_dependency(tokens, dependency(trees[rule_id])) if text == "DEP" else itertools.chain.from_iterable(find_sequence(tokens, s) for s in sequence(text))
        out += [(*s, rule_id, "morpho_syntactic", category, sub, rules._number(weight), status or "active", None, None, None) for s in spans]
    for rule_id, family, subtype, texts, weight, status in rulesets.table("FIGURES", version):
        for text in texts.split(" ; "):
            out += [(*s, rule_id, "rhetorical", family, subtype, rules._number(weight), status or "active", None, None, None) for slots in sequence(text) for s in find_sequence(tokens, slots)]
    for k, t in enumerate(tokens):
        word = (t["text"] or "").lower()
        if t["pos"] in AFFIX_POS and word.isalpha():
            out += [(k, k, a.rule_id, "word_formation", a.category, a.subcategory, a.weight, a.status, word, t["pos"], a.polarity) for a in rules.affixes(version) if affix_fires(a, word)]
    least: dict[tuple[int, str], tuple] = {}
    for m in sorted(out, key=lambda m: (m[0], m[2], m[1])):
        least.setdefault((m[0], m[2]), m)
    return list(least.values())


def signals(units: DataFrame, version: str = "0.2") -> DataFrame:
    """Signals of the rule sets over tagged units (text_unit_id, text, tokens): one per rule and start, the shortest.

    Null or empty token lists give nothing; heads that point outside count as
    roots; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, text, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                for first, last, *rest in matches(tokens or [], version):
                    begin = tokens[first]["start"]
                    rows.append((unit, begin, (text or "")[begin : tokens[last]["end"]], *rest))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    names = ["text_unit_id", *[f.split()[0] for f in annotate.MATCH.split(", ")]]
    kinds = [pa.string(), *[{"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in annotate.MATCH.split(", ")]]
    found = units.select("text_unit_id", "text", "tokens").mapInArrow(run, f"text_unit_id string, {annotate.MATCH}")
    return annotate._signals(found, version)
