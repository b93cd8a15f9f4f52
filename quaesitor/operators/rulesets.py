"""Rule sets by version, as data.

Fixed values, in their natural order; columns are parted by ` | `, `-` is none.
A pattern is a sequence of slots: `a/b` one of these lower-case words, `~a/b` a
form of one of these lemmas, `@POS` a part of speech, `?` an optional slot; `;`
parts the alternatives of a figure. DEP patterns are windows (see rules.py).
"""

LEXICON = "id | lemma | pos | category | subcategory | polarity | weight | status"
PATTERNS = "id | pattern | category | subcategory | weight | status"
FIGURES = "id | family | subtype | alternatives | weight | status"
AFFIXES = "kind | affix | id | category | subcategory | least length | mode | polarity | allowed | blocked | weight | status"

TEXT = """
LEXICON 0.2
uncertain | uncertain | ADJ | prototype | epistemic_state | neutral | 0.9 | active
unclear | unclear | ADJ | prototype | epistemic_state | neutral | 0.9 | active
doubt_n | doubt | NOUN | prototype | epistemic_state | neutral | 0.85 | active
doubt_v | doubt | VERB | prototype | epistemic_state | neutral | 0.85 | active
ignorance | ignorance | NOUN | prototype | epistemic_state | pejorative | 0.8 | active
unknown | unknown | ADJ | prototype | epistemic_state | neutral | 0.85 | active
vague | vague | ADJ | prototype | imprecision | pejorative | 0.8 | active
ambiguous | ambiguous | ADJ | prototype | imprecision | neutral | 0.8 | active
lack_of | lack of | PHRASE | shared_feature | absence_of_X | pejorative | 0.6 | active
missing | missing | ADJ | shared_feature | absence_of_X | neutral | 0.5 | candidate
unresolved | unresolved | ADJ | shared_feature | pending_resolution | neutral | 0.6 | active
blind_spot | blind spot | PHRASE | fixed_phrase | visibility_metaphor | pejorative | 0.85 | active
knowledge_gap | knowledge gap | PHRASE | fixed_phrase | gap_phrase | pejorative | 0.85 | active
risk | risk | NOUN | shared_feature | decision_under_uncertainty | neutral | 0.3 | candidate
controversy | controversy | NOUN | shared_feature | disagreement | neutral | 0.3 | candidate
error_n | error | NOUN | shared_feature | defect | pejorative | 0.2 | candidate
bug | bug | NOUN | shared_feature | defect | pejorative | 0.2 | candidate
no_idea | no idea | PHRASE | prototype | not_knowing | neutral | 0.95 | active
no_clue | no clue | PHRASE | prototype | not_knowing | neutral | 0.95 | active
not_sure | not sure | PHRASE | prototype | not_knowing | neutral | 0.9 | active
unsure | unsure | ADJ | prototype | not_knowing | neutral | 0.9 | active
dont_know | don't know | PHRASE | prototype | not_knowing | neutral | 0.9 | active
hard_to_tell | hard to tell | PHRASE | prototype | not_knowing | neutral | 0.85 | active
hard_to_say | hard to say | PHRASE | prototype | not_knowing | neutral | 0.85 | active
who_knows | who knows | PHRASE | prototype | not_knowing | neutral | 0.8 | active
cant_tell | can't tell | PHRASE | prototype | not_knowing | neutral | 0.85 | active
not_clear_to_me | not clear to me | PHRASE | prototype | not_knowing | neutral | 0.85 | active
confused | confused | ADJ | prototype | not_knowing | neutral | 0.7 | active
clueless | clueless | ADJ | prototype | not_knowing | pejorative | 0.75 | candidate
idk | idk | X | prototype | not_knowing | neutral | 0.9 | active
guess_v | guess | VERB | prototype | plausibility_shield | neutral | 0.6 | active
suppose_v | suppose | VERB | prototype | plausibility_shield | neutral | 0.6 | active
assume_v | assume | VERB | prototype | plausibility_shield | neutral | 0.6 | active
suspect_v | suspect | VERB | prototype | plausibility_shield | neutral | 0.6 | active
reckon_v | reckon | VERB | prototype | plausibility_shield | neutral | 0.6 | candidate
flaky | flaky | ADJ | shared_feature | non_deterministic_behaviour | pejorative | 0.8 | active
cannot_reproduce | cannot reproduce | PHRASE | shared_feature | repro_gap | neutral | 0.85 | active
no_repro | no repro | PHRASE | shared_feature | repro_gap | neutral | 0.85 | active
works_on_my_machine | works on my machine | PHRASE | fixed_phrase | repro_gap | neutral | 0.9 | active
heisenbug | heisenbug | NOUN | shared_feature | non_deterministic_behaviour | pejorative | 0.85 | active
intermittent | intermittent | ADJ | shared_feature | non_deterministic_behaviour | neutral | 0.6 | candidate
black_box | black box | PHRASE | fixed_phrase | opacity | neutral | 0.75 | active
magic | magic | NOUN | shared_feature | opacity | neutral | 0.5 | candidate
voodoo | voodoo | NOUN | shared_feature | opacity | pejorative | 0.7 | candidate
cargo_cult | cargo cult | PHRASE | fixed_phrase | opacity | pejorative | 0.75 | candidate
undefined_behaviour | undefined behaviour | PHRASE | shared_feature | spec_gap | pejorative | 0.85 | active
undefined_behavior | undefined behavior | PHRASE | shared_feature | spec_gap | pejorative | 0.85 | active
unspecified | unspecified | ADJ | shared_feature | spec_gap | neutral | 0.7 | active
underspecified | underspecified | ADJ | shared_feature | spec_gap | neutral | 0.75 | active
implementation_defined | implementation-defined | ADJ | shared_feature | spec_gap | neutral | 0.7 | candidate
undocumented | undocumented | ADJ | shared_feature | doc_gap | neutral | 0.7 | active
todo | TODO | X | shared_feature | code_comment_marker | neutral | 0.4 | candidate
fixme | FIXME | X | shared_feature | code_comment_marker | pejorative | 0.5 | candidate
hack_marker | HACK | X | shared_feature | code_comment_marker | pejorative | 0.4 | candidate
iirc | iirc | X | prototype | plausibility_shield | neutral | 0.8 | active
afaik | afaik | X | prototype | attribution_shield | neutral | 0.8 | active
afaict | afaict | X | prototype | attribution_shield | neutral | 0.8 | active
apparently | apparently | ADV | prototype | evidential_inferential | neutral | 0.7 | active
seemingly | seemingly | ADV | prototype | evidential_inferential | neutral | 0.7 | active
supposedly | supposedly | ADV | prototype | evidential_reportative | neutral | 0.7 | active
reportedly | reportedly | ADV | prototype | evidential_reportative | neutral | 0.7 | candidate
according_to | according to | PHRASE | prototype | evidential_reportative | neutral | 0.5 | candidate
obviously | obviously | ADV | prototype | booster | certainty | 0.0 | active
clearly | clearly | ADV | prototype | booster | certainty | 0.0 | active
definitely | definitely | ADV | prototype | booster | certainty | 0.0 | active
certainly | certainly | ADV | prototype | booster | certainty | 0.0 | active
of_course | of course | PHRASE | prototype | booster | certainty | 0.0 | active
no_doubt | no doubt | PHRASE | prototype | booster | certainty | 0.0 | active
and_so_on | and so on | PHRASE | shared_feature | general_extender | neutral | 0.4 | candidate
or_something | or something | PHRASE | shared_feature | general_extender | neutral | 0.5 | candidate
or_whatever | or whatever | PHRASE | shared_feature | general_extender | neutral | 0.5 | candidate
stuff_like_that | stuff like that | PHRASE | shared_feature | general_extender | neutral | 0.4 | candidate
PATTERNS 0.2
morph.epi.neg_cognition | DEP | epistemic_verb | not_knowing | 1.0 | active
morph.epi.neg_cognition_modal | DEP | epistemic_verb | not_knowing | 1.0 | active
morph.hedge.shield_think | DEP | hedging | plausibility_shield | 0.8 | active
morph.hedge.shield_asfaras | as far as i/we | hedging | attribution_shield | 0.85 | active
morph.evid.inferential_seem | ~seem/appear/look/sound&@VERB | evidential | inferential | 0.75 | active
morph.evid.inferential_suggest | ~suggest/indicate/imply&@VERB | evidential | inferential | 0.6 | active
morph.mod.epistemic_maymight | may/might | modality | epistemic | 0.8 | active
morph.mod.epistemic_must_be | must ~be/have | modality | epistemic | 0.7 | active
morph.mod.epistemic_will_predict | will/'ll/ll | modality | epistemic_prediction | 0.5 | candidate
morph.mod.underspecified_cancould | can/could/would | modality | underspecified | 0.2 | candidate
morph.mod.deontic | should/shall/ought/must | modality | deontic | 0.4 | active
morph.hedge.adverbial_perhaps | perhaps/possibly/probably/presumably/arguably/conceivably | hedging | adverbial | 0.7 | active
morph.hedge.adverbial_maybe | maybe/likely/unlikely | hedging | adverbial | 0.7 | active
morph.hedge.approximator_kind_of | kind/sort of | hedging | approximator | 0.6 | active
morph.hedge.approximator_somehow | somehow/somewhat/roughly/approximately | hedging | approximator | 0.5 | active
morph.neg.scoped_epistemic | DEP | negation | scoped_epistemic | 0.9 | active
morph.neg.bare_modifier | not/n't/never | negation | bare_negation | 0.15 | candidate
morph.neg.quantifier_no_det | no&@DET | negation | quantifier_no | 0.3 | candidate
morph.neg.nobody_nothing | nobody/nothing/nowhere/neither | negation | quantifier_no | 0.3 | candidate
morph.tense.past_nk_notyet | DEP | tense | past_nk | 0.6 | active
morph.tense.future_nk_will_never | will/'ll never? know/tell/find? never | tense | future_nk | 0.6 | active
morph.tense.future_nk_wont_know | wo/won't/wont/cannot/ca/can't n't? know/tell/say/determine | tense | future_nk | 0.7 | active
morph.syn.adversative | but/however/although/though/nevertheless/nonetheless | syntactic_pattern | adversative | 0.2 | candidate
morph.syn.embedded_question | wonder/unsure/unclear? whether/if/why/how/what/which/where/when | syntactic_pattern | embedded_question | 0.8 | active
morph.syn.i_wonder | i/we wonder | syntactic_pattern | embedded_question | 0.85 | active
morph.syn.tag_question | , right/no/correct/yeah ? | syntactic_pattern | tag_question | 0.6 | candidate
morph.syn.question_mark | ? | syntactic_pattern | question_mark | 0.1 | candidate
FIGURES 0.2
rhetor.metaphor.spatial.uncharted | metaphor | spatial_journey | uncharted ; unmapped ; terra incognita | 0.75 | active
rhetor.metaphor.spatial.new_territory | metaphor | spatial_journey | stepping/venturing/moving into unknown/new/uncharted ; new territory/terrain/ground ; unknown territory/terrain/ground | 0.65 | active
rhetor.metaphor.visibility.blind_spot | metaphor | visibility | blind spot ; blind spots | 0.8 | active
rhetor.metaphor.visibility.dark | metaphor | visibility | in the dark ; shot in the dark ; dark area/zone/corner | 0.7 | active
rhetor.metaphor.visibility.overlook | metaphor | visibility | ~overlook&@VERB ; easy to miss | 0.55 | candidate
rhetor.metaphor.gap.knowledge_gap | metaphor | container | knowledge gap/gaps/hole/holes ; research gap/gaps ; information gap/gaps | 0.8 | active
rhetor.metaphor.gap.missing_piece | metaphor | container | missing piece/part/link/step | 0.65 | active
rhetor.comparison.something_like | comparison | approximator | something like ; looks like ; feels like ; acts like | 0.5 | active
rhetor.personification.poor_cousin | personification | poor_cousin | poor cousin ; poor relative/sibling/relation | 0.5 | candidate
rhetor.personification.elephant_room | personification | avoidance | elephant in the room | 0.7 | active
rhetor.metaphor.opacity.black_box | metaphor | opacity | black box/boxes ; opaque | 0.7 | active
rhetor.metaphor.opacity.magic | metaphor | opacity | some magic ; voodoo/witchcraft/wizardry ; black art/magic/arts | 0.55 | candidate
rhetor.metaphor.obscurity.fog | metaphor | obscurity | foggy/murky/hazy/cloudy/fuzzy/nebulous ; a bit fuzzy/hazy | 0.6 | candidate
rhetor.metaphor.depth.iceberg | metaphor | hidden_extent | tip of the iceberg | 0.7 | active
rhetor.metaphor.depth.rabbit_hole | metaphor | hidden_extent | rabbit hole ; down the rabbit hole | 0.6 | candidate
rhetor.metaphor.depth.can_of_worms | metaphor | hidden_extent | can of worms | 0.65 | candidate
AFFIXES 0.2
prefix | un | affix.prefix.un | affix_negation | un_prefix | 4 | scan | - | unclear unknown uncertain undefined unspecified undocumented unresolved unpredictable unexplained unreliable unstable unexpected unfamiliar | under until unit union unique university unless update upload url use user utf | 0.5 | active
prefix | in | affix.prefix.in | affix_negation | in_prefix | 4 | scan | - | incomplete inconsistent inconclusive indeterminate indefinite insufficient incorrect invalid | income index initial input install integer interface interior internal issue info init inline into include instance int in | 0.4 | active
prefix | non | affix.prefix.non | affix_negation | non_prefix | 3 | scan | - |  |  | 0.7 | active
prefix | dis | affix.prefix.dis | affix_negation | dis_prefix | 4 | scan | - |  | display distribute dispatch distance district discuss distinct | 0.4 | candidate
prefix | under | affix.prefix.under | affix_negation | under_prefix | 5 | scan | - | underspecified underdocumented underdetermined underdefined understudied undertested | understand understood underscore underlying undergo underneath | 0.55 | active
prefix | mis | affix.prefix.mis | affix_negation | mis_prefix | 4 | scan | - | misunderstand misunderstood misunderstanding misinterpret misinterpreted misread misleading misconception | miss missing mission missile | 0.5 | candidate
suffix | less | affix.suffix.less | affix_negation | less_suffix | 6 | scan | - |  | unless less bless regardless nonetheless | 0.45 | active
suffix | able | affix.suffix.able | shared_feature | epistemic_potentiality | 6 | allowlist_only | - | questionable debatable unpredictable undecidable unknowable unverifiable unfalsifiable unexplainable inexplicable unaccountable unprovable | able table stable cable enable disable reproducible testable configurable serializable readable available | 0.5 | active
suffix | free | affix.suffix.free | shared_feature | privative_certainty | 6 | scan | certainty |  | free freeze | 0.0 | candidate
LEXICON 0.1
uncertain | uncertain | ADJ | prototype | epistemic_state | neutral | - | -
unclear | unclear | ADJ | prototype | epistemic_state | neutral | - | -
doubt_n | doubt | NOUN | prototype | epistemic_state | neutral | - | -
doubt_v | doubt | VERB | prototype | epistemic_state | neutral | - | -
ignorance | ignorance | NOUN | prototype | epistemic_state | pejorative | - | -
unknown | unknown | ADJ | prototype | epistemic_state | neutral | - | -
error_n | error | NOUN | prototype | error_or_failure | pejorative | - | -
bug | bug | NOUN | prototype | error_or_failure | pejorative | - | -
controversy | controversy | NOUN | prototype | controversy | neutral | - | -
risk | risk | NOUN | prototype | risk | neutral | - | -
lack_of | lack of | PHRASE | shared_feature | absence_of_X | pejorative | - | -
missing | missing | ADJ | shared_feature | absence_of_X | neutral | - | -
unresolved | unresolved | ADJ | shared_feature | pending_resolution | neutral | - | -
blind_spot | blind spot | PHRASE | fixed_phrase | visibility_metaphor | pejorative | - | -
knowledge_gap | knowledge gap | PHRASE | fixed_phrase | gap_phrase | pejorative | - | -
vague | vague | ADJ | prototype | imprecision | pejorative | - | -
ambiguous | ambiguous | ADJ | prototype | imprecision | neutral | - | -
flaky | flaky | ADJ | shared_feature | non_deterministic_behaviour | pejorative | - | -
undefined_behaviour | undefined behaviour | PHRASE | shared_feature | spec_gap | pejorative | - | -
undocumented | undocumented | ADJ | shared_feature | doc_gap | neutral | - | -
PATTERNS 0.1
morph.neg.adverbial_not | not | negation | adverbial_not | - | -
morph.neg.contraction_nt | n't/nt | negation | adverbial_not | - | -
morph.neg.temporal_never | never | negation | temporal_never | - | -
morph.neg.quantifier_no | no&@DET | negation | quantifier_no | - | -
morph.neg.nobody_nothing | nobody/nothing/nowhere/neither/nor | negation | quantifier_no | - | -
morph.mod.epistemic | can/could/may/might/would | modality | epistemic | - | -
morph.mod.deontic | must/should/shall/ought | modality | deontic | - | -
morph.mod.quasi_seem | ~seem/appear&@VERB | modality | quasi_modal | - | -
morph.mod.quasi_tend | ~tend/suggest/indicate&@VERB | modality | quasi_modal | - | -
morph.hedge.adverbial_perhaps | perhaps/possibly/probably/presumably/arguably/conceivably | hedging | adverbial | - | -
morph.hedge.adverbial_maybe | maybe/likely/unlikely | hedging | adverbial | - | -
morph.hedge.approximator_kind_of | kind/sort/type of | hedging | approximator | - | -
morph.hedge.approximator_somehow | somehow/somewhat/roughly/approximately/around/about | hedging | approximator | - | -
morph.tense.past_nk_yet | not yet? yet | tense | past_nk | - | -
morph.tense.future_nk_will_never | will never | tense | future_nk | - | -
morph.tense.future_nk_wont_know | won't/wont/cannot/can't know/tell/say/determine | tense | future_nk | - | -
morph.syn.adversative_but | but | syntactic_pattern | adversative | - | -
morph.syn.adversative_however | however/although/though/yet/nevertheless/nonetheless | syntactic_pattern | adversative | - | -
morph.syn.question_mark | ? | syntactic_pattern | question_answer | - | -
FIGURES 0.1
rhetor.metaphor.spatial.uncharted | metaphor | spatial_journey | uncharted ; unmapped ; terra incognita | - | -
rhetor.metaphor.spatial.new_territory | metaphor | spatial_journey | stepping/venturing/moving into unknown/new/uncharted ; new territory/terrain/ground ; unknown territory/terrain/ground | - | -
rhetor.metaphor.visibility.blind_spot | metaphor | visibility | blind spot ; blind spots | - | -
rhetor.metaphor.visibility.dark | metaphor | visibility | in the dark ; shot in the dark ; dark area/zone/corner | - | -
rhetor.metaphor.visibility.overlook | metaphor | visibility | ~overlook&@VERB ; easy to miss | - | -
rhetor.metaphor.gap.knowledge_gap | metaphor | container | knowledge gap/gaps/hole/holes ; research gap/gaps ; information gap/gaps | - | -
rhetor.metaphor.gap.missing_piece | metaphor | container | missing piece/part/link/step | - | -
rhetor.comparison.kind_of | comparison | approximator | kind/sort/type of ; a kind/sort/type of | - | -
rhetor.comparison.something_like | comparison | approximator | something like ; looks like ; feels like ; acts like | - | -
rhetor.personification.poor_cousin | personification | poor_cousin | poor cousin ; poor relative/sibling/relation | - | -
rhetor.personification.elephant_room | personification | avoidance | elephant in the room | - | -
AFFIXES 0.1
prefix | un | affix.prefix.un | affix_negation | un_prefix | 4 | scan | - |  | under until unit union unique university unless update upload url use user utf | - | -
prefix | in | affix.prefix.in | affix_negation | in_prefix | 4 | scan | - |  | income index initial input install integer interface interior internal issue info init inline into include instance int in | - | -
prefix | non | affix.prefix.non | affix_negation | non_prefix | 3 | scan | - |  |  | - | -
prefix | dis | affix.prefix.dis | affix_negation | dis_prefix | 4 | scan | - |  | display distribute dispatch | - | -
suffix | less | affix.suffix.less | affix_negation | less_suffix | 6 | scan | - |  | unless less | - | -
suffix | able | affix.suffix.able | affix_modality | able_suffix | 6 | scan | - |  | able table stable cable enable disable | - | -
"""


def table(kind: str, version: str) -> list[list[str | None]]:
    """The rows of one part (LEXICON, PATTERNS, FIGURES, AFFIXES) of a version."""
    out: list[list[str | None]] = []
    inside = False
    for line in TEXT.strip().splitlines():
        if " | " not in line:
            inside = line == f"{kind} {version}"
        elif inside:
            out.append([None if x.strip() in ("-", "None") else x.strip() for x in line.split("|")])
    return out
