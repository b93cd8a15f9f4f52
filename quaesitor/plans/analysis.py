"""The analysis queries, as SQL that runs on the engine's views and on the oracle's.

SET_OF(x) is the sorted set of the values of x that are not null, FIRST_OF(a, n)
the first n elements of an array; each engine spells them its own way.
"""

from __future__ import annotations

import re

from ..operators import rules

#: Subcategories and subtypes native to software engineering, and the layers.
SE_LEXICAL = "'repro_gap', 'opacity', 'spec_gap', 'doc_gap', 'code_comment_marker', 'non_deterministic_behaviour'"
SE_FIGURES = "'opacity', 'hidden_extent', 'obscurity'"
SCOPED = ", ".join(f"'{r}'" for r in rules.scoped_rules())
NON_NK = ", ".join(f"'{r}'" for r in rules.certainty_subcategories())
ARENA = "CASE WHEN u.parent_type = 'email' THEN 'mailing_list' ELSE 'github' END"
RATE = "round(CAST(1000 AS DOUBLE) * count(DISTINCT {0}) / (SELECT count(*) FROM text_units), 2)"
FLAGS = """per_unit AS (SELECT u.text_unit_id, coalesce(max(v.label), 0) = 1 AS clf, count(nk.signal_id) > 0 AS marker
  FROM text_units u LEFT JOIN verdicts v ON v.text_unit_id = u.text_unit_id LEFT JOIN nk ON nk.text_unit_id = u.text_unit_id GROUP BY u.text_unit_id)"""
MIX = f"""mix AS (SELECT {ARENA} AS arena, nk.layer, count(*) AS n FROM text_units u JOIN nk ON nk.text_unit_id = u.text_unit_id GROUP BY 1, 2)"""
LABELLED = """labelled AS (SELECT s.rule_id, s.signal_id, CASE WHEN v.confidence >= 0.75 THEN 1 ELSE 0 END AS yes FROM signals s JOIN verdicts v ON v.text_unit_id = s.text_unit_id)"""

BODIES: dict[str, str] = {
    # sanity and totals
    "q001_node_counts": "SELECT 'TextUnit' AS label, count(*) AS n FROM text_units UNION ALL SELECT 'Signal', count(*) FROM signals UNION ALL SELECT 'ClassifierVerdict', count(*) FROM verdicts UNION ALL SELECT 'EmailMessage', count(*) FROM mails ORDER BY n DESC, label",
    "q002_layer_status": "SELECT layer, CAST(sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN status = 'candidate' THEN 1 ELSE 0 END) AS BIGINT) AS candidate FROM signals GROUP BY layer",
    "u04_silent_layers": "SELECT e.layer FROM (SELECT 'lexical' AS layer UNION ALL SELECT 'morpho_syntactic' UNION ALL SELECT 'word_formation' UNION ALL SELECT 'rhetorical' UNION ALL SELECT 'classifier') e LEFT ANTI JOIN signals s ON s.layer = e.layer",
    "q003_rule_versions": "SELECT rule_version, count(*) AS n FROM signals GROUP BY rule_version",
    "q004_quotation_invariant": "SELECT count(*) AS quotations FROM text_units WHERE role = 'quotation'",
    "q005_arena_totals": f"SELECT {ARENA} AS arena, count(*) AS units, CAST(sum(token_count) AS BIGINT) AS tokens FROM text_units u GROUP BY 1",
    "q006_silent_units": "SELECT u.text_unit_id FROM text_units u LEFT ANTI JOIN signals s ON s.text_unit_id = u.text_unit_id",
    "q006b_orphan_signals": "SELECT count(*) AS orphans FROM signals s LEFT ANTI JOIN text_units u ON s.text_unit_id = u.text_unit_id",
    "q006c_verdict_distribution": "SELECT label, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM verdicts GROUP BY label",
    "q007_rule_counts": "SELECT rule_id, rule_version, count(*) AS n FROM signals GROUP BY rule_id, rule_version",
    "q008_unit_signals": "SELECT u.text_unit_id, u.role, s.rule_id, s.surface_form FROM text_units u JOIN signals s ON s.text_unit_id = u.text_unit_id",
    "q009_category_rollup": "SELECT layer, category, subcategory, count(*) AS n FROM signals GROUP BY ROLLUP(layer, category, subcategory)",
    "q009b_heatmap": "SELECT layer, category, count(*) AS n FROM signals GROUP BY layer, category",
    "q010_units_per_parent": "SELECT parent_id, count(*) AS units FROM text_units WHERE parent_type IN ('issue', 'pull_request') GROUP BY parent_id",
    # lexical
    "q101_lexical_inventory": f"SELECT s.category, s.subcategory, s.status, count(*) AS signals, count(DISTINCT s.text_unit_id) AS units, {RATE.format('s.text_unit_id')} AS rate_per_1k, s.subcategory IN ({SE_LEXICAL}) AS se_native FROM signals s WHERE s.layer = 'lexical' GROUP BY s.category, s.subcategory, s.status",
    "q102_se_native_share": f"SELECT round(CAST(sum(CASE WHEN subcategory IN ({SE_LEXICAL}) THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS share FROM signals WHERE layer = 'lexical' AND status = 'active'",
    "q103_top_rules": f"SELECT rule_id, subcategory, count(*) AS signals, {RATE.format('text_unit_id')} AS rate_per_1k FROM signals WHERE layer = 'lexical' AND status = 'active' GROUP BY rule_id, subcategory ORDER BY signals DESC, rule_id LIMIT 25",
    "q104_rate_per_source": "SELECT u.repo AS source, count(DISTINCT u.text_unit_id) AS units, count(DISTINCT CASE WHEN s.signal_id IS NOT NULL THEN u.text_unit_id END) AS nk_units, round(CAST(1000 AS DOUBLE) * count(DISTINCT CASE WHEN s.signal_id IS NOT NULL THEN u.text_unit_id END) / count(DISTINCT u.text_unit_id), 1) AS rate_per_1k FROM text_units u LEFT JOIN nk s ON s.text_unit_id = u.text_unit_id AND s.layer = 'lexical' GROUP BY u.repo",
    "q105_top_markers": "SELECT lemma, category, polarity, count(*) AS n FROM signals WHERE layer = 'lexical' GROUP BY lemma, category, polarity ORDER BY n DESC, lemma, category LIMIT 50",
    "q106_markers_by_verdict": "SELECT s.lemma, count(DISTINCT s.text_unit_id) AS units, count(DISTINCT s.signal_id) AS occurrences, count(DISTINCT CASE WHEN v.label = 0 THEN v.text_unit_id END) AS label_0, count(DISTINCT CASE WHEN v.label = 1 THEN v.text_unit_id END) AS label_1 FROM signals s LEFT JOIN verdicts v ON v.text_unit_id = s.text_unit_id WHERE s.layer = 'lexical' GROUP BY s.lemma",
    "q107_markers_by_role": "SELECT u.role, s.lemma, count(*) AS n FROM text_units u JOIN signals s ON s.text_unit_id = u.text_unit_id WHERE s.layer = 'lexical' GROUP BY u.role, s.lemma ORDER BY n DESC, u.role, s.lemma LIMIT 50",
    # constructions
    "q201_morpho_inventory": f"SELECT category, subcategory, status, count(*) AS signals, count(DISTINCT text_unit_id) AS units, round(avg(weight), 2) AS avg_weight, {RATE.format('text_unit_id')} AS rate_per_1k FROM signals WHERE layer = 'morpho_syntactic' GROUP BY category, subcategory, status",
    "q202_new_families": "SELECT category, subcategory, count(*) AS signals FROM signals WHERE layer = 'morpho_syntactic' AND (category IN ('epistemic_verb', 'evidential') OR subcategory IN ('plausibility_shield', 'attribution_shield')) GROUP BY category, subcategory",
    "q203_cue_scope": f"""WITH f AS (SELECT v.text_unit_id, coalesce(max(CASE WHEN s.rule_id IN ({SCOPED}) THEN 1 ELSE 0 END), 0) = 1 AS has_scoped, coalesce(max(CASE WHEN s.rule_id NOT IN ({SCOPED}) THEN 1 ELSE 0 END), 0) = 1 AS has_cue
      FROM verdicts v JOIN text_units u ON u.text_unit_id = v.text_unit_id LEFT JOIN signals s ON s.text_unit_id = v.text_unit_id AND s.layer = 'morpho_syntactic' AND s.status = 'active' WHERE v.label = 1 GROUP BY v.text_unit_id)
      SELECT has_scoped, has_cue, count(*) AS units FROM f GROUP BY has_scoped, has_cue""",
    "q204_scoped_rules": f"SELECT rule_id, count(*) AS signals, count(DISTINCT text_unit_id) AS units, FIRST_OF(SET_OF(surface_form), 5) AS samples FROM signals WHERE rule_id IN ({SCOPED}) GROUP BY rule_id",
    "q205_three_way": "SELECT text_unit_id FROM signals WHERE category IN ('negation', 'modality', 'hedging') GROUP BY text_unit_id HAVING count(DISTINCT category) = 3",
    "q206_layer_matrix": "WITH l AS (SELECT DISTINCT text_unit_id, layer FROM signals) SELECT a.layer AS layer_a, b.layer AS layer_b, count(*) AS units FROM l a JOIN l b ON a.text_unit_id = b.text_unit_id GROUP BY a.layer, b.layer",
    # figures
    "q301_figures": f"SELECT category AS family, subcategory AS subtype, status, count(*) AS signals, count(DISTINCT text_unit_id) AS units, {RATE.format('text_unit_id')} AS rate_per_1k, subcategory IN ({SE_FIGURES}) AS se_native FROM signals WHERE layer = 'rhetorical' GROUP BY category, subcategory, status",
    "q302_se_ratio": f"SELECT k.kind, CAST(sum(CASE WHEN s.subcategory IN ({SE_FIGURES}) THEN 1 ELSE 0 END) AS BIGINT) AS se_native, CAST(sum(CASE WHEN s.subcategory NOT IN ({SE_FIGURES}) THEN 1 ELSE 0 END) AS BIGINT) AS canonical, round(CAST(sum(CASE WHEN s.subcategory IN ({SE_FIGURES}) THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN s.subcategory NOT IN ({SE_FIGURES}) THEN 1 ELSE 0 END), 0), 4) AS ratio FROM signals s JOIN (SELECT 'active' AS kind, 'active' AS status UNION ALL SELECT 'all', 'active' UNION ALL SELECT 'all', 'candidate') k ON k.status = s.status WHERE s.layer = 'rhetorical' GROUP BY k.kind",
    "q303_density_by_arena": f"WITH t AS (SELECT {ARENA} AS arena, count(*) AS total FROM text_units u GROUP BY 1), r AS (SELECT {ARENA} AS arena, count(*) AS signals, count(DISTINCT u.text_unit_id) AS units FROM text_units u JOIN signals s ON s.text_unit_id = u.text_unit_id WHERE s.layer = 'rhetorical' GROUP BY 1) SELECT t.arena, r.signals, r.units, round(CAST(1000 AS DOUBLE) * r.units / t.total, 2) AS rate_per_1k FROM t JOIN r ON r.arena = t.arena",
    "q304_metaphors": "SELECT rule_id, count(*) AS n, FIRST_OF(SET_OF(surface_form), 10) AS examples FROM signals WHERE layer = 'rhetorical' AND category = 'metaphor' GROUP BY rule_id",
    # taxonomy
    "q401_unit_features": "SELECT v.text_unit_id, concat(nk.layer, '.', nk.category) AS feature, count(*) AS n, round(ln(CAST(1 + count(*) AS DOUBLE)), 6) AS weight FROM verdicts v JOIN nk ON nk.text_unit_id = v.text_unit_id WHERE v.label = 1 GROUP BY v.text_unit_id, concat(nk.layer, '.', nk.category)",
    "q405_coverage": "WITH m AS (SELECT 'lexical' AS layer, 'named' AS kind UNION ALL SELECT 'rhetorical', 'named' UNION ALL SELECT 'word_formation', 'residual'), t AS (SELECT coalesce(m.kind, 'unmapped') AS kind, count(DISTINCT s.text_unit_id) AS units FROM signals s LEFT JOIN m ON m.layer = s.layer GROUP BY 1) SELECT kind, units, round(CAST(units AS DOUBLE) / sum(units) OVER (), 4) AS share FROM t",
    # markers and classifier
    "q501_marker_clf_2x2": f"WITH {FLAGS} SELECT marker, clf, count(*) AS units FROM per_unit GROUP BY marker, clf",
    "q502_marker_only_sample": "SELECT u.text_unit_id, SET_OF(nk.rule_id) AS rules, max(left(u.text, 400)) AS text FROM text_units u JOIN nk ON nk.text_unit_id = u.text_unit_id LEFT ANTI JOIN (SELECT text_unit_id FROM verdicts WHERE label = 1) v ON v.text_unit_id = u.text_unit_id GROUP BY u.text_unit_id ORDER BY md5(u.text_unit_id), u.text_unit_id LIMIT 100",
    "q503_clf_only_sample": "SELECT v.text_unit_id, max(v.confidence) AS confidence FROM verdicts v JOIN text_units u ON u.text_unit_id = v.text_unit_id LEFT ANTI JOIN nk ON nk.text_unit_id = v.text_unit_id WHERE v.label = 1 GROUP BY v.text_unit_id ORDER BY md5(v.text_unit_id), v.text_unit_id LIMIT 100",
    "q504_rule_samples": "WITH f AS (SELECT rule_id FROM signals GROUP BY rule_id HAVING count(*) >= 100), r AS (SELECT s.rule_id, s.signal_id, s.surface_form, row_number() OVER (PARTITION BY s.rule_id ORDER BY md5(s.signal_id), s.signal_id) AS k FROM signals s JOIN f ON f.rule_id = s.rule_id) SELECT rule_id, signal_id, surface_form FROM r WHERE k <= 50",
    "q505_rule_precision": f"WITH {LABELLED} SELECT rule_id, count(*) AS size, round(avg(CAST(yes AS DOUBLE)), 4) AS prec, CASE WHEN avg(CAST(yes AS DOUBLE)) >= 0.70 THEN 'promote' ELSE 'keep' END AS advice FROM labelled GROUP BY rule_id",
    "q506_recall": f"WITH {FLAGS}, c AS (SELECT CAST(sum(CASE WHEN marker AND clf THEN 1 ELSE 0 END) AS DOUBLE) AS both_n, CAST(sum(CASE WHEN NOT marker AND clf THEN 1 ELSE 0 END) AS DOUBLE) AS clf_only FROM per_unit), m AS (SELECT avg(CASE WHEN confidence >= 0.75 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS miss FROM verdicts WHERE label = 1) SELECT round(both_n / (both_n + clf_only * (SELECT miss FROM m)), 4) AS recall FROM c",
    "q507_promotions": f"WITH {LABELLED}, p AS (SELECT rule_id FROM labelled GROUP BY rule_id HAVING avg(CAST(yes AS DOUBLE)) >= 0.70) SELECT s.signal_id, CASE WHEN p.rule_id IS NOT NULL THEN 'active' ELSE s.status END AS status FROM signals s LEFT JOIN p ON p.rule_id = s.rule_id",
    "q509_flat_lists": "SELECT text_unit_id, SET_OF(CASE WHEN layer = 'lexical' THEN lemma END) AS lexical, SET_OF(CASE WHEN layer = 'rhetorical' THEN rule_id END) AS figures, SET_OF(CASE WHEN layer = 'word_formation' THEN lemma END) AS affixes FROM signals GROUP BY text_unit_id",
    "q510_diversity": "SELECT v.text_unit_id, v.label, v.confidence, count(DISTINCT s.layer) AS layer_diversity FROM verdicts v JOIN text_units u ON u.text_unit_id = v.text_unit_id LEFT JOIN signals s ON s.text_unit_id = v.text_unit_id GROUP BY v.text_unit_id, v.label, v.confidence",
    "q511_ambiguity": "SELECT v.text_unit_id, v.confidence, count(DISTINCT s.category) AS categories FROM verdicts v JOIN signals s ON s.text_unit_id = v.text_unit_id WHERE v.confidence < 0.6 GROUP BY v.text_unit_id, v.confidence HAVING count(DISTINCT s.polarity) >= 2",
    # arenas and communities
    "q601_layer_mix": f"WITH {MIX} SELECT arena, layer, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY arena), 3) AS share FROM mix",
    "q602_chi_square": f"WITH {MIX}, c AS (SELECT arena, layer, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY arena) AS DOUBLE) AS r, CAST(sum(n) OVER (PARTITION BY layer) AS DOUBLE) AS k, CAST(sum(n) OVER () AS DOUBLE) AS total FROM mix), s AS (SELECT max(total) * (sum(n * n / (r * k)) - 1) AS x, max(total) AS total, count(DISTINCT arena) - 1 AS rows_less_1, count(DISTINCT layer) - 1 AS columns_less_1 FROM c) SELECT round(x, 6) AS chi_square, rows_less_1 * columns_less_1 AS dof, round(sqrt(x / total), 6) AS cramers_v FROM s",
    "q603_registers": f"WITH t AS (SELECT {ARENA} AS arena, count(*) AS total FROM text_units u GROUP BY 1), g AS (SELECT {ARENA} AS arena, CASE WHEN s.subcategory IN ('repro_gap', 'spec_gap') THEN 'task_register' ELSE 'discursive_register' END AS marker_group, count(DISTINCT u.text_unit_id) AS units FROM text_units u JOIN signals s ON s.text_unit_id = u.text_unit_id WHERE s.status = 'active' AND (s.category = 'hedging' OR s.layer = 'rhetorical' OR s.subcategory IN ('repro_gap', 'spec_gap')) GROUP BY 1, 2) SELECT g.arena, g.marker_group, g.units, round(CAST(1000 AS DOUBLE) * g.units / t.total, 2) AS rate_per_1k FROM g JOIN t ON t.arena = g.arena",
    "q604_signatures": "WITH f AS (SELECT u.repo AS source, concat(nk.layer, '.', nk.category) AS feature, count(*) AS n FROM text_units u JOIN nk ON nk.text_unit_id = u.text_unit_id GROUP BY u.repo, concat(nk.layer, '.', nk.category)) SELECT source, feature, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source), 3) AS share FROM f",
    "q605_thread_position": "WITH p AS (SELECT u.text_unit_id, CASE WHEN r.reply IS NOT NULL THEN 'reply' ELSE 'thread_opener' END AS position FROM text_units u LEFT JOIN (SELECT DISTINCT concat('email:', reply) AS reply FROM replies) r ON r.reply = u.parent_id WHERE u.parent_type = 'email') SELECT p.position, count(DISTINCT p.text_unit_id) AS units, count(DISTINCT nk.text_unit_id) AS nk_units, round(CAST(count(DISTINCT nk.text_unit_id) AS DOUBLE) / count(DISTINCT p.text_unit_id), 3) AS nk_rate FROM p LEFT JOIN nk ON nk.text_unit_id = p.text_unit_id GROUP BY p.position",
    "q606_threading": "SELECT (SELECT count(*) FROM replies) AS edges, (SELECT count(*) FROM mails m LEFT ANTI JOIN replies r ON r.reply = m.urn WHERE m.in_reply_to IS NOT NULL) AS dangling",
    # joins
    "j02_units_by_container": "SELECT u.repo, u.parent_type, count(*) AS units FROM text_units u JOIN (SELECT DISTINCT parent_id FROM text_units WHERE role IN ('title', 'commit_message', 'subject')) p ON p.parent_id = u.parent_id GROUP BY u.repo, u.parent_type",
    "j05_left_with_filter": "SELECT u.text_unit_id, count(nk.signal_id) AS n FROM text_units u LEFT JOIN nk ON nk.text_unit_id = u.text_unit_id AND nk.layer = 'lexical' GROUP BY u.text_unit_id",
    "j08_marker_negative": "SELECT u.text_unit_id FROM text_units u LEFT ANTI JOIN nk ON nk.text_unit_id = u.text_unit_id",
    "j08b_dangling_replies": "SELECT m.urn FROM mails m LEFT ANTI JOIN replies r ON r.reply = m.urn WHERE m.in_reply_to IS NOT NULL",
    "j09_reply_units": "SELECT u.text_unit_id FROM text_units u LEFT SEMI JOIN replies r ON concat('email:', r.reply) = u.parent_id",
    "j10_reply_self_join": "SELECT reply, parent FROM replies",
    "j14_ids_to_text": "SELECT u.text_unit_id, left(u.text, 400) AS text FROM (SELECT DISTINCT text_unit_id FROM signals WHERE layer = 'rhetorical') i JOIN text_units u ON u.text_unit_id = i.text_unit_id",
    "j16_resolved_per_group": "SELECT m.list, count(*) AS resolved FROM mails m LEFT SEMI JOIN mails p ON p.message_id = m.in_reply_to AND p.list = m.list GROUP BY m.list",
    # filters and windows
    "f01_scope": "SELECT text_unit_id FROM text_units WHERE (lang IN ('en') OR lang IS NULL) AND coalesce(token_count, 0) >= 2 AND (author_login IS NULL OR author_login NOT LIKE '%[bot]')",
    "f06_linked_pulls": "WITH linked AS (SELECT DISTINCT r.parent_id FROM refs r JOIN (SELECT DISTINCT repo, parent_number FROM text_units WHERE parent_type = 'issue') i ON i.repo = r.repo AND i.parent_number = r.number) SELECT u.text_unit_id FROM text_units u LEFT JOIN linked l ON l.parent_id = u.parent_id WHERE coalesce(u.parent_type, '') <> 'pull_request' OR l.parent_id IS NOT NULL",
    "f09_evidence": "SELECT signal_id FROM nk",
    "f12_every_tenth": "WITH r AS (SELECT text_unit_id, row_number() OVER (PARTITION BY repo ORDER BY text_unit_id) AS n FROM text_units) SELECT text_unit_id FROM r WHERE n % 10 = 0",
    "f13_head_per_source": "WITH r AS (SELECT text_unit_id, row_number() OVER (PARTITION BY repo ORDER BY text_unit_id) AS n FROM text_units) SELECT text_unit_id FROM r WHERE n <= 5",
    "f15_two_layers": "SELECT text_unit_id, count(DISTINCT layer) AS layers FROM nk GROUP BY text_unit_id HAVING count(DISTINCT layer) >= 2",
    "w05_first_writer": "SELECT lemma, rule_version, MIN_BY(pos, rule_id, signal_id) AS pos, MIN_BY(category, rule_id, signal_id) AS category FROM signals WHERE layer = 'lexical' GROUP BY lemma, rule_version",
    "w06_last_writer": "SELECT rule_id, MAX_BY(status, signal_id) AS status, MAX_BY(weight, signal_id) AS weight FROM signals GROUP BY rule_id",
    "o02_top_sources": "SELECT repo, count(*) AS n FROM text_units GROUP BY repo ORDER BY n DESC, repo LIMIT 25",
    "o03_hash_sample": "SELECT text_unit_id FROM text_units ORDER BY md5(text_unit_id), text_unit_id LIMIT 50",
    "u03_certainty_union": f"SELECT DISTINCT subcategory FROM (SELECT subcategory FROM signals WHERE layer = 'lexical' AND polarity = 'certainty' UNION ALL SELECT subcategory FROM signals WHERE layer = 'word_formation' AND polarity = 'certainty') t",
    "u07_rest_of_cluster": "SELECT text_unit_id, layer FROM signals EXCEPT SELECT text_unit_id, layer FROM nk",
    "g09_row_shares": "WITH c AS (SELECT layer, status, count(*) AS n FROM signals GROUP BY layer, status) SELECT layer, status, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY layer), 3) AS share FROM c",
    "g18_unique_keys": "SELECT (SELECT count(*) - count(DISTINCT text_unit_id) FROM text_units) AS units, (SELECT count(*) - count(DISTINCT signal_id) FROM signals) AS signals",
    # nodes and edges
    "m02_actors": "SELECT author_login AS login, 'User' AS type FROM text_units WHERE author_login IS NOT NULL GROUP BY author_login",
    "m06_has_text": "SELECT parent_id AS src, text_unit_id AS dst, role FROM text_units",
    "m07_mailing_lists": "SELECT DISTINCT list AS name FROM mails",
    "m08_email_messages": "SELECT urn, message_id, subject, list, in_reply_to, lang FROM mails",
    "m09_has_signal": "SELECT text_unit_id AS src, signal_id AS dst FROM signals",
    "m11_matches_marker": "SELECT signal_id, lemma, rule_version AS lexicon_version FROM signals WHERE layer = 'lexical'",
    "m12_instantiates": "SELECT signal_id, rule_id AS figure_id FROM signals WHERE layer = 'rhetorical'",
    "m13_references": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY source_text_unit, place) AS n FROM (SELECT r.parent_id AS src, concat('issue:', r.repo, ':', CAST(r.number AS VARCHAR(20))) AS dst, r.mechanism, r.text_unit_id AS source_text_unit, r.place FROM refs r JOIN (SELECT DISTINCT parent_id FROM text_units WHERE parent_type = 'issue') i ON i.parent_id = concat('issue:', r.repo, ':', CAST(r.number AS VARCHAR(20)))) t) SELECT src, dst, mechanism, source_text_unit FROM r WHERE n = 1",
    "m14_replies_to": "SELECT DISTINCT reply AS src, parent AS dst FROM replies",
    "q607_mechanisms": "SELECT mechanism, count(*) AS n FROM refs GROUP BY mechanism",
    "x13_references": "SELECT text_unit_id, place, number, mechanism FROM refs",
    # reports over the mailing lists
    "e01_inventory": "WITH g AS (SELECT list, count(*) AS messages, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS en, count(DISTINCT lang) AS n_langs FROM mails GROUP BY list), l AS (SELECT list, lang, count(*) AS n, row_number() OVER (PARTITION BY list ORDER BY count(*) DESC, lang) AS r FROM mails GROUP BY list, lang), y AS (SELECT list, min(CAST(left(created, 4) AS INTEGER)) AS year_min, max(CAST(left(created, 4) AS INTEGER)) AS year_max FROM mails GROUP BY list) SELECT g.list AS grp, g.messages, g.messages * 10 AS messages_estimated, l.lang AS top_lang, round(CAST(100 AS DOUBLE) * l.n / g.messages, 1) AS top_lang_pct, round(CAST(100 AS DOUBLE) * g.en / g.messages, 1) AS en_pct, g.n_langs, y.year_min, y.year_max FROM g JOIN l ON l.list = g.list AND l.r = 1 JOIN y ON y.list = g.list WHERE g.messages >= 2 ORDER BY messages_estimated DESC, grp",
    "e02_identity": "SELECT list AS grp, count(*) AS messages, count(*) * 10 AS messages_estimated, round(CAST(100 AS DOUBLE) * sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / count(*), 1) AS en_pct, count(DISTINCT trim(sender)) AS unique_authors, round(CAST(count(*) AS DOUBLE) / count(DISTINCT trim(sender)), 1) AS msgs_per_author, min(CAST(left(created, 4) AS INTEGER)) AS year_min, max(CAST(left(created, 4) AS INTEGER)) AS year_max FROM mails GROUP BY list",
    "e03_threading": "WITH r AS (SELECT DISTINCT m.urn FROM mails m JOIN mails p ON p.message_id = m.in_reply_to AND p.list = m.list) SELECT m.list AS grp, round(CAST(100 AS DOUBLE) * count(m.in_reply_to) / count(*), 1) AS reply_pct, round(CAST(100 AS DOUBLE) * count(r.urn) / greatest(count(m.in_reply_to), 1), 1) AS thread_resolution_pct FROM mails m LEFT JOIN r ON r.urn = m.urn GROUP BY m.list",
    "e08_length_buckets": "SELECT list AS grp, CASE WHEN length(body) = 0 THEN '0' WHEN length(body) < 200 THEN '1-200' WHEN length(body) < 1000 THEN '200-1k' WHEN length(body) < 5000 THEN '1k-5k' ELSE '5k+' END AS bucket, count(*) AS n FROM mails GROUP BY 1, 2",
}


def render(body: str, engine: str) -> str:
    """The body in the engine's spelling ('spark' or 'duck')."""
    if engine == "spark":
        body = re.sub(r"MIN_BY\((\w+), (\w+), (\w+)\)", r"min_by(\1, struct(\2, \3))", body)
        body = re.sub(r"MAX_BY\((\w+), (\w+)\)", r"max_by(struct(\1), \2).\1", body)
        body = re.sub(r"SET_OF\(((?:[^()]|\([^()]*\))*)\)", r"array_sort(collect_set(\1))", body)
        return re.sub(r"FIRST_OF\((.*?\)\)), (\d+)\)", r"slice(\1, 1, \2)", body)
    body = re.sub(r"MIN_BY\((\w+), (\w+), (\w+)\)", r"min_by({'x': \1}, {'a': \2, 'b': \3}).x", body)
    body = re.sub(r"MAX_BY\((\w+), (\w+)\)", r"max_by({'x': \1}, \2).x", body)
    body = re.sub(r"SET_OF\(((?:[^()]|\([^()]*\))*)\)", r"list_sort(coalesce(list(DISTINCT \1) FILTER (\1 IS NOT NULL), []))", body)
    body = re.sub(r"FIRST_OF\((.*?, \[\]\)\)), (\d+)\)", r"(\1)[1:\2]", body)
    return re.sub(r"LEFT (ANTI|SEMI) JOIN", r"\1 JOIN", body)
