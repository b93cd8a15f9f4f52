"""SQL of the oracle's own for analysis queries, written from their definitions and not from the engine's bodies.

Each reads the oracle's base relations (duck.py). What the definitions fix stands
here again as plain values, so that a wrong value in the engine is seen.
"""

from __future__ import annotations

#: The dependency rules, the layers of rules, the subcategories of certainty.
SCOPED = "['morph.epi.neg_cognition', 'morph.epi.neg_cognition_modal', 'morph.hedge.shield_think', 'morph.neg.scoped_epistemic', 'morph.tense.past_nk_notyet']"
LAYERS = "['lexical', 'morpho_syntactic', 'word_formation', 'rhetorical']"
CERTAIN = "['booster', 'privative_certainty']"
EVIDENCE = f"s.status = 'active' AND s.layer <> 'classifier' AND NOT list_contains({CERTAIN}, coalesce(s.subcategory, ''))"
MAILED = "(u.parent_type = 'email')"
ARENA = f"if({MAILED}, 'mailing_list', 'github')"

BODIES: dict[str, str] = {
    "q104_rate_per_source": f"""SELECT source, units, nk_units, round(1000.0::DOUBLE * nk_units / units, 1) AS rate_per_1k FROM
        (SELECT u.repo AS source, count(*) AS units, count(*) FILTER (EXISTS (SELECT 1 FROM signals s WHERE s.text_unit_id = u.text_unit_id AND s.layer = 'lexical' AND {EVIDENCE})) AS nk_units FROM text_units u GROUP BY u.repo) t""",
    "q203_cue_scope": f"""SELECT len(list_intersect(r, {SCOPED})) > 0 AS has_scoped, len(list_filter(r, lambda x: NOT list_contains({SCOPED}, x))) > 0 AS has_cue, count(*) AS units FROM
        (SELECT u.text_unit_id, coalesce((SELECT list(DISTINCT s.rule_id) FROM signals s WHERE s.text_unit_id = u.text_unit_id AND s.layer = 'morpho_syntactic' AND s.status = 'active'), []) AS r
         FROM text_units u WHERE u.text_unit_id IN (SELECT text_unit_id FROM verdicts WHERE label = 1)) t GROUP BY ALL""",
    "q205_three_way": "SELECT text_unit_id FROM signals WHERE category = 'negation' INTERSECT SELECT text_unit_id FROM signals WHERE category = 'modality' INTERSECT SELECT text_unit_id FROM signals WHERE category = 'hedging'",
    "q206_layer_matrix": "SELECT layer_a, layer_b, count(*) AS units FROM (SELECT unnest(a) AS layer_a, b FROM (SELECT list(DISTINCT layer) AS a, list(DISTINCT layer) AS b FROM signals GROUP BY text_unit_id) x) y, unnest(b) AS z(layer_b) GROUP BY ALL",
    "q303_density_by_arena": f"""SELECT arena, CAST(sum(n) AS BIGINT) AS signals, count(*) FILTER (n > 0) AS units, round(1000.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 2) AS rate_per_1k FROM
        (SELECT {ARENA} AS arena, (SELECT count(*) FROM signals s WHERE s.text_unit_id = u.text_unit_id AND s.layer = 'rhetorical') AS n FROM text_units u) t GROUP BY arena HAVING sum(n) > 0""",
    "q401_unit_features": f"""SELECT s.text_unit_id, s.layer || '.' || s.category AS feature, count(*) AS n, round(ln(1.0::DOUBLE + count(*)), 6) AS weight FROM signals s
        WHERE {EVIDENCE} AND EXISTS (SELECT 1 FROM verdicts v WHERE v.text_unit_id = s.text_unit_id AND v.label = 1) GROUP BY ALL""",
    "q501_marker_clf_2x2": f"""SELECT marker, clf, count(*) AS units FROM (SELECT u.text_unit_id IN (SELECT s.text_unit_id FROM signals s WHERE {EVIDENCE}) AS marker,
        u.text_unit_id IN (SELECT text_unit_id FROM verdicts WHERE label = 1) AS clf FROM text_units u) t GROUP BY ALL""",
    "q506_recall": f"""SELECT round(b / (b + o * m), 4) AS recall FROM (SELECT (SELECT count(*)::DOUBLE FROM text_units u WHERE u.text_unit_id IN (SELECT text_unit_id FROM verdicts WHERE label = 1) AND u.text_unit_id IN (SELECT s.text_unit_id FROM signals s WHERE {EVIDENCE})) AS b,
        (SELECT count(*)::DOUBLE FROM text_units u WHERE u.text_unit_id IN (SELECT text_unit_id FROM verdicts WHERE label = 1) AND u.text_unit_id NOT IN (SELECT s.text_unit_id FROM signals s WHERE {EVIDENCE})) AS o,
        (SELECT count(*) FILTER (confidence >= 0.75)::DOUBLE / count(*) FROM verdicts WHERE label = 1) AS m) t""",
    "q601_layer_mix": f"""SELECT arena, layer, n, round(n::DOUBLE / t, 3) AS share FROM (SELECT {ARENA} AS arena, s.layer, count(*) AS n FROM signals s JOIN text_units u USING (text_unit_id) WHERE {EVIDENCE} GROUP BY ALL) a
        JOIN (SELECT {ARENA} AS arena, count(*) AS t FROM signals s JOIN text_units u USING (text_unit_id) WHERE {EVIDENCE} GROUP BY ALL) b USING (arena)""",
    "q602_chi_square": f"""WITH mix AS (SELECT {ARENA} AS arena, s.layer, count(*) AS n FROM signals s JOIN text_units u USING (text_unit_id) WHERE {EVIDENCE} GROUP BY ALL), cells AS (SELECT a.arena, l.layer, CAST(coalesce(m.n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT arena FROM mix) a CROSS JOIN (SELECT DISTINCT layer FROM mix) l LEFT JOIN mix m ON m.arena = a.arena AND m.layer = l.layer), e AS (SELECT n, sum(n) OVER (PARTITION BY arena) * sum(n) OVER (PARTITION BY layer) / sum(n) OVER () AS x, sum(n) OVER () AS total FROM cells) SELECT round(sum((n - x) * (n - x) / x), 6) AS chi_square, (SELECT (count(DISTINCT arena) - 1) * (count(DISTINCT layer) - 1) FROM cells) AS dof, round(sqrt(sum((n - x) * (n - x) / x) / max(total)), 6) AS cramers_v FROM e""",
    "q605_thread_position": f"""SELECT if(reply, 'reply', 'thread_opener') AS position, count(*) AS units, count(*) FILTER (nk) AS nk_units, round(count(*) FILTER (nk)::DOUBLE / count(*), 3) AS nk_rate FROM
        (SELECT EXISTS (SELECT 1 FROM mails m JOIN mails p ON p.message_id = m.in_reply_to AND p.urn <> m.urn WHERE 'email:' || m.urn = u.parent_id) AS reply, u.text_unit_id IN (SELECT s.text_unit_id FROM signals s WHERE {EVIDENCE}) AS nk FROM text_units u WHERE {MAILED}) t GROUP BY ALL""",
    "f06_linked_pulls": """SELECT text_unit_id FROM text_units WHERE coalesce(parent_type, '') <> 'pull_request' OR EXISTS
        (SELECT 1 FROM refs r JOIN docs d ON d.kind = 0 AND d.source = r.repo AND d.doc_id = r.number WHERE r.parent_id = text_units.parent_id)""",
    "f09_evidence": f"SELECT s.signal_id FROM signals s WHERE {EVIDENCE}",
    "j08_marker_negative": f"SELECT text_unit_id FROM text_units EXCEPT SELECT s.text_unit_id FROM signals s WHERE {EVIDENCE}",
    "w05_first_writer": "SELECT lemma, rule_version, pos, category FROM signals WHERE layer = 'lexical' QUALIFY row_number() OVER (PARTITION BY lemma, rule_version ORDER BY rule_id, signal_id) = 1",
    "w06_last_writer": "SELECT rule_id, status, weight FROM signals QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY signal_id DESC) = 1",
    "e03_threading": """SELECT list AS grp, round(100.0::DOUBLE * count(in_reply_to) / count(*), 1) AS reply_pct, round(100.0::DOUBLE * count(*) FILTER (in_reply_to IN (SELECT message_id FROM mails p WHERE p.list = m.list)) / greatest(count(in_reply_to), 1), 1) AS thread_resolution_pct FROM mails m GROUP BY list""",
}

#: q508: the lists of a layer as sorted, distinct strings of their fields.
FALSE_NEGATIVES = f""", c AS (SELECT v.text_unit_id, max(v.confidence) AS confidence, count(DISTINCT s.layer) AS layer_count FROM verdicts v JOIN signals s USING (text_unit_id) WHERE v.label = 0 AND list_contains({LAYERS}, s.layer) GROUP BY v.text_unit_id HAVING count(DISTINCT s.layer) >= 2)
SELECT c.text_unit_id, if({MAILED}, '(comment)', u.repo) AS repo, u.parent_type, CASE u.parent_type WHEN 'commit' THEN left(split_part(u.parent_id, ':', 2), 8) WHEN 'email' THEN NULL ELSE split_part(u.parent_id, ':', 3) END AS parent_ref, u.role, u.position, u.author_login, c.confidence, c.layer_count,
    {', '.join(f"list_sort(coalesce((SELECT list(DISTINCT {x}) FROM signals s WHERE s.text_unit_id = c.text_unit_id AND s.layer = '{layer}'), [])) AS {name}" for name, layer, x in (
        ("lexical_markers", "lexical", "concat_ws('|', s.rule_id, s.surface_form, s.lemma, s.category, s.polarity)"), ("morph_signals", "morpho_syntactic", "concat_ws('|', s.category, s.subcategory, s.rule_id, s.surface_form)"),
        ("word_formation_signals", "word_formation", "concat_ws('|', s.category, s.subcategory, s.rule_id, s.surface_form)"), ("rhetorical_signals", "rhetorical", "concat_ws('|', s.rule_id, s.category, s.subcategory, s.surface_form)")))}
FROM c JOIN text_units u USING (text_unit_id) ORDER BY c.layer_count DESC, c.confidence DESC, c.text_unit_id LIMIT 50"""
SET_SIZES = """SELECT text_unit_id, layer, count(*) AS n FROM (SELECT DISTINCT text_unit_id, layer, category, subcategory, rule_id, surface_form FROM signals) t GROUP BY ALL"""
