"""The oracle's base relations in DuckDB's SQL: the same corpus, units and signals by other means."""

from __future__ import annotations

import functools

from ..functions import text as T
from ..operators import annotate, rules
from .fixture import CUES, N

W = r"[ \t\n\r\f\v]"
TOKEN = T.TOKEN.replace(r"\x0B", r"\v")
#: What cleaning removes, in its order, in this engine's patterns.
CLEANED = (
    ("<!--(?:.|\n)*?-->", "''"),
    ("```(?:.|\n)*?```", "''"),
    ("`[^`\n]+`", "''"),
    ("(?m)^>.*$", "''"),
    (r"!\[[^]]*\]\([^)]*\)", "''"),
    (r"@[\pL\pN_]+", "''"),
    ("\n\n\n+", "chr(10) || chr(10)"),
)


def q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def strip_steps(x: str) -> list[str]:
    out, now = [], f"coalesce({x}, '')"
    for pattern, to in CLEANED:
        now = f"regexp_replace({now}, {q(pattern)}, {to}, 'g')"
        out.append(now)
    return out


def strip(x: str) -> str:
    return trim(strip_steps(x)[-1])


def words(x: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({x}, '{W}+'), lambda x: x <> '')) AS INTEGER)"


def whole(n: str) -> str:
    """Whole characters in the first n bytes of `code`, the hexadecimal UTF-8 form: bytes that begin one, less one that is cut."""
    follows, n = "x[1] IN ('8', '9', 'A', 'B')", f"least({n}, length(code) // 2)"
    return f"({n} - len(list_filter(regexp_extract_all(left(code, 2 * {n}), '..'), lambda x: {follows})) - CASE WHEN substring(code, 2 * {n} + 1, 1) IN ('8', '9', 'A', 'B') THEN 1 ELSE 0 END)"


def cue(shift: int) -> str:
    return f"(SELECT cues FROM cue_list)[CAST((doc_id + {shift}) % {N} + 1 AS INTEGER)]"


@functools.cache
def base(version: str = "0.2") -> str:
    """WITH clause of all base relations; the optimiser drops those that a query does not use."""
    alts = ",\n".join(
        f"({q(a.rule_id)}, {q(a.layer)}, {q(a.category)}, {q(a.subcategory)}, {'NULL' if a.weight is None else a.weight}, {q(a.status)}, {q(a.lemma)}, {q(a.pos)}, {q(a.polarity)}, {len(a.slots)}, "
        f"[{', '.join(lst(s) for s in a.slots)}], {lst(a.before_in)}, {lst(a.before_not)}, {str(a.word_after).lower()}, {str(a.cased).lower()})"
        for a in rules.alternatives(version)
    )
    affixes = []
    for a in rules.affixes(version):
        allowed = f"list_contains({lst(a.allowed)}, word)"
        if a.kind == "prefix":
            shape = f"starts_with(word, {q(a.affix)}) AND length(word) - {len(a.affix)} >= {a.least}"
            blocked = f"len(list_filter({lst(a.blocked)}, lambda b: CASE WHEN length(b) > {len(a.affix)} THEN starts_with(word, b) ELSE word = b END)) > 0"
        else:
            shape = f"ends_with(word, {q(a.affix)}) AND length(word) >= {a.least}"
            blocked = f"list_contains({lst(a.blocked)}, word)"
        ok = allowed if a.listed_only else f"({allowed} OR NOT {blocked})"
        affixes.append(f"SELECT text_unit_id, span_start, span_end, word, {q(a.rule_id)} AS rule_id, {q(a.category)} AS category, {q(a.subcategory)} AS subcategory, {'NULL' if a.weight is None else a.weight}::DOUBLE AS weight, {q(a.status)} AS status, {q(a.polarity)}::VARCHAR AS polarity FROM words_at WHERE {shape} AND {ok}")
    mechanisms = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.MECHANISMS.items()) + "}"
    finish = "text_unit_id, parent_id, parent_type, repo, parent_number, role, position, text, lang"
    return rf"""
WITH cue_list AS MATERIALIZED (SELECT {lst(CUES)} AS cues),
docs AS (SELECT doc_id, lang, source, {cue(0)} || ' ' || coalesce(text, '') AS body,
    'user' || (doc_id % 37) || CASE WHEN doc_id % 29 = 0 THEN '[bot]' ELSE '' END AS author,
    '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created, doc_id % 4 AS kind, 'rev' || (doc_id % 11) AS rev,
    md5(CAST(doc_id AS VARCHAR)) AS sha, 'list' || (doc_id % 5) AS list FROM documents),
mails AS (SELECT *, 'urn:' || doc_id AS urn, 'm' || doc_id AS message_id,
    CASE WHEN doc_id % 8 = 7 THEN 'm' || (doc_id - 4) WHEN doc_id % 8 = 3 AND doc_id % 5 = 0 THEN 'mx' || doc_id END AS in_reply_to,
    CASE WHEN doc_id % 41 = 0 THEN 'jenkins@ci' ELSE ' ' || author || ' ' END AS sender,
    CASE WHEN doc_id % 17 = 3 THEN 'Re: bug 12 ' || {cue(5)} ELSE {cue(5)} END AS subject,
    CAST(length({cue(0)}) AS INTEGER) AS n1,
    CAST(CASE (doc_id // 4) % 3 WHEN 0 THEN length(body) WHEN 1 THEN length(body) + 1 ELSE strlen(body) END AS INTEGER) AS n2,
    CASE doc_id % 16 WHEN 3 THEN 'section_heading' WHEN 7 THEN 'quotation' WHEN 11 THEN 'log_data' ELSE 'paragraph' END AS label2 FROM docs WHERE kind = 3),
segs AS (SELECT doc_id, body, 0 AS i, n1 + 1 AS b, n2 AS e, label2 AS label FROM mails UNION ALL
    SELECT doc_id, body, 1, 0, n1, 'paragraph' FROM mails UNION ALL SELECT doc_id, body, 2, 5, 4, 'paragraph' FROM mails UNION ALL
    SELECT doc_id, body, 3, 2, n2 + 60, 'closing' FROM mails),
votes AS (SELECT doc_id, count(*) FILTER (e > b AND e <= length(body)) AS c, count(*) FILTER (e > b AND e <= strlen(body)) AS u8 FROM segs GROUP BY doc_id),
conv AS (SELECT doc_id, CASE WHEN c >= u8 THEN 'char' ELSE 'utf8_bytes' END AS convention FROM votes),
codes AS (SELECT doc_id, hex(encode(body)) AS code FROM mails WHERE doc_id IN (SELECT doc_id FROM conv WHERE convention = 'utf8_bytes')),
span1 AS (SELECT s.*, convention, CASE WHEN convention = 'utf8_bytes' THEN {whole('s.b')} ELSE b END AS cb, CASE WHEN convention = 'utf8_bytes' THEN {whole('s.e')} ELSE e END AS ce
    FROM segs s JOIN conv USING (doc_id) LEFT JOIN codes USING (doc_id)),
span2 AS (SELECT *, CASE WHEN cb < length(body) AND ce > length(body) AND ce <= length(body) + {T.OVERSHOOT} THEN length(body) ELSE ce END AS fe FROM span1),
spans AS (SELECT *, e > b AND fe <= length(body) AND cb < fe AS valid FROM span2),
kept AS (SELECT doc_id, label, t, row_number() OVER (PARTITION BY doc_id ORDER BY b, e, i) AS pos FROM
    (SELECT *, {strip("substring(body, CAST(cb + 1 AS BIGINT), CAST(fe - cb AS BIGINT))")} AS t FROM spans WHERE valid AND label IN ('paragraph', 'section_heading')) WHERE t <> ''),
entries AS (
    SELECT CASE kind WHEN 0 THEN 'issue:' ELSE 'pr:' END || source || ':' || doc_id AS parent_id, CASE kind WHEN 0 THEN 'issue' ELSE 'pull_request' END AS parent_type, source AS repo, CAST(doc_id AS INTEGER) AS parent_number, lang, created AS created_at, u.* FROM
      (SELECT *, unnest(CASE kind WHEN 0 THEN
        [{{'role': 'title', 'position': 0, 'x': {cue(3)}, 'author_login': author}}, {{'role': 'body', 'position': 1, 'x': body, 'author_login': author}}, {{'role': 'comment_body', 'position': 2, 'x': {cue(1)}, 'author_login': rev}}, {{'role': 'comment_body', 'position': 4, 'x': {cue(2)}, 'author_login': rev}}]
        ELSE [{{'role': 'title', 'position': 0, 'x': {cue(4)}, 'author_login': author}}, {{'role': 'body', 'position': 1, 'x': body, 'author_login': author}}, {{'role': 'comment_body', 'position': 2, 'x': {cue(1)}, 'author_login': rev}}, {{'role': 'comment_body', 'position': 3, 'x': {cue(2)}, 'author_login': rev}}] END) AS u FROM docs WHERE kind < 2)
    UNION ALL SELECT 'commit:' || sha, 'commit', source, NULL, lang, created, 'commit_message', 0, body, CASE WHEN doc_id % 5 <> 0 THEN author ELSE 'Dev ' || (doc_id % 7) END FROM docs WHERE kind = 2
    UNION ALL SELECT 'email:' || urn, 'email', list, NULL, lang, created, 'subject', 0, subject, trim(sender) FROM mails
    UNION ALL SELECT 'email:' || urn, 'email', list, NULL, lang, created, k.label, CAST(pos AS INTEGER), t, trim(sender) FROM kept k JOIN mails USING (doc_id)),
stripped AS (SELECT *, {strip('x')} AS text FROM entries),
text_units AS (SELECT CASE WHEN parent_type = 'email' AND role <> 'subject' OR position >= 2 THEN parent_id || ':' || role || ':' || position ELSE parent_id || ':' || role END AS {finish},
    {words('text')} AS token_count, sha256(text) AS sha256, author_login, created_at FROM stripped WHERE text <> ''),
cut1 AS (SELECT text_unit_id, flatten(list_transform(regexp_extract_all(text, {q(W + '*(?:' + TOKEN + ')')}, 0), lambda p: CASE
    WHEN ends_with(lower(p), 'n''t') AND length(ltrim(p)) > 3 OR {trim('lower(p)')} = 'cannot' THEN [left(p, length(p) - 3), right(p, 3)] ELSE [p] END)) AS pieces FROM text_units),
cut2 AS (SELECT text_unit_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS ix FROM cut1),
tok AS (SELECT text_unit_id, ix, regexp_replace(piece, '^{W}+', '') AS raw, lower(raw) AS word,
    CAST(sum(length(piece)) OVER (PARTITION BY text_unit_id ORDER BY ix) AS INTEGER) AS span_end, span_end - CAST(length(raw) AS INTEGER) AS span_start FROM cut2),
seen AS (SELECT *, coalesce(lag(word) OVER w, '') AS before, [word, {", ".join(f"lead(word, {k}) OVER w" for k in range(1, rules.SLOTS + 1))}] AS low FROM tok WINDOW w AS (PARTITION BY text_unit_id ORDER BY ix)),
alts AS (SELECT * FROM (VALUES {alts}) AS v(rule_id, layer, category, subcategory, weight, status, lemma, pos, polarity, n, slots, before_in, before_not, word_after, cased)),
keyed AS (SELECT *, unnest(slots[1]) AS word FROM alts),
hits AS (SELECT t.*, k.* EXCLUDE (word) FROM seen t JOIN keyed k USING (word) WHERE low[n] IS NOT NULL
    AND len(list_filter(range(1, n), lambda k: NOT CASE WHEN len(slots[k + 1]) = 0 THEN regexp_matches(low[k + 1], '^\p{{L}}') ELSE list_contains(slots[k + 1], low[k + 1]) END)) = 0
    AND (len(before_in) = 0 OR list_contains(before_in, before)) AND NOT list_contains(before_not, before)
    AND (NOT word_after OR coalesce(regexp_matches(low[n + 1], '^\p{{L}}'), false)) AND (NOT cased OR raw = upper(raw))),
shortest AS (SELECT h.text_unit_id, h.rule_id, h.span_start, min(e.span_end) AS span_end, min(layer) AS layer, min(category) AS category, min(subcategory) AS subcategory, CAST(min(weight) AS DOUBLE) AS weight, min(status) AS status, min(lemma) AS lemma, min(pos) AS pos, min(polarity) AS polarity
    FROM hits h JOIN tok e ON e.text_unit_id = h.text_unit_id AND e.ix = h.ix + h.n - 1 GROUP BY ALL),
words_at AS (SELECT * FROM tok WHERE regexp_full_match(word, '\p{{L}}+')),
fixes AS ({' UNION ALL '.join(affixes)}),
asks AS (SELECT text_unit_id, text, list_filter(regexp_extract_all(text, {q(annotate.SENTENCE)}, 0), lambda x: {trim('x')} <> '') AS s FROM text_units),
all_signals AS (
    SELECT text_unit_id, layer, category, subcategory, span_start, span_end, rule_id, weight, status, lemma, pos, polarity FROM shortest
    UNION ALL SELECT text_unit_id, 'word_formation', category, subcategory, span_start, span_end, rule_id, weight, status, word, NULL, polarity FROM fixes
    UNION ALL SELECT text_unit_id, 'morpho_syntactic', 'syntactic_pattern', 'question_answer', 0, CAST(length(text) AS INTEGER), '{annotate.QA_RULE}', 0.5, 'active', NULL, NULL, NULL FROM asks
      WHERE len(list_filter(s, lambda x: contains(x, '?'))) > 0 AND len(list_filter(s, lambda x: NOT contains(x, '?'))) > 0),
signals AS (SELECT text_unit_id || '::' || rule_id || '::' || span_start AS signal_id, text_unit_id, layer, category, subcategory, substring(text, span_start + 1, span_end - span_start) AS surface_form, span_start, span_end, rule_id, '{version}' AS rule_version, weight, status, lemma, pos, polarity FROM all_signals JOIN (SELECT text_unit_id, text FROM text_units) t USING (text_unit_id)),
verdicts AS (SELECT CASE kind WHEN 0 THEN 'issue:' || source || ':' || doc_id || ':body' WHEN 1 THEN 'pr:' || source || ':' || doc_id || ':body' WHEN 2 THEN 'commit:' || sha || ':commit_message' ELSE 'email:urn:' || doc_id || ':paragraph:1' END AS text_unit_id,
    'hand' AS model_id, '1' AS model_version, CAST(quality AS INTEGER) AS label, CAST(0.5 + (doc_id % 50) / 100 AS DOUBLE) AS confidence FROM docs JOIN labels USING (doc_id)),
nk AS (SELECT * FROM signals WHERE layer <> 'classifier' AND status = 'active' AND coalesce(subcategory, '') NOT IN ('booster', 'privative_certainty')),
replies AS (SELECT r.urn AS reply, p.urn AS parent FROM mails r JOIN mails p ON r.in_reply_to = p.message_id AND r.urn <> p.urn),
refs AS (SELECT text_unit_id, parent_id, parent_number, repo, CAST(unnest(range(0, len(ns))) AS INTEGER) AS place, CAST(unnest(ns) AS BIGINT) AS number,
    coalesce({mechanisms}[lower(unnest(ms))], 'bare') AS mechanism FROM (SELECT *, regexp_extract_all(text, {q(T.REFERENCE.replace(chr(92) + "x0B", chr(92) + "v"))}, 2) AS ns, regexp_extract_all(text, {q(T.REFERENCE.replace(chr(92) + "x0B", chr(92) + "v"))}, 1) AS ms
      FROM text_units WHERE role IN ('body', 'commit_message', 'comment_body')) t)
"""
