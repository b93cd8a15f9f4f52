"""Queries over single operators, with their SQL forms."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotate, dispatch, eda, graph, rules, stats, units
from ..sources import landing, publish
from ..streaming import pipeline as stream
from . import checks, duck, fixture

Query = Callable[[SparkSession, str], DataFrame]

#: Frequent words by language, for texts without a known language.
STOP = {
    "en": "the and that this with from they have not for are was".split(),
    "de": "der die und den von zu das mit sich des auf für".split(),
    "fr": "le la les de et des du un une que dans pour".split(),
    "es": "el la los las de que y en un una por con".split(),
}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.documents(spark, sf_dir)


def _base_docs() -> str:
    return duck.base()


def strip_steps(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", *[F.md5(s.cast("binary")).alias(f"s{k}") for k, s in enumerate(T.strip_steps(F.col("body")), 1)], T.strip_text(F.col("body")).alias("text"))


def strip_steps_sql():
    return _base_docs() + "SELECT doc_id, " + ", ".join(f"md5({s}) AS s{k}" for k, s in enumerate(duck.strip_steps("body"), 1)) + f", {duck.strip('body')} AS text FROM docs"


def guess_language(text):
    """The language whose frequent words a text's first 1,000 characters hold most; ties to the first name; none for short texts or without hits."""
    words = F.filter(F.split(F.lower(F.left(text, F.lit(1000))), T.WHITE + "+"), lambda w: w != "")
    hits = [F.size(F.filter(words, _is_in(ws))) for ws in STOP.values()]
    best = F.greatest(*hits)
    out = F.lit(None).cast("string")
    for name, h in reversed(list(zip(STOP, hits))):
        out = F.when(h == best, name).otherwise(out)
    return F.when((F.length(text) >= 10) & (best > 0), out)


def _is_in(words):
    return lambda w: w.isin(*words)


def language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", guess_language(F.col("body")).alias("guess"))


def language_sql():
    words = f"list_filter(regexp_split_to_array(lower(left(t, 1000)), '{duck.W}+'), lambda x: x <> '')"
    hits = ", ".join(f"len(list_filter({words}, lambda x: list_contains({duck.lst(ws)}, x))) AS h_{k}" for k, ws in STOP.items())
    best = f"greatest({', '.join('h_' + k for k in STOP)})"
    case = " ".join(f"WHEN h_{k} = {best} THEN '{k}'" for k in STOP)
    return _base_docs() + f"SELECT doc_id, CASE WHEN length(t) < 10 OR {best} = 0 THEN NULL {case} END AS guess FROM (SELECT doc_id, t, {hits} FROM (SELECT doc_id, body AS t FROM docs) a) b"


def bulk_lines(spark, sf_dir):
    """Action and source lines of every document, with blank, malformed and repeated lines among them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    act = F.concat(F.lit('{"index":{"_id":"<urn:'), F.col("doc_id").cast("string"), F.lit('>"}}'))
    src = F.concat(F.lit('{"lang":"'), "lang", F.lit('","group":"'), "source", F.lit('"}'))
    lines = F.array(act, F.when(F.col("doc_id") % 7 == 0, "oops{").when(F.col("doc_id") % 7 == 1, act).otherwise(""), src, F.lit(" "))
    return d.select(F.col("source").alias("file"), "doc_id", F.posexplode(lines).alias("k", "line")).select("file", (F.col("doc_id") * 4 + F.col("k")).alias("n"), "line")


BULK_SQL = """
lines AS (SELECT source AS file, doc_id * 4 + k AS n, CASE k WHEN 0 THEN act WHEN 1 THEN CASE doc_id % 7 WHEN 0 THEN 'oops{' WHEN 1 THEN act ELSE '' END WHEN 2 THEN src ELSE ' ' END AS line FROM
  (SELECT doc_id, source, unnest([0, 1, 2, 3]) AS k, '{"index":{"_id":"<urn:' || doc_id || '>"}}' AS act, '{"lang":"' || lang || '","group":"' || source || '"}' AS src FROM documents) t),
marked AS (SELECT *, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.index._id') END AS action FROM lines WHERE trim(line) <> ''),
paired AS (SELECT *, lag(action) OVER (PARTITION BY file ORDER BY n) AS prev FROM marked)"""


def bulk_pairs(spark, sf_dir):
    return landing.pair_bulk(bulk_lines(spark, sf_dir))


def bulk_pairs_sql():
    return f"WITH {BULK_SQL.strip()} SELECT file, n, regexp_replace(trim(prev), '^<+|>+$', '', 'g') AS urn, line AS source FROM paired WHERE ok AND action IS NULL AND prev IS NOT NULL"


def in_scope(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.filter(landing.in_scope(F.col("source"), F.col("lang"), ["src1", "src2", "src3"], ["en", "de"])).select("doc_id")


def ingest(spark, sf_dir):
    """Records kept by urn, first by file and place; repeats of known ones add nothing."""
    p = bulk_pairs(spark, sf_dir)
    return landing.first_by(p.union(p), ["urn"], [F.col("file"), F.col("n")]).select("urn", "file")


def new_records(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id")
    return landing.new_records(d, d.filter("doc_id % 3 = 0"), "doc_id")


def link_header(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    header = F.concat(F.lit("<https://x/?page="), F.col("doc_id").cast("string"), F.lit('>; rel="prev", <https://x/?page='), (F.col("doc_id") + 2).cast("string"), F.lit('>; rel="'), F.when(F.col("doc_id") % 2 == 0, "next").otherwise("last"), F.lit('"'))
    return d.select("doc_id", F.try_element_at(T.links(header), F.lit("next")).alias("next"))


def issue_listing(spark, sf_dir):
    """A listing with repeats, each issue once, with its comments joined on and gathered in order."""
    i = fixture.raw_issues(spark, sf_dir)
    c = i.select("id", F.posexplode("comments_data").alias("k", "c")).select("id", "k", F.col("c.body").alias("body"))
    gathered = c.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]).alias("bodies"))
    return i.select("id", "title").union(i.select("id", "title")).dropDuplicates(["id"]).join(gathered, "id", "left")


def pull_listing(spark, sf_dir):
    p = fixture.raw_pulls(spark, sf_dir)
    return p.filter("state = 'open'").unionByName(p.filter("state = 'closed'")).dropDuplicates(["id"]).select("id", "state", "merged", F.size("comments_data").alias("review_comments"), F.size("issue_comments_data").alias("issue_comments"))


def pointers(spark, sf_dir):
    d = _docs(spark, sf_dir)
    e = F.concat(F.lit('{"item_id":"'), F.col("doc_id").cast("string"), F.lit('","item_type":"issue","mongo_id":"'), (F.col("doc_id") * 2).cast("string"), F.lit('"}'))
    return d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "broken").otherwise(e).alias("value"))


def event_lookup(spark, sf_dir):
    found, _ = stream.lookup(stream.events(pointers(spark, sf_dir)), _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id"), "lang"))
    return found.select("item_id", "mongo_id", "lang")


def event_missing(spark, sf_dir):
    return stream.lookup(stream.events(pointers(spark, sf_dir)), _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("_id")))[1].select("item_id", "mongo_id")


def conventions(spark, sf_dir):
    return units.with_segments(fixture.raw_emails(spark, sf_dir)).select("doc_id", "convention")


def final_spans(spark, sf_dir):
    s = units.with_segments(fixture.raw_emails(spark, sf_dir)).select("doc_id", F.explode_outer("spans").alias("s"))
    return s.filter("s.span IS NOT NULL").select("doc_id", F.col("s.i").alias("i"), F.col("s.label").alias("label"), F.col("s.span.b").alias("b"), F.col("s.span.e").alias("e"))


def commit_nodes(spark, sf_dir):
    return graph.commits(fixture.raw_commits(spark, sf_dir))


def issue_nodes(spark, sf_dir):
    i = fixture.raw_issues(spark, sf_dir)
    return i.select(F.col("_meta.repo_full_name").alias("repo"), "number", "created_at", "state", "closed_at", graph.label_names(F.col("labels")).alias("labels"))


def pull_nodes(spark, sf_dir):
    return fixture.raw_pulls(spark, sf_dir).select(F.col("_meta.repo_full_name").alias("repo"), "number", "created_at", "state", "merged")


def repository_nodes(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("source").alias("full_name"), F.col("created").alias("created_at"), "lang", "doc_id")
    batch = d.select("full_name", "created_at", F.col("lang").alias("language"), F.col("doc_id").cast("int").alias("stars"), F.col("created_at").alias("mined_at"), "doc_id")
    return graph.collapse(batch, *graph.UPSERTS["repository"], [F.col("doc_id")])


def upsert_commits(spark, sf_dir):
    """A batch of all documents over a target of every other one: set-once columns stay, set-each-time columns change."""
    d = _docs(spark, sf_dir)
    target = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.lit("old").alias("once"), F.lit(0).alias("each"))
    batch = d.select(F.col("doc_id").alias("k"), F.lit("new").alias("once"), F.lit(1).alias("each"), F.lit(1).alias("seq")).union(d.filter("doc_id % 5 = 0").select("doc_id", F.lit("newer"), F.lit(2), F.lit(2)))
    return graph.upsert(target, batch.filter("k % 3 <> 0"), ["k"], ["once"], ["each"], [F.col("seq")])


def parent_keys(spark, sf_dir):
    p = _text_units(spark, sf_dir).select("parent_id").distinct()
    return p.select("parent_id", *[c.alias(n) for n, c in graph.parent_key(F.col("parent_id")).items()])


def _text_units(spark, sf_dir):
    from . import catalogue

    return catalogue._shared(spark, sf_dir, "text_units", catalogue.text_units)


def _signals_like(f) -> Query:
    return lambda spark, sf_dir: f(_text_units(spark, sf_dir))


def verdict_signals(spark, sf_dir):
    return annotate.verdict_signals(fixture.verdicts(spark, sf_dir))


def payloads(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", annotate.payload_json(F.create_map(F.lit("lang"), "lang", F.lit("__verdict__"), F.lit("1"))).alias("payload_json"))


def ablation(spark, sf_dir):
    u = _text_units(spark, sf_dir)
    per = lambda v: annotate.signals(u, v).groupBy("layer").agg(F.count("*").alias(f"n_{v.replace('.', '')}"))
    return per("0.1").join(per("0.2"), "layer", "full_outer").na.fill(0)


def ablation_sql():
    old, new = duck.base("0.1"), duck.base("0.2")
    return f"SELECT layer, coalesce(a.n, 0) AS n_01, coalesce(b.n, 0) AS n_02 FROM ({old} SELECT layer, count(*) AS n FROM signals GROUP BY layer) a FULL JOIN ({new} SELECT layer, count(*) AS n FROM signals GROUP BY layer) b USING (layer)"


def verdict_model(spark, sf_dir):
    return annotate.verdicts(_text_units(spark, sf_dir))


def cluster_features() -> list[str]:
    """Every layer.category that a rule can give, from the rule set itself: no job looks for them."""
    found = {f"{a.layer}.{a.category}" for a in rules.alternatives() if a.layer != "classifier"} | {f"word_formation.{a.category}" for a in rules.affixes()} | {"morpho_syntactic.syntactic_pattern"}
    return sorted(found)


def _cluster_column(feature: str) -> str:
    return feature.replace(".", "__")


def unit_features(spark, sf_dir):
    """log(1 + count) of each layer.category for the units of label 1 that have evidence."""
    from . import catalogue

    catalogue.views(spark, sf_dir)
    f = spark.sql("SELECT nk.text_unit_id, concat(nk.layer, '.', nk.category) AS feature, count(*) AS n FROM nk LEFT SEMI JOIN (SELECT text_unit_id FROM verdicts WHERE label = 1) v ON v.text_unit_id = nk.text_unit_id GROUP BY 1, 2")
    names = cluster_features()
    return stats.pivot(f, "text_unit_id", "feature", names).select("text_unit_id", *[F.log1p(F.col(f"`{n}`")).alias(_cluster_column(n)) for n in names])


def unit_clusters(spark, sf_dir):
    return stats.clusters(unit_features(spark, sf_dir), [_cluster_column(n) for n in cluster_features()])[0]


def cluster_profile(spark, sf_dir):
    """Cluster, units and the mean of each feature in the cluster."""
    return unit_clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("units"), *[F.round(F.avg(c), 4).alias(c) for c in map(_cluster_column, cluster_features())])


def exemplars(members, texts, top: int = 5, random: int = 10):
    """Of each cluster the units of most signals, and as many others by a hash of the id: (cluster, text_unit_id, total, kind, text).

    `members` has cluster, text_unit_id and total. Each choice is an aggregate
    that keeps as many rows as it needs, so a large cluster is no single task. The
    chosen rows are few enough to broadcast, so no text moves.
    """
    best = landing.least_by(members, ["cluster"], F.struct((-F.col("total")).alias("o"), "text_unit_id", "total"), top).select("cluster", "e.text_unit_id", "e.total", F.lit("top").alias("kind"))
    rest = members.join(best.select("cluster", "text_unit_id"), ["cluster", "text_unit_id"], "left_anti")
    drawn = landing.least_by(rest, ["cluster"], F.struct(F.md5(F.col("text_unit_id").cast("binary")).alias("o"), "text_unit_id", "total"), random).select("cluster", "e.text_unit_id", "e.total", F.lit("random").alias("kind"))
    return F.broadcast(best.union(drawn)).join(texts.select("text_unit_id", F.left("text", F.lit(400)).alias("text")), "text_unit_id").select("cluster", "text_unit_id", "total", "kind", "text")


def cluster_exemplars(spark, sf_dir):
    c = unit_clusters(spark, sf_dir)
    total = sum((F.expm1(F.col(_cluster_column(n))) for n in cluster_features()), F.lit(0.0))
    return exemplars(c.select("cluster", "text_unit_id", F.round(total).cast("long").alias("total")), _text_units(spark, sf_dir))


def layer_exemplars(spark, sf_dir):
    """The same choice with the layer as the cluster, which SQL can check."""
    from . import catalogue

    catalogue.views(spark, sf_dir)
    members = spark.sql("SELECT layer AS cluster, text_unit_id, count(*) AS total FROM signals GROUP BY layer, text_unit_id")
    return exemplars(members, _text_units(spark, sf_dir))


LAYER_EXEMPLARS_SQL = """, t AS (SELECT layer AS cluster, text_unit_id, count(*) AS total FROM signals GROUP BY layer, text_unit_id),
best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY total DESC, text_unit_id) <= 5),
drawn AS (SELECT * FROM (SELECT * FROM t EXCEPT SELECT * FROM best) r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY md5(text_unit_id), text_unit_id) <= 10)
SELECT cluster, text_unit_id, total, kind, left(text, 400) AS text FROM (SELECT *, 'top' AS kind FROM best UNION ALL SELECT *, 'random' FROM drawn) x JOIN (SELECT text_unit_id, text FROM text_units) u USING (text_unit_id)"""


def two_stage_stream(spark, sf_dir):
    """Units as JSON lines through both streaming stages: signals by layer, as in batch."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quaesitor-")
    import uuid

    root = f"{root}/stream-{uuid.uuid4().hex}"
    u = _text_units(spark, sf_dir).select("text_unit_id", "parent_id", "parent_type", "role", "position", "text", "lang")
    u.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/in")
    stream.two_stages(spark, f"{root}/in", root)
    return spark.read.parquet(f"{root}/signals").groupBy("layer").agg(F.count("*").alias("n"))


#: For each layer its list column in the report of false negatives, and the fields of its entries.
LISTS = {
    "lexical": ("lexical_markers", ("rule_id", "surface_form", "lemma", "category", "polarity")),
    "morpho_syntactic": ("morph_signals", ("category", "subcategory", "rule_id", "surface_form")),
    "word_formation": ("word_formation_signals", ("category", "subcategory", "rule_id", "surface_form")),
    "rhetorical": ("rhetorical_signals", ("rule_id", "category", "subcategory", "surface_form")),
}


def false_negatives(spark, sf_dir, least_layers: int = 2, limit: int = 50):
    """Units of label 0 in which two layers or more fire, the most layers and the surest verdicts first, with the distinct signals of each layer.

    The units are chosen before their lists are gathered, so lists are made for
    `limit` units only, and these are few enough to broadcast. A layer without signals has an empty list.
    """
    from . import catalogue

    catalogue.views(spark, sf_dir)
    s = spark.table("signals").filter(F.col("layer").isin(*LISTS))
    v = spark.table("verdicts").filter("label = 0").groupBy("text_unit_id").agg(F.max("confidence").alias("confidence"))
    fired = s.groupBy("text_unit_id").agg(F.count_distinct("layer").alias("layer_count")).filter(F.col("layer_count") >= least_layers)
    units_ = spark.table("text_units")
    first = v.join(fired, "text_unit_id").join(units_.select("text_unit_id"), "text_unit_id", "left_semi").orderBy(F.desc("layer_count"), F.desc("confidence"), "text_unit_id").limit(limit)
    entry = lambda fields: F.concat_ws("|", *fields)
    lists = s.join(F.broadcast(first.select("text_unit_id")), "text_unit_id").groupBy("text_unit_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("layer") == layer, entry(fields)))).alias(name) for layer, (name, fields) in LISTS.items()])
    u = units_.join(F.broadcast(first), "text_unit_id")
    key = F.split("parent_id", ":")
    ref = F.when(F.col("parent_type") == "commit", F.left(key[1], F.lit(8))).when(F.col("parent_type") != "email", F.get(key, F.lit(2)))
    repo = F.when(F.col("parent_type") == "email", "(comment)").otherwise(F.col("repo"))
    out = u.select("text_unit_id", repo.alias("repo"), "parent_type", ref.alias("parent_ref"), "role", "position", "author_login", "confidence", "layer_count").join(lists, "text_unit_id")
    return out.orderBy(F.desc("layer_count"), F.desc("confidence"), "text_unit_id")


def marker_only_sample(spark, sf_dir, limit: int = 100):
    """The body of q502_marker_only_sample with the units chosen by their ids first: no text moves, and rules are gathered for `limit` units only."""
    from . import catalogue

    catalogue.views(spark, sf_dir)
    nk, u = spark.table("nk").select("text_unit_id", "rule_id"), spark.table("text_units").select("text_unit_id", "text")
    ids = nk.select("text_unit_id").distinct().join(spark.table("verdicts").filter("label = 1"), "text_unit_id", "left_anti").join(u, "text_unit_id", "left_semi")
    order = [F.md5(F.col("text_unit_id").cast("binary")), F.col("text_unit_id")]
    first = F.broadcast(ids.orderBy(*order).limit(limit))
    sets = nk.join(first, "text_unit_id").groupBy("text_unit_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    texts = u.join(first, "text_unit_id").groupBy("text_unit_id").agg(F.max(F.left("text", F.lit(400))).alias("text"))
    return sets.join(texts, "text_unit_id").orderBy(*order)


def ids_to_text(spark, sf_dir):
    """The body of j14_ids_to_text with the texts cut before they meet the ids."""
    from . import catalogue

    catalogue.views(spark, sf_dir)
    ids = spark.table("signals").filter("layer = 'rhetorical'").select("text_unit_id").distinct()
    return spark.table("text_units").select("text_unit_id", F.left("text", F.lit(400)).alias("text")).join(ids, "text_unit_id").select("text_unit_id", "text")


#: Analysis queries whose body moves more than it needs when it is run as it stands; the oracle runs the body.
PLANNED = {"q502_marker_only_sample": marker_only_sample, "j14_ids_to_text": ids_to_text}


def set_sizes(spark, sf_dir):
    """How many distinct signals, as structs, a unit has in each layer."""
    from . import catalogue

    catalogue.views(spark, sf_dir)
    return spark.table("signals").groupBy("text_unit_id", "layer").agg(F.size(F.collect_set(F.struct("category", "subcategory", "rule_id", "surface_form"))).cast("long").alias("n"))


def chi_square_p(spark, sf_dir):
    """The chi-square of q602 with its p-value."""
    from . import catalogue

    t = catalogue.queries()["q602_chi_square"](spark, sf_dir)
    p = F.udf(lambda x, dof: None if x is None or not dof else float(stats.chi_square_p(x, int(dof))), "double")  # one row
    return t.withColumn("p_value", p("chi_square", "dof"))


def page_of_units(spark, sf_dir):
    """A page of units by key: those after an id, in order."""
    return annotate.unit_page(_text_units(spark, sf_dir), "issue:src1", 200)


E_COLS = {"pct": lambda part, whole: f"coalesce(round(100.0::DOUBLE * ({part}) / nullif({whole}, 0), 1), 0)"}


def _any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {duck.q(t)})" for t in terms) + ")"


def segment_profile_sql():
    pct = E_COLS["pct"]
    machine = ", ".join(map(duck.q, eda.MACHINE))
    kept = "label IN ('paragraph', 'section_heading')"
    paragraphs = "count(*) FILTER (label = 'paragraph')"
    return duck.base() + f"SELECT list AS grp, {pct(f'count(*) FILTER (label IN ({machine}))', 'count(*)')} AS machine_segment_pct, {pct(paragraphs, 'count(*)')} AS paragraph_segment_pct, {pct(f'count(*) FILTER ({kept} AND valid)', f'count(*) FILTER ({kept})')} AS kept_span_valid_pct FROM spans JOIN (SELECT doc_id, list FROM mails) m USING (doc_id) GROUP BY list"


def mail_profile_sql():
    pct = E_COLS["pct"]
    templated = duck.q(eda.TEMPLATED)
    return duck.base() + f""", kn AS (SELECT doc_id, count(*) FILTER (label IN ('paragraph', 'section_heading')) AS kept FROM segs GROUP BY doc_id),
un AS (SELECT repo AS list, count(*) AS units, count(*) FILTER (lang = 'en' AND token_count >= 2 AND NOT ends_with(author_login, '[bot]')) AS fit FROM text_units WHERE parent_type = 'email' GROUP BY repo)
SELECT list AS grp, {pct(f"count(*) FILTER {_any('sender', eda.BOT_HINTS)}", "count(*)")} AS bot_from_pct, {pct(f"count(*) FILTER (regexp_matches(subject, {templated}))", "count(*)")} AS templated_subject_pct,
{pct("count(*) FILTER (convention = 'utf8_bytes')", "count(*)")} AS utf8_bytes_doc_pct, round(CAST(sum(kept) AS DOUBLE) / count(*), 2) AS kept_segments_per_msg, CAST(any_value(units) AS BIGINT) AS est_text_units, CAST(10 * any_value(units) AS BIGINT) AS est_text_units_scaled, CAST(10 * any_value(fit) AS BIGINT) AS est_annotatable_units_scaled,
CAST(round(avg(length(body)), 0) AS BIGINT) AS mean_chars_per_msg, {pct(f"count(*) FILTER {_any('body', eda.PRESCREEN)}", "count(*)")} AS nk_prescreen_pct FROM mails JOIN conv USING (doc_id) JOIN kn USING (doc_id) JOIN un USING (list) GROUP BY list"""


TALLY_SQL = """, real AS (SELECT s.doc_id, convention, e <= CASE convention WHEN 'char' THEN length(body) ELSE strlen(body) END AS fits FROM segs s JOIN conv USING (doc_id) WHERE b >= 0 AND e > b),
per AS (SELECT doc_id, convention, count(*) FILTER (fits) AS n_valid, count(*) AS n_total FROM real GROUP BY doc_id, convention) """


def records(spark, sf_dir):
    return fixture.records(spark, sf_dir)


def edge_query(kind: str) -> Query:
    def run(spark, sf_dir):
        r = records(spark, sf_dir)
        return dispatch.contains(r, kind).withColumn("type", F.lit("CONTAINS")).unionByName(dispatch.authored(r, kind).withColumn("type", F.lit("AUTHORED")))

    return run


ACTORS_SQL = "SELECT author AS login FROM docs WHERE kind < 2 UNION SELECT 'ghost' || (doc_id % 3) FROM docs WHERE doc_id % 50 = 1 UNION SELECT trim(sender) FROM mails"


def edge_sql(table: str, src: str, dst: str, login: str) -> Callable[[], str]:
    return lambda: duck.base() + f", actors AS ({ACTORS_SQL}) SELECT 'CONTAINS' AS type, {src} AS src, {dst} AS dst FROM {table} UNION ALL SELECT 'AUTHORED', {login}, {dst} FROM {table} WHERE {login} IN (SELECT login FROM actors)"


def saved(spark, sf_dir):
    """A batch of all records over a store of every other issue: one row per key, with what the batch brought."""
    r = records(spark, sf_dir)
    store = publish.keyed(r.filter("item_type = 'issue'")).filter("item_id % 2 = 0").withColumn("processed", F.lit(True))
    return publish.save(store, r.union(r)).select("item_type", "item_id", "item_subtype", "repo_name", "processed")


def published(spark, sf_dir):
    r = records(spark, sf_dir)
    return stream.events(publish.events(r.union(r))).select("item_id", "item_type", "item_subtype", "repo_name", "mongo_id")


def file_ordinals(spark, sf_dir):
    """The bulk pairs with their ordinal in the file."""
    return bulk_pairs(spark, sf_dir).select("file", "urn", F.row_number().over(Window.partitionBy("file").orderBy("n")).alias("seen"))


KEYED_SQL = ", saved AS (SELECT 'issue' AS item_type, CAST(doc_id AS VARCHAR) AS item_id, 'issue' AS item_subtype, source AS repo_name FROM docs WHERE kind < 2 UNION ALL SELECT 'commit', sha, 'commit', source FROM docs WHERE kind = 2) "
ORDINAL_SQL = "SELECT file, urn FROM (SELECT file, regexp_replace(trim(prev), '^<+|>+$', '', 'g') AS urn, row_number() OVER (PARTITION BY file ORDER BY n) AS seen FROM paired WHERE ok AND action IS NULL AND prev IS NOT NULL) t WHERE "


def classified_as(spark, sf_dir):
    """CLASSIFIED_AS edges: verdicts of units that exist."""
    v = fixture.verdicts(spark, sf_dir).join(_text_units(spark, sf_dir).select("text_unit_id"), "text_unit_id", "left_semi")
    return v.select(F.col("text_unit_id").alias("src"), F.concat_ws("::", "text_unit_id", "model_id", "model_version").alias("dst"))


def _by_type(kind: str) -> tuple[Query, Callable[[], str]]:
    make = {"issue": (units.from_issues, fixture.raw_issues), "pull_request": (units.from_pulls, fixture.raw_pulls), "commit": (units.from_commits, fixture.raw_commits), "email": (units.from_emails, fixture.raw_emails)}[kind]
    return (lambda spark, sf_dir: make[0](make[1](spark, sf_dir))), (lambda: duck.base() + f"SELECT * FROM text_units WHERE parent_type = '{kind}'")


def _where(condition: str, spark_filter) -> tuple[Query, Callable[[], str]]:
    return (lambda spark, sf_dir: _text_units(spark, sf_dir).filter(spark_filter()).select("text_unit_id")), (lambda: duck.base() + f"SELECT text_unit_id FROM text_units WHERE {condition}")


def _layer(f, condition: str) -> tuple[Query, Callable[[], str]]:
    return _signals_like(f), (lambda: duck.base() + f"SELECT * FROM signals WHERE {condition}")


_scoped = ", ".join(duck.q(r) for r in rules.scoped_rules())
STEPS: dict[str, tuple[Query, Callable[[], str] | None]] = {
    "p01_strip_text": (strip_steps, strip_steps_sql),
    "p02_language": (language, language_sql),
    "p06_issue_units": _by_type("issue"),
    "p07_pull_units": _by_type("pull_request"),
    "p08_commit_units": _by_type("commit"),
    "p09_email_units": _by_type("email"),
    "p11_convention": (conventions, lambda: duck.base() + "SELECT doc_id, convention FROM conv"),
    "p13_final_spans": (final_spans, lambda: duck.base() + "SELECT doc_id, CAST(i AS INTEGER) AS i, label, CAST(cb AS INTEGER) AS b, CAST(fe AS INTEGER) AS e FROM spans WHERE valid"),
    "p16_commit_nodes": (commit_nodes, lambda: duck.base() + "SELECT sha, created AS authored_at, created AS committed_at, left(split_part(body, chr(10), 1), 200) AS message_summary FROM docs WHERE kind = 2"),
    "p18_parent_keys": (parent_keys, lambda: duck.base() + "SELECT DISTINCT parent_id, split_part(parent_id, ':', 1) AS kind, split_part(parent_id, ':', -1) AS sha, regexp_extract(parent_id, '^[^:]*:(.*)$', 1) AS urn FROM text_units"),
    "f02_min_tokens": _where("coalesce(token_count, 0) >= 8", lambda: F.coalesce("token_count", F.lit(0)) >= 8),
    "f03_roles": _where("role IN ('body', 'title') OR role IS NULL", lambda: F.col("role").isin("body", "title") | F.col("role").isNull()),
    "f04_parent_types": _where("parent_type IN ('email') OR parent_type IS NULL", lambda: F.col("parent_type").isin("email") | F.col("parent_type").isNull()),
    "f05_skip_bots": _where("author_login IS NULL OR NOT ends_with(author_login, '[bot]')", lambda: F.col("author_login").isNull() | ~F.col("author_login").endswith("[bot]")),
    "f19_prescreen": (lambda spark, sf_dir: _docs(spark, sf_dir).filter(eda.contains_any(F.col("body"), eda.PRESCREEN)).select("doc_id"), lambda: duck.base() + f"SELECT doc_id FROM docs WHERE {_any('body', eda.PRESCREEN)}"),
    "a01_tokens": (lambda spark, sf_dir: annotate.token_table(_text_units(spark, sf_dir)), lambda: duck.base() + "SELECT text_unit_id, CAST(ix AS INTEGER) AS pos, raw AS token, word AS lower, span_start, span_end FROM tok"),
    "w08_bigrams": (lambda spark, sf_dir: annotate.bigrams(_text_units(spark, sf_dir)).groupBy("first", "second").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first", "second").limit(100), lambda: duck.base() + "SELECT a.word AS first, b.word AS second, count(*) AS n FROM tok a JOIN tok b ON b.text_unit_id = a.text_unit_id AND b.ix = a.ix + 1 GROUP BY ALL ORDER BY n DESC, first, second LIMIT 100"),
    "a04_rule_windows": _layer(annotate.rule_signals, f"layer <> 'word_formation' AND rule_id <> '{annotate.QA_RULE}'"),
    "a05_scoped_windows": _layer(lambda u: annotate.rule_signals(u).filter(F.col("rule_id").isin(*rules.scoped_rules())), f"rule_id IN ({_scoped})"),
    "a07_question_answer": _layer(annotate.question_answer_signals, f"rule_id = '{annotate.QA_RULE}'"),
    "a08_affixes": _layer(annotate.affix_signals, "layer = 'word_formation'"),
    "a11_figures": _layer(lambda u: annotate.rule_signals(u).filter("layer = 'rhetorical'"), "layer = 'rhetorical'"),
    "a12_classifier": (verdict_model, None),
    "a13_verdict_signals": (verdict_signals, lambda: duck.base() + "SELECT text_unit_id || '::clf.roberta_binary::0' AS signal_id, text_unit_id, 'classifier' AS layer, CASE label WHEN 1 THEN 'nk_positive' ELSE 'nk_negative' END AS category, 'clf.roberta_binary' AS rule_id, confidence, 'active' AS status FROM verdicts"),
    "a19_payload": (payloads, lambda: """SELECT doc_id, '{"lang":"' || lang || '"}' AS payload_json FROM documents"""),
    "q701_ablation": (ablation, ablation_sql),
    "s02_issue_listing": (issue_listing, lambda: duck.base() + f"SELECT doc_id AS id, {duck.cue(3)} AS title, [{duck.cue(1)}, '```x```', {duck.cue(2)}] AS bodies FROM docs WHERE kind = 0"),
    "s03_pull_listing": (pull_listing, lambda: duck.base() + "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, doc_id % 3 = 0 AS merged, 1 AS review_comments, 1 AS issue_comments FROM docs WHERE kind = 1"),
    "s04_commit_listing": (lambda spark, sf_dir: fixture.raw_commits(spark, sf_dir).select("sha", F.col("commit.message").alias("message")), lambda: duck.base() + "SELECT sha, body AS message FROM docs WHERE kind = 2"),
    "s05_link_header": (link_header, lambda: "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://x/?page=' || (doc_id + 2) END AS next FROM documents"),
    "s07_saved": (saved, lambda: duck.base() + KEYED_SQL + "SELECT *, false AS processed FROM saved"),
    "s07b_published": (published, lambda: duck.base() + KEYED_SQL + "SELECT *, sha256(item_type || ':' || item_id) AS mongo_id FROM saved"),
    "f12b_file_sample": (lambda spark, sf_dir: file_ordinals(spark, sf_dir).filter("seen % 10 = 0").select("file", "urn"), lambda: f"WITH {BULK_SQL.strip()} " + ORDINAL_SQL + "seen % 10 = 0"),
    "f13b_file_head": (lambda spark, sf_dir: file_ordinals(spark, sf_dir).filter("seen <= 5").select("file", "urn"), lambda: f"WITH {BULK_SQL.strip()} " + ORDINAL_SQL + "seen <= 5"),
    "s08_bulk_pairs": (bulk_pairs, bulk_pairs_sql),
    "s10_scope": (in_scope, lambda: "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de')"),
    "s11_ingest": (ingest, lambda: bulk_pairs_sql().replace("SELECT file, n, regexp", "SELECT DISTINCT file, regexp").replace(", line AS source FROM", " FROM")),
    "s12_new_records": (new_records, lambda: "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0"),
    "s15_event_lookup": (event_lookup, lambda: "SELECT CAST(e.doc_id AS VARCHAR) AS item_id, CAST(e.doc_id * 2 AS VARCHAR) AS mongo_id, d.lang FROM documents e JOIN documents d ON d.doc_id = e.doc_id * 2 WHERE e.doc_id % 9 <> 0"),
    "s15b_event_missing": (event_missing, lambda: "SELECT CAST(e.doc_id AS VARCHAR) AS item_id, CAST(e.doc_id * 2 AS VARCHAR) AS mongo_id FROM documents e ANTI JOIN documents d ON d.doc_id = e.doc_id * 2 WHERE e.doc_id % 9 <> 0"),
    "m00_upsert": (upsert_commits, lambda: "WITH t AS (SELECT doc_id AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS each FROM documents WHERE doc_id % 3 <> 0) SELECT k, CASE WHEN t.k IS NOT NULL THEN 'old' ELSE 'new' END AS once, coalesce(b.each, 0) AS each FROM t FULL JOIN b USING (k)"),
    "m01_repositories": (repository_nodes, lambda: duck.base() + "SELECT source AS full_name, arg_min(created, doc_id) AS created_at, arg_min(lang, doc_id) AS language, CAST(max(doc_id) AS INTEGER) AS stars, arg_max(created, doc_id) AS mined_at FROM docs GROUP BY source"),
    "m03_issues": (issue_nodes, lambda: duck.base() + "SELECT source AS repo, CAST(doc_id AS INTEGER) AS number, created AS created_at, CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, CAST(NULL AS VARCHAR) AS closed_at, ['bug', lang] AS labels FROM docs WHERE kind = 0"),
    "m04_pulls": (pull_nodes, lambda: duck.base() + "SELECT source AS repo, CAST(doc_id AS INTEGER) AS number, created AS created_at, CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, doc_id % 3 = 0 AS merged FROM docs WHERE kind = 1"),
    "e05_segments": (lambda spark, sf_dir: eda.segment_profile(fixture.raw_emails(spark, sf_dir)), segment_profile_sql),
    "e06_mail_profile": (lambda spark, sf_dir: eda.mail_profile(fixture.raw_emails(spark, sf_dir), sample_rate=10), mail_profile_sql),
    "d01_conventions": (lambda spark, sf_dir: eda.convention_tally(fixture.raw_emails(spark, sf_dir)), lambda: duck.base() + TALLY_SQL + "SELECT convention, count(*) AS n, count(*) FILTER (n_valid = n_total) AS clean, count(*) FILTER (n_valid < n_total) AS partial FROM per GROUP BY convention"),
    "d02_label_validity": (lambda spark, sf_dir: eda.label_validity(fixture.raw_emails(spark, sf_dir)), lambda: duck.base() + "SELECT label, count(*) AS segments, count(*) FILTER (valid) AS valid FROM spans WHERE b >= 0 AND e > b GROUP BY label"),
    "d03_failing_segments": (lambda spark, sf_dir: eda.failing_segments(fixture.raw_emails(spark, sf_dir)), lambda: duck.base() + "SELECT 'urn:' || doc_id AS urn, CAST(i AS INTEGER) AS i, label, round(100.0::DOUBLE * e / greatest(length(body), 1), 1) AS position_pct FROM spans WHERE NOT valid AND b >= 0 AND e > b ORDER BY urn, i LIMIT 8"),
    "d03b_convention_examples": (lambda spark, sf_dir: eda.convention_examples(fixture.raw_emails(spark, sf_dir)), lambda: duck.base() + TALLY_SQL + "SELECT convention, urn, n_valid, n_total FROM (SELECT *, 'urn:' || doc_id AS urn, row_number() OVER (PARTITION BY convention ORDER BY 'urn:' || doc_id) AS k FROM per WHERE convention <> 'char') t WHERE k <= 5"),
    "p15_dispatch": (lambda spark, sf_dir: records(spark, sf_dir).groupBy(dispatch.kind_of().alias("kind")).agg(F.count("*").alias("n")), lambda: duck.base() + "SELECT CASE kind WHEN 0 THEN 'issue' WHEN 1 THEN 'pull_request' WHEN 2 THEN 'commit' ELSE 'email' END AS kind, count(*) AS n FROM docs GROUP BY 1 UNION ALL SELECT 'repository', count(*) FROM docs WHERE doc_id % 40 = 2 UNION ALL SELECT NULL, count(*) FROM docs WHERE doc_id % 50 = 1"),
    "p15b_dispatched_units": (lambda spark, sf_dir: dispatch.text_units(records(spark, sf_dir)), lambda: duck.base() + "SELECT * FROM text_units"),
    "m01b_bare_repositories": (lambda spark, sf_dir: dispatch.repositories(records(spark, sf_dir)), lambda: duck.base() + "SELECT source AS full_name FROM docs WHERE kind < 3 OR doc_id % 40 = 2 UNION SELECT 'only-' || source FROM docs WHERE doc_id % 50 = 1"),
    "m18_actors": (lambda spark, sf_dir: dispatch.actors(records(spark, sf_dir)), lambda: duck.base() + f"SELECT login, 'User' AS type FROM ({ACTORS_SQL}) t WHERE login <> ''"),
    "m03e_issue_edges": (edge_query("issue"), edge_sql("(SELECT * FROM docs WHERE kind = 0) t", "'repo:' || source", "'issue:' || source || ':' || doc_id", "author")),
    "m04e_pull_edges": (edge_query("pull_request"), edge_sql("(SELECT * FROM docs WHERE kind = 1) t", "'repo:' || source", "'pr:' || source || ':' || doc_id", "author")),
    "m05_commits": (lambda spark, sf_dir: dispatch.nodes(records(spark, sf_dir), "commit"), lambda: duck.base() + "SELECT sha, created AS authored_at, created AS committed_at, left(split_part(body, chr(10), 1), 200) AS message_summary FROM docs WHERE kind = 2"),
    "m05e_commit_edges": (edge_query("commit"), edge_sql("(SELECT *, CASE WHEN doc_id % 5 <> 0 THEN author END AS login FROM docs WHERE kind = 2) t", "'repo:' || source", "'commit:' || sha", "login")),
    "m08e_email_edges": (edge_query("email"), edge_sql("mails", "'list:' || list", "'email:' || urn", "trim(sender)")),
    "m10_classified_as": (classified_as, lambda: duck.base() + "SELECT text_unit_id AS src, text_unit_id || '::' || model_id || '::' || model_version AS dst FROM verdicts SEMI JOIN text_units USING (text_unit_id)"),
    "m18_edge_counts": (lambda spark, sf_dir: dispatch.edges(records(spark, sf_dir)).groupBy("type", F.substring_index("dst", ":", 1).alias("kind")).agg(F.count("*").alias("n")), lambda: duck.base() + f", actors AS ({ACTORS_SQL}), k AS (SELECT *, CASE kind WHEN 0 THEN 'issue' WHEN 1 THEN 'pr' WHEN 2 THEN 'commit' ELSE 'email' END AS to_kind, CASE kind WHEN 2 THEN CASE WHEN doc_id % 5 <> 0 THEN author END WHEN 3 THEN CASE WHEN doc_id % 41 = 0 THEN 'jenkins@ci' ELSE author END ELSE author END AS login FROM docs) SELECT 'CONTAINS' AS type, to_kind AS kind, count(*) AS n FROM k GROUP BY to_kind UNION ALL SELECT 'AUTHORED', to_kind, count(*) FROM k WHERE login IN (SELECT login FROM actors) GROUP BY to_kind"),
    "q402_unit_clusters": (unit_clusters, None),
    "q403_cluster_profile": (cluster_profile, None),
    "q508_false_negatives": (false_negatives, lambda: duck.base() + checks.FALSE_NEGATIVES),
    "g06_struct_sets": (set_sizes, lambda: duck.base() + checks.SET_SIZES),
    "q602b_p_value": (chi_square_p, None),
    "s16_unit_page": (page_of_units, lambda: duck.base() + "SELECT text_unit_id, text FROM text_units WHERE text_unit_id > 'issue:src1' ORDER BY text_unit_id LIMIT 200"),
    "q404_exemplars": (cluster_exemplars, None),
    "w03_top_and_random": (layer_exemplars, lambda: duck.base() + LAYER_EXEMPLARS_SQL),
    "t03_two_stage_stream": (two_stage_stream, lambda: duck.base() + "SELECT layer, count(*) AS n FROM signals GROUP BY layer"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in STEPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, (_, sql) in STEPS.items() if sql}
