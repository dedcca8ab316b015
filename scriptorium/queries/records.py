"""Queries of catalogue, search, vector, queue and view operators."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import display, text, venues
from ..operators import catalog, fuzzy, hybrid, index, queue, search, vectors, views
from ..plans import search_plans
from ..shared import shared_folder
from ..sources import outside, paged, snapshots, store
from ..values import CATEGORY_HINTS, DICTIONARY, EVIDENCE_TERMS, PLAN_PHRASES, PLAN_THEMES, REJECT_TERMS, STAGE_BONUS, STAGE_ORDER, STAGE_WEIGHTS, STOP_WORDS, TOPICS
from .base import PAPERS, contained, distinct_in_order, items, norm, norm_search, papers, q, query, re2, slug, squeeze, tokens
from .text import _RULE, NOW, _candidates, _clean_title, _dirty, _quality

col, lit = F.col, F.lit

#: Hints for invented prose.
HINTS = {"alpha": ["the", "tion"], "beta": ["er", "wh", "qu"], "gamma": ["ung", "sch"], "delta": ["ción", "os "], "epsilon": ["é", "ment"], "zeta": ["zzz"]}
FOCUS = ["the of", "und", "que"]
#: Sources that stand for the official list.
OFFICIAL = "venue IN ('src0', 'src1', 'src2', 'src3')"


def _classified(x: str, hints: dict, default: str, most: int = 4) -> dict[str, str]:
    rows = ", ".join(f"{{'n': -len({contained('b', [h.lower() for h in words])}), 'ord': {i}, 'key': {q(key)}}}" for i, (key, words) in enumerate(hints.items()))
    keys = f"list_transform([{norm(x)}], lambda b: list_transform(list_sort(list_filter([{rows}], lambda r: r.n < 0)), lambda r: r.key))[1]"
    return {"primary": f"coalesce({keys}[1], {q(default)})", "categories": f"list_slice({keys}, 1, {most})"}


_C = _classified("abstract", HINTS, "alpha")


@query("classify", f"WITH {PAPERS} SELECT id, {_C['primary']} AS primary_category, array_to_string({_C['categories']}, ',') AS categories, CAST(len({contained(norm('abstract'), FOCUS)}) AS INTEGER) AS focus_score FROM papers")
def _(t):
    rows = papers(t).select("id", catalog.classify(col("abstract"), HINTS, FOCUS, "alpha").alias("c"))
    return rows.select("id", col("c.primary").alias("primary_category"), F.array_join("c.categories", ",").alias("categories"), "c.focus_score")


@query("topic_terms", f"WITH {PAPERS} SELECT id, array_to_string({contained(squeeze('lower(abstract)'), TOPICS)}, ',') AS topics FROM papers")
def _(t):
    return papers(t).select("id", F.array_join(text.contained(queue.scoring_text(col("abstract")), TOPICS), ",").alias("topics"))


_ASK = "CASE id % 6 WHEN 0 THEN 'RAG memory' WHEN 1 THEN '长上下文 agents' WHEN 2 THEN concat(title, ' 3D world model') WHEN 3 THEN 'robot policy' ELSE title END"


def _labels(part: int) -> str:
    rows = ", ".join(f"CASE WHEN len({contained('n', [search._norm(a) for a in e[1]])}) > 0 THEN {items([e[0]] if part == 0 else e[2])} ELSE [] END" for e in DICTIONARY)
    return f"list_transform([{norm_search('ask')}], lambda n: flatten([{rows}]))[1]"


@query("dictionary_expand", f"WITH {PAPERS}, a AS (SELECT id, {_ASK} AS ask FROM papers) SELECT id, array_to_string({_labels(0)}, ',') AS labels, array_to_string(list_sort(list_distinct({_labels(2)})), ',') AS categories FROM a")
def _(t):
    rows = papers(t).select("id", search.dictionary_matches(F.expr(_ASK)).alias("m"))
    return rows.select("id", F.array_join("m.labels", ",").alias("labels"), F.array_join(F.array_sort("m.categories"), ",").alias("categories"))


@query("facet_venue_year", f"WITH {PAPERS} SELECT split_part(venue, ' ', 1) AS venue, year, count(*) AS count FROM papers GROUP BY ALL")
def _(t):
    return catalog.facet_venue_year(papers(t))


@query("facet_category", f"WITH {PAPERS} SELECT {_C['primary']} AS primary_category, count(*) AS count FROM papers GROUP BY ALL")
def _(t):
    return catalog.facet(papers(t).select(catalog.classify(col("abstract"), HINTS, FOCUS, "alpha")["primary"].alias("primary_category")), "primary_category")


@query("catalog_summary", f"WITH {PAPERS} SELECT count(*) AS papers, count(DISTINCT venue) AS venues, count_if(year = 2026) AS current, count_if(trim(abstract) <> '') AS with_abstract, count_if(l.doc_id IS NOT NULL) AS with_guide FROM papers p LEFT JOIN labels l ON p.id = l.doc_id")
def _(t):
    rows = papers(t).join(t("labels").select(col("doc_id").alias("id"), lit(True).alias("g")), "id", "left")
    return rows.agg(F.count("*").alias("papers"), F.count_distinct("venue").alias("venues"), F.count_if(col("year") == 2026).alias("current"), F.count_if(F.trim("abstract") != "").alias("with_abstract"), F.count_if("g").alias("with_guide"))


@query("top_keywords", "SELECT value, count(*) AS count FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS value FROM part) WHERE value <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(t):
    return views.top_counts(t("part").select(F.explode(F.split("p_name", " ")).alias("k")), "k", 8)


@query("platform_breakdown", """WITH c AS (SELECT conv_id, CASE role WHEN 'user' THEN 'x' WHEN 'assistant' THEN 'arxiv' ELSE 'web' END AS p FROM conversations), u AS (SELECT DISTINCT conv_id, p FROM c WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, p FROM c WHERE conv_id % 2 = 1)
  SELECT CASE p WHEN 'x' THEN 'X' WHEN 'arxiv' THEN 'arXiv' ELSE 'Web / Homepage' END AS platform, count(*) AS count FROM u GROUP BY 1""")
def _(t):
    p = F.when(col("role") == "user", "x").when(col("role") == "assistant", "arxiv").otherwise("web")
    entries = t("conversations").groupBy("conv_id").agg(F.collect_set(p).alias("set"), F.collect_list(p).alias("list"))
    return views.platform_breakdown(entries, F.when(col("conv_id") % 2 == 0, col("set")), col("list"))


@query("stage_breakdown", "SELECT event_type AS stage, count(*) AS queries, sum(CAST(floor(value) AS BIGINT)) AS raw, sum(CAST(floor(value / 2) AS BIGINT)) AS kept, sum(CAST(floor(value) AS BIGINT) - CAST(floor(value / 2) AS BIGINT)) AS rejected FROM events GROUP BY 1")
def _(t):
    raw, kept = F.floor("value"), F.floor(col("value") / 2)
    return views.stage_breakdown(t("events"), "event_type", raw, kept, raw - kept)


_KEY = f"year || '-' || {slug('venue', 'venue')}"


@query("shard_manifest", f"WITH {PAPERS} SELECT {_KEY} AS key, arg_min(venue, pos) AS venue, arg_min(year, pos) AS year, count(*) AS count, 'shards/' || {_KEY} || '.json' AS path FROM papers GROUP BY ALL")
def _(t):
    return catalog.shard_manifest(papers(t))


@query("shard_lookup", f"WITH {PAPERS} SELECT id, title FROM papers WHERE {_KEY} = '2026-src3'")
def _(t):
    return papers(t).where(catalog.shard_key(col("venue"), col("year")) == "2026-src3").select("id", "title")


@query("catalog_sort", f"WITH {PAPERS} SELECT id, venue, title FROM papers ORDER BY venue, title, id")
def _(t):
    return papers(t).select("id", "venue", "title").orderBy(*catalog.catalog_order(), "id")


@query("dedupe_first", f"WITH {PAPERS} SELECT id, venue FROM (SELECT *, row_number() OVER (PARTITION BY abstract ORDER BY pos) AS n FROM papers) WHERE n = 1")
def _(t):
    return catalog.dedupe_first(papers(t).select("id", "pos", "venue", F.sha2("abstract", 256).alias("k")), ["k"], "pos").select("id", "venue")


@query("dedupe_last", f"WITH {PAPERS} SELECT title, arg_max(id, pos) AS id, arg_max(venue, pos) AS venue, min(pos) AS pos FROM papers GROUP BY 1")
def _(t):
    return catalog.dedupe_last(papers(t).select("title", "id", "venue", "pos"), ["title"], "pos")


@query("id_suffix", f"WITH {PAPERS}, n AS (SELECT pos, lower(string_split(title, ' ')[1]) AS k, row_number() OVER (PARTITION BY lower(string_split(title, ' ')[1]) ORDER BY pos) AS n FROM papers) SELECT pos, CASE n WHEN 1 THEN k ELSE k || '-' || n END AS id FROM n")
def _(t):
    return catalog.suffix_ids(papers(t).select("pos", F.lower(F.get(F.split("title", " "), 0)).alias("id")), "id", "pos")


@query("source_fallback", f"WITH {PAPERS}, c AS (SELECT id, venue, 'now' AS taken FROM papers WHERE venue IN ('src1', 'src4', 'src7') AND lang = 'en') SELECT * FROM c UNION ALL SELECT id, venue, 'before' FROM papers WHERE venue NOT IN (SELECT venue FROM c)")
def _(t):
    rows = papers(t).select("id", "venue", "lang")
    now = rows.where("venue IN ('src1', 'src4', 'src7') AND lang = 'en'").drop("lang").withColumn("taken", lit("now"))
    return catalog.with_fallback(now, rows.drop("lang").withColumn("taken", lit("before")), "venue")


_G = "SELECT l.doc_id AS pos, CASE l.doc_id % 3 WHEN 0 THEN CAST(l.doc_id AS VARCHAR) END AS id, CASE l.doc_id % 3 WHEN 1 THEN p.title END AS title, CASE l.doc_id % 3 WHEN 2 THEN 'u' || l.doc_id END AS url, l.quality FROM labels l JOIN papers p ON l.doc_id = p.id"


@query("guide_enrich", f"""WITH {PAPERS}, g AS ({_G}), a AS (SELECT id AS k, arg_max(quality, pos) AS v FROM g WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT {norm('title')} AS k, arg_max(quality, pos) AS v FROM g WHERE title IS NOT NULL AND {norm('title')} <> '' GROUP BY 1), c AS (SELECT url AS k, arg_max(quality, pos) AS v FROM g WHERE url IS NOT NULL GROUP BY 1)
  SELECT p.id, coalesce(a.v, b.v, c.v) AS quality, CASE WHEN coalesce(a.v, b.v, c.v) IS NULL THEN 'pending' ELSE 'ready' END AS status FROM papers p LEFT JOIN a ON CAST(p.id AS VARCHAR) = a.k LEFT JOIN b ON {norm('p.title')} = b.k LEFT JOIN c ON 'u' || p.id = c.k""")
def _(t):
    rows = papers(t).select("id", "title", F.concat(lit("u"), "id").alias("url"))
    on = lambda n, x: F.when(F.pmod("doc_id", lit(3)) == n, x)
    guides = t("labels").join(rows.select(col("id").alias("doc_id"), "title"), "doc_id").select(col("doc_id").alias("pos"), on(0, col("doc_id").cast("string")).alias("id"), on(1, col("title")).alias("title"), on(2, F.concat(lit("u"), "doc_id")).alias("url"), "quality")
    return catalog.enrich_with_guides(rows, guides, ["quality"]).select("id", "quality", col("guideStatus").alias("status"))


@query("official_anti_join", f"WITH {PAPERS}, o AS (SELECT DISTINCT {norm('title')} AS k FROM papers WHERE venue IN ('src0', 'src1', 'src2', 'src3')) SELECT id, title FROM papers WHERE NOT venue IN ('src0', 'src1', 'src2', 'src3') AND {norm('title')} NOT IN (SELECT k FROM o WHERE k <> '')")
def _(t):
    rows = papers(t).select("id", "title", "venue")
    return catalog.without_official(rows.where(f"NOT {OFFICIAL}"), rows.where(OFFICIAL)).drop("venue")


@query("official_promote", f"""WITH {PAPERS}, o AS (SELECT {norm('title')} AS k, arg_min(venue, pos) AS venue, arg_min(year, pos) AS year FROM papers WHERE venue IN ('src0', 'src1', 'src2', 'src3') GROUP BY 1)
  SELECT p.id, CASE WHEN o.k IS NULL THEN 'candidate' ELSE 'officially-published' END AS status, o.venue AS "acceptedVenue", o.year AS "acceptedYear", CASE WHEN o.k IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM papers p LEFT JOIN o ON {norm('p.title')} = o.k AND o.k <> '' WHERE NOT p.venue IN ('src0', 'src1', 'src2', 'src3')""")
def _(t):
    rows = papers(t)
    entries = rows.where(f"NOT {OFFICIAL}").select("id", "title", lit("candidate").alias("status"), lit(None).cast("string").alias("acceptedVenue"), lit(None).cast("int").alias("acceptedYear"), lit(0.5).alias("confidence"))
    return catalog.promote_official(entries, rows.where(OFFICIAL).select("pos", "title", "venue", "year")).drop("title")


@query("facet_filter", f"WITH {PAPERS} SELECT id, venue, year, lang FROM papers WHERE venue || ':' || year IN ('src3:2026', 'src5:2025', 'src7:2024') AND lang IN ('en', 'fr')")
def _(t):
    return catalog.facet_filter(papers(t), ["src3:2026", "src5:2025", "src7:2024"], ["en", "fr"], "lang").select("id", "venue", "year", "lang")


@query("paginate", "WITH r AS (SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) SELECT o_orderkey, o_totalprice, rank, 40 AS pages FROM r WHERE rank BETWEEN 51 AND 75")
def _(t):
    return catalog.paginate(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), col("o_orderkey")], 1000, 3, 25)


@query("latest_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 8")
def _(t):
    return views.latest(t("events"), "ts", "event_id", 8).select("event_id", "event_type")


@query("timeline", """WITH i AS (SELECT * FROM (SELECT event_id AS id, props AS title, ts, 'paper' AS kind FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, id LIMIT 6) UNION ALL SELECT * FROM (SELECT event_id, props, ts, 'workflow' FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 4)
  UNION ALL SELECT * FROM (SELECT event_id, props, ts, 'snapshot' FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id LIMIT 1)) SELECT id, title, kind FROM i ORDER BY ts DESC, kind, id LIMIT 10""")
def _(t):
    rows = t("events").select(col("event_id").alias("id"), col("props").alias("title"), "ts", "event_type")
    return views.timeline([("paper", rows.where("event_type = 'purchase'"), 6), ("workflow", rows.where("event_type = 'error'"), 4), ("snapshot", rows.where("event_type = 'signup'"), 1)]).select("id", "title", "kind")


@query("exact_collapse", f"WITH {PAPERS}, s AS (SELECT id, {norm('title')} = (SELECT {norm('title')} FROM papers WHERE id = 7) AS exact FROM papers) SELECT id FROM s WHERE exact OR NOT (SELECT bool_or(exact) FROM s)")
def _(t):
    rows = papers(t)
    wanted = rows.where("id = 7").select(text.normalize_text(col("title")).alias("w"), lit(1).alias("one"))
    scored = rows.withColumn("one", lit(1)).join(F.broadcast(wanted), "one").withColumn("exact", text.normalize_text(col("title")) == col("w"))
    return search.exact_collapse(scored.select("id", "exact")).select("id")


TEXT = "the ing of tion"
_Q = search.expand(TEXT)
def _fuzzy(relation: str, ident: str, fields: dict[str, float], asked: str, total: float) -> str:
    """A CTE `fuzzy` (id, score) by the definition: of every part of a value that is about as long as the query, the edits.

    Letters beyond ASCII, which no query here has, count as one byte, as edits do in DuckDB.
    """
    m, most = len(asked), int(0.34 * len(asked))
    values = " UNION ALL ".join(f"SELECT {ident} AS id, {w} AS w, regexp_replace(lower({c}), '[^\\x00-\\x7F]', '~', 'g') AS x FROM {relation} WHERE trim({c}) <> ''" for c, w in fields.items())
    return f"""fv AS ({values}), fx AS MATERIALIZED (SELECT x, row_number() OVER () AS n FROM (SELECT DISTINCT x FROM fv)), fs AS (SELECT n, x, unnest(range(1, greatest(1, length(x) - {m - most} + 1) + 1)) AS i FROM fx),
  fp AS MATERIALIZED (SELECT n, substr(x, i, {m + most}) AS p FROM fs), fd AS MATERIALIZED (SELECT DISTINCT p FROM fp), fe AS (SELECT p, least({", ".join(f"levenshtein({q(asked)}, left(p, {n}))" for n in range(m - most, m + most + 1))}) AS e FROM fd),
  fw AS (SELECT fx.x, min(fe.e) AS e FROM fp JOIN fe ON fe.p = fp.p JOIN fx ON fx.n = fp.n GROUP BY fx.x),
  fuzzy AS (SELECT id, 1 - exp(sum(w / {total} * round(1 / sqrt(len(regexp_extract_all(fv.x, '[^ ]+'))), 3) * ln(CASE WHEN fv.x = {q(asked)} THEN 2.220446049250313e-16 ELSE greatest(e / {m}.0, 0.001) END))) AS score FROM fv JOIN fw ON fw.x = fv.x WHERE e <= {most} GROUP BY id)"""


_BASE = "100 * coalesce((SELECT f.score FROM fuzzy f WHERE f.id = l.id), 0)"
def _lex(text: str, limit: int = 100) -> str:
    """CTEs up to `lex` (id, pos, score, exact, strong): the lexical hits of a query."""
    asked = search.expand(text)
    return f"""{_fuzzy("papers", "id", {"title": 4.0, "abstract": 1.0}, text, 14.6)}, l AS (SELECT id, pos, {norm_search('title')} AS t, {norm_search("concat_ws(' ', nullif(title, ''), nullif(venue, ''), nullif(abstract, ''))")} AS b FROM papers),
  s AS (SELECT id, pos, t = {q(asked.norm)} AS exact, contains(t, {q(asked.norm)}) AS tc, contains(b, {q(asked.norm)}) AS bc,
  CAST({_BASE} + CASE WHEN t = {q(asked.norm)} THEN 240 ELSE 0 END + CASE WHEN contains(t, {q(asked.norm)}) THEN 70 ELSE 0 END + CASE WHEN contains(b, {q(asked.norm)}) THEN 42 ELSE 0 END + 14 * len({contained('b', asked.tokens)})
  + CASE WHEN len(list_filter({contained('b', asked.tokens)}, lambda h: contains(t, h))) > 0 THEN 28 ELSE 0 END + 8 * len({contained('b', asked.terms)}) AS DOUBLE) AS score FROM l),
  lex AS (SELECT id, pos, score, exact, tc OR bc AS strong FROM s WHERE score > 0 AND (exact OR NOT (SELECT coalesce(bool_or(exact), false) FROM s WHERE score > 0)) ORDER BY score DESC, pos LIMIT {limit})"""


_LEX = _lex(TEXT)


def _lexical(t, limit: int = 100):
    return search.lexical_search(search.prepare(papers(t), blob=["venue", "abstract"]), _Q, limit)


@query("lexical_search", f"WITH {PAPERS}, {_LEX} SELECT id, round(score, 6) AS score, exact FROM lex")
def _(t):
    return _lexical(t).select("id", F.round("score", 6).alias("score"), "exact")


@query("indexed_search", f"WITH {PAPERS}, {_lex('password token', 40)} SELECT id, round(score, 6) AS score, exact FROM lex")
def _(t):
    rows = papers(t)
    path = f"{shared_folder(rows.sparkSession)}/index-{uuid.uuid4().hex}"
    made = lambda x: search.prepare(x, blob=["venue", "abstract"])
    index.build_index(rows, path, prepare=made)
    hits, _ = index.indexed_search(rows.sparkSession, path, search.expand("password token"), 40, prepare=made)
    return hits.select("id", F.round("score", 6).alias("score"), "exact")


@query("text_rank", f"""WITH {PAPERS}, b AS (SELECT id, pos, {norm_search('title')} AS t, {norm_search("concat_ws(' ', nullif(title, ''), nullif(venue, ''), nullif(lang, ''))")} AS b FROM papers),
  s AS (SELECT id, pos, CASE WHEN contains(b, {q(_Q.norm)}) THEN 160 ELSE 0 END + 16 * len({contained('b', _Q.tokens)}) + CASE WHEN contains(t, {q(_Q.norm)}) THEN 40 ELSE 0 END AS score FROM b) SELECT id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, pos LIMIT 40""")
def _(t):
    return search.text_rank(papers(t), TEXT, ["title", "venue", "lang"], 40).select("id", "score")


@query("fuzzy_title", f"WITH {_fuzzy('part', 'p_partkey', {'p_name': 4.0, 'p_type': 1.0}, 'smal rings', 5.0)} SELECT id AS p_partkey, round(score, 9) AS fuzzy FROM fuzzy ORDER BY score DESC, id LIMIT 50")
def _(t):
    return fuzzy.fuzzy_rows(t("part"), "smal rings", 50, {"p_name": 4.0, "p_type": 1.0}, "p_partkey").select("p_partkey", F.round("fuzzy", 9).alias("fuzzy"))


_NAMES = "SELECT p_partkey AS id, concat(p_name, ' of ', p_type, ' ', p_name, CASE WHEN p_partkey % 5 = 0 THEN ' (' || upper(left(p_name, 1)) || upper(left(split_part(p_name, ' ', 2), 1)) || ')' ELSE '' END) AS title FROM part"
_STOP = items(STOP_WORDS)
_ACRO = "array_to_string(list_transform(list_filter({t}, lambda w: NOT list_contains(" + _STOP + ", w)), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN regexp_extract(regexp_replace(w, '[^a-z0-9]+', '', 'g'), '^[0-9]+[a-z]?', 0) ELSE left(regexp_replace(w, '[^a-z0-9]+', '', 'g'), 1) END), '')"
_OK = "length(a) BETWEEN 2 AND 12 AND regexp_matches(a, '[a-z]') AND NOT list_contains(" + _STOP + ", a) AND len(list_filter(t, lambda w: length(w) > 2 AND NOT list_contains(" + _STOP + ", w))) > 0 AND len(t) >= 2"
_ACRONYMS = f"""n AS ({_NAMES}), w AS (SELECT id, list_filter({tokens('title')}, lambda t: length(t) > 1) AS w FROM n), g AS (SELECT unnest(list_filter(flatten(list_transform([2, 3, 4, 5], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: list_slice(w, i, i + k - 1)))), lambda t: len(t) > 1)) AS t FROM w),
  x AS (SELECT {_ACRO.format(t='t')} AS a, t, 1 AS weight FROM g), lp AS (SELECT regexp_extract_all(title, {re2(search.LONG_SHORT)}, 2) AS s, regexp_extract_all(title, {re2(search.LONG_SHORT)}, 1) AS l, regexp_extract_all(title, {re2(search.SHORT_LONG)}, 1) AS s2, regexp_extract_all(title, {re2(search.SHORT_LONG)}, 2) AS l2 FROM n WHERE contains(title, '(')),
  bp AS (SELECT unnest(list_concat(s, s2)) AS s, unnest(list_concat(l, l2)) AS l FROM lp), br AS (SELECT regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS a, list_filter(string_split({norm_search("array_to_string(list_slice(string_split_regex(trim(l), '[ ]+'), -6, -1), ' ')")}, ' '), lambda t: t <> '') AS t FROM bp),
  bx AS (SELECT a, t, 4 AS weight FROM br WHERE {_ACRO.format(t='t')} = a OR contains({_ACRO.format(t='t')}, a) OR contains(a, {_ACRO.format(t='t')})), u AS (SELECT * FROM x UNION ALL SELECT * FROM bx), idx AS (SELECT a AS acronym, array_to_string(t, ' ') AS phrase, CAST(sum(weight) AS BIGINT) AS weight FROM u WHERE {_OK} GROUP BY ALL)"""


def _names(t):
    tag = F.when(col("p_partkey") % 5 == 0, F.concat(lit(" ("), F.upper(F.left("p_name", lit(1))), F.upper(F.left(F.get(F.split("p_name", " "), 1), lit(1))), lit(")"))).otherwise("")
    return t("part").select(col("p_partkey").alias("id"), F.concat("p_name", lit(" of "), "p_type", lit(" "), "p_name", tag).alias("title"))


@query("acronym_index", f"WITH {_ACRONYMS} SELECT acronym, phrase, weight FROM idx")
def _(t):
    return search.acronym_index(_names(t))


@query("acronym_expand", f"WITH {_ACRONYMS}, r AS (SELECT acronym, phrase, weight, CAST(row_number() OVER (PARTITION BY acronym ORDER BY weight DESC, phrase) AS INTEGER) AS rank FROM idx WHERE acronym IN ('rw', 'sr', 'bb', 'the')) SELECT * FROM r WHERE rank <= 8")
def _(t):
    return search.acronym_expand(search.acronym_index(_names(t)), "RW of the sr. BB!")


_SEM = "sem AS (SELECT e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) o ORDER BY 2 DESC, 1 LIMIT 100)"


def _semantic(t, k: int = 100):
    rows = t("embeddings").withColumnRenamed("vec_id", "id")
    return vectors.top_k(rows, rows.where("id = 0").first()["embedding"], k)


@query("vector_topk", f"WITH {_SEM} SELECT id, round(score, 9) AS score FROM sem")
def _(t):
    return _semantic(t).select("id", F.round("score", 9).alias("score"))


@query("vector_topk_chunked", f"WITH {_SEM} SELECT id, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sem")
def _(t):
    rows = t("embeddings").withColumnRenamed("vec_id", "id")
    path = f"{shared_folder(rows.sparkSession)}/chunks-{uuid.uuid4().hex}"
    vectors.write_chunks(rows, path, size=128, regions=64)
    hits, _, _ = vectors.top_k_chunked(rows.sparkSession, path, rows.where("id = 0").first()["embedding"], 100)
    return hits.select("id", F.round("score", 9).alias("score"), "rank")


_MANY = sorted({f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("th", "er", "ion", "ough", "ly")})


@query("large_dictionary", f"SELECT doc_id, len(f) AS terms, md5(array_to_string(f, ',')) AS digest FROM (SELECT doc_id, {contained('text', _MANY)} AS f FROM documents WHERE text IS NOT NULL)")
def _(t):
    found = text.contained(col("text"), _MANY)
    return t("documents").where("text IS NOT NULL").select("doc_id", found.alias("f")).select("doc_id", F.size("f").alias("terms"), F.md5(F.array_join("f", ",")).alias("digest"))


@query("queue_snapshot", f"WITH {PAPERS} SELECT id, CASE WHEN id % 10 = 0 THEN 'changed ' || coalesce(title, '') ELSE title END AS title FROM papers WHERE id % 7 <> 3")
def _(t):
    rows = papers(t).select("id", "title")
    path = f"{shared_folder(rows.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    snapshots.write_snapshot(rows, path, "id")
    changed = F.when(col("id") % 10 == 0, F.concat(lit("changed "), F.coalesce("title", lit("")))).otherwise(col("title"))
    snapshots.write_snapshot(rows.where("id % 7 <> 3").withColumn("title", changed), path, "id")
    return snapshots.read_snapshot(rows.sparkSession, path)


@query("vector_topk_many", """WITH o AS (SELECT 'q' || vec_id AS query, embedding AS v FROM embeddings WHERE vec_id IN (1, 2, 3)), s AS (SELECT o.query, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], o.v::DOUBLE[]) AS score FROM embeddings e, o), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
  SELECT query, id, round(score, 9) AS score, rank FROM r WHERE rank <= 10""")
def _(t):
    rows = t("embeddings").withColumnRenamed("vec_id", "id")
    asked = {f"q{r['id']}": list(r["embedding"]) for r in rows.where("id IN (1, 2, 3)").collect()}
    return vectors.top_k_many(rows, asked, 10).withColumn("score", F.round("score", 9))


@query("vector_shape_check", "SELECT count(*) AS rows, count_if(len(embedding) <> 64) AS wrong_size, count_if(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite FROM embeddings")
def _(t):
    return vectors.check_shape(t("embeddings"), 64)


_RRF = f"""{_LEX}, {_SEM}, sr AS (SELECT id, score, 1.0::DOUBLE / (row_number() OVER (ORDER BY score DESC, id) + 60.0::DOUBLE) AS r FROM sem), lr AS (SELECT id, score, exact, 1.0::DOUBLE / (row_number() OVER (ORDER BY score DESC, pos) + 60.0::DOUBLE) * CASE WHEN exact THEN 3.2::DOUBLE WHEN strong THEN 2.6::DOUBLE WHEN score >= 80 THEN 2.0::DOUBLE ELSE 1.35::DOUBLE END AS r FROM lex),
  f AS (SELECT p.id, p.pos, coalesce(sr.r, 0) + coalesce(lr.r, 0) AS rs, sr.score AS ss, lr.score AS ls, coalesce(lr.exact, false) AS exact FROM sr FULL OUTER JOIN lr ON sr.id = lr.id JOIN papers p ON p.id = coalesce(sr.id, lr.id)),
  k AS (SELECT *, CAST(row_number() OVER (ORDER BY rs DESC, coalesce(ls, 0) DESC, coalesce(ss, 0) DESC, pos) AS INTEGER) AS rank FROM f)"""


@query("rrf_fuse", f"WITH {PAPERS}, {_RRF} SELECT id, rank, round(rs, 12) AS rank_score, round(ss, 9) AS semantic_score, round(ls, 6) AS lexical_score, exact FROM k")
def _(t):
    hits = hybrid.fuse(_semantic(t), _lexical(t), papers(t))
    return hits.select("id", "rank", F.round("rankScore", 12).alias("rank_score"), F.round("semanticScore", 9).alias("semantic_score"), F.round("lexicalScore", 6).alias("lexical_score"), col("exactTitleMatch").alias("exact"))


@query("hybrid_search", f"WITH {PAPERS}, {_RRF} SELECT k.id, p.title, p.venue, p.year, k.rank FROM k JOIN papers p ON p.id = k.id WHERE p.lang IN ('en', 'de') QUALIFY row_number() OVER (ORDER BY k.rank) <= 20")
def _(t):
    rows = papers(t)
    hits = hybrid.fuse(_semantic(t), _lexical(t), rows).select("id", "rank").join(rows, "id")
    return catalog.facet_filter(hits, [], ["en", "de"], "lang").orderBy("rank").limit(20).select("id", "title", "venue", "year", "rank")


@query("embed_reuse", "SELECT doc_id AS id, sha1(text) AS fingerprint, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS reused FROM documents")
def _(t):
    now = t("documents").select(col("doc_id").alias("id"), F.sha1("text").alias("fingerprint"))
    other = F.when(col("id") % 7 == 0, "changed").otherwise(col("fingerprint"))
    stored = now.where("id % 3 <> 0").select("id", other.alias("fingerprint"), lit("m").alias("model")).unionByName(now.select("id", "fingerprint", lit("old").alias("model")))
    return vectors.reuse_split(now, stored, "m")


def _manifest_sql(where: str) -> str:
    return f"""SELECT key, CAST(part AS INTEGER) AS part, CAST(min(o) AS BIGINT) AS "offset", count(*) AS count, 64 AS dimensions, 'vectors.' || key || '.' || lpad(CAST(part AS VARCHAR), 3, '0') || '.f32.bin' AS file, CAST(count(*) * 256 AS INTEGER) AS bytes,
  sha1(key || chr(10) || part || chr(10) || min(o) || chr(10) || count(*) || chr(10) || '64' || chr(10) || string_agg(vec_id || chr(10), '' ORDER BY vec_id) || string_agg(fp || chr(10), '' ORDER BY vec_id)) AS fingerprint
  FROM (SELECT *, floor(i / 20)::BIGINT + 1 AS part, row_number() OVER (ORDER BY key, vec_id) - 1 AS o FROM (SELECT vec_id, 'k' || label AS key, sha1(CAST(vec_id AS VARCHAR)) AS fp, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings WHERE {where})) GROUP BY key, part"""


def _manifest(t, where: str = "true"):
    rows = t("embeddings").where(where).select("vec_id", F.concat(lit("k"), "label").alias("key"), F.sha1(col("vec_id").cast("string").cast("binary")).alias("fp"))
    return vectors.chunk_manifest(rows, "key", "vec_id", "vec_id", "fp", 64, size=20).withColumn("bytes", col("bytes").cast("int"))


@query("chunk_manifest", _manifest_sql("true"))
def _(t):
    return _manifest(t)


@query("chunk_delta", f"WITH a AS ({_manifest_sql('true')}), b AS ({_manifest_sql('label <> 7')}) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'delete' WHEN a = b THEN 'keep' ELSE 'write' END AS action FROM a FULL OUTER JOIN b ON a.file = b.file".replace("a = b", 'a."offset" = b."offset" AND a.count = b.count AND a.fingerprint = b.fingerprint'))
def _(t):
    return vectors.chunk_delta(_manifest(t), _manifest(t, "label <> 7"))


@query("batching", "SELECT p_partkey, p_brand, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 32) AS BIGINT) AS batch FROM part")
def _(t):
    return vectors.batches(t("part").select("p_partkey", "p_brand"), "p_partkey", 32, "p_brand")


_STAGE = "CASE id % 9 " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(STAGE_ORDER[:8])) + " ELSE 'follow-up' END"
_LINK = "CASE id % 5 WHEN 0 THEN concat('https://github.com/lab/t', id) WHEN 1 THEN concat('https://example.com/', id) WHEN 2 THEN concat('https://arxiv.org/list/', id) WHEN 3 THEN concat('https://lab.edu/', id) ELSE 'https://news.example.com' END"
_SNIP = "CASE id % 11 WHEN 0 THEN 'our paper accepted to ACL 2026, project page' WHEN 1 THEN 'awesome list' WHEN 2 THEN 'Workshop call' WHEN 3 THEN 'introducing a multimodal agent' ELSE '' END"
_EVID = f"{PAPERS}, ev AS (SELECT id, title, {_STAGE} AS stage, {_LINK} AS url, {_SNIP} AS snippet, {squeeze(f'lower(concat_ws(chr(32), title, {_SNIP}, {_LINK}))')} AS x FROM papers)"


def _weights(x: str, weights: dict[str, int]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in weights.items()) + " ELSE 0 END"


_TERMS = " + ".join(f"{w} * len({contained('x', [k for k, v in words.items() if v == w])})" for words in EVIDENCE_TERMS.values() for w in sorted(set(words.values())))
_BAD = f"len({contained('x', REJECT_TERMS)}) > 0"
_HIGH = r"regexp_matches(url, '(?i)arxiv\.org|github\.com|github\.io|openreview\.net|x\.com|twitter\.com|\.edu')"
_SCORED = f"sc AS (SELECT *, {_BAD} AS bad, {_HIGH} AS high, {_weights('stage', STAGE_WEIGHTS)} + {_TERMS} + CASE WHEN {_BAD} THEN -5 ELSE 0 END + CASE WHEN {_HIGH} THEN 2 ELSE 0 END + {_weights('stage', STAGE_BONUS)} AS score FROM ev)"


def _scored(t):
    rows = papers(t).select("id", "title", F.expr(_STAGE).alias("stage"), F.expr(_LINK).alias("url"), F.expr(_SNIP).alias("snippet"))
    return rows.withColumn("r", queue.evidence_score(queue.scoring_text(col("title"), col("snippet"), col("url")), col("stage"), col("url")))


@query("evidence_score", f"WITH {_EVID}, {_SCORED} SELECT id, CAST(score AS INTEGER) AS score, NOT bad AND (score >= 3 OR (score >= 1 AND (high OR stage = 'follow-up'))) AS keep, bad AS strong_reject FROM sc")
def _(t):
    return _scored(t).select("id", "r.score", "r.keep", "r.strong_reject")


_YEAR = r"(?i)\b(?:aaai|acl|emnlp|cvpr|iccv|iclr|icml|neurips|siggraph|kdd|www|ijcai|colm|mm|sigir)[-\s]?(?:2026|26)\b"


@query("evidence_priority", f"""WITH {_EVID}, {_SCORED} SELECT id, CAST(score + {_weights('stage', STAGE_WEIGHTS)} + CASE WHEN regexp_matches(url, '(?i)github\\.com|github\\.io') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(concat_ws(' ', title, snippet, url), {q(_YEAR)}) THEN 8 ELSE 0 END
  - CASE WHEN regexp_matches(url, '(?i)arxiv\\.org/list/') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(x, '\\bawesome\\b|curated list|reading list|survey list|leaderboard') THEN 8 ELSE 0 END AS INTEGER) AS priority FROM sc""")
def _(t):
    return _scored(t).select("id", queue.evidence_priority(col("r.score"), col("stage"), col("url"), F.concat_ws(" ", "title", "snippet", "url")).alias("priority"))


_CAND = "CASE id % 10 WHEN 0 THEN '' WHEN 1 THEN 'GitHub - lab/tool' WHEN 2 THEN 'Our research interests and more' WHEN 3 THEN 'Abstract of a thing' WHEN 4 THEN 'abc' ELSE title END"
_CURL = "CASE id % 7 WHEN 0 THEN 'not a url' WHEN 1 THEN 'https://github.com/topics/nlp' WHEN 2 THEN 'https://github.com/me/me.github.io' ELSE concat('https://example.com/', id) END"
_BROKEN = " OR ".join(f"regexp_matches({squeeze('c')}, {re2(p)})" for p in queue.BROKEN_TITLE)


@query("reject_reasons", f"""WITH {PAPERS}, c AS (SELECT id, {_CAND} AS c, {_CURL} AS u, id % 13 = 0 AS official FROM papers) SELECT id, CASE WHEN {squeeze('c')} = '' OR NOT regexp_matches(u, '(?i)^https?://') THEN 'missing-title-or-primary-url' WHEN length({squeeze('c')}) NOT BETWEEN 4 AND 300 OR {_BROKEN} THEN 'broken-title-shape'
  WHEN contains(u, 'github.com/topics/') OR contains(u, 'me/me.github.io') OR regexp_matches({squeeze('c')}, '(?i)\\b(research interests?|selected research)\\b') THEN 'generic-homepage-or-topic' WHEN {norm('c')} = '' THEN 'missing-title-key' WHEN official THEN 'already-in-official-catalog' END AS reason FROM c""")
def _(t):
    return papers(t).select("id", queue.reject_reason(F.expr(_CAND), F.expr(_CURL), F.expr("id % 13 = 0")).alias("reason"))


_ORDER = ["error", "purchase", "signup"]


@query("round_robin", """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, list_position(['error', 'purchase', 'signup'], event_type) AS p FROM events), k AS (SELECT *, row_number() OVER (ORDER BY p IS NULL, CASE WHEN p IS NOT NULL THEN turn END, p, event_id) AS pick FROM r)
  SELECT event_id, event_type, CAST(turn AS INTEGER) AS turn, CAST(pick AS INTEGER) AS pick FROM k WHERE pick <= 40""")
def _(t):
    return queue.round_robin(t("events").select("event_id", "event_type"), "event_type", "event_id", 40, _ORDER)


@query("backfill_fill", """WITH b AS (SELECT event_id, user_id, 0 AS tier FROM events WHERE event_type = 'error' AND value > 90 UNION ALL SELECT event_id, user_id, 1 FROM events WHERE event_type = 'view'), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, event_id) = 1) SELECT event_id, user_id, tier FROM f ORDER BY tier, event_id LIMIT 60""")
def _(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return queue.backfill(e.where("event_type = 'error' AND value > 90").drop("event_type", "value"), e.where("event_type = 'view'").drop("event_type", "value"), "user_id", [col("event_id")], 60)


_VALUES = ", ".join(f"({q(s)}, {i}, {q(x)})" for (s, _, _), xs in search_plans.FAMILIES.items() for i, x in enumerate(xs, 1))


def _papers_by_stage(t):
    """How many papers each stage has found."""
    return papers(t).groupBy(F.expr(_STAGE).alias("stage")).agg(F.count("*").alias("papers"))


@query("plan_generate", f"""WITH f(stage, i, query) AS (VALUES {_VALUES}), s AS (SELECT stage || '-' || i AS label, query, stage FROM f UNION ALL SELECT 'social-' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 32), ''), 'query') || '-' || j, p || ' ' || h || ' 2026', 'social'
  FROM (SELECT unnest({items(PLAN_PHRASES)}) AS p), (SELECT unnest({items(PLAN_THEMES)}) AS h, unnest(range(1, {len(PLAN_THEMES) + 1})) AS j)), {PAPERS}, k AS (SELECT {_STAGE} AS stage, count(*) AS papers FROM papers GROUP BY 1)
  SELECT label, query, s.stage, coalesce(papers, 0) AS papers FROM s LEFT JOIN k ON k.stage = s.stage""")
def _(t):
    plans = search_plans.static_plans(t("documents").sparkSession)
    return plans.join(_papers_by_stage(t), "stage", "left").select("label", "query", "stage", F.coalesce("papers", lit(0)).alias("papers"))


@query("plan_select", f"""WITH f(stage, i, query) AS (VALUES {_VALUES}), s AS (SELECT stage, i FROM f UNION ALL SELECT 'social', i FROM range(1, {len(PLAN_PHRASES) * len(PLAN_THEMES) + 1}) r(i)), r AS (SELECT stage, row_number() OVER (ORDER BY i, list_position({items(STAGE_ORDER)}, stage)) AS n FROM s), {PAPERS}, k AS (SELECT {_STAGE} AS stage, count(*) AS papers FROM papers GROUP BY 1), p AS (SELECT stage, count(*) AS plans FROM r WHERE n <= 16 GROUP BY 1)
  SELECT p.stage, plans, coalesce(papers, 0) AS papers FROM p LEFT JOIN k ON k.stage = p.stage""")
def _(t):
    picked = search_plans.select_plans(search_plans.static_plans(t("documents").sparkSession), 16).groupBy("stage").agg(F.count("*").alias("plans"))
    return picked.join(_papers_by_stage(t), "stage", "left").select("stage", "plans", F.coalesce("papers", lit(0)).alias("papers"))


@query("follow_up_plans", f"""WITH {PAPERS}, e AS (SELECT id, {_LINK} AS url FROM papers) SELECT id * 10 + j AS pos, CASE j WHEN 0 THEN '"lab/t' || id || '" paper accepted 2026' ELSE 'site:x.com "t' || id || '" paper' END AS query, CASE j WHEN 0 THEN 'web' ELSE 'x' END AS platform FROM e, (SELECT unnest([0, 1]) AS j) WHERE id % 5 = 0""")
def _(t):
    return search_plans.follow_up_plans(papers(t).select("pos", F.expr(_LINK).alias("url"), lit("no venue here").alias("text"))).select("pos", "query", "platform")


_CONV = "SELECT conv_id, turn, role AS platform, 'u' || (turn % 2) AS url, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS title, text AS snippet, CASE WHEN turn % 2 = 0 THEN '2026-0' || (turn % 9 + 1) ELSE '' END AS \"publishDate\" FROM conversations"


@query("evidence_merge", f"""WITH c AS ({_CONV}), b AS (SELECT conv_id, platform, url, turn, nullif(trim(title), '') AS t, nullif(trim(snippet), '') AS s, nullif("publishDate", '') AS d FROM c)
  SELECT conv_id, platform, url, min(turn) AS turn, arg_max(t, (length(t), -turn)) FILTER (WHERE t IS NOT NULL) AS title, arg_max(s, (length(s), -turn)) FILTER (WHERE s IS NOT NULL) AS snippet, coalesce(arg_max(d, turn) FILTER (WHERE d IS NOT NULL), '') AS "publishDate" FROM b GROUP BY 1, 2, 3""")
def _(t):
    c = t("conversations")
    rows = c.select("conv_id", "turn", col("role").alias("platform"), F.concat(lit("u"), (col("turn") % 2).cast("string")).alias("url"), F.when(col("turn") % 3 == 0, "").otherwise(col("text")).alias("title"), col("text").alias("snippet"), F.when(col("turn") % 2 == 0, F.concat(lit("2026-0"), (col("turn") % 9 + 1).cast("string"))).otherwise("").alias("publishDate"))
    return queue.merge_evidence(rows, "conv_id", "turn")


@query("status_lattice", "SELECT user_id || ':' || hour(ts) AS entry, ['ignored', 'candidate', 'accepted', 'officially-published'][1 + max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)] AS status FROM events GROUP BY 1")
def _(t):
    s = F.when(col("event_type") == "purchase", "officially-published").when(col("event_type") == "signup", "accepted").when(col("event_type") == "click", "candidate").otherwise("ignored")
    return queue.status_lattice(t("events").select(F.concat_ws(":", "user_id", F.hour("ts")).alias("entry"), s.alias("status")), "entry")


_ST = "CASE event_id % 4 WHEN 0 THEN 'ignored' WHEN 1 THEN 'candidate' WHEN 2 THEN 'accepted' ELSE 'officially-published' END"
_TI = "CASE WHEN event_id % 29 = 0 THEN 'bibtex @inproceedings' WHEN event_id % 31 = 0 THEN 'a title ## ' ELSE props END"


@query("recheck_due", f"""WITH r AS (SELECT event_id, {_ST} AS s, {_TI} AS t, CASE WHEN event_id % 5 <> 0 THEN ts END AS c FROM events) SELECT event_id, CASE WHEN s = 'officially-published' THEN false WHEN regexp_matches(t, '(?i)^bibtex\\s+@') OR regexp_matches(t, '\\s##\\s*$') THEN true
  ELSE s <> 'accepted' AND (c IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(c) > 18 * 3600000000) END AS due FROM r""")
def _(t):
    checked = F.when(col("event_id") % 5 != 0, col("ts").cast("timestamp"))
    return t("events").select("event_id", queue.is_recheck_due(F.expr(_ST), F.expr(_TI), lit(""), checked, lit(NOW).cast("timestamp")).alias("due"))


@query("queue_priority", f"SELECT event_id, {_ST} AS status, value AS confidence FROM events ORDER BY (status = 'accepted') DESC, value DESC, ts DESC, props, event_id LIMIT 24")
def _(t):
    rows = t("events").select("event_id", F.expr(_ST).alias("status"), col("value").alias("confidence"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updatedAt"), lit("").alias("discoveredAt"), col("props").alias("title"))
    return rows.orderBy(*queue.queue_order(), "event_id").limit(24).select("event_id", "status", "confidence")


@query("queue_display", f"SELECT event_id FROM events WHERE {_ST} <> 'officially-published' AND event_id % 3 = 0 AND NOT contains(props, '7')")
def _(t):
    waits = F.when(col("props").contains("7"), "Discovery evidence found").otherwise("")
    state = display.enrichment_status(F.when(col("event_id") % 3 == 0, "zhipu-chat").otherwise("unknown"), col("props"), waits)
    return t("events").select("event_id", F.expr(_ST).alias("s"), state.alias("e")).where("s <> 'officially-published' AND e = 'cleaned'").select("event_id")


_REC = """SELECT CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'p' || (doc_id % 400) END AS id, doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'T' || doc_id END AS title, source AS venue, CASE WHEN doc_id % 7 = 0 THEN 'nope' ELSE 'reasoning' END AS pc, CASE WHEN doc_id % 17 = 0 THEN 'bad url' ELSE 'https://example.com/' || doc_id END AS url, text AS abstract FROM documents"""


@query("validate_rules", f"""WITH r AS ({_REC}), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title NULLS FIRST) AS n FROM r), p AS (SELECT 'missing string field id' AS problem FROM n WHERE id = '' UNION ALL SELECT 'missing string field title' FROM n WHERE title IS NULL UNION ALL SELECT 'missing string field abstract' FROM n WHERE coalesce(abstract, '') = ''
  UNION ALL SELECT 'duplicate id ' || id FROM n WHERE n > 1 UNION ALL SELECT 'invalid primaryCategory nope' FROM n WHERE pc = 'nope' UNION ALL SELECT 'invalid category nope' FROM n WHERE pc = 'nope' UNION ALL SELECT 'keywords must be a non-empty array' FROM n WHERE doc_id % 19 = 0 UNION ALL SELECT 'openreviewUrl is not a valid URL' FROM n WHERE url = 'bad url') SELECT problem, count(*) AS records FROM p GROUP BY 1""")
def _(t):
    r = t("documents")
    on = lambda n, a, b: F.when(col("doc_id") % n == 0, a).otherwise(b)
    pc = on(7, lit("nope"), lit("reasoning"))
    rows = r.select(
        on(11, lit(""), F.concat(lit("p"), (col("doc_id") % 400).cast("string"))).alias("id"), on(13, lit(None), F.concat(lit("T"), "doc_id")).alias("title"), col("source").alias("venue"), pc.alias("primaryCategory"), F.array(lit("reasoning"), pc).alias("categories"),
        F.array(lit("a")).alias("authors"), on(19, F.array().cast("array<string>"), F.array(lit("k"))).alias("keywords"), on(17, lit("bad url"), F.concat(lit("https://example.com/"), "doc_id")).alias("openreviewUrl"), lit(None).cast("string").alias("pdfUrl"), col("text").alias("abstract"),
    )
    return catalog.validate(rows).groupBy("problem").agg(F.count("*").alias("records"))


_CR = _classified("concat_ws(' ', title, abstract, 'k one; k two', lang)", CATEGORY_HINTS, "mllm-foundations")
_KW = f"list_filter(list_transform(flatten(list_transform(list_concat(['k one; k two', lang], CASE WHEN len({_CR['categories']}) > 0 THEN {_CR['categories']} ELSE [{_CR['primary']}] END, [venue]), lambda x: string_split_regex(x, '[;,|]'))), lambda x: trim(x)), lambda x: x <> '')"


@query("canonical_record", f"""WITH {PAPERS}, c AS (SELECT id, title, venue, lang, {_CR['primary']} AS pc, {_KW} AS k FROM papers) SELECT venue || '-' || {slug('title')} AS id, pc AS primary_category, array_to_string(list_slice({distinct_in_order('k')}, 1, 14), ',') AS keywords, 'Unknown authors' AS authors FROM c""")
def _(t):
    p = papers(t)
    rows = p.select(lit("").alias("id"), "title", "venue", "year", col("lang").alias("track"), F.array(lit("k one; k two")).alias("keywords"), lit(None).cast("array<string>").alias("authors"), lit("https://x.org").alias("openreviewUrl"), lit("").alias("pdfUrl"), lit(None).cast("string").alias("tldr"), "abstract", col("venue").alias("source"), lit("").alias("sourceId"), lit(None).cast("string").alias("sourceType"))
    return catalog.canonical(rows).select("id", col("primaryCategory").alias("primary_category"), F.array_join("keywords", ",").alias("keywords"), F.array_join("authors", ",").alias("authors"))


def _entries(t):
    p = papers(t)
    status = F.expr("CASE id % 4 WHEN 0 THEN 'ignored' WHEN 1 THEN 'candidate' WHEN 2 THEN 'accepted' ELSE 'officially-published' END")
    none = lambda kind: lit(None).cast(kind)
    return p.select(
        F.concat(lit("e"), "id").alias("id"), "title", none("string").alias("titleZh"), col("abstract").alias("summary"), lit("").alias("abstract"), none("string").alias("reason"), none("string").alias("hookZh"),
        F.when(col("id") % 3 == 0, "provisional").otherwise("cleaned").alias("enrichmentStatus"), F.when(col("id") % 3 == 0, "unknown").otherwise("zhipu-chat").alias("metadataSource"), lit("").alias("primaryUrl"), F.concat(lit("https://example.com/"), "id").alias("canonicalUrl"), lit("").alias("pdfUrl"), none("string").alias("sourceId"),
        col("year"), status.alias("status"), (col("id") % 10 / 10).alias("confidence"), F.when(col("id") % 2 == 0, "ACL 2026").alias("acceptedVenue"), F.when(col("id") % 2 == 0, 2026).alias("acceptedYear"), lit("2026-01-01").alias("discoveredAt"), lit("2026-01-02").alias("updatedAt"), lit("").alias("lastCheckedAt"),
        none("array<string>").alias("authors"), F.array(lit("k"), lit(" k "), lit("")).alias("keywords"), none("array<string>").alias("titleAliases"), none("array<string>").alias("aliases"), F.array(lit("x")).alias("platforms"), none("array<struct<platform:string,url:string,title:string,author:string,snippet:string,readerTitle:string,readerExcerpt:string,publishDate:string,query:string>>").alias("evidence"), none("int").alias("evidenceCount"),
        none("struct<confidence:double,url:string,title:string,venue:string,snippet:string>").alias("acceptanceEvidence"), col("pos"),
    )


_UN = _classified("concat_ws(' ', nullif(title, ''), nullif(abstract, ''), 'k  k  ', CASE WHEN id % 2 = 0 THEN 'ACL 2026' END)", CATEGORY_HINTS, "mllm-foundations")


@query("unofficial_record", f"""WITH {PAPERS}, o AS (SELECT DISTINCT {norm('title')} AS k FROM papers WHERE venue IN ('src0', 'src1', 'src2', 'src3')) SELECT 'e' || id AS id, CASE WHEN id % 4 = 2 THEN 'ACL 2026' ELSE '未分类 / Unclassified' END AS venue, CASE WHEN id % 4 = 2 THEN 2026 ELSE year END AS year, CASE WHEN id % 4 = 2 THEN 'accepted' ELSE 'candidate' END AS "acceptanceStatus",
  {_UN['primary']} AS "primaryCategory", CASE WHEN id % 2 = 0 THEN 'k,ACL 2026,x,unofficial' ELSE 'k,x,unofficial' END AS keywords, 'https://example.com/' || id AS "openreviewUrl", abstract FROM papers WHERE id % 4 IN (1, 2) AND id % 3 <> 0 AND {norm('title')} NOT IN (SELECT k FROM o WHERE k <> '')""")
def _(t):
    out = catalog.unofficial_papers(_entries(t).drop("pos"), papers(t).where(OFFICIAL).select("title"))
    return out.select("id", "venue", "year", "acceptanceStatus", "primaryCategory", F.array_join("keywords", ",").alias("keywords"), "openreviewUrl", "abstract")


_WAIT = q("(?i)waiting for Zhipu enrichment|Discovery evidence found")
_ENTRY = f"""c AS (SELECT id, list_filter(list_concat([{_clean_title('title')}], {_candidates('title')}, {_candidates('abstract')}), lambda c: c <> '') AS l FROM papers), u AS (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS x FROM c),
  best AS (SELECT id, x FROM u WHERE NOT {_dirty('x')} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_quality('x')} DESC, i) = 1), n AS (SELECT p.*, trim(coalesce(p.title, '')) AS raw, coalesce(best.x, trim(coalesce(p.title, ''))) AS t FROM papers p LEFT JOIN best ON best.id = p.id),
  m AS (SELECT *, CASE WHEN t <> '' AND raw <> '' AND t <> raw AND contains(trim(abstract), raw) THEN replace(trim(abstract), raw, t) ELSE trim(abstract) END AS told FROM n),
  w AS (SELECT *, CASE WHEN trim(abstract) = '' THEN NULL WHEN {_dirty('told')} THEN CASE WHEN t <> '' THEN 'Discovery evidence found an explicit ' || CASE WHEN id % 2 = 0 THEN 'ACL 2026' ELSE 'a 2026 top venue' END || ' paper signal for ' || t || '; waiting for Zhipu enrichment.' END ELSE told END AS summary FROM m)"""


@query("entry_normalize", f"""WITH {PAPERS}, {_ENTRY} SELECT 'e' || id AS id, t AS title, CASE id % 4 WHEN 0 THEN 'ignored' WHEN 1 THEN 'candidate' WHEN 2 THEN 'accepted' ELSE 'officially-published' END AS status, CASE WHEN regexp_matches(concat_ws(' ', t, summary), {_WAIT}) OR id % 3 = 0 THEN 'provisional' ELSE 'cleaned' END AS "enrichmentStatus",
  'https://example.com/' || id AS "primaryUrl", CASE WHEN id % 2 = 0 THEN 'ACL 2026' END AS "acceptedVenue", 'k' AS keywords, summary FROM w""")
def _(t):
    out = queue.normalize_entry(_entries(t).drop("pos"), "2026-02-01")
    return out.select("id", "title", "status", "enrichmentStatus", "primaryUrl", "acceptedVenue", F.array_join("keywords", ",").alias("keywords"), "summary")


_UP = f"""r AS (SELECT CASE WHEN id % 3 = 0 THEN pos ELSE pos + 1000000000000 END AS pos, id % 3 = 0 AS stored, 'i:p' || (id // 2) AS i, 't:' || nullif({norm('title')}, '') AS t, 'u:u' || id AS p, 'u:u' || (id + 7) AS c FROM papers), k AS (SELECT pos, stored, unnest([0, 1, 2, 3]) AS prio, unnest([i, t, p, c]) AS k FROM r),
  b AS (SELECT pos, stored, prio, CASE WHEN prio = 0 THEN first_value(pos) OVER w ELSE lag(pos) OVER w END AS before FROM k WHERE k IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY pos)), a AS (SELECT pos, arg_min(before, prio) AS parent FROM b WHERE NOT stored AND before < pos GROUP BY pos),
  climb AS (SELECT pos, pos AS place FROM r WHERE NOT stored UNION ALL SELECT climb.pos, a.parent FROM climb JOIN a ON a.pos = climb.place)"""


@query("upsert_match", f"WITH RECURSIVE {PAPERS}, {_UP} SELECT pos, min(place) AS target FROM climb GROUP BY pos")
def _(t):
    rows = papers(t).select("pos", (col("id") % 3 == 0).alias("stored"), F.concat(lit("p"), (F.floor(col("id") / 2)).cast("string")).alias("id"), text.normalize_text(col("title")).alias("title_key"), F.concat(lit("u"), "id").alias("primary_url"), F.concat(lit("u"), (col("id") + 7).cast("string")).alias("canonical_url"), F.array().cast("array<string>").alias("urls"))
    rows = rows.withColumn("pos", F.when(col("stored"), col("pos")).otherwise(col("pos") + 1_000_000_000_000))
    return queue.upsert_match(rows)


_FOLD = f"""e AS (SELECT pos // 3 AS target, pos, id, title, abstract, id % 3 = 0 AS prov, regexp_matches(coalesce(title, ''), '(?i)^bibtex\\s+@|\\s##\\s*$') AS legacy, id % 10 / 10 AS conf, concat_ws(' ', CASE WHEN id % 2 = 0 THEN 'ACL 2026' END, abstract) AS v, nullif({_clean_title('title')}, '') AS clean FROM papers),
  f AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'ACL 2026' ELSE {_RULE} END AS venue FROM e), h AS (SELECT *, coalesce(lag(prov OR legacy) OVER w, false) AND (NOT prov OR NOT legacy) AS fresh, max(conf) OVER b AS sure, max(CASE WHEN venue IS NOT NULL THEN 1 END) OVER b AS had FROM f WINDOW w AS (PARTITION BY target ORDER BY pos), b AS (PARTITION BY target ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  x AS (SELECT *, coalesce(max(CASE WHEN fresh AND trim(title) <> '' THEN pos END) OVER (PARTITION BY target), -1) AS rt, coalesce(max(CASE WHEN fresh AND trim(abstract) <> '' THEN pos END) OVER (PARTITION BY target), -1) AS rs, had IS NULL OR conf > sure + 0.05 AS trust FROM h)"""


@query("entry_merge", f"""WITH {PAPERS}, {_FOLD} SELECT target, 'e' || min(id) AS id, CASE WHEN count_if(pos >= rt AND trim(title) <> '') > 1 THEN coalesce(arg_max(clean, ({_quality('clean')}, pos)) FILTER (WHERE pos >= rt AND clean IS NOT NULL), arg_max(trim(title), pos) FILTER (WHERE pos >= rt AND trim(title) <> '')) ELSE arg_max(trim(title), pos) FILTER (WHERE pos >= rt AND trim(title) <> '') END AS title,
  arg_max(trim(abstract), (length(trim(abstract)), -pos)) FILTER (WHERE pos >= rs AND trim(abstract) <> '') AS summary, ['ignored', 'candidate', 'accepted', 'officially-published'][1 + max(id % 4)] AS status, max(conf) AS confidence, coalesce(arg_max(venue, pos) FILTER (WHERE trust AND venue IS NOT NULL), arg_min(venue, pos) FILTER (WHERE venue IS NOT NULL)) AS "acceptedVenue", 'k' AS keywords FROM x GROUP BY target""")
def _(t):
    rows = _entries(t).select("id", "title", "summary", "reason", "metadataSource", "enrichmentStatus", "status", "confidence", "acceptedVenue", "acceptedYear", "keywords", "platforms", F.floor(col("pos") / 3).cast("long").alias("target"), "pos")
    out = queue.merge_entries(rows, "target", "pos")
    return out.select("target", "id", "title", "summary", "status", "confidence", "acceptedVenue", F.array_join("keywords", ",").alias("keywords"))


_HEAD = f"""b AS (SELECT *, {norm_search('title')} AS t, {norm_search("concat_ws(' ', nullif(title, ''), nullif(abstract, ''))")} AS b FROM papers), s AS (SELECT *, CASE WHEN contains(b, {q(_Q.norm)}) THEN 160 ELSE 0 END + 16 * len({contained('b', _Q.tokens)}) + CASE WHEN contains(t, {q(_Q.norm)}) THEN 40 ELSE 0 END AS score FROM b), h AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, pos LIMIT 20)"""


@query("brainstorm_plan", f"""WITH {PAPERS}, {_HEAD}, v AS (SELECT venue AS v, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4), c AS (SELECT upper(lang[1]) || lang[2:] AS v, count(*) AS n FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), k AS (SELECT trim(unnest(list_slice(string_split(title, ' '), 1, 6))) AS w FROM h),
  kk AS (SELECT w AS v, count(*) AS n FROM k WHERE w <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8), a AS (SELECT title, pos FROM h ORDER BY pos LIMIT 3) SELECT 'Background' || chr(10) || 'Idea' AS query, 'Closest literature cluster: ' || (SELECT string_agg(title, ' | ' ORDER BY pos) FROM a) AS cluster,
  'Recurring neighborhoods: ' || (SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM c) || '.' AS neighborhoods, 'Benchmark against papers from ' || (SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM v) || ' with one matched baseline and one stronger reference.' AS evaluation,
  'Add 2-3 ablations around ' || (SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT * FROM kk ORDER BY n DESC, v LIMIT 3)) || ' to show what actually matters.' AS ablations""")
def _(t):
    hits = search.text_rank(papers(t), TEXT, ["title", "abstract"], 20)  # as many papers as an idea may have
    head = hits.select("pos", "title", "venue", col("lang").alias("primaryCategory"), F.split("title", " ").alias("keywords"))
    return views.related_plan(head, " Background ", "Idea", "").drop("signals")


@query("title_from_evidence", f"""WITH {PAPERS} SELECT id, trim(CASE id % 3 WHEN 0 THEN title WHEN 1 THEN '[page] ' || title ELSE '' END) AS title, rtrim(trim(left(regexp_replace(abstract, '\\s+', ' ', 'g'), 2200))) AS excerpt FROM papers""")
def _(t):
    p = papers(t)
    body = F.expr("CASE id % 3 WHEN 0 THEN to_json(named_struct('data', named_struct('title', title, 'content', abstract))) WHEN 1 THEN to_json(named_struct('page_title', concat('[page] ', title), 'text', abstract)) ELSE to_json(named_struct('result', named_struct('summary', abstract))) END")
    r = queue.reader_payload(body)
    return p.select("id", r["title"].alias("title"), r["excerpt"].alias("excerpt"))


@query("discovery_summary", "SELECT count(*) AS queries, count(DISTINCT event_type) AS stages, count_if(event_type = 'error') AS failed, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS raw, max(event_id) AS last_event FROM events")
def _(t):
    return t("events").agg(F.count("*").alias("queries"), F.count_distinct("event_type").alias("stages"), F.count_if(col("event_type") == "error").alias("failed"), F.sum(F.floor("value")).alias("raw"), F.max("event_id").alias("last_event"))


@query("running_rank", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rank FROM events")
def _(t):
    return t("events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))


@query("evidence_backfill", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'own' || turn WHEN conv_id % 3 = 0 THEN 'have' || conv_id END AS url FROM conversations")
def _(t):
    rows = t("conversations").select("conv_id", "turn")
    item = lambda url: F.array(F.struct(lit("web").alias("platform"), url.alias("url"), *[lit(None).cast("string").alias(c) for c in ("title", "author", "snippet", "readerTitle", "readerExcerpt", "publishDate", "query")]))
    refined = rows.withColumn("evidence", F.when(col("turn") % 2 == 0, item(F.concat(lit("own"), "turn"))))
    candidates = rows.where("conv_id % 3 = 0").select("conv_id").distinct().withColumn("evidence", item(F.concat(lit("have"), "conv_id")))
    return queue.evidence_backfill(refined, candidates, "conv_id").select("conv_id", "turn", F.get("evidence", 0)["url"].alias("url"))


@query("selection_toggle", "SELECT event_id, CASE WHEN list_contains(['error', 'click'], event_type) THEN array_to_string(list_filter(['error', 'click'], lambda x: x <> event_type), ',') ELSE 'error,click,' || event_type END AS selection FROM events")
def _(t):
    return t("events").select("event_id", F.array_join(queue.toggled_values(F.array(lit("error"), lit("click")), col("event_type")), ",").alias("selection"))


@query("follow_up_seed", f"WITH {_EVID}, {_SCORED} SELECT id, url <> '' AND NOT bad AND (score >= 2 OR high) AS seed FROM sc")
def _(t):
    return _scored(t).select("id", queue.is_follow_up_seed(col("r"), col("url")).alias("seed"))


_PLACE = "CASE page_id % 8 WHEN 0 THEN 'https://github.com/lab' WHEN 1 THEN 'https://github.com/lab/' WHEN 2 THEN concat('https://GitHub.com/lab/t', page_id) WHEN 3 THEN 'https://arxiv.org/list/cs' WHEN 4 THEN 'https://arxiv.org/abs/1' WHEN 5 THEN 'https://www.Example.com/x' WHEN 6 THEN 'not a host!' ELSE url END"


@query("source_gate", f"""WITH u AS (SELECT page_id, {_PLACE} AS u FROM pages), h AS (SELECT page_id, u, lower(regexp_replace(regexp_replace(regexp_replace({squeeze('u')}, '(?i)^https?://', ''), '(?i)^www\\.', ''), '/.*$', '')) AS h FROM u)
  SELECT page_id, NOT (contains(lower(u), 'arxiv.org/list/') OR regexp_matches(u, '(?i)github\\.com/[^/\\s?#]+/?$')) AND regexp_matches(u, '(?i)github\\.com/[^/\\s?#]+/[^/\\s?#]+|github\\.io|openreview\\.net|arxiv\\.org/abs|x\\.com|twitter\\.com') AS strong, CASE WHEN h <> '' AND NOT regexp_matches(h, '[^a-z0-9.-]') THEN h END AS host,
  CASE WHEN page_id % 3 = 0 THEN 'oneWeek' ELSE 'oneMonth' END AS recency FROM h""")
def _(t):
    rows = t("pages").select("page_id", F.expr(_PLACE).alias("u"), F.when(col("page_id") % 3 == 0, " oneWeek ").otherwise("ever").alias("r"))
    return rows.select("page_id", venues.is_strong_source(col("u")).alias("strong"), venues.domain_filter(col("u")).alias("host"), venues.one_of(col("r"), ["oneDay", "oneWeek", "oneMonth"], "oneMonth").alias("recency"))


@query("legacy_entry", "SELECT event_id, event_id % 29 = 0 OR event_id % 31 = 0 OR event_id % 37 = 0 AS legacy FROM events")
def _(t):
    why = F.when(col("event_id") % 37 == 0, "Local high-confidence extraction of it").otherwise("why")
    return t("events").select("event_id", queue.is_legacy(F.expr(_TI), why).alias("legacy"))


@query("manifest_header", f"WITH m AS ({_manifest_sql('true')}) SELECT 'chunked-v1' AS format, 'm' AS model, CAST(sum(count) AS BIGINT) AS count, max(dimensions) AS dimensions, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, 20 AS \"chunkRows\" FROM m")
def _(t):
    return store.manifest_header(_manifest(t), "m", None, 20).select("format", "model", "count", "dimensions", "chunks", "bytes", "chunkRows")


@query("manifest_ids", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, conv_id || ':' || turn AS id, sha1(text) AS fingerprint FROM conversations")
def _(t):
    rows = vectors.numbered(t("conversations").withColumn("o", F.struct("conv_id", "turn")), "o").select(col("_i").alias("pos"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.sha1("text").alias("fp"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "id", "fp")))
    chunks = rows.groupBy(F.floor(col("pos") / 50).alias("c")).agg(F.min("pos").alias("offset"), listed.alias("m"))  # 50 rows a chunk
    return store.manifest_ids(chunks.select("offset", col("m.id").alias("ids"), col("m.fp").alias("fingerprints")))


@query("embedding_pool", "WITH w AS (SELECT p_partkey AS id, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS w FROM part), a AS (SELECT id, list_avg(list_transform(w, lambda x: length(x))) AS m FROM w) SELECT id, round(m / sqrt(m * m + 1), 5) AS x, round(1 / sqrt(m * m + 1), 5) AS y FROM a")
def _(t):
    def encode(texts: list[str]) -> list[np.ndarray]:  # a stand-in for a model: a token's vector is its length and 1
        return [np.array([[len(w), 1.0] for w in text.split()]).reshape(-1, 2) for text in texts]

    out = outside.embed(t("part").select(col("p_partkey").alias("id"), "p_name"), encode, "p_name")
    return out.select("id", *[F.round(F.get("embedding", i).cast("double"), 5).alias(n) for i, n in enumerate("xy")])


@query("paged_scan", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    rows = t("customer").select("c_custkey", "c_name", "c_nationkey")
    spark = rows.sparkSession
    spark.dataSource.register(paged.paged_source("paged_customers", paged.stored_pages(rows, "c_custkey", 100)))
    pages = -(-rows.count() // 100) + 1
    notes = spark.read.format("paged_customers").options(url="https://api.example.org/customers?v=1", limit=100, max_pages=pages, lanes=4).load()
    note = F.from_json("value", "c_custkey long, c_name string, c_nationkey long")
    return notes.select("pos", note.alias("n")).join(t("nation"), col("n.c_nationkey") == col("n_nationkey")).select("pos", "n.c_custkey", "n.c_name", "n_name")


@query("search_answers", f"WITH {PAPERS} SELECT 'https://a.org/' || id AS url, title, CASE id % 3 WHEN 0 THEN 'S' ELSE '' END AS snippet, 'seed' AS stage FROM papers WHERE title <> ''")
def _(t):
    body = F.expr("CASE id % 3 WHEN 0 THEN to_json(named_struct('search_result', array(named_struct('link', concat('https://a.org/', id), 'title', title, 'content', 'S'), named_struct('link', '', 'title', 'x', 'content', '')))) WHEN 1 THEN to_json(named_struct('data', named_struct('search_result', array(named_struct('url', concat('https://a.org/', id), 'name', title))))) ELSE to_json(named_struct('results', array(named_struct('url', concat('https://a.org/', id), 'title', title)))) END")
    return paged.search_items(papers(t).select(body.alias("value")), "web", {"stage": "seed", "query": "q", "label": "seed-1"}).select("url", "title", "snippet", "stage")


@query("upsert_queue")
def _(t):
    rows = _entries(t)
    stored, found = rows.where("pos % 3 = 0"), rows.where("pos % 3 <> 0").withColumn("id", lit(None).cast("string"))
    return queue.upsert_queue(stored, found, "2026-02-01").select("id", "title", "status", "confidence", "acceptedVenue", "enrichmentStatus", "evidenceCount")
