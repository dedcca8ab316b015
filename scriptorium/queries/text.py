"""Queries of text, page and title functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, guides, html, text, titles, unicode, venues
from ..operators import catalog, queue
from ..values import DIRTY_TITLE, ENTITIES, EVIDENCE_CONTEXT, EVIDENCE_VENUES, GUIDE_FAMILIES, GUIDE_RESULTS, GUIDE_TOPICS, LIMITATION_WORDS, OTHER_TRACKS, TITLE_BAD_START, VENUES, WAITING
from .base import PAPERS, contained, distinct_in_order, items, norm, norm_search, papers, q, query, re2, slug, squeeze, sub, tokens

col, lit = F.col, F.lit
NOW = "2024-01-31 00:00:00"


@query("scan_project", "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size >= 20")
def _(t):
    return t("part").where("p_size >= 20").select("p_partkey", "p_name", "p_brand", "p_size")


@query("index_projection", f"WITH {PAPERS} SELECT p.id, p.title, p.venue, trim(p.abstract) <> '' AS has_abstract, l.doc_id IS NOT NULL AS has_guide FROM papers p LEFT JOIN labels l ON p.id = l.doc_id")
def _(t):
    guides_ = t("labels").select(col("doc_id").alias("id"), lit(True).alias("g"))
    return papers(t).join(guides_, "id", "left").select("id", "title", "venue", (F.trim("abstract") != "").alias("has_abstract"), col("g").isNotNull().alias("has_guide"))


_SEMANTIC = squeeze("concat_ws(' ', nullif(title, ''), nullif(venue, ''), nullif(lang, ''), nullif(abstract, ''))")


@query("semantic_text", f"WITH {PAPERS} SELECT id, length({_SEMANTIC}) AS size, sha1({_SEMANTIC}) AS fingerprint FROM papers")
def _(t):
    body = text.semantic_text(col("title"), col("venue"), col("lang"), col("abstract"))
    return papers(t).select("id", body.alias("s")).select("id", F.length("s").cast("long").alias("size"), text.fingerprint(col("s")).alias("fingerprint"))


@query("bibtex", """SELECT p_partkey, '@inproceedings{' || lower(list_last(string_split('Ann ' || p_brand, ' '))) || '2024' || left(p_type, 8) || ',' || chr(10) || '  title={' || p_name || '},' || chr(10) || '  author={Ann ' || p_brand || ' and Bo Li},' || chr(10)
  || '  booktitle={' || p_type || '},' || chr(10) || '  year={2024},' || chr(10) || '  url={https://example.com/' || p_partkey || '}' || chr(10) || '}' AS bibtex FROM part""")
def _(t):
    authors = F.array(F.concat(lit("Ann "), "p_brand"), lit("Bo Li"))
    return t("part").select("p_partkey", display.bibtex(authors, col("p_type"), col("p_name"), col("p_type"), lit(2024), F.concat(lit("https://example.com/"), "p_partkey")).alias("bibtex"))


@query("affinity_label", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'L' || CAST(floor(value + 0.5) AS BIGINT) WHEN 1 THEN printf('%.4f', value) WHEN 2 THEN 'H' || printf('%.4f', value) ELSE '1.0000' END AS label,
  printf('%.4f', least(value / 100, 0.9999)) AS lexical FROM events""")
def _(t):
    at = lambda n: F.when(F.pmod("event_id", lit(4)) == n, col("value"))
    return t("events").select("event_id", display.affinity_label(at(0), at(1), at(2)).alias("label"), display.lexical_affinity(col("value")).alias("lexical"))


@query("clamp", "SELECT p_partkey, CAST(least(greatest(CASE WHEN p_size = 25 THEN 10 ELSE p_size - 25 END, 1), 20) AS INTEGER) AS per_page FROM part")
def _(t):
    return t("part").select("p_partkey", text.clamp((col("p_size") - 25).cast("string"), 1, 20, 10).alias("per_page"))


@query("relative_time", f"""WITH m AS (SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 60000000.0 + 0.5) AS BIGINT) AS m FROM events),
  h AS (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM m), d AS (SELECT *, CAST(floor(h / 24.0 + 0.5) AS BIGINT) AS d FROM h)
  SELECT event_id, CASE WHEN abs(m) < 1 THEN 'Just now' WHEN abs(m) < 60 THEN abs(m) || ' min' || CASE WHEN m >= 0 THEN ' ago' ELSE ' later' END
  WHEN abs(h) < 48 THEN abs(h) || ' hr' || CASE WHEN h >= 0 THEN ' ago' ELSE ' later' END ELSE abs(d) || CASE WHEN abs(d) = 1 THEN ' day' ELSE ' days' END || CASE WHEN d >= 0 THEN ' ago' ELSE ' later' END END AS label FROM d""")
def _(t):
    return t("events").select("event_id", display.relative_time(col("ts").cast("timestamp"), lit(NOW).cast("timestamp")).alias("label"))


@query("normalize_text", f"WITH {PAPERS} SELECT id, {norm('title')} AS norm FROM papers")
def _(t):
    return papers(t).select("id", text.normalize_text(col("title")).alias("norm"))


@query("normalize_text_search", f"WITH {PAPERS} SELECT id, {norm_search('title')} AS norm FROM papers")
def _(t):
    return papers(t).select("id", text.normalize_search(col("title")).alias("norm"))


@query("nfkc", f"WITH {PAPERS} SELECT id, nfc_normalize(title) AS title FROM papers")
def _(t):
    return papers(t).select("id", unicode.nfkc("title").alias("title"))


@query("title_key", f"WITH {PAPERS} SELECT {norm('title')} AS title_key, min(pos) AS first_pos, count(*) AS papers FROM papers GROUP BY 1")
def _(t):
    return papers(t).groupBy(text.normalize_text(col("title")).alias("title_key")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("papers"))


@query("slugify", f"WITH {PAPERS} SELECT id, {slug('title')} AS slug FROM papers")
def _(t):
    return papers(t).select("id", text.slugify(col("title")).alias("slug"))


@query("token_count", f"SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(text.tokenize(col("text"))).cast("long").alias("tokens"))


_KEYWORDS = "CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', ' ; ') WHEN 1 THEN p_name ELSE '' END"
_SPLIT = f"list_filter(list_transform(string_split_regex(trim({_KEYWORDS}), '[;,|]'), lambda x: trim(x)), lambda x: x <> '')"


@query("keyword_split", f"SELECT p_partkey, CASE WHEN trim({_KEYWORDS}) = '' THEN '' WHEN len({_SPLIT}) > 1 THEN array_to_string({_SPLIT}, '|') ELSE trim({_KEYWORDS}) END AS keywords FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(text.split_keywords(F.expr(_KEYWORDS)), "|").alias("keywords"))


_ALL = "list_filter(list_transform(flatten(list_transform([p_name, p_type || ';' || p_brand, p_type, ''], lambda x: string_split_regex(x, '[;,|]'))), lambda x: trim(x)), lambda x: x <> '')"


@query("keyword_normalize", f"SELECT p_partkey, array_to_string({distinct_in_order(_ALL)}, '|') AS keywords FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(text.normalize_keywords(F.array("p_name", F.concat_ws(";", "p_type", "p_brand"), "p_type", lit(""))), "|").alias("keywords"))


@query("author_parse", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|Bo Li' WHEN 1 THEN p_brand || '|Bo|C' WHEN 2 THEN 'Unknown authors' ELSE p_name END AS authors FROM part""")
def _(t):
    bib = F.expr("CASE WHEN p_partkey % 4 = 0 THEN concat('@a{x, Author = {', p_brand, ' AND Bo Li}, year=1}') END")
    names = F.expr("CASE p_partkey % 4 WHEN 1 THEN concat(p_brand, '; Bo ,C') WHEN 2 THEN ' ' ELSE p_name END")
    return t("part").select("p_partkey", F.array_join(text.parse_authors(bib, names), "|").alias("authors"))


_A, _B = "string_split(lower(p_name), ' ')", "string_split(lower(p_type || ' ' || p_name || ' ' || p_brand), ' ')"


@query("array_ops", f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({_A}, {_B}))), '|') AS both, array_to_string(list_sort(list_intersect({_A}, {_B})), '|') AS common,
  array_to_string(list_sort(list_distinct(list_filter({_B}, lambda x: NOT list_contains({_A}, x)))), '|') AS other FROM part""")
def _(t):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")), " ")
    show = lambda x: F.array_join(F.array_sort(x), "|")
    return t("part").select("p_partkey", show(F.array_union(a, b)).alias("both"), show(F.array_intersect(a, b)).alias("common"), show(F.array_except(b, a)).alias("other"))


@query("json_extract", "SELECT event_id, coalesce(json_extract_string(props, '$.k.value'), json_extract_string(props, '$.k')) AS k FROM events")
def _(t):
    return t("events").select("event_id", text.content_value(col("props"), "k").alias("k"))


_MESSAGE = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Sure: ```json', chr(10), props, chr(10), '``` done') WHEN 2 THEN concat('answer ', props) ELSE 'none' END"


@query("json_block", f"""WITH m AS (SELECT event_id, trim({_MESSAGE}) AS x FROM events) SELECT event_id, coalesce(CASE WHEN json_valid(x) THEN x END, nullif(regexp_extract(x, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1), ''),
  nullif(regexp_extract(x, '(?s)\\{{.*\\}}$', 0), '')) AS json FROM m""")
def _(t):
    return t("events").select("event_id", text.json_block(F.expr(_MESSAGE)).alias("json"))


@query("fingerprint", "SELECT doc_id, sha1(text) AS fingerprint FROM documents")
def _(t):
    return t("documents").select("doc_id", text.fingerprint(col("text")).alias("fingerprint"))


@query("stable_id", f"WITH {PAPERS} SELECT id, 'unofficial-' || left(sha1(coalesce(nullif({norm('title')}, ''), 'paper')), 12) AS stable_id FROM papers")
def _(t):
    return papers(t).select("id", text.stable_id(col("title")).alias("stable_id"))


def _decode(x: str) -> str:
    for name, to in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(to)})"
    return x


_CLEAN = squeeze(_decode(sub("html", "<[^>]*>", " ")))


@query("html_clean", f"SELECT page_id, CAST(length({_CLEAN}) AS BIGINT) AS size, sha1({_CLEAN}) AS digest FROM pages")
def _(t):
    return t("pages").select("page_id", html.clean_html(col("html")).alias("c")).select("page_id", F.length("c").cast("long").alias("size"), F.sha1("c").alias("digest"))


_STRIP = squeeze(f"regexp_replace({sub(sub('html', '(?i)<br' + chr(92) + 's*/?>', ' '), '<[^>]*>', ' ')}, {q(chr(92) + '[([^' + chr(92) + ']]{2,220})' + chr(92) + ']' + chr(92) + '([^)]+' + chr(92) + ')')}, '\\1', 'g')")


@query("html_text", f"SELECT page_id, CAST(length({_STRIP}) AS BIGINT) AS size, sha1({_STRIP}) AS digest FROM pages")
def _(t):
    return t("pages").select("page_id", html.strip_markup(col("html")).alias("c")).select("page_id", F.length("c").cast("long").alias("size"), F.sha1("c").alias("digest"))


def _element(tag: str) -> str:
    return squeeze(_decode(sub(f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)", "<[^>]*>", " ")))


@query("html_title", f"SELECT page_id, coalesce(nullif({_element('h1')}, ''), nullif({_element('title')}, '')) AS title, {_element('title')} AS page_title FROM pages")
def _(t):
    return t("pages").select("page_id", html.page_title(col("html")).alias("title"), html.element(col("html"), "title").alias("page_title"))


@query("html_links", f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]+"[^>]*>[^<]*</a></li>', 0) AS l FROM pages), u AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM l)
  SELECT page_id, i, {_decode("regexp_extract(x, 'href=\"([^\"]+)\"', 1)")} AS href, {squeeze(_decode("regexp_extract(x, '(?s)>([^<]*)</a>', 1)"))} AS title FROM u""")
def _(t):
    return t("pages").select("page_id", F.posexplode(html.links(col("html"))).alias("i", "x")).select("page_id", col("i").cast("long").alias("i"), "x.href", "x.title")


@query("html_meta", f"""SELECT page_id, {_decode("regexp_extract(regexp_extract(replace(html, '<meta charset=', '<meta name=\"charset\" content='), '(?i)<meta\\b[^>]*\\bname=\"charset\"[^>]*>', 0), '(?i)\\bcontent=\"([^\"]*)\"', 1)")} AS charset FROM pages""")
def _(t):
    named = F.replace(col("html"), lit("<meta charset="), lit('<meta name="charset" content='))
    return t("pages").select("page_id", html.meta_content(named, "charset").alias("charset"))


_HREFS = "list_filter(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda x: x <> '')"


@query("html_distinct", f"SELECT page_id, array_to_string(list_slice({distinct_in_order(_HREFS)}, 1, 40), ' ') AS hrefs FROM pages")
def _(t):
    return t("pages").select("page_id", F.array_join(html.distinct_values(col("html"), 'href="([^"]+)"'), " ").alias("hrefs"))


_URL = "CASE page_id % 6 WHEN 0 THEN concat('https://github.com/lab/tool-', page_id, '.git') WHEN 1 THEN concat('https://x.com/u/', page_id) WHEN 2 THEN concat('https://arxiv.org/list/', page_id) WHEN 3 THEN concat('http://openreview.net/forum?id=', page_id) WHEN 4 THEN concat('https://github.com/me/me.github.io') ELSE url END"
_REPO = r"(?i)^https?://github\.com/([^/\s?#]+)/([^/\s?#]+)"


@query("url_parse", f"""WITH u AS (SELECT page_id, {_URL} AS u FROM pages), r AS (SELECT *, regexp_extract(u, {q(_REPO)}, 1) AS o, regexp_replace(regexp_extract(u, {q(_REPO)}, 2), '(?i)\\.git$', '') AS n FROM u)
  SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE '' END AS valid, nullif(o, '') AS owner, nullif(n, '') AS name, n <> '' AND lower(n) = lower(o) || '.github.io' AS personal,
  regexp_replace(regexp_replace(lower(u), '^https?://(www\\.)?', ''), '/.*$', '') AS domain, regexp_matches(u, '(?i)arxiv\\.org|github\\.com|github\\.io|openreview\\.net|x\\.com|twitter\\.com|\\.edu') AS high_signal FROM r""")
def _(t):
    u = F.expr(_URL)
    rows = t("pages").select("page_id", u.alias("u"))
    repo = venues.repository(col("u"))
    return rows.select("page_id", venues.valid_url(col("u")).alias("valid"), repo["owner"].alias("owner"), repo["name"].alias("name"), venues.is_personal_homepage(col("u")).alias("personal"), venues.domain_filter(col("u")).alias("domain"), venues.is_high_signal(col("u")).alias("high_signal"))


@query("platform_detect", f"""WITH u AS (SELECT page_id, {_URL} AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '(?i)x\\.com|twitter\\.com') THEN 'x' WHEN regexp_matches(u, '(?i)xiaohongshu\\.com') THEN 'xiaohongshu'
  WHEN regexp_matches(u, '(?i)arxiv\\.org') THEN 'arxiv' ELSE 'web' END AS platform, CASE WHEN regexp_matches(u, '(?i)x\\.com|twitter\\.com') THEN 'x' WHEN regexp_matches(u, '(?i)openreview\\.net|aaai\\.org|thecvf\\.com') THEN 'official' ELSE 'web' END AS site FROM u""")
def _(t):
    rows = t("pages").select("page_id", F.expr(_URL).alias("u"))
    return rows.select("page_id", venues.platform_of(col("u")).alias("platform"), venues.platform_of(col("u"), official=True).alias("site"))


_EV = "CASE id % 7 WHEN 0 THEN concat('GitHub - lab/repo: ', left(title, 100), ' Abstract of it') WHEN 1 THEN concat('[ACL 2026] ', left(title, 100), ' (ACL 2026 Main)') WHEN 2 THEN concat('Official code for our paper: ', left(title, 100)) WHEN 3 THEN concat(left(title, 100), ' ## Readme') WHEN 4 THEN concat('\"', left(title, 100), '\"') WHEN 5 THEN concat('paper: ', left(title, 100), ' with') ELSE concat('see Alpha-Net: ', left(title, 60), ' accepted to KDD 2026, poster') END"


def _noise(x: str) -> str:
    x = sub(f"coalesce({x}, '')", r"!\[[^\]]*\]\([^)]*\)", " ")
    x = f"regexp_replace({x}, {q(r'[[]([^]]+)[]][(][^)]*[)]')}, '\\1', 'g')"
    x = sub(sub(sub(x, "<[^>]+>", " "), "(?i)&nbsp;", " "), "(?i)&amp;", "&")
    return squeeze(sub(sub(x, "^[\"'`]+|[\"'`]+$"), r"^[#>\s]+"))


def _clean_title(x: str) -> str:
    """Nested rewrites; the checks refer to the value by a subquery-free lambda over a one-element list."""
    out = _noise(x)
    for pattern, to in titles.REWRITES:
        out = sub(out, pattern, to)
    bad = f"length(y) NOT BETWEEN 8 AND 220 OR NOT regexp_matches(y, '[a-zA-Z]') OR regexp_matches(y, {re2(TITLE_BAD_START)}) OR regexp_matches(y, {q('(?i)' + chr(92) + 'b(?:for|via|with|and|of|the|from|to)$')})"
    return f"list_transform([{squeeze(out)}], lambda y: CASE WHEN {bad} THEN '' ELSE y END)[1]"


def _dirty(x: str) -> str:
    return f"(trim({x}) = '' OR length(trim({x})) > 260 OR " + " OR ".join(f"regexp_matches(trim({x}), {re2(p)})" for p in DIRTY_TITLE) + ")"


def _quality(x: str) -> str:
    marks = "[`\"“”‘’']"
    return f"""(least(length(trim({x})), 180) - CASE WHEN {_dirty(x)} OR regexp_matches({x}, '(?i)github|official repo|official code') THEN 60 ELSE 0 END - CASE WHEN regexp_matches(trim({x}), {q(f'^{marks}|{marks}$')}) THEN 20 ELSE 0 END
      - CASE WHEN regexp_matches(trim({x}), '(?i)for$|via$|with$|and$|of$|the$') THEN 80 ELSE 0 END + CASE WHEN regexp_matches(trim({x}), '[.:?]$') THEN 6 ELSE 0 END)"""


def _candidates(x: str) -> str:
    found = ", ".join(f"regexp_extract_all(z, {re2(p)}, 1)" for p in titles.TITLE_PATTERNS)
    return f"flatten(list_transform([{_noise(x)}], lambda z: list_filter(list_transform(flatten([{found}]), lambda c: {_clean_title('c')}), lambda c: c <> '')))"


_E = f"{PAPERS}, e AS (SELECT id, {_EV} AS v FROM papers)"


def _evidence(t):
    return papers(t).select("id", F.expr(_EV).alias("v"))


@query("title_clean", f"WITH {_E} SELECT id, {_clean_title('v')} AS title FROM e")
def _(t):
    return _evidence(t).select("id", titles.clean_title(col("v")).alias("title"))


@query("title_dirty", f"WITH {_E} SELECT id, {_dirty('v')} AS dirty FROM e")
def _(t):
    return _evidence(t).select("id", titles.is_dirty_title(col("v")).alias("dirty"))


@query("title_quality", f"WITH {_E} SELECT id, CAST({_quality('v')} AS BIGINT) AS quality FROM e")
def _(t):
    return _evidence(t).select("id", titles.title_quality(col("v")).cast("long").alias("quality"))


@query("title_candidates", f"WITH {_E} SELECT id, array_to_string(list_sort(list_distinct({_candidates('v')})), '|') AS titles FROM e")
def _(t):
    return _evidence(t).select("id", F.array_join(F.array_sort(titles.title_candidates(col("v"))), "|").alias("titles"))


@query("best_title", f"""WITH {_E}, c AS (SELECT id, list_filter(list_concat([{_clean_title('v')}], {_candidates('v')}), lambda c: c <> '') AS l FROM e), u AS (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS x FROM c),
  r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {_quality('x')} DESC, i) AS n FROM u WHERE NOT {_dirty('x')}) SELECT e.id, r.x AS title FROM e LEFT JOIN r ON e.id = r.id AND r.n = 1""")
def _(t):
    return _evidence(t).select("id", titles.best_title(F.array("v"), F.array("v")).alias("title"))


_VENUE = "CASE id % 8 WHEN 0 THEN 'accepted to ACL 2026' WHEN 1 THEN 'ACL 2026 findings' WHEN 2 THEN 'paper at aaai-26' WHEN 3 THEN 'NeurIPS 2026 poster' WHEN 4 THEN title WHEN 5 THEN 'to appear at KDD 26, main track' WHEN 6 THEN 'CVPR26 workshop' ELSE 'official code, SIGIR 2026' END"
_V = f"{PAPERS}, v AS (SELECT id, {_VENUE} AS v FROM papers)"
_RULE = "CASE WHEN " + f"{norm('v')} = '' OR regexp_matches({norm('v')}, {q(rf'{chr(92)}b(?:{OTHER_TRACKS}){chr(92)}b')}) THEN NULL " + " ".join(f"WHEN regexp_matches({norm('v')}, {q(rf'{chr(92)}b{w}(?:-?26|{chr(92)}s+2026)?{chr(92)}b')}) THEN {q(v)}" for w, v in VENUES) + " END"


@query("venue_rule", f"WITH {_V} SELECT id, {_RULE} AS venue, CASE WHEN {_RULE} IS NOT NULL THEN 2026 END AS year FROM v")
def _(t):
    rows = papers(t).select("id", F.expr(_VENUE).alias("v")).select("id", venues.venue_rule(col("v")).alias("r"))
    return rows.select("id", "r.venue", "r.year")


_EVV = rf"\b({EVIDENCE_VENUES})[-\s']*(2026|26)\b"


@query("venue_extract", f"""WITH {_V} SELECT id, CASE WHEN regexp_matches(lower(v), {q(_EVV)}) AND regexp_matches(v, {q(f'(?i)({EVIDENCE_CONTEXT})')}) THEN upper(regexp_extract(lower(v), {q(_EVV)}, 1)) || CASE WHEN regexp_matches(v, '(?i)\\bmain(?:\\s+conference|\\s+track)?\\b') THEN ' 2026 Main' ELSE ' 2026' END END AS venue,
  CASE WHEN regexp_matches(v, {q(rf'(?i)({EVIDENCE_VENUES})[-{chr(92)}s]?(2026|26){chr(92)}b')}) AND id % 8 <> 4 THEN upper(regexp_extract(v, {q(rf'(?i){chr(92)}b({EVIDENCE_VENUES})[-{chr(92)}s]?(2026|26){chr(92)}b')}, 1)) || ' 2026' ELSE '' END AS venue_year FROM v""")
def _(t):
    rows = papers(t).select("id", F.expr(_VENUE).alias("v"))
    return rows.select("id", venues.venue_in_evidence(col("v")).alias("venue"), venues.venue_year(col("v")).alias("venue_year"))


@query("longest_text", f"WITH {PAPERS} SELECT id, CASE WHEN nullif(trim(title), '') IS NULL THEN venue || ' in ' || lang WHEN length(venue || ' in ' || lang) > length(trim(title)) THEN venue || ' in ' || lang ELSE trim(title) END AS text FROM papers")
def _(t):
    return papers(t).select("id", text.longer_text(col("title"), F.concat_ws(" in ", "venue", "lang")).alias("text"))


_S = f"list_filter(string_split(regexp_replace({squeeze('abstract')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 30)"


@query("sentence_find", f"WITH {PAPERS} SELECT id, list_filter({_S}, lambda s: contains(lower(s), 'wh') OR contains(lower(s), 'ung'))[1] AS sentence, CAST(len({_S}) AS BIGINT) AS sentences FROM papers")
def _(t):
    return papers(t).select("id", text.find_sentence(col("abstract"), ["wh", "ung"]).alias("sentence"), F.size(text.sentences(col("abstract"))).cast("long").alias("sentences"))


def _first(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(n)}) THEN {q(v)}" for n, v in rules) + f" ELSE {default} END"


_LOW = "lower(abstract)"


@query("guide_rules", f"""WITH {PAPERS} SELECT id, {_first(_LOW, GUIDE_TOPICS, q(guides.DEFAULT_TOPIC))} AS topic, {_first(_LOW, [(w, n) for n, ws in GUIDE_FAMILIES for w in ws], q('paper'))} AS family, {_first(_LOW, [(w, n) for n, ws in GUIDE_RESULTS for w in ws], 'NULL')} AS result,
  CASE WHEN trim(string_split(title, ':')[1]) <> '' AND length(trim(string_split(title, ':')[1])) <= 80 THEN trim(string_split(title, ':')[1]) ELSE nullif(regexp_extract(title, '\\b[A-Z][A-Z0-9-]{{2,}}\\b', 0), '') END AS method,
  list_filter({_S}, lambda s: len({contained('lower(s)', LIMITATION_WORDS)}) > 0)[1] AS limitation FROM papers""")
def _(t):
    return papers(t).select("id", guides.topic(col("abstract")).alias("topic"), guides.family(col("abstract")).alias("family"), guides.result_signal(col("abstract")).alias("result"), guides.method_name(col("title")).alias("method"), guides.limitation(col("abstract")).alias("limitation"))


@query("evidence_compact", f"WITH {PAPERS} SELECT id, CASE WHEN length({squeeze('abstract')}) > 500 THEN rtrim(left({squeeze('abstract')}, 497)) || '...' ELSE {squeeze('abstract')} END AS text FROM papers")
def _(t):
    return papers(t).select("id", queue.compact_evidence(col("abstract"), 500).alias("text"))


@query("enrichment_status", f"""WITH {PAPERS} SELECT id, CASE WHEN regexp_matches(concat_ws(' ', title, CASE WHEN id % 5 = 0 THEN 'Waiting for Zhipu enrichment.' END), {q(f'(?i){WAITING}')}) THEN 'provisional' WHEN id % 2 = 0 THEN 'cleaned' ELSE 'provisional' END AS status FROM papers""")
def _(t):
    source, extra = F.when(col("id") % 2 == 0, "zhipu-chat").otherwise("local-fallback"), F.when(col("id") % 5 == 0, "Waiting for Zhipu enrichment.")
    return papers(t).select("id", display.enrichment_status(source, col("title"), extra).alias("status"))


_STATUS = "CASE event_id % 4 WHEN 0 THEN 'ignored' WHEN 1 THEN 'candidate' WHEN 2 THEN 'accepted' ELSE 'officially-published' END"


@query("status_label", f"""WITH s AS (SELECT event_id, {_STATUS} AS s FROM events) SELECT event_id, CASE s WHEN 'officially-published' THEN 'Officially published' WHEN 'accepted' THEN 'Accepted signal' ELSE 'Candidate signal' END AS label,
  CASE s WHEN 'officially-published' THEN 'muted' WHEN 'accepted' THEN 'good' ELSE 'active' END AS tone FROM s""")
def _(t):
    s = F.expr(_STATUS)
    return t("events").select("event_id", display.status_label(s).alias("label"), display.status_tone(s).alias("tone"))


@query("relevant_title", f"""WITH {PAPERS} SELECT id, len({contained(norm('title'), ['tion', 'sch', 'ment'])}) > 0 OR len({contained(norm('title'), ['the of', 'que la'])}) > 0 AS relevant FROM papers""")
def _(t):
    return papers(t).select("id", catalog.is_relevant_title(col("title"), ["tion", "sch", "ment"], ["the of", "que la"]).alias("relevant"))




def _rewritten(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = sub(x, pattern, to)
    return squeeze(x)


_SHOWN = f"""list_transform([{_rewritten('coalesce(' + ', '.join(f"nullif(trim(regexp_extract(trim(v), {re2(p)}, 1)), '')" for p in titles.VIEW_PATTERNS) + ', trim(v))', titles.VIEW_REWRITES)}], lambda y: CASE WHEN length(y) NOT BETWEEN 4 AND 220 OR regexp_matches(y, '(?i)^(?:GitHub|This is|Discovery evidence found|从项目页|该项目明确|没有提供)')
  OR regexp_matches(y, '(?i)waiting for Zhipu enrichment|repository files navigation|go to file|table of contents') OR NOT regexp_matches(y, '[A-Za-z]|[\\x{{4e00}}-\\x{{9fff}}]') OR (length(y) < 12 AND NOT regexp_matches(y, '^[A-Z][A-Za-z0-9+_.-]{{2,40}}$')) THEN '' ELSE y END)[1]"""


@query("view_title", f"WITH {_E} SELECT id, {_SHOWN} AS title FROM e")
def _(t):
    return _evidence(t).select("id", titles.view_title(col("v")).alias("title"))


@query("narrative_clean", f"""WITH {PAPERS}, n AS (SELECT id, 'About ' || title || ' now' AS s, title AS raw, CASE WHEN id % 2 = 0 THEN 'Clean ' || id ELSE title END AS clean, CASE WHEN id % 3 = 0 THEN '' ELSE 'ACL 2026' END AS venue FROM papers),
  c AS (SELECT *, CASE WHEN clean <> raw AND raw <> '' AND clean <> '' THEN replace(trim(s), raw, clean) ELSE trim(s) END AS x FROM n) SELECT id, CASE WHEN {_dirty('x')} THEN 'Discovery evidence found an explicit ' || coalesce(nullif(venue, ''), 'a 2026 top venue') || ' paper signal for ' || clean || '; waiting for Zhipu enrichment.' ELSE x END AS text FROM c WHERE clean <> ''""")
def _(t):
    rows = papers(t).select("id", col("title").alias("raw"), F.when(col("id") % 2 == 0, F.concat(lit("Clean "), "id")).otherwise(col("title")).alias("clean"), F.when(col("id") % 3 == 0, "").otherwise("ACL 2026").alias("venue"))
    return rows.where("clean <> ''").select("id", titles.clean_narrative(F.concat(lit("About "), "raw", lit(" now")), col("raw"), col("clean"), col("venue")).alias("text"))


@query("generated_guides", f"""WITH {PAPERS} SELECT id, CASE WHEN id % 2 = 0 THEN 'reasoning' ELSE 'audio-speech' END AS "primaryCategory", CASE WHEN id % 2 = 0 THEN 'reasoning,rag-knowledge' ELSE 'audio-speech,rag-knowledge' END AS categories, 'g,' || lang AS keywords, 'h' || id AS hook FROM papers WHERE id IN (SELECT doc_id FROM labels)""")
def _(t):
    p = papers(t)
    made = p.join(t("labels").select(col("doc_id").alias("id")), "id").select("id", F.when(col("id") % 2 == 0, "reasoning").otherwise("no such").alias("primaryCategory"), F.array(lit("rag-knowledge"), lit("none")).alias("categories"), F.array(lit(" g ")).alias("keywords"), F.concat(lit("h"), "id").alias("hook"))
    rows = p.select("id", lit("audio-speech").alias("primaryCategory"), F.array(lit("audio-speech")).alias("categories"), F.array("lang", lit("g")).alias("keywords"))
    out = catalog.with_generated(rows, made)
    return out.select("id", "primaryCategory", F.array_join("categories", ",").alias("categories"), F.array_join("keywords", ",").alias("keywords"), "hook")


@query("notes_normalize", f"""WITH {PAPERS} SELECT coalesce(nullif({slug('title', '')}, ''), 'f' || id) AS id, title, 2000 + (id % 30) AS year, 'Ann ' || lang || '|Bo' AS authors, 'https://openreview.net/forum?id=f' || id AS "openreviewUrl" FROM papers""")
def _(t):
    body = F.expr("to_json(named_struct('title', named_struct('value', title), 'venue', concat('VENUE ', 2000 + id % 30, ' poster'), 'authors', named_struct('value', array(concat('Ann ', lang), 'Bo'))))")
    out = catalog.from_notes(papers(t).select(F.concat(lit("f"), "id").alias("forum"), body.alias("content")))
    return out.select("id", "title", "year", F.array_join("authors", "|").alias("authors"), "openreviewUrl")


_REPAIRED = ", ".join(f"nullif({_clean_title(f'regexp_extract(s, {re2(p)}, 1)')}, '')" for p in (r"(?i)title=\{([^}]{8,220})\}", r"(?i)accepted paper\s*:\s*([^\n]{8,220})", r'(?i)implementation of\s+"([^"\n]{8,220})"', r"(?i)implementation of\s+([A-Z][^.\n]{8,220})", r"([A-Z][A-Za-z0-9+_.-]{1,48}:\s*[^#\n]{8,220})"))


@query("repair_title", f"WITH {_E}, s AS (SELECT id, {squeeze('v')} AS s FROM e) SELECT id, CASE WHEN NOT regexp_matches(s, {q(f'(?i){WAITING}')}) THEN coalesce({_REPAIRED}) END AS title FROM s")
def _(t):
    return _evidence(t).select("id", titles.repair_title(F.array("v"), lit("")).alias("title"))


@query("strong_candidates")
def _(t):
    rows = papers(t).select(col("id").cast("int").alias("pos"), F.concat(lit("https://github.com/lab/t"), "id").alias("url"), lit("").alias("platform"), F.expr(_EV).alias("title"), lit("").alias("snippet"), lit("").alias("readerTitle"), lit("").alias("readerExcerpt"), lit(20).alias("score"), (col("id") % 50).cast("int").alias("priority"))
    return queue.strong_candidates(rows, 24)


_DETAIL = "concat('<title>CVPR Oral ', id, ' x</title><h1>head</h1>', CASE WHEN id % 2 = 0 THEN concat('{\"name\": \"Paper ', id, ' &amp; more\"}') ELSE '' END, '{\"name\": \"Ann B\"} {\"name\" : \"Bo &quot;C&quot;\"} {\"name\": \"Ann B\"} {\"name\": \"CVPR 2026\"}<div id=\"abstractText\"><b>x</b><p>', title, ' <i>of</i> it</p><p>no</p></div>')"


@query("page_detail", f"""WITH {PAPERS} SELECT id, CASE WHEN id % 2 = 0 THEN 'Paper ' || id || ' & more' ELSE 'Ann B' END AS title, {squeeze("title || ' of it'")} AS abstract, CASE WHEN id % 2 = 0 THEN 'Ann B|Bo "C"' ELSE 'Bo "C"' END AS authors, 'Oral' AS track FROM papers""")
def _(t):
    rows = papers(t).select("id", html.page_detail(F.expr(_DETAIL), lit("none")).alias("d"))
    return rows.select("id", "d.title", "d.abstract", F.array_join("d.authors", "|").alias("authors"), "d.track")


@query("issue_urls", f"WITH {PAPERS} SELECT id, 'https://j.example.org/issue/' || (id % 90) || '|https://j.example.org/issue/' || (id % 90 + 100) AS urls FROM papers")
def _(t):
    one = lambda n, title, series: f"concat('<a class=\"title\" href=\"https://j.example.org/issue/', {n}, '\"> {title} </a> <p>x</p><div class=\"series\">{series}</div>')"
    page = f"concat({one('id % 90 + 100', 'J-26 Tracks 2', 'Vol. 40 No. 9')}, {one('id % 90', '<b>J-26</b> Tracks', ' Vol. 40 No. 1')}, {one('id % 90', 'J-26 Tracks', 'Vol. 40 No. 1')}, {one('7', 'J-26 Tracks', 'Vol. 39 No. 1')}, {one('8', 'Other', 'Vol. 40 No. 2')})"
    return papers(t).select("id", F.array_join(html.issue_urls(F.expr(page), "https://j.example.org/issue/", "Vol. 40 No.", "J-26 Tracks"), "|").alias("urls"))
