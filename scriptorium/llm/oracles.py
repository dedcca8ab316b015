"""DuckDB SQL for the corpus queries that SQL can express.

No SQL is given where a hash that SQL lacks (XXH64, CRC-32), a tokenizer or a trained model
decide: simhash, media, packing, language ID, main text and the pipeline. Tests hold those
against brute force.
"""

from __future__ import annotations

from .license_texts import LONG_TEXTS, NOTICES, TEXTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def top_k() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def _canonical(x: str) -> str:
    """Lower case without copyright lines, words of a-z and 0-9, then one spelling of each word."""
    words = f"regexp_extract_all(regexp_replace(lower({x}), '(?m)^[ \\t]*((copyright:?[ \\t]*)?(\\(c\\)|©)|copyright:?[ \\t]+([0-9\\[<{{]|by[ \\t]))[^\\n]*$|^[ \\t]*all rights reserved[.!]?[ \\t]*$', ' ', 'g'), '[a-z0-9]+')"
    one = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v", "version"), ("https", "http"), ("noncommercial", "nc"), ("organisation", "organization"), ("favour", "favor"))
    spelled = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in one)
    return f"array_to_string(list_transform({words}, lambda w: CASE w {spelled} ELSE w END), ' ')"


def licenses() -> str:
    """Known texts are digested by the SQL itself; of long ones only the digests are known."""
    lines = ", ".join(f"({q(t)}, {q(n)})" for n, texts in NOTICES.items() for t in texts)
    wholes = ", ".join(f"({q(title + chr(10) + chr(10) + body)}, {q(n)})" for n, (titles, body) in TEXTS.items() for title in ["", *titles])
    long = ", ".join(f"({q(d)}, {q(n)})" for n, digests in LONG_TEXTS.items() for d in digests)
    return f"""WITH n(line, name) AS (VALUES {lines}), x(body, name) AS (VALUES {wholes}), y(digest, name) AS (VALUES {long}), k AS (SELECT DISTINCT sha256({_canonical('line')}) AS digest, name FROM n), a AS (SELECT * FROM k UNION SELECT sha256({_canonical('body')}), name FROM x UNION SELECT * FROM y),
      t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
      s AS (SELECT rid, string_agg(DISTINCT k.name, ',' ORDER BY k.name) AS notices, count(*) AS n FROM l JOIN k ON k.digest = sha256({_canonical('line')}) GROUP BY rid), w AS (SELECT rid, doc_id, sha256({_canonical('text')}) AS text_digest FROM t)
      SELECT w.doc_id, w.text_digest, a.name AS license, coalesce(s.notices, '') AS notices, coalesce(s.n, 0) AS n_notices FROM w LEFT JOIN a ON a.digest = w.text_digest LEFT JOIN s ON s.rid = w.rid"""


def secrets(copied_owners: int = 3) -> str:
    key, sep = "(?i:password|passwd|secret|token|api_?key)", """[\"']?\\x20*[:=]\\x20*[\"']?"""
    # a run of hexadecimal digits is found whole, so shorter ones needn't be looked at
    kinds = (("assign", f"{key}{sep}[A-Za-z0-9+/_.=-]+"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{24,}"), ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*Proc-Type:[^\n]*\n)?(?:\s*DEK-Info:[^\n]*\n)?[^-]*-----END [A-Z ]*PRIVATE KEY-----"), ("opaque", "[A-Za-z0-9+/_-]{24,}"))
    found = " UNION ALL ".join(f"SELECT rid, {i} AS ord, {q(k)} AS kind, regexp_extract_all(t, {q(p)}) AS f, string_split_regex(t, {q(p)}) AS g FROM d WHERE regexp_matches(t, {q(p)})" for i, (k, p) in enumerate(kinds))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS o, coalesce(lang, chr(1)) AS l, coalesce(text, '') AS t FROM documents), m AS ({found}), u AS (SELECT rid, ord, kind, f, g, unnest(range(len(f))) AS i FROM m),
      c AS (SELECT rid, ord, kind, f[i + 1] AS m, CAST(sum(length(g[i + 1])) OVER w + coalesce(sum(length(f[i + 1])) OVER (PARTITION BY rid, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM u WINDOW w AS (PARTITION BY rid, ord ORDER BY i ROWS UNBOUNDED PRECEDING)),
      v AS (SELECT rid, ord, kind, s, s + length(m) AS e, CASE ord WHEN 0 THEN regexp_replace(m, {q("^" + key + sep)}, '') WHEN 3 THEN regexp_replace(m, '-----[A-Z ]*-----|\\s', '', 'g') ELSE m END AS x FROM c),
      k AS (SELECT * FROM v WHERE CASE ord WHEN 0 THEN length(x) >= 6 WHEN 1 THEN length(x) >= 20 WHEN 2 THEN length(x) >= 24 WHEN 3 THEN length(x) >= 16 ELSE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') END),
      w AS (SELECT k.x, count(DISTINCT d.o || chr(2) || d.l) AS repos, count(DISTINCT d.o) AS owners FROM k JOIN d ON d.rid = k.rid GROUP BY 1),
      j AS (SELECT k.*, w.repos, w.owners, w.owners <= {copied_owners} AS live, k.kind || ':' || k.s || ':' || k.e AS span FROM k JOIN w ON w.x = k.x),
      a AS (SELECT rid, count_if(ord = 0) AS n_assign, count_if(ord = 1) AS n_access, count_if(ord = 2) AS n_hex, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < 3 OR live) AS spans,
      count_if(live) AS live, count_if(NOT live) AS copied, max(repos) AS repositories, max(owners) AS owners FROM j GROUP BY rid)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0) AS live, coalesce(copied, 0) AS copied, coalesce(repositories, 0) AS repositories, coalesce(owners, 0) AS owners
      FROM d LEFT JOIN a ON a.rid = d.rid"""


def mixing(epochs: int = 3, seed: int = 17) -> str:
    """Sources by how soon they are full: those whose limit over their weight is below the level that the others then have. All copies then queue up by finish time."""
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5({seed} || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS r FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM d GROUP BY source),
      f AS (SELECT *, {epochs} * n / w AS ratio FROM s),
      l AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum({epochs} * n) OVER (ORDER BY ratio, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
      c AS (SELECT *, bool_and(ratio < level) OVER (ORDER BY ratio, o ROWS UNBOUNDED PRECEDING) AS capped FROM l),
      t AS (SELECT source, n, CASE WHEN capped THEN CAST({epochs} * n AS DOUBLE) ELSE CAST((SELECT sum(n) FROM c) - coalesce((SELECT sum({epochs} * n) FROM c WHERE capped), 0) AS DOUBLE) * w / (SELECT sum(w) FROM c WHERE NOT capped) END AS target FROM c),
      q AS (SELECT row_number() OVER () AS rid, doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY r, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
      k AS (SELECT q.rid, q.size, o, e, CAST(e * t.n + q.start + q.size AS DOUBLE) / t.target AS finish FROM q JOIN (SELECT t.*, s.o FROM t JOIN s ON s.source IS NOT DISTINCT FROM t.source) t ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN range({epochs}) x(e) WHERE q.size > 0),
      g AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, o, e ROWS UNBOUNDED PRECEDING) - size AS before FROM k),
      a AS (SELECT rid, sum(greatest(0, least(size, (SELECT sum(n) FROM s) - before))) AS taken FROM g GROUP BY rid)
      SELECT q.doc_id, q.size, t.n AS source_size, t.target, CAST(coalesce(a.taken, 0) AS BIGINT) AS taken FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN a ON a.rid = q.rid"""


def repeats(length: int = 200) -> str:
    """Every window of bytes, as hexadecimal digits, by its MD5: some gigabytes of digits for each 10 MB of text, so for small tables."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
      u AS (SELECT rid, unnest(list_transform(range(length(x) // 2 - {length - 1}), lambda i: md5(substr(x, 2 * i + 1, {2 * length})))) AS h, unnest(range(length(x) // 2 - {length - 1})) AS p FROM d WHERE length(x) >= {2 * length}),
      g AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1), f AS (SELECT rid, p FROM u WHERE h IN (SELECT h FROM g)),
      b AS (SELECT rid, unnest(list_transform(range(length(x) // 2), lambda i: substr(x, 2 * i + 1, 2))) AS byte, unnest(range(length(x) // 2)) AS p FROM d),
      c AS (SELECT b.rid, b.p, b.byte, coalesce(max(CASE WHEN f.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.rid ORDER BY b.p ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM b LEFT JOIN f ON f.rid = b.rid AND f.p = b.p),
      e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY rid ORDER BY p) AS before FROM c),
      a AS (SELECT rid, count(*) AS n, CAST(sum(gone) AS BIGINT) AS removed, count_if(gone = 1 AND before = 0) AS spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY rid)
      SELECT d.doc_id, coalesce(a.n, 0) AS n_bytes, coalesce(a.removed, 0) AS n_removed, coalesce(a.spans, 0) AS n_spans, sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.rid = d.rid"""


def near_duplicates(percent: int = 85) -> str:
    """Sets of whole shingles of each distinct text, met by inverted lists; components by reachability."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, array_to_string({words}, ' ') AS t FROM documents),
      k AS (SELECT t, row_number() OVER (ORDER BY t) AS k, min(doc_id) AS least, string_split(t, ' ') AS w FROM d WHERE t <> '' GROUP BY t),
      s AS (SELECT k, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [t] ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END)) AS x FROM k),
      n AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k < b.k GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN n m ON m.k = p.a JOIN n o ON o.k = p.b WHERE 100 * c >= {percent} * (m.n + o.n - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
      r AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), g AS (SELECT r.a AS k, min(k.least) AS component FROM r JOIN k ON k.k = r.b GROUP BY r.a)
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN d.t = '' THEN d.doc_id ELSE g.component END AS component_id, d.doc_id IS NOT DISTINCT FROM CASE WHEN d.t = '' THEN d.doc_id ELSE g.component END AS kept
      FROM d LEFT JOIN k ON k.t = d.t LEFT JOIN n ON n.k = k.k LEFT JOIN g ON g.k = k.k"""


def _crc32(x: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = f"list_transform(range(8 * length({x})), lambda i: (ascii(substr({x}, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"


def manifest() -> str:
    """Levels are built one by one, trees of a group first, then the tree over their roots; each row then climbs them."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"

    def levels(base: str) -> str:
        return f"SELECT 0 AS lev, t, i, node, n FROM {base} UNION ALL SELECT lev + 1, t, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM {{own}} WHERE n > 1 GROUP BY lev, t, i // 2, n"

    def climb(own: str, start: str) -> str:
        """(rid, lev, i, said, node): siblings so far and the node that the row's own leaf gives."""
        pair = f"CASE WHEN c.i % 2 = 1 THEN x.node || c.node WHEN x.node IS NOT NULL THEN c.node || x.node ELSE c.node END"
        return f"SELECT rid, t, 0 AS lev, i, said, node, n FROM {start} UNION ALL SELECT c.rid, c.t, c.lev + 1, c.i // 2, c.said || coalesce(x.node, ''), sha256({pair}), (c.n + 1) // 2 FROM {{me}} c LEFT JOIN {own} x ON x.t = c.t AND x.lev = c.lev AND x.i = xor(c.i, 1) WHERE c.n > 1"

    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || lang, '') AS t, {leaf('n_chars')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {leaf('n_chars + 1')} END AS changed FROM documents),
      b AS (SELECT rid, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY t) AS n, leaf AS node FROM d),
      u AS ({levels('b').format(own='u')}), s AS (SELECT t AS of, node AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n, '' AS t FROM u WHERE n = 1),
      w AS (SELECT 0 AS lev, t, i, subroot AS node, n FROM s UNION ALL SELECT lev + 1, t, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM w WHERE n > 1 GROUP BY lev, t, i // 2, n), z AS (SELECT node AS root FROM w WHERE n = 1),
      o AS (SELECT b.rid, b.t, b.i, b.n, '' AS said, coalesce(d.changed, d.leaf) AS node FROM b JOIN d USING (rid)), c AS ({climb('u', 'o').format(me='c')}),
      h AS (SELECT c.rid, '' AS t, s.i, s.n, c.said, c.node FROM c JOIN s ON s.of = c.t WHERE c.n = 1), e AS ({climb('w', 'h').format(me='e')})
      SELECT d.doc_id, d.leaf, s.subroot, z.root, sha256(e.said) AS proof_sha256, e.node AS folded_root, e.node = z.root AS verified FROM d JOIN e ON e.rid = d.rid AND e.n = 1 JOIN s ON s.of = d.t CROSS JOIN z"""


def filter_audit() -> str:
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    return f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS w FROM documents), x AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS u, min(doc_id) OVER (PARTITION BY t) AS least FROM w),
      m AS (SELECT doc_id, part, CASE WHEN n < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * u < 65 * n THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS f FROM x),
      l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
      c AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL),
      v(x, b) AS {letters}, o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM v a JOIN v b ON b.x <> a.x JOIN v c ON c.x NOT IN (a.x, b.x) JOIN v d ON d.x NOT IN (a.x, b.x, c.x) JOIN v e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
      s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step, bits FROM o), q AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM s),
      r AS (SELECT part, filter_order, step, n, good, toxic, f & own <> 0 AS fails, f & before <> 0 AS gone, f = own AS sole FROM c CROSS JOIN q),
      g AS (SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
      SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM g"""
