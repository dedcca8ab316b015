"""Text, title, venue and page functions on literal cases."""

from pyspark.sql import functions as F

from scriptorium.functions import display, guides, html, text, titles, unicode, venues
from scriptorium.operators import catalog, queue


def cases():
    return [
        (text.normalize_text(F.lit("Don't: RAG—based LLMs!")), "don t rag based llms"),
        (text.normalize_search(F.lit("Don't: RAG")), "dont rag"),
        (text.normalize_text(F.lit(None).cast("string")), ""),
        (text.slugify(F.lit("CVPR 2026 Main")), "cvpr-2026-main"),
        (text.slugify(F.lit("中文"), "venue"), "venue"),
        (text.split_keywords(F.lit("a; b,c")), ["a", "b", "c"]),
        (text.split_keywords(F.lit("single")), ["single"]),
        (text.split_keywords(F.lit(" ")), []),
        (text.longer_text(F.lit("ab"), F.lit("cd")), "ab"),
        (text.longer_text(F.lit("ab"), F.lit("abc")), "abc"),
        (text.longer_text(F.lit(""), F.lit("x")), "x"),
        (text.clamp(F.lit("0"), 1, 50, 10), 10),
        (text.clamp(F.lit("999"), 1, 50, 10), 50),
        (text.clamp(F.lit("-3.7"), 1, 50, 10), 1),
        (text.clamp(F.lit("x"), 1, 50, 10), 10),
        (text.hash_values(F.array(F.lit("a"), F.lit("b"))), __import__("hashlib").sha1(b"a\nb\n").hexdigest()),
        (text.content_value(F.lit('{"title": {"value": "T"}}'), "title"), "T"),
        (text.content_value(F.lit('{"title": "T"}'), "title"), "T"),
        (text.json_block(F.lit('so ```json\n{"a": 1}\n``` ok')), '{"a": 1}'),
        (text.json_block(F.lit("none")), None),
        (text.parse_authors(F.lit("@x{author={A B and C D}}"), F.lit("")), ["A B", "C D"]),
        (text.parse_authors(F.lit(None).cast("string"), F.lit(None).cast("string")), ["Unknown authors"]),
        (text.truncate(F.lit("a  b c"), 3), "a b..."),
        (html.decode_named(F.lit("&amp;lt; &quot;")), '< "'),
        (html.clean_html(F.lit("<b>a</b>\n <i>b&nbsp;</i>")), "a b"),
        (html.strip_markup(F.lit("a<br/>b [link text](http://x) <i>c</i>")), "a b link text c"),
        (html.meta_content(F.lit('<meta name="citation_title" content="A &amp; B">'), "citation_title"), "A & B"),
        (titles.clean_title(F.lit("GitHub - lab/x: DeepThing: A Study of Things ## Install")), "DeepThing: A Study of Things"),
        (titles.clean_title(F.lit("the paper")), ""),
        (titles.clean_title(F.lit("[ACL 2026] Learning to Rank Widgets")), "Learning to Rank Widgets"),
        (titles.is_dirty_title(F.lit("see github.com/x")), True),
        (titles.is_dirty_title(F.lit("识别到接收信号")), True),
        (titles.is_dirty_title(F.lit("A Fine Title")), False),
        (titles.title_quality(F.lit("A Fine Title.")), 19),
        (titles.title_quality(F.lit("Models for")), 10 - 80),
        (titles.best_title(F.array(F.lit("abstract of"), F.lit("Graph Nets: A Long Survey")), F.array(F.lit("x"))), "Graph Nets: A Long Survey"),
        (titles.pick_title(F.lit("A Short Title"), F.lit("A Much Longer Title Here")), "A Much Longer Title Here"),
        (venues.venue_rule(F.lit("accepted to ACL 2026"))["venue"], "ACL 2026"),
        (venues.venue_rule(F.lit("aaai-26"))["venue"], "AAAI"),
        (venues.venue_rule(F.lit("ACL 2026 findings")), None),
        (venues.venue_in_evidence(F.lit("accepted at CVPR 26 main conference")), "CVPR 2026 Main"),
        (venues.venue_in_evidence(F.lit("CVPR 2026")), None),
        (venues.venue_year(F.lit("see NeurIPS 26")), "NEURIPS 2026"),
        (venues.venue_short(F.lit("未分类 / Unclassified")), "Unclassified"),
        (venues.venue_year_key(F.lit("ACL 2026 Main"), F.lit(2026)), "ACL:2026"),
        (venues.platform_of(F.lit("https://twitter.com/a")), "x"),
        (venues.platform_of(F.lit("https://openreview.net/a"), official=True), "official"),
        (venues.platform_of_query(F.lit("site:github.com x y")), "x"),
        (venues.repository(F.lit("https://github.com/topics/nlp"))["name"], "nlp"),
        (venues.repository(F.lit("https://github.com/a/topics")), None),
        (venues.is_personal_homepage(F.lit("https://github.com/Me/me.github.io")), True),
        (venues.domain_filter(F.lit("https://www.X.com/a")), "x.com"),
        (venues.domain_filter(F.lit("not a host")), None),
        (display.affinity_label(F.lit(79.5), F.lit(None).cast("double"), F.lit(None).cast("double")), "L80"),
        (display.lexical_affinity(F.lit(240.0)), "0.9999"),
        (display.relative_time(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:59:40").cast("timestamp")), "1 hr ago"),
        (display.relative_time(F.lit("2024-01-03 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")), "2 days later"),
        (display.timestamp_or_epoch(F.lit("no time")).cast("long"), 0),
        (display.run_label(F.lit(None).cast("string"), F.lit("x")), "No workflow run yet."),
        (display.run_tone(F.lit("completed"), F.lit("cancelled")), "bad"),
        (display.display_summary(F.lit("Found; waiting for Zhipu enrichment."), F.lit(""), F.lit("s"), F.lit("")), "Found"),
        (guides.topic(F.lit("A Web agent for video")), "网页智能体"),
        (guides.data_scale(F.lit("over 1.5k tasks in all")), "1.5k tasks"),
        (guides.method_name(F.lit("AlphaNet: learning")), "AlphaNet"),
        (queue.is_broken_title(F.lit("x")), True),
        (queue.reject_reason(F.lit("A fine title of it"), F.lit("https://github.com/topics/x")), "generic-homepage-or-topic"),
        (catalog.classify(F.lit("A VLM agent for video retrieval"))["categories"], ["vlm-understanding", "evaluation-benchmarks", "agents-tool-use", "video-understanding"]),
        (catalog.classify(F.lit("nothing"))["primary"], "mllm-foundations"),
        (catalog.is_relevant_title(F.lit("A Multimodal Thing")), True),
    ]


def test_cases(spark):
    listed = cases()
    row = spark.range(1).select(*[expr.alias(f"v{i}") for i, (expr, _) in enumerate(listed)]).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(listed) if row[i] != want]
    assert wrong == []


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁ①Ａ",), (None,)], "x string")
    assert [r["x"] for r in df.select(unicode.nfkc("x").alias("x")).collect()] == ["fi1A", None]
    df = spark.createDataFrame([("&#65;&#x42; &#0; &amp;",), (None,)], "x string")
    assert [r["x"] for r in df.select(unicode.decode_numeric("x").alias("x")).collect()] == ["AB &#0; &amp;", None]
    assert [r["x"] for r in df.select(unicode.decode_all("x").alias("x")).collect()][0].startswith("AB ")
