"""The pipeline's stages on a small table with odd rows."""

import corpus_pipeline as cp


def test_stages(spark, docs, rows, tmp_path):
    at = docs.select(*cp.COLUMNS)
    kept = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, at, "").write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = at.collect()
        if i < len(cp.STAGES) - 1:
            assert at.columns == cp.COLUMNS
    gone = {9001, 9002, 9003, 9009}  # no letter; 9010 is of an unknown and a known script, and so at the border
    assert {r["doc_id"] for r in kept["language ID"]} | {9010} == {d for d, *_ in rows} - gone
    assert len(kept["SimHash near-dedup"]) < len(kept["language ID"])
    assert {r["doc_id"] for r in kept["SimHash near-dedup"]} <= {r["doc_id"] for r in kept["language ID"]}
    assert sum(r["doc_id"] == 9006 for r in kept["SimHash near-dedup"]) <= 1
    assert next(r["text"] for r in kept["secret scans"] if r["doc_id"] == 9007) == 'x [SECRET]" y [SECRET] z'
    assert {r["doc_id"] for r in kept["mixing"]} == {r["doc_id"] for r in kept["packing"]}


def test_run(spark, sf):
    found = cp.run(spark, sf)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)


def test_empty(spark, empty, tmp_path):
    at = empty
    for _, stage in cp.STAGES:
        at = stage(spark, at, "")
    assert at.collect() == []


def test_live_opaque_strings_go(spark):
    """The secret stage redacts what op1_secret_scan judges live, and leaves widely copied strings alone."""
    from scriptorium.llm import secret_scan

    copied, live = "Zx9aB3dE5fG7hJ9kL1mN3pQ5rS7t", "Qq1aB3dE5fG7hJ9kL1mN3pQ5rS7t"
    rows = [(i, f"say {copied} end", "en", f"s{i}", 1) for i in range(6)]
    rows += [(6, f"é {live} and {copied} password: abcdef", "en", "s6", 1), (7, f"{live}", "en", "s6", 1), (7, f"{live}", "en", "s6", 1), (8, None, None, None, None), (None, "plain", "en", "s1", 5)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cp.secrets(spark, at, "").collect()), key=str)
    want = [(i, f"say {copied} end", 1) for i in range(6)]
    long = f"é [SECRET] and {copied} [SECRET]"
    want += [(6, long, len(long)), (7, "[SECRET]", 8), (7, "[SECRET]", 8), (8, None, None), (None, "plain", 5)]
    assert found == sorted(want, key=str)
    assert {r["doc_id"]: r["live"] for r in secret_scan.scan_secrets(at).collect()}[7] == 1


def test_one_of_each_component_stays(spark):
    """Unlike texts that share an id, or have none, all stay; of each group of copies exactly one row does."""
    words = lambda i: " ".join(f"w{i}x{j * (i + 3)}" for j in range(40))
    unlike = [(None, words(i), "en", "s", 1) for i in range(8)] + [(7, words(100 + i), "en", "s", 1) for i in range(8)]
    copies = [(7, words(200), "en", "s", 1), (5, words(200), "en", "s", 1), (5, words(201), "en", "s", 1), (3, words(201), "en", "s", 1), (None, words(202), "en", "a", 1), (None, words(202), "en", "b", 1), (None, words(0), "en", "s", 1)]
    at = spark.createDataFrame(unlike + copies, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = [(r["doc_id"], r["text"]) for r in cp.near_dedup(spark, at, "").collect()]
    want = [(d, t) for d, t, *_ in unlike] + [(5, words(200)), (3, words(201)), (None, words(202))]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_languages_that_nobody_taught_go(spark, sf):
    """Every labelled document stays; long texts in other languages, of no letters' use or of code go, as do those without a letter."""
    from scriptorium.llm import langid

    base = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    junk = ["To jest zdanie w języku polskim, które jest dłuższe i ma wiele słów. " * 5, "Ez egy hosszabb magyar szöveg, amelyet azért írtunk, hogy lássuk, milyen messze van. " * 5, "bcdfg hjklm npqrs tvwxz " * 20, "Привет мир, это текст на русском языке. " * 5, "12 34 !!", None, "日本語のテキスト" * 9]
    planted = spark.createDataFrame([(90_000 + i, t, None, "s", 1) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in cp.language(spark, base.unionByName(planted), "").collect()}
    assert {r["doc_id"] for r in base.collect()} <= kept and len([d for d in kept if d >= 90_000]) <= 1
    judged = langid.identify(base.unionByName(planted)).groupBy("rejected").count().collect()
    assert {r["rejected"]: r["count"] for r in judged}[True] >= len(junk) - 1


def test_mix_is_in_order_and_cut(spark, docs, tmp_path):
    """What the stage writes is the head of the global order of finish times, as long as the budget."""
    from scriptorium.llm import mixing

    at = docs.select(*cp.COLUMNS)
    cp.mix(spark, at, "").write.parquet(f"{tmp_path}/m")
    served, budget, horizon = mixing._served(at, (1, 2, 3), 3, 17)
    copies = sorted(mixing._copies(served, 3, horizon).collect(), key=lambda c: (c["finish"], c["_o"]))
    last, used = 0, 0
    for c in copies:
        if used + c["size"] > budget:
            break
        used, last = used + c["size"], c["finish"]
    written = spark.read.parquet(f"{tmp_path}/m").count()
    assert abs(written - sum(c["finish"] <= last for c in copies)) <= 2 and written < len(copies)


def test_passed_stages_leave_nothing(spark, sf):
    """Of all tables that a run writes only its result stays."""
    from scriptorium import shared

    before = shared.cuts()
    found = cp.run(spark, sf)
    assert shared.cuts() == before + 1 and found.count() > 0
