"""Approximate matches against the edit distance of every part of a text."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.operators import fuzzy, search


def edits(piece, text):
    """Least edits between a piece and any part of a text, cell by cell."""
    column = list(range(len(piece) + 1))
    best = column[-1]
    for c in text:
        old, column = column, [0]
        for i, x in enumerate(piece, 1):
            column.append(min(old[i - 1] + (x != c), old[i] + 1, column[-1] + 1))
        best = min(best, column[-1])
    return best


letters = st.text(alphabet="abé日 \U0001f600", max_size=150)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abé日 ", min_size=1, max_size=32), st.lists(letters, max_size=6), st.integers(1, 90), st.integers(1, 5))
def test_least_edits(piece, texts, window, together):
    """Any window size and any number of windows at a time give what whole texts give."""
    before = fuzzy.WINDOW, fuzzy.TOGETHER
    fuzzy.WINDOW, fuzzy.TOGETHER = window, together
    try:
        codes, bounds = fuzzy._code_points(pa.array(texts, pa.string()))
        assert fuzzy.least_edits(codes, bounds, piece).tolist() == [edits(piece, t) for t in texts]
    finally:
        fuzzy.WINDOW, fuzzy.TOGETHER = before


def test_slices():
    texts = pa.array(["skip", "abcd", "xbcé", ""])[1:]
    codes, bounds = fuzzy._code_points(texts)
    assert fuzzy.least_edits(codes, bounds, "abc").tolist() == [0, 1, 3]


def value_score(query, text):
    """The mean over pieces, 1 for those with more than 34 % of edits; none if all are; nearly 0 for the query itself."""
    parts = fuzzy.pieces(query)
    shares = [edits(p, text) / len(p) for p in parts]
    if text == query:
        return 2.220446049250313e-16
    return sum(max(s, 0.001) if s <= 0.34 else 1.0 for s in shares) / len(parts) if any(s <= 0.34 for s in shares) else None


def row_score(query, values):
    """values: (weight, text) pairs, of weights that sum up to 14.6 over the fields."""
    left = 1.0
    for weight, text in values:
        found = value_score(query, text.lower())
        if found is not None:
            left *= found ** (weight / 14.6 * int(1000 / len([w for w in text.split(" ") if w]) ** 0.5 + 0.5) / 1000)
    return 1 - left


PAPERS = [
    (0, "Graph Netwroks for All", "图网络", ["graphs", "deep learning"], ["GNN"], "a hook", "Graph nets and more about neural graph networks", "short"),
    (1, "Graph Networks", None, None, None, None, None, None), (2, "Something else", "", [], [""], "", "", ""),
    (3, "", "graph networks", [None, "graph network", "graph networks"], ["graph networks"], "graph netwrks", "of graphs; networks", "grph networks"), (4, None, None, None, None, None, None, "x" * 3000 + "graph netw0rks"),
]
SHAPE = "pos int, title string, titleZh string, keywords array<string>, aliases array<string>, hookZh string, abstract string, tldr string"


@pytest.mark.parametrize("query", ["graph networks", "Graph Networks for a text that is longer than one piece of it", "图网络", " ", "zzzz"])
def test_seven_fields(spark, query):
    rows = spark.createDataFrame(PAPERS, SHAPE).repartition(2)
    scored = search.prepare(rows, keywords="keywords").select("pos", search.fuzzy_base(search.expand(query)).alias("b")).collect()
    asked = query.strip().lower()
    for r in scored:
        row = next(p for p in PAPERS if p[0] == r["pos"])
        values = [(w, x) for (name, w), field in zip({"title": 4, "titleZh": 3, "keywords": 2, "aliases": 2, "hookZh": 1.4, "abstract": 1, "tldr": 1.2}.items(), row[1:]) for x in (field if isinstance(field, list) else [field]) if x and x.strip()]
        assert r["b"] == pytest.approx(100 * row_score(asked, values) if asked else 0, abs=1e-9), (row, query)


def test_titles_and_aliases(spark):
    """Other titles may be strings or arrays; an alias that is the query is an exact hit."""
    rows = search.prepare(spark.createDataFrame(PAPERS, SHAPE), other_titles=["titleZh", "aliases"], keywords="keywords", blob=["titleZh", "keywords", "aliases", "tldr"])
    hits = search.lexical_search(rows, search.expand("GNN"), 5).collect()
    assert [h["pos"] for h in hits] == [0] and hits[0]["exact"]
    assert search.lexical_search(rows.where("pos <> 3"), search.expand("zzzz qqqq"), 5).count() == 0


def test_fuzzy_rows(spark):
    found = fuzzy.fuzzy_rows(spark.createDataFrame(PAPERS, SHAPE), "graph networks", 9, {"title": 1.0, "keywords": 2.0}).collect()
    assert [r["pos"] for r in found] == [3, 1, 0] and found[0]["fuzzy"] > 0.99
    assert np.isclose(found[1]["fuzzy"], 1 - 2.220446049250313e-16 ** (0.707 / 3))
