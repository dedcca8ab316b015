"""Properties of the plain functions under the operators."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import html_extract, langid, media, mixing, packing, simhash, suffix_dedup

quick = settings(max_examples=60, deadline=None)
TREE = html_extract.train_tree(html_extract.LABELLED)


@quick
@given(st.lists(st.integers(0, 10_000), max_size=12), st.integers(1, 5))
def test_targets(sizes, epochs):
    weights = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
    target = mixing.fair_targets(sizes, weights, sum(sizes), epochs)
    assert abs(sum(target) - sum(sizes)) < 1e-6 * (1 + sum(sizes))
    level = [t / w for t, w, s in zip(target, weights, sizes) if s and t < epochs * s - 1e-9]
    assert all(t <= epochs * s + 1e-9 for t, s in zip(target, sizes)) and (not level or max(level) - min(level) < 1e-6 * (1 + max(level)))


@quick
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_packing(stock):
    for used in (packing.best_fit(dict(stock), 64), packing.solve_configurations(dict(stock), 64)):
        held = Counter()
        for pattern, times in used:
            assert times > 0 and sum(k * c for k, c in pattern.items()) <= 64
            for k, c in pattern.items():
                held[k] += c * times
        assert held == Counter(stock)
    places = packing._places(packing.solve_configurations(dict(stock), 64))
    taken = Counter()
    for length, _, copies, first, at in places.tolist():
        taken[length] += copies
        assert 0 <= at <= 64 - copies * length and first >= 0


@quick
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), min_size=1, max_size=20))
def test_merge(spans):
    spans = [(a, a + n) for a, n in spans]
    merged = suffix_dedup.merge(np.array(spans)).tolist()
    assert {i for a, b in merged for i in range(a, b)} == {i for a, b in spans for i in range(a, b)}
    assert all(x[1] < y[0] for x, y in zip(merged, merged[1:]))


@quick
@given(st.text(max_size=300))
def test_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert 0 <= simhash.fingerprint(text) < 1 << 64
    html_extract.main_text(text, TREE)
    html_extract.main_text(f"<article><p>{text}</p>", TREE)
    assert langid.counts([text, ""])[0].shape == (2, langid.WIDTH) and langid.counts([text, ""])[0][1].sum() == 0
    stored = media.as_image(text.encode())
    assert media.decode(stored).tobytes().startswith(text.encode()) and len(media.tile(media.decode(stored))) > 128


@quick
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 12), st.integers(1, 12))
def test_area(h, w, height, width):
    a = np.random.default_rng(h * 31 + w).integers(0, 256, (h, w))
    assert np.isclose(media.area_resize(a, height, width).mean(), a.mean())
    assert (media.decode(media.encode_bmp(a.astype(np.uint8))) == a).all()
