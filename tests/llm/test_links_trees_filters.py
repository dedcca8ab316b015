"""Near-duplicates by registers, Merkle manifests and filter audits against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import filter_audit, manifest, minhash


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def linked(rows, percent=85):
    """Counter of (doc_id, n_shingles, component_id, kept) by all pairs of distinct sets."""
    kinds = defaultdict(list)
    for doc, text, *_ in rows:
        kinds[frozenset(sets(text))].append(doc)
    keys = [k for k in kinds if k]
    root = {k: k for k in keys}

    def find(k):
        while root[k] is not k:
            k = root[k]
        return k

    for a, b in combinations(keys, 2):
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            root[find(a)] = find(b)
    least = {}
    for k in keys:
        for d in kinds[k]:
            if d is not None:
                least[find(k)] = min(d, least.get(find(k), d))
    out = Counter()
    for k, docs in kinds.items():
        for d in docs:
            c = least.get(find(k)) if k else d
            out[(d, len(k), c, d == c)] += 1
    return out


def found_links(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_minhash(rows, docs):
    assert found_links(minhash.minhash_report(docs)) == linked(rows)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("bands", "block"), [(32, 1 << 18), (32, 300)])
def test_minhash_groups(spark, bands, block):
    """Groups of copies that are edited as far as the threshold, chains of edits, and sets of other sizes; in small blocks too."""
    rng = random.Random(7)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 60, 150, 400]))]
        texts += [edited(base, rng, rng.randrange(1 + len(base) // 30)) for _ in range(14)]
        chain = base
        for _ in range(6):
            chain = edited(chain, rng, max(1, len(base) // 60)).split()
            texts.append(" ".join(chain))
        texts += [" ".join(base[: len(base) * 9 // 10]), " ".join(base).upper(), " ".join(base)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  Words"), (905, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_links(minhash.near_duplicates(df, bands=bands, block=block)) == linked(rows)


def test_minhash_repeated_rows(spark):
    """Thousands of equal rows, and as many without an id, are one kind."""
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text + " more").alias("text")))
    assert found_links(minhash.near_duplicates(df)) == {(5, 98, 5, True): 4000, (None, 99, 5, False): 4000}


def test_leftover_pairs(spark):
    """A bucket whose stars fail: links of members beyond its first one are still found, whatever the size of blocks."""
    base = [f"w{i}" for i in range(300)]
    texts = {0: " ".join(f"z{i}" for i in range(300)), 1: " ".join(base), 2: " ".join([*base[:-2], "x", "y"]), 3: " ".join(f"q{i}" for i in range(290)), 4: " ".join(f"q{i}" for i in range(294))}
    own = {k: minhash.shingles(t.encode()) for k, t in texts.items()}
    near = spark.createDataFrame([(k, len(x)) for k, x in own.items()], "node long, n long")
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in own.items()], "node long, set binary")
    members = spark.createDataFrame([(77, k, 0) for k in texts], "key long, node long, rep long")
    for block in (1, 400, 1 << 18):
        roots = spark.createDataFrame([], "node long, root long")
        assert {tuple(r) for r in minhash._leftover(members, roots, near, sets, 85, block).collect()} == {(2, 1), (4, 3)}
        roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
        assert {tuple(r) for r in minhash._leftover(members, roots, near, sets, 85, block).collect()} == {(4, 3)}


@pytest.mark.parametrize("seed", range(6))
def test_joining_pairs(seed):
    """Components after joining are those of all pairs with an odd member, with at most one link less than components."""
    rng = np.random.default_rng(seed)
    universe = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    sets = [np.unique(universe[rng.random(90) < rng.choice([0.5, 0.9, 0.97])]) for _ in range(40)]
    roots, odd = list(rng.integers(0, 25, 40)), list(rng.random(40) < 0.6)

    def joined(pairs):
        parent = {r: r for r in roots}
        for i, j in pairs:
            a, b = parent[roots[i]], parent[roots[j]]
            parent = {k: a if v == b else v for k, v in parent.items()}
        return Counter(frozenset(k for k, v in parent.items() if v == p) for p in set(parent.values()))

    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    every = [(i, j) for i in range(40) for j in range(40) if i != j and odd[i] and 100 * both(i, j) >= 85 * (len(sets[i]) + len(sets[j]) - both(i, j))]
    found = minhash.joining_pairs(sets, roots, odd, 85)
    assert joined(found) == joined(every) and set(found) <= set(every) and len(found) < len(set(roots))


def test_sketches():
    """Registers of a union are the maxima of registers; similarities are estimated well, and none at the threshold is dropped."""
    rng = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.85, 0.97):
        errors = []
        for _ in range(30):
            union = rng.integers(0, 1 << 64, 2000, np.uint64, endpoint=False)
            both = int(2000 * share)
            cut = both + int((2000 - both) * rng.random())
            a, b = union[:cut], np.concatenate([union[:both], union[cut:]])
            x, y = minhash.sketch(a), minhash.sketch(b)
            assert (minhash.sketch(union) == np.maximum(x, y)).all()
            args = [np.array([float(v)]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), len(a), len(b))]
            errors.append(minhash.similarity(*args)[0] - share)
            assert share < 0.85 or not minhash.likely(*args, 0.85)[0] is np.False_ or min(len(a), len(b)) < 0.85 * max(len(a), len(b))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert len(minhash.shingles(b"")) == 0 and len(minhash.shingles(b"A b")) == 1


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    """(root, proofs) of a list of nodes: for each, what stands before and after it, level by level."""
    proofs, levels = [[] for _ in leaves], [list(leaves)]
    while len(levels[-1]) > 1:
        own = levels[-1]
        for i in range(len(leaves)):
            at = i >> (len(levels) - 1)
            proofs[i].append((own[at - 1], "") if at % 2 else ("", own[at + 1] if at + 1 < len(own) else ""))
        levels.append([sha("".join(own[j : j + 2])) for j in range(0, len(own), 2)])
    return levels[-1][0], proofs


def manifest_of(rows):
    """Counter of the report's columns by plain lists."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: sha(enc(d) + enc(s) + enc(lang) + enc(n) + enc(t))
    groups = defaultdict(list)
    for d, t, lang, s, n in rows:
        changed = leaf(d, t, lang, s, n + 1 if n is not None else None) if d is not None and zlib.crc32(str(d).encode()) % 7 == 0 else None
        groups[lang].append((d is not None, d or 0, leaf(d, t, lang, s, n), changed, d))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(groups[x], key=lambda r: r[:3])]) for x in langs}
    root, over = tree([trees[x][0] for x in langs])
    out = Counter()
    for j, lang in enumerate(langs):
        for (_, _, own, changed, d), proof in zip(sorted(groups[lang], key=lambda r: r[:3]), trees[lang][1]):
            steps, node = proof + over[j], changed or own
            for before, after in steps:
                node = sha(before + node + after)
            out[(d, own, trees[lang][0], root, sha("".join(a + b for a, b in steps)), node, node == root)] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest(rows, docs):
    found = Counter(tuple(r) for r in manifest.manifest_report(docs).select(*COLUMNS).collect())
    assert found == manifest_of(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize(("bits", "top", "groups"), [(1, 1, 3), (2, 3, 40), (2, 5, 1), (3, 4, 9), (10, 4096, 70)])
def test_manifest_rounds(spark, monkeypatch, bits, top, groups):
    """Small blocks and upper trees, and more groups than the driver may be given."""
    monkeypatch.setattr(manifest.build_manifest, "__defaults__", (*manifest.build_manifest.__defaults__[:-2], bits, top))
    rows = [(i % 90 if i else None, f"t{i}", None if i % groups == 0 else f"l{i * i % groups}", "s", i) for i in range(137)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(tuple(r) for r in manifest.manifest_report(df).select(*COLUMNS).collect()) == manifest_of(rows)


def test_manifest_of_few(spark, empty):
    """A lone leaf is subroot and root, with an empty proof; repeated rows are leaves each."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(3, "x", "en", "s", 1)]
    row = manifest.manifest_report(spark.createDataFrame(one, shape)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    same = one * 300
    assert Counter(tuple(r) for r in manifest.manifest_report(spark.createDataFrame(same, shape)).select(*COLUMNS).collect()) == manifest_of(same)
    assert manifest.manifest_report(empty).count() == 0


def test_proofs(docs):
    """The operator gives the proofs themselves, and any altered field is noticed."""
    out = manifest.build_manifest(docs, carry={"t": F.col("text")})
    assert out.where(manifest.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    forged = manifest.leaf_hash(F.col("doc_id"), F.lit("forged"), F.col("lang"), F.lit(1), F.col("t"))
    assert out.where(manifest.fold(forged, F.col("proof")) == F.col("root")).count() == 0


def audit_of(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}  # rows without an id have no labels
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    cells = defaultdict(list)
    for d, t, _, s, _ in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and least[text] < d,
        }
        cells[s or ""].append((d, {k for k, v in fails.items() if v}))
    out = {}
    for part, docs in cells.items():
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                gone = [d for d, f in docs if x in f and not f & before]
                removed[x] += len(gone)
                out[(part, order, step)] = [
                    sum(1 for _, f in docs if not f & set(order[:step])), len(gone), sum(1 for _, f in docs if x in f and f & before), sum(1 for _, f in docs if f == {x}),
                    sum(1 for d in gone if d in good), sum(1 for d in gone if d in toxic),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(docs, labels):
    found = filter_audit.audit_filters(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT] for r in found}
    assert len(out) == len(found)
    return out


@pytest.fixture(scope="module")
def more(rows):
    """Copies of several lengths, shouting, symbols and repeated words beside the odd rows."""
    long_text = "".join(chr(97 + i % 26) + (" " if i % 5 == 0 else "") for i in range(30_000))
    tail = long_text[:-1] + "#"  # the same up to its last block
    texts = ["SHOUTING " * 60, "calm words #1", long_text, tail, long_text, "same text", "same text", "", None, "Some Text " + "w " * 60, tail]
    return [*rows, *[(9500 - i, t, "en", "s1" if i % 2 else None, 1) for i, t in enumerate(texts)], (9400, "same text", "en", "", 1), (9400, "same text", "en", "", 1), (None, "same text", "en", "s1", 1)]


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "colliding"])
def test_filter_audit(spark, sf, more, monkeypatch, way):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()] + [(9499, 1, 1), (9499, 0, None), (9496, None, 1), (None, 1, 1), (9400, 1, 0)]
    if way == "shuffled":
        monkeypatch.setattr(filter_audit.later_copies, "__defaults__", (None, -1))
    if way == "colliding":  # all texts of equal length are one class until their texts are compared
        monkeypatch.setattr(filter_audit, "_class_of", lambda length, hashes: length.cast("long"))
    docs = spark.createDataFrame(more, shape).repartition(4).withColumns({c: F.lit("x") for c in ("part", "cls", "least", "failed", "cells", "step", "quality")})
    assert audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == audit_of(more, labels)


def test_filter_audit_empty(spark, empty, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(empty, none).count() == 0
    assert audited(docs, none) == audit_of(rows, [])


def test_hot_copies(spark):
    """Thousands of copies, equal rows and rows without an id."""
    text = "x" * 3000
    df = spark.range(6000).select(F.when(F.col("id") < 3000, F.col("id") + 5).when(F.col("id") < 4500, F.lit(7)).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"))
    out = audited(df, spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out[("s", "EABCD", 1)][:2] == [1501, 4499] and out[("s", "EABCD", 1)][4] == 1
