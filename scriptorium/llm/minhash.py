"""Near-duplicates by Jaccard similarity: SetSketch registers in bands, likelihood estimates, links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut
from ..operators.graph import connected_components

#: Bands of a sketch and registers of a band: a pair at similarity 0.85 shares no band with probability 2.6e-7, one at 0.9 with 1.6e-11.
BANDS, ROWS = 32, 6
#: Base, rate and largest value of registers: they take 16 bits and tell apart what plain minima do.
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: A candidate is dropped unconfirmed only where its registers are e**MARGIN times less likely at the threshold than at the best estimate.
MARGIN = 20.0
#: Shingles of a bucket's block when leftover members are compared block by block.
BLOCK = 1 << 18
_DIGEST = xxhash.xxh64_intdigest


def _factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(20_211)).integers(0, 1 << 32, (2, m), np.uint32, endpoint=False)
    return drawn[0] | np.uint32(1), drawn[1]


def shingles(raw: bytes, size: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles, A-Z lower-cased; with fewer words the whole sequence is one, without words there is none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((_DIGEST(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n))


def sketch(hashes: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """m registers of a non-empty set: floor(1 - log_b of the least of its exponential variates), truncated to 0..LIMIT.

    The least variate is that of the greatest uniform one, so only maxima are kept; registers of a union are the maxima of registers.
    """
    a, b = _factors(m)
    values, top = (hashes >> np.uint64(32)).astype(np.uint32)[:, None], np.zeros(m, np.uint32)
    for at in range(0, len(hashes), 1024):  # bounded memory for very long texts
        np.maximum(top, (values[at : at + 1024] * a + b).max(axis=0), out=top)
    least = -np.log((top.astype(np.float64) + 0.5) * 2.0**-32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype("<u2")


def _above(x: np.ndarray) -> np.ndarray:
    """Probability that a register is above the other set's, for the share x of the union that only its own set has."""
    return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    p, q = _above(u - (1 - u) * j), _above(1 - u - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def similarity(more: np.ndarray, less: np.ndarray, same: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Estimates of Jaccard similarities by maximum likelihood, jointly from registers that are greater, less and equal, and from the sizes n and of of the sets."""
    u = n / (n + of)
    low, high = np.zeros(len(u)), np.minimum(n / of, of / n)
    for _ in range(40):  # the likelihood has one maximum
        third = (high - low) / 3
        left = _log_likelihood(low + third, more, less, same, u) < _log_likelihood(high - third, more, less, same, u)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def likely(more: np.ndarray, less: np.ndarray, same: np.ndarray, n: np.ndarray, of: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets may be as similar as the threshold: their sizes allow it, and their registers don't speak against it by MARGIN."""
    fits = np.minimum(n, of) >= threshold * np.maximum(n, of) - 1e-9
    best, u = similarity(more, less, same, n, of), n / (n + of)
    at = np.maximum(best, np.minimum(threshold, np.minimum(n / of, of / n)))
    return fits & (_log_likelihood(best, more, less, same, u) - _log_likelihood(at, more, less, same, u) <= MARGIN)


def _registers(column) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), "<u2") for x in column])


def _sketched(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                digests, counts, sketches = [], [], []
                for text in part.column(3).cast(pa.binary()):
                    raw = text.as_py()
                    found = shingles(raw, size)
                    digests.append(np.frombuffer(hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest(), "<i8"))
                    counts.append(len(found))
                    sketches.append(sketch(found, m).tobytes() if len(found) else b"")
                pair = np.array(digests)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "dk", "h", "d1", "d2", "n", "sketch"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("dk"), F.xxhash64(text).alias("h"), text.alias("text"))


def sketches(docs: DataFrame, size: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, dk, h, d1, d2, n, sketch): of each document a key and a hash of its text, a digest of its words, the size of its shingle set and its registers."""
    return _texts(docs).mapInArrow(_sketched(size, bands * rows), "doc_id long, dk long, h long, d1 long, d2 long, n long, sketch binary")


def _likely_pairs(threshold: float):
    """Pairs (a, b, n, sketch, of, other) whose sketches allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, other = _registers(batch.column(3)), _registers(batch.column(5))
                n, of = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 4))
                more, same = (own > other).sum(axis=1), (own == other).sum(axis=1)
                ok = pa.array(likely(more, own.shape[1] - more - same, same, n, of, threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _sets(size: int):
    """(node, set): the whole shingle set of a text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [shingles(x.as_py(), size).tobytes() for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "set"])

    return run


def _enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _alike(percent: int):
    """Pairs (a, b, set, other) whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([_enough(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def joining_pairs(sets: list[np.ndarray], roots: list[int], odd: list[bool], percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j), i odd, of sets that are alike enough and whose components nothing before has joined: at most one less than there are components.

    Sets that are alike share one of the rarest members of each, as many as may be missing and one more; so each set is
    only held against those it meets there. Nothing is left out: the frequencies only order the members.
    """
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.argsort(np.argsort(np.bincount(at, minlength=len(values)), kind="stable"), kind="stable")
    bounds, parent = np.cumsum([0, *map(len, sets)]), {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    heads: dict[int, list[int]] = {}
    prefixes = []
    for i, own in enumerate(sets):
        n = len(own)
        prefixes.append(np.sort(rank[at[bounds[i] : bounds[i + 1]]])[: n - -(-percent * n // 100) + 1].tolist())
        for x in prefixes[i]:
            heads.setdefault(x, []).append(i)
    out = []
    for i in (i for i, o in enumerate(odd) if o):
        tried = {i}
        for x in prefixes[i]:
            for j in heads[x]:
                if j not in tried and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                    tried.add(j)
                    if find(roots[i]) != find(roots[j]) and _enough(sets[i], sets[j], percent):
                        parent[find(roots[i])] = find(roots[j])
                        out.append((i, j))
    return out


def _compared(percent: int):
    """Of a block of a bucket: links between outliers and members of other components, as few as join these."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending"), ("odd", "descending")])
        node, root, odd = (group[c].to_pylist() for c in ("node", "root", "odd"))
        first = [i for i in range(len(node)) if not i or node[i] != node[i - 1]]  # an outlier may be on both sides
        sets = [np.frombuffer(group["set"][i].as_py(), np.uint64) for i in first]
        found = joining_pairs(sets, [root[i] for i in first], [odd[i] for i in first], percent)
        pairs = [(max(a, b), min(a, b)) for a, b in ((node[first[i]], node[first[j]]) for i, j in found)]
        return pa.table({c: pa.array([p[i] for p in pairs], pa.int64()) for i, c in enumerate("ab")})

    return run


def _leftover(members: DataFrame, roots: DataFrame, near: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links within a bucket, between members that no star has tried, that join components.

    Pairs of one component need no link, so only outliers, members beyond a bucket's main component, are held against the
    others. Both sides are dealt out in blocks of about so many shingles, so no task holds a bucket, and what comes out of
    a block joins what is in it: never more links than members.
    """
    placed = members.where("node <> rep").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")).join(near.select("node", "n"), "node")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by(F.struct("root", "n"), F.struct("c", "root")).alias("main"), F.sum("n").alias("k"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(block))).cast("long")
    mixed = apart(mixed.select("key", F.col("main.root").alias("main"), blocks(F.col("k")).alias("kbs"), blocks(F.col("k") - F.col("main.n")).alias("obs")), "key")
    rows = placed.join(mixed, "key")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = rows.select("key", "node", "root", spot("kbs").alias("kb"), every("obs").alias("ob"), F.lit(False).alias("odd"))
    odd = rows.where("root <> main").select("key", "node", "root", every("kbs").alias("kb"), spot("obs").alias("ob"), F.lit(True).alias("odd"))
    both = all_.unionByName(odd).join(sets, "node")
    return both.groupBy("key", "kb", "ob").applyInArrow(_compared(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept; documents whose shingle sets are `percent` similar or more are linked.

    Texts of equal words are one kind. Each kind has a SetSketch of bands * rows registers; kinds that share all registers
    of a band are a bucket. Every kind is first held against one bucket's first member, then against those of its other
    buckets that are still in another component; these candidates pass by the likelihood of their registers and are confirmed
    on whole sets. Members of a bucket that are in different components even then are compared block by block on whole sets,
    each only with those it shares a rare enough shingle with. So a group of near copies costs a few comparisons a member,
    and yet no pair of a bucket that could join components is left out.

    Null, empty and blank texts have no shingles and are linked with nothing. Long texts count whole. Rows that repeat are
    returned each. component_id is the smallest doc_id, null only where all ids of a component are; kept: doc_id is
    component_id, null being null. An empty table gives no rows; columns other than doc_id and text are ignored, whatever
    their names. Shingles count as equal if their 64-bit hashes are, words if 128 bits are.
    """
    threshold = percent / 100
    found = cut(sketches(docs, size, bands, rows))
    kinds = found.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min(F.struct("dk", "h")).alias("one"))
    kinds = cut(kinds.select("d1", "d2", "least", "n", "sketch", "one.*").withColumn("node", F.monotonically_increasing_id()))
    part = lambda i: F.xxhash64(F.lit(i), F.substring("sketch", 2 * rows * i + 1, 2 * rows))
    members = kinds.select("node", F.explode(F.array(*[part(i) for i in range(bands)])).alias("key"))
    buckets = apart(members.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("rep")).where("c > 1").select("key", "rep"), "key")
    members = cut(members.join(buckets, "key").select("key", "node", "rep"))
    near = cut(kinds.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch", "dk", "h"))
    texts = _texts(docs).select("dk", "h", "text").join(near.select("dk", "h", "node").hint("shuffle_hash"), ["dk", "h"]).select("node", "text")
    sets = cut(texts.mapInArrow(_sets(size), "node long, set binary").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda df, a, *cols: df.select(F.col("node").alias(a), *cols)
        own, other = side(near, "a", "n", "sketch"), side(near, "b", F.col("n").alias("of"), F.col("sketch").alias("other"))
        tried = pairs.join(own, "a").join(other, "b").where(F.least("n", "of") * 100 >= F.greatest("n", "of") * percent)
        passed = cut(tried.select("a", "b", "n", "sketch", "of", "other").mapInArrow(_likely_pairs(threshold), "a long, b long"))
        whole = passed.join(side(sets, "a", "set"), "a").join(side(sets, "b", F.col("set").alias("other")), "b")
        return cut(whole.select("a", "b", "set", "other").mapInArrow(_alike(percent), "a long, b long"))

    stars = cut(members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct())
    first = apart(stars.groupBy("a").agg(F.min("b").alias("b")), "a")
    links = confirmed(first)
    roots = connected_components(links)
    of = lambda a, r: roots.select(F.col("node").alias(a), F.col("root").alias(r))
    again = stars.join(first.withColumnRenamed("b", "tried"), "a").where("b <> tried").select("a", "b")
    again = again.join(of("a", "_a"), "a", "left").join(of("b", "_b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    for more in (lambda: confirmed(cut(again)), lambda: cut(_leftover(members, roots, near, sets, percent, block))):
        new = more()
        if new.head(1):
            links = links.unionByName(new)
            roots = connected_components(links)

    known = kinds.select("d1", "d2", "node", "least").join(roots, "node", "left").select("d1", "d2", "least", F.coalesce("root", "node").alias("root"))
    named = apart(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    known = apart(known.join(named, "root").select("d1", "d2", "component_id"), "d1", "d2")
    some = found.where("n > 0").select("doc_id", "d1", "d2", "n").join(known, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def minhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
