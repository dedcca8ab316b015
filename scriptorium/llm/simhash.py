"""SimHash fingerprints and their components by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut
from ..operators.graph import connected_components

#: Members of a table bucket up to which a probe fetches them all; the members of larger ones are linked by their whole Hamming balls.
BUCKET = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the SimHash as a signed long; columns of longs named in `carry` come along. Null and empty texts have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return rows.mapInArrow(_fingerprints, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in carry]]))


def _segments(fp: str):
    """The two 32-bit segments of a fingerprint."""
    return [F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))]


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all those at 2 or fewer differing bits.

    Of two such fingerprints, one 32-bit segment differs in at most one bit. So each fingerprint stands
    in a table under both segments and probes each table with its segment and every segment that has one
    more bit set; complete distances are then verified. A bucket of more than `bucket` members is not
    paired off: for its members and those who probe it, the ball is enumerated over the whole
    fingerprint. Balls of radius 1 meet exactly if the distance is at most 2, so stars around the points
    where they meet join the same components, with 65 rows a fingerprint at any size of the bucket.
    """
    seg = lambda i: _segments("fp")[i]
    number = lambda i: F.lit(i).cast("long").alias("s")
    entry = F.explode(F.array(*[F.struct(number(i), seg(i).alias("k")) for i in (0, 1)])).alias("e")
    table = prints.select("fp", entry).select("fp", "e.s", "e.k")
    bits = F.sequence(F.lit(0), F.lit(31))
    ball = lambda x: F.concat(F.array(x), F.filter(F.transform(bits, lambda b: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))), lambda y: y != x))
    keyed = lambda i: F.transform(ball(seg(i)), lambda k: F.struct(number(i), k.alias("k")))
    probe = F.explode(F.concat(keyed(0), keyed(1))).alias("e")
    probes = prints.select(F.col("fp").alias("a"), probe).select("a", "e.s", "e.k")
    large = apart(table.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("s", "k"), "s", "k")
    small = table.join(large, ["s", "k"], "left_anti")
    differ = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    pairs = probes.join(small, ["s", "k"]).where((F.col("a") != F.col("fp")) & (differ("a", "fp") <= 2)).select("a", F.col("fp").alias("b"))
    whole = probes.join(large, ["s", "k"], "left_semi").select("a").distinct()  # members probe their own bucket
    flips = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda b: F.when(b < 0, F.col("a")).otherwise(F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("point")
    points = whole.select("a", flips)
    centre = apart(points.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b < top").select("point", "b"), "point")
    stars = points.join(centre, "point").where((F.col("a") != F.col("b")) & (differ("a", "b") <= 2)).select("a", "b")
    return pairs.unionByName(stars)


def _components(rows: DataFrame, bucket: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of rows (doc_id, fp): root is the least fingerprint of a component, its name whatever ids its rows have."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(prints.select("fp"), bucket)
    roots = connected_components(links).withColumnsRenamed({"node": "fp"})
    known = prints.join(roots, "fp", "left")
    named = known.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = known.where(F.col("root").isNotNull()).join(named, "root").select("fp", "root", "component_id")
    alone = known.where(F.col("root").isNull()).select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest doc_id that links reach.

    Texts without words, null ones too, share fingerprint 0 and link like any other. Long texts count whole. Equal texts
    are one fingerprint, so copies are never paired. Rows that repeat are returned each; a null doc_id never names a
    component unless no other does (then component_id is null). An empty table gives no rows; columns other than
    doc_id and text are ignored, whatever their names.
    """
    rows = cut(fingerprints(docs))
    return rows.join(_components(rows, bucket), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, key, n): of each component of near-duplicates the row of least doc_id, nulls last, and least key (a long), and how often the two are there.

    Components are told apart by fingerprints, so rows that share an id or have none stand for themselves.
    """
    rows = cut(fingerprints(docs, (key,)))
    counted = rows.groupBy("fp", "doc_id", key).agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", key, "n")
    each = counted.groupBy("fp").agg(F.min(first).alias("r"))  # one row a fingerprint before it meets its component
    least = each.join(_components(rows, bucket), "fp").groupBy("root").agg(F.min("r").alias("r"))
    return least.select("r.doc_id", f"r.{key}", "r.n")


def simhash_report(docs: DataFrame) -> DataFrame:
    """near_duplicates() with the fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
