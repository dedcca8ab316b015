"""Removal of repeated passages by enhanced suffix arrays over the places where repeats can be."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, cut

#: Bytes of the shortest repeat that is removed, and of the k-grams whose hashes choose anchors.
LENGTH, GRAM = 200, 32
#: A key that more than one in so many rows have is heavy: there are fewer such keys than that, whatever the table.
HEAVY = 1000
#: Bytes that are anchored at once; longer texts are taken in overlapping parts.
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C55 | 5)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4D)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, tuple] = {}


def _tables(n: int) -> tuple:
    """Powers of the two bases and their inverses modulo 2**64."""
    if n not in _TABLES:
        inverse = lambda b: np.uint64(pow(int(b), -1, 1 << 64))
        _TABLES.clear()
        _TABLES[n] = tuple(_powers(b, n) for b in (_BASE, inverse(_BASE), _BASE2, inverse(_BASE2)))
    return _TABLES[n]


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first start, last start, gram hash, span hash) of the runs of windows that share an anchor, for texts laid end to end.

    A window of `length` bytes is anchored at the leftmost of its grams with the least hash, so equal windows
    are anchored at the same offset. The span hash is of all bytes of the run's windows and of where the anchor is.
    Windows that cross the end of a text are left out.
    """
    n, wide = len(data), length - gram + 1
    power, back, power2, back2 = _tables(CHUNK + 4 * LENGTH)
    sums = np.zeros(n + 1, np.uint64)
    values = data.astype(np.uint64) + np.uint64(1)
    np.cumsum(values * power[:n], out=sums[1:])
    hashes = _mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    least = (hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:  # minima of 2, 4, 8 ... grams
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    m = n - length + 1
    least = np.minimum(least[:m], least[wide - span : wide - span + m])
    anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
    inside = np.zeros(m + 1, np.int64)
    inside[begins] += 1
    inside[np.minimum(ends - length + 1, m)] -= 1
    inside = np.cumsum(inside[:m]) > 0
    edge = np.ones(m, bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    edge[begins] = True
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [m]]) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    at = anchor[first]
    np.cumsum(values * power2[:n], out=sums[1:])
    whole = (sums[last + length] - sums[first]) * back2[first]
    return first, last, hashes[at], _mix(whole ^ _mix((at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))


def _anchor_batches(length: int, gram: int):
    """Rows (dk, h, first, more, gram, span) for every run of windows of every text; the last start is first + more."""

    def flush(group: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
        ends = np.cumsum([len(g[3]) for g in group])
        begins = ends - [len(g[3]) for g in group]
        first, last, grams, spans = anchors(data, begins, ends, length, gram)
        doc = np.searchsorted(ends, first, side="right")
        dk, h, shift = (np.array([g[i] for g in group], np.int64)[doc] for i in range(3))
        columns = [dk, h, first - begins[doc] + shift, (last - first).astype(np.int32), grams.view(np.int64), spans.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dk", "h", "first", "more", "gram", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for dk, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                raw = text.as_py()
                for at in range(0, len(raw) - length + 1, CHUNK - length + 1):
                    part = raw[at : at + CHUNK]
                    if size + len(part) > CHUNK:
                        yield flush(group)
                        group, size = [], 0
                    group.append((dk, h, at, part))
                    size += len(part)
        if group:
            yield flush(group)

    return run


def suffix_array(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the given suffixes, each up to its stop, sorted by at most `depth` bytes, and the common prefixes of neighbours.

    Ranks of 8, 16, 32 ... bytes are doubled; they also give the common prefixes. A byte past a stop sorts first.
    """
    n = len(data)
    padded = np.zeros(n + depth + 16, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)  # data holds 0 where a text ends
    padded[:n][data == 256] = 0
    words = np.zeros(n + depth + 8, np.uint64)
    for i in range(7):  # 7 symbols of 9 bits
        words = (words << np.uint64(9)) | padded[i : i + len(words)]
    _, rank = np.unique(words, return_inverse=True)
    ranks, spans = [rank.astype(np.uint64)], [7]
    while spans[-1] < depth:
        span, rank = spans[-1], ranks[-1]
        more = min(span, depth - span)
        second = np.zeros_like(rank)
        second[: len(rank) - more] = rank[more:]
        _, rank = np.unique(rank << np.uint64(32) | second, return_inverse=True)
        ranks.append(rank.astype(np.uint64))
        spans.append(span + more)
    order = starts[np.argsort(ranks[-1][starts], kind="stable")]
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for rank, span in zip(ranks[::-1], spans[::-1]):
        for _ in range(2):
            same = (rank[np.minimum(a + lcp, len(rank) - 1)] == rank[np.minimum(b + lcp, len(rank) - 1)]) & (lcp + span <= depth)
            lcp += same * span
    for _ in range(7):
        lcp += (padded[np.minimum(a + lcp, n + depth)] == padded[np.minimum(b + lcp, n + depth)]) & (padded[np.minimum(a + lcp, n + depth)] > 0) & (lcp < depth)
    return order, np.minimum(lcp, np.minimum(stops[np.searchsorted(starts, a)] - a, stops[np.searchsorted(starts, b)] - b))


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of each maximal repeat of `least` bytes or more: a scan with a stack over the interval tree.

    left: for each suffix in order, what stands to its left; negative values are all different (the begin of a
    text). An interval is a repeat that can't be extended to the right; it is maximal if its members' left
    sides differ. Runs of suffixes whose common prefixes stay at `least` or more are scanned one by one,
    and those whose left sides are all the same are passed over whole, as nothing within them can differ.
    """
    n = len(order)
    if n < 2:
        return
    joined = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        own = left[lo : hi + 1]
        if own[0] >= 0 and (own == own[0]).all():
            continue
        changes = np.concatenate([[0], np.cumsum((own[1:] != own[:-1]) | (own[1:] < 0))])
        stack: list[tuple[int, int]] = []  # (common prefix, left bound)
        for i, height in enumerate([*lcp[lo:hi].tolist(), 0], 1):
            begin = i - 1
            while stack and stack[-1][0] > height:
                size, begin = stack.pop()
                if changes[i - 1] > changes[begin]:
                    yield size, order[lo + begin : lo + i]
            if height >= least and (not stack or stack[-1][0] < height):
                stack.append((height, begin))


def groups_in(spans: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, occurrences as (index, start)) of each maximal repeat among the windows of spans (first start, last start, bytes)."""
    pieces, starts, stops, place, at = [], [], [], [], 0
    for i, (first, last, raw) in enumerate(spans):
        pieces.append(np.frombuffer(raw, np.uint8).astype(np.uint16))
        pieces.append(np.array([256], np.uint16))
        own = np.arange(at, at + last - first + 1)
        starts.append(own)
        stops.append(np.full(len(own), at + len(raw)))
        place.append((at, i, first))
        at += len(raw) + 1
    data, starts, stops = np.concatenate(pieces), np.concatenate(starts), np.concatenate(stops)
    deepest = int((stops - starts).max())
    order, lcp = suffix_array(data, starts, stops, deepest)
    begins = np.array([p[0] for p in place])
    owner = np.searchsorted(begins, order, side="right") - 1
    left = np.where(order == begins[owner], -1 - order, data[np.maximum(order - 1, 0)].astype(np.int64))
    for size, members in maximal_repeats(order, lcp, left, length):
        who = np.searchsorted(begins, members, side="right") - 1
        yield size, [(place[w][1], place[w][2] + s - place[w][0]) for w, s in zip(who.tolist(), members.tolist())]


def repeats_in(spans: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(index, start, stop) of the occurrences of maximal repeats among the windows of spans."""
    return [(i, start, start + size) for size, found in groups_in(spans, length) for i, start in found]


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of (start, stop) rows: sorted and apart."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > top[:-1]]))
    return np.column_stack([spans[new, 0], top[np.concatenate([new[1:] - 1, [len(spans) - 1]])]])


_COVER = "dk long, h long, start long, stop long"


def _cut_out(length: int):
    """The bytes of the wanted spans of each text, once for rows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for dk, h, text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()), batch.column(4)):
                if (dk, h) in seen:
                    continue
                seen.add((dk, h))
                raw, want = text.as_py(), want.as_py()
                rows += [(w["gram"], dk, h, w["first"], w["more"], raw[w["first"] : w["first"] + w["more"] + length]) for w in want]
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["gram", "dk", "h", "first", "more", "raw"])


def _scan(length: int, most: int):
    """Maximal repeats among spans that come sorted by gram: arrays of whole groups, of about `most` bytes or one group."""

    def found(group: list[tuple]) -> pa.RecordBatch:
        rows = repeats_in([(first, first + more, raw) for _, _, _, first, more, raw in group], length)
        if len(rows):
            who = np.array([r[0] for r in rows])
            spans = np.array(rows, np.int64)[:, 1:]
            parts = [(i, merge(spans[who == i])) for i in np.unique(who).tolist()] if len(rows) < 64 else _merged(who, spans)
            rows = [(group[i][1], group[i][2], a, b) for i, part in parts for a, b in part.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["dk", "h", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:4] == group[-1][:4]:  # a row that repeats, cut out by another task
                    continue
                if size >= most and row[0] != group[-1][0]:
                    yield found(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
        if group:
            yield found(group)

    return run


def _merged(who: np.ndarray, spans: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(who, kind="stable")
    who, spans = who[order], spans[order]
    cuts = np.flatnonzero(np.diff(who)) + 1
    return [(int(w[0]), merge(s)) for w, s in zip(np.split(who, cuts), np.split(spans, cuts))]


def _windows(length: int):
    """(window digest, dk, h, start) of every window of spans: the exact way for groups that are too large for one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, dk, h, first, more, raw in zip(*(c.to_pylist() for c in batch.columns)):
                digests = [hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(more + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([dk] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())], ["digest", "dk", "h", "start"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for text, spans in zip(part.column(3).cast(pa.binary()), part.column(4).to_pylist()):
                raw = text.as_py()
                runs = merge(np.array([(s["start"], s["stop"]) for s in spans], np.int64)).tolist() if spans else []
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw
                rows.append((len(raw), len(raw) - len(kept), len(runs), kept))
            n, gone, count, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _spans_and_kinds(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Texts by key (dk, h); spans of grams that stand more than once; kinds of spans (gram, span) with their number n and one of each; and the number of spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("dk"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.select("doc_id", "dk", "h", "text")
    spans = cut(rows.select("dk", "h", "text").mapInArrow(_anchor_batches(length, gram), "dk long, h long, first long, more int, gram long, span long"))
    again = apart(spans.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "gram")
    spans = cut(spans.join(again, "gram", "left_semi"))
    kinds = spans.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("dk", "h", "first", "more")).alias("one"))
    kinds = cut(kinds.select("gram", "span", "n", "one.*"))
    return rows, spans, kinds, kinds.agg(F.sum("n").alias("n")).first()["n"] or 0


def _those_of(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose keys counted (keys, n) has. Heavy keys are fewer than HEAVY and so are broadcast; their rows stay where they are, and no other key is much of a task's work."""
    heavy = F.broadcast(counted.where(F.col("n") > F.lit(max(1, total // HEAVY))).select(*keys))
    light = counted.where(F.col("n") <= F.lit(max(1, total // HEAVY))).select(*keys)
    return rows.join(heavy, keys, "left_semi").unionByName(rows.join(heavy, keys, "left_anti").join(light, keys, "left_semi"))


def _cut_from(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """(gram, dk, h, first, more, raw): the bytes of the one span that stands for each kind."""
    want = kinds.groupBy("dk", "h").agg(F.collect_list(F.struct("gram", "first", "more")).alias("want"))
    return rows.join(want.hint("shuffle_hash"), ["dk", "h"]).select("doc_id", "dk", "h", "text", "want").mapInArrow(_cut_out(length), "gram long, dk long, h long, first long, more int, raw binary")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats of `length` bytes or more with all their occurrences: (gram, number, size, doc_id, start), a row for each occurrence.

    (gram, number) names a group. Groups are found among the windows of one anchor: a span that only stands as it is, is a
    group; where spans of an anchor differ, the interval tree gives the groups, and each occurrence in one span stands for
    all equal spans. A repeat that is longer than an anchor's reach comes out in parts, one for each of its anchors. The spans
    of an anchor that differ are one task's work; remove_repeats(), which needs no groups, has another way for the largest.

    Null text: empty. Rows that repeat are occurrences each. An empty table gives no rows. Spans count as equal if 64 bits of
    their hash and those of their anchor do.
    """
    rows, spans, kinds, _ = _spans_and_kinds(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []

        def found() -> pa.RecordBatch:
            out = [(own[0][0], number, size, own[i][1], own[i][2], own[i][3], start - own[i][3]) for number, (size, members) in enumerate(groups_in([(r[3], r[3] + r[4], r[5]) for r in own], length)) for i, start in members]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], ["gram", "number", "size", "dk", "h", "first", "offset"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own and row[0] != own[0][0]:
                    yield found()
                    own = []
                if not own or row[:4] != own[-1][:4]:
                    own.append(row)
        if own:
            yield found()

    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    mixed = kinds.join(several.where("kinds > 1").select("gram"), "gram")
    groups = _cut_from(rows, mixed, length).repartition("gram").sortWithinPartitions("gram", "dk", "h", "first").mapInArrow(run, "gram long, number int, size int, dk long, h long, first long, offset long")
    groups = groups.join(kinds.select("gram", "span", "dk", "h", "first"), ["gram", "dk", "h", "first"]).select("gram", "span", "number", "size", "offset")
    plain = kinds.join(several.where("kinds = 1").select("gram"), "gram").where("n > 1").select("gram", "span", F.lit(0).alias("number"), (F.col("more") + length).alias("size"), F.lit(0).cast("long").alias("offset"))
    places = groups.unionByName(plain).join(spans, ["gram", "span"])
    ids = F.when(F.col("dk") != -1, F.col("dk"))
    return places.select("gram", "number", "size", ids.alias("doc_id"), (F.col("first") + F.col("offset")).alias("start"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 400_000, group: int = 8192) -> DataFrame:
    """One row per document: its UTF-8 bytes without those that strings of `length` bytes cover which also start elsewhere.

    Every window of `length` bytes has an anchor, its gram of least hash, so equal windows meet under one gram.
    Neighbouring windows with one anchor are a span. Spans that are equal in whole are repeats as they stand
    and are only counted. Where spans of one gram differ, one of each kind is cut out of its text and their
    windows go into an enhanced suffix array, whose interval tree gives the maximal repeats with all
    occurrences. Grams with over `group` kinds of spans have their single windows counted instead.

    Null text: empty. A text shorter than `length` keeps all. Rows that repeat are occurrences of their own; their covers
    are told once, however many they are. An empty table gives no rows; columns other than doc_id and text are ignored, whatever their names. Long texts are
    anchored in overlapping parts. Spans count as equal if 64 bits of their hash and those of their anchor's do. Columns:
    doc_id, n_bytes, n_removed, n_spans, kept (binary: without repeats a text needn't be UTF-8).
    """
    rows, spans, kinds, total = _spans_and_kinds(docs, length, gram)
    equal = _those_of(spans, kinds.where("n > 1"), ["gram", "span"], total).select("dk", "h", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("stop"))
    mixed = cut(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))

    def cut_out(grams: DataFrame) -> DataFrame:
        return _cut_from(rows, kinds.join(grams.select("gram"), "gram"), length)

    covers = equal.unionByName(cut_out(mixed.where(F.col("kinds") <= group)).repartition("gram").sortWithinPartitions("gram", "dk", "h", "first").mapInArrow(_scan(length, most), _COVER))
    if mixed.where(F.col("kinds") > group).head(1):
        windows = cut(cut_out(mixed.where(F.col("kinds") > group)).mapInArrow(_windows(length), "digest binary, dk long, h long, start long"))
        twice = cut(windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
        covers = covers.unionByName(_those_of(windows, twice, ["digest"], windows.count()).select("dk", "h", "start", (F.col("start") + length).alias("stop")))
    covers = covers.distinct().groupBy("dk", "h").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    out = rows.join(covers.hint("shuffle_hash"), ["dk", "h"], "left").select("doc_id", "dk", "h", "text", "gone")
    return out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """The digest columns of remove_repeats()."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
