"""Best-fit packing of tokenised documents by a configuration linear program."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

CAPACITY, END = 1024, 2
#: Pieces of one length that one task ranks, about.
BUCKET_ROWS = 20_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Characters on whose classes the rank file's pattern and the tokenizer's agree (tests compare them); other texts go to the tokenizer itself.
_COMMON = re.compile("[^\x00-ɏ‐-‧€]")
_LONG_RUN = re.compile(r"[^\s]{2000}|\s{2000}")
_TOKENIZERS: dict[str, object] = {}
_RANKS: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizers file, loaded where a text needs it."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _ranks(path: str):
    """An encoder with the same merges from the rank file beside a tokenizers file; None if there is no such file."""
    if path not in _RANKS:
        ranks, _RANKS[path] = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                _RANKS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    return _RANKS[path]


def _encoder(path: str):
    """texts to lists of ids, those of the tokenizers file."""

    def encode(text: str) -> list[int]:
        # a run of more than a few thousand letters would take the rank encoder quadratic time
        if "<|endoftext|>" in text or _COMMON.search(text) or _LONG_RUN.search(text) or (fast := _ranks(path)) is None:
            return _tokenizer(path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of capacity but the first, which may be shorter."""
    n = len(ids)
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(docs), 512):
                rows = []
                for doc, text in zip(docs[lo : lo + 512], texts.slice(lo, 512).to_pylist()):
                    ids = np.array(encode(text or "") + [end], dtype="<u4")
                    rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(pieces_of(ids, capacity))]
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenise(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32. Null text is an empty one: its piece is the end id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenise(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last) for each room from 0 to capacity: the value of the best pattern that fits and its last length, 0 where a smaller room does as well. prices: of lengths 1 to capacity, used any number of times."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = prices[::-1]  # back[i] is the price of length capacity - i
    for c in range(1, capacity + 1):
        values = best[:c] + back[capacity - c :]  # length c - j beside what fits in j
        j = int(values.argmax())
        best[c], last[c] = (values[j], c - j) if values[j] > best[c - 1] else (best[c - 1], 0)
    return best, last


def pattern_in(last: np.ndarray, room: int) -> Counter:
    """The pattern that knapsack() found for a room: length to count."""
    found: Counter = Counter()
    while room > 0:
        if last[room]:
            found[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return found


def relax(need: np.ndarray, capacity: int, accuracy: float, rate: float, power: float) -> dict[tuple, float]:
    """Patterns and fractional amounts that cover the need of each length in full: the configuration program by multiplicative weights.

    A length's weight falls by the exponential of the part of it that is covered; its price is its weight times its length
    to a power over 1, so that long pieces, which few others fit beside, come before the short ones that fill any gap.
    Each round prices patterns by one knapsack. It tells the best pattern with each length in it; those within `accuracy`
    of the best of all are added, as far as one of their lengths is covered. So no more patterns are made than there are lengths.
    """
    base = (np.arange(capacity + 1) / capacity) ** power
    covered, amount = np.zeros(capacity + 1), {}
    while True:
        part = np.divide(covered, need, out=np.ones(capacity + 1), where=need > 0)
        short = part < 1 - 1e-9
        if not short.any():
            return amount
        low = part[short].min()
        prices = np.where(short, np.exp(-rate * (part - low)) * base, -1.0)[1:]
        best, last = knapsack(prices, capacity)
        with_each = prices + best[capacity - 1 :: -1]
        for i in np.argsort(-with_each, kind="stable").tolist():
            if with_each[i] < (1 - accuracy) * best[capacity]:
                break
            pattern = pattern_in(last, capacity - i - 1) + Counter([i + 1])
            if any(covered[k] >= need[k] * (1 - 1e-9) for k in pattern):
                continue
            if sum(c * base[k] * np.exp(-rate * (covered[k] / need[k] - low)) for k, c in pattern.items()) < (1 - accuracy) * best[capacity]:
                continue  # at the weights as they stand by now
            most = min((need[k] - covered[k]) / c for k, c in pattern.items())
            key = tuple(sorted(pattern.items()))
            amount[key] = amount.get(key, 0.0) + most
            for k, c in key:
                covered[k] += c * most


def solve_configurations(stock: dict[int, int], capacity: int = CAPACITY, accuracy: float = 0.002, rate: float = 0.2, power: float = 1.1) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to count) and how often to use each, which together hold the stock exactly.

    The configuration program is solved to full coverage (relax) and its amounts are rounded down; only what the rounding
    leaves is packed by best fit over the histogram. Work depends on the capacity, not on the number of pieces.
    """
    full = stock.get(capacity, 0)
    need = np.zeros(capacity + 1)
    for length, count in stock.items():
        need[length] = count if length < capacity else 0
    used: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    left = need.astype(np.int64)
    for key, x in relax(need, capacity, accuracy, rate, power).items():
        times = int(min(x + 1e-6, *(left[k] // c for k, c in key)))
        if times:
            used.append((dict(key), times))
            for k, c in key:
                left[k] -= c * times
    used += best_fit({k: int(left[k]) for k in range(1, capacity) if left[k]}, capacity)
    held: Counter = Counter()
    for pattern, times in used:
        for k, c in pattern.items():
            held[k] += c * times
    if held != Counter(stock):
        raise AssertionError("the patterns don't hold the stock")
    return used


def best_fit(stock: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: each length, longest first, goes where least room is left. Equal bins are one entry."""
    bins: dict[int, dict[tuple, int]] = {}  # room to {pattern: bins}
    for length in sorted(stock, reverse=True):
        count = stock[length]
        while count:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                whole, rest = divmod(count, each)
                for k, times in ((each, whole), (rest, 1)):
                    if k and times:
                        group = bins.setdefault(capacity - k * length, {})
                        group[((length, k),)] = group.get(((length, k),), 0) + times
                break
            group = bins[room]
            pattern, have = next(iter(group.items()))
            each = min(room // length, -(-count // have))
            take = min(have, count // each)
            group.pop(pattern)
            if have > take:
                group[pattern] = have - take
            if not group:
                del bins[room]
            grown = bins.setdefault(room - each * length, {})
            if pattern[-1][0] == length:  # lengths only fall, so a repeated one is the last
                added = (*pattern[:-1], (length, pattern[-1][1] + each))
            else:
                added = (*pattern, (length, each))
            grown[added] = grown.get(added, 0) + take
            count -= take * each
    return [(dict(p), times) for group in bins.values() for p, times in group.items()]


def _places(used: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset) by length and rank."""
    rank: Counter = Counter()
    rows, base = [], 0
    for pattern, times in used:
        at = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, rank[length], copies, base, at))
            rank[length] += copies * times
            at += copies * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    The pieces' length histogram (at most `capacity` rows) goes to the driver, which solves the
    configuration program and gives each range of ranks of a length its sequences. Ranks within a length
    are counted in hashed buckets, as many as the most common length fills, so that it is many tasks' work.

    Null and empty texts: one piece, the end id. Long texts are cut into pieces, never shortened. Rows that repeat are
    packed each; ties within a length go by id, piece and digest. An empty table gives no rows. Columns other than doc_id
    and text are ignored, whatever their names.
    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    rows = cut(tokenise(docs, tokenizer, capacity, end).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")))
    stock = {x["length"]: x["n"] for x in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(solve_configurations(stock, capacity))
    rows = rows.withColumn("b", F.pmod("h", F.lit(max(64, -(-max(stock.values(), default=0) // BUCKET_ROWS)))).cast("int")).drop("h")
    counts = rows.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = counts.select("length", "b", (F.sum("n").over(Window.partitionBy("length").orderBy("b")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("local", local).join(before, ["length", "b"]).withColumn("rank", (F.col("before") + F.col("local")).cast("long"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    bits = 2**44  # ranks below this, lengths above: one sorted key to search

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] * bits + places[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = places[np.searchsorted(keys, length * bits + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
