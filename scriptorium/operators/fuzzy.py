"""Approximate matches of a query at any place of a text: bit-parallel, over whole Arrow batches at once.

A text matches a piece of the query by the least number of edits (insertions, deletions, replacements) between the piece
and any part of the text. Myers' recurrence holds a column of that table in two words; here one step takes a character
of thousands of windows at once. Windows overlap by as much as a match can be long, so cutting texts into them changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the fields of a match, the share of edits up to which a piece matches, the length of a piece, the least score of a text that isn't the query itself, and the score of one that is.
WEIGHTS = {"title": 4.0, "titleZh": 3.0, "keywords": 2.0, "aliases": 2.0, "hookZh": 1.4, "abstract": 1.0, "tldr": 1.2}
THRESHOLD, PIECE, LEAST_SCORE, EQUAL_SCORE = 0.34, 32, 0.001, 2.220446049250313e-16
#: Characters that a window adds to its overlap, and windows that are stepped through together.
WINDOW, TOGETHER = 480, 8192


def pieces(query: str, size: int = PIECE) -> list[str]:
    """The query in pieces of `size` characters; the last one ends where the query does."""
    if len(query) <= size:
        return [query] if query else []
    out = [query[i : i + size] for i in range(0, len(query) - len(query) % size, size)]
    return out + [query[-size:]] if len(query) % size else out


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of texts end to end, and the places where texts begin and end."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b"".join(x.as_buffer().to_pybytes() for x in texts.cast(pa.large_binary())) if texts.offset or texts.null_count else _buffer(texts)
    codes = np.frombuffer(raw, np.uint8) if len(raw) == lengths.sum() else np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def _buffer(texts: pa.Array) -> bytes:
    _, offsets, data = texts.buffers()
    if data is None:
        return b""
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return data.to_pybytes()[ends[0] : ends[len(texts)]]


def least_edits(codes: np.ndarray, bounds: np.ndarray, piece: str) -> np.ndarray:
    """For each text between bounds the least edits between the piece, of up to 32 characters, and any part of the text."""
    m, best = len(piece), np.full(len(bounds) - 1, len(piece), np.int32)
    if not len(codes):
        return best
    masks = np.zeros(max(int(codes.max()), *map(ord, piece)) + 1, np.uint32)
    for i, c in enumerate(piece):
        masks[ord(c)] |= np.uint32(1 << i)
    over, sizes = 2 * m, np.diff(bounds)  # a part with fewer edits than the whole piece is shorter than this
    count = np.maximum(1, -(-(sizes - over) // WINDOW))
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[owner] + nth * WINDOW
    stop = np.minimum(start + WINDOW + over, bounds[owner + 1])
    order = np.argsort(stop - start, kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        np.minimum.at(best, owner[some], _stepped(codes, start[some], stop[some], masks, m))
    return best


def _stepped(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, masks: np.ndarray, m: int) -> np.ndarray:
    """Least edits in each window. Steps past a window's end match nothing there and can't lessen its least."""
    one, top = np.uint32(1), np.uint32(m - 1)
    up, down = np.full(len(start), (1 << m) - 1 if m < 32 else 0xFFFFFFFF, np.uint32), np.zeros(len(start), np.uint32)
    score = np.full(len(start), m, np.int32)
    least = score.copy()
    for step in range(int((stop - start).max())):
        place = start + step
        equal = np.where(place < stop, masks[codes[np.minimum(place, len(codes) - 1)]], 0).astype(np.uint32)
        right = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(across | up), up & across
        score += ((rise >> top) & one).astype(np.int32) - ((fall >> top) & one).astype(np.int32)
        np.minimum(least, score, out=least)
        rise, fall = rise << one, fall << one
        up, down = fall | ~(right | rise), rise & right
    return least


def scores(texts: pa.Array, query: str, threshold: float = THRESHOLD) -> np.ndarray:
    """Of each text 0 to 1, less being better, and nan where no piece matches: the mean over pieces of the share of edits, 1 for a piece that doesn't match."""
    codes, bounds = _code_points(texts)
    total, any_ = np.zeros(len(texts)), np.zeros(len(texts), bool)
    parts = pieces(query)
    for piece in parts:
        share = least_edits(codes, bounds, piece) / len(piece)
        hit = share <= threshold
        total += np.where(hit, np.maximum(share, LEAST_SCORE), 1.0)
        any_ |= hit
    total = np.where(any_, total / max(1, len(parts)), np.nan)
    return np.where(pc.equal(texts, query).to_numpy(zero_copy_only=False).astype(bool), EQUAL_SCORE, total)


def field_list(columns: dict[str, float], kinds: dict[str, str]) -> Column:
    """All values of the fields that aren't blank, lower-cased, each with its field's weight: what fuzzy_score() reads. Fields may be strings or arrays of strings."""
    item = lambda w: lambda x: F.struct(F.lit(w).alias("w"), F.lower(x).alias("x"))
    none = F.array().cast("array<struct<w:double,x:string>>")
    parts = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c)), item(float(w))) for c, w in columns.items() if c in kinds]
    return F.filter(F.concat(none, *parts), lambda f: F.trim(f["x"]) != "")


def fuzzy_score(fields: Column, query: str, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> Column:
    """0 to 1, more being better: what the product of all matching fields leaves to 1. Fields are those of field_list().

    A matching value counts by its score to the power of its share of all weights, over the root of its number of words
    (rounded to three places): short fields count more. No query or no match: 0.
    """
    asked, total = query.strip().lower(), sum((weights or WEIGHTS).values())

    def score(column: pa.Array) -> pa.Array:
        flat, rows = column.flatten(), np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        if not len(flat) or not asked:
            return pa.array(np.zeros(len(column)))
        texts = flat.field("x")
        words = np.maximum(1, pc.count_substring_regex(texts, "[^ ]+").to_numpy(zero_copy_only=False))
        share = flat.field("w").to_numpy(zero_copy_only=False) / total * np.floor(1000 / np.sqrt(words) + 0.5) / 1000
        found = scores(texts, asked, threshold)
        logs = np.where(np.isnan(found), 0.0, share * np.log(np.where(np.isnan(found), 1.0, found)))
        return pa.array(1 - np.exp(np.bincount(rows, weights=logs, minlength=len(column))))

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(fields)


def fuzzy_rows(papers: DataFrame, query: str, limit: int, columns: dict[str, float], pos: str = "pos", threshold: float = THRESHOLD) -> DataFrame:
    """Rows with a matching field by falling fuzzy score, then position. Null and blank fields never match."""
    scored = papers.withColumn("fuzzy", fuzzy_score(field_list(columns, dict(papers.dtypes)), query, columns, threshold))
    return scored.orderBy(F.desc("fuzzy"), pos).limit(max(1, limit)).where("fuzzy > 0")  # a filter on the score would be pushed to the scan and score each row twice
