"""Language identification by nearest clustered centroids of TF-IDF character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Width of the hashed n-gram vectors.
WIDTH = 4096
#: About as many labelled rows of each language are learned from, chosen by hash: the bound of the training sample.
SAMPLE = 400
#: Centroids a language has.
CENTROIDS = 4
#: A text is rejected below a share of a quantile of the cosines that sampled texts, cut to about as many letters, have with their nearest centroids: (quantile, share).
REJECT = (0.01, 0.6)
#: Classes of letter counts by powers of two; the last one holds all longer texts.
CLASSES = 12
UNKNOWN = "und"
#: Code point to class: letters keep their lower-case form, the rest is one mark.
_FOLD = np.array([ord(c) if (c := chr(i).lower()[:1]).isalpha() else 32 for i in range(0x3000)], np.uint32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray  # by class of letter counts


def counts(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of the 1 to 3-grams of letters and word edges of whole texts, (texts, width), and their numbers of letters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    flat = np.frombuffer(("  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(flat < 0x3000, _FOLD[np.minimum(flat, 0x2FFF)], flat).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    edge = code == 32
    letters = np.bincount(text[~edge], minlength=len(texts))
    row = text * width
    out = np.zeros(len(texts) * width)
    gram = code
    for n in range(1, 4):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        h = gram * np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> np.uint64(64 - 12) if width == 4096 else h % np.uint64(width)).astype(np.int64)
        # grams of marks only and those that cross a word's inner edge say nothing
        ok = ~edge[: len(gram)] if n == 1 else ~(edge[: len(gram)] & edge[1 : len(gram) + 1])
        if n == 3:
            ok &= ~edge[1 : len(gram) + 1]
        out += np.bincount(row[: len(gram)][ok] + slot[ok], minlength=out.size)
    return out.reshape(len(texts), width), letters


def size_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), CLASSES - 1)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(count: np.ndarray, langs: list[str], centroids: int = CENTROIDS, rounds: int = 12) -> Model:
    """Spherical k-means within each language over rows of counts(); a model without floors, which rejects nothing."""
    order = sorted(range(len(langs)), key=lambda i: (langs[i], count[i].tobytes()))
    langs, count = [langs[i] for i in order], count[order]
    idf = (np.log((1 + len(langs)) / (1 + (count > 0).sum(axis=0))) + 1).astype(np.float32)
    x, found, owner = vectors(count.astype(np.float32), idf), [], []
    names = sorted(set(langs))
    for j, name in enumerate(names):
        own = x[np.array([a == name for a in langs])]
        k = min(centroids, len(own))
        centre = own[[0]]
        for _ in range(1, k):  # the farthest point next
            centre = np.vstack([centre, own[[(own @ centre.T).max(axis=1).argmin()]]])
        for _ in range(rounds):
            near = (own @ centre.T).argmax(axis=1)
            centre = np.vstack([own[near == c].mean(axis=0) if (near == c).any() else centre[c] for c in range(k)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        found.append(centre)
        owner += [j] * k
    return Model(names, idf, np.vstack(found) if found else np.zeros((0, count.shape[1])), np.array(owner, np.int64), np.zeros(CLASSES))


def beginnings(text: str) -> list[str]:
    """A text cut to about 1, 2, 4 ... letters, as far as it has so many, and the whole."""
    places = np.flatnonzero(np.fromiter(map(str.isalpha, text), bool, len(text))) + 1
    return [text[: places[n - 1]] for n in (1 << j for j in range(CLASSES)) if n <= len(places)] + [text]


def nearest(model: Model, texts: list[str]) -> list[tuple[int, float]]:
    """(class of letter counts, cosine with the nearest centroid) of the beginnings of texts and the whole."""
    out = []
    for text in texts:
        count, letters = counts(beginnings(text), len(model.idf))
        out += zip(size_class(letters).tolist(), (vectors(count, model.idf) @ model.centroids.T).max(axis=1).tolist())
    return out


def with_floors(model: Model, low: dict[int, float], share: float = REJECT[1]) -> Model:
    """The model with its floors: a share of each class's low cosine; a class that no text is in has the floor of the next smaller one."""
    at = 0.0
    for c in range(CLASSES):
        at = model.floors[c] = share * low[c] if c in low else at
    return model


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text; `und`, 0 and rejected for null, for no letter and without a model."""
    full = [t if t is not None and any(map(str.isalpha, t)) else None for t in texts]
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    use = [i for i, t in enumerate(full) if t is not None]
    if not model.languages or not use:
        return out
    count, letters = counts([full[i] for i in use], len(model.idf))
    cosine = vectors(count, model.idf) @ model.centroids.T
    best = cosine.argmax(axis=1)
    for i, row, b, floor in zip(use, cosine, best, model.floors[size_class(letters)]):
        score = float(min(1.0, max(0.0, row[b])))
        out[i] = (model.languages[model.owner[b]], score, bool(score < floor))
    return out


def _groups(texts: pa.Array, most: int = 250_000) -> Iterator[list[str | None]]:
    """Runs of up to 64 texts of bounded length together, or one longer text."""
    group: list[str | None] = []
    size = 0
    for x in texts:
        text = x.as_py()
        if group and (len(group) == 64 or size + len(text or "") > most):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for group in _groups(batch.column(0)) for r in predict(model, group)]
            name, score, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def held_out(key):
    """crc32 of the key as text, modulo 5, is 0; a null key counts as an empty text and so is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): the counts that aren't 0 of each text, as bytes."""
    for batch in batches:
        langs, at = batch.column(1), 0
        for group in _groups(batch.column(0)):
            count, _ = counts(group)
            rows = [np.flatnonzero(x) for x in count]
            yield pa.RecordBatch.from_arrays([langs.slice(at, len(group)), pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([x[r].astype("<f4").tobytes() for x, r in zip(count, rows)], pa.binary())], ["lang", "slot", "n"])
            at += len(group)


def _nearest_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cosine = zip(*nearest(model, batch.column(0).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(cosine, pa.float64())], ["class", "cosine"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model of the labelled documents that aren't held out.

    Counts over all documents with a letter give each language's sampling rate, at which about `sample` of its documents
    are chosen by a hash of text and doc_id; a language with no more is used whole. Their n-gram counts, at most WIDTH
    numbers each, come to the driver, never the texts; floors are found where the texts are. So what is gathered is
    bounded by WIDTH times `sample` times the number of languages. No labelled documents: a model that rejects all.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id") & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    total = {x["lang"]: x["n"] for x in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return fit(np.zeros((0, WIDTH)), [])
    rate = F.create_map(*[F.lit(y) for k, n in sorted(total.items()) for y in (k, sample / n)])
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(2**31)) / float(2**31)
    chosen = cut(usable.where(draw < F.element_at(rate, F.col("lang"))).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    chosen = chosen.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a few files would be few tasks
    rows = chosen.mapInArrow(_count_batches, "lang string, slot binary, n binary").collect()
    count = np.zeros((len(rows), WIDTH), np.float32)
    for x, r in zip(count, rows):
        x[np.frombuffer(r["slot"], "<i4")] = np.frombuffer(r["n"], "<f4")
    model = fit(count, [r["lang"] for r in rows], centroids)
    low = chosen.select("text").mapInArrow(_nearest_batches(model), "class int, cosine double").groupBy("class").agg(F.percentile("cosine", F.lit(REJECT[0])).alias("low")).collect()
    return with_floors(model, {x["class"]: x["low"] for x in low})


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred, score and rejected; predictions see the text only.

    Null text or one without a letter: `und`, 0, rejected. A text whose best cosine is below the model's floor for so many
    letters keeps its nearest language and is marked rejected. Long texts count whole. Of equally near centroids the first
    counts. Rows that repeat are predicted each; an empty table gives no rows. Columns of docs named like the results are replaced.
    """
    model = model or train(docs)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*keep).alias("_row"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    shape = T.StructType([*rows.schema.fields, *added])
    return rows.mapInArrow(_predictor(model), shape).select("_row.*", "lang_pred", "score", "rejected")


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
