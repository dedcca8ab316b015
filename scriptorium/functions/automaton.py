"""Many terms looked for at once: one automaton over all of them, so that the time of a text doesn't grow with their number."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=8)
def _built(terms: tuple[str, ...]):
    """A worker builds the automaton of a dictionary once."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term and term not in out:
            out.add_word(term, i)
    out.make_automaton()
    return out


def contained_many(text: Column, terms: list[str]) -> Column:
    """functions.text.contained() for dictionaries of any size: those terms, in their order, that a text contains.

    An empty term is in every text but null, which has none; a term that is listed twice is found twice. text: a column, not
    the variable of a lambda, as no Python function can stand in one.
    """
    known = tuple(terms)
    places: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        places.setdefault(t, []).append(i)
    plain, always = max(map(len, places.values()), default=1) == 1, places.get("", [])

    def run(texts: pa.Array) -> pa.Array:
        automaton, rows, sizes = _built(known), [], []
        for x in texts.to_pylist():
            found = {i for _, i in automaton.iter(x)} if x and len(automaton) else set()
            if x is not None:
                found = found.union(always) if plain else {j for i in found for j in places[known[i]]}.union(always)
            rows += sorted(found)
            sizes.append(len(found))
        values = pa.array(known, pa.string()).take(pa.array(rows, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(text)
