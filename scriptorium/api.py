"""Search as an application calls it: health, hybrid search, facets, pages, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.catalog import facet_filter, paginate
from .operators.hybrid import fuse, fuse_all, fused_order
from .operators.search import Query, acronym_expand, acronym_index, expand, lexical_hits, lexical_search, prepare
from .operators.vectors import adaptive_k, brainstorm_k, check_shape, top_k


@dataclass
class Catalogue:
    """papers: id, pos, title, venue, year, primaryCategory, keywords, categories, abstract; vectors: id, embedding. Cached while it is open."""

    papers: DataFrame
    vectors: DataFrame
    dimensions: int
    model: str = "vectors"

    def __post_init__(self):
        self.prepared = prepare(self.papers, "title", keywords="keywords", blob=["venue", "abstract"], categories="categories").cache()
        self.acronyms = acronym_index(self.papers).cache()
        self.rows = self.papers.count()

    def close(self) -> None:
        self.prepared.unpersist()
        self.acronyms.unpersist()

    def health(self) -> dict:
        shape = check_shape(self.vectors, self.dimensions).first()
        return {"ok": shape["wrong_size"] == 0 and shape["not_finite"] == 0, "papers": self.rows, "vectors": shape["rows"], "model": self.model}

    def query(self, text: str) -> Query:
        out = expand(text)
        out.acronyms = [(r["acronym"], r["phrase"]) for r in acronym_expand(self.acronyms, text).orderBy("acronym", "rank").collect()]  # at most 8 for each token
        return out

    def lexical(self, text: str, limit: int) -> DataFrame:
        return lexical_search(self.prepared, self.query(text), limit)

    def semantic(self, vector, limit: int) -> DataFrame:
        return top_k(self.vectors, vector, limit)

    def search(self, text: str, vector=None, cap: int = 50, venue_years: list[str] = (), categories: list[str] = (), page: int = 1, per_page: int = 10) -> DataFrame:  # type: ignore[assignment]
        """A page of hits. Filters are applied to all hits and the cap follows them; without a vector the order is lexical."""
        if not text.strip():
            ranked, order = self.papers, [F.col("pos")]
        elif vector is None:
            ranked, order = lexical_hits(self.prepared, self.query(text)), [F.desc("score"), F.col("pos")]
        else:
            hits = fuse_all(self.semantic(vector, adaptive_k(cap, self.rows)), lexical_hits(self.prepared, self.query(text)), self.papers, self.model)
            ranked, order = hits.drop("pos").join(self.papers, "id"), fused_order()
        return paginate(facet_filter(ranked, list(venue_years), list(categories)), order, cap, page, per_page)

    def related(self, text: str, vector=None, papers: int = 20) -> DataFrame:
        """The papers nearest to an idea, for a brainstorm over so many of them: hybrid, or lexical without a vector."""
        semantic, lexical = brainstorm_k(papers)
        hits = self.lexical(text, lexical)
        if vector is None:
            return hits.orderBy(F.desc("score"), "pos").limit(papers)
        fused = fuse(self.semantic(vector, semantic), hits, self.papers, self.model)
        return fused.drop("pos").join(self.papers, "id").orderBy("rank").limit(papers)


def export(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)
