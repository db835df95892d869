"""The two tool surfaces: files of a source, and ranked retrieval over a bundle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import bundle, catalog, lexical, ranking, rerank, siblings, trigram
from quern.operators.embedding import Model
from quern.sources.corpus import MarkdownSource


@dataclass
class Corpus:
    """Files of a source: list, read, search (through an index of trigrams, if there is one)."""

    source: MarkdownSource
    trigrams: trigram.TrigramIndex | None = None

    @property
    def files(self) -> DataFrame:
        if not hasattr(self, "_files"):
            self._files = self.source.files()
        return self._files

    def list_publications(self) -> DataFrame:
        return catalog.list_publications(self.files)

    def list_files(self, publication: str) -> DataFrame:
        return catalog.list_files(self.files, publication)

    def read_file(self, publication: str, file: str, max_chars: int = 50_000) -> DataFrame:
        return catalog.read_file(self.files, publication, file, max_chars)

    def search(self, query: str, scope: str | None = None, regex: bool = False, max_results: int = 50) -> DataFrame:
        search = catalog.search_text if self.trigrams is None else self.trigrams.search
        return search(self.files, query, scope, regex, max_results)

    def get_release_info(self) -> DataFrame:
        return self.source.release_info()


@dataclass
class Retriever:
    """Ranked retrieval over chunks with embeddings, for one query or a batch in one job.

    With ``by_siblings`` the sibling boost of chunks without tags is worked out for the queries asked.
    """

    chunks: DataFrame
    index: lexical.LexicalIndex | None
    model: Model
    scorer: Callable[[], rerank.Scorer] | None = None
    manifest: dict | None = None
    texts: DataFrame | None = None
    by_siblings: bool = False

    @classmethod
    def open(cls, spark: SparkSession, folder: str, model: Model, scorer: Callable[[], rerank.Scorer] | None = None, expected: str | None = None, keep: bool = True) -> Retriever:
        """A retriever over a saved bundle, opened once for many queries; ``expected`` is the repository it should be from.

        With ``keep`` postings and vectors, but no texts, stay in memory or on local disks of the
        executors once they were read; :meth:`close` gives them up.
        """
        opened = bundle.open_bundle(spark, folder)
        if expected:
            bundle.check_source(opened.manifest, expected)
        chunks, index, texts = opened.chunks, opened.index, opened.texts
        if keep:
            chunks = chunks.persist()
            if index is not None:
                index = lexical.LexicalIndex(index.blocks.persist(), index.terms.persist(), index.fields.persist())
        return cls(chunks, index, model, scorer, opened.manifest, texts)

    def close(self) -> None:
        self.chunks.unpersist()
        if self.index is not None:
            for part in (self.index.blocks, self.index.terms, self.index.fields):
                part.unpersist()

    @property
    def _texts(self) -> DataFrame | None:
        return None if self.texts is None else self.texts.select("id", "text")

    def queries(self, texts: list[str]) -> DataFrame:
        """The query table of some texts: query_id is the place in the list."""
        vectors = self.model(texts).tolist() if texts else []
        rows = [(i, q, v) for i, (q, v) in enumerate(zip(texts, vectors, strict=True))]
        return self.chunks.sparkSession.createDataFrame(rows, "query_id int, query string, vector array<double>")

    def search_docs(self, query: str | list[str], rerank_hits: bool = False, request: str | None = None, **options) -> DataFrame:
        """Hits of the queries; with ``rerank_hits`` a hundred candidates go through the scorer.

        ``request`` names the jobs of this thread from here on, so that they can be found and stopped together.
        """
        if request:
            self.chunks.sparkSession.addTag(request)
        asked = self.queries([query] if isinstance(query, str) else query)
        o = ranking.Options(**options)
        o.check()
        if not 1 <= o.top_k <= 50:
            raise ValueError("top_k must lie between 1 and 50")
        chunks = self.chunks
        if self.by_siblings and "cluster_tags" not in chunks.columns:
            asked = ranking.prepared(asked)
            chunks = siblings.tagged(chunks, chunks, asked)
        if not rerank_hits:
            return ranking.search(chunks, asked, self.index, o, self._texts)
        if self.scorer is None:
            raise ValueError("no scorer to rerank with")
        wide = ranking.search(chunks, asked, self.index, replace(o, top_k=rerank.CANDIDATES), self._texts)
        return rerank.rerank(wide, asked, self.scorer, o.top_k)

    def search_code(self, query: str | list[str], **options) -> DataFrame:
        return self.search_docs(query, **(options | {"is_code": True}))

    def get_chunk(self, chunk_id: str | int) -> DataFrame:
        """The chunk of an id, no row if there is none; of a saved bundle the one row group that can hold it is read."""
        rows = self.chunks if self.texts is None else self.texts
        return rows.where(F.col("id") == chunk_id).drop("embedding", "norm", "packed")

    def get_bundle_info(self) -> dict:
        return self.manifest or {}
