"""The facade: create indexes, write documents, publish, search."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .functions.analysis import Analyzer, Registry
from .mapping import IndexMapping
from .operators.search import SearchRequest, SearchResponse, count, paged, scroll, search
from .operators.suggest import Suggestion, suggest
from .plans.ast import Query
from .sources.catalog import Catalog
from .sources.files import Folder
from .sources.index import Index
from .sources.store import BulkResult, DocumentStore
from .streaming.changes import ChangeFeed


class SearchEngine:
    """Indexes below one folder. Names may be aliases. `principals` are the groups of who asks; None means no restriction."""

    def __init__(self, spark: SparkSession, uri: str, keep: int = 100):
        self.spark, self.uri, self.keep = spark, uri.rstrip("/"), keep
        self._catalog = Catalog(spark, f"{self.uri}/catalog")
        self._analyzers: dict[str, Analyzer] = {}
        self._loaded: dict[tuple[str, int], Index] = {}
        self._answers: dict[tuple, SearchResponse] = {}

    def create_index(self, mapping: IndexMapping) -> None:
        self._catalog.create(mapping)

    def drop_index(self, name: str) -> None:
        self._catalog.drop(name)

    def set_alias(self, alias: str, index: str) -> None:
        self._catalog.alias(alias, index)

    def catalog(self) -> dict:
        return self._catalog.state()

    def analyzers(self, mapping: IndexMapping) -> Registry:
        """The built-in analyzers, the mapping's synonyms, and what has been registered."""
        found = Registry(mapping.synonyms)
        for n, a in self._analyzers.items():
            found.register(n, a)
        return found

    def register_analyzer(self, name: str, analyzer: Analyzer) -> None:
        self._analyzers[name] = analyzer

    def store(self, name: str) -> DocumentStore:
        mapping = self._catalog.mapping(name)
        return DocumentStore(self.spark, f"{self.uri}/{mapping.name}", mapping)

    def bulk(self, name: str, docs: DataFrame) -> BulkResult:
        return self.store(name).bulk(docs)

    def delete(self, name: str, ids: DataFrame) -> None:
        self.store(name).delete(ids)

    def feed(self, name: str) -> ChangeFeed:
        store = self.store(name)
        return ChangeFeed(store, f"{store.uri}/index", f"{store.uri}/checkpoint", analyzers=self.analyzers(store.mapping))

    def refresh(self, name: str) -> None:
        """Makes all that was written before visible to searches from now on."""
        self.feed(name).drain()

    def index(self, name: str) -> Index:
        """The newest generation."""
        mapping = self._catalog.mapping(name)
        uri = f"{self.uri}/{mapping.name}/index"
        newest = max(Folder(self.spark, uri).versions(), default=0)
        key = (mapping.name, newest)
        if key not in self._loaded:
            self._loaded = {k: v for k, v in self._loaded.items() if k[0] != mapping.name}
            self._loaded[key] = Index.load(self.spark, uri, mapping, newest, self.analyzers(mapping))
        return self._loaded[key]

    def search(self, name: str, request: SearchRequest, principals: list[str] | None = None) -> SearchResponse:
        """Answers are remembered for as long as the generation is the newest."""
        index = self.index(name)
        generation = max(k[1] for k in self._loaded if k[0] == index.mapping.name)
        key = (index.mapping.name, generation, request, None if principals is None else tuple(sorted(principals)))
        if key not in self._answers:
            if len(self._answers) >= self.keep:
                self._answers.pop(next(iter(self._answers)))
            self._answers[key] = search(index, request, principals)
        return self._answers[key]

    def count(self, name: str, query: str | Query | None, principals: list[str] | None = None) -> int:
        return count(self.index(name), query, principals)

    def scroll(self, name: str, request: SearchRequest, principals: list[str] | None = None) -> Iterator[SearchResponse]:
        """Page after page that has hits, all of the generation that is the newest when it starts."""
        return scroll(self.index(name), request, principals)

    def pages(self, name: str, request: SearchRequest, principals: list[str] | None = None) -> DataFrame:
        """What scroll() gives, as one frame: doc_id, score, shard_id, stored fields, the order's values, place and page."""
        return paged(self.index(name), request, principals)

    def suggest(self, name: str, field: str, text: str, size: int = 5, correct: bool = True, principals: list[str] | None = None) -> list[Suggestion]:
        return suggest(self.index(name), field, text, size, correct, principals)
