"""The engine's API: ingest, resolve, embed, detect communities, ask; and what it counted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators import communities as com
from tripleloom.operators import graph, index, resolve, rules, vectors
from tripleloom.operators.extraction import call, parse_replies, sections
from tripleloom.operators.retrieval import Retriever, extractive, search_text
from tripleloom.operators.store import TripleStore, provenance, query
from tripleloom.operators.validate import validate
from tripleloom.schema import EXTRACTOR, UNIVERSAL, VAULT, Vocabulary
from tripleloom.session import materialise
from tripleloom.sources import files



@runtime_checkable
class Adapter(Protocol):
    """What brings documents into the graph. ``scan`` lists the documents of a source (at least doc_id or
    relative_path), ``extract`` makes triples of them (columns as in ``schema.TRIPLES``; missing ones get
    defaults), ``vocabulary`` says what the triples may hold. All are lazy DataFrames. An adapter may also
    split ``extract`` into ``texts`` (with relative_path and error, null where a document could be read) and
    ``extract_texts``: then documents are read once and errors are reported one by one."""

    vocabulary: Vocabulary

    def scan(self, spark: SparkSession, source: str, **filters) -> DataFrame: ...

    def extract(self, documents: DataFrame) -> DataFrame: ...


@dataclass
class FileAdapter:
    """Files of a folder by the rules of ``name``. ``max_facts`` a document and ``limits`` of structured
    files are those that the name stands for; None is all."""

    name: str
    vocabulary: Vocabulary
    max_facts: int | None = None
    limits: files.Limits = field(default_factory=files.Limits)

    def scan(self, spark: SparkSession, source: str, **filters) -> DataFrame:
        return files.scan(spark, source, self.name, **filters)

    def texts(self, documents: DataFrame) -> DataFrame:
        return files.read_texts(documents, self.limits)

    def extract(self, documents: DataFrame) -> DataFrame:
        return self.extract_texts(self.texts(documents))

    def extract_texts(self, texts: DataFrame) -> DataFrame:
        return rules.extract(texts, self.name, structured="is_structured" if self.name == "universal" else None, max_facts=self.max_facts)


@dataclass
class ModelAdapter:
    """Texts of files by a text-generation client, section by section."""

    client: Callable[[str, str], str]
    vocabulary: Vocabulary = EXTRACTOR
    max_sections: int | None = None

    def scan(self, spark: SparkSession, source: str, **filters) -> DataFrame:
        return files.scan(spark, source, "llm", **filters)

    def texts(self, documents: DataFrame) -> DataFrame:
        return files.read_texts(documents, files.Limits(None, None, None, None))

    def extract(self, documents: DataFrame) -> DataFrame:
        return self.extract_texts(self.texts(documents))

    def extract_texts(self, texts: DataFrame) -> DataFrame:
        return parse_replies(call(sections(texts, "relative_path", max_sections=self.max_sections), self.client), doc="doc_id")


#: Adapters by name; ``register`` adds one.
ADAPTERS: dict[str, Adapter] = {"universal": FileAdapter("universal", UNIVERSAL, rules.FACTS["universal"]), "vault": FileAdapter("vault", VAULT, rules.FACTS["vault"])}


def register(name: str, adapter: Adapter) -> None:
    """Make ``Engine.ingest(..., adapter=name)`` use ``adapter``."""
    if not isinstance(adapter, Adapter):
        raise TypeError("an adapter has a vocabulary, scan and extract")
    ADAPTERS[name] = adapter


@dataclass
class IngestResult:
    adapter: str
    source: str
    scanned: int = 0
    extracted: int = 0
    added: int = 0
    skipped: int = 0
    rejected: int = 0
    messages: list[str] = field(default_factory=list)

    def summary(self) -> str:
        head = [f"Adapter:    {self.adapter}", f"Source:     {self.source}", f"Scanned:    {self.scanned} documents", f"Extracted:  {self.extracted} documents", f"Triples:    {self.added} added, {self.skipped} skipped, {self.rejected} rejected"]
        return "\n".join(head + ([f"Messages:   {len(self.messages)}"] + [f"  - {m}" for m in self.messages[:5]] if self.messages else []))


class Engine:
    """One knowledge graph under one path."""

    def __init__(self, spark: SparkSession, path: str, encoder=None, client=None, messages: int | None = 100):
        """``messages`` of an ingest are reported at most (None: all; they come to the driver)."""
        self.spark, self.path = spark, path.rstrip("/")
        self.store = TripleStore(spark, f"{self.path}/store")
        self.encoder = encoder or vectors.NGramEncoder()
        self.client, self.messages = client, messages

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception:  # noqa: BLE001  not built yet
            return None

    def ingest(
        self, source: str, adapter: str | Adapter = "universal", dry_run: bool = False, strict: bool = False, max_facts: int | None = None,
        timestamp: str | None = None, client=None, **filters,
    ) -> IngestResult:
        """Scan a source, extract, validate and store; a dry run only counts the documents. ``adapter`` is a
        registered name, "llm" (with a client), or an adapter itself."""
        if isinstance(adapter, str):
            name = adapter
            if name != "llm" and name not in ADAPTERS:
                raise ValueError(f"unknown adapter {name}")
            adapter = ModelAdapter(client or self.client) if name == "llm" else ADAPTERS[name]
        else:
            name = adapter.vocabulary.name
        if max_facts is not None and isinstance(adapter, FileAdapter):
            adapter = replace(adapter, max_facts=max_facts)
        found = adapter.scan(self.spark, source, **filters)
        result = IngestResult(name, source, found.count())
        if dry_run:
            return result
        now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        if not hasattr(adapter, "extract_texts"):
            return self._store(adapter.extract(found).withColumn("timestamp", now), adapter.vocabulary, strict, result)
        texts = materialise(adapter.texts(found), "texts")
        unread = texts.filter("error is not null").select(F.concat("relative_path", F.lit(": "), "error").alias("message"))
        result = self._store(adapter.extract_texts(texts).withColumn("timestamp", now), adapter.vocabulary, strict, result)
        result.messages = (self._said(unread) + result.messages)[: self.messages]
        return result

    def _said(self, messages: DataFrame) -> list[str]:
        m = messages.orderBy("message")
        return [r["message"] for r in (m if self.messages is None else m.limit(self.messages)).collect()]

    def _store(self, triples: DataFrame, vocabulary, strict: bool, result: IngestResult) -> IngestResult:
        checked = materialise(validate(triples, vocabulary, strict), "checked")
        result.extracted = checked.select("source_doc").distinct().count()
        result.rejected = checked.filter("not accepted").count()
        result.messages = self._said(checked.filter("message is not null").select("message"))
        result.added, result.skipped = self.store.add(checked.filter("accepted"), *(("place", "source_doc") if "place" in checked.columns else ()))
        return result

    def resolve(self, threshold: float = 0.85, timestamp: str = "1970-01-01T00:00:00+00:00", embeddings: bool = True) -> dict:
        """Resolve entities by names and (``embeddings``) the cosine of their vectors, append the alias rows
        that are new, and add SAME_AS edges."""
        entities = self.store.entities()
        got = resolve.resolve(entities, self.store.triples(), threshold, encoder=self.encoder if embeddings else None)
        aliases = materialise(got["aliases"].withColumn("resolved_at", F.lit(timestamp)), "aliases")
        before = self.table("aliases")
        fresh = aliases if before is None else resolve.new_aliases(before, aliases)
        materialise(fresh, "aliases").write.mode("append").parquet(f"{self.path}/aliases")
        self.store.add(resolve.same_as_edges(aliases, entities, timestamp))
        return {"aliases": aliases.count(), "flagged": got["flagged"].count(), "by_phase": {r["phase"]: r["n"] for r in resolve.alias_stats(aliases).filter("phase is not null").collect()}}

    def aliases_for(self, canonical: str) -> list[str]:
        a = self.table("aliases")
        return [] if a is None else [r["alias_id"] for r in resolve.aliases_of(a, canonical).collect()]  # the names of one entity

    def embed(self, epochs: int = 30, retrain: bool = True, skip_existing: bool = False) -> dict:
        """Encode entities, learn the aggregator (or reuse stored weights of the same shape), store vectors
        with their kinds and an index. ``skip_existing`` encodes only entities without a vector and appends
        theirs; the others keep theirs although new edges may have changed them."""
        t, e = self.store.triples(), self.store.entities()
        old = self.table("base") if skip_existing else None
        todo = e if old is None else e.join(old.select("id"), "id", "left_anti")
        fresh = materialise(vectors.encode(vectors.entity_texts(t, todo), "text", self.encoder).select("id", "vec"), "base")
        n = fresh.count()
        if old is not None and not n:
            return {"entities": 0, "skipped": old.count(), "edges": 0, "losses": []}
        skipped = 0 if old is None else old.count()
        base = fresh if old is None else old.select("id", "vec").union(fresh)
        adj = materialise(vectors.adjacency(t, e), "adjacency")
        w = None if retrain and old is None else vectors.load_weights(self.spark, f"{self.path}/weights", self.encoder.dim)
        losses: list[float] = []
        if w is None:
            w, losses = vectors.train(base, adj, epochs)
            vectors.save_weights(self.spark, f"{self.path}/weights", w)
        final = vectors.aggregate(base, adj, w).join(e.groupBy("id").agg(F.min("kind").alias("kind")), "id")
        if old is not None:
            final = final.join(fresh.select("id"), "id", "left_semi")
        mode = "overwrite" if old is None else "append"
        final = materialise(final, "vectors")
        fresh.write.mode(mode).parquet(f"{self.path}/base")
        final.write.mode(mode).parquet(f"{self.path}/vectors")
        index.build(self.vectors_table().select("id", "vec", "kind")).save(f"{self.path}/index")
        return {"entities": n, "skipped": skipped, "edges": adj.count() // 2, "losses": losses}

    def communities(self, client=None, **params) -> dict:
        """Detect communities, summarise them, store both."""
        t = self.store.triples()
        edges = materialise(com.semantic_edges(t), "semantic")
        if not edges.head(1):
            return {"levels": 0, "communities": 0, "covered": 0}
        levels = materialise(com.hierarchy_levels(edges, **params), "hierarchy")
        c, m = com.community_tables(levels)
        said = com.summarise(com.community_facts(t, m), m, client or self.client or extractive)
        c.join(said, "community_id", "left").write.mode("overwrite").parquet(f"{self.path}/communities")
        m.write.mode("overwrite").parquet(f"{self.path}/community_members")
        return com.detection_stats(levels).first().asDict()

    def retriever(self, **kw) -> Retriever:
        v = self.table("vectors")
        return Retriever(
            self.store.triples(), self.store.entities(), self.table("communities"), self.table("community_members"), self.table("aliases"), v,
            self.encoder if v is not None else None, **({"client": self.client} if self.client else {}), **kw,
        )

    def ask(self, question: str, mode: str = "local", hops: int = 2) -> dict:
        return self.retriever(hops=hops).ask(question, mode)

    def similar(self, entity: str, k: int = 10, kind: str | None = None) -> DataFrame:
        v = self.table("vectors")
        if v is None:
            raise ValueError("no vectors yet")
        data = v.filter(F.col("kind") == kind) if kind else v
        q = v.filter(F.col("id") == entity).select("id", "vec")
        if self.table("index/cells") is not None and kind is None:
            return index.VectorIndex.load(self.spark, f"{self.path}/index").search(q, k)
        return vectors.nearest(data.select("id", "vec"), q, k)

    def search(self, text: str, k: int = 10, kind: str | None = None) -> DataFrame:
        """The k entities nearest to a text, encoded as the entities were."""
        v = self.table("vectors")
        if v is None:
            raise ValueError("no vectors yet")
        return search_text(v, text, self.encoder, k, kind)

    def vectors_table(self) -> DataFrame | None:
        """(id, vec, kind) of all entities that have a vector."""
        return self.table("vectors")

    def vector(self, entity: str) -> list[float] | None:
        v = self.table("vectors")
        row = None if v is None else v.filter(F.col("id") == entity).select("vec").first()
        return None if row is None else list(row["vec"])

    def vector_count(self) -> int:
        v = self.table("vectors")
        return 0 if v is None else v.count()

    def update_summaries(self, said: DataFrame) -> None:
        """Replace the stored summaries of the communities that ``said`` (community_id, summary) names."""
        c = self.table("communities")
        if c is not None:
            materialise(com.with_summaries(c, said), "communities").write.mode("overwrite").parquet(f"{self.path}/communities")

    def query(self, **kw) -> DataFrame:
        return query(self.store.triples(), **kw)

    def provenance(self, entity: str) -> DataFrame:
        return provenance(self.store.triples(), self.store.entities(), entity)

    def path_between(self, a: str, b: str, max_depth: int = 4) -> list[dict] | None:
        return graph.shortest_path(self.store.triples(), a, b, max_depth)

    def stats(self) -> dict:
        return self.store.stats()
