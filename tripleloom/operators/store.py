"""The triple store as tables: idempotent inserts, entities, lookups, statistics, purging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.schema import LAYERS, TRIPLES, conform, triple_id
from tripleloom.session import discard, materialise


def with_triple_ids(triples: DataFrame) -> DataFrame:
    return triples.withColumn("computed_id", triple_id())


def new_triples(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The incoming rows to add: one a triple_id (the first by ``order``), none that exist already."""
    first = incoming.groupBy("triple_id").agg(F.min(order).alias(order))
    return incoming.join(first, ["triple_id", order]).dropDuplicates(["triple_id"]).join(existing.select("triple_id"), "triple_id", "left_anti")


def insert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(added, skipped) of an insert-if-absent by triple_id, in one pass over the incoming ids."""
    ids = incoming.groupBy("triple_id").agg(F.count(F.lit(1)).alias("n"))
    fresh = ids.join(existing.select("triple_id").distinct().withColumn("there", F.lit(True)), "triple_id", "left")
    return fresh.agg(
        F.coalesce(F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"),
    )


def endpoints(triples: DataFrame, order: str) -> DataFrame:
    """(id, kind, seq): both ends of every triple in the order of arrival, subject first."""

    def end(name: str, kind: str, side: int):
        return F.struct(F.col(name).alias("id"), F.col(kind).alias("kind"), F.struct(F.col(order).alias("at"), F.lit(side).alias("side")).alias("seq"))

    return triples.select(F.explode(F.array(end("subject", "source_kind", 0), end("object", "target_kind", 1))).alias("e")).select("e.*")


def first_kinds(triples: DataFrame, order: str) -> DataFrame:
    """(id, kind): the first writer of an entity decides its kind; literals are entities too."""
    return endpoints(triples, order).groupBy("id").agg(F.min(F.struct("seq", "kind")).alias("f")).select("id", F.col("f.kind").alias("kind"))


def kind_conflicts(triples: DataFrame, order: str) -> DataFrame:
    """(id, kind, other): kinds that later writers gave an entity, each once."""
    seen = endpoints(triples, order).groupBy("id", "kind").agg(F.min("seq").alias("seq"))
    first = seen.groupBy("id").agg(F.min(F.struct("seq", "kind")).alias("f")).select(F.col("id"), F.col("f.kind").alias("won"))
    return seen.join(first, "id").filter(~F.col("kind").eqNullSafe(F.col("won"))).select("id", F.col("won").alias("kind"), F.col("kind").alias("other"))


def query(
    triples: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, layer: str | None = None, limit: int | None = 100,
) -> DataFrame:
    """Conjunctive equality filter; empty text is no filter; the first ``limit`` by triple_id."""
    out = triples
    for c, v in (("subject", subject), ("predicate", predicate), ("object", obj), ("layer", layer)):
        if v:
            out = out.filter(F.col(c) == v)
    return out if limit is None else out.orderBy("triple_id", *[c for c in ("row_id",) if c in triples.columns]).limit(limit)


def provenance(triples: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Triples that touch ``entity`` and whose subject is an entity, with the subject's kind, by time."""
    t = triples.filter((F.col("subject") == entity) | (F.col("object") == entity))
    kinds = entities.groupBy("id").agg(F.min("kind").alias("subject_kind")).withColumnRenamed("id", "subject")
    return t.join(kinds, "subject").orderBy("timestamp", "triple_id")


def node_view(triples: DataFrame, entity: str, limit: int) -> DataFrame:
    """Outgoing and incoming triples, each the first ``limit`` by triple_id; a loop is in both."""
    order = ["triple_id", *[c for c in ("row_id",) if c in triples.columns]]
    out = triples.filter(F.col("subject") == entity).orderBy(*order).limit(limit).withColumn("direction", F.lit("out"))
    inc = triples.filter(F.col("object") == entity).orderBy(*order).limit(limit).withColumn("direction", F.lit("in"))
    return out.unionByName(inc)


def purge_layer(triples: DataFrame, entities: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """(triples without the layer, entities that are still an end of a triple)."""
    kept = triples.filter(~F.coalesce(F.col("layer") == layer, F.lit(False)))
    ends = kept.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    return kept, entities.join(ends, "id", "left_semi")


def row_checks(triples: DataFrame) -> DataFrame:
    """Rows that a store with checks would refuse: (triple_id, reason)."""
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("confidence")), F.when(~F.coalesce(F.col("layer").isin(LAYERS), F.lit(False)), F.lit("layer")), *[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in ("subject", "predicate", "object")]))
    return triples.select("row_id", F.explode(bad).alias("reason"))


#: Place in the order of arrival: the batch, and within it the document (where told) and the place.
ARRIVAL = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("doc", T.StringType()), T.StructField("at", T.LongType())])


class TripleStore:
    """Triples and entities as Parquet under one path, in batches; triples partitioned by layer.

    Inserts are idempotent by triple_id and append: an insert writes its new rows as one batch, then a
    manifest that lists the batches that make up the store. Readers see the batches of the latest
    manifest, so they see whole snapshots; a batch without a manifest is nobody's. ``purge`` and
    ``compact`` write one batch anew. The store has one writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        fs, path = self._fs()
        root = path(f"{self.path}/manifest")
        return max((int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()), default=0) if fs.exists(root) else 0

    def batches(self) -> list[int]:
        """The batches of the latest manifest."""
        v = self.version()
        if not v:
            return []
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/manifest/{v}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [int(x) for x in text.split()]

    def _publish(self, batches: list[int]) -> None:
        """A manifest appears under its name when it is complete."""
        fs, path = self._fs()
        v = self.version() + 1
        draft = path(f"{self.path}/manifest/.{v}")
        out = fs.create(draft, True)
        out.write(bytearray(" ".join(map(str, batches)).encode()))
        out.close()
        if not fs.rename(draft, path(f"{self.path}/manifest/{v}")):
            raise OSError("another writer has published this version")

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        fs, path = self._fs()
        there = [f"{self.path}/{table}/batch={b}" for b in self.batches()]
        there = [x for x in there if fs.exists(path(x))]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*there).select(*schema.names)

    def triples(self, arrival: bool = False) -> DataFrame:
        """All triples; with ``arrival``, their place in the order of arrival too."""
        schema = T.StructType([*TRIPLES.fields, T.StructField("arrival", ARRIVAL)])
        t = self._read("triples", schema)
        return t if arrival else t.drop("arrival")

    def entities(self) -> DataFrame:
        return self._read("entities", T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType())]))

    def _next(self) -> int:
        """A number that no batch folder has, those of failed writes included."""
        fs, path = self._fs()
        used = [0]
        for table in ("triples", "entities"):
            root = path(f"{self.path}/{table}")
            if fs.exists(root):
                used += [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
        return max(used) + 1

    def _write(self, triples: DataFrame, entities: DataFrame, batches: list[int], n: int | None = None) -> None:
        n = n or self._next()
        triples.write.partitionBy("layer").parquet(f"{self.path}/triples/batch={n}")
        entities.write.parquet(f"{self.path}/entities/batch={n}")
        self._publish([*batches, n])

    def add(self, triples: DataFrame, order: str | None = None, within: str | None = None) -> tuple[int, int]:
        """Insert what is not there yet; (added, skipped). Of rows with one triple_id the first arrived is
        kept, and the first writer of an entity decides its kind; ``order`` names the column that tells the
        order of arrival (``within`` the documents that a text column names, if given, which arrive in
        the order of their names); without it the order of the rows does. Only new rows are written."""
        at = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        numbered = triples.withColumn("_at", F.struct((F.col(within) if within else F.lit("")).alias("doc"), at.alias("at")))
        incoming = materialise(conform(numbered, "_at"), "incoming")
        bad = incoming.filter(~F.coalesce(F.col("confidence").between(0, 1) & F.col("layer").isin(LAYERS), F.lit(False))).limit(1).count()
        if bad:
            raise ValueError("a triple's confidence is outside 0..1 or its layer is unknown")
        old, known, batches = self.triples(), self.entities(), self.batches()
        first = (
            incoming.groupBy("triple_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_at", *[c for c in TRIPLES.names if c != "triple_id"])).alias("r"))
        )
        fresh = materialise(first.join(old.select("triple_id"), "triple_id", "left_anti").select("triple_id", "n", "r.*"), "fresh")
        total, added = incoming.count(), fresh.count()
        if added:
            n = self._next()
            arrival = F.struct(F.lit(n).alias("batch"), F.col("_at.doc").alias("doc"), F.col("_at.at").alias("at")).cast(ARRIVAL)
            kinds = first_kinds(fresh, "_at").join(known.select("id"), "id", "left_anti")
            self._write(fresh.withColumn("arrival", arrival).select(*TRIPLES.names, "arrival"), kinds, batches, n)
        discard(incoming, fresh)
        return added, total - added

    def compact(self) -> None:
        """All batches as one; the files of the old ones stay for readers of old snapshots."""
        self._write(self.triples(arrival=True), self.entities(), [])

    def purge(self, layer: str) -> int:
        """Delete a layer and the entities that only it had; the number of triples deleted."""
        old = self.triples(arrival=True)
        gone = old.filter(F.col("layer") == layer).count()
        if gone:
            self._write(*purge_layer(old, self.entities(), layer), [])
        return gone

    def kind_conflicts(self) -> DataFrame:
        """(id, kind, other): kinds that later triples gave an entity."""
        return kind_conflicts(self.triples(arrival=True), "arrival")

    def by_id(self, triple_id: str) -> DataFrame:
        return self.triples().filter(F.col("triple_id") == triple_id)

    def count(self) -> int:
        return self.triples().count()

    def stats(self) -> dict:
        t = self.triples()
        return {
            "entities": self.entities().count(),
            "triples": t.count(),
            "layers": {r["layer"]: r["count"] for r in t.groupBy("layer").count().collect()},  # four layers
            "top_predicates": {r["predicate"]: r["count"] for r in t.groupBy("predicate").count().orderBy(F.desc("count"), "predicate").limit(20).collect()},
        }


def top_per_key(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each key to n before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
