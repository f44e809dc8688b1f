"""Stored indexes of a channel's chunks: vector lists around centroids, and postings in token and impact order.

Both are tables of numbered segments under one root. A change writes its rows as a new segment, then the ids it makes void,
then the segment's own line: readers look at segments that have a line only, so a job that failed is not seen, and when it
runs again it overwrites what it left. ``compact`` writes what is valid as one segment that readers begin with.

Rows are never cut or sampled: the exact search of either index gives the answer of a full scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamplight.functions import vectors
from lamplight.operators import scoring
from lamplight.operators.scoring import Question

#: Rows the centroids are fitted on, at most.
SAMPLE = 16_384
#: Folders postings are dealt to by token, in each channel.
TOKEN_BUCKETS = 16
#: Row groups of postings are small, so that their greatest weights can rule them out.
ROW_GROUP = 1 << 20
#: Scores are rounded to nine digits, so a bound must allow for one unit of the last.
LAST_DIGIT = 10.0**-scoring.SCORE_DIGITS


class _Segments:
    """Numbered segments of one table, the ids they make void, and the lines that make them count."""

    COLUMNS = ""
    KEYS: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string"):
        self.spark, self.root, self.id_type = spark, root.rstrip("/"), id_type

    def _has(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, table: str, ddl: str) -> DataFrame:
        if not self._has(table):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{table}")

    def _lines(self) -> tuple[int, int]:
        """The first segment that counts, and the last one there is (0: none)."""
        lines = self._read("lines", "number int, whole boolean")
        row = lines.agg(F.max(F.when(F.col("whole"), F.col("number"))), F.max("number")).first()
        return row[0] or 0, row[1] or 0

    def _put(self, table: str, number: int, rows: DataFrame, keys: Sequence[str] = (), **options) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**options)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{self.root}/{table}/segment={number}")

    def rows(self) -> DataFrame:
        """What is valid: of segments that count, rows that no later segment makes void."""
        first, last = self._lines()
        within = F.col("segment").between(first, last)
        rows = self._read("rows", f"{self.COLUMNS.format(id=self.id_type)}, segment int").where(within)
        if not self._has("void"):
            return rows
        void = self._read("void", f"id {self.id_type}, segment int").where(within)
        void = void.groupBy("id").agg(F.max("segment").alias("void_from"))
        return rows.join(void, "id", "left").where("void_from IS NULL OR segment >= void_from").drop("void_from")

    def replace(self, chunks: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds ``chunks``; the rows of the ids in ``gone`` as they were before are void."""
        number = self._lines()[1] + 1
        self._write(number, chunks)
        if gone is not None:
            self._put("void", number, gone.select(F.col("id").cast(self.id_type).alias("id")).distinct())
        self._commit(number, False)

    def compact(self) -> None:
        """Everything valid as one segment."""
        number = self._lines()[1] + 1
        self._rewrite(number)
        self._commit(number, True)

    def _commit(self, number: int, whole: bool) -> None:
        line = self.spark.range(1).select(F.lit(number).alias("number"), F.lit(whole).alias("whole"))
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/lines")

    def _write(self, number: int, chunks: DataFrame) -> None:
        raise NotImplementedError

    def _rewrite(self, number: int) -> None:
        raise NotImplementedError


class DenseIndex(_Segments):
    """Vectors in lists around centroids, each list with the radius that holds all its directions.

    Cosine distance is half the squared distance of unit vectors, so by the triangle inequality no vector of a list
    is nearer than its centroid's distance less the radius allows.
    """

    COLUMNS = "id {id}, channel_id string, embedding array<float>, list int"

    def _model(self) -> KMeansModel:
        return KMeansModel.load(f"{self.root}/centroids")

    def fit(self, chunks: DataFrame, lists: int = 64, seed: int = 7) -> DenseIndex:
        """Centroids from ``SAMPLE`` rows at most. They shape the lists; what is found does not depend on them."""
        total = chunks.count()
        usable = self._directions(chunks)
        if total > SAMPLE:
            usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
        KMeans(k=lists, seed=seed, maxIter=10, featuresCol="direction", predictionCol="list").fit(usable).write().overwrite().save(
            f"{self.root}/centroids"
        )
        return self

    @staticmethod
    def _directions(chunks: DataFrame) -> DataFrame:
        """Rows that have a direction: a null vector, or one of length zero, has no distance to anything."""
        there = chunks.where(F.col("embedding").isNotNull())
        length = vectors.norm(F.col("embedding"))
        unit = F.transform("embedding", lambda x: x.cast("double") / F.col("_length"))
        return there.withColumn("_length", length).where("_length > 0").withColumn("direction", array_to_vector(unit)).drop("_length")

    def _write(self, number: int, chunks: DataFrame) -> None:
        model = self._model()
        placed = model.transform(self._directions(chunks.select(F.col("id").cast(self.id_type).alias("id"), "channel_id", "embedding")))
        self._lay(number, placed)

    def _rewrite(self, number: int) -> None:
        self._lay(number, self._directions(self.rows().drop("segment")))

    def _lay(self, number: int, placed: DataFrame) -> None:
        kept = placed.select("id", "channel_id", "embedding", "list").hint("rebalance", "list")
        self._put("rows", number, kept.sortWithinPartitions("list", "channel_id"), ["list"])
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self._model().clusterCenters()])
        written = self._read("rows", f"{self.COLUMNS.format(id=self.id_type)}, segment int").where(F.col("segment") == number)
        unit = vectors.unit(F.col("embedding"))
        apart = F.zip_with(unit, F.get(centres, F.col("list")), lambda a, b: (a - b) * (a - b))
        far = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))
        facts = written.groupBy("channel_id", "list").agg(F.count("*").alias("rows"), F.max(far).alias("radius"))
        self._put("lists", number, facts)

    def lists(self, channel_id: str) -> list[tuple[int, int, float]]:
        """(list, rows, radius) of a channel: as many as there are lists."""
        first, last = self._lines()
        facts = self._read("lists", "channel_id string, list int, rows long, radius double, segment int")
        facts = facts.where(F.col("segment").between(first, last) & (F.col("channel_id") == channel_id))
        return [tuple(r) for r in facts.groupBy("list").agg(F.sum("rows"), F.max("radius")).orderBy("list").collect()]

    def _bounds(self, facts: list[tuple[int, int, float]], vector: Sequence[float]) -> np.ndarray:
        """The least cosine distance that a row of each list can have, rounding covered."""
        q = np.asarray(vector, float)
        q = q / np.linalg.norm(q)
        centres = np.array(self._model().clusterCenters())[[f[0] for f in facts]]
        gap = np.linalg.norm(centres - q, axis=1) - np.array([f[2] for f in facts]) - 1e-6
        return np.maximum(gap, 0) ** 2 / 2

    def _scan(self, channel_id: str, lists: list[int], question: Question, k: int) -> DataFrame:
        rows = self.rows().where((F.col("channel_id") == channel_id) & F.col("list").isin(lists))
        return scoring.candidates(rows, [question], k, sparse=False)

    def search(self, channel_id: str, question: Question, k: int, probes: int | None = None) -> DataFrame:
        """(question_id, arm, id, score, rank) of the ``k`` nearest rows of a channel, as a full scan ranks them.

        The lists whose rows can be nearest are read until they hold ``k`` rows; the distance of the last bounds what else
        is read. ``probes`` reads so many lists and no more: faster, and not exact.
        """
        facts = self.lists(channel_id)
        if not facts:
            return scoring.ranked(self._scan(channel_id, [], question, k), k)
        bounds = self._bounds(facts, question.dense)
        order = np.argsort(bounds, kind="stable")
        if probes is not None:
            centres = np.array(self._model().clusterCenters())[[f[0] for f in facts]]
            nearest = np.argsort(-(centres @ np.asarray(question.dense, float)) / np.linalg.norm(centres, axis=1), kind="stable")
            return scoring.ranked(self._scan(channel_id, [facts[i][0] for i in nearest[:probes]], question, k), k)
        held = np.cumsum([facts[i][1] for i in order])
        upto = int(np.searchsorted(held, k)) + 1
        early = [facts[i][0] for i in order[:upto]]
        found = scoring.ranked(self._scan(channel_id, early, question, k), k)
        bar = found.agg(F.count("*"), F.max("score")).first()
        far = bar[1] + LAST_DIGIT if bar[0] >= k else np.inf
        late = [facts[i][0] for i in order[upto:] if bounds[i] <= far]
        return scoring.ranked(self._scan(channel_id, early + late, question, k), k)


class SparseIndex(_Segments):
    """Postings by channel and bucket of tokens, sorted by token and falling weight.

    A row group's greatest weight is its first, and the file keeps it: a floor on a token's weight is pushed to the
    scan and rules out the groups after it.
    """

    COLUMNS = "token int, weight double, id {id}, channel_id string, bucket int"

    def _write(self, number: int, chunks: DataFrame) -> None:
        rows = chunks.select(F.col("id").cast(self.id_type).alias("id"), "channel_id", "sparse_embedding")
        self._put("members", number, rows.select("id", "channel_id").hint("rebalance", "channel_id").sortWithinPartitions("channel_id", "id"), ["channel_id"])
        postings = rows.select("id", "channel_id", F.explode("sparse_embedding").alias("token", "weight"))
        self._lay(number, postings.select("id", "channel_id", F.col("token").cast("int").alias("token"), F.col("weight").cast("double").alias("weight")))

    def _rewrite(self, number: int) -> None:
        members = self.members()
        self._put("members", number, members.hint("rebalance", "channel_id").sortWithinPartitions("channel_id", "id"), ["channel_id"])
        self._lay(number, self.rows().drop("segment", "bucket"))

    def _lay(self, number: int, postings: DataFrame) -> None:
        dealt = postings.withColumn("bucket", F.pmod("token", F.lit(TOKEN_BUCKETS)))
        # Ranges, not hashes: a token of very many rows is split where its weights fall.
        dealt = dealt.repartitionByRange("channel_id", "bucket", "token", F.desc("weight"), "id")
        sorted_ = dealt.sortWithinPartitions("channel_id", "bucket", "token", F.desc("weight"), "id")
        self._put("rows", number, sorted_, ["channel_id", "bucket"], **{"parquet.block.size": str(ROW_GROUP)})
        written = self._read("rows", f"{self.COLUMNS.format(id=self.id_type)}, segment int").where(F.col("segment") == number)
        facts = written.groupBy("channel_id", "token").agg(F.max("weight").alias("most"), F.min("weight").alias("least"))
        self._put("terms", number, facts.sortWithinPartitions("token"), ["channel_id"])

    def members(self) -> DataFrame:
        """(id, channel_id) of all chunks, those without a token too."""
        first, last = self._lines()
        within = F.col("segment").between(first, last)
        rows = self._read("members", f"id {self.id_type}, channel_id string, segment int").where(within)
        void = self._read("void", f"id {self.id_type}, segment int").where(within).groupBy("id").agg(F.max("segment").alias("void_from"))
        return rows.join(void, "id", "left").where("void_from IS NULL OR segment >= void_from").select("id", "channel_id")

    def _terms(self, channel_id: str, tokens: list[int]) -> dict[int, tuple[float, float]]:
        """The greatest and least weight of each asked token."""
        first, last = self._lines()
        facts = self._read("terms", "token int, most double, least double, channel_id string, segment int")
        facts = facts.where(F.col("segment").between(first, last) & (F.col("channel_id") == channel_id) & F.col("token").isin(tokens))
        return {r[0]: (r[1], r[2]) for r in facts.groupBy("token").agg(F.max("most"), F.min("least")).collect()}

    def postings(self, channel_id: str, floors: dict[int, float | None]) -> DataFrame:
        """The postings of the tokens, each from its greatest weight down to its floor (None: all)."""
        tokens = sorted(floors)
        buckets = sorted({t % TOKEN_BUCKETS for t in tokens})
        wanted: Column = F.lit(False)
        for token in tokens:
            own = F.col("token") == token
            wanted = wanted | (own if floors[token] is None else own & (F.col("weight") >= floors[token]))
        return self.rows().where((F.col("channel_id") == channel_id) & F.col("bucket").isin(buckets) & wanted)

    def _products(self, postings: DataFrame, weights: dict[int, float]) -> DataFrame:
        w = F.create_map(*[F.lit(x) for t, v in sorted(weights.items()) for x in (t, float(v))])
        return postings.groupBy("id").agg(F.sum(F.col("weight") * F.element_at(w, F.col("token"))).alias("product"))

    def search(self, channel_id: str, question: Question, k: int, zero_overlap: bool = True) -> DataFrame:
        """(question_id, arm, id, score, rank) of the ``k`` greatest inner products, as a full scan ranks them.

        The heaviest postings of each token give products so far, whose ``k``-th is a bar. A row that lies under its floor
        in every list cannot reach the bar; rows above one in any list are candidates, and their products are completed.
        """
        weights = {int(t): float(w) for t, w in question.sparse.items()}
        terms = self._terms(channel_id, sorted(weights)) if weights else {}
        weights = {t: w for t, w in weights.items() if t in terms}
        floors: dict[int, float | None] = {t: None for t in weights}
        # Bounds hold for positive weights only; with others all postings of the tokens are read.
        if weights and all(w > 0 for w in weights.values()) and all(least >= 0 for _, least in terms.values()):
            heavy = {t: terms[t][0] / 2 for t in weights}
            early = self._products(self.postings(channel_id, heavy), weights)
            best = early.orderBy(F.desc("product")).limit(k).agg(F.count("*"), F.min("product")).first()
            if best[0] >= k:
                bar = best[1] - LAST_DIGIT
                total = sum(weights[t] * terms[t][0] for t in weights)
                floors = {t: (bar - (total - weights[t] * terms[t][0])) / weights[t] - LAST_DIGIT for t in weights}
        hits = self._hits(channel_id, weights, floors)
        shaped = [
            F.lit(question.question_id).alias("question_id"), F.lit("sparse").alias("arm"), "id", "score",
        ]
        hits = hits.select("id", F.round(-F.col("product"), scoring.SCORE_DIGITS).alias("score"))
        if zero_overlap:
            # A product of zero ranks by id alone: the first ids that no hit has.
            others = self.members().where(F.col("channel_id") == channel_id).join(hits.select("id"), "id", "left_anti")
            hits = hits.unionByName(others.orderBy("id").limit(k).select("id", F.lit(0.0).alias("score")))
        else:
            hits = hits.where("score < 0")
        return scoring.ranked(hits.select(*shaped), k)

    def _hits(self, channel_id: str, weights: dict[int, float], floors: dict[int, float | None]) -> DataFrame:
        whole = self.postings(channel_id, {t: None for t in floors})
        if any(f is None or f <= 0 for f in floors.values()) or not floors:
            return self._products(whole, weights)
        candidates = self.postings(channel_id, floors).select("id").distinct()
        return self._products(whole.join(candidates, "id", "left_semi"), weights)
