"""Similarity of nodes: by words, by dense vectors, by the shape of their bodies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.ids import is_test_path
from meshwright.functions.words import tokenise
from meshwright.operators.graph import CODE_KINDS, Graph


def postings(graph: Graph) -> DataFrame:
    """(snapshot, id, token, tf) of code: words of name, summary and called symbols.

    Words of calls are counted with the calls, not gathered per caller.
    """
    code = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS)))
    own = code.select("snapshot", "id", F.explode(F.concat(tokenise(F.col("name")), F.coalesce(tokenise(F.col("summary")), F.array().cast("array<string>")))).alias("token"))
    calls = graph.edges.where(F.col("relation") == "CALLS").select("snapshot", F.col("src").alias("id"), F.explode(tokenise(F.col("dst_symbol"))).alias("token"))
    calls = calls.join(code.select("snapshot", "id"), ["snapshot", "id"], "left_semi")
    return own.unionByName(calls).groupBy("snapshot", "id", "token").agg(F.count(F.lit(1)).alias("tf"))


def semantic(graph: Graph, text: str) -> DataFrame:
    """(snapshot, id, score): cosine of word counts with a text, where it is above 0.

    Words of the text that nothing has count in its norm; a text without words gives no rows.
    """
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(text,)], "text string").select(F.explode(tokenise(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("q"))
    norm = (asked.agg(F.sum(F.col("q") * F.col("q"))).first()[0] or 0) ** 0.5
    words = postings(graph)
    norms = words.groupBy("snapshot", "id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    dots = words.join(F.broadcast(asked), "token").groupBy("snapshot", "id").agg(F.sum(F.col("tf") * F.col("q")).alias("dot"))
    return dots.join(norms, ["snapshot", "id"]).select("snapshot", "id", (F.col("dot") / (F.col("norm") * F.lit(float(norm or 1.0)))).alias("score"))


def component_scores(graph: Graph, text: str, boost: float = 0.15) -> DataFrame:
    """(snapshot, id, name, exported, score): what public code serves a purpose; tests left out,
    exported code raised."""
    kept = graph.nodes.where(~F.array_contains("roles", "test") & ~is_test_path(F.col("id"))).select("snapshot", "id", "name", F.array_contains("roles", "exported").alias("exported"))
    out = semantic(graph, text).join(kept, ["snapshot", "id"])
    return out.withColumn("score", F.round(F.col("score") + F.when(F.col("exported"), boost).otherwise(0.0), 3)).select("snapshot", "id", "name", "exported", "score")


def normalised(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vec) of unit length; a vector of no length stays as it is, a null one drops out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(vector, lambda x: (x / F.when(norm > 0, norm).otherwise(F.lit(1.0))).cast("float"))
    return vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), unit.alias("vec"))


def _products(k: int):
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def pairwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, qids, qvecs in zip(*(batch.column(c).to_pylist() for c in ("ids", "vecs", "qids", "qvecs"))):
                width = max(1, len(vecs) // max(1, len(ids)))
                x = np.asarray(vecs, np.float64).reshape(len(ids), width)
                q = np.asarray(qvecs, np.float64).reshape(len(qids), width)
                ident, query = np.asarray(ids), np.asarray(qids)
                scores = q @ x.T
                scores[query[:, None] == ident[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ident, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                keep = best > 0
                rows = [np.repeat(query, order.shape[1])[keep.reshape(-1)], ident[order][keep], best[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], schema=schema)

    return pairwise


def _blocks(vectors: DataFrame, n: int, names: tuple[str, str, str]) -> DataFrame:
    key, ids, vecs = names
    cells = vectors.withColumn(key, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("x"))
    return cells.select(key, F.col("x.id").alias(ids), F.flatten("x.vec").alias(vecs))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, block: int = 2048) -> DataFrame:
    """(query, id, score, place): the k greatest cosines above 0 of each query with all others.

    Both sides are unit vectors (id, vec) and are cut into blocks of bounded size; a task
    multiplies one block of queries with one block of vectors and keeps k per query.
    """
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    asked = _blocks(queries, n_q, ("q", "qids", "qvecs"))
    held = _blocks(vectors, n_v, ("v", "ids", "vecs")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    best = held.join(asked, "q").select("ids", "vecs", "qids", "qvecs").mapInArrow(_products(k), "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("query", "id", F.round("score", 6).alias("score"), "place")


def cluster(embedding: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """(id, cluster): k-means on rows of unit length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="raw").transform(embedding)
    rows = Normalizer(inputCol="raw", outputCol="features").transform(rows)
    model = KMeans(k=k, seed=seed, maxIter=50, initSteps=5).fit(rows.select("id", "features"))
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def best_of(scored: DataFrame, n: int) -> DataFrame:
    """The n best rows of each snapshot by score, then id: cut per salt before they are ranked."""
    order = (F.desc("score"), F.asc("id"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    cut = salted.withColumn("place", F.row_number().over(Window.partitionBy("snapshot", "salt").orderBy(*order))).where(F.col("place") <= n).drop("salt", "place")
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("snapshot").orderBy(*order))).where(F.col("place") <= n)
