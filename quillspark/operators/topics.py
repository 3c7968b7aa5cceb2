"""Topic mining over user messages."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import params as P
from ..functions import jsonx as J
from ..session import written
from ..sources.schemas import TOPIC_JSON
from .ranking import top_n


def topic_messages(msgs: DataFrame) -> DataFrame:
    return msgs.filter((F.col("role") == "user") & (F.length("content") > P.TOPIC_MIN_CHARS))


def cluster(vectors: DataFrame, k: int = P.MAX_CLUSTERS, n_init: int = P.TOPIC_N_INIT,
            seed: int = P.TOPIC_SEED, min_samples: int = P.TOPIC_MIN_SAMPLES,
            max_iter: int = 20, parallel_fits: int = 5):
    """(..., v) -> (clustered rows, cost), the cheapest of ``n_init`` seeded fits.

    Returns None when there are too few rows to cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    n = feats.count()
    if n < min_samples:
        feats.unpersist()
        return None

    def fit(i: int):
        model = KMeans(k=min(k, n), seed=seed + i, maxIter=max_iter).fit(feats)
        return model.summary.trainingCost, i, model

    # the fits are independent chains of small jobs: run them side by side
    with ThreadPool(parallel_fits) as pool:
        cost, _, model = min(pool.map(inheritable_thread_target(feats.sparkSession)(fit),
                                      range(n_init)), key=lambda r: r[:2])
    out = model.transform(feats).withColumnRenamed("prediction", "cluster").drop("features")
    out = written(out)
    feats.unpersist()
    return out, cost


def representatives(clustered: DataFrame, order: list, n: int = P.TOPIC_REPRESENTATIVES,
                    value: str = "content") -> DataFrame:
    """(cluster, hit_count, first ``n`` values). Only ``n`` rows per cluster are gathered."""
    first = top_n(clustered, ["cluster"], order, n, "rn")
    lists = (first.groupBy("cluster")
             .agg(F.sort_array(F.collect_list(F.struct("rn", value))).alias("xs"))
             .select("cluster", F.transform("xs", lambda x: x[value]).alias("representative_queries")))
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("hit_count"))
    return sizes.join(lists, "cluster")


def prompts(clustered: DataFrame, order: list, n: int = P.TOPIC_PROMPT_MESSAGES,
            value: str = "content") -> DataFrame:
    reps = representatives(clustered, order, n, value)
    return reps.select("cluster", F.array_join("representative_queries", "\n").alias("prompt"))


def parse_label(response: Column, index: Column) -> Column:
    """Struct(topic_name, keywords) of a labelling response, with the defaults for
    missing fields and for responses that hold no JSON object."""
    obj = J.embedded_object(response)
    parsed = F.from_json(obj, TOPIC_JSON)
    # a broken object parses to nulls only; tell it from an object without the fields
    ok = (obj != "") & F.get_json_object(obj, "$").isNotNull()
    words = [F.array(*map(F.lit, w)) for w in (P.TOPIC_DEFAULT_KEYWORDS, P.TOPIC_FAILED_KEYWORDS)]
    return F.struct(
        F.when(ok, F.coalesce(parsed["topic_name"], F.lit(P.TOPIC_DEFAULT_NAME)))
        .otherwise(F.concat(F.lit(P.TOPIC_FAILED_NAME), (index + 1).cast("string")))
        .alias("topic_name"),
        F.when(ok, F.coalesce(parsed["keywords"], words[0])).otherwise(words[1]).alias("keywords"))


def topic_rows(clustered: DataFrame, labels: DataFrame, order: list) -> DataFrame:
    """Rows of the topic table: label (cluster, response), size and representatives."""
    reps = representatives(clustered, order)
    label = parse_label(F.col("response"), F.col("cluster"))
    return (reps.join(labels, "cluster", "left").withColumn("l", label)
            .select("cluster", F.col("l.topic_name").alias("topic_name"),
                    F.col("l.keywords").alias("keywords"), "hit_count", "representative_queries"))
