"""Checks and flat forms of results that have no oracle as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import dense as DN
from ..operators import topics as TP
from . import aggregates, joins  # noqa: F401  their queries' oracles are parts of the ones here
from . import derived as D
from .catalog import _ENTRIES, query
from .filters import dashboard_record


def _from(name: str) -> str:
    return f"({_ENTRIES[name].sql})"


@query("dashboard_rows", f"""
    SELECT 'metrics' AS part, 'total_users' AS name, users::DOUBLE AS number FROM {_from("dashboard_counts")}
    UNION ALL SELECT 'metrics', 'total_chunks', total_chunks FROM {_from("total_chunks")}
    UNION ALL SELECT 'metrics', 'cache_hit_rate', hit_rate FROM {_from("cache_hit_rate")}
    UNION ALL SELECT 'metrics', 'estimated_cost', estimated_cost FROM {_from("token_cost")}
    UNION ALL SELECT 'chart', day || ' input', input_tokens FROM {_from("tokens_7d")}
    UNION ALL SELECT 'chart', day || ' output', output_tokens FROM {_from("tokens_7d")}
    UNION ALL SELECT 'top_users', rank || ' ' || username, msg_count FROM {_from("top_users")}""")
def dashboard_rows(t):
    """The nested record as rows, one for every number in it."""
    record = dashboard_record(t)
    metrics = F.array(*[F.struct(F.lit("metrics").alias("part"), F.lit(c).alias("name"),
                                 F.col(f"metrics.{c}").cast("double").alias("number"))
                        for c in ("total_users", "total_chunks", "cache_hit_rate", "estimated_cost")])

    def listed(part, items, name, number):
        return F.transform(items, lambda x: F.struct(F.lit(part).alias("part"), name(x).alias("name"),
                                                     x[number].cast("double").alias("number")))

    chart = [listed("chart", F.col("chart"), lambda x, side=side: F.concat(x["day"].cast("string"), F.lit(f" {side}")),
                    f"{side}_tokens") for side in ("input", "output")]
    top = listed("top_users", F.col("top_users"), lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["username"]),
                 "msg_count")
    return record.select(F.inline(F.concat(metrics, *chart, top)))


@query("kmeans_topics_shape", f"""
    SELECT count(*) AS messages, true AS topics, true AS cheapest FROM msgs
    WHERE role = 'user' AND length(content) > {P.TOPIC_MIN_CHARS}""", ("msgs",))
def kmeans_topics_shape(t):
    """What must hold of the clustering: all messages in at most k topics, no dearer than its first fit."""
    m = TP.topic_messages(D.msgs(t)).select("message_id", "content")
    vectors = DN.hash_embed(m, "content", dim=64)
    rows, cost = TP.cluster(vectors)
    _, first = TP.cluster(vectors, n_init=1)
    return rows.agg(F.count("*").alias("messages"),
                    F.count_distinct("cluster").between(1, P.MAX_CLUSTERS).alias("topics"),
                    F.lit(bool(cost <= first * (1 + 1e-9))).alias("cheapest"))
