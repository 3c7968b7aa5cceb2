"""Usage, cost and activity figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import numeric as N


def user_message_counts(users: DataFrame, sessions: DataFrame, msgs: DataFrame,
                        role: str = "user") -> DataFrame:
    """(username, msg_count). Messages are counted per session before any join,
    so the joins carry one row per session and a busy session is no hot key."""
    per_session = (msgs.filter(F.col("role") == role).groupBy("session_id")
                   .agg(F.count("*").alias("n")))
    per_user = (per_session.join(sessions, "session_id").groupBy("user_id")
                .agg(F.sum("n").alias("n")))
    return (per_user.join(users.select("id", "username"), F.col("user_id") == F.col("id"))
            .groupBy("username").agg(F.sum("n").alias("msg_count")))


def top_users(users, sessions, msgs, k: int = 5) -> DataFrame:
    top = (user_message_counts(users, sessions, msgs)
           .orderBy(F.desc("msg_count"), "username").limit(k))
    rank = F.row_number().over(W.orderBy(F.desc("msg_count"), "username"))  # k rows
    return top.withColumn("rank", rank)


def user_query_counts(sessions: DataFrame, msgs: DataFrame) -> DataFrame:
    per_session = (msgs.filter(F.col("role") == "user").groupBy("session_id")
                   .agg(F.count("*").alias("n")))
    return (sessions.join(per_session, "session_id", "left").groupBy("user_id")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("query_count")))


def user_profile(users: DataFrame, sessions: DataFrame, msgs: DataFrame, now: Column) -> DataFrame:
    days = F.greatest(N.whole_days(now, F.col("created_at")), F.lit(1).cast("bigint"))
    q = user_query_counts(sessions, msgs)
    return (users.join(q, F.col("id") == F.col("user_id"), "left")
            .select("id", days.alias("join_days"),
                    F.coalesce("query_count", F.lit(0)).cast("bigint").alias("query_count")))


def daily_tokens(msgs: DataFrame) -> DataFrame:
    """(day, input_tokens, output_tokens) of all days that have messages."""
    est = N.token_estimate(F.col("content"))
    return (msgs.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.coalesce(F.sum(F.when(F.col("role") == "user", est)), F.lit(0))
                 .cast("bigint").alias("input_tokens"),
                 F.coalesce(F.sum(F.when(F.col("role") == "ai", est)), F.lit(0))
                 .cast("bigint").alias("output_tokens")))


def recent(msgs: DataFrame, now: Column, days: int = 7, ts: str = "created_at") -> DataFrame:
    return msgs.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def tokens_last_days(msgs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """One row per labelled day ending today; the day before the first label is not charted."""
    spine = msgs.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(F.to_date(now), days - 1), F.to_date(now))).alias("day"))
    per_day = daily_tokens(recent(msgs, now, days))
    return (spine.join(per_day, "day", "left")
            .select(F.date_format("day", "MM-dd").alias("day"),
                    F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"),
                    F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens")))


def token_cost(per_day: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).cast("bigint")
    return (per_day.agg(total.alias("total_tokens"))
            .select("total_tokens",
                    N.round_even(F.col("total_tokens") / F.lit(1000.0) * F.lit(P.PRICE_PER_1K), 4)
                    .alias("estimated_cost")))


def cache_hit_rate(metrics: DataFrame, is_hit: Column) -> DataFrame:
    return (metrics.agg(F.count("*").alias("queries"), F.count_if(is_hit).alias("hits"))
            .select("queries", "hits",
                    N.rate_percent(F.col("hits"), F.col("queries")).alias("hit_rate")))


def total_chunks(docs: DataFrame) -> DataFrame:
    return docs.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("total_chunks"))


def answer_stats(records: DataFrame) -> DataFrame:
    return (records.groupBy("user_id")
            .agg(F.count("*").alias("total"),
                 F.count_if("is_correct").alias("correct_count"))
            .select("user_id", "total", "correct_count",
                    N.rate_percent(F.col("correct_count"), F.col("total")).alias("correct_rate")))


def score_band(score: Column) -> Column:
    return (F.when(score == 100, "perfect").when(score >= 80, "excellent")
            .when(score >= 60, "pass").otherwise("fail"))


def record(users: DataFrame, sessions: DataFrame, msgs: DataFrame, docs: DataFrame,
           metrics: DataFrame, is_hit: Column, now: Column) -> DataFrame:
    """The dashboard as one nested row: metrics, chart, top users (all parts are bounded)."""
    chart = tokens_last_days(msgs, now)
    cost = token_cost(chart)
    days = chart.agg(F.sort_array(F.collect_list(F.struct("day", "input_tokens", "output_tokens")))
                     .alias("c"))
    top = top_users(users, sessions, msgs).agg(
        F.sort_array(F.collect_list(F.struct("rank", "username", "msg_count"))).alias("t"))
    rate = cache_hit_rate(metrics, is_hit)
    return msgs.sparkSession.range(1).select(
        F.struct(
            users.agg(F.count("*")).scalar().alias("total_users"),
            total_chunks(docs).scalar().alias("total_chunks"),
            rate.select("hit_rate").scalar().alias("cache_hit_rate"),
            cost.select("estimated_cost").scalar().alias("estimated_cost")).alias("metrics"),
        days.scalar().alias("chart"), top.scalar().alias("top_users"))
