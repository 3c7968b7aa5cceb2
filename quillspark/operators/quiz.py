"""Quiz: building questions, picking them for users, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import jsonx as J
from ..functions import text as X
from ..functions.arrays import stable_hash
from ..session import written
from ..sources.schemas import QUIZ_JSON
from .ranking import global_rank, sample_n, top_n



def _letter(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in P.QUIZ_LETTERS]), index)


def shuffle_options(options: Column, answer: Column, seed: str | int) -> Column:
    """Struct(options, correct_answer, matched): options in hash order, lettered anew.

    The right text is that of the first option that starts with the given
    letter. If several options carry it the last letter wins; if none does the
    letter is A and ``matched`` is false.
    """
    first = F.get(F.filter(options, lambda o: F.startswith(o, answer)), 0)
    right = F.coalesce(X.strip_option_prefix(first), F.lit(""))
    texts = F.transform(options, X.strip_option_prefix)
    order = F.array_sort(F.transform(texts, lambda x, i: F.struct(
        F.md5(F.concat(x, F.lit(f"#{seed}"))).alias("h"), i.alias("i"), x.alias("x"))))
    shuffled = F.transform(order, lambda s: s["x"])
    hit = F.array_max(F.transform(shuffled, lambda x, i: F.when(x == right, i + 1)))
    return F.struct(
        F.transform(shuffled, lambda x, i: F.concat(_letter(i + 1), F.lit(". "), x)).alias("options"),
        F.when(hit.isNull(), "A").otherwise(_letter(hit)).alias("correct_answer"),
        hit.isNotNull().alias("matched"))


def difficulty(key: Column, seed: str | int) -> Column:
    """Uniform integer between the two bounds, fixed by the key."""
    span = P.QUIZ_MAX_DIFFICULTY - P.QUIZ_MIN_DIFFICULTY + 1
    digits = F.conv(F.substring(stable_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return (F.lit(P.QUIZ_MIN_DIFFICULTY) + F.pmod(digits, F.lit(span))).cast("int")


def build_questions(raw: DataFrame, seed: str | int = "quiz") -> DataFrame:
    """(id, response) -> questions; malformed responses and more than four options are skipped."""
    q = (raw.select("id", F.from_json(J.embedded_object(F.col("response")), QUIZ_JSON).alias("q"))
         .select("id", "q.*")
         .dropna(subset=["content", "options", "correct_answer", "explanation"])
         .filter((F.size("options") > 0) & (F.size("options") <= len(P.QUIZ_LETTERS))))
    answer = F.upper(X.strip(F.col("correct_answer")))
    return (q.withColumn("s", shuffle_options(F.col("options"), answer, seed))
            .select("id", "content", F.col("s.options").alias("options"),
                    F.col("s.correct_answer").alias("correct_answer"),
                    F.col("s.matched").alias("matched"), "explanation",
                    difficulty(F.col("id"), seed).alias("difficulty")))


def sample_input(chunks: DataFrame, seed: str | int = "quiz") -> DataFrame:
    """Long enough chunks of a few sampled documents, at most the wanted number."""
    picked = sample_n(chunks.select("doc_id").distinct(), "doc_id", P.QUIZ_DOCS, seed)
    usable = (chunks.join(F.broadcast(picked), "doc_id")  # QUIZ_DOCS rows
              .filter(F.length("text") > P.QUIZ_MIN_CHARS))
    keyed = usable.withColumn("k", F.concat_ws("-", "doc_id", "chunk_idx"))
    return sample_n(keyed, "k", P.QUIZ_COUNT, seed).drop("k")


def grade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answer log -> records; answers to unknown questions are dropped."""
    key = questions.select(F.col("id").alias("question_id"), "correct_answer")
    return answers.join(key, "question_id").withColumn(
        "is_correct", F.upper("user_answer") == F.upper("correct_answer"))


def unanswered(users: DataFrame, questions: DataFrame, answers: DataFrame,
               n: int = P.QUIZ_COUNT, seed: str | int = "daily", block: int = 16) -> DataFrame:
    """(user_id, question_id, pos): each user's first ``n`` unseen questions in one hash order.

    Users never meet the whole question bank. The bank is cut into blocks of
    consecutive ranks; per user only the number of answers in each block is
    needed to find the few blocks that hold the first unseen questions: answered
    blocks that are not full, up to the point where they yield ``n`` on their
    own, and the first blocks nothing was answered in.
    """
    # each of these three feeds several branches
    ranked = written(global_rank(questions.select(F.col("id").alias("question_id")), "question_id", seed)
                     .withColumn("blk", F.floor((F.col("rank") - 1) / block)))
    seen = written(answers.select("user_id", "question_id").distinct().join(ranked, "question_id"))
    per_block = seen.groupBy("user_id", "blk").agg(F.count("*").alias("a"))
    sizes = ranked.groupBy("blk").agg(F.count("*").alias("size"))
    by_block = W.partitionBy("user_id").orderBy("blk")
    state = written(per_block.join(sizes, "blk").withColumn("open", F.col("size") - F.col("a"))
                    .withColumn("open_before", F.coalesce(F.sum("open").over(
                        by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    part_open = (state.filter((F.col("open") > 0) & (F.col("open_before") < n))
                 .select("user_id", "blk"))
    # untouched blocks: gaps in the sequence of touched ones, then what follows the last
    touched = state.select("user_id", "blk", F.coalesce(
        F.lag("blk").over(by_block), F.lit(-1)).alias("prev"))
    gap_first = touched.filter(F.col("blk") - F.col("prev") > 1).select(
        "user_id", (F.col("prev") + 1).alias("lo"), (F.col("blk") - 1).alias("hi"))
    after = users.select("user_id").join(
        state.groupBy("user_id").agg(F.max("blk").alias("last")), "user_id", "left").select(
        "user_id", (F.coalesce("last", F.lit(-1)) + 1).alias("lo"), F.lit(2 ** 40).alias("hi"))
    need = -(-n // block) + 1  # blocks that hold n questions, plus one for a short last block
    gaps = top_n(gap_first.unionByName(after), ["user_id"], ["lo"], need, "_g")
    fresh = gaps.select("user_id", F.explode(F.sequence(
        F.col("lo"), F.least(F.col("hi"), F.col("lo") + need - 1))).alias("blk"))
    wanted = (part_open.join(users.select("user_id"), "user_id", "left_semi")
              .unionByName(fresh.join(users.select("user_id"), "user_id", "left_semi")).distinct())
    pool = (wanted.join(ranked, "blk")
            .join(seen.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti"))
    return top_n(pool, ["user_id"], ["rank"], n, "pos").select("user_id", "question_id", "pos")


def review_pool(users: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct questions of the bank that each user has answered."""
    ids = questions.select(F.col("id").alias("question_id"))
    return (answers.select("user_id", "question_id").distinct()
            .join(users.select("user_id"), "user_id", "left_semi")
            .join(ids, "question_id", "left_semi"))


def daily_pick(users: DataFrame, questions: DataFrame, answers: DataFrame,
               n: int = P.QUIZ_COUNT, seed: str | int = "daily") -> DataFrame:
    """Up to ``n`` unseen questions per user, topped up with answered ones.

    If both pools are empty the bank itself is empty, so the third pool of "any
    questions" never adds a row.
    """
    new = unanswered(users, questions, answers, n, seed).select(
        "user_id", "question_id", F.lit(0).alias("pool"), F.col("pos").alias("o"))
    old = review_pool(users, questions, answers).withColumn(
        "h", stable_hash(F.col("question_id"), seed))
    old = top_n(old, ["user_id"], ["h", "question_id"], n, "o").select(
        "user_id", "question_id", F.lit(1).alias("pool"), "o")
    return top_n(new.unionByName(old), ["user_id"], ["pool", "o"], n, "pos").select(
        "user_id", "question_id", "pool", "pos")
