"""Model evaluation on long tables (O-07, O-14, O-15, W-07, W-09, W-10, G-05, G-06).

Model tables are ``beta(topic, word, p)`` (probabilities, one dimension at
a time) and ``theta(user_id, topic, p)``; both are model-sized or keyed
by user, so every metric is joins and grouped sums that Catalyst plans
with broadcast model sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import guarded_broadcast

LOG_ZERO = -100.0


def beta_from_counts(counts: DataFrame, topic: str, word: str, value: str = "n") -> DataFrame:
    """O-07 on a count table: logp = ln(count) - ln(topic total); counts <= 0 give -100."""
    total = F.sum(value).over(Window.partitionBy(topic))
    return counts.select(
        F.col(topic).alias("topic"), F.col(word).alias("word"),
        F.when(F.col(value) > 0, F.log(F.col(value)) - F.log(total)).otherwise(F.lit(LOG_ZERO)).alias("logp"))


def top_words(beta: DataFrame, r: int, by: list[str] | tuple = ()) -> DataFrame:
    """W-07: the ``r`` most probable words per topic (per ``by`` group, e.g. dimension).

    ``rank`` 1 is the most probable; ties go to the higher word id, which
    is what taking the tail of a stable ascending sort gives.  Spark plans
    the rank filter as a per-group limit applied before the shuffle.
    """
    w = Window.partitionBy(*by, "topic").orderBy(F.desc("p"), F.desc("word"))
    return beta.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= r)


def topic_coherence(beta: DataFrame, words: DataFrame, r: int = 10, epsilon: float = 1.0,
                    by: list[str] | tuple = ()) -> DataFrame:
    """O-15: UMass-style coherence with token counts (Q17).

    For each topic, its top-``r`` words w_1..w_r in ascending probability
    order, and every pair (w_i, w_j), j < i:
    ``Σ log((cofreq(w_i, w_j) + ε) / freq(w_j))`` over pairs with freq > 0,
    where freq(w) = Σ_u c_u(w) and cofreq(a, b) = Σ_u c_u(a)·c_u(b).

    ``words(user_id, [by...], word, cnt)`` is the bag of words.  The
    co-frequencies come from a self-join on (user, topic) restricted to
    the topic's top words, so each join key holds at most ``r`` rows.
    """
    by = list(by)
    top = top_words(beta, r, by).select(*by, "topic", "word", (F.lit(r + 1) - F.col("rank")).alias("pos"))
    top_b = guarded_broadcast(top)
    per_user = words.groupBy("user_id", *by, "word").agg(F.sum("cnt").alias("c"))
    hit = per_user.join(top_b, [*by, "word"])
    freq = hit.groupBy(*by, "topic", "word").agg(F.sum("c").alias("freq"))
    a = hit.select("user_id", *by, "topic", F.col("word").alias("w1"), F.col("pos").alias("p1"), F.col("c").alias("c1"))
    b = hit.select("user_id", *by, "topic", F.col("word").alias("w2"), F.col("pos").alias("p2"), F.col("c").alias("c2"))
    co = (a.join(b, ["user_id", *by, "topic"]).filter(F.col("p2") < F.col("p1"))
          .groupBy(*by, "topic", "w1", "w2").agg(F.sum(F.col("c1") * F.col("c2")).alias("cofreq")))
    t1 = top.select(*by, "topic", F.col("word").alias("w1"), F.col("pos").alias("p1"))
    t2 = top.select(*by, "topic", F.col("word").alias("w2"), F.col("pos").alias("p2"))
    pairs = t1.join(t2, [*by, "topic"]).filter(F.col("p2") < F.col("p1")).select(*by, "topic", "w1", "w2")
    scored = (pairs.join(co, [*by, "topic", "w1", "w2"], "left")
              .join(freq.withColumnRenamed("word", "w2"), [*by, "topic", "w2"], "left")
              .filter(F.col("freq") > 0)
              .withColumn("term", F.log((F.coalesce("cofreq", F.lit(0)) + F.lit(epsilon)) / F.col("freq"))))
    topics = beta.select(*by, "topic").distinct()
    return topics.join(scored.groupBy(*by, "topic").agg(F.sum("term").alias("coherence")), [*by, "topic"],
                       "left").select(*by, "topic", F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def perplexity(words: DataFrame, theta_counts: DataFrame, beta: DataFrame, alpha: float,
               n_topics: int, by: list[str] | tuple = ()) -> DataFrame:
    """O-14: exp(-Σ log(Σ_z β[z,w] θ_uz + 1e-6) / Σ_u W_u), θ_uz = count_uz / (W_u + Z·α).

    ``words(user_id, [by...], word, cnt)``; ``theta_counts(user_id, [by...], topic, count)``
    (``by`` columns optional there); ``beta([by...], topic, word, p)``.  Word
    scores are formed per distinct (user, word) with the model side broadcast.
    """
    by = list(by)
    wsum = words.groupBy("user_id", *by).agg(F.sum("cnt").alias("W"))
    on = ["user_id"] + [c for c in by if c in theta_counts.columns]
    th = theta_counts.join(wsum, on).select(
        "user_id", *by, "topic", (F.col("count") / (F.col("W") + F.lit(n_topics * alpha))).alias("th"))
    pw = words.groupBy("user_id", *by, "word").agg(F.sum("cnt").alias("cnt"))
    bt = guarded_broadcast(beta.select(*by, "topic", "word", "p"))
    score = (pw.join(th, ["user_id", *by]).join(bt, [*by, "topic", "word"])
             .groupBy("user_id", *by, "word").agg(F.sum(F.col("p") * F.col("th")).alias("s")))
    # words whose β is zero in every topic of the user still count, with score 0
    full = pw.join(score, ["user_id", *by, "word"], "left")
    agg = full.groupBy(*by).agg(
        F.sum(F.col("cnt") * F.log(F.coalesce("s", F.lit(0.0)) + F.lit(1e-6))).alias("ll"), F.sum("cnt").alias("n"))
    return agg.select(*by, F.exp(-F.col("ll") / F.col("n")).alias("perplexity"), F.col("n").alias("n_words"))


def topic_similarity(beta_a: DataFrame, beta_b: DataFrame) -> DataFrame:
    """J-05/G-05: cosine similarity of every topic of A with every topic of B.

    An equi-join on the word id with one partial sum per (topic_a, topic_b);
    both sides are topics × vocabulary (model-sized).
    """
    a = beta_a.select(F.col("topic").alias("topic_a"), "word", F.col("p").alias("pa"))
    b = beta_b.select(F.col("topic").alias("topic_b"), "word", F.col("p").alias("pb"))
    dot = a.join(b, "word").groupBy("topic_a", "topic_b").agg(F.sum(F.col("pa") * F.col("pb")).alias("dot"))
    na = a.groupBy("topic_a").agg(F.sqrt(F.sum(F.col("pa") * F.col("pa"))).alias("na"))
    nb = b.groupBy("topic_b").agg(F.sqrt(F.sum(F.col("pb") * F.col("pb"))).alias("nb"))
    return dot.join(na, "topic_a").join(nb, "topic_b").select(
        "topic_a", "topic_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("sim"))


def topic_match(sim: DataFrame) -> DataFrame:
    """W-09/G-05: best topic of B for each topic of A (ties -> lowest id)."""
    return sim.groupBy("topic_a").agg(
        F.min_by("topic_b", F.struct(-F.col("sim"), F.col("topic_b"))).alias("match"),
        F.max("sim").alias("sim"))


def reorder_topics(beta_b: DataFrame, match: DataFrame) -> DataFrame:
    """G-06: B's topics renumbered to the A topic they match."""
    m = match.select(F.col("topic_a").alias("new_topic"), F.col("match").alias("topic"))
    return beta_b.join(m, "topic").drop("topic").withColumnRenamed("new_topic", "topic")


def passenger_pattern(theta: DataFrame, J: int, K: int, L: int) -> DataFrame:
    """W-10: (O, D, T) topic of each passenger's largest θ cell (ties -> lowest j, k, l).

    ``theta(user_id, theta array)`` holds the J·K·L mixture j-major.
    """
    arr = F.col("theta")
    best = F.array_position(arr, F.array_max(arr)) - 1
    return theta.select("user_id", best.alias("_c")).select(
        "user_id", (F.col("_c") / (K * L)).cast("int").alias("o_topic"),
        ((F.col("_c") / L).cast("int") % K).alias("d_topic"),
        (F.col("_c") % L).cast("int").alias("t_topic"))


def theta_long(theta: DataFrame) -> DataFrame:
    """θ arrays to ``(user_id, cell, p)``."""
    return theta.select("user_id", F.posexplode("theta").alias("cell", "p"))
