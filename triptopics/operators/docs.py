"""Passenger documents, vocabularies, bag-of-words and TF-IDF (A-10 ... A-15, V-01 ... V-05, J-03).

A passenger's document is the time-ordered list of its trips, each trip a
word triple (origin, destination, hour).  Documents are never collected
whole: the engine keeps them as

* ``doc_words(user_id, pos, o, d, t)``: one row per trip with its position,
  computed per (user, day-chunk) window plus a prefix sum over the chunks
  (no per-user window, so a traveller with a third of all trips stays
  parallel);
* ``doc_triples(user_id, o_id, d_id, t_id, cnt)``: the bag of distinct
  triples, which is all the topic models need and whose size per user is
  bounded by |stations|² × |hours| whatever the data volume.

Where the reference's list form is wanted (inspection, export) it is cut
into chunks of at most ``DOC_CHUNK`` words per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import token, triple_token
from ..functions.indexing import guarded_broadcast
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import chained_position

DOC_CHUNK = 1000
UNKNOWN_ID = -1


def doc_words(trips: DataFrame, order: list[str], ts_col: str = "ts") -> DataFrame:
    """One row per trip with its 0-based position in the user's timeline
    (per (user, day-chunk) windows plus a per-chunk prefix sum)."""
    return chained_position(trips, "user_id", order, "pos", ts_col)


def passenger_summary(trips: DataFrame, order: list[str]) -> DataFrame:
    """Per user: subtype (type of the first trip) and word count (A-10, A-13 input)."""
    o = F.struct(*[F.col(c) for c in order])
    return trips.groupBy("user_id").agg(
        F.min_by("txn_type", o).alias("subtype"),
        F.count(F.lit(1)).alias("wordcount"))


def passenger_docs(trips: DataFrame, order: list[str], chunk: int = DOC_CHUNK) -> DataFrame:
    """A-10: documents as token lists (``O12``, ``D7``, ``T8``) in time order,
    cut into chunks of ``chunk`` words, with subtype and word count."""
    w = doc_words(trips, order).withColumn("chunk", (F.col("pos") / chunk).cast("int"))
    parts = w.groupBy("user_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct(
            "pos", token("O", "origin").alias("o"), token("D", "dest").alias("d"),
            token("T", "hour").alias("t")))).alias("_w"))
    docs = parts.select(
        "user_id", "chunk",
        F.transform("_w", lambda x: x["o"]).alias("o"),
        F.transform("_w", lambda x: x["d"]).alias("d"),
        F.transform("_w", lambda x: x["t"]).alias("t"))
    docs = docs.withColumn("chunk_words", F.size("o"))          # P-11
    return docs.join(passenger_summary(trips, order), "user_id")


def doc_triples(trips: DataFrame, o: str = "origin", d: str = "dest", t: str = "hour") -> DataFrame:
    """Bag of distinct (o, d, t) triples per user with counts."""
    return trips.groupBy("user_id", F.col(o).alias("o"), F.col(d).alias("d"), F.col(t).alias("t")).agg(
        F.count(F.lit(1)).alias("cnt"))


def flat_tokens(user_tensor: DataFrame) -> DataFrame:
    """A-11/A-12: the flat ``O#_D#_T#`` document of each user as (token, count)
    from the user tensor COO; ``explode(array_repeat)`` gives the word list."""
    return user_tensor.select(
        "user_id", triple_token("origin", "dest", "bin").alias("token"),
        F.col("value").cast("bigint").alias("cnt"))


def repeat_words(bow: DataFrame, tok: str = "token", cnt: str = "cnt") -> DataFrame:
    """P-10: one row per word occurrence."""
    return bow.select("user_id", F.explode(F.array_repeat(F.col(tok), F.col(cnt).cast("int"))).alias(tok))


# ---- vocabularies ---------------------------------------------------------

def station_vocab(trips: DataFrame) -> DataFrame:
    """One station vocabulary for origins and destinations (Q3), ids dense by
    station number; hours get their own.  Both tables are bounded by the
    network size, so the ranking windows over them are small."""
    st = (trips.select(F.col("origin").alias("value")).union(trips.select(F.col("dest").alias("value")))
          .distinct().withColumn("dim", F.lit("S")))
    hr = trips.select(F.col("hour").alias("value")).distinct().withColumn("dim", F.lit("T"))
    both = st.unionByName(hr)
    return both.withColumn("id", (F.dense_rank().over(Window.partitionBy("dim").orderBy("value")) - 1)
                           .cast("int"))


def vocab(trips: DataFrame) -> DataFrame:
    """V-01: per dimension (O, D, T): token, dense id, document and collection frequency."""
    ids = station_vocab(trips)
    parts = []
    for dim, col, space in (("O", "origin", "S"), ("D", "dest", "S"), ("T", "hour", "T")):
        f = trips.groupBy(F.col(col).alias("value")).agg(
            F.countDistinct("user_id").alias("doc_freq"), F.count(F.lit(1)).alias("coll_freq"))
        v = ids.filter(F.col("dim") == space).select("value", "id")
        parts.append(f.join(v, "value").select(
            F.lit(dim).alias("dim"), token(dim, "value").alias("token"), "value", "id", "doc_freq", "coll_freq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_corpus(trips: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """J-03 (``doc2idx``): positions with o/d/t ids; tokens missing from the
    vocabulary map to -1 (left join + coalesce)."""
    w = doc_words(trips, order)
    ensure_checkpoint_dir(ids.sparkSession)
    ids = ids.select("dim", "value", "id").checkpoint()         # one small table, filtered twice
    n = ids.count()
    st = guarded_broadcast(ids.filter(F.col("dim") == "S").select("value", "id"), n)
    hr = guarded_broadcast(ids.filter(F.col("dim") == "T").select("value", "id"), n)
    j = (w.join(st.select(F.col("value").alias("origin"), F.col("id").alias("o_id")), "origin", "left")
          .join(st.select(F.col("value").alias("dest"), F.col("id").alias("d_id")), "dest", "left")
          .join(hr.select(F.col("value").alias("hour"), F.col("id").alias("t_id")), "hour", "left"))
    return j.select("user_id", "pos",
                    *[F.coalesce(F.col(c), F.lit(UNKNOWN_ID)).alias(c) for c in ("o_id", "d_id", "t_id")])


def word_freq(trips: DataFrame) -> DataFrame:
    """A-14/A-15: collection frequency of each token and the corpus total."""
    v = vocab(trips).select("dim", "token", "coll_freq")
    return v.withColumn("total_tokens", F.sum("coll_freq").over(Window.partitionBy("dim")))


# ---- text documents (flat LDA / TF-IDF path) ------------------------------

def text_tokens(documents: DataFrame, text: str = "text", key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """``split(lower(text), ' ')`` counted per document: (doc_id, token, tf) and the ``carried`` columns of the document.

    The texts are shuffled once, by document, and their words counted where they arrive: what is counted,
    joined or ranked per document behind needs no shuffle of (document, word) rows, which take several times the texts."""
    documents = documents.select(key, text, *carried).repartition(key)
    words = documents.select(key, *carried, F.explode(F.split(F.lower(F.col(text)), " ")).alias("token"))
    # explicit (split never yields NULL): keeps every use of this subplan identical, so
    # AQE can reuse one shuffle when the counts feed both the vocabulary and a join
    words = words.filter(F.col("token").isNotNull())
    return words.groupBy(key, "token", *carried).agg(F.count(F.lit(1)).alias("tf"))


def pruned_vocab(tf: DataFrame, n_docs: Column | int, no_below: int = 3, no_above: float = 0.5,
                 keep_n: int = 100_000, key: str = "doc_id") -> DataFrame:
    """V-02: keep tokens with doc_freq >= no_below and <= floor(no_above * N),
    then the ``keep_n`` most frequent (ties by token); ids dense by token.

    ``keep_n`` bounds the result, so the final ordering runs over a bounded
    top-k (TakeOrderedAndProject) and the id window over at most keep_n rows.
    """
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("coll_freq"))
    limit = F.floor(F.lit(no_above) * (n_docs if isinstance(n_docs, Column) else F.lit(n_docs)))
    kept = df.filter((F.col("doc_freq") >= no_below) & (F.col("doc_freq") <= limit))
    top = kept.orderBy(F.desc("doc_freq"), "token").limit(keep_n)
    return top.withColumn("id", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))


def bag_of_words(tf: DataFrame, vocabulary: DataFrame, key: str = "doc_id", vocab_bound: int | None = None) -> DataFrame:
    """V-03/V-05: (doc, id, tf) against a fixed vocabulary; unknown tokens dropped.

    ``vocab_bound`` (e.g. ``keep_n`` of a pruned vocabulary) lets the
    vocabulary be broadcast without a size job."""
    v = guarded_broadcast(vocabulary.select("token", "id"), vocab_bound)
    return tf.join(v, "token").select(key, "id", "tf")


def tfidf(bow: DataFrame, vocabulary: DataFrame, n_docs: int, key: str = "doc_id",
          vocab_bound: int | None = None) -> DataFrame:
    """V-04: ``tf * log2(N / df)`` then L2-normalised per document; zero weights dropped.

    ``bow`` is either (doc, id, tf) or token counts (doc, token, tf); the
    vocabulary side is joined once and the norm is a window over the
    document (at most one row per vocabulary entry), not a second join.
    """
    on = "id" if "id" in bow.columns else "token"
    v = guarded_broadcast(vocabulary.select("token", "id", "doc_freq"), vocab_bound)
    raw = bow.join(v, on).withColumn("w", F.col("tf") * F.log2(F.lit(float(n_docs)) / F.col("doc_freq")))
    raw = raw.filter(F.abs(F.col("w")) > 1e-12)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "id", (F.col("w") / norm).alias("weight"))
