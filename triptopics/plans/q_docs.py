"""Queries of build step 3: passenger documents, vocabularies, BoW and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as dc
from ..operators import flow
from ..operators import trips as tr
from ..session import table
from ..sources.fixtures import TRIPS_SQL, trips
from .catalog import query, with_views

T = {"trips": TRIPS_SQL}
ORDER = ["ts", "event_id"]
TRAIN_FRACTION = 0.8
# Vocabulary pruning of the reference's flat LDA (fixed values)
NO_BELOW, NO_ABOVE, KEEP_N = 3, 0.5, 100_000

TRAIN_USERS_SQL = """SELECT user_id FROM (SELECT DISTINCT user_id FROM trips)
QUALIFY ROW_NUMBER() OVER (ORDER BY user_id) <= FLOOR(0.8 * COUNT(*) OVER ())"""


def train_users(spark, sf):
    users = trips(spark, sf).select("user_id").distinct()
    n_train = int(users.count() * TRAIN_FRACTION)
    return tr.train_test_split(users, n_train).filter(F.col("split") == "train").select("user_id")


LONG_DOC_WORDS = 50          # the stand-in travellers make fewer trips than a two-month cohort


@query("passenger_docs", with_views("""
SELECT g.user_id, g.chunk, s.subtype, s.wordcount, g.o, g.d, g.t, g.chunk_words FROM (
  SELECT user_id, CAST((rn - 1) // 1000 AS INT) AS chunk, CAST(COUNT(*) AS INT) AS chunk_words,
         string_agg('O' || origin, ' ' ORDER BY rn) AS o,
         string_agg('D' || dest, ' ' ORDER BY rn) AS d,
         string_agg('T' || hour, ' ' ORDER BY rn) AS t
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM trips)
  GROUP BY 1, 2) g
JOIN (SELECT user_id, arg_min(txn_type, (ts, event_id)) AS subtype, COUNT(*) AS wordcount
      FROM trips GROUP BY 1) s ON g.user_id = s.user_id""", **T), ("A-10", "P-05", "A-13"))
def q_passenger_docs(spark, sf):
    d = dc.passenger_docs(trips(spark, sf), ORDER)
    return d.select("user_id", "chunk", "subtype", "wordcount",
                    *[F.concat_ws(" ", c).alias(c) for c in ("o", "d", "t")], "chunk_words")


@query("long_docs", with_views(f"""
SELECT user_id, arg_min(txn_type, (ts, event_id)) AS subtype, COUNT(*) AS wordcount
FROM trips GROUP BY 1 HAVING COUNT(*) >= {LONG_DOC_WORDS}""", **T), ("P-08", "A-13"))
def q_long_docs(spark, sf):
    """Documents long enough for the online learner."""
    return dc.passenger_summary(trips(spark, sf), ORDER).filter(F.col("wordcount") >= LONG_DOC_WORDS)


@query("doc_words", with_views("""
SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
       'O' || origin AS o, 'D' || dest AS d, 'T' || hour AS t
FROM trips""", **T), ("A-10", "P-05"))
def q_doc_words(spark, sf):
    w = dc.doc_words(trips(spark, sf), ORDER)
    return w.select("user_id", "pos", dc.token("O", "origin").alias("o"),
                    dc.token("D", "dest").alias("d"), dc.token("T", "hour").alias("t"))


@query("doc_triples", with_views("""
SELECT user_id, origin AS o, dest AS d, hour AS t, COUNT(*) AS cnt FROM trips GROUP BY 1, 2, 3, 4""", **T),
    ("A-11",))
def q_doc_triples(spark, sf):
    return dc.doc_triples(trips(spark, sf))


@query("flat_tokens", with_views("""
SELECT user_id, 'O' || origin || '_D' || dest || '_T' || bin AS token, COUNT(*) AS cnt FROM (
  SELECT user_id, origin, dest, CAST(CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT) // 7 AS INT) AS bin
  FROM trips WHERE ((HOUR(ts) - 5) % 24 + 24) % 24 < 21)
GROUP BY 1, 2""", **T), ("A-11", "A-12", "P-06", "P-10"))
def q_flat_tokens(spark, sf):
    return dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7))


@query("flat_doc_words", with_views("""
SELECT user_id, 'O' || origin || '_D' || dest || '_T' || CAST(CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT) // 7 AS INT)
       AS token
FROM trips WHERE ((HOUR(ts) - 5) % 24 + 24) % 24 < 21""", **T), ("P-10", "A-11"))
def q_flat_doc_words(spark, sf):
    return dc.repeat_words(dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7)))


@query("vocab", with_views("""
SELECT f.dim, f.dim || f.value AS token, f.value, v.id, f.doc_freq, f.coll_freq FROM (
  SELECT 'O' AS dim, origin AS value, 'S' AS space, COUNT(DISTINCT user_id) AS doc_freq, COUNT(*) AS coll_freq FROM trips GROUP BY 2
  UNION ALL
  SELECT 'D', dest, 'S', COUNT(DISTINCT user_id), COUNT(*) FROM trips GROUP BY 2
  UNION ALL
  SELECT 'T', hour, 'T', COUNT(DISTINCT user_id), COUNT(*) FROM trips GROUP BY 2) f
JOIN (
  SELECT 'S' AS space, value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INT) AS id
  FROM (SELECT origin AS value FROM trips UNION SELECT dest FROM trips)
  UNION ALL
  SELECT 'T', value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INT)
  FROM (SELECT DISTINCT hour AS value FROM trips)) v
ON f.space = v.space AND f.value = v.value""", **T), ("V-01", "J-04"))
def q_vocab(spark, sf):
    return dc.vocab(trips(spark, sf))


@query("word_freq", with_views("""
SELECT dim, token, coll_freq, CAST(SUM(coll_freq) OVER (PARTITION BY dim) AS BIGINT) AS total_tokens FROM (
  SELECT 'O' AS dim, 'O' || origin AS token, COUNT(*) AS coll_freq FROM trips GROUP BY 2
  UNION ALL SELECT 'D', 'D' || dest, COUNT(*) FROM trips GROUP BY 2
  UNION ALL SELECT 'T', 'T' || hour, COUNT(*) FROM trips GROUP BY 2)""", **T), ("A-14", "A-15"))
def q_word_freq(spark, sf):
    w = dc.word_freq(trips(spark, sf))
    return w.select("dim", "token", "coll_freq", F.col("total_tokens").cast("bigint"))


@query("doc_max_len", with_views("""
SELECT MAX(wordcount) AS max_wordcount, COUNT(*) AS n_docs FROM (
  SELECT user_id, COUNT(*) AS wordcount FROM trips GROUP BY 1)""", **T), ("A-13",))
def q_doc_max_len(spark, sf):
    s = dc.passenger_summary(trips(spark, sf), ORDER)
    return s.agg(F.max("wordcount").alias("max_wordcount"), F.count(F.lit(1)).alias("n_docs"))


@query("corpus_index", with_views("""
SELECT w.user_id, w.pos, COALESCE(so.id, -1) AS o_id, COALESCE(sd.id, -1) AS d_id, COALESCE(h.id, -1) AS t_id
FROM (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
             origin, dest, hour FROM trips) w
LEFT JOIN st so ON w.origin = so.value
LEFT JOIN st sd ON w.dest = sd.value
LEFT JOIN hr h ON w.hour = h.value""", **T, train=TRAIN_USERS_SQL,
    tt="SELECT * FROM trips WHERE user_id IN (SELECT user_id FROM train)",
    st="""SELECT value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INT) AS id
          FROM (SELECT origin AS value FROM tt UNION SELECT dest FROM tt)""",
    hr="""SELECT value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INT) AS id
          FROM (SELECT DISTINCT hour AS value FROM tt)"""), ("J-03", "V-01", "U-04"))
def q_corpus_index(spark, sf):
    t = trips(spark, sf)
    train = t.join(train_users(spark, sf), "user_id", "left_semi")
    return dc.index_corpus(t, dc.station_vocab(train), ORDER)


# ---- text documents ---------------------------------------------------------
TEXT_SQL = {
    "w": "SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents",
    "tf": "SELECT doc_id, token, COUNT(*) AS tf FROM w GROUP BY 1, 2",
    "dfreq": "SELECT token, COUNT(*) AS doc_freq, SUM(tf) AS coll_freq FROM tf GROUP BY 1",
    "nd": "SELECT COUNT(*) AS n FROM documents",
    "kept": f"""SELECT token, doc_freq, coll_freq FROM dfreq
               WHERE doc_freq >= {NO_BELOW} AND doc_freq <= FLOOR({NO_ABOVE} * (SELECT n FROM nd))
               ORDER BY doc_freq DESC, token LIMIT {KEEP_N}""",
    "voc": """SELECT token, doc_freq, coll_freq,
                     CAST(ROW_NUMBER() OVER (ORDER BY token) - 1 AS INT) AS id FROM kept""",
}


def _text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dc.text_tokens(docs), docs.count()      # (doc, token, tf), cut into words by the vocabulary and by the weights


@query("pruned_vocab", with_views(
    "SELECT token, id, doc_freq, CAST(coll_freq AS BIGINT) AS coll_freq FROM voc", **TEXT_SQL), ("V-01", "V-02"))
def q_pruned_vocab(spark, sf):
    tf, n = _text(spark, sf)
    v = dc.pruned_vocab(tf, n, NO_BELOW, NO_ABOVE, KEEP_N)
    return v.select("token", "id", "doc_freq", F.col("coll_freq").cast("bigint"))


@query("bag_of_words", with_views(
    "SELECT tf.doc_id, voc.id, tf.tf FROM tf JOIN voc ON tf.token = voc.token", **TEXT_SQL), ("V-03",))
def q_bag_of_words(spark, sf):
    tf, n = _text(spark, sf)
    return dc.bag_of_words(tf, dc.pruned_vocab(tf, n, NO_BELOW, NO_ABOVE, KEEP_N), vocab_bound=KEEP_N)


@query("tfidf", with_views("""
SELECT doc_id, id, ROUND(w / SQRT(SUM(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM (
  SELECT tf.doc_id, voc.id, tf.tf * LOG2((SELECT n FROM nd) / voc.doc_freq) AS w
  FROM tf JOIN voc ON tf.token = voc.token)
WHERE ABS(w) > 1e-12""", **TEXT_SQL), ("V-04",))
def q_tfidf(spark, sf):
    tf, n = _text(spark, sf)
    v = dc.pruned_vocab(tf, n, NO_BELOW, NO_ABOVE, KEEP_N)
    t = dc.tfidf(tf, v, n, vocab_bound=KEEP_N)
    return t.select("doc_id", "id", F.round("weight", 9).alias("weight"))


UNSEEN_SQL = {
    "train": """SELECT doc_id FROM documents
                QUALIFY ROW_NUMBER() OVER (ORDER BY doc_id) <= FLOOR(0.8 * COUNT(*) OVER ())""",
    **TEXT_SQL,
    "tf": """SELECT doc_id, token, COUNT(*) AS tf FROM w
             WHERE doc_id IN (SELECT doc_id FROM train) GROUP BY 1, 2""",
    "nd": "SELECT COUNT(*) AS n FROM train",
    "tf_all": "SELECT doc_id, token, COUNT(*) AS tf FROM w GROUP BY 1, 2",
}


@query("unseen_doc_bow", with_views("""
SELECT t.doc_id, voc.id, t.tf FROM tf_all t JOIN voc ON t.token = voc.token
WHERE t.doc_id NOT IN (SELECT doc_id FROM train)""", **UNSEEN_SQL), ("V-05", "U-04"))
def q_unseen_doc_bow(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n_train = int(docs.count() * TRAIN_FRACTION)
    split = tr.train_test_split(docs.select(F.col("doc_id").alias("user_id")), n_train).select(
        F.col("user_id").alias("doc_id"), "split")
    # how often an id lies in each part (ids may repeat); known before the texts are cut into words
    marks = split.groupBy("doc_id").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "test")])

    def part(name):
        tf = dc.text_tokens(docs.join(marks.where(F.col(name) > 0).select("doc_id", F.col(name).alias("copies")), "doc_id"), carried=("copies",))
        return tf.select("doc_id", "token", "tf", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")

    v = dc.pruned_vocab(part("train"), n_train, NO_BELOW, NO_ABOVE, KEEP_N)
    return dc.bag_of_words(part("test"), v, vocab_bound=KEEP_N)
