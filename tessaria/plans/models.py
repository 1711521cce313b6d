"""Scoring, search and ad-hoc SQL over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.operators import scoring, search, search_index
from tessaria.operators.workspace import Workspace
from tessaria.plans import sqlgate
from tessaria.plans.registry import parts, query
from tessaria.session import table

FEATURES = ("price", "p_size", "floor")


def features(spark, d):
    return parts(spark, d).select("id", "price", F.col("p_size").cast("double").alias("p_size"), F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("floor"))


@query(
    "normalise_vector",
    """WITH f AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS p_size, nullif(p_size % 7, 0)::DOUBLE AS floor FROM part),
s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(floor) AS mf, stddev_pop(floor) AS sf FROM f)
SELECT id, round((price - mp) / sp, 5) AS price, round((p_size - ms) / ss, 5) AS p_size, round(coalesce((floor - mf) / sf, 0), 5) AS floor FROM f, s""",
)
def normalise_vector(spark, d):
    z = scoring.normalised(features(spark, d), "id", FEATURES)
    return z.select("id", *(F.round(c, 5).alias(c) for c in FEATURES))


WEIGHTS = (0.8, -0.5, 0.3)


@query(
    "explanations",
    """WITH f AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS p_size, nullif(p_size % 7, 0)::DOUBLE AS floor FROM part),
s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(floor) AS mf, stddev_pop(floor) AS sf FROM f),
z AS (SELECT id, (price - mp) / sp AS price, (p_size - ms) / ss AS p_size, coalesce((floor - mf) / sf, 0) AS floor FROM f, s),
t AS (SELECT id, 'price' AS feature, price * 0.8::DOUBLE AS c FROM z UNION ALL SELECT id, 'p_size', p_size * -0.5::DOUBLE FROM z UNION ALL SELECT id, 'floor', floor * 0.3::DOUBLE FROM z)
SELECT id, feature, round(c, 5) AS contribution, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, feature)::INTEGER AS rank FROM t WHERE abs(c) >= 0.000001""",
)
def explanations(spark, d):
    z = scoring.normalised(features(spark, d), "id", FEATURES)
    return scoring.explanations(z, "id", FEATURES, WEIGHTS).withColumn("contribution", F.round("contribution", 5))


@query("logit_gd")
def logit_gd(spark, d):
    """A model per user from purchases (1) and errors (0) over value and hour. (A thousand gradient steps are no SQL.)"""
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    rows = e.select("user_id", (F.col("value") / 100).alias("value"), (F.hour("ts") / 24).alias("hour"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    made = scoring.train_models(rows.withColumn("profile", F.col("user_id") % 5).drop("user_id"), "profile", ("value", "hour"), "label")
    return made.select("profile", "n", F.round("bias", 6).alias("bias"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


def _steps_sql(n: int) -> str:
    """Gradient steps one after another as common tables: r has the labelled rows, w0 starts from zero."""
    out = ["""r AS (SELECT user_id % 20 AS profile, value / 100 AS x1, hour(ts) / 24::DOUBLE AS x2, (event_type = 'purchase')::INT AS y FROM events WHERE event_type IN ('purchase', 'error')),
w0 AS (SELECT profile, count(*) AS n, 0::DOUBLE AS b, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM r GROUP BY profile HAVING count(*) >= 32 AND sum(y) > 0 AND sum(y) < count(*))"""]
    for i in range(n):
        out.append(f"""e{i} AS (SELECT profile, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y AS e, x1, x2 FROM r JOIN w{i} USING (profile)),
w{i + 1} AS (SELECT profile, n, b - 0.5 * g / n AS b, w1 - 0.5 * (g1 / n + 1.0 / n * w1) AS w1, w2 - 0.5 * (g2 / n + 1.0 / n * w2) AS w2 FROM w{i} JOIN (SELECT profile, sum(e) AS g, sum(e * x1) AS g1, sum(e * x2) AS g2 FROM e{i} GROUP BY profile) USING (profile))""")
    return f"WITH {', '.join(out)} SELECT profile, n::BIGINT AS n, round(b, 8) AS bias, round(w1, 8) AS w1, round(w2, 8) AS w2 FROM w{n}"


@query("gradient_steps", _steps_sql(5))
def gradient_steps(spark, d):
    """Five steps of the models of twenty profiles at once, as aggregates over all labels."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    rows = e.select((F.col("user_id") % 20).alias("profile"), (F.col("value") / 100).alias("value"), (F.hour("ts") / 24).alias("hour"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    made = scoring.gradient_models(rows, "profile", ("value", "hour"), "label", steps=5)
    return made.select("profile", "n", F.round("bias", 8).alias("bias"), *(F.round(F.col("weights")[i], 8).alias(f"w{i + 1}") for i in range(2)))


@query(
    "cold_start_fill",
    """WITH r AS (SELECT user_id % 40 AS profile, (event_type = 'purchase')::INT AS y FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 40 < 20),
m AS (SELECT profile FROM r GROUP BY profile HAVING count(*) >= 32 AND sum(y) > 0 AND sum(y) < count(*)),
c AS (SELECT event_id, user_id % 40 AS profile, value / 100 AS v, CASE WHEN event_id % 3 = 0 THEN round((event_id % 100) / 100::DOUBLE, 3) END AS score FROM events WHERE event_type = 'view')
SELECT event_id, profile, CASE WHEN m.profile IS NULL THEN coalesce(score, round(coalesce(1 / (1 + v), 0.5), 3)) ELSE round(1 / (1 + exp(-(v - 0.5))), 3) END AS score,
  CASE WHEN m.profile IS NOT NULL THEN 'trained' WHEN score IS NULL THEN 'cold_start' ELSE 'kept' END AS kind FROM c LEFT JOIN m USING (profile)""",
)
def cold_start_fill(spark, d):
    """Scores of all viewed events: profiles with a model are scored anew, others get a cold start where no score is stored."""
    e = table(spark, d, "events")
    labels = e.filter(F.col("event_type").isin("purchase", "error") & (F.col("user_id") % 40 < 20)).select((F.col("user_id") % 40).alias("profile"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    models = scoring.trainable(labels, "profile", "label").select("profile", F.lit(-0.5).alias("bias"), F.array(F.lit(1.0)).alias("weights"))
    stored = F.when(F.col("event_id") % 3 == 0, F.round((F.col("event_id") % 100) / 100, 3))
    rows = e.filter("event_type = 'view'").select("event_id", (F.col("user_id") % 40).alias("profile"), F.array(F.col("value") / 100).alias("x"), (F.col("value") / 100).alias("cold"), stored.alias("score"))
    return scoring.rescored(rows, models, "profile").select("event_id", "profile", "score", "kind")


@query(
    "preference_signal",
    """WITH u AS (SELECT vec_id, label = 0 AS liked, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT i, avg(x) FILTER (WHERE liked) AS plus, avg(x) FILTER (WHERE NOT liked) AS minus FROM u GROUP BY i),
s AS (SELECT vec_id, sum(x * plus) / (sqrt(sum(x * x)) * sqrt(sum(plus * plus))) - sum(x * minus) / (sqrt(sum(x * x)) * sqrt(sum(minus * minus))) AS v FROM u JOIN c USING (i) GROUP BY vec_id)
SELECT vec_id, round(least(greatest(v, -1), 1), 5) AS signal, round(least(greatest(0.5 + 0.15 * least(greatest(v, -1), 1), 0), 1), 5) AS score FROM s""",
)
def preference_signal(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).alias("liked"))
    signal = scoring.preference(F.col("embedding"), F.col("plus"), F.col("minus"))
    both = rows.join(F.broadcast(scoring.centroids(rows, "embedding", "liked", 64))).select("vec_id", signal.alias("signal"))
    return both.select("vec_id", F.round("signal", 5).alias("signal"), F.round(scoring.with_preference(F.lit(0.5), F.col("signal")), 5).alias("score"))


TOKENS_SQL = "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^0-9a-z]+', ' ', 'g')) || ' '"


@query(
    "fts_and_or_not",
    f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS line FROM documents) SELECT doc_id FROM t WHERE (line LIKE '% the %' AND line LIKE '% with %' AND line NOT LIKE '% token %') OR (line LIKE '% der %' AND line LIKE '% in der %')""",
)
def fts_and_or_not(spark, d):
    return table(spark, d, "documents").filter(search.matches(F.col("text"), 'the with -token or der "in der"')).select("doc_id")


@query(
    "inverted_index_top",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(strip_accents(lower(text)), '[^0-9a-z]+'), lambda x: x <> ''))) AS lexeme FROM documents)
SELECT lexeme, count(*)::BIGINT AS docs FROM w GROUP BY lexeme""",
)
def inverted_index_top(spark, d):
    return search.inverted_index(table(spark, d, "documents"), "doc_id", "text").groupBy("lexeme").agg(F.count("*").alias("docs"))


STEMS_SQL = """list_transform(list_filter(string_split_regex(strip_accents(lower(%s)), '[^0-9a-z]+'), lambda x: x <> ''),
  lambda x: replace(regexp_replace(regexp_replace(regexp_replace(x, 'eses$', 'es_'), 'ces$', 'z_'), '^(.{3,})[aeo]s?$', '\\1'), '_', ''))"""


@query(
    "search_index",
    f"""WITH l AS (SELECT doc_id, ' ' || array_to_string({STEMS_SQL % "source"}, ' ') || ' ' AS a, ' ' || array_to_string({STEMS_SQL % "text"}, ' ') || ' ' AS b, ' ' || array_to_string({STEMS_SQL % "lang"}, ' ') || ' ' AS c FROM documents)
SELECT 'all' AS question, doc_id AS key FROM l WHERE (a || ltrim(b) || ltrim(c) LIKE '% the %' AND a || ltrim(b) || ltrim(c) LIKE '% with %' AND NOT a || ltrim(b) || ltrim(c) LIKE '% token %') OR a || ltrim(b) || ltrim(c) LIKE '% in der %'
UNION ALL SELECT 'sources', doc_id FROM l WHERE a LIKE '% src3 %' OR a LIKE '% src1 %'
UNION ALL SELECT 'languages', doc_id FROM l WHERE c LIKE '% es %'
UNION ALL SELECT 'without', doc_id FROM l WHERE NOT a || ltrim(b) || ltrim(c) LIKE '% the %'""",
)
def search_index_answers(spark, d):
    """Documents with their source (A), text (B) and language (C), indexed in two rounds, of which the second changes a third of
    them and adds the rest; four questions, some of one weight alone."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "lang")
    index = search_index.SearchIndex(spark, Workspace(spark, "search").path, buckets=16)
    weighted = {"A": F.col("source"), "B": F.col("text"), "C": F.col("lang")}
    index.update(docs.filter("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("the old text with token")).otherwise(F.col("text"))), "doc_id", weighted)
    index.update(docs, "doc_id", weighted)
    asked = {"all": ('the with -token or "in der"', None), "sources": ("src3 or src1", "A"), "languages": ("es", "C"), "without": ("-the", None)}
    out = [index.search(q, w).select(F.lit(name).alias("question"), "key") for name, (q, w) in asked.items()]
    return reduce(DataFrame.unionByName, out)


@query(
    "gateway_query",
    "SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = ANY(['F', 'O']) AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderpriority",
)
def gateway_query(spark, d):
    """A widget's SQL with a global filter and a date token, through the read-only gateway."""
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(name)
    sql = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE __gf_status__ AND o_orderdate >= {{date_from}} GROUP BY o_orderpriority"
    rewritten, args = sqlgate.rewrite(sql, {"status": ("o_orderstatus", ["F", "O"])}, {"date_from": "1995-01-01 00:00:00"})
    return sqlgate.Gateway(spark, {"orders", "customer"}).execute(rewritten, args)
