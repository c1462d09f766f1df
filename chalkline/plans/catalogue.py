"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import numbers as N
from ..functions import text as T
from ..operators import context, lookups, memory, quotas, rules, vectors
from ..sources import tables
from ..sources.staging import with_distinct

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For queries with much work on each row."""
    return tables.read_spread(spark, f"{sf_dir}/{name}.parquet")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(text: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({text}, w))) > 0"


# ---- vectors: the query set is every vector whose id is divisible by 100

DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
HITS = f"""hits AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label AS label, b.label % 3 AS index_ord, {DOT} AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), "label", (F.col("label") % 3).alias("index_ord"), "embedding")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _scored(hits: DataFrame, rank: str = "rank_in_group") -> DataFrame:
    return hits.select("query_id", F.col("pos").alias("vec_id"), F.round("score", 6).alias("score"), F.col(rank).cast("int").alias("rank"))


@query(f"WITH {HITS} SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM hits QUALIFY rank <= 5")
def q01_vec_topk(spark, sf_dir):
    return _scored(vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir), 5))


@query(f"WITH {HITS} SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM hits WHERE s >= 0.3 QUALIFY rank <= 10")
def q02_vec_topk_threshold(spark, sf_dir):
    return _scored(vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir), 10, threshold=0.3))


@query(f"""WITH {HITS}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM hits QUALIFY rank <= 10)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM top WHERE label = 1""")
def q03_vec_topk_postfilter(spark, sf_dir):
    return _scored(vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir), 10).where("label = 1"))


@query(f"WITH {HITS} SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM hits WHERE label = 1 QUALIFY rank <= 10")
def q04_vec_topk_prefilter(spark, sf_dir):
    return _scored(vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir).where("label = 1"), 10))


def _multi(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    hits = vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir), k, by=["index_ord"])
    return vectors.merge_hits(hits.withColumn("chunk_id", F.floor(F.col("pos") / 2)), k)


MULTI = f"""{HITS}, per AS (SELECT *, row_number() OVER (PARTITION BY query_id, index_ord ORDER BY s DESC, vec_id) AS n FROM hits QUALIFY n <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id // 2 ORDER BY s DESC, index_ord, vec_id) AS m FROM per QUALIFY m = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, index_ord, vec_id)::INT AS rank FROM once QUALIFY rank <= 5)"""


@query(f"WITH {MULTI} SELECT query_id, vec_id, round(s, 6) AS score, rank FROM merged")
def q05_vec_multi_index(spark, sf_dir):
    return _scored(_multi(spark, sf_dir), "rank")


@query(f"WITH {MULTI} SELECT query_id, count(*) AS n_hits, (count(*) >= 2 AND max(s) >= 0.45) AS sufficient FROM merged GROUP BY query_id")
def q06_sufficiency_gate(spark, sf_dir):
    return vectors.sufficient(_multi(spark, sf_dir), min_score=0.45, min_results=2)


TOP10 = f"{HITS}, top AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM hits QUALIFY rank <= 10)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vectors.top_k(_queries(spark, sf_dir), _index(spark, sf_dir), 10).select("query_id", "pos", F.col("rank_in_group").alias("rank"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return docs.join(top, F.col("doc_id") == F.col("pos"))


@query(f"""WITH {TOP10}, used AS (SELECT query_id, rank, doc_id, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used
  FROM top JOIN documents ON doc_id = vec_id)
SELECT query_id, count(*) AS n_blocks, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_sha FROM used WHERE used <= 3000 GROUP BY query_id""")
def q07_context_budget(spark, sf_dir):
    return context.assemble(_blocks(spark, sf_dir), 3000).select("query_id", "n_blocks", F.sha2("context", 256).alias("context_sha"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 = 0")
def q08_pairwise_cosine(spark, sf_dir):
    own = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return vectors.pairwise(own).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id OR (a.vec_id > b.vec_id AND b.vec_id % 100 <> 0)
WHERE a.vec_id % 100 = 0""")
def q08_pairwise_cosine_whole(spark, sf_dir):
    """The query set against the whole table; q08_pairwise_cosine has the pairs within the set only, as its SQL."""
    e = read(spark, sf_dir, "embeddings")
    return vectors.pairwise(e.where("vec_id % 100 = 0"), e).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3)) AS e FROM embeddings),
n AS (SELECT vec_id, e, CASE WHEN list_dot_product(e, e) = 0 THEN 1.0 ELSE sqrt(list_dot_product(e, e)) END AS norm FROM v)
SELECT vec_id, round(e[1] / norm, 6) AS first, round(list_sum(list_transform(e, lambda x: x / norm * x / norm)), 6) AS length2 FROM n""")
def q09_l2_normalise(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)).alias("e"))
    e = e.select("vec_id", vectors.l2_normalise(F.col("e")).alias("u"))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length2"))


@query("SELECT label % 3 AS index_name, count(*) AS n FROM embeddings GROUP BY ROLLUP (label % 3)")
def q10_index_stats_rollup(spark, sf_dir):
    return vectors.index_counts(_index(spark, sf_dir).select(F.col("index_ord").alias("index_name")))


# ---- cache and history

HASH = "substr(sha256(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), 1, 16)"


@query(f"SELECT doc_id, {HASH.format('text')} AS q_hash FROM documents")
def q11_question_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", memory.question_hash(F.col("text")).alias("q_hash"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read(spark, sf_dir, "documents").select(memory.question_hash(F.col("text")).alias("q_hash"), "doc_id")
    return keyed.groupBy("q_hash").agg(F.min("doc_id").alias("cached_id"), (F.count("*") - 1).alias("hit_count"))


@query(f"""WITH k AS (SELECT doc_id, {HASH.format('text')} AS q_hash FROM documents WHERE text IS NOT NULL),
c AS (SELECT q_hash, min(doc_id) AS cached_id FROM k WHERE doc_id % 2 = 0 GROUP BY q_hash)
SELECT k.doc_id, k.q_hash, cached_id, cached_id IS NOT NULL AS hit FROM k LEFT JOIN c USING (q_hash)""")
def q12_cache_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question")).where("question is not null")
    even = docs.where("doc_id % 2 = 0").select(memory.question_hash(F.col("question")).alias("q_hash"), "doc_id")
    return memory.cache_lookup(docs, even.groupBy("q_hash").agg(F.min("doc_id").alias("cached_id"))).select("doc_id", "q_hash", "cached_id", "hit")


@query(f"""WITH c AS (SELECT {HASH.format('text')} AS q_hash, min(text) AS question, count(*) - 1 AS hits FROM documents GROUP BY 1)
SELECT substr(question, 1, 60) AS question, hits FROM c ORDER BY hits DESC, c.question LIMIT 5""")
def q13_cache_stats_top5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(memory.question_hash(F.col("text")).alias("q_hash"), "text")
    cache = docs.groupBy("q_hash").agg(F.min("text").alias("question"), (F.count("*") - 1).alias("hit_count"))
    return memory.top_hits(cache)


@query("""SELECT sha256(text) AS sha, length(any_value(text)) AS n_chars FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY sha256(text)""")
def q14_embed_cache_miss(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha"))
    return memory.unseen(docs, cache).select("sha", F.length("text").cast("bigint").alias("n_chars"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"))


@query("""WITH k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= 4)
SELECT conv_id AS session_id, turn AS timestamp, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM k""")
def q15_history_last_n(spark, sf_dir):
    return memory.last_n(_messages(spark, sf_dir), 4).select("session_id", "timestamp", F.col("place").cast("int").alias("place"))


@query(f"""WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= 4)
SELECT conv_id AS session_id, '{L.HISTORY_FRAMES["EN"][0]}' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '{L.HISTORY_FRAMES["EN"][1]}' ELSE '{L.HISTORY_FRAMES["EN"][2]}' END || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn)
  || chr(10) || '{L.HISTORY_FRAMES["EN"][3]}' AS context FROM k GROUP BY conv_id""")
def q16_history_context(spark, sf_dir):
    return memory.history_context(_messages(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 20")
def q17_retention_keep20(spark, sf_dir):
    return memory.last_n(_events(spark, sf_dir), 20, session="user_id", order="us").select("user_id", "event_id")


@query("WITH s AS (SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id) SELECT user_id FROM s WHERE updated_at < (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def q18_old_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sessions = e.groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return memory.older_than(sessions, 2, F.lit(now)).select("user_id")


DAY = 86_400_000_000


@query("""WITH n AS (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n_global,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS n_user_day,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS n_user_hour FROM events)
SELECT *, CASE WHEN n_global > 350 THEN 'global' WHEN n_user_hour > 1 THEN 'user_hour' WHEN n_user_day > 3 THEN 'user_day' ELSE 'ok' END AS reason FROM n""")
def q19_rolling_quota_audit(spark, sf_dir):
    limits = [("global", None, DAY, 350), ("user_hour", "user_id", DAY // 24, 1), ("user_day", "user_id", DAY, 3)]
    return quotas.rolling_audit(_events(spark, sf_dir).select("event_id", "user_id", "us"), limits).drop("user_id", "us")


@query("SELECT event_type AS model, ts::DATE AS day, count(*) AS used, greatest(0, 60 - count(*)) AS remaining, count(*) >= 60 AS exhausted FROM events GROUP BY ALL")
def q20_daily_quota_remaining(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "ts")
    return quotas.daily_counts(calls, F.lit(60), key="model", at="ts")


# ---- text


def _count_words(words) -> str:
    return "len(regexp_extract_all(text, '(?i)\\b(?:" + "|".join(words) + ")\\b'))"


@query(f"""WITH c AS (SELECT doc_id, {_count_words(L.MALAY_MARKERS)} AS bm, {_count_words(L.ENGLISH_MARKERS)} AS en FROM documents)
SELECT doc_id, CASE WHEN bm > en * 2 THEN 'BM' WHEN en > bm * 2 THEN 'EN' ELSE 'mixed' END AS language FROM c""")
def q21_language_by_lexicon(spark, sf_dir):
    return read_wide(spark, sf_dir, "documents").select("doc_id", T.language_by_markers(F.col("text")).alias("language"))


@query(f"""SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: list_contains({sql_list(L.ENGLISH_TOKENS)}, t))) >= 2 THEN 'EN' ELSE 'BM' END AS language FROM documents""")
def q22_token_language(spark, sf_dir):
    return read_wide(spark, sf_dir, "documents").select("doc_id", T.language_by_tokens(F.col("text")).alias("language"))


@query(f"""WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN {sql_any('q', L.THEORY_SIGNALS)} THEN 'index_theory,index_qa'
  WHEN {sql_any('q', L.CALCULATION_SIGNALS)} AND NOT ({sql_any('q', L.QA_SIGNALS)}) THEN 'index_calculations,index_theory'
  WHEN {sql_any('q', L.QA_SIGNALS)} AND NOT ({sql_any('q', L.CALCULATION_SIGNALS)}) THEN 'index_qa,index_theory'
  ELSE 'index_theory,index_calculations,index_qa' END AS indexes FROM c""")
def q23_keyword_route(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.route_indexes(F.col("text")), ",").alias("indexes"))


@query(f"SELECT doc_id, len(list_filter({sql_list(L.ENGLISH_CHEMISTRY)}, lambda w: contains(lower(text), w)))::INT AS n FROM documents")
def q24_keyword_distinct_hits(spark, sf_dir):
    return read_wide(spark, sf_dir, "documents").select("doc_id", T.distinct_hits(F.lower("text"), L.ENGLISH_CHEMISTRY).alias("n"))


@query("""WITH d AS (SELECT source, lang, doc_id % 5 AS chapter FROM documents)
SELECT 'content_type' AS by, source AS content_type, NULL AS language, NULL AS chapter, count(*) AS n FROM d GROUP BY source UNION ALL
SELECT 'language', NULL, lang, NULL, count(*) FROM d GROUP BY lang UNION ALL SELECT 'chapter', NULL, NULL, chapter, count(*) FROM d GROUP BY chapter""")
def q25_doc_type_counts(spark, sf_dir):
    from ..operators import documents

    d = read(spark, sf_dir, "documents")
    return documents.type_counts(d.select(F.col("source").alias("content_type"), F.col("lang").alias("language"), (F.col("doc_id") % 5).alias("chapter")))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, 'sample of ' || l_quantity::INT || ' g in ' || (l_suppkey % 50 + 1) || ' cm3, ' || (l_partkey % 9 + 1) || ' mol dm3 and ' || l_linenumber || ' mg' AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_extract(q, '([0-9]+) g', 1)::DOUBLE + l_linenumber / 1000.0 AS mass, regexp_extract(q, '([0-9]+) cm3', 1)::DOUBLE AS volume, regexp_extract(q, '([0-9]+) mol', 1)::DOUBLE AS molarity FROM t""")
def q26_unit_extract(spark, sf_dir):
    li = read_wide(spark, sf_dir, "lineitem")
    q = F.concat(
        F.lit("sample of "), F.col("l_quantity").cast("int"), F.lit(" g in "), F.col("l_suppkey") % 50 + 1, F.lit(" cm3, "), F.col("l_partkey") % 9 + 1, F.lit(" mol dm3 and "), F.col("l_linenumber"), F.lit(" mg"),
    )
    li = li.select("l_orderkey", "l_linenumber", q.alias("q"))
    mass = T.masses(F.col("q"))
    return li.select("l_orderkey", "l_linenumber", (mass[0] + mass[1]).alias("mass"), T.volumes_cm3(F.col("q"))[0].alias("volume"), T.molarities(F.col("q"))[0].alias("molarity"))


CLEAN = "html"
for _old, _new in ((r"\$\\rm\s*", ""), (r"\$", ""), (r"\\text\{([^}]*)\}", r"\1"), (r"\\rm\s*", ""), (r"_\{([0-9]+)\}", r"\1"), (r"\^\{([^}]+)\}", r"\1"), (r"_([0-9]+)", r"\1"), (r"\^([0-9]+)", r"\1")):
    CLEAN = f"regexp_replace({CLEAN}, '{_old}', '{_new}', 'g')"
CLEAN = f"translate({CLEAN}, '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻−–—×', '01234567890123456789+----x')"
for _old, _new in (("→", "->"), ("⟶", "->"), ("⇌", "<->"), ("⇆", "<->")):
    CLEAN = f"replace({CLEAN}, '{_old}', '{_new}')"
CLEAN = rf"regexp_replace(regexp_replace(regexp_replace({CLEAN}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, sha256({CLEAN}) AS clean_sha FROM pages")
def q27_text_clean(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(T.clean_recognised(F.col("html")), 256).alias("clean_sha"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha FROM pages")
def q28_html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_escape(F.col("html")), 256).alias("escaped_sha"))


@query("WITH p AS (SELECT event_type, json_keys(props::JSON) AS k FROM events) SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(k) AS key FROM p) GROUP BY ALL")
def q29_props_json(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS path FROM pages) SELECT path, min(page_id) AS first_page, count(*) AS n FROM r GROUP BY path""")
def q31_link_refs(spark, sf_dir):
    refs = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("path"))
    return refs.groupBy("path").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


WORDS = ("STEEL", "BRASS", "COPPER", "TIN", "NICKEL")


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(upper(p_type), '{w}') THEN '{w.lower()}'" for w in WORDS) + " ELSE 'other' END AS material FROM part")
def q32_dim_contains_join(spark, sf_dir):
    entries = [(w, F.lit(w.lower())) for w in WORDS]
    return read(spark, sf_dir, "part").select("p_partkey", lookups.first_contained(F.upper("p_type"), entries, F.lit("other")).alias("material"))


# ---- evaluation


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_tax, 0), 4) AS value FROM lineitem")
def q33_ratio_eval(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.ratio(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("value"))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + 1e-7, 4) AS mean FROM lineitem GROUP BY l_orderkey")
def q34_weighted_mean(spark, sf_dir):
    w = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_quantity")).alias("x"))
    x = F.array_sort("x")  # an order has few lines
    # a little more, lest a tie in the last place fall either way
    return w.select("l_orderkey", F.round(N.weighted_mean(F.transform(x, lambda r: r["l_extendedprice"]), F.transform(x, lambda r: r["l_quantity"])) + 1e-7, 4).alias("mean"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_quantity * 2, l_quantity + l_linenumber * 0.1] AS v FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, list_transform(v, lambda x: x / list_min(v)) AS s FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN len(list_filter(s, lambda x: abs(x - round_even(x, 0)) > 0.15)) = 0 THEN array_to_string(list_transform(s, lambda x: round_even(x, 0)::INT), ':') END AS ratios FROM s""")
def q35_min_normalise(spark, sf_dir):
    q = F.col("l_quantity")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(q, q * 2, q + F.col("l_linenumber") * 0.1).alias("v"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(N.whole_ratios(F.col("v")), ":").alias("ratios"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(-log10(l_discount), 6) END AS ph FROM lineitem")
def q36_log_eval(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.minus_log10(F.col("l_discount")), 6).alias("ph"))


@query("""WITH d AS (SELECT user_id, event_id, value - lag(value) OVER w AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, round(dv / nullif(dt / 1e6, 0), 8) AS slope FROM d""")
def q37_two_point_slope(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us")
    e = _events(spark, sf_dir)
    return e.select("event_id", F.round(N.ratio(F.col("value") - F.lag("value").over(w), (F.col("us") - F.lag("us").over(w)) / 1e6), 8).alias("slope"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 4.2 * abs(l_tax * 100 - l_discount * 100), 4) AS heat FROM lineitem")
def q38_calorimetry_eval(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    records = li.select("l_orderkey", "l_linenumber", F.lit("calorimetry").alias("task"), F.col("l_quantity").alias("mass_g"), (F.col("l_discount") * 100).alias("temp_initial"), (F.col("l_tax") * 100).alias("temp_final"))
    return N.evaluate(records).select("l_orderkey", "l_linenumber", F.round("answer_value", 4).alias("heat"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN l_extendedprice / 1000 END AS dm3 FROM lineitem")
def q39_unit_convert_coalesce(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 3
    return li.select("l_orderkey", "l_linenumber", N.in_dm3(F.when(n == 0, F.col("l_quantity")), F.when(n == 1, F.col("l_extendedprice"))).alias("dm3"))


TASKS = ("moles_from_volume", "particles_from_moles", "volume_from_moles", "dilution", "ph_from_h", "rate_average", "enthalpy", "no_such_task")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 AS t, l_quantity AS q, l_discount AS d, l_tax AS x FROM lineitem),
v AS (SELECT *, CASE t WHEN 0 THEN q / 24.0 WHEN 1 THEN d * 6.02e23 WHEN 2 THEN d * 24.0 WHEN 3 THEN d * q / nullif(x, 0) WHEN 4 THEN CASE WHEN d > 0 THEN -log10(d) END
  WHEN 5 THEN q / nullif(x, 0) WHEN 6 THEN -q / nullif(d, 0) / 1000 END AS value FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN t = 1 THEN value / 1e20 ELSE value END, 6) AS value, CASE WHEN t = 7 THEN 'unknown_task' WHEN value IS NULL THEN 'undefined' ELSE 'ok' END AS status FROM v""")
def q40_dispatch_all(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    records = li.select(
        "l_orderkey", "l_linenumber", F.array(*map(F.lit, TASKS))[((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")].alias("task"), q.alias("volume_dm3"), d.alias("moles"), x.alias("M1"), d.alias("M2"),
        q.alias("V2"), d.alias("h_plus"), q.alias("change"), x.alias("time"), q.alias("Q_joule"),
    )
    v = F.col("answer_value")
    return N.evaluate(records).select("l_orderkey", "l_linenumber", F.round(F.when(F.col("task") == "particles_from_moles", v / 1e20).otherwise(v), 6).alias("value"), "status")


# ---- quality rules


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    found = rules.issues([
        *rules.in_range("quantity", F.col("l_quantity"), positive=True, most=48),
        *rules.in_range("discount", F.col("l_discount"), least=0.01, warn_above=0.08),
        ("warning", "tax_missing", "tax is zero", "tax", F.col("l_tax") == 0),
    ])
    return li.select("l_orderkey", "l_linenumber", found.alias("issues"))


CHECKED = """issues AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity <= 0 THEN 'critical:quantity_not_positive' END, CASE WHEN l_quantity > 48 THEN 'critical:quantity_too_high' END,
  CASE WHEN l_discount < 0.01 THEN 'critical:discount_too_low' END, CASE WHEN l_discount > 0.08 THEN 'warning:discount_unusual' END, CASE WHEN l_tax = 0 THEN 'warning:tax_missing' END], lambda i: i IS NOT NULL)) AS issue FROM lineitem)"""


@query(f"WITH {CHECKED} SELECT l_orderkey, l_linenumber, split_part(issue, ':', 1) AS severity, split_part(issue, ':', 2) AS code FROM issues")
def q41_range_rule_issues(spark, sf_dir):
    rows = _checked(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode("issues").alias("i"))
    return rows.select("l_orderkey", "l_linenumber", "i.severity", "i.code")


@query(f"WITH {CHECKED} SELECT split_part(issue, ':', 1) AS severity, split_part(issue, ':', 2) AS code, count(*) AS n FROM issues GROUP BY ALL")
def q42_issue_summary(spark, sf_dir):
    return rules.issue_counts(_checked(spark, sf_dir))


@query("""SELECT 'document' AS kind, doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages UNION ALL SELECT 'item', item_id, NULL, NULL FROM benchmark""")
def q45_ragged_union(spark, sf_dir):
    from ..operators import documents

    d = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    p = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    b = read(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return documents.build_corpus([d, p, b])


# ---- state


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT event_id, user_id, n, us AS last, true AS allowed, 0::BIGINT AS wait FROM e WHERE n = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.n, CASE WHEN e.us - f.last >= 21600000000 THEN e.us ELSE f.last END, e.us - f.last >= 21600000000, greatest(0, 21600000000 - (e.us - f.last)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, allowed, wait FROM f""")
def q46_cooldown_fold(spark, sf_dir):
    return quotas.cooldown(_events(spark, sf_dir), DAY // 4)


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT event_id, user_id, n, [us] AS kept, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT event_id, user_id, n, CASE WHEN len(own) < 2 THEN list_append(own, us) ELSE own END, len(own) < 2
  FROM (SELECT e.event_id, e.user_id, e.n, e.us, list_filter(f.kept, lambda k: k > e.us - 86400000000) AS own FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, allowed, len(kept) AS n FROM f""")
def q47_rate_limit_fold(spark, sf_dir):
    return quotas.rate_limit(_events(spark, sf_dir), 2, DAY)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 7 < 3, "5xx").when(F.col("event_id") % 7 == 3, "limited").otherwise("ok")
    return e.select("event_id", F.col("user_id").alias("model"), "us", kind.alias("outcome"))


@query()
def q48_breaker_fold(spark, sf_dir):
    return quotas.breaker(_calls(spark, sf_dir), failures=2, reset=DAY)


@query("SELECT event_id, (sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER w)::BIGINT AS running, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def q49_inflight_running_sum(spark, sf_dir):
    changes = _events(spark, sf_dir).select("event_id", "user_id", "us", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"))
    return quotas.in_flight(changes, 3, key="user_id").select("event_id", F.col("running").cast("bigint").alias("running"), "allowed")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q50_tumbling_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def q51_session_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = F.session_window(F.col("ts").cast("timestamp"), "12 hours")
    return e.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# ---- documents and confidence


@query()
def q30_markdown_chunks(spark, sf_dir):
    from ..operators import documents

    # lines of prose become sections, so that every rule of the chunker has work
    d = read_wide(spark, sf_dir, "documents").where("text is not null")
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\n"), F.regexp_replace("text", r"\.\n", ".\n---\n"))
    files = d.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("source_file"), text.alias("text"))
    return documents.tag(documents.chunk_markdown(files)).select("chunk_id", "char_count", "content_type", "language", F.sha2("embed_text", 256).alias("embed_sha"))


@query()
def q43_confidence_score(spark, sf_dir):
    from ..functions import confidence

    d = read_wide(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", confidence.confidence(F.col("text")).alias("score")).withColumn("tier", confidence.tier(F.col("score")))


@query(r"""SELECT doc_id, CASE WHEN length(text) < 5 THEN 0.0 WHEN length(text) < 15 THEN 0.15 WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 3 THEN 0.20
  WHEN length(regexp_replace(text, '[\x00-\x7F°ΔΩμ→⇌⁺⁻₀₁₂₃₄₅₆₇₈₉αβγδ]', '', 'g')) > 0.30 * length(text) THEN 0.10
  WHEN regexp_matches(text, '""" + "|".join(f"{c}{{6,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!#%&,") + r"""|[$]{6,}|[*]{6,}|[|]{6,}|[ ]{6,}|[.]{6,}|[0]{6,}|[1]{6,}|[2]{6,}|[3]{6,}|[4]{6,}|[5]{6,}|[6]{6,}|[7]{6,}|[8]{6,}|[9]{6,}') THEN 0.20
  WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{10,}($|[^\p{L}\p{N}_])') THEN 0.25 ELSE 0.80 END::DOUBLE AS score FROM documents""")
def q44_quick_confidence(spark, sf_dir):
    from ..functions import confidence

    return read_wide(spark, sf_dir, "documents").select("doc_id", confidence.quick_confidence(F.col("text")).alias("score"))


#: (question, its task, the answer as SQL) for quantity q and line number n; what stands in braces is put in.
ASKED = (
    ("Hitungkan bilangan mol {q} g NaOH", "moles_from_mass", "q / 40"),
    ("isipadu {n} mol gas pada RTP", "volume_from_moles", "n * 24"),
    ("volume of {n} mol gas at STP", "volume_from_moles", "n * 22.4"),
    ("Apakah JMR K4Fe(CN)6?", "jmr", "368"),
    ("pH asid dengan [H+] = 0.0{n} mol dm-3", "ph_from_h", "-log10(n / 100)"),
    ("25 cm3 0.{n} mol dm-3 NaOH dititrat dengan 0.2 mol dm-3 HCl", "titration_find_volume", "25 * n / 10 / 0.2"),
    ("{q} g H2, 2H2 + O2 -> 2H2O, berapakah jisim H2O terhasil?", "stoichiometry_mass_to_mass", "q / 2 * 18"),
    ("{q} g CaCO3 -> CaO + CO2, berapakah isipadu CO2 pada RTP?", "stoichiometry_mass_to_volume", "q / 100 * 24"),
    ("Isotop Cl-35 (1{n}%) dan Cl-37 (20%), jisim atom relatif?", "ar_from_abundance", "(35 * (10 + n) + 37 * 20) / (30 + n)"),
    ("nombor proton Z = 11, nombor nukleon A = 2{n}, bilangan neutron?", "subatomic", "9 + n"),
    ("{q} g N2 dan {n} g O2, jumlah mol?", "moles_multi", "q / 28 + n / 32"),
    ("Zn E0 = -0.7{n} V, Cu E0 = +0.34 V, berapakah voltan sel?", "voltaic_cell", "0.34 + 0.7 + n / 100"),
    ("Tentukan nombor pengoksidaan Mn dalam KMnO4", "oxidation_number", "7"),
    ("berapakah jisim {n} mol NaCl", "mass_from_moles", "n * 58.5"),
    ("kadar tindak balas {q} cm3 dalam 20 s", "rate_average", "q / 20"),
    ("terangkan larutan", "unknown", "NULL::DOUBLE"),
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_wide(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("n"))
    place = F.col("l_orderkey") % len(ASKED)
    texts = (F.concat(*(F.coalesce(F.col(x[1]).cast("string"), F.lit("null")) if x in ("{q}", "{n}") else F.lit(x) for x in re.split("({[qn]})", t) if x)) for t, _, _ in ASKED)
    return li.select("l_orderkey", "l_linenumber", F.coalesce(*(F.when(place == i, t) for i, t in enumerate(texts))).alias("question"))


def _sql_asked(i: int) -> str:
    return "CASE l_orderkey % " + str(len(ASKED)) + " " + " ".join(f"WHEN {k} THEN {row[i] if i == 2 else repr(row[i])}" for k, row in enumerate(ASKED)) + " END"


@query(f"SELECT l_orderkey, l_linenumber, {_sql_asked(1)} AS task FROM lineitem")
def q52_classify_questions(spark, sf_dir):
    from ..functions import questions

    tasks = with_distinct(_asked(spark, sf_dir), ["question"], lambda each: questions.records_of(each, "question").select("question", "task"), "tasks")
    return tasks.select("l_orderkey", "l_linenumber", "task")


@query(f"SELECT l_orderkey, l_linenumber, round(({_sql_asked(2)})::DOUBLE, 6) AS answer FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity)::DOUBLE AS q, l_linenumber::DOUBLE AS n FROM lineitem)")
def q54_solve_questions(spark, sf_dir):
    from . import retrieval

    return retrieval.answers(_asked(spark, sf_dir), columns=["answer_value"]).select("l_orderkey", "l_linenumber", F.round("answer_value", 6).alias("answer"))


def _sql_issues() -> str:
    return "SELECT l_orderkey, l_linenumber, (CASE WHEN m < 0 THEN 1 ELSE 0 END) + (CASE WHEN m > 10000 THEN 1 ELSE 0 END) + (CASE WHEN m = 0 THEN 1 ELSE 0 END) + (CASE WHEN p < 0 OR p > 14 THEN 1 ELSE 0 END) AS n_issues FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 5 - 200 AS m, l_discount * 200 AS p FROM lineitem)"


@query(_sql_issues())
def q53_validate_records(spark, sf_dir):
    from ..operators import rules as R
    from ..operators import validation

    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 5 - 200).alias("mass_g"), (F.col("l_discount") * 200).alias("ph"))
    return li.select("l_orderkey", "l_linenumber", F.size(R.issues(validation.range_rules(["mass_g", "ph"]))).alias("n_issues"))



@query("""WITH r AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS request, epoch_us(ts) AS us, event_type IN ('signup', 'view') AS s, event_type = 'purchase' AS e FROM events),
t AS (SELECT request, min(us) FILTER (s) AS started, max(us) FILTER (e) AS ended, count(*) FILTER (NOT s AND NOT e) AS n_steps, max(us) AS newest FROM r GROUP BY request),
u AS (SELECT *, CASE WHEN started IS NULL THEN 'orphan' WHEN ended >= started THEN 'done' WHEN (SELECT max(us) FROM r) - newest > 86400000000 THEN 'timeout' ELSE 'open' END AS status FROM t)
SELECT request, started, ended, n_steps, CASE WHEN status = 'done' THEN ended - started END AS elapsed, status FROM u""")
def q55_request_traces(spark, sf_dir):
    from ..operators import traces

    log = _events(spark, sf_dir).select(F.concat_ws("/", "user_id", F.date_format(F.col("ts"), "yyyy-MM-dd")).alias("request"), "us", "event_type")
    return traces.traces(log, ["signup", "view"], ["purchase"], DAY)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY user_id")
def q56_store_latest(spark, sf_dir):
    """All events, upserted into a keyed store in four batches of which one comes twice, then read."""
    from ..sources.staging import shared_folder
    from ..sources.store import KeyedStore

    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.lit(1).cast("bigint").alias("n"))
    store = KeyedStore(spark, shared_folder(spark, "store"), "user_id", "event_id", sums=["n"])
    for number, part in enumerate([2, 0, 3, 1]):
        for _ in range(1 + (part == 3)):
            store.upsert(rows.where(F.pmod("event_id", F.lit(4)) == part), batch=("events", number))
    return store.read().select("user_id", "event_id", "event_type", "value", "n")


@query("""WITH k AS (SELECT event_id, value, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
s AS (SELECT CASE WHEN event_type = 'error' THEN 'error event' WHEN value < 1 THEN 'small value' WHEN k % 10 = 0 THEN 'ZeroDivisionError' END AS reason FROM k)
SELECT CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason, count(*) AS n FROM s GROUP BY ALL""")
def q57_errors_by_reason(spark, sf_dir):
    """Events through checks and a function that fails for some; every row has a status and a reason."""
    from ..operators import isolation

    def share(row: dict) -> dict:
        return {"share": row["value"] / (json.loads(row["props"])["k"] % 10)}

    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    checked = isolation.checked(rows, {"error event": F.col("event_type") == "error", "small value": F.col("value") < 1})
    return isolation.by_reason(isolation.attempted(checked, share, "share double"))
