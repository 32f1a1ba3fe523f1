"""Queries over history, job, dictionary, glossary and error tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions.languages import LANGUAGES, rows_sql
from cuewright.operators import filters, lookups, rollups
from cuewright.operators.timeline import top_per_group
from cuewright.plans import shapes
from cuewright.plans.registry import query
from cuewright.session import scratch_path, small_side, spread
from cuewright.sources import readers
from cuewright.sources.keyed_store import KeyedStore, upsert
from cuewright.views import table


@query(
    "join_label",
    sql="""SELECT d.doc_id AS id, d.source AS shard, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS label_state
FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id""",
)
def label(spark, sf_dir):
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("shard"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return lookups.join_labels(samples, labels, ["id"])


LANG_DIM = rows_sql(LANGUAGES, "code, iso3, name")
LANG_SQL = f"""dim AS (SELECT code, iso3, name, NULL AS alias FROM {LANG_DIM}
  UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey, LOWER(n_name), LOWER(n_name) || ' tongue' FROM nation)"""


def _languages(spark, sf_dir):
    """A language map file with the given languages and one more per nation, read back; the latter have an alias."""
    path = scratch_path(spark, "language-map")
    given = spark.createDataFrame([(c, n, i) for c, i, n in LANGUAGES], "language_id string, language_name string, iso_639_3_id string")
    number = F.col("n_nationkey").cast("string")
    more = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), number).alias("language_id"), F.lower("n_name").alias("language_name"), F.concat(F.lit("x"), number).alias("iso_639_3_id"))
    given.unionByName(more).withColumn("train_data_duration", F.lit(1.0)).write.option("sep", "\t").option("header", True).csv(path)
    found = readers.language_map(spark, path)
    alias = F.when(F.col("language_id").rlike("^n[0-9]"), F.array(F.concat("language_name", F.lit(" Tongue"))))
    return found.select(F.col("language_id").alias("code"), F.col("iso_639_3_id").alias("iso3"), F.col("language_name").alias("name"), alias.alias("aliases"))


@query(
    "join_language_dim",
    views="v_manifest",
    sql=f"""WITH {LANG_SQL}, m AS (SELECT id, CASE WHEN id%7=0 THEN 'n' || (id%25) ELSE language_id END AS language_id FROM v_manifest)
SELECT m.id, m.language_id, dim.iso3 AS iso_code FROM m LEFT JOIN dim ON dim.code=m.language_id""",
)
def language_dim(spark, sf_dir):
    """Every seventh document is in the language of a nation."""
    dim = small_side(_languages(spark, sf_dir).select(F.col("code").alias("language_id"), F.col("iso3").alias("iso_code")))
    nation = F.concat(F.lit("n"), (F.col("id") % 25).cast("string"))
    docs = views.manifest(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, nation).otherwise(F.col("language_id")).alias("language_id"))
    return docs.join(dim, "language_id", "left")


@query(
    "join_language_resolve",
    sql=f"""WITH {LANG_SQL},
raw AS (SELECT d.doc_id, CASE d.doc_id%7 WHEN 0 THEN d.lang WHEN 1 THEN ' ' || UPPER(d.lang) || '_XX ' WHEN 2 THEN dim.name WHEN 3 THEN 'Auto' WHEN 4 THEN 'x' || d.lang || '-' || d.source
    WHEN 5 THEN UPPER(n_name) || ' Tongue' ELSE LOWER(n_name) || ' tongue_XX' END AS label
  FROM documents d LEFT JOIN dim ON dim.code=d.lang LEFT JOIN nation ON n_nationkey=d.doc_id%25),
k AS (SELECT *, REPLACE(LOWER(TRIM(label)), '_', '-') AS key FROM raw),
s AS (SELECT code, code AS k FROM dim UNION ALL SELECT code, alias FROM dim WHERE alias IS NOT NULL)
SELECT k.doc_id, k.label, CASE WHEN key IN ('', 'auto') THEN NULL ELSE COALESCE(a.code, b.code, n.code,
  CASE WHEN REGEXP_FULL_MATCH(SPLIT_PART(key, '-', 1), '[a-z]{{2,3}}') THEN SPLIT_PART(key, '-', 1) END) END AS iso_code
FROM k LEFT JOIN s a ON a.k=key LEFT JOIN s b ON b.k=SPLIT_PART(key, '-', 1) LEFT JOIN dim n ON n.name=LOWER(TRIM(label))""",
)
def language_resolve(spark, sf_dir):
    """Labels as users write them: codes, tags, names, and aliases with and without a region."""
    dim = _languages(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_n"), "n_name")
    named = docs.join(dim.select(F.col("code").alias("lang"), "name"), "lang", "left").join(nations, F.col("doc_id") % 25 == F.col("_n"), "left")
    kind = F.col("doc_id") % 7
    label = (
        F.when(kind == 0, F.col("lang"))
        .when(kind == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit("_XX ")))
        .when(kind == 2, F.col("name"))
        .when(kind == 3, F.lit("Auto"))
        .when(kind == 4, F.concat(F.lit("x"), "lang", F.lit("-"), "source"))
        .when(kind == 5, F.concat(F.upper("n_name"), F.lit(" Tongue")))
        .otherwise(F.concat(F.lower("n_name"), F.lit(" tongue_XX")))
    )
    return filters.resolve_languages(named.select("doc_id", label.alias("label")), "label", dim)


DICT_SQL = """d AS (SELECT p_partkey AS id, SPLIT_PART(p_name, ' ', 1) AS term, LOWER(p_type) AS replacement,
  CASE WHEN p_size < 40 THEN 'respelling' WHEN p_size < 45 THEN 'ipa' ELSE 'cmu' END AS type,
  CASE p_partkey%4 WHEN 0 THEN '*' WHEN 1 THEN 'en-US' WHEN 2 THEN 'de' ELSE NULL END AS language,
  CASE WHEN p_retailprice < 905 THEN 0 ELSE 1 END AS enabled, p_retailprice AS created_at FROM part),
req AS (SELECT UNNEST(['en', 'de-AT', 'Auto', 'fr']) AS request),
sc AS (SELECT *, COALESCE(NULLIF(TRIM(language), ''), '*') AS scope FROM d, req WHERE enabled <> 0 AND TRIM(term) <> ''),
hit AS (SELECT * FROM sc WHERE scope='*' OR (LOWER(TRIM(request)) NOT IN ('', 'auto') AND LOWER(LEFT(scope, 2)) = LEFT(LOWER(TRIM(request)), 2)))"""


def _dictionary(spark, sf_dir):
    key = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"),
        F.lower("p_type").alias("replacement"),
        F.when(F.col("p_size") < 40, "respelling").when(F.col("p_size") < 45, "ipa").otherwise("cmu").alias("type"),
        F.when(key == 0, "*").when(key == 1, "en-US").when(key == 2, "de").alias("language"),
        F.when(F.col("p_retailprice") < 905, 0).otherwise(1).alias("enabled"),
        F.col("p_retailprice").alias("created_at"),
    )


REQUESTS = ["en", "de-AT", "Auto", "fr"]


@query(
    "join_dictionary_scope",
    sql=f"WITH {DICT_SQL} SELECT request, term, ARG_MAX(replacement, (scope <> '*', created_at, id)) AS replacement FROM hit WHERE type='respelling' GROUP BY 1,2",
)
def dictionary_scope(spark, sf_dir):
    return lookups.dictionary_for(_dictionary(spark, sf_dir), REQUESTS)


@query("join_dictionary_inert", sql=f"WITH {DICT_SQL} SELECT request, id, term, type AS kind FROM hit WHERE type<>'respelling'")
def dictionary_inert(spark, sf_dir):
    return lookups.dictionary_inert(_dictionary(spark, sf_dir), REQUESTS)


def _projects(spark, sf_dir):
    """Dub projects: the conversations' roles written as project JSON, some of it broken."""
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")).select(
        F.col("l_orderkey").alias("project_id"),
        F.concat(
            F.lit('{"segments": [{"profile_id": "p'),
            F.col("l_suppkey").cast("string"),
            F.lit('"}, {"profile_id": "p'),
            (F.col("l_linenumber") % 3).cast("string"),
            F.lit('"}]'),
            F.when(F.col("l_returnflag") == "R", "").otherwise("}"),
        ).alias("state_json"),
    )
    return rows


@query(
    "join_profile_usage",
    sql="""WITH p AS (SELECT l_orderkey AS project_id, UNNEST(['p' || l_suppkey, 'p' || (l_linenumber%3)]) AS profile_id FROM lineitem WHERE l_returnflag <> 'R'),
tot AS (SELECT 'p' || user_id AS profile_id, COUNT(*) AS takes FROM events GROUP BY 1)
SELECT p.profile_id, p.project_id, COUNT(*) AS segment_count, ANY_VALUE(takes) AS takes FROM p LEFT JOIN tot USING (profile_id) GROUP BY 1,2""",
)
def profile_usage(spark, sf_dir):
    totals = (
        views.takes(spark, sf_dir)
        .groupBy(F.concat(F.lit("p"), F.col("profile_id").cast("string")).alias("profile_id"))
        .agg(F.count(F.lit(1)).alias("takes"))
    )
    return lookups.profile_usage(_projects(spark, sf_dir), totals)


@query(
    "join_reference_scan",
    sql="""WITH j AS (SELECT o_orderkey AS id, '{"vocals": "/dub/' || (o_orderkey - o_custkey%50) || '/v.wav", "thumb": "/dub/' || o_orderkey || '/t.png"}' AS data FROM orders),
x AS (SELECT id AS holder, UNNEST(list_distinct(regexp_extract_all(data, '/dub/([^/"]+)/', 1))) AS target FROM j)
SELECT target, holder FROM x WHERE target <> CAST(holder AS VARCHAR) AND target IN (SELECT CAST(id AS VARCHAR) FROM j)""",
)
def reference_scan(spark, sf_dir):
    older = (F.col("o_orderkey") - F.col("o_custkey") % 50).cast("string")
    own = F.col("o_orderkey").cast("string")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit('{"vocals": "/dub/'), older, F.lit('/v.wav", "thumb": "/dub/'), own, F.lit('/t.png"}')).alias("job_data"),
    )
    return lookups.referencing_jobs(jobs, '/dub/([^/"]+)/')


@query(
    "join_cache_lookup",
    sql="""WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus='P' THEN '' ELSE 'h' || o_custkey END AS h, o_orderdate AS c, o_totalprice > 150000 AS usable FROM orders),
p AS (SELECT a.job_id, a.h, b.job_id AS other, b.usable, ROW_NUMBER() OVER (PARTITION BY a.job_id ORDER BY b.c DESC, b.job_id DESC) AS rn
  FROM j a JOIN j b ON a.h=b.h AND a.job_id<>b.job_id WHERE a.h<>'')
SELECT a.job_id, a.h AS content_hash, (SELECT ARG_MIN(other, rn) FROM p WHERE p.job_id=a.job_id AND rn<=5 AND usable) AS cached_job FROM j a WHERE a.h<>''""",
)
def cache_lookup(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("h"), F.col("o_custkey").cast("string"))).alias("content_hash"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") > 150000).alias("usable"),
    )
    return lookups.cache_hits(jobs)


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE CASE WHEN o_totalprice < 100000 THEN 'failed' ELSE 'pending' END END AS status,
  CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'audiobook' WHEN '2' THEN 'story' ELSE 'dub' END AS type, o_custkey AS project_id, o_orderdate AS created_at,
  '{"title": "meta ' || o_orderkey || '"}' AS meta_json FROM orders)"""


def _jobs(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "running")
        .when(F.col("o_totalprice") < 100000, "failed")
        .otherwise("pending")
        .alias("status"),
        F.when(first == "1", "audiobook").when(first == "2", "story").otherwise("dub").alias("type"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit('{"title": "meta '), F.col("o_orderkey").cast("string"), F.lit('"}')).alias("meta_json"),
    )


@query(
    "join_job_library",
    sql=f"""WITH {JOBS_SQL},
ev AS (SELECT l_orderkey AS job_id, l_linenumber AS seq, l_returnflag, l_linestatus, l_suppkey, l_quantity, l_partkey, l_extendedprice FROM lineitem),
done AS (SELECT * FROM ev WHERE l_returnflag <> 'R' QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) = 1)
SELECT j.job_id, j.type, 'out' || l_suppkey || '.m4b' AS output, CASE WHEN l_quantity < 20 THEN 'T' || l_suppkey ELSE 'meta ' || j.job_id END AS title,
  ROUND_EVEN(CAST(l_quantity AS DOUBLE), 2) AS duration_s, CASE WHEN l_quantity < 10 THEN 0 ELSE CAST(seq AS BIGINT) END AS chapters, created_at
FROM jobs j JOIN done d ON d.job_id=j.job_id WHERE status='done' AND type IN ('audiobook', 'story') AND l_linestatus='F'
ORDER BY created_at DESC, j.job_id DESC LIMIT 50""",
)
def job_library(spark, sf_dir):
    supp = F.col("l_suppkey").cast("string")
    payload = F.concat(
        F.lit('{"type": "done", "output": "'),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("out"), supp, F.lit(".m4b"))).otherwise(""),
        F.lit('", "title": "'),
        F.when(F.col("l_quantity") < 20, F.concat(F.lit("T"), supp)).otherwise(""),
        F.lit('", "duration_s": '),
        F.col("l_quantity").cast("string"),
        F.lit(', "chapters": '),
        F.when(F.col("l_quantity") < 10, '"many"').otherwise(F.col("l_linenumber").cast("string")),
        F.when(F.col("l_returnflag") == "R", "").otherwise("}"),
    )
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("seq"), payload.alias("payload")
    )
    return lookups.job_library(_jobs(spark, sf_dir), events, ["audiobook", "story"], 50)


@query(
    "join_default_chain",
    sql="""SELECT o_orderkey AS request_id, o_custkey AS client_id,
  CASE WHEN o_orderpriority='1-URGENT' THEN 'x' || o_orderkey WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'default' END AS profile_id,
  CASE WHEN o_orderpriority='1-URGENT' THEN 'explicit' WHEN c_acctbal > 0 THEN 'binding' ELSE 'global' END AS source
FROM orders LEFT JOIN customer ON c_custkey=o_custkey""",
)
def default_chain(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("client_id"),
        F.when(urgent, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise("").alias("explicit_profile"),
    )
    bindings = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("bound_profile"),
    )
    return lookups.resolve_voice(requests, bindings, "default").drop("explicit_profile")


@query(
    "anti_missing_keys",
    sql="""WITH base AS (SELECT DISTINCT p_brand || '.' || p_type AS key FROM part),
loc AS (SELECT DISTINCT CASE WHEN p_size%2=0 THEN 'de' ELSE 'fr' END AS lang, p_brand || '.' || p_type || CASE WHEN p_size > 44 THEN '' ELSE '.old' END AS key FROM part)
SELECT l.lang, base.key FROM base, (SELECT UNNEST(['de', 'fr']) AS lang) l WHERE NOT EXISTS (SELECT 1 FROM loc WHERE loc.lang=l.lang AND loc.key=base.key)""",
)
def missing_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("key", F.concat("p_brand", F.lit("."), "p_type"))
    lang = F.when(F.col("p_size") % 2 == 0, "de").otherwise("fr")
    kept = F.when(F.col("p_size") > 44, "").otherwise(".old")
    locales = part.select(lang.alias("lang"), F.concat("key", kept).alias("key"))
    return lookups.missing_keys(part.select("key"), locales, ["de", "fr"])


GLOSS_SQL = """auto AS (SELECT l_suppkey AS project_id, l_orderkey*10+l_linenumber AS position, l_partkey, l_extendedprice, p_name AS source,
    CASE WHEN l_quantity < 5 THEN p_name WHEN l_quantity < 8 THEN ' ' ELSE LOWER(p_brand) || '-' || l_orderkey END AS target
  FROM lineitem JOIN part ON p_partkey=l_partkey),
usr AS (SELECT ps.s_suppkey AS project_id, UPPER(p_name) AS source, p_brand AS target FROM part JOIN supplier ps ON ps.s_suppkey = p_size)"""


def _glossary(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    joined = spread(items).join(part, F.col("p_partkey") == F.col("l_partkey"))
    target = (
        F.when(F.col("l_quantity") < 5, F.col("p_name"))
        .when(F.col("l_quantity") < 8, " ")
        .otherwise(F.concat(F.lower("p_brand"), F.lit("-"), F.col("l_orderkey").cast("string")))
    )
    auto = joined.select(
        F.col("l_suppkey").alias("project_id"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"), F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("e")).alias("position"),
        F.col("p_name").alias("source"),
        target.alias("target"),
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"))
    user = part.select(
        F.col("p_size").cast("long").alias("project_id"), F.upper("p_name").alias("source"), F.col("p_brand").alias("target")
    ).join(supplier, "project_id", "left_semi")
    return user, auto


@query(
    "anti_glossary_new",
    sql=f"""WITH {GLOSS_SQL}, ok AS (SELECT * FROM auto WHERE TRIM(target)<>'' AND NOT (source=target AND source LIKE '% %'))
SELECT project_id, source, target FROM ok WHERE NOT EXISTS (SELECT 1 FROM usr WHERE usr.project_id=ok.project_id AND LOWER(usr.source)=LOWER(ok.source))
QUALIFY ROW_NUMBER() OVER (PARTITION BY project_id, LOWER(source) ORDER BY position, l_partkey, l_extendedprice) = 1""",
)
def glossary_new(spark, sf_dir):
    user, auto = _glossary(spark, sf_dir)
    return lookups.new_glossary_terms(auto, user)


@query(
    "set_merge_glossary",
    sql=f"""WITH {GLOSS_SQL}, ok AS (SELECT * FROM auto WHERE TRIM(target)<>'')
SELECT project_id, source, target, 'user' AS origin FROM usr UNION ALL
SELECT project_id, source, target, 'auto' FROM (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM usr WHERE usr.project_id=ok.project_id AND LOWER(usr.source)=LOWER(ok.source))
QUALIFY ROW_NUMBER() OVER (PARTITION BY project_id, LOWER(source) ORDER BY position, l_partkey, l_extendedprice) = 1) z""",
)
def merge_glossary(spark, sf_dir):
    user, auto = _glossary(spark, sf_dir)
    return lookups.merge_glossary(user, auto)


@query(
    "set_merge_catalogs",
    sql="""WITH a AS (SELECT CASE WHEN l_quantity > 49 THEN l_partkey ELSE -1-l_partkey END AS id, MIN(l_suppkey) AS v FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS v FROM part)
SELECT id, v, 'orders' AS origin FROM a UNION ALL SELECT id, v, 'parts' FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def merge_catalogs(spark, sf_dir):
    known = F.when(F.col("l_quantity") > 49, F.col("l_partkey")).otherwise(-1 - F.col("l_partkey"))
    first = table(spark, sf_dir, "lineitem").groupBy(known.alias("id")).agg(F.min("l_suppkey").alias("v"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("v"))
    return lookups.merge_catalogs([("orders", first), ("parts", parts)])


@query(
    "anti_unreferenced_files",
    views="v_takes",
    sql="""SELECT DISTINCT audio_path FROM v_takes WHERE created_at < TIMESTAMP '2024-01-29' AND starred=0
  AND audio_path NOT IN (SELECT audio_path FROM v_takes WHERE NOT (created_at < TIMESTAMP '2024-01-29' AND starred=0) AND audio_path IS NOT NULL)""",
)
def unreferenced_files(spark, sf_dir):
    takes = views.takes(spark, sf_dir)
    gone = (F.col("created_at") < F.expr("timestamp_ntz'2024-01-29 00:00:00'")) & (F.col("starred") == 0)
    return lookups.unreferenced_files(takes.filter(gone), takes.filter(~gone))


@query(
    "semi_purge_finished",
    sql="""WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 1000)
SELECT 'attempt' AS part, l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS attempt_no FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM d)
UNION ALL SELECT 'survivor', o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)""",
)
def purge_finished(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("finished_at")
    )
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("attempt_no")
    )
    _, removed, kept = lookups.purge_finished(
        tasks, attempts, ["F", "P"], F.expr("timestamp_ntz'1997-01-01 00:00:00'"), 1000
    )
    survivors = kept.select(F.lit("survivor").alias("part"), "task_id", F.lit(0).cast("long").alias("attempt_no"))
    return removed.select(F.lit("attempt").alias("part"), "task_id", "attempt_no").unionByName(survivors)


@query(
    "agg_usage_summary",
    views="v_takes",
    sql="""SELECT COUNT(*) AS takes, COUNT(*) FILTER (starred=1) AS starred, ROUND(SUM(CAST(ROUND(duration_seconds*1000) AS BIGINT))/1000.0, 1) AS audio_seconds,
  ROUND(SUM(CAST(ROUND(duration_seconds*0.25*1000) AS BIGINT))/1000.0, 1) AS compute_seconds,
  COUNT(DISTINCT CAST(created_at AS DATE)) AS active_days, MIN(created_at) AS first_at, MAX(created_at) AS last_at,
  (SELECT COUNT(*) FROM supplier) AS voices, (SELECT COUNT(*) FROM orders) AS dubs, (SELECT COUNT(*) FROM part) AS projects FROM v_takes""",
)
def usage_summary(spark, sf_dir):
    dims = {"voices": "supplier", "dubs": "orders", "projects": "part"}
    takes = views.takes(spark, sf_dir).withColumn("generation_time", F.col("duration_seconds") * 0.25)
    return rollups.usage_summary(takes, {k: table(spark, sf_dir, t) for k, t in dims.items()})


@query(
    "agg_distribution",
    sql="""WITH x AS (SELECT CASE WHEN doc_id%11=0 THEN NULL WHEN doc_id%13=0 THEN ' ' ELSE source END AS s FROM documents)
SELECT CASE WHEN TRIM(COALESCE(s, ''))='' THEN 'unknown' ELSE s END AS name, COUNT(*) AS count FROM x GROUP BY s ORDER BY COUNT(*) DESC, s NULLS LAST LIMIT 12""",
)
def distribution(spark, sf_dir):
    source = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").select(source.alias("source"))
    return rollups.distribution(docs, "source", rollups.LANGUAGE_ROWS)


ERR_SQL = """er AS (SELECT event_id, ts AS created_at, json_extract_string(props, '$.k') AS k, value, user_id FROM events WHERE event_type='error'),
fe AS (SELECT *, 'failed item ' || k || ' in ~/x' AS message, CASE WHEN value < 20 THEN 'NETWORK_ERROR' ELSE 'UNKNOWN' END AS error_class,
  CASE WHEN value < 15 THEN '' ELSE '/api/dub/' || user_id END AS route FROM er),
fp AS (SELECT *, LEFT(SHA1(error_class || '|' || 'RuntimeError' || '|' || LEFT(message, 200)), 16) AS fingerprint FROM fe)"""


def errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    rows = rows.select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.concat(F.lit("failed item "), F.get_json_object("props", "$.k"), F.lit(" in /home/u"), F.col("user_id").cast("string"), F.lit("/x")).alias("message"),
        F.when(F.col("value") < 20, "NETWORK_ERROR").otherwise("UNKNOWN").alias("error_class"),
        F.when(F.col("value") < 15, "").otherwise(F.concat(F.lit("/api/dub/"), F.col("user_id").cast("string"))).alias("route"),
        "user_id",
    )
    fp = rollups.error_fingerprint(F.col("error_class"), F.lit("RuntimeError"), F.col("message"))
    return rows.withColumn("fingerprint", fp)


@query("hash_error_fingerprint", sql=f"WITH {ERR_SQL} SELECT event_id, fingerprint FROM fp")
def error_fingerprints(spark, sf_dir):
    return errors(spark, sf_dir).select("event_id", "fingerprint")


@query(
    "agg_error_journal",
    sql=f"""WITH {ERR_SQL} SELECT fingerprint, ARG_MIN(error_class, (created_at, event_id)) AS error_class, ARG_MIN(message, (created_at, event_id)) AS message,
  ARG_MAX(route, (created_at, event_id)) FILTER (route<>'') AS route, MIN(created_at) AS first_seen, MAX(created_at) AS last_seen, COUNT(*) AS count
FROM fp GROUP BY 1 ORDER BY last_seen DESC, fingerprint LIMIT 50""",
)
def error_journal(spark, sf_dir):
    return rollups.error_journal(errors(spark, sf_dir))


CRASH_SQL = """r AS (SELECT CASE WHEN value < 2 THEN 'Backend died: ' || event_id WHEN value < 4 THEN 'The app is STILL STARTING' WHEN value < 6 THEN 'Can''t reach the local speech backend' ELSE event_type END AS title,
  CASE user_id%4 WHEN 0 THEN '**Version:** `1.2.0-rc1`' WHEN 1 THEN '**Version:** `1.1.9`' WHEN 2 THEN '**Build status:** OUTDATED' ELSE 'no stamp' END AS body, event_id FROM events),
c AS (SELECT event_id, CASE WHEN regexp_matches(title, 'can''?t reach the local .* backend|not answered|stopped responding', 'i') THEN 'unreachable'
   WHEN regexp_matches(title, 'still starting|abandoned before ready|failed to start', 'i') THEN 'never-started'
   WHEN regexp_matches(title, 'backend (died|ended uncleanly)|\\[crash\\]', 'i') THEN 'backend-died' END AS crash_class,
  CASE WHEN body LIKE '**Version:**%' THEN CASE WHEN SPLIT_PART(regexp_extract(body, '`([^`]+)`', 1), '-', 1)='1.2.0' THEN 'current' ELSE 'outdated' END
   WHEN body LIKE '%OUTDATED%' THEN 'outdated' WHEN body LIKE '%current at filing time%' THEN 'current' ELSE 'unknown' END AS b FROM r)"""


def _reports(spark, sf_dir):
    u = F.col("user_id") % 4
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("value") < 2, F.concat(F.lit("Backend died: "), F.col("event_id").cast("string")))
        .when(F.col("value") < 4, "The app is STILL STARTING")
        .when(F.col("value") < 6, "Can't reach the local speech backend")
        .otherwise(F.col("event_type"))
        .alias("title"),
        F.when(u == 0, "**Version:** `1.2.0-rc1`")
        .when(u == 1, "**Version:** `1.1.9`")
        .when(u == 2, "**Build status:** OUTDATED")
        .otherwise("no stamp")
        .alias("body"),
    )


@query(
    "agg_crash_pivot",
    sql=f"""WITH {CRASH_SQL} SELECT n.crash_class, COUNT(*) FILTER (b='current') AS current, COUNT(*) FILTER (b='outdated') AS outdated, COUNT(*) FILTER (b='unknown') AS unknown,
  CAST(SUM(COUNT(*) FILTER (b='current')) OVER () AS BIGINT) AS recurrence FROM (SELECT UNNEST(['unreachable', 'never-started', 'backend-died']) AS crash_class) n LEFT JOIN c USING (crash_class) GROUP BY 1""",
)
def crash_pivot(spark, sf_dir):
    return rollups.crash_report(_reports(spark, sf_dir), "1.2.0")


@query("str_classify_title", sql=f"WITH {CRASH_SQL} SELECT event_id, crash_class, b AS build FROM c")
def classify_title(spark, sf_dir):
    return _reports(spark, sf_dir).select(
        "event_id",
        rollups.crash_class(F.col("title")).alias("crash_class"),
        rollups.build_bucket(F.col("body"), "1.2.0").alias("build"),
    )


@query(
    "agg_cps_calibration",
    views="v_segments",
    sql=f"""WITH s AS (SELECT speaker_id, LENGTH(TRIM(text)) AS chars, {shapes.NATURAL} AS nat FROM v_segments),
r AS (SELECT speaker_id, chars*1000.0/nat AS rate FROM s WHERE nat >= 400 AND chars >= 4)
SELECT speaker_id, COUNT(rate) AS samples, ROUND(CASE WHEN COUNT(rate) >= 3 THEN MEDIAN(CAST(rate AS DOUBLE)) END, 6) AS cps FROM (SELECT DISTINCT speaker_id FROM s) LEFT JOIN r USING (speaker_id) GROUP BY 1""",
)
def cps_calibration(spark, sf_dir):
    samples = shapes.voiced(spark, sf_dir).withColumn("chars", F.length(F.trim("text")))
    out = rollups.cps_calibration(samples, ["speaker_id"], ["job_id", "seg_no"])
    return out.withColumn("cps", F.round("cps", 6))


@query(
    "agg_storage_rollup",
    views="v_files",
    sql="""SELECT CASE WHEN path LIKE 'dir1%' THEN 'outputs' WHEN path LIKE 'dir2%' THEN 'voices' WHEN path LIKE 'dir3%' THEN 'cache' ELSE 'other' END AS category,
  CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(*) AS files FROM v_files GROUP BY 1""",
)
def storage_rollup(spark, sf_dir):
    return rollups.storage_rollup(views.files(spark, sf_dir), {"outputs": "dir1", "voices": "dir2", "cache": "dir3"})


@query("topk_bytes", views="v_files", sql="SELECT path, bytes FROM v_files WHERE path LIKE 'dir3%' ORDER BY bytes DESC, path LIMIT 10")
def topk_bytes(spark, sf_dir):
    files = views.files(spark, sf_dir).filter(F.startswith(F.col("path"), F.lit("dir3")))
    return files.select("path", "bytes").orderBy(F.desc("bytes"), "path").limit(10)


@query(
    "agg_eval_pass_rate",
    sql="""WITH c AS (SELECT event_type AS suite, CASE WHEN user_id%9=0 THEN NULL ELSE props END AS t, value > 20 AS ok, CASE WHEN user_id%10=0 THEN 'judge failed' END AS e FROM events)
SELECT suite, COUNT(*) AS total, COUNT(*) FILTER (t IS NOT NULL AND e IS NULL AND ok) AS passed, COUNT(*) - COUNT(*) FILTER (t IS NOT NULL AND e IS NULL AND ok) AS failed,
  ROUND(COUNT(*) FILTER (t IS NOT NULL AND e IS NULL AND ok)/CAST(COUNT(*) AS DOUBLE), 4) AS pass_rate FROM c GROUP BY 1""",
)
def eval_pass_rate(spark, sf_dir):
    return rollups.pass_rate(_cases(spark, sf_dir), ["suite"])


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("suite"),
        F.col("event_id").alias("case_id"),
        F.when(F.col("user_id") % 9 != 0, F.col("props")).alias("transcript"),
        (F.col("value") > 20).alias("judge_passed"),
        F.when(F.col("user_id") % 10 == 0, "judge failed").alias("judge_error"),
    )


@query(
    "agg_status_counts",
    views="v_segments",
    sql=f"WITH {shapes.FIT_SQL} SELECT job_id, status, COUNT(*) AS segments, MAX(video_ratio) > 1.000001 AS retimed FROM fit GROUP BY 1,2",
)
def status_counts(spark, sf_dir):
    return rollups.status_counts(shapes.plan(spark, sf_dir))


@query(
    "flt_jobs",
    sql=f"WITH {JOBS_SQL} SELECT job_id, status, type, project_id, created_at FROM jobs WHERE status IN ('pending','running') AND project_id=7 ORDER BY created_at DESC, job_id DESC LIMIT 50",
)
def flt_jobs(spark, sf_dir):
    return filters.jobs(_jobs(spark, sf_dir), status="active", project_id=7, limit=50).drop("meta_json")


@query(
    "flt_gallery_search",
    sql="""SELECT p_partkey AS id, p_name AS name, p_brand AS character, p_type AS description FROM part WHERE p_type='ECONOMY' AND (p_name LIKE '%ri%' OR p_brand LIKE '%ri%' OR p_type LIKE '%ri%')
ORDER BY p_retailprice DESC, p_partkey""",
)
def gallery_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("character"),
        F.col("p_type").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("created_at"),
    )
    return filters.gallery(rows, "ECONOMY", "RI").drop("category", "created_at")


@query(
    "flt_facets",
    sql="""SELECT p_partkey AS id, p_name AS name FROM part WHERE CONTAINS(LOWER(p_name), 'red') AND p_type='SMALL' ORDER BY p_partkey LIMIT 20 OFFSET 5""",
)
def facets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("instruct"),
        F.struct(F.col("p_type").alias("gender"), F.col("p_size").alias("age")).alias("facets"),
    )
    out = filters.facets(rows, q=" RED ", wanted={"facets.gender": "SMALL"}, order=["id"], offset=5, limit=20)
    return out.select("id", "name")


@query(
    "flt_catalog_items",
    sql="""WITH k AS (SELECT p_partkey AS id, p_name AS name, COUNT(*) OVER () AS total FROM part WHERE p_type='LARGE' AND CONTAINS(LOWER(p_name), 'bolt'))
SELECT * FROM k ORDER BY id LIMIT 60 OFFSET 10""",
)
def catalog_items(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("use_case"))
    out = filters.catalog_page(rows, q="Bolt", wanted={"use_case": "LARGE"}, order=["id"], offset=10, limit=60)
    return out.select("id", "name", "total")


@query(
    "flt_allowlist_props",
    sql="""SELECT event_id, CASE WHEN LENGTH(event_type) <= 6 THEN 'k=' || json_extract_string(props, '$.k') || ',stage=' || event_type ELSE 'k=' || json_extract_string(props, '$.k') END AS kept FROM events""",
)
def allowlist_props(spark, sf_dir):
    props = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("stage"), F.col("event_type"), F.lit("path"), F.lit("/home/x")
    )
    kept = filters.allowed_properties(props, ["k", "stage"], 6)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return table(spark, sf_dir, "events").select("event_id", text.alias("kept"))


@query(
    "prj_repair_values",
    sql="""WITH raw AS (SELECT p_partkey AS id, CASE WHEN p_size=1 THEN '[object Object]' ELSE LOWER(p_type) || ' , ' || SPLIT_PART(p_name, ' ', 1) || ', small,BOLT' END AS instruct FROM part),
t AS (SELECT id, instruct, UNNEST(string_split(instruct, ',')) AS tag, UNNEST(range(1, len(string_split(instruct, ','))+1)) AS pos FROM raw),
c AS (SELECT id, instruct, LOWER(TRIM(tag)) AS tag, pos, CASE WHEN LOWER(TRIM(tag)) IN ('small','medium','large') THEN 0 WHEN LOWER(TRIM(tag)) IN ('red','blue','green') THEN 1 END AS cat FROM t),
f AS (SELECT * FROM c WHERE cat IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY id, cat ORDER BY pos)=1),
h AS (SELECT id, STRING_AGG(tag, ', ' ORDER BY pos) AS healed FROM f GROUP BY 1)
SELECT raw.id, COALESCE(h.healed, CASE WHEN raw.id%2=0 THEN 'green' ELSE '' END) AS instruct FROM raw LEFT JOIN h USING (id)
WHERE raw.instruct <> COALESCE(h.healed, CASE WHEN raw.id%2=0 THEN 'green' ELSE '' END)""",
)
def repair_values(spark, sf_dir):
    mixed = F.concat(F.lower("p_type"), F.lit(" , "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(", small,BOLT"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") == 1, "[object Object]").otherwise(mixed).alias("instruct"),
        F.when(F.col("p_partkey") % 2 == 0, "design").otherwise("clone").alias("kind"),
        F.lit('{"tone": "odd", "colour": "green"}').alias("vd_states"),
    )
    return filters.repair_tags(rows, [["small", "medium", "large"], ["red", "blue", "green"]])


@query("sort_newest_limit", sql="SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(100)


@query(
    "sort_priority_fifo",
    sql="SELECT o_orderkey AS task_id, o_orderpriority AS priority, o_orderdate AS created_at FROM orders WHERE o_orderstatus IN ('O','P')",
)
def priority_fifo(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    named = rows.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return named.orderBy("priority", "created_at", "task_id")


@query(
    "sort_nulls",
    sql="""SELECT c_custkey AS client_id, l AS last_seen FROM customer LEFT JOIN (SELECT o_custkey, MAX(CASE WHEN o_totalprice > 400000 THEN o_orderdate END) AS l FROM orders GROUP BY 1) x ON o_custkey=c_custkey""",
)
def sort_nulls(spark, sf_dir):
    large = F.when(F.col("o_totalprice") > 400000, F.col("o_orderdate"))
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("client_id")).agg(F.max(large).alias("last_seen"))
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
    return clients.join(seen, "client_id", "left").orderBy(F.desc_nulls_last("last_seen"), F.desc("client_id"))


@query(
    "win_top_n_per_group",
    views="v_takes",
    sql="SELECT profile_id, id, created_at, ROW_NUMBER() OVER (PARTITION BY profile_id ORDER BY created_at DESC, id DESC) AS rank FROM v_takes QUALIFY rank <= 20",
)
def top_n(spark, sf_dir):
    takes = views.takes(spark, sf_dir).select("profile_id", "id", "created_at")
    return top_per_group(takes, ["profile_id"], [F.desc("created_at"), F.desc("id")], 20)


@query(
    "sink_upsert_history",
    sql="""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS language, o_orderpriority AS content_hash, o_custkey AS segments FROM orders WHERE o_totalprice > 100000),
i AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus='F' THEN '' ELSE 'x' END AS language, CASE WHEN o_custkey%2=0 THEN NULL ELSE 'new' END AS content_hash, o_custkey+1 AS segments FROM orders WHERE o_totalprice < 300000)
SELECT COALESCE(i.id, s.id) AS id, COALESCE(NULLIF(i.language,''), s.language, i.language) AS language, COALESCE(NULLIF(i.content_hash,''), s.content_hash, i.content_hash) AS content_hash,
  CASE WHEN i.id IS NOT NULL THEN i.segments ELSE s.segments END AS segments FROM s FULL JOIN i ON s.id=i.id""",
)
def upsert_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stored = orders.filter(F.col("o_totalprice") > 100000).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("language"),
        F.col("o_orderpriority").alias("content_hash"),
        F.col("o_custkey").alias("segments"),
    )
    incoming = orders.filter(F.col("o_totalprice") < 300000).select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("x").alias("language"),
        F.when(F.col("o_custkey") % 2 != 0, "new").alias("content_hash"),
        (F.col("o_custkey") + 1).alias("segments"),
    )
    store = KeyedStore(spark, scratch_path(spark, "history"), stored.schema, ["id"], 16)
    store.merge(stored, upsert(["id"]), "load")
    merge = partial(lookups.upsert_history, guarded=["language", "content_hash"])
    for half in (0, 1):
        store.merge(incoming.filter(F.col("id") % 2 == half), merge, f"incoming {half}")
    return store.read()
