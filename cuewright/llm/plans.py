"""One query per training-data operator, each over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import (
    centroid_clustering,
    chat_format,
    collocations,
    decontamination,
    exact_dedup,
    mixing,
    near_dup,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
    window_dedup,
)
from cuewright.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, COALESCE(text, '') AS t,
    list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
gw AS (SELECT doc_id, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS g FROM g),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gw) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, unnest(range(0, 8)) AS r(k) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(COALESCE(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS r1,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS r2,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS r3,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS r4 FROM m),
q AS (SELECT lang, source, GROUPING(lang, source) AS lvl, count(*) AS n, quantile_disc(r4, 0.1) AS l4, quantile_disc(r4, 0.01) AS b4,
    quantile_disc(r1, 0.5) AS m1, quantile_disc(r1, 0.9) AS u1, quantile_disc(r1, 0.99) AS e1,
    quantile_disc(r2, 0.5) AS m2, quantile_disc(r2, 0.99) AS u2, quantile_disc(r2, 0.99) AS e2,
    quantile_disc(r3, 0.5) AS m3, quantile_disc(r3, 0.99) AS u3, quantile_disc(r3, 0.99) AS e3,
    quantile_disc(r4, 0.5) AS m4, quantile_disc(r4, 0.9) AS u4, quantile_disc(r4, 0.99) AS e4
  FROM r WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (SELECT r.*, CASE WHEN s.n >= 100 THEN s WHEN l.n >= 100 THEN l ELSE w END AS y,
    CASE WHEN s.n >= 1000 THEN s WHEN l.n >= 1000 THEN l ELSE w END AS z
  FROM r LEFT JOIN q s ON s.lvl = 0 AND r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source
  LEFT JOIN q l ON l.lvl = 1 AND r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN q w ON w.lvl = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND r1 <= y.u1 + 2.0 * (y.u1 - y.m1) + 0.1 * (y.e1 - y.u1) + 0.01
  AND r2 <= z.u2 + 2.0 * (z.u2 - z.m2) + 0.1 * (z.e2 - z.u2) + 0.01
  AND r3 <= z.u3 + 2.0 * (z.u3 - z.m3) + 0.1 * (z.e3 - z.u3) + 0.01
  AND r4 BETWEEN y.l4 + 2.0 * (y.l4 - y.m4) + 0.1 * (y.b4 - y.l4) - 0.5
             AND y.u4 + 2.0 * (y.u4 - y.m4) + 0.1 * (y.e4 - y.u4) + 0.5 AS kept
FROM f
"""


@query("op10_quality_rules", RULES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *counts)


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


WINDOWS_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(list_aggregate(w[i:i+49], 'string_agg', ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, unnest(range(0, 50)) AS s(k)),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed,
  sha256(COALESCE(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""


@query("op7_window_dedup", WINDOWS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return cut.select("doc_id", "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_near_dup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


CONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
q AS (SELECT item_id, least(len(w), 13) AS n, list_aggregate(w[i:i+least(len(w), 13)-1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, g.n FROM g JOIN q ON g.g = q.g AND g.n = q.n),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
fr AS (SELECT word, count(*) AS f FROM (SELECT unnest(w) AS word FROM dw) GROUP BY word),
it AS (SELECT item_id, w, row_number() OVER () AS it
  FROM (SELECT DISTINCT COALESCE(CAST(item_id AS VARCHAR), '') AS item_id, w FROM bw WHERE len(w) > 0)),
ip AS (SELECT it, q, word, COALESCE(f, 0) AS f FROM (SELECT it, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM it) LEFT JOIN fr USING (word)),
iw AS (SELECT it, item_id, s, w[s+1:s+13] AS phrase FROM (SELECT *, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM it)),
pk AS (SELECT * FROM (SELECT iw.it, s, q, word, least(3, len(phrase)) AS np, row_number() OVER (PARTITION BY iw.it, s ORDER BY f, q) AS k,
    min(f) OVER (PARTITION BY iw.it, s) AS rarest FROM iw JOIN ip ON iw.it = ip.it AND q BETWEEN s AND s + 12) WHERE k <= 3 AND rarest > 0),
po AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM dw) WHERE word IN (SELECT word FROM pk)),
sh AS (SELECT doc_id, it, s, k, np, pos - q AS d FROM po JOIN pk USING (word)),
ex AS (SELECT DISTINCT doc_id, it, s, k AS other, d + e AS d FROM (SELECT *, unnest(range(-3, 4)) AS e FROM sh WHERE k > 1)),
nr AS (SELECT sh.doc_id, sh.it, sh.s, sh.d FROM sh LEFT JOIN ex ON sh.doc_id = ex.doc_id AND sh.it = ex.it AND sh.s = ex.s AND sh.d = ex.d
  WHERE k = 1 GROUP BY ALL HAVING count(other) = any_value(np) - 1),
nw AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, it, s FROM nr) GROUP BY doc_id),
nd AS (SELECT doc_id, string_agg(place, ',' ORDER BY place) AS places FROM (SELECT DISTINCT nr.doc_id, item_id || ':' || CAST(d + nr.s AS VARCHAR) AS place
    FROM nr JOIN iw ON nr.it = iw.it AND nr.s = iw.s JOIN dw ON nr.doc_id = dw.doc_id
    WHERE d + nr.s < 0 OR w[d+nr.s+1:d+nr.s+len(phrase)] <> phrase) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated,
  CAST(COALESCE(n_near, 0) AS BIGINT) AS n_near, sha256(COALESCE(places, '')) AS near_sha256
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN n ON dw.doc_id = n.doc_id
LEFT JOIN nw ON dw.doc_id = nw.doc_id LEFT JOIN nd ON dw.doc_id = nd.doc_id
"""


@query("op3_decontamination", CONTAMINATION_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    places = F.transform("near", lambda m: F.concat_ws(":", m["item_id"], m["start"].cast("string")))
    near = F.sha2(F.array_join(F.array_sort(F.array_distinct(places)), ","), 256).alias("near_sha256")
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, "contaminated", "n_near", near)


STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "[user] ", "[bot] "),
    ("Instructions: ", "Q: ", "A: "),
)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as lines of raw transcripts, with the true turn and role of each line.

    The style of markers differs between conversations, and every fifth turn after the first comes
    without its marker, after a blank line only.
    """
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.coalesce(F.col("conv"), F.lit(0)), F.lit(len(STYLES)))
    marker = F.lit("")
    for s, marks in enumerate(STYLES):
        for role, mark in zip(chat_format.ROLES, marks):
            marker = F.when((style == s) & (F.col("role") == role), mark).otherwise(marker)
    silent = (F.col("turn") > 0) & (F.crc32(F.concat_ws(":", "conv", "turn").cast("binary")) % 5 == 0)
    lines = F.split(F.concat(F.when(silent, "").otherwise(marker), "text"), "\n")
    flat = turns.select("conv", "turn", "role", F.posexplode(lines).alias("i", "line")).filter(F.trim("line") != "")
    part = F.floor(F.col("turn") / 256).cast("long").alias("part")
    no = F.shiftleft("turn", 32) + F.col("i")
    blank = (F.col("i") == 0) & (F.col("turn") > 0)
    return flat.select("conv", "turn", "role", part, no.alias("no"), "i", "line", blank.alias("blank"))


@query("op1_chat_format")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_transcripts(table(spark, sf_dir, "conversations"))
    labelled = lines.filter(F.crc32(F.col("conv").cast("string").cast("binary")) % 5 != 0)
    model = chat_format.train(labelled.select("conv", "turn", F.col("i").alias("no"), "line", "blank", "role"))
    return chat_format.render(lines.select("conv", "part", "no", "line", "blank"), model)


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.load(VOCABULARY))


MIX = {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, "poor": 0.05}


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled documents: poor quality, else the language."""
    known = labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id")
    return known.select("doc_id", F.when(F.col("quality") == 0, "poor").otherwise(F.col("lang")).alias("domain"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, domains(docs, table(spark, sf_dir, "labels")), MIX)
    return mixed.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(MIX)], "rate")


COPIES_SQL = r"""
WITH t AS (SELECT doc_id, length(COALESCE(text, '')) AS points,
    sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM f
"""


@query("op11_exact_dedup", COPIES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


PHRASES_SQL = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
w AS (SELECT lang, id, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM q),
t AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY lang, id ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM t GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT lang, w1 || ' ' || w2 AS phrase, f2.f AS a, 1 AS cut, x.f AS l, y.f AS r FROM f2 JOIN f1 x USING (lang, w1)
    JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2)
    WHERE NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
      AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x USING (lang, w1)
    JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) y USING (lang, w2, w3)
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x USING (lang, w1, w2)
    JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3)),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM (SELECT *, (1000000 * a * a) // (l * r) AS score FROM s)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM m WHERE place = 1),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", PHRASES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


CENTROIDS, ROUNDS = 40, 5


def clusters_sql() -> str:
    """Rounds as one common table each: distances to all centroids, the nearest one, floors of means."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64)
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS number, v AS c
  FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {CENTROIDS}))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(distance := d, number := number)) AS near FROM (SELECT vec_id, v, number,
    CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id, v)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (SELECT number, i, sum(x) AS s, count(*) AS n
  FROM (SELECT near.number AS number, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY number, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.number, COALESCE(q.c, c{r}.c) AS c FROM c{r} LEFT JOIN
  (SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY number) q ON q.number = c{r}.number)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(near.number AS INTEGER) AS cluster, near.distance AS distance,
  CAST(sum(near.distance) OVER (PARTITION BY near.number) AS BIGINT) AS cluster_inertia, CAST(sum(near.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON number = near.number"""
    )


@query("op13_centroid_clustering", clusters_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS).drop("centroid")
