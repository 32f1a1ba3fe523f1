"""Queries whose state runs over the rows of a job, a text or a segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions import chunks, describe
from cuewright.functions import text as T
from cuewright.operators import folding, segmenting
from cuewright.plans import shapes
from cuewright.plans.registry import query
from cuewright.session import spread
from cuewright.views import table


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def pieces(rows, column):
    return rows.select("doc_id", F.posexplode(column).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("str_chunk_max_chars")
def chunk_max_chars(spark, sf_dir):
    return pieces(docs(spark, sf_dir), chunks.chunks_of(F.col("text"), 800))


@query("str_chunk_punctuation")
def chunk_punctuation(spark, sf_dir):
    return pieces(docs(spark, sf_dir), chunks.punctuation_chunks_of(F.col("text"), 200, 50))


@query(
    "str_wrap_lines",
    views="v_segments",
    sql="""WITH t AS (SELECT job_id, seg_no, string_split(TRIM(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tk FROM v_segments WHERE TRIM(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
w AS (SELECT job_id, seg_no, UNNEST(tk) AS w, UNNEST(range(1, len(tk)+1)) AS i, LENGTH(tk[1]) AS first FROM t),
c AS (SELECT *, SUM(LENGTH(w)+1) OVER (PARTITION BY job_id, seg_no ORDER BY i)-1 AS upto FROM w)
SELECT job_id, seg_no, CASE WHEN first > 42 OR upto <= 42 THEN 0::BIGINT ELSE 1 END AS pos, STRING_AGG(w, ' ' ORDER BY i) AS line FROM c GROUP BY 1,2,3""",
)
def wrap_lines(spark, sf_dir):
    rows = views.segments(spark, sf_dir).select("job_id", "seg_no", F.posexplode(T.wrapped(F.col("text"))).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("str_collapse_repeats")
def collapse_repeats(spark, sf_dir):
    body = F.concat(F.lit("URL url, URL. url URL URL "), "text", F.repeat(F.lit(" thanks for watching"), F.lit(7)))
    once = docs(spark, sf_dir).select("doc_id", T.without_token_loops(body).alias("once"))
    return once.select("doc_id", T.without_character_loops(F.col("once")).alias("out"))


PAGE_SQL = r"""WITH v AS (SELECT page_id, regexp_replace(COALESCE(html, ''), '(?is)<(script|style|head)\b.*?</(script|style|head)\s*>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_extract(h, '(?is)<(title|h1|h2)\b[^>]*>(.*?)</(title|h1|h2)\s*>', 2) AS title,
  regexp_replace(h, '(?is)<(title|h1|h2)\b[^>]*>.*?</(title|h1|h2)\s*>', '<br>') AS rest FROM v),
b AS (SELECT page_id, trim(regexp_replace(title, '(?s)<[^>]*>', '', 'g'), chr(10) || ' ') AS title,
  regexp_replace(regexp_replace(rest, '(?is)<(p|br|div|h1|h2|h3|li|tr)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS body FROM t),
l AS (SELECT page_id, title, regexp_replace(regexp_replace(body, '[ \t\r]*\n[ \t\r]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM b)
SELECT page_id, replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS title,
  replace(replace(replace(replace(replace(replace(trim(body, chr(10) || chr(9) || chr(13) || ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS body FROM l"""


@query("str_html_text", sql=PAGE_SQL)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *T.page_text(F.col("html")))


LINE_SQL = """l AS (SELECT doc_id, TRIM(regexp_replace(UNNEST(ls), '\\s+', ' ', 'g')) AS line, UNNEST(range(1, len(ls)+1)) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(text, '[\\[\\]#\\r\\f]', '', 'g'), chr(10)) AS ls FROM documents) x)"""


def scripts(spark, sf_dir):
    """Documents as long-form scripts: a chapter per line, read slowly, then a pause and a closing word."""
    lines = F.split(F.regexp_replace("text", r"[\[\]#\r\f]", ""), "\n")
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    parts = F.transform(
        tidy, lambda x, i: F.concat(F.lit("# Title "), (i + 1).cast("string"), F.lit("\n[voice:ann][slow]"), x, F.lit("[/slow][pause 1s]end"))
    )
    return docs(spark, sf_dir).select("doc_id", F.array_join(parts, "\n").alias("script"))


@query(
    "str_chapter_spans",
    sql=f"""WITH {LINE_SQL} SELECT doc_id, CAST(i AS INTEGER) AS chapter_no, 'Title ' || i AS title, 1 AS span_no, 'ann' AS voice, line AS text, 1000 AS pause_ms, CASE WHEN line='' THEN NULL ELSE 0.85::DOUBLE END AS speed FROM l
UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'Title ' || i, 2, 'ann', 'end', 0, NULL FROM l""",
)
def chapter_spans(spark, sf_dir):
    return scripts(spark, sf_dir).select("doc_id", F.explode(chunks.spans_of(F.col("script"))).alias("s")).select("doc_id", "s.*")


@query(
    "agg_plan_counts",
    sql=f"WITH {LINE_SQL} SELECT doc_id, COUNT(*) AS chapters, CAST(SUM(LENGTH(line)+3) AS BIGINT) AS characters FROM l GROUP BY 1",
)
def plan_counts(spark, sf_dir):
    spans = chapter_spans(spark, sf_dir)
    return spans.groupBy("doc_id").agg(
        F.count_distinct("chapter_no").alias("chapters"), F.sum(F.length("text").cast("long")).alias("characters")
    )


@query("udtf_chunks")
def udtf_chunks(spark, sf_dir):
    """The chunker as a table function joined laterally in SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos bigint, piece string", useArrow=True)
    class Chunks:
        def eval(self, text: str, limit: int):
            yield from enumerate(chunks.chunk_by_chars(text or "", limit))

    spark.udtf.register("text_chunks", Chunks)
    table(spark, sf_dir, "documents").createOrReplaceTempView("cuewright_documents")
    return spark.sql("SELECT doc_id, c.pos, c.piece FROM cuewright_documents, LATERAL text_chunks(text, 400) c")


@query(
    "str_describe_parse",
    sql="""SELECT event_id, CASE event_type WHEN 'click' THEN 'female, elderly, low pitch, british accent' WHEN 'view' THEN 'male, young adult, very low pitch, whisper' WHEN 'error' THEN 'child, high pitch, 四川话' WHEN 'signup' THEN 'middle-aged, american accent' ELSE '' END AS instruct FROM events""",
)
def describe_parse(spark, sf_dir):
    kind = F.col("event_type")
    said = (
        F.when(kind == "click", "An old lady from London, husky")
        .when(kind == "view", "very deep whispery young man")
        .when(kind == "error", "8 years old, high-pitched, Sichuan or British")
        .when(kind == "signup", "45yo New  York")
        .otherwise("raspy storyteller")
    )
    tokens = describe.describe(said)
    return table(spark, sf_dir, "events").select("event_id", describe.instruct(tokens).alias("instruct"))


# The greedy grouping as a machine that takes one word of each job per step.
SEGMENT_SQL = f"""WITH RECURSIVE o AS (SELECT *, LEAD(word_start) OVER (PARTITION BY job_id ORDER BY seg_no, word_no) AS nx FROM v_words),
w AS (SELECT job_id, LIST(word_start ORDER BY seg_no, word_no) AS b, LIST(word_end ORDER BY seg_no, word_no) AS e, LIST(LENGTH(word)+1 ORDER BY seg_no, word_no) AS ch, LIST(word ORDER BY seg_no, word_no) AS word,
  LIST(regexp_matches(word, '{segmenting.SENTENCE_TAIL.replace("'", "''")}') ORDER BY seg_no, word_no) AS sent, LIST(regexp_matches(word, '{segmenting.CLAUSE_TAIL}') ORDER BY seg_no, word_no) AS cl,
  LIST(GREATEST(COALESCE(nx-word_end, 0), 0) ORDER BY seg_no, word_no) AS pa, COUNT(*) AS n FROM o GROUP BY 1),
m(job_id, i, head, heads) USING KEY (job_id) AS (
  SELECT job_id, 1::BIGINT, 1::BIGINT, [1::BIGINT] FROM w
  UNION
  SELECT job_id, i+1, next, CASE WHEN next <> head AND next <= n THEN list_append(heads, next) ELSE heads END FROM (
    SELECT *, CASE WHEN sent[i] AND span >= 4500 AND held >= 12 THEN i+1 WHEN NOT whole THEN head WHEN sent[i] OR cl[i] OR pa[i] >= 350 THEN i+1
      ELSE COALESCE(list_min(list_transform(list_filter(range(head, i), lambda k: e[k]-b[head] >= 1500 AND e[i]-b[k+1] >= 1500),
        lambda k: {{'score': ABS(e[k]-b[head]-4500) - CASE WHEN sent[k] THEN 2000 WHEN cl[k] THEN 800 ELSE 0 END, 'k': k}})).k, i)+1 END AS next
    FROM (SELECT *, span >= 9000 OR held >= 140 AS whole FROM (SELECT m.i, m.head, m.heads, w.*, e[i]-b[head] AS span, list_sum(ch[head:i]) AS held FROM m JOIN w USING (job_id) WHERE m.i <= w.n) x) y) z)
SELECT job_id, head, b[head] AS start_ms, e[upto] AS end_ms, array_to_string(word[head:upto], ' ') AS text, upto-head+1 AS words
FROM (SELECT w.*, head, COALESCE(LEAD(head) OVER (PARTITION BY w.job_id ORDER BY head)-1, n) AS upto FROM w JOIN (SELECT job_id, UNNEST(heads) AS head FROM m) h USING (job_id)) x"""


@query("grp_words_to_segments", views="v_words", sql=SEGMENT_SQL)
def words_to_segments(spark, sf_dir):
    return segmenting.word_lists_to_segments(views.word_lists(spark, sf_dir))


def fragments(spark, sf_dir):
    """Short segments: one to four words at a time."""
    size = F.col("seg_no") % 4 + 1
    w = views.words(spark, sf_dir).withColumn("frag", F.floor((F.col("word_no") - 1) / size))
    parts = F.array_sort(F.collect_list(F.struct("word_no", "word")))
    rows = w.groupBy("job_id", "seg_no", "frag", "speaker_id").agg(
        F.min("word_start").alias("start_ms"), F.max("word_end").alias("end_ms"), F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("text")
    )
    return rows.select("job_id", (F.shiftleft("seg_no", 32) + F.col("frag")).alias("seg_no"), "start_ms", "end_ms", "text", "speaker_id")


def folding_sql(*phases: str, where: str = "TRUE") -> str:
    """The passes as a machine that handles one part of each job per step: ``rest`` waits, ``done`` is behind.

    A pass that joins nothing ends its phase, ``fold`` or ``stitch``.
    """
    stitching = " OR ".join(f"phase = {i}" for i, name in enumerate(phases, 1) if name == "stitch") or "FALSE"
    return f"""WITH RECURSIVE fr AS (SELECT job_id, seg_no*4294967296+(word_no-1)//(seg_no%4+1) AS seg, ANY_VALUE(speaker_id) AS who, MIN(word_start) AS a, MAX(word_end) AS b,
  STRING_AGG(word, ' ' ORDER BY word_no) AS t FROM v_words GROUP BY 1,2),
m(job_id, rest, done, n0, pass, phase) USING KEY (job_id) AS (
  SELECT job_id, LIST({{'s': a, 'e': b, 't': t, 'w': who, 'f': seg, 'n': 1::BIGINT}} ORDER BY seg), []::STRUCT(s BIGINT, e BIGINT, t VARCHAR, w VARCHAR, f BIGINT, n BIGINT)[], COUNT(*), 1, 1
  FROM fr WHERE {where} GROUP BY job_id
  UNION
  SELECT job_id,
    CASE WHEN p IS NULL THEN CASE WHEN finished THEN [] ELSE done END WHEN target = 2 THEN list_prepend({{'s': LEAST(h.s, p.s), 'e': h.e, 't': p.t || ' ' || h.t, 'w': h.w, 'f': p.f, 'n': p.n + h.n}}, rest[3:]) ELSE rest[2:] END,
    CASE WHEN p IS NULL THEN CASE WHEN finished THEN done ELSE [] END WHEN target = 0 THEN list_append(done, p) WHEN target = 1
      THEN list_append(done[1:len(done)-1], {{'s': k.s, 'e': CASE WHEN stitching THEN p.e ELSE GREATEST(k.e, p.e) END, 't': k.t || ' ' || p.t, 'w': k.w, 'f': k.f, 'n': k.n + p.n}}) ELSE done END,
    CASE WHEN p IS NULL THEN len(done) ELSE n0 END, CASE WHEN p IS NOT NULL THEN pass WHEN settled THEN 1 ELSE pass + 1 END, CASE WHEN p IS NULL AND settled THEN phase + 1 ELSE phase END
  FROM (SELECT *, settled AND phase = {len(phases)} AS finished, CASE WHEN stitching THEN CASE WHEN sk AND gk <= 900 AND GREATEST(k.e-k.s, p.e-p.s) <= 2500 AND p.e-k.s <= 9000 THEN 1 ELSE 0 END
      WHEN NOT short THEN 0 WHEN sk AND gk <= near AND sh AND gh <= near THEN CASE WHEN k.e-k.s <= h.e-h.s THEN 1 ELSE 2 END WHEN sk AND gk <= near THEN 1 WHEN sh AND gh <= near THEN 2
      WHEN sk THEN 1 WHEN sh THEN 2 WHEN stray AND k IS NOT NULL AND h IS NOT NULL THEN CASE WHEN gk <= gh THEN 1 ELSE 2 END WHEN k IS NOT NULL THEN 1 WHEN h IS NOT NULL THEN 2 ELSE 0 END AS target
    FROM (SELECT *, len(done) = n0 OR pass = CASE WHEN stitching THEN 32 ELSE 64 END AS settled, p.e-p.s < 1500 OR LENGTH(p.t) < 12 OR CASE WHEN tok >= 3 THEN tok ELSE GREATEST(tok, LENGTH(REPLACE(p.t, ' ', ''))//2) END < 3 AS short,
        CASE WHEN stray THEN 2000 ELSE 600 END AS near, p.s-k.e AS gk, h.s-p.e AS gh, COALESCE(k.w = p.w, FALSE) AS sk, COALESCE(h.w = p.w, FALSE) AS sh
      FROM (SELECT *, p.e-p.s < 500 OR LENGTH(p.t) < 4 AS stray, len(string_split(p.t, ' ')) AS tok
        FROM (SELECT *, rest[1] AS p, rest[2] AS h, done[len(done)] AS k, {stitching} AS stitching FROM m WHERE phase <= {len(phases)}) z1) z2) z3) z4)
SELECT job_id, d.f AS seg_no, d.s AS start_ms, d.e AS end_ms, d.t AS text, d.w AS speaker_id, d.n AS joined FROM (SELECT job_id, UNNEST(done) AS d FROM m WHERE phase > {len(phases)})"""


@query("grp_merge_short", views="v_words", sql=folding_sql("fold"))
def merge_short(spark, sf_dir):
    return folding.merge_short(fragments(spark, sf_dir))


@query("grp_stitch", views="v_words", sql=folding_sql("stitch"))
def stitch(spark, sf_dir):
    return folding.stitch(fragments(spark, sf_dir))


@query("grp_clean_up", views="v_words", sql=folding_sql("fold", "stitch", "fold", where="b > a AND t <> ''").replace(", d.n AS joined", ""))
def clean_up(spark, sf_dir):
    return folding.clean_up(fragments(spark, sf_dir))


@query("grp_scene_cuts", views="v_segments")
def scene_cuts(spark, sf_dir):
    cuts = views.turns(spark, sf_dir).select("job_id", F.col("turn_start").alias("cut_ms"))
    return segmenting.scene_cuts(views.segments(spark, sf_dir), cuts)


LABEL_SQL = """
ov AS (SELECT w.job_id, w.seg_no, w.word_no, t.speaker, SUM(LEAST(word_end, turn_end)-GREATEST(word_start, turn_start)) AS o, MIN(turn_no) AS f
  FROM v_words w JOIN v_turns t ON w.job_id=t.job_id AND LEAST(word_end, turn_end) > GREATEST(word_start, turn_start) GROUP BY 1,2,3,4),
best AS (SELECT * FROM ov QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, seg_no, word_no ORDER BY o DESC, f) = 1),
mid AS (SELECT w.job_id, w.seg_no, w.word_no, ARG_MIN(t.speaker, t.turn_no) AS speaker FROM v_words w JOIN v_turns t
  ON w.job_id=t.job_id AND turn_start*2 <= word_start+word_end AND word_start+word_end <= turn_end*2 GROUP BY 1,2,3),
lab AS (SELECT w.*, 'Speaker ' || CAST(CAST(SUBSTR(COALESCE(b.speaker, m.speaker), 9) AS INT)+1 AS VARCHAR) AS l FROM v_words w
  LEFT JOIN best b USING (job_id, seg_no, word_no) LEFT JOIN mid m USING (job_id, seg_no, word_no)),
fil AS (SELECT job_id, seg_no, word_no, word, word_start, word_end, COALESCE(LAST_VALUE(l IGNORE NULLS) OVER (PARTITION BY job_id, seg_no ORDER BY word_no ROWS UNBOUNDED PRECEDING),
  FIRST_VALUE(l IGNORE NULLS) OVER (PARTITION BY job_id, seg_no ORDER BY word_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS l FROM lab),
nx AS (SELECT *, LEAD(l) OVER (PARTITION BY job_id, seg_no ORDER BY word_no) AS n, LEAD(1) OVER (PARTITION BY job_id, seg_no ORDER BY word_no) AS more FROM fil),
sm AS (SELECT job_id, seg_no, word_no, l AS label FROM nx WHERE word_no=1
  UNION ALL SELECT x.job_id, x.seg_no, x.word_no, CASE WHEN x.more=1 AND x.l IS DISTINCT FROM s.label AND s.label IS NOT DISTINCT FROM x.n THEN s.label ELSE x.l END
  FROM sm s JOIN nx x ON x.job_id=s.job_id AND x.seg_no=s.seg_no AND x.word_no=s.word_no+1)"""


@query("grp_smooth_labels", views="v_words v_turns", sql=f"WITH RECURSIVE {LABEL_SQL} SELECT job_id, seg_no, word_no, label FROM sm")
def smooth_labels(spark, sf_dir):
    out = segmenting.smoothed_words(views.words(spark, sf_dir), views.turns(spark, sf_dir))
    return out.select("job_id", "seg_no", "word_no", "label")


@query(
    "grp_resplit_speakers",
    views="v_words v_turns",
    sql=f"""WITH RECURSIVE {LABEL_SQL},
c AS (SELECT sm.*, word, word_start, word_end, CASE WHEN LAG(label) OVER w IS NOT DISTINCT FROM label AND LAG(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch
  FROM sm JOIN fil USING (job_id, seg_no, word_no) WINDOW w AS (PARTITION BY sm.job_id, sm.seg_no ORDER BY sm.word_no)),
r AS (SELECT *, CAST(SUM(ch) OVER (PARTITION BY job_id, seg_no ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c),
g AS (SELECT job_id, seg_no, run, ANY_VALUE(label) AS label, MIN(word_start) AS a, MAX(word_end) AS b, STRING_AGG(word, ' ' ORDER BY word_no) AS t FROM r GROUP BY 1,2,3),
m AS (SELECT *, MAX(run) OVER (PARTITION BY job_id, seg_no) AS n FROM g QUALIFY n > 1)
SELECT s.job_id, s.seg_no, COALESCE(run-1, 0) AS piece, CASE WHEN run > 1 THEN a ELSE start_ms END AS start_ms, CASE WHEN run < n THEN b ELSE end_ms END AS end_ms,
  COALESCE(t, s.text) AS text, COALESCE(label, speaker_id) AS speaker_id FROM v_segments s LEFT JOIN m ON m.job_id=s.job_id AND m.seg_no=s.seg_no""",
)
def resplit_speakers(spark, sf_dir):
    return segmenting.resplit_speakers(views.segments(spark, sf_dir), views.words(spark, sf_dir), views.turns(spark, sf_dir))


def subtitle_cues(spark, sf_dir):
    rows = views.segments(spark, sf_dir).filter(F.trim("text") != "")
    cues = chunks.cues_of(F.col("text"), F.col("start_ms") / 1000, F.col("end_ms") / 1000)
    return rows.select("job_id", "seg_no", "speaker_id", F.posexplode(cues).alias("pos", "c"))


@query("grp_subtitle_split", views="v_segments")
def subtitle_split(spark, sf_dir):
    return subtitle_cues(spark, sf_dir).select(
        "job_id", "seg_no", F.col("pos").cast("long").alias("pos"), F.round("c.start", 3).alias("start_s"), F.round("c.end", 3).alias("end_s"), "c.text"
    )


@query(
    "grp_subtitle_merge",
    views="v_words",
    sql="""WITH RECURSIVE fr AS (SELECT job_id, seg_no*100000+(word_no-1)//(seg_no%4+1) AS cue, ANY_VALUE(speaker_id) AS who, MIN(word_start) AS a, MAX(word_end) AS b, STRING_AGG(word, ' ' ORDER BY word_no) AS t FROM v_words GROUP BY 1,2),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY cue) AS rn FROM fr),
m AS (SELECT job_id, rn, rn AS head, a, b, t, who FROM c WHERE rn=1
  UNION ALL SELECT job_id, rn, CASE WHEN ok THEN head ELSE rn END, CASE WHEN ok THEN pa ELSE a END, b, CASE WHEN ok THEN pt || ' ' || t ELSE t END, who FROM (
    SELECT c.job_id, c.rn, m.head, m.a AS pa, m.t AS pt, c.a, c.b, c.t, c.who, (m.b-m.a < 1200 OR c.b-c.a < 1200 OR LENGTH(m.t) < 8 OR LENGTH(c.t) < 8) AND LENGTH(m.t)+1+LENGTH(c.t) <= 84
      AND (LENGTH(m.t)+1+LENGTH(c.t))*1000 <= 17*GREATEST(c.b-m.a, 1) AND NOT regexp_matches(m.t || ' ', '[.!?。！？]+\\s+') AND m.who=c.who AS ok
    FROM m JOIN c ON c.job_id=m.job_id AND c.rn=m.rn+1) z)
SELECT job_id, head, ARG_MAX(a, rn) AS start_ms, MAX(b) AS end_ms, ARG_MAX(t, rn) AS text, ARG_MAX(who, rn) AS speaker_id, COUNT(*) AS merged FROM m GROUP BY 1,2""",
)
def subtitle_merge(spark, sf_dir):
    cues = fragments(spark, sf_dir).withColumnRenamed("seg_no", "cue_no")
    return segmenting.merge_cues(cues)


@query(
    "grp_reference_slices",
    views="v_segments",
    sql="""WITH RECURSIVE h AS (SELECT job_id, seg_no, speaker_id, start_ms, CAST(FLOOR((start_ms+end_ms)/2.0) AS BIGINT) AS end_ms FROM v_segments),
k AS (SELECT *, end_ms-start_ms AS dur_ms, EXISTS (SELECT 1 FROM h o WHERE o.job_id=s.job_id AND o.speaker_id<>s.speaker_id AND GREATEST(o.start_ms-s.end_ms, s.start_ms-o.end_ms) < 300) AS near FROM h s),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id, speaker_id ORDER BY near, dur_ms DESC, seg_no) AS rn FROM k WHERE dur_ms >= 1500 AND job_id%7<>0),
p AS (SELECT job_id, speaker_id, seg_no, dur_ms, rn, TRUE AS taken, dur_ms AS total FROM r WHERE rn=1
  UNION ALL SELECT r.job_id, r.speaker_id, r.seg_no, r.dur_ms, r.rn, p.total < 8000 AND p.total+r.dur_ms <= 15000, CASE WHEN p.total < 8000 AND p.total+r.dur_ms <= 15000 THEN p.total+r.dur_ms ELSE p.total END
  FROM p JOIN r ON r.job_id=p.job_id AND r.speaker_id=p.speaker_id AND r.rn=p.rn+1),
t AS (SELECT job_id, speaker_id, MAX(total) AS total FROM p GROUP BY 1,2)
SELECT job_id, speaker_id, seg_no, dur_ms FROM p JOIN t USING (job_id, speaker_id) WHERE taken AND t.total >= 5000""",
)
def reference_slices(spark, sf_dir):
    """Slices come from the segments cut to half their length, which brings them into range."""
    segs = views.segments(spark, sf_dir)
    half = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    source = F.when(F.col("job_id") % 7 == 0, "heuristic").otherwise("diarizer")
    return segmenting.reference_slices(segs.withColumn("end_ms", half).withColumn("label_source", source))


@query(
    "flt_segment_refs",
    views="v_segments",
    sql="""SELECT job_id, seg_no, TRIM(CASE WHEN seg_no%2=0 THEN UPPER(speaker_id) ELSE text END) AS ref_text, end_ms-start_ms AS dur_ms FROM v_segments WHERE end_ms-start_ms >= 3000""",
)
def segment_refs(spark, sf_dir):
    original = F.when(F.col("seg_no") % 2 == 0, F.upper("speaker_id")).otherwise("")
    return segmenting.segment_references(views.segments(spark, sf_dir).withColumn("text_original", original))
