"""Queries over evaluation records, cards, similarity and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import cards, followup, jsonfix, similar
from ..functions import text as tx
from ..operators import nearjoin, ranking
from ..sources import pages as page_source
from ..sources import sinks
from . import views
from .queries_filters import KNOWN, TOKENS, strip
from .queries_more import NUMBERS
from .registry import query, rows_sql

RAW = [
    (1, '```json\n{"score": 9, "category": "军事", "title": "A", "summary_bullets": ["x", " y "]}\n```'), (2, 'Here: {"score": 15, "is_spam": false, "title": "B",} thanks'),
    (3, "{'bad': 1}"), (4, '{"urgency_score": 3, "summary_points": "- one\\n2. two\\n", "is_news": "false"}'), (5, '{"score": 9, "is_spam": true, "category": "军事"}'), (6, "no json"),
    (7, '{"score": "8", "title": "' + "t" * 120 + '"}'), (8, '[1, 2]'), (9, '{"score": 0, "is_news": True, "note": None}'), (10, ""), (11, '```\n{"score": 7, "key_takeaways": ["k"], "actionable_insight": " go "}\n```'), (12, None),
]
RAW_COLUMNS = "id long, raw string"
#: The inline cases, and every event's properties in the ways in which a model may wrap them.
R = rows_sql("r00", RAW_COLUMNS, RAW) + """, r0 AS (SELECT * FROM r00 UNION ALL SELECT event_id + 1000, CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here: ' || props || ' thanks'
  WHEN 2 THEN '{"x": [1, 2, ], "on": True, "p": ' || props || ', }' WHEN 3 THEN ' ``` {"n": None, "e": "' || event_type || '"} ``` ' WHEN 4 THEN event_type ELSE props END FROM events)"""
CLEAN = r"CASE WHEN regexp_matches(trim(coalesce(raw, ''), E' \n'), '(?is)^```(?:json)?\s*(.*?)\s*```$') THEN trim(regexp_extract(trim(coalesce(raw, ''), E' \n'), '(?is)^```(?:json)?\s*(.*?)\s*```$', 1), E' \n') ELSE trim(coalesce(raw, ''), E' \n') END"
OUTER = "CASE WHEN strpos(c, '{') > 0 AND strpos(reverse(c), '}') > 0 AND length(c) - strpos(reverse(c), '}') + 1 > strpos(c, '{') THEN substr(c, strpos(c, '{'), length(c) - strpos(reverse(c), '}') + 2 - strpos(c, '{')) END"


def raw(spark, sf_dir):
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    said = (
        F.when(i % 6 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i % 6 == 1, F.concat(F.lit("Here: "), "props", F.lit(" thanks")))
        .when(i % 6 == 2, F.concat(F.lit('{"x": [1, 2, ], "on": True, "p": '), "props", F.lit(", }"))).when(i % 6 == 3, F.concat(F.lit(' ``` {"n": None, "e": "'), "event_type", F.lit('"} ``` ')))
        .when(i % 6 == 4, F.col("event_type")).otherwise(F.col("props"))
    )
    return spark.createDataFrame(RAW, RAW_COLUMNS).unionByName(e.select((i + 1000).alias("id"), said.alias("raw")))


@query(f"WITH {R} SELECT id, {CLEAN} AS clean FROM r0")
def jsn1_fences(spark, sf_dir):
    return raw(spark, sf_dir).select("id", jsonfix.without_fences(F.col("raw")).alias("clean"))


@query(f"WITH {R}, c AS (SELECT id, {CLEAN} AS c FROM r0) SELECT id, {OUTER} AS inner_text FROM c")
def jsn2_outer_object(spark, sf_dir):
    return raw(spark, sf_dir).select("id", jsonfix.outer_object(jsonfix.without_fences(F.col("raw"))).alias("inner_text"))


@query(
    f"""WITH {R}, c AS (SELECT id, {CLEAN} AS c FROM r0), o AS (SELECT id, {OUTER} AS o FROM c)
    SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(o, ',\\s*([}}\\]])', '\\1', 'g'), '\\bTrue\\b', 'true', 'g'), '\\bFalse\\b', 'false', 'g'), '\\bNone\\b', 'null', 'g') AS repaired FROM o"""
)
def jsn3_repair(spark, sf_dir):
    return raw(spark, sf_dir).select("id", jsonfix.repaired(jsonfix.outer_object(jsonfix.without_fences(F.col("raw")))).alias("repaired"))


EXPECTED = [
    (1, 9, True, False, "A", "x|y", "军事"), (2, 10, True, False, "B", "B", "突发安全"), (3, None, None, None, None, None, None), (4, 3, True, False, "实时快讯评估简报", "one|two", "行业快讯"),
    (5, 2, False, True, "实时快讯评估简报", "实时快讯评估简报", "推广广告"), (6, None, None, None, None, None, None), (7, 8, True, False, "t" * 97 + "...", "t" * 97 + "...", "突发安全"), (8, None, None, None, None, None, None),
    (9, 1, True, False, "实时快讯评估简报", "实时快讯评估简报", "行业快讯"), (10, None, None, None, None, None, None), (11, 7, True, False, "实时快讯评估简报", "实时快讯评估简报", "突发安全"), (12, None, None, None, None, None, None),
]


@query(
    f"""WITH {rows_sql('x', 'id long, score int, is_news boolean, is_spam boolean, title string, bullets string, category string', EXPECTED)},
    e AS (SELECT event_id, event_id % 5 = 0 AS spam, least(10, greatest(1, CAST(user_id % 14 - 1 AS INTEGER))) AS s, event_id % 3 = 0 AS named, event_type || ' ' || event_id AS title FROM events)
    SELECT * FROM x UNION ALL SELECT event_id + 1000, CASE WHEN spam THEN least(s, 2) ELSE s END, NOT spam AND s >= 5, spam, title, title, CASE WHEN spam THEN '推广广告' WHEN named THEN '军事' WHEN s >= 7 THEN '突发安全' ELSE '行业快讯' END FROM e"""
)
def jsn5_normalised(spark, sf_dir):
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    given = F.struct((F.col("user_id") % 14 - 1).alias("score"), (i % 5 == 0).alias("is_spam"), F.concat("event_type", F.lit(" "), i.cast("string")).alias("title"), F.when(i % 3 == 0, "军事").alias("category"))
    rows = spark.createDataFrame(RAW, RAW_COLUMNS).unionByName(e.select((i + 1000).alias("id"), F.to_json(given).alias("raw")))
    r = rows.select("id", jsonfix.normalised(jsonfix.parsed(F.col("raw"))).alias("e"))
    return r.select("id", "e.score", "e.is_news", "e.is_spam", "e.title", F.array_join("e.summary_bullets", "|").alias("bullets"), "e.category")


BRIEFS = [
    (1, '{"headline": "h", "items": [{"rank": 1, "message_id": 5, "channel": "a", "score": 9}, {"rank": 2, "message_id": 6, "channel": "b"}]}'), (2, '{"headline": "h", "items": []}'),
    (3, '{"items": [{"rank": 9, "message_id": 5, "channel": "a"}]}'), (4, '{"items": [{"rank": 1, "message_id": 5, "channel": "a", "score": 11}]}'), (5, '{"items": [],}'),
    (6, '```json\n{"has_material_news": true, "items": [' + ", ".join(f'{{"rank": {min(k, 5)}, "message_id": {k}, "channel": "c"}}' for k in range(1, 8)) + "]}\n```"),
]


@query(
    """SELECT * FROM (VALUES (1, 2, TRUE), (2, 0, FALSE), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL), (6, 5, TRUE)) AS v(id, n_items, material)
    UNION ALL SELECT CAST(event_id + 1000 AS INTEGER), CASE WHEN event_id % 11 > 0 THEN CAST(least(event_id % 8, 5) AS INTEGER) END, CASE WHEN event_id % 11 > 0 THEN event_id % 8 > 0 END FROM events"""
)
def jsn6_digest(spark, sf_dir):
    """Digests of up to seven items, of which five count; a rank beyond five spoils one."""
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    item = lambda k: F.struct(F.when(i % 11 == 0, 9).otherwise(F.least(k, F.lit(5))).alias("rank"), (i * 10 + k).alias("message_id"), F.col("event_type").alias("channel"))
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: (k > 0) & ((k <= i % 8) | (i % 11 == 0))), item)
    made = e.select((i + 1000).cast("int").alias("id"), F.to_json(F.struct(F.col("event_type").alias("headline"), items.alias("items"))).alias("raw"))
    b = spark.createDataFrame(BRIEFS, "id int, raw string").unionByName(made).select("id", jsonfix.brief(F.col("raw")).alias("b"))
    return b.select("id", F.when(F.col("b").isNotNull(), F.size("b.items")).alias("n_items"), F.col("b.has_material_news").alias("material"))


ENVELOPES = [(1, '{"choices": [{"message": {"content": "hi"}}]}'), (2, '{"x": 1}'), (3, "plain")]


@query(
    f"""WITH {rows_sql('x', 'id long, s string', ENVELOPES)} SELECT id, CAST(0 AS BIGINT) AS turn, CASE id WHEN 1 THEN 'hi' ELSE s END AS content FROM x
    UNION ALL SELECT conv_id + 1000, turn, CASE turn % 3 WHEN 2 THEN '{{"x":' || turn || '}}' ELSE text END FROM conversations"""
)
def jsn7_envelope(spark, sf_dir):
    c, t = views.table(spark, sf_dir, "conversations"), F.col("turn")
    whole = F.to_json(F.struct(F.array(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))).alias("choices")))
    made = c.select((F.col("conv_id") + 1000).alias("id"), "turn", F.when(t % 3 == 0, whole).when(t % 3 == 2, F.concat(F.lit('{"x":'), t.cast("string"), F.lit("}"))).otherwise(F.col("text")).alias("s"))
    own = spark.createDataFrame(ENVELOPES, "id long, s string").withColumn("turn", F.lit(0).cast("long"))
    return own.unionByName(made).select("id", "turn", jsonfix.envelope(F.col("s")).alias("content"))


SECRETS = [(1, "api_key=abc123 ok"), (2, "Authorization: Bearer abc.def-1"), (3, "post to https://x.example/hook/abc-1 now"), (4, "nothing")]


@query(
    """SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'api_key=*** ok'), (2, 'Authorization: Bearer ***'), (3, 'post to https://x.example/hook/*** now'), (4, 'nothing')) AS v(id, shown)
    UNION ALL SELECT doc_id + 1000, CASE doc_id % 4 WHEN 0 THEN source || ' api_key=*** ok' WHEN 1 THEN 'Authorization: Bearer *** ' || source WHEN 2 THEN 'post to https://x.example/hook/*** now' ELSE source END FROM documents"""
)
def jsn10_redaction(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    key = F.md5("text")
    said = (
        F.when(i % 4 == 0, F.concat("source", F.lit(" api_key="), key, F.lit(" ok"))).when(i % 4 == 1, F.concat(F.lit("Authorization: Bearer "), key, F.lit(" "), "source"))
        .when(i % 4 == 2, F.concat(F.lit("post to https://x.example/hook/"), key, F.lit(" now"))).otherwise(F.col("source"))
    )
    rows = spark.createDataFrame(SECRETS, "id long, s string").unionByName(d.select((i + 1000).alias("id"), said.alias("s")))
    return rows.select("id", jsonfix.redacted(F.col("s")).alias("shown"))


CHANNELS = [(1, "A, @b ,,a"), (2, '["@X", "y", "x"]'), (3, ""), (4, "@@q")]


@query(
    """SELECT * FROM (VALUES ('1', 'a|b'), ('2', 'x|y'), ('3', ''), ('4', 'q')) AS v(id, channels)
    UNION ALL SELECT lang || '-' || form, (SELECT string_agg(DISTINCT lower(source), '|' ORDER BY lower(source)) FROM documents d WHERE d.lang = l.lang) FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l, (VALUES ('csv'), ('json')) AS f(form)"""
)
def jsn11_channel_list(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    by = d.groupBy("lang").agg(F.array_sort(F.collect_set(F.concat(F.lit("@"), F.upper("source")))).alias("c"))
    forms = F.array(F.struct(F.lit("csv").alias("form"), F.array_join("c", " ,, ").alias("s")), F.struct(F.lit("json").alias("form"), F.to_json(F.concat("c", F.array(F.element_at("c", 1)))).alias("s")))
    made = by.select("lang", F.explode(forms).alias("x")).select(F.concat("lang", F.lit("-"), "x.form").alias("id"), "x.s")
    rows = spark.createDataFrame([(str(i), s) for i, s in CHANNELS], "id string, s string")
    return rows.unionByName(made).select("id", F.array_join(jsonfix.channel_list(F.col("s")), "|").alias("channels"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text ELSE text || ' see ' || role || '  now' END AS shown FROM conversations)
    SELECT conv_id, turn, md5(trim(regexp_replace(shown, '\s+', ' ', 'g'))) AS shown_md5 FROM c"""
)
def strf15_squeezed(spark, sf_dir):
    """Turns without their links: two thirds of them have one."""
    c = views.table(spark, sf_dir, "conversations")
    linked = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" see https://t.me/"), "role", F.lit("/7 "), "role", F.lit("  now")))
    return c.select("conv_id", "turn", F.md5(tx.without_traces(linked)).alias("shown_md5"))


PAIRS = [
    (1, "Diesel retail price hits $6.06 in California", "California diesel retail price at $6 record", False, ""),
    (2, "Diesel retail price hits $6.06 in California", "Gasoline exports from Rotterdam fall 12%", False, ""),
    (3, "Fed cuts by 25 bp after meeting", "Fed cuts by 50 bp after meeting", False, ""), (4, "", "text", False, ""), (5, "柴油零售均价突破6.06美元，加州居民抱怨", "加州居民抱怨柴油零售价升至6美元", True, "新增7.5美元"),
    (6, "Storm closes harbour near Lisbon tonight", "Storm closes harbour near Lisbon", True, "officials named Almada terminal"), (7, "Storm closes harbour near Lisbon tonight", "Storm closes harbour near Lisbon", True, "short"), (8, "", "", True, "x"), (9, None, None, None, None),
]


#: The event rule in SQL, for rows with the features of two texts a and b (t: tokens, s: specific ones, n: numbers).
_SPECIFIC = "list_filter(t, lambda x: x NOT IN ('the', 'and', 'for', 'from', 'with', 'that', 'this'))"
_SAME = """(len(list_intersect(sa, sb)) >= 1 AND (len(na) = 0 OR len(nb) = 0 OR len(list_intersect(na, nb)) > 0) AND
  ((len(list_intersect(ta, tb)) >= 0.45 * (len(ta) + len(tb) - len(list_intersect(ta, tb)))) OR (len(list_intersect(ta, tb)) >= 0.30 * (len(ta) + len(tb) - len(list_intersect(ta, tb))) AND len(list_intersect(sa, sb)) >= 4)))"""
_ADDS = "(len(list_filter({0}n{1}, lambda x: NOT list_contains(nb, x))) > 0 OR len(list_filter({0}s{1}, lambda x: NOT list_contains(sb, x))) >= 2)"


def _features(source: str) -> str:
    return f"SELECT *, {_SPECIFIC} AS s FROM (SELECT *, {TOKENS} AS t, {NUMBERS} AS n FROM ({source}))"


@query(
    f"""SELECT id, CAST(0 AS BIGINT) AS turn, same, material, adds FROM (VALUES (CAST(1 AS BIGINT), TRUE, FALSE, TRUE), (2, FALSE, FALSE, TRUE), (3, FALSE, FALSE, TRUE), (4, FALSE, FALSE, FALSE), (5, TRUE, TRUE, FALSE), (6, TRUE, TRUE, FALSE), (7, TRUE, FALSE, FALSE), (8, FALSE, FALSE, FALSE), (9, FALSE, FALSE, FALSE)) AS v(id, same, material, adds)
    UNION ALL SELECT id, turn, {_SAME}, turn % 2 = 0 AND said <> '' AND {_ADDS.format('', 'a')}, {_ADDS.format('', 'a')} FROM (
      SELECT x.conv_id + 1000 AS id, x.turn, trim(x.text) AS said, x.t AS ta, x.s AS sa, x.n AS na, y.t AS tb, y.s AS sb, y.n AS nb FROM ({_features("SELECT * FROM conversations")}) x JOIN ({_features("SELECT * FROM conversations")}) y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1)"""
)
def strf9_similar_event(spark, sf_dir):
    """Inline pairs, and every conversation's turns against the turns before them."""
    c = views.table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    turns = c.join(before, ["conv_id", "turn"]).select((F.col("conv_id") + 1000).alias("id"), "turn", F.col("text").alias("a"), "b", (F.col("turn") % 2 == 0).alias("is_update"), F.col("text").alias("reason"))
    own = spark.createDataFrame(PAIRS, "id long, a string, b string, is_update boolean, reason string").withColumn("turn", F.lit(0).cast("long"))
    p = own.unionByName(turns).withColumns({"fa": tx.features("a"), "fb": tx.features("b"), "fr": tx.features("reason")})
    fa, fb = F.col("fa"), F.col("fb")
    return p.select("id", "turn", similar.same_event(fa, fb).alias("same"), similar.material_update(F.col("is_update"), F.col("reason"), F.col("fr"), fb).alias("material"), similar.adds_content(fa, fb).alias("adds"))


_CLAIMED = f"""SELECT group_id, s AS text FROM (SELECT group_id, s, row_number() OVER (PARTITION BY group_id ORDER BY min(n)) AS place FROM (
    SELECT group_id, {strip('text')} AS s, row_number() OVER (PARTITION BY group_id ORDER BY published_s DESC, CAST(message_id AS VARCHAR)) AS n FROM posts WHERE {KNOWN}) WHERE n <= 40 AND s <> '' GROUP BY 1, 2) WHERE place <= 20"""


@query(
    f"""WITH {views.POSTS}, old AS MATERIALIZED ({_features(_CLAIMED)}), new AS MATERIALIZED ({_features("SELECT group_id, message_id, text FROM posts")}),
    j AS (SELECT new.message_id, new.text, new.t AS ta, new.s AS sa, new.n AS na, old.t AS tb, old.s AS sb, old.n AS nb FROM new JOIN old USING (group_id)),
    d AS (SELECT message_id, bool_or({_SAME} AND NOT (message_id % 4 = 0 AND {_ADDS.format('', 'a')})) AS dup FROM j GROUP BY 1)
    SELECT * FROM (VALUES (CAST(-1 AS BIGINT), TRUE), (-2, FALSE), (-3, FALSE), (-4, FALSE), (-5, FALSE), (-6, FALSE), (-7, TRUE), (-8, FALSE), (-9, FALSE)) AS v(id, near_duplicate)
    UNION ALL SELECT message_id, coalesce(dup, FALSE) FROM posts LEFT JOIN d USING (message_id)"""
)
def jn8_against_recent(spark, sf_dir):
    """Inline cases, and every post against the last twenty summaries of its group's stored posts; some are updates."""
    own = spark.createDataFrame(PAIRS, "id long, blob string, b string, is_update boolean, reason string").withColumn("group_id", F.col("id").cast("string")).withColumn("id", -F.col("id"))
    p = views.posts(spark, sf_dir)
    update = F.col("message_id") % 4 == 0
    new = p.select("group_id", F.col("message_id").alias("id"), F.col("text").alias("blob"), update.alias("is_update"), F.when(update, F.col("text")).otherwise("").alias("reason"))
    key = ["group_id", "message_id", F.col("message_id").cast("string").alias("fingerprint"), F.unix_seconds("published_at").alias("claimed")]
    # the newest stored posts are found without their texts; only these ones' are read, 40 a group
    newest = ranking.newest_claims(views.marked(spark, sf_dir).where("known").select(*key), F.lit(0), 2 * fixed.RECENT_MAX).select("message_id").distinct()
    known = p.join(F.broadcast(newest), "message_id", "left_semi").select(*key, F.col("text").alias("summary"))
    recents = ranking.recent_summaries(known, F.lit(0)).select("group_id", "summary")
    both = nearjoin.against_recent(own.select(*new.columns).unionByName(new), recents.unionByName(own.select("group_id", F.col("b").alias("summary"))))
    return both.select("id", "near_duplicate")


@query()
def strf14_followup(spark, sf_dir):
    """What is left of follow-up copy, for every conversation turn against the turn before it."""
    c = views.table(spark, sf_dir, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array("text").alias("recents"))
    j = c.join(prev, ["conv_id", "turn"], "left")
    s = followup.sanitized(j, tx.lead_title(F.col("text")), F.col("text"), F.split("text", "\n"), F.col("recents"), F.col("turn") % 2 == 0, F.lit(""), out="s")
    return s.select("conv_id", "turn", "s.skip", "s.rewritten", "s.title", F.size("s.bullets").alias("n_bullets"))


CAPTIONS = [(1, "A quiet lake…"), (2, ""), (3, "• 看 https://t.me/x/1 湖边"), (4, "长句" * 40 + "。" + "尾巴" * 20), (5, "x" * 150), (6, "已经完整。"), (7, "..."), (8, None)]
_CAPTIONS = [(1, "A quiet lake。"), (2, ""), (3, "看 湖边。"), (4, "长句" * 40 + "。"), (5, "x" * 99 + "。"), (6, "已经完整。"), (7, ""), (8, "")]


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), '{v}')" for k, v in _CAPTIONS) + """) AS v(id, caption)
    UNION ALL SELECT doc_id + 1000, CASE doc_id % 4 WHEN 0 THEN source || ' ' || lang || '。' WHEN 1 THEN source || '！' WHEN 2 THEN repeat('x', least(99, 60 + CAST(doc_id % 80 AS INTEGER))) || '。' ELSE '看 ' || source || '。' END FROM documents WHERE lang IS NOT NULL"""
)
def strf16_caption(spark, sf_dir):
    """Captions: inline cases, and of every document one with odd spacing, a mark of its own, a long word or a link."""
    d, i = views.table(spark, sf_dir, "documents").where("lang IS NOT NULL"), F.col("doc_id")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("  "), "source", F.lit(" \t "), "lang", F.lit("..."))).when(i % 4 == 1, F.concat("source", F.lit("！")))
        .when(i % 4 == 2, F.repeat(F.lit("x"), 60 + (i % 80).cast("int"))).otherwise(F.concat(F.lit("• 看 https://t.me/x/"), i.cast("string"), F.lit(" "), "source"))
    )
    rows = spark.createDataFrame(CAPTIONS, "id long, s string").unionByName(d.select((i + 1000).alias("id"), text.alias("s")))
    return rows.select("id", tx.caption(F.col("s")).alias("caption"))


SUMMARIES = [(1, "- Rates held..."), (2, ""), (3, "第一句。第二句"), (4, "甲" * 30 + "，" + "乙" * 70), (5, "完整！"), (6, "…"), (7, None)]
_POLISHED = "CASE WHEN p = '' OR regexp_matches(p, '[。！？；]$') THEN p ELSE p || '。' END"


def _polished(source: str, column: str, out: str, *keep: str) -> str:
    """The rows of source with a column's texts polished, and the columns kept."""
    bare = f"trim(regexp_replace(regexp_replace({strip(f"coalesce({column}, '')")}, '^[•\\-* ]+', ''), '[.…⋯． ]+$', ''))"
    return f"SELECT {', '.join(keep)}, {_POLISHED} AS {out} FROM (SELECT {', '.join(keep)}, {bare} AS p FROM {source})"


def _first_sentence(column: str) -> str:
    head = lambda mark: strip(f"split_part({column}, '{mark}', 1)")
    return "CASE " + " ".join(f"WHEN contains({column}, '{m}') AND {head(m)} <> '' THEN {head(m)} || '{m}'" for m in "。！？") + f" ELSE {column} END"


def _clause(window: str, least: int) -> str:
    at = lambda mark: f"length({window}) - strpos(reverse({window}), '{mark}')"
    return "CASE " + " ".join(f"WHEN contains({window}, '{m}') AND {at(m)} >= {least} THEN substr({window}, 1, {at(m)})" for m in "，、； ") + f" ELSE {window} END"


@query(
    f"""WITH {rows_sql('x0', 'id long, s string', SUMMARIES)}, x AS (SELECT * FROM x0 UNION ALL SELECT conv_id * 100 + turn + 1000, CASE turn % 3 WHEN 0 THEN '• ' || text || '…' WHEN 1 THEN role || '。' || text ELSE text || '；' END FROM conversations),
    p AS ({_polished('x', 's', 'polished', 'id')}), l AS (SELECT id, polished, {strip("split_part(polished, chr(10), 1)")} AS line FROM p),
    f AS (SELECT id, polished, {_first_sentence('line')} AS sentence FROM l), w AS (SELECT id, polished, sentence, substr(sentence, 1, {cards.LONG_CHARS}) AS w FROM f),
    c AS (SELECT id, polished, CASE WHEN length(sentence) <= {cards.LONG_CHARS} THEN sentence ELSE {_clause('w', max(20, cards.LONG_CHARS // 3))} END AS cut FROM w)
    {_polished('c', 'cut', 'shortened', 'id', 'polished')}"""
)
def strf20_summaries(spark, sf_dir):
    """Summaries polished and shortened: inline cases, and every turn's whole text as a bullet of some kind."""
    c, t = views.table(spark, sf_dir, "conversations"), F.col("turn")
    text = F.when(t % 3 == 0, F.concat(F.lit("• "), "text", F.lit("…"))).when(t % 3 == 1, F.concat("role", F.lit("。"), "text")).otherwise(F.concat("text", F.lit("；")))
    rows = spark.createDataFrame(SUMMARIES, "id long, s string").unionByName(c.select((F.col("conv_id") * 100 + t + 1000).alias("id"), text.alias("s")))
    return rows.select("id", cards.polished(F.col("s")).alias("polished"), cards.shortened(F.col("s")).alias("shortened"))


_SHORT = [(1, "Rates held。"), (2, ""), (3, "第一句。"), (4, "甲" * 30 + "。"), (5, "完整！"), (6, ""), (7, "")]


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), '{v}')" for k, v in _SHORT) + """) AS v(id, shortened)
    UNION ALL SELECT doc_id + 1000, CASE doc_id % 3 WHEN 0 THEN source || ' rises。' WHEN 1 THEN lang || '？' || source || '。' ELSE repeat('甲', 30 + CAST(doc_id % 40 AS INTEGER)) || '。' END FROM documents WHERE lang IS NOT NULL"""
)
def strf20_shortened(spark, sf_dir):
    """First sentences: the full stop comes before other marks; those too long are cut at a clause."""
    d, i = views.table(spark, sf_dir, "documents").where("lang IS NOT NULL"), F.col("doc_id")
    long = F.concat(F.repeat(F.lit("甲"), 30 + (i % 40).cast("int")), F.lit("，"), F.repeat(F.lit("乙"), F.lit(70)))
    text = F.when(i % 3 == 0, F.concat("source", F.lit(" rises。"), "lang", F.lit("。falls"))).when(i % 3 == 1, F.concat("lang", F.lit("？"), "source")).otherwise(long)
    rows = spark.createDataFrame(SUMMARIES, "id long, s string").unionByName(d.select((i + 1000).alias("id"), text.alias("s")))
    return rows.select("id", cards.shortened(F.col("s")).alias("shortened"))


@query(
    """SELECT doc_id, '**' || (doc_id % 5 + 1) || '. ' || CASE WHEN doc_id % 4 = 0 THEN '未命名' ELSE source END || '**' || chr(10) || source || ' in short' || chr(10) || '关注：' || CASE WHEN doc_id % 3 = 0 THEN lang ELSE '跟踪后续进展' END || chr(10)
      || '北京时间：' || strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%H:%M') AS block FROM documents WHERE lang IS NOT NULL"""
)
def strf22_morning_block(spark, sf_dir):
    """A short morning item of every document."""
    d, i = views.table(spark, sf_dir, "documents").where("lang IS NOT NULL"), F.col("doc_id")
    clock = F.date_format(F.timestamp_seconds(views.START + i * 60), "HH:mm")
    block = cards.morning_block(i % 5 + 1, F.when(i % 4 > 0, F.concat(F.lit(" "), "source", F.lit(" "))), F.concat(F.lit(" "), "source", F.lit(" in short ")), F.lit(None).cast("array<string>"), F.when(i % 3 == 0, F.col("lang")), clock)
    return d.select("doc_id", block.alias("block"))


@query(
    """WITH s AS (SELECT doc_id, CAST(doc_id % 12 AS INTEGER) AS score, ['军事', '科技/AI', '宏观财经'][doc_id % 3 + 1] AS category, doc_id % 2 = 0 AS flagged FROM documents)
    SELECT doc_id, CASE WHEN score >= 9 THEN 'red' WHEN score >= 7 THEN 'orange' WHEN score >= 5 THEN 'blue' ELSE 'grey' END AS template,
      CASE WHEN score >= 9 THEN 'alarm_outlined' WHEN score >= 7 THEN 'bell_outlined' WHEN score >= 5 THEN 'info_outlined' ELSE 'cross_outlined' END AS icon,
      2 + CAST(flagged AND score >= 9 AND category IN ('军事', '宏观财经') AS INTEGER) AS elements FROM s"""
)
def jsn9_item_card(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    score, category = (i % 12).cast("int"), F.element_at(F.array(F.lit("军事"), F.lit("科技/AI"), F.lit("宏观财经")), (i % 3).cast("int") + 1)
    item = F.struct(score.alias("score"), tx.lead_title(F.col("text")).alias("title"), F.col("text").alias("summary"), F.split("text", "\n").alias("summary_bullets"), category.alias("category"))
    card = d.select("doc_id", cards.item_card(item, F.timestamp_seconds(views.START + i), cards.shows_impact(score, category, i % 2 == 0)).alias("card"))
    read = F.from_json("card", "struct<header: struct<template: string, icon: string>, elements: array<struct<tag: string>>>")
    return card.select("doc_id", read.alias("c")).select("doc_id", "c.header.template", "c.header.icon", F.size("c.elements").alias("elements"))


#: HMAC by its definition: the key, filled up to a block, is combined with two pads around two hashes.
_PAD = "unhex(repeat('{}', 64))"
_XOR = "CAST(xor(CAST(k AS BIT), CAST({} AS BIT)) AS BLOB)"


@query(
    f"""WITH {views.EVENTS}, k AS (SELECT event_id, encode(CAST(at_s AS VARCHAR) || chr(10) || 'secret-' || event_type) AS raw FROM ev), b AS (SELECT event_id, raw || unhex(repeat('00', 64 - octet_length(raw))) AS k FROM k)
    SELECT event_id, to_base64(unhex(sha256({_XOR.format(_PAD.format('5C'))} || unhex(sha256({_XOR.format(_PAD.format('36'))}))))) AS sign FROM b"""
)
def snk8_signature(spark, sf_dir):
    """Signature of each event's time under a secret of its kind."""
    e = views.events(spark, sf_dir)
    return e.select("event_id", sinks.signatures(F.col("at_s").cast("string"), F.concat(F.lit("secret-"), "event_type")).alias("sign"))


@query(
    """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM (SELECT page_id * 2 AS page_id, url FROM pages UNION ALL
      SELECT page_id * 2 + 1, ['http://127.0.0.1/' || page_id, 'https://10.0.0.' || page_id % 250 || '/x', 'http://8.8.8.' || page_id % 250, 'ftp://a.example/' || page_id, 'https://db' || page_id || '.internal/', 'https://host' || page_id][page_id % 6 + 1] FROM pages))
    SELECT page_id, regexp_matches(url, '^https?://') AND contains(host, '.') AND NOT regexp_matches(host, '(^(127|10)[.]|[.](local|internal|localhost)$)') AS safe FROM u"""
)
def snk12_safe_urls(spark, sf_dir):
    """Whether each page's URL, and one made of its number, may be fetched from."""
    p, i = views.table(spark, sf_dir, "pages"), F.col("page_id")
    n, small = i.cast("string"), (i % 250).cast("string")
    made = [("http://127.0.0.1/", n, ""), ("https://10.0.0.", small, "/x"), ("http://8.8.8.", small, ""), ("ftp://a.example/", n, ""), ("https://db", n, ".internal/"), ("https://host", n, "")]
    urls = F.element_at(F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in made]), (i % 6).cast("int") + 1)
    both = p.select((i * 2).alias("page_id"), "url").unionByName(p.select((i * 2 + 1).alias("page_id"), urls.alias("url")))
    return both.select("page_id", sinks.safe_image_url("url").alias("safe"))


WIDGET = """<div class="tgme_widget_message_wrap"><div class="tgme_widget_message" data-post="News/{n}"><div class="tgme_widget_message_text">Hi <b>all</b><br>see <a href="{u}">this</a> <a href="x">@who</a></div>
<span class="tgme_widget_message_views">{v}</span><time datetime="{t}">03:04</time></div></div>
<div class="tgme_widget_message tgme_widget_message_service" data-post="News/9"><div class="tgme_widget_message_text">pinned</div></div>
<div class="tgme_widget_message" data-post="News/{m}"><a class="tgme_widget_message_forwarded_from_name"> Origin {v} </a><a class="tgme_widget_message_photo_wrap" style="background-image:url('{u}/1.jpg')"></a>{p}</div>
<div class="tgme_widget_message" data-post="News/x"></div>"""
#: Further parts of the second message, by page: another photo, a video, a document, a poll or nothing.
_PARTS = (
    """<a class="tgme_widget_message_photo_wrap" style="background-image:url({u}/2.jpg)"></a>""", """<video src="{u}/v.mp4"></video>""", """<div class="tgme_widget_message_document"></div>""",
    """<div class="tgme_widget_message_poll"></div><video src="{u}/v.mp4"></video>""", "",
)


@query(
    """WITH p AS (SELECT page_id, page_id % 5 AS k, replace(url, '&', '&amp;') AS u, url, 'v' || page_id % 17 AS v FROM pages)
    SELECT 'news' AS channel, page_id * 10 + 1 AS message_id, 'Hi all' || chr(10) || 'see [this](' || url || ') @who' AS text, FALSE AS has_media, CAST(NULL AS VARCHAR) AS media_type, '' AS urls, CAST(1704067200 + page_id * 60 AS INTEGER) AS at_s, v AS views, CAST(NULL AS VARCHAR) AS forwarded FROM p
    UNION ALL SELECT 'news', page_id * 10 + 2, '[' || upper(['album', 'video', 'document', 'poll', 'photo'][k + 1]) || ']', TRUE, ['album', 'video', 'document', 'poll', 'photo'][k + 1],
      array_to_string(list_concat([url || '/1.jpg'], CASE k WHEN 0 THEN [url || '/2.jpg'] WHEN 1 THEN [url || '/v.mp4'] WHEN 3 THEN [url || '/v.mp4'] ELSE [] END), '|'), 0, NULL, 'Origin ' || v FROM p"""
)
def src4_page_posts(spark, sf_dir):
    """Posts of a page made of every page's address: text with links, five kinds of media, a forward and what is to be skipped."""
    p, i = views.table(spark, sf_dir, "pages"), F.col("page_id")
    html = F.replace(F.lit(WIDGET), F.lit("{p}"), F.element_at(F.array(*[F.lit(x) for x in _PARTS]), (i % 5).cast("int") + 1))
    clock = F.date_format(F.timestamp_seconds(views.START + i * 60), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    values = {"{n}": (i * 10 + 1).cast("string"), "{m}": (i * 10 + 2).cast("string"), "{u}": F.replace("url", F.lit("&"), F.lit("&amp;")), "{v}": F.concat(F.lit("v"), (i % 17).cast("string")), "{t}": clock}
    for name, value in values.items():
        html = F.replace(html, F.lit(name), value)
    posts = page_source.posts(p.select(F.lit("news").alias("channel"), html.alias("html")))
    return posts.select("channel", "message_id", "text", "has_media", "media_type", F.array_join("media_urls", "|").alias("urls"), F.unix_seconds("published_at").cast("int").alias("at_s"), "views", F.col("forward_from").alias("forwarded"))


@query(
    f"""WITH {views.POSTS}, b AS (SELECT message_id, channel, {strip('text')} AS body FROM posts),
    f AS (SELECT *, len(list_filter([{', '.join(f"'{k}'" for k in fixed.BREAKING_KEYWORDS)}], lambda k: contains(lower(body), k))) > 0 AS found, {strip("regexp_extract(body, '^[^。！？!?\n]*')")} AS head FROM b)
    SELECT message_id, CASE WHEN found THEN 7 ELSE 3 END AS score, found AS is_news, CASE WHEN found THEN '突发安全' ELSE '日常闲聊' END AS category,
      CASE WHEN NOT found THEN '未分级动态: @' || channel || '#' || message_id WHEN head = '' THEN '[降级预警] 来自 @' || channel || ' 的突发动态' WHEN length(head) > 40 THEN '[降级预警] ' || substr(head, 1, 37) || '...' ELSE '[降级预警] ' || head END AS title FROM f"""
)
def udf1_heuristic_evaluation(spark, sf_dir):
    """The offline evaluator's record of each post."""
    from .pipeline import heuristic

    p = views.posts(spark, sf_dir)
    return p.select("message_id", heuristic(F.col("text"), F.col("channel"), F.col("message_id")).alias("e")).select("message_id", "e.score", "e.is_news", "e.category", "e.title")

