"""Further queries: prompts, clauses, archives, decoded rows and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prompts, timewin
from ..functions import text as tx
from ..operators import ranking, store
from . import views
from .queries_filters import KNOWN, LOCAL, NORM, NOW, TOKENS, URLS, C, P, copies, local_events, photos, strip
from .registry import query, rows_sql

POSTS = views.POSTS


@query(
    f"""WITH {POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY published_s DESC, channel, message_id) AS rank FROM posts)
    SELECT group_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg('[' || rank || '] @' || channel || '#' || message_id || chr(10) || CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || ' …[cut]' ELSE text END, chr(10) || chr(10) ORDER BY rank)) AS prompt_md5
    FROM r WHERE rank <= 20 GROUP BY 1"""
)
def strf24_digest_prompt(spark, sf_dir):
    batch = ranking.batch(views.posts(spark, sf_dir).withColumn("urgent", F.lit(False)))
    return prompts.digest_prompts(batch).select("group_id", "n", F.md5("prompt").alias("prompt_md5"))


NUMBERS = (
    rf"list_sort(list_distinct(list_transform(regexp_extract_all({NORM}, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda y: "
    "CASE WHEN CAST(replace(y, ',', '') AS DOUBLE) >= 1 THEN CAST(CAST(floor(CAST(replace(y, ',', '') AS DOUBLE)) AS HUGEINT) AS VARCHAR) ELSE printf('%.2f', CAST(replace(y, ',', '') AS DOUBLE)) END)))"
)


@query(
    f"""WITH {POSTS}, f AS (SELECT message_id, list_concat(list_filter({TOKENS}, lambda x: x NOT IN ('the', 'and', 'for', 'from', 'with', 'that', 'this')), list_transform({NUMBERS}, lambda n: '#' || n)) AS t FROM posts)
    SELECT message_id, CASE WHEN len(t) >= 3 THEN md5(array_to_string(t, ' ')) END AS event_key_md5 FROM f"""
)
def strf7_event_key(spark, sf_dir):
    return views.posts(spark, sf_dir).select("message_id", F.md5(tx.features("text")["event_key"]).alias("event_key_md5"))


CLAUSES = r"list_filter(list_transform(string_split_regex(text, '[。！？；;：:\n]'), lambda c: regexp_replace(c, '^[ ，,、:：]+|[ ，,、:：]+$', '', 'g')), lambda c: length(c) >= 6)"


@query(f"WITH {POSTS}, c AS (SELECT message_id, list_concat({CLAUSES}, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN [trim(regexp_replace(text, '\\s+', ' ', 'g'))] ELSE [] END) AS l FROM posts) SELECT message_id, len(list_distinct(l)) AS n, md5(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|')) AS clauses_md5 FROM c")
def win9_clauses(spark, sf_dir):
    c = views.posts(spark, sf_dir).select("message_id", tx.clauses(F.col("text")).alias("c"))
    return c.select("message_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("clauses_md5"))


@query(f"WITH {C} SELECT id, concat_ws(' ', nullif(CASE WHEN {strip('title')} <> '' AND {strip('summary')} <> '' THEN {strip('title')} || ': ' || {strip('summary')} ELSE {strip('title')} || {strip('summary')} END, ''), 'b1') AS copy FROM c0")
def strf12_reader_copy(spark, sf_dir):
    return copies(spark, sf_dir).select("id", tx.reader_blob(F.col("title"), F.col("summary"), F.array(F.lit(" b1 "), F.lit(" "))).alias("copy"))


@query(f"WITH {P}, u AS (SELECT id, text, {URLS} AS l FROM p0) SELECT id, coalesce(text, '') || chr(10) || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) AS material FROM u")
def strf17_material_text(spark, sf_dir):
    p = photos(spark, sf_dir)
    return p.select("id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.array_join(tx.photo_urls(F.col("urls")), "\n")).alias("material"))


@query(f"WITH {P} SELECT id, CASE WHEN coalesce(text, '') = '' AND coalesce(has_media, FALSE) THEN '[' || upper(coalesce(media_type, 'MEDIA')) || ']' ELSE coalesce(text, '') END AS shown FROM p0")
def src9_placeholder(spark, sf_dir):
    p = photos(spark, sf_dir)
    t = F.coalesce("text", F.lit(""))
    return p.select("id", F.when((t == "") & F.coalesce("has_media", F.lit(False)), F.concat(F.lit("["), F.upper(F.coalesce("media_type", F.lit("MEDIA"))), F.lit("]"))).otherwise(t).alias("shown"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, json_valid(props) AS valid FROM events")
def src12_json_rows(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(f"WITH {POSTS} SELECT message_id, published_s >= {NOW - 7200} AND published_s < {NOW} AND published_s <= {NOW - 3600} + 120 AS inside FROM posts")
def flt17_in_window(spark, sf_dir):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    return views.posts(spark, sf_dir).select("message_id", timewin.in_window(F.col("published_at"), at(NOW - 7200), at(NOW), at(NOW - 3600)).alias("inside"))


@query(f"WITH {POSTS} SELECT message_id, row_number() OVER (ORDER BY published_s, message_id) AS place FROM (SELECT * FROM posts ORDER BY length(text) DESC, message_id LIMIT 20)")
def top4_delivery_order(spark, sf_dir):
    chosen = views.posts(spark, sf_dir).orderBy(F.length("text").desc(), "message_id").limit(20)
    return chosen.select("message_id", F.row_number().over(Window.orderBy("published_at", "message_id")).cast("long").alias("place"))


@query(f"WITH {POSTS} SELECT group_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY message_id DESC) AS n FROM posts) WHERE n <= 20")
def top9_last_archived(spark, sf_dir):
    return ranking.capped(views.posts(spark, sf_dir), ["group_id"], [F.desc("message_id")], 20).where("within_cap").select("group_id", "message_id")


@query(f"WITH {POSTS}, f AS (SELECT message_id, {NORM} AS n FROM posts) SELECT message_id, length(n) AS length, md5(n) AS norm_md5 FROM f")
def strf1_normalised(spark, sf_dir):
    n = views.posts(spark, sf_dir).select("message_id", tx.normalized("text").alias("n"))
    return n.select("message_id", F.length("n").cast("long").alias("length"), F.md5("n").alias("norm_md5"))


SPLIT = "SELECT message_id % 2 AS side, unnest({t}) AS x FROM posts".format(t=TOKENS)


@query(f"WITH {POSTS}, s AS ({SPLIT}) SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) AS total FROM (SELECT x, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM s GROUP BY x)")
def set1_token_sets(spark, sf_dir):
    t = views.posts(spark, sf_dir).select((F.col("message_id") % 2).alias("side"), F.explode(tx.features("text")["tokens"]).alias("x"))
    g = t.groupBy("x").agg(F.bool_or(F.col("side") == 0).alias("a"), F.bool_or(F.col("side") == 1).alias("b"))
    return g.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count("*").alias("total"))


@query(f"WITH {POSTS}, s AS (SELECT DISTINCT group_id, channel FROM posts WHERE {KNOWN}) SELECT p.message_id, s.channel IS NOT NULL AS stored FROM posts p LEFT JOIN s USING (group_id, channel)")
def src11_key_lookup(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    known = p.where("known").select("group_id", "channel").distinct().withColumn("stored", F.lit(True))
    return p.join(known, ["group_id", "channel"], "left").select("message_id", F.coalesce("stored", F.lit(False)).alias("stored"))


@query(f"WITH {POSTS} SELECT message_id FROM posts WHERE NOT {KNOWN}")
def snk1_save_new(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    return store.insert_if_absent(p, p.where("known"), [F.col("text")]).select("message_id")


WINDOWS = [("22:00-00:00", 1320, 0), ("8-9:30", 480, 570), ("08:00-08:00", None, None), ("", None, None)]


@query(
    f"""WITH {rows_sql('x', 'spec string, start int, stop int', WINDOWS)}, {views.EVENTS}, {LOCAL}
    SELECT spec, any_value(start) AS start, any_value(stop) AS stop, count(*) FILTER (CASE WHEN start < stop THEN mi >= start AND mi < stop WHEN start > stop THEN mi >= start OR mi < stop ELSE FALSE END) AS inside FROM x, m GROUP BY spec"""
)
def dt2_windows(spark, sf_dir):
    """The ends of each window, and the events inside."""
    spans = [(s, timewin.Span.parse(s)) for s, _, _ in WINDOWS]
    minute = timewin.minute_of_day(F.col("l"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(x and x.start).cast("int").alias("start"), F.lit(x and x.end).cast("int").alias("stop"), (x.holds(minute) if x else F.lit(False)).alias("in")) for s, x in spans]))
    return local_events(spark, sf_dir).select(each.alias("w")).groupBy("w.spec", "w.start", "w.stop").agg(F.count_if("w.in").alias("inside"))


@query(
    f"""WITH {POSTS}, a AS (SELECT *, DATE '2024-01-01' + CAST(message_id % 6 AS INTEGER) AS day FROM posts) SELECT message_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN message_id % 4 = 0 THEN 9 ELSE 5 END AS score
    FROM a WHERE day >= DATE '2024-01-06' - 3"""
)
def str7_night_archive(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("message_id") % 6).cast("int"))
    p = views.posts(spark, sf_dir).select(*store.KEY, day.alias("day"), F.lit(5).alias("score"))
    new = p.where("message_id % 4 = 0").withColumn("score", F.lit(9))
    kept = store.night_archive(p, new, F.lit("2024-01-06").cast("date"))
    return kept.select("message_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "score")
