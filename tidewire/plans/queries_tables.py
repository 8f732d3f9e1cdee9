"""Queries over keyed tables, queues, ledgers and state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..operators import admission, filters, nearjoin, ranking, store
from ..functions import text as tx
from ..functions import timewin
from . import views
from .queries_filters import BUCKET, KNOWN, NORM, NOW, TOKENS, T, now, texts  # noqa: F401
from .registry import query, rows_sql

P, E, C = views.POSTS, views.EVENTS, views.EVENTS + ", " + views.CALLS
FP = f"sha256({NORM})"


def keyed(df):
    """Posts with their fingerprint."""
    return df.withColumn("fingerprint", tx.fingerprint("text"))


# the flagship: pending digest candidates ---------------------------------------------------------------

BATCH = 20


@query(
    f"""WITH {P}, clock AS (SELECT max(published_s) AS latest FROM posts), fresh AS (SELECT posts.*, {FP} AS fingerprint FROM posts, clock WHERE latest - published_s >= -120),
    u AS (SELECT *, row_number() OVER (PARTITION BY group_id, fingerprint ORDER BY published_s DESC, channel, message_id) AS k FROM fresh),
    kept AS (SELECT * FROM u WHERE k = 1 AND ({BUCKET.replace("WHEN group_id <> 'intl'", "WHEN FALSE AND group_id <> 'intl'")}) IS NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY published_s DESC, channel, message_id) AS rank FROM kept)
    SELECT group_id, channel, message_id, fingerprint, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {BATCH}"""
)
def pending_digest_candidates(spark, sf_dir):
    """Posts of any age, newest of each fingerprint, unfiltered, in the order of the next batch at the time of the latest post."""
    posts = views.posts(spark, sf_dir)
    posts = posts.where(timewin.fresh(F.col("published_at"), 0, posts.agg(F.max("published_at")).scalar()))
    unique = ranking.newest_by_fingerprint(keyed(posts)).where("NOT duplicate")
    kept = unique.where(filters.bucket(F.col("text")).isNull()).withColumn("urgent", filters.is_urgent(F.col("text")))
    return ranking.batch(kept, BATCH).select("group_id", "channel", "message_id", "fingerprint", "rank")


# joins ---------------------------------------------------------------------------------------------------

NEW = f"{P}, stored AS (SELECT group_id, channel, message_id FROM posts WHERE {KNOWN}), incoming AS (SELECT *, 0 AS ord FROM posts UNION ALL SELECT *, 1 FROM posts)"


def stored_and_new(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    return p.where("known"), views.posts(spark, sf_dir).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))


@query(f"WITH {NEW} SELECT i.group_id, i.channel, i.message_id, i.ord FROM incoming i ANTI JOIN stored USING (group_id, channel, message_id)")
def jn1_unprocessed(spark, sf_dir):
    stored, new = stored_and_new(spark, sf_dir)
    return store.unseen(new, stored).select(*store.KEY, "ord")


@query(f"WITH {NEW} SELECT group_id, channel, message_id, min(ord) AS ord FROM (SELECT i.* FROM incoming i ANTI JOIN stored USING (group_id, channel, message_id)) GROUP BY ALL")
def snk2_insert_if_absent(spark, sf_dir):
    stored, new = stored_and_new(spark, sf_dir)
    return store.insert_if_absent(new, stored, [F.col("ord")]).select(*store.KEY, "ord")


CLAIMS = f"claims AS (SELECT group_id, {FP} AS fingerprint, published_s AS claimed FROM posts WHERE {KNOWN})"


@query(f"WITH {P}, {CLAIMS} SELECT message_id FROM posts WHERE EXISTS (SELECT 1 FROM claims c WHERE c.group_id = posts.group_id AND c.fingerprint = {FP} AND c.claimed >= {NOW - 86400})")
def jn2_seen_recently(spark, sf_dir):
    p = keyed(views.marked(spark, sf_dir))
    claims = p.where("known").select("group_id", "fingerprint", F.unix_seconds("published_at").alias("claimed"))
    return store.seen(p, claims, F.lit(NOW - 86400)).select("message_id")


# every post is stored, and every turn is an item of the post with its conversation's id

ITEMS = "raw AS (SELECT conv_id AS message_id, turn AS pos, conv_id AS item, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn % 12 END AS score FROM conversations)"


def model_items(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    p = views.posts(spark, sf_dir)
    items = c.select(F.col("conv_id").alias("message_id"), F.col("turn").alias("pos"), F.col("conv_id").alias("item"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 12).alias("score"))
    return items.join(p.select("message_id", "group_id", "channel"), "message_id"), p


@query(f"WITH {P}, {ITEMS} SELECT message_id, item, pos FROM (SELECT r.*, row_number() OVER (PARTITION BY r.message_id ORDER BY pos, item) AS n FROM raw r JOIN posts p USING (message_id)) WHERE n = 1")
def jn4_first_known_item(spark, sf_dir):
    items, p = model_items(spark, sf_dir)
    return ranking.first_items(items.withColumn("pos", F.struct("pos", "item")), p).select("message_id", "item", "pos.pos")


@query(f"WITH {P}, {ITEMS} SELECT r.item, r.pos, p.channel, p.published_s FROM raw r JOIN posts p USING (message_id)")
def jn5_item_to_post(spark, sf_dir):
    items, p = model_items(spark, sf_dir)
    return items.join(p.select(*store.KEY, "published_at"), list(store.KEY)).select("item", "pos", "channel", F.unix_seconds("published_at").alias("published_s"))


@query(
    f"""WITH {P}, {ITEMS}, f AS (SELECT message_id, max(score) AS score FROM (SELECT * FROM raw WHERE pos = 1) GROUP BY 1)
    SELECT p.message_id, f.score AS item_score, CASE WHEN f.score IS NULL THEN CASE WHEN p.message_id % 10 = 0 THEN 'near_duplicate' ELSE 'digest_filtered' END WHEN p.message_id % 10 = 0 THEN 'near_duplicate' END AS filter_reason
    FROM posts p LEFT JOIN f USING (message_id)"""
)
def jn6_outcome(spark, sf_dir):
    items, p = model_items(spark, sf_dir)
    cand = p.withColumn("filter_reason", F.when(F.col("message_id") % 10 == 0, fixed.NEAR_DUPLICATE))
    return ranking.outcome(cand, items.where("pos = 1").groupBy(*store.KEY).agg(F.max("score").alias("score"))).select("message_id", "item_score", "filter_reason")


@query(f"WITH {P} SELECT message_id, CASE WHEN {KNOWN} THEN message_id % 10 ELSE 7 END AS score FROM posts")
def jn7_overnight_merge(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    archived = p.where("known").select(*store.KEY, (F.col("message_id") % 10).cast("int").alias("score"))
    return ranking.merged_overnight(archived, p.select(*store.KEY)).select("message_id", F.col("score").cast("long").alias("score"))


_SIMILAR = f"""WITH {P}, f AS (SELECT group_id, message_id, {TOKENS} AS tokens FROM posts),
    x AS (SELECT group_id, message_id, len(tokens) AS n, unnest(tokens) AS t FROM f),
    s AS (SELECT a.group_id, a.message_id AS a, b.message_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared,
      count(*) FILTER (a.t NOT IN ('the', 'and', 'for', 'from', 'with', 'that', 'this')) AS specific FROM x a JOIN x b ON a.group_id = b.group_id AND a.t = b.t AND a.message_id < b.message_id GROUP BY 1, 2, 3),
    q AS (SELECT group_id, message_id, list_distinct(list_transform(regexp_extract_all({NORM}, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda y: CASE WHEN CAST(replace(y, ',', '') AS DOUBLE) >= 1 THEN CAST(floor(CAST(replace(y, ',', '') AS DOUBLE)) AS VARCHAR) ELSE printf('%.2f', CAST(replace(y, ',', '') AS DOUBLE)) END)) AS nums FROM posts)
    SELECT s.group_id, a, b, shared, na + nb - shared AS total FROM s JOIN q qa ON qa.group_id = s.group_id AND qa.message_id = a JOIN q qb ON qb.group_id = s.group_id AND qb.message_id = b
    WHERE ((shared >= 0.45 * (na + nb - shared) AND specific >= 1) OR (shared >= 0.30 * (na + nb - shared) AND specific >= 4))
      AND (len(qa.nums) = 0 OR len(qb.nums) = 0 OR len(list_intersect(qa.nums, qb.nums)) > 0)"""


@query(_SIMILAR)
def jn8_similar_posts(spark, sf_dir):
    p = views.posts(spark, sf_dir)
    f = p.select("group_id", F.col("message_id").alias("id"), tx.features("text").alias("f"))
    return nearjoin.similar_pairs(f).select("group_id", "a", "b", F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


@query(
    "WITH RECURSIVE pairs AS (" + _SIMILAR + """), l AS (SELECT group_id, a, b FROM pairs UNION ALL SELECT group_id, b, a FROM pairs),
    r AS (SELECT group_id, a, b FROM l UNION SELECT r.group_id, r.a, l.b FROM r JOIN l ON r.group_id = l.group_id AND r.b = l.a),
    d AS (SELECT group_id, a, count(*) AS n FROM l GROUP BY 1, 2), m AS (SELECT group_id, a, min(b) AS low FROM r GROUP BY 1, 2),
    """ + P + """ SELECT p.group_id, p.message_id, coalesce(n, 0) AS n_links, least(p.message_id, coalesce(low, p.message_id)) AS component_id
    FROM posts p LEFT JOIN d ON d.group_id = p.group_id AND d.a = p.message_id LEFT JOIN m ON m.group_id = p.group_id AND m.a = p.message_id"""
)
def jn8_similar_groups(spark, sf_dir):
    """Number of posts that tell of a post's event, and the group of posts that it is in."""
    f = views.posts(spark, sf_dir).select("group_id", "message_id", tx.features("text").alias("f"))
    return nearjoin.similar_groups(f, "message_id").select("group_id", "message_id", "n_links", "component_id")


@query(f"WITH {P} SELECT message_id, CASE group_id WHEN 'news24' THEN 8 ELSE 7 END AS min_score, CASE group_id WHEN 'news24' THEN '' ELSE '00:00-08:00' END AS quiet_hours FROM posts")
def jn10_group_settings(spark, sf_dir):
    groups = spark.createDataFrame([("news24", 8, ""), ("other", 5, None)], "group_id string, min_score int, quiet_hours string")
    return store.with_settings(views.posts(spark, sf_dir), groups, {"min_score": 7, "quiet_hours": "00:00-08:00"}).select("message_id", "min_score", "quiet_hours")


@query(f"WITH {P} SELECT message_id, CASE WHEN {KNOWN} THEN scraped_s ELSE {NOW} END AS scraped_s FROM posts")
def jn11_scraped_or_now(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    read = p.where("known").select(*store.KEY, F.unix_seconds("scraped_at").alias("s"))
    return p.select(*store.KEY).join(read, list(store.KEY), "left").select("message_id", F.coalesce("s", F.lit(NOW)).alias("scraped_s"))


@query(f"WITH {C} SELECT group_id, id, max(at_s) OVER (PARTITION BY group_id ORDER BY at_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_s FROM calls")
def jn12_last_call_before(spark, sf_dir):
    return views.calls(spark, sf_dir).select("group_id", "id", ranking.before("at_s", ["group_id"], ["at_s", "id"]).alias("last_s"))


# aggregations --------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT group_id, channel, count(*) AS n FROM posts GROUP BY CUBE (group_id, channel)")
def agg1_post_counts(spark, sf_dir):
    return views.posts(spark, sf_dir).cube("group_id", "channel").agg(F.count("*").alias("n"))


@query(f"WITH {C} SELECT group_id, max(at_s) AS last_s FROM calls GROUP BY 1")
def agg2_last_call(spark, sf_dir):
    return views.calls(spark, sf_dir).groupBy("group_id").agg(F.max("at_s").alias("last_s"))


@query(f"WITH {C} SELECT at_s // 86400 AS day, group_id, count(*) AS n FROM calls GROUP BY GROUPING SETS ((at_s // 86400, group_id), (at_s // 86400))")
def agg3_calls_of_day(spark, sf_dir):
    c = views.calls(spark, sf_dir).withColumn("day", F.floor(F.col("at_s") / 86400))
    return c.groupingSets([[F.col("day"), F.col("group_id")], [F.col("day")]], "day", "group_id").agg(F.count("*").alias("n")).select("day", "group_id", "n")


@query(f"WITH {C} SELECT at_s // 86400 AS day, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (tokens IS NULL) AS unknown FROM calls GROUP BY 1")
def agg4_daily_usage(spark, sf_dir):
    return views.calls(spark, sf_dir).groupBy(F.floor(F.col("at_s") / 86400).alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"))


@query(f"WITH {T} SELECT coalesce({BUCKET.replace("WHEN group_id <> 'intl'", "WHEN FALSE AND group_id <> 'intl'")}, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1")
def agg5_reason_histogram(spark, sf_dir):
    return filters.tally(texts(spark, sf_dir), filters.bucket(F.col("text")))


@query(f"WITH {P} SELECT group_id, greatest(0, {NOW} - min(scraped_s)) AS oldest FROM posts GROUP BY 1")
def agg6_oldest_pending(spark, sf_dir):
    return views.posts(spark, sf_dir).groupBy("group_id").agg(F.greatest(F.lit(0), NOW - F.min(F.unix_seconds("scraped_at"))).alias("oldest"))


@query(f"WITH {P} SELECT channel, message_id // 100 AS page, max(message_id) AS newest, min(message_id) AS oldest FROM posts GROUP BY 1, 2")
def agg7_page_bounds(spark, sf_dir):
    return views.posts(spark, sf_dir).groupBy("channel", F.floor(F.col("message_id") / 100).alias("page")).agg(F.max("message_id").alias("newest"), F.min("message_id").alias("oldest"))


@query(f"WITH {P} SELECT count(*) AS posts, count(DISTINCT group_id || '/' || channel) AS channels, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (length(text) < 100) AS short FROM posts")
def agg9_pass_summary(spark, sf_dir):
    return views.posts(spark, sf_dir).agg(F.count("*").alias("posts"), F.countDistinct("group_id", "channel").alias("channels"), F.sum(F.length("text")).alias("characters"), F.count_if(F.length("text") < 100).alias("short"))


@query(
    f"""WITH {P} SELECT group_id, count(*) AS n, greatest(0, {NOW} - min(scraped_s)) AS oldest, bool_or(message_id % 997 = 0) AS any_urgent,
    bool_or(message_id % 997 = 0) OR count(*) >= 700 OR greatest(0, {NOW} - min(scraped_s)) >= 900000 AS open FROM posts GROUP BY 1"""
)
def agg10_gate(spark, sf_dir):
    p = views.posts(spark, sf_dir).withColumn("urgent", F.col("message_id") % 997 == 0)
    return ranking.gate(p, now(), 700, 900000)


@query(f"WITH {P} SELECT group_id, count(DISTINCT {FP}) AS fingerprints FROM posts GROUP BY 1")
def agg11_fingerprint_sets(spark, sf_dir):
    return keyed(views.posts(spark, sf_dir)).groupBy("group_id").agg(F.countDistinct("fingerprint").alias("fingerprints"))


@query(
    f"""WITH {E}, p AS (SELECT CAST(user_id AS VARCHAR) AS channel, at_s, event_id, event_type <> 'error' AS ok FROM ev), m AS (SELECT channel, max((at_s, event_id)) FILTER (ok) AS last FROM p GROUP BY 1)
    SELECT p.channel, max(event_id) AS last_message_id, max(at_s) AS polled_s, max(at_s) FILTER (ok) AS success_s, count(*) AS total_seen,
      arg_max(CASE WHEN ok THEN NULL ELSE 'failed' END, (at_s, event_id)) AS any_error, count(*) FILTER (NOT ok AND (m.last IS NULL OR (at_s, event_id) > m.last)) AS streak FROM p JOIN m USING (channel) GROUP BY 1"""
    .replace("arg_max(CASE WHEN ok THEN NULL ELSE 'failed' END, (at_s, event_id)) AS any_error", "CASE WHEN arg_max(ok, (at_s, event_id)) THEN NULL ELSE 'failed' END AS any_error")
)
def agg12_channel_state(spark, sf_dir):
    s = store.channel_state(views.polls(spark, sf_dir))
    return s.select(
        "channel", "last_message_id", F.unix_seconds("last_polled_at").alias("polled_s"), F.unix_seconds("last_success_at").alias("success_s"), F.col("total_messages_seen").alias("total_seen"),
        F.col("last_error").alias("any_error"), F.col("consecutive_errors").alias("streak"),
    )


@query(
    f"""WITH {E}, c AS (SELECT event_type AS group_id, CAST(event_id AS VARCHAR) AS fingerprint, at_s AS claimed, 'user ' || user_id AS summary FROM ev),
    n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY claimed DESC, fingerprint) AS n FROM c), o AS (SELECT group_id, summary, min(n) AS n FROM n WHERE n <= 40 GROUP BY 1, 2)
    SELECT group_id, summary, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n) AS position FROM o) WHERE position <= 20"""
)
def agg13_recent_summaries(spark, sf_dir):
    e = views.events(spark, sf_dir)
    claims = e.select(F.col("event_type").alias("group_id"), F.col("event_id").cast("string").alias("fingerprint"), F.col("at_s").alias("claimed"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("summary"))
    return ranking.recent_summaries(claims, F.lit(0))


# windows and sequential decisions ------------------------------------------------------------------------


@query(f"WITH {P} SELECT message_id, row_number() OVER (PARTITION BY group_id, {FP} ORDER BY published_s DESC, channel, message_id) > 1 AS duplicate FROM posts")
def win1_newest_by_fingerprint(spark, sf_dir):
    return ranking.newest_by_fingerprint(keyed(views.posts(spark, sf_dir))).select("message_id", "duplicate")


@query(f"WITH {ITEMS} SELECT item, pos, least(10, greatest(1, coalesce(score, 11 - pos))) AS score FROM raw")
def win3_item_score(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    score = F.when(F.col("turn") % 3 != 0, F.col("turn") % 12)
    return c.select(F.col("conv_id").alias("item"), F.col("turn").alias("pos"), ranking.item_score(score, F.col("turn")).alias("score"))


@query(
    f"""WITH RECURSIVE {E}, k AS (SELECT event_type AS g, user_id AS f, min(at_s) AS s FROM ev GROUP BY 1, 2), a AS (
      SELECT g, f, s FROM k UNION ALL SELECT a.g, a.f, (SELECT min(at_s) FROM ev WHERE event_type = a.g AND user_id = a.f AND at_s > a.s + 86400) FROM a WHERE a.s IS NOT NULL)
    SELECT g AS group_id, f AS fingerprint, count(*) AS accepted, max(s) AS last_s FROM a WHERE s IS NOT NULL GROUP BY 1, 2"""
)
def win4_claims(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("event_type").alias("group_id"), F.col("user_id").alias("fingerprint"), F.col("at_s").alias("claimed_s"), F.col("event_id").alias("id"))
    return admission.claims(e).where("accepted").groupBy("group_id", "fingerprint").agg(F.count("*").alias("accepted"), F.max("claimed_s").alias("last_s"))


@query(
    f"""WITH RECURSIVE {C}, a AS (SELECT group_id AS g, min(at_s) AS s FROM calls GROUP BY 1 UNION ALL
      SELECT a.g, (SELECT min(at_s) FROM calls WHERE group_id = a.g AND at_s >= a.s + 21600) FROM a WHERE a.s IS NOT NULL)
    SELECT g AS group_id, s AS at_s FROM a WHERE s IS NOT NULL"""
)
def win5_cooldown(spark, sf_dir):
    return admission.reservations(views.calls(spark, sf_dir), 21600).where("accepted").select("group_id", "at_s")


@query(f"WITH {C} SELECT group_id, id, row_number() OVER (PARTITION BY group_id, at_s // 86400 ORDER BY at_s, id) <= 5 AS within_cap FROM calls")
def win6_card_cap(spark, sf_dir):
    c = views.calls(spark, sf_dir).withColumn("window", F.floor(F.col("at_s") / 86400))
    return ranking.capped(c, ["group_id", "window"], [F.col("at_s"), F.col("id")], 5).select("group_id", "id", "within_cap")


@query(
    f"""WITH {E}, m AS (SELECT event_type AS group_id, at_s * 100000 + event_id AS k, at_s // 86400 AS day, CASE WHEN (at_s % 86400) < 28800 THEN 'quiet' ELSE 'day' END AS mode FROM ev),
    c AS (SELECT *, lag(mode) OVER (PARTITION BY group_id ORDER BY k) AS before FROM m) SELECT group_id, day, min(k) AS k FROM c WHERE mode = 'day' AND before <> 'day' GROUP BY 1, 2"""
)
def win7_morning_flush(spark, sf_dir):
    e = views.events(spark, sf_dir)
    mode = F.when(F.col("at_s") % 86400 < 28800, "quiet").otherwise("day")
    m = e.select(F.col("event_type").alias("group_id"), (F.col("at_s") * 100000 + F.col("event_id")).alias("at"), F.floor(F.col("at_s") / 86400).alias("day"), mode.alias("mode"))
    return ranking.flushes(m).withColumnRenamed("at", "k")


@query(
    f"""WITH RECURSIVE {E}, q AS (SELECT event_type AS g, at_s, event_id, value > 100 AS esc, row_number() OVER (PARTITION BY event_type ORDER BY at_s, event_id) AS n FROM ev),
    w AS (SELECT g, n, at_s AS last, TRUE AS ok FROM q WHERE n = 1 UNION ALL SELECT q.g, q.n, CASE WHEN q.esc OR q.at_s - w.last >= 1800 THEN q.at_s ELSE w.last END, q.esc OR q.at_s - w.last >= 1800 FROM w JOIN q ON q.g = w.g AND q.n = w.n + 1)
    SELECT g AS group_id, count(*) FILTER (ok) AS accepted, max(last) AS last_s FROM w GROUP BY 1"""
)
def str8_night_alerts(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("event_type").alias("group_id"), "at_s", F.col("event_id").alias("id"), (F.col("value") > 100).alias("escalation"))
    done = admission.night_alerts(e)
    return done.groupBy("group_id").agg(F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("at_s"))).alias("last_s"))


@query(f"WITH {E} SELECT event_type AS group_id, at_s // 86400 AS day, min(at_s) AS at_s FROM ev GROUP BY 1, 2")
def str12_morning_claim(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("event_type").alias("group_id"), F.floor(F.col("at_s") / 86400).alias("day"), "at_s", F.col("event_id").alias("id"))
    return admission.once_per_day(e).select("group_id", "day", "at_s")


#: One step a call, in order; the state is the last call and the day's calls of each group, and the day's calls of all.
_BUDGET = f"""WITH RECURSIVE {C}, q AS MATERIALIZED (SELECT list({{'g': group_id, 's': at_s, 'id': id}} ORDER BY at_s, id) AS xs FROM calls), w AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS BIGINT) AS id, CAST(-1 AS BIGINT) AS at_s, FALSE AS ok, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS last, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS n, CAST(0 AS BIGINT) AS total
      UNION ALL SELECT i, g, id, at_s, ok, CASE WHEN ok THEN map_concat(last, MAP {{g: at_s}}) ELSE last END, CASE WHEN ok THEN map_concat(n, MAP {{g: coalesce(n[g], 0) + 1}}) ELSE n END, total + CAST(ok AS BIGINT) FROM (
        SELECT *, coalesce(at_s - last[g] >= 600, TRUE) AND coalesce(n[g], 0) < 50 AND total < 120 AS ok FROM (
          SELECT i + 1 AS i, xs[i + 1].g AS g, xs[i + 1].id AS id, xs[i + 1].s AS at_s, last, CASE WHEN xs[i + 1].s // 86400 = w.at_s // 86400 THEN n ELSE MAP {{}} END AS n,
            CASE WHEN xs[i + 1].s // 86400 = w.at_s // 86400 THEN total ELSE 0 END AS total FROM w, q WHERE i < len(xs))))
    SELECT g AS group_id, id, at_s FROM w WHERE ok"""


@query(_BUDGET)
def str4_total_budget(spark, sf_dir):
    """Calls accepted under a cooldown, a group budget and one over all groups."""
    return admission.reservations_with_total(views.calls(spark, sf_dir), 600, 50, 120).where("accepted").select("group_id", "id", "at_s")


#: One step a claim of each group, in order; the state is what the group took in the last day.
_PAIRED = f"""WITH RECURSIVE {E}, q AS MATERIALIZED (SELECT event_type AS g, list({{'s': at_s, 'id': event_id, 'u': 'u' || user_id, 'v': 'v' || CAST(floor(value) AS BIGINT)}} ORDER BY at_s, event_id) AS xs FROM ev GROUP BY 1), w AS (
      SELECT g, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, FALSE AS ok, CAST([] AS STRUCT(p VARCHAR, s BIGINT)[]) AS live FROM q
      UNION ALL SELECT g, i, id, ok, CASE WHEN ok THEN list_concat(live, [{{'p': u, 's': s}}, {{'p': v, 's': s}}]) ELSE live END FROM (
        SELECT *, len(list_filter(live, lambda x: x.p = u OR x.p = v)) = 0 AS ok FROM (
          SELECT g, i + 1 AS i, xs[i + 1].id AS id, xs[i + 1].s AS s, xs[i + 1].u AS u, xs[i + 1].v AS v, list_filter(live, lambda x: xs[i + 1].s - x.s <= 86400) AS live FROM w JOIN q USING (g) WHERE i < len(xs))))
    SELECT g AS group_id, id FROM w WHERE ok"""


@query(_PAIRED)
def str3_paired_claims(spark, sf_dir):
    """Claims of two fingerprints each: by user and by a bucket of the value."""
    e = views.events(spark, sf_dir)
    prints = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("v"), F.floor("value").cast("string")))
    rows = e.select(F.col("event_type").alias("group_id"), F.col("event_id").alias("id"), F.col("at_s").alias("claimed_s"), prints.alias("fingerprints"))
    return admission.paired_claims(rows).where("accepted").select("group_id", "id")


# top-k ---------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT group_id, message_id FROM posts WHERE NOT {KNOWN} ORDER BY scraped_s, message_id, group_id, channel LIMIT 100")
def top1_pending(spark, sf_dir):
    p = views.marked(spark, sf_dir).withColumn("evaluated_at", F.when(F.col("known"), F.lit(1)))
    return ranking.pending(p, ranking.load_limit(20, 5)).select("group_id", "message_id")


@query(f"WITH {P} SELECT group_id, message_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY scraped_s, message_id, channel) AS position FROM posts) WHERE position <= 50")
def top1_pending_by_group(spark, sf_dir):
    p = views.posts(spark, sf_dir).withColumn("evaluated_at", F.lit(None).cast("timestamp"))
    return ranking.pending_by_group(p, 50).select("group_id", "message_id", "position")


@query(f"WITH {P} SELECT group_id, message_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY message_id % 50 = 0 DESC, published_s DESC, channel, message_id) AS rank FROM posts) WHERE rank <= 20")
def top3_batch(spark, sf_dir):
    p = views.posts(spark, sf_dir).withColumn("urgent", F.col("message_id") % 50 == 0)
    return ranking.batch(p).select("group_id", "message_id", "rank")


@query(f"WITH {P} SELECT channel, message_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) AS n FROM posts) WHERE n <= 10")
def top6_page_rows(spark, sf_dir):
    p = views.posts(spark, sf_dir)
    return p.withColumn("n", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("message_id")))).where("n <= 10").select("channel", "message_id")


@query(
    f"""WITH {P}, s AS (SELECT *, message_id % 10 + 1 AS score, {FP} AS fp FROM posts WHERE group_id = 'news24'), f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY score DESC, published_s DESC, message_id) AS k FROM s),
    t AS (SELECT * FROM f WHERE k = 1 ORDER BY score DESC, published_s DESC, message_id LIMIT 5) SELECT message_id, score, published_s FROM t"""
)
def top5_morning_ranking(spark, sf_dir):
    p = keyed(views.posts(spark, sf_dir).where("group_id = 'news24'")).withColumn("score", F.col("message_id") % 10 + 1)
    order = [F.desc("score"), F.desc("published_at"), F.col("message_id")]
    return store.first_by(p, ["fingerprint"], order).orderBy(*order).limit(5).select("message_id", "score", F.unix_seconds("published_at").alias("published_s"))


@query(f"WITH {P} SELECT message_id, CASE WHEN row_number() OVER (PARTITION BY channel ORDER BY published_s, message_id) > 2 THEN 'wechat_digest_cap' END AS reason FROM posts")
def top8_photo_cap(spark, sf_dir):
    p = ranking.capped(views.posts(spark, sf_dir), ["channel"], [F.col("published_at"), F.col("message_id")], fixed.PHOTO_MAX_ITEMS)
    return p.select("message_id", F.when(~F.col("within_cap"), fixed.PHOTO_CAP).alias("reason"))


# writes --------------------------------------------------------------------------------------------------

STATE = f"{P}, st AS (SELECT group_id, channel, message_id, published_s, CAST(NULL AS INTEGER) AS score, CASE WHEN message_id % 6 = 0 THEN 1 ELSE 0 END AS alert_sent FROM posts)"


@query(f"WITH {STATE} SELECT message_id, CASE WHEN {KNOWN} THEN CAST(message_id % 10 AS INTEGER) ELSE score END AS score, alert_sent FROM st")
def snk3_evaluation_update(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    st = p.select(*store.KEY, F.lit(None).cast("int").alias("score"), F.when(F.col("message_id") % 6 == 0, 1).otherwise(0).alias("alert_sent"))
    u = p.where("known").select(*store.KEY, (F.col("message_id") % 10).cast("int").alias("score"), F.lit(0).alias("alert_sent"))
    return store.apply_updates(st, u).select("message_id", "score", "alert_sent")


@query(f"WITH {STATE} SELECT message_id, CASE WHEN {KNOWN} THEN 1 ELSE alert_sent END AS alert_sent, CASE WHEN {KNOWN} AND message_id % 8 = 0 THEN 9 END AS score FROM st")
def snk4_mark_sent(spark, sf_dir):
    p = views.marked(spark, sf_dir)
    st = p.select(*store.KEY, F.lit(None).cast("int").alias("score"), F.when(F.col("message_id") % 6 == 0, 1).otherwise(0).alias("alert_sent"), F.lit(None).cast("timestamp").alias("alert_sent_at"), F.lit(None).cast("string").alias("summary"))
    sent = p.where("known").select(*store.KEY, now().alias("at"), F.when(F.col("message_id") % 8 == 0, 9).alias("score"), F.lit(None).cast("string").alias("summary"))
    return store.mark_sent(st, sent).select("message_id", "alert_sent", "score")


@query(f"WITH {E} SELECT user_id, count(*) AS retry_count, CASE WHEN arg_max(event_id % 3 = 0, event_id) THEN -1 ELSE 0 END AS alert_sent, 'e' || max(event_id) AS alert_error FROM ev WHERE event_type = 'error' GROUP BY 1")
def snk5_mark_failed(spark, sf_dir):
    e = views.events(spark, sf_dir).where("event_type = 'error'")
    a = e.select("user_id", F.col("event_id").alias("at"), (F.col("event_id") % 3 == 0).alias("permanent"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    return store.failures(a, ["user_id"])


@query(f"WITH {E} SELECT event_type AS name, max(at_s) AS updated FROM ev GROUP BY 1")
def snk13_heartbeats(spark, sf_dir):
    return store.heartbeats(views.events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("at_s").alias("updated")))


@query(f"WITH {E} SELECT event_type AS name, {NOW + 30 * 86400} - max(at_s) <= 40000 AS healthy FROM ev GROUP BY 1")
def flt18_health(spark, sf_dir):
    b = store.heartbeats(views.events(spark, sf_dir).select(F.col("event_type").alias("name"), F.timestamp_seconds("at_s").alias("updated")))
    return store.unhealthy(b, F.timestamp_seconds(F.lit(NOW + 30 * 86400)), F.lit(40000))


@query(f"WITH {P} SELECT message_id FROM posts WHERE length(text) < 1000 OR published_s >= {NOW + 90 * 86400} - 90 * 86400")
def snk14_retention(spark, sf_dir):
    p = views.posts(spark, sf_dir).withColumn("evaluated_at", F.when(F.length("text") >= 1000, F.col("published_at")))
    return store.retained(p, "evaluated_at", fixed.RETENTION_DAYS["posts"], F.timestamp_seconds(F.lit(NOW + 90 * 86400))).select("message_id")


OLD = [(1, "news24", "a"), (2, "bad id!", "a"), (3, None, "a"), (4, "-x", "b"), (5, "ok_1", "b"), (6, "x" * 65, "c")]


@query(
    f"""WITH {rows_sql('x0', 'id long, group_id string, channel string', OLD)}, x AS (SELECT * FROM x0 UNION ALL SELECT doc_id + 1000, [lang, NULL, '-' || lang, lang || ' x', lang || '_' || doc_id % 3][doc_id % 5 + 1], source FROM documents),
    g AS (SELECT id, channel, CASE WHEN regexp_matches(coalesce(group_id, ''), '^[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}$') THEN group_id ELSE 'legacy' END AS group_id FROM x) SELECT group_id, channel, min(id) AS id FROM g GROUP BY 1, 2"""
)
def snk16_migration(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    group = F.element_at(F.array("lang", F.lit(None).cast("string"), F.concat(F.lit("-"), "lang"), F.concat("lang", F.lit(" x")), F.concat("lang", F.lit("_"), (i % 3).cast("string"))), (i % 5).cast("int") + 1)
    x = spark.createDataFrame(OLD, "id long, group_id string, channel string").unionByName(d.select((i + 1000).alias("id"), group.alias("group_id"), F.col("source").alias("channel")))
    return store.migrated(x, ["group_id", "channel"], [F.col("id")])


@query(f"WITH {P} SELECT message_id, 1 AS score, TRUE AS is_filtered, 'digest_empty' AS filter_reason, '[filtered] ' || substr(text, 1, 20) AS summary FROM posts WHERE length(text) < 500")
def sup11_mark_filtered(spark, sf_dir):
    p = views.posts(spark, sf_dir).where(F.length("text") < 500)
    return store.mark_filtered(p, fixed.DIGEST_EMPTY, F.substring("text", 1, 20)).select("message_id", "score", "is_filtered", "filter_reason", "summary")


@query(
    """WITH g AS (SELECT * FROM (VALUES ('g1', ['A', '@b']), ('g2', ['B', 'c']), ('g3', ['d', '@D'])) AS v(group_id, channels) UNION ALL SELECT lang || '-' || doc_id % 3, list(DISTINCT CASE WHEN doc_id % 2 = 0 THEN '@' || upper(source) ELSE source END) FROM documents GROUP BY 1),
    c AS (SELECT DISTINCT group_id, ltrim(lower(unnest(channels)), '@') AS channel FROM g) SELECT channel, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1"""
)
def api4_exclusive_channels(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    listed = d.groupBy(F.concat("lang", F.lit("-"), (i % 3).cast("string")).alias("group_id")).agg(F.collect_set(F.when(i % 2 == 0, F.concat(F.lit("@"), F.upper("source"))).otherwise(F.col("source"))).alias("channels"))
    g = spark.createDataFrame([("g1", ["A", "@b"]), ("g2", ["B", "c"]), ("g3", ["d", "@D"])], "group_id string, channels array<string>")
    return store.exclusive_channels(g.unionByName(listed))