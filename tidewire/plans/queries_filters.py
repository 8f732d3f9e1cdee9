"""Filter, time and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import cards, mathfn, timewin
from ..functions import text as tx
from ..operators import filters
from ..sources import pages as page_source
from ..sources import sinks
from . import views
from .registry import duck, query, rows_sql

#: Texts that meet each filter; the supplied prose meets none of them.
TEXTS = [
    (-1, "Big airdrop for everybody, join the presale today"), (-2, "hello!!"), (-3, "GM"), (-4, "加群领取最新消息，名额有限，先到先得哦"), (-5, "Bitcoin rises again after the weekly close"),
    (-6, "Ethereum and the wider altcoin market slip"), (-7, "比特币价格再度走高，市场情绪回暖明显"), (-8, "VIP signal group opens tomorrow morning"), (-9, "An emergency rate cut was announced by the bank"),
    (-10, "央行降息二十五个基点，市场普遍认为符合预期"), (-11, "Missile strike reported near the border town"), (-12, "the methane leak was closed within hours"), (-13, "Casino opens in the old town next week"),
    (-14, "原油价格大幅上涨，布伦特突破九十美元"), (-15, "Quiet morning at the lake, two swans and a boat"), (-16, "short text"), (-17, ""), (-18, None), (-19, "solar panels and soldering: solid work done"),
    (-20, "Reuters reports trading halt after the earthquake"), (-21, "Guaranteed profit, 100x gem, free money for all"), (-22, "Ebitcoins and webbing3 are not words of note"), (-23, "矿工费上涨，链上活动趋于活跃，用户关注度提升"),
]
TEXT_COLUMNS = "message_id long, text string"
T = rows_sql("t0", TEXT_COLUMNS, TEXTS) + ", t AS (SELECT message_id, text, 'news24' AS group_id FROM t0 UNION ALL SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'news24' ELSE 'intl' END FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(TEXTS, TEXT_COLUMNS).withColumn("group_id", F.lit("news24"))
    d = views.table(spark, sf_dir, "documents")
    return own.unionByName(d.select(F.col("doc_id").alias("message_id"), "text", F.when(F.col("lang") == "en", "news24").otherwise("intl").alias("group_id")))


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[\\s 　]+|[\\s 　]+$', '', 'g')"


def like(c: str, *p: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), {duck(*p)})"


def flag(name: str, *patterns: str):
    sql = f"WITH {T} SELECT message_id, {like('text', *patterns)} AS hit FROM t"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("message_id", tx.any_match(F.coalesce("text", F.lit("")), *patterns).alias("hit"))

    run.__name__ = name
    return query(sql)(run)


flt1_spam_words = flag("flt1_spam_words", *fixed.SPAM)
flt2_crypto = flag("flt2_crypto", *fixed.CRYPTO)
flt6_urgent = flag("flt6_urgent", fixed.URGENT)
flt8_photo_unsafe = flag("flt8_photo_unsafe", *fixed.VICE, *fixed.POLITICAL, fixed.NEWS_LIKE)

POLICY = {"default": {"enabled": True, "patterns": [r"\b(swans|casino)\b", "(unclosed"]}, "intl": {"enabled": False, "patterns": [r"\bthe\b"]}}
BUCKET = f"""CASE WHEN length({strip('text')}) < 12 OR {like('text', *fixed.SPAM)} THEN 'coarse_filter' WHEN {like('text', *fixed.CRYPTO)} THEN 'crypto_filter'
  WHEN group_id <> 'intl' AND {like('text', POLICY['default']['patterns'][0])} THEN 'topic_filter' END"""


@query(f"WITH {T} SELECT message_id, group_id <> 'intl' AND {like('text', POLICY['default']['patterns'][0])} AS hit FROM t")
def flt3_topic(spark, sf_dir):
    return texts(spark, sf_dir).select("message_id", filters.topic_matches(F.coalesce("text", F.lit("")), F.col("group_id"), POLICY).alias("hit"))


@query(f"WITH {T} SELECT message_id, {BUCKET} AS reason FROM t")
def flt4_bucket_router(spark, sf_dir):
    return texts(spark, sf_dir).select("message_id", filters.bucket(F.col("text"), F.col("group_id"), POLICY).alias("reason"))


@query(f"WITH {T} SELECT coalesce({BUCKET}, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1")
def agg8_drop_tally(spark, sf_dir):
    return filters.tally(texts(spark, sf_dir), filters.bucket(F.col("text"), F.col("group_id"), POLICY))


NOW = views.START + 600 * 60  # the queries' clock: ten hours after the first post
KNOWN = "EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = message_id)"  # the stored posts are those with a label


def now():
    return F.timestamp_seconds(F.lit(NOW))


@query(
    f"""WITH {views.POSTS}, ages AS (SELECT * FROM (VALUES (1800), (0), (NULL)) AS v(max_age))
    SELECT message_id, CAST(max_age AS INTEGER) AS max_age, coalesce({NOW} - published_s >= -120 AND (max_age <= 0 OR {NOW} - published_s <= max_age), FALSE) AS fresh FROM posts, ages"""
)
def flt5_freshness(spark, sf_dir):
    ages = F.explode(F.array(F.lit(1800), F.lit(0), F.lit(None).cast("int"))).alias("max_age")
    return views.posts(spark, sf_dir).select("message_id", "published_at", ages).select("message_id", "max_age", timewin.fresh(F.col("published_at"), F.col("max_age"), now()).alias("fresh"))


PHOTOS = [
    (1, True, "photo", ["https://a.example/x.jpg", " https://a.example/x.jpg", "https://t.me/c/1"], "Quiet lake"), (2, True, "Album", ["http://b.example/y.png"], "casino night"),
    (3, True, "video", ["https://a.example/x.mp4"], "boat"), (4, False, "photo", ["https://a.example/x.jpg"], "boat"), (5, True, "photo", [], "boat"), (6, True, "photo", ["ftp://a.example/z"], "x"),
    (7, True, "photo", ["https://c.example/1.jpg"], "油价上涨"), (8, True, " PHOTO ", ["https://c.example/2.jpg"], "hello!!"), (9, True, "photo", ["https://c.example/3.jpg"], "Bitcoin art"),
    (10, None, "photo", ["https://c.example/3.jpg"], None), (11, True, None, ["https://c.example/3.jpg"], "x"), (12, True, "album", None, "x"),
]
PHOTO_COLUMNS = "id long, has_media boolean, media_type string, urls array<string>, text string"
#: The inline cases, and every document as a photo post of some kind.
P = rows_sql("p00", PHOTO_COLUMNS, PHOTOS) + """, p0 AS (SELECT * FROM p00 UNION ALL SELECT doc_id + 1000, doc_id % 5 <> 0, ['photo', ' Album ', 'video', 'PHOTO', NULL, 'album'][doc_id % 6 + 1],
  CASE WHEN doc_id % 4 = 0 THEN ['ftp://' || source] ELSE ['https://' || source || '.example/' || doc_id % 3, ' HTTPS://b.example/' || doc_id, 'https://t.me/x/' || doc_id, 'https://' || source || '.example/' || doc_id % 3] END,
  CASE WHEN doc_id % 7 > 0 THEN text END FROM documents)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    own = F.concat(F.lit("https://"), "source", F.lit(".example/"), (i % 3).cast("string"))
    urls = F.when(i % 4 == 0, F.array(F.concat(F.lit("ftp://"), "source"))).otherwise(F.array(own, F.concat(F.lit(" HTTPS://b.example/"), i.cast("string")), F.concat(F.lit("https://t.me/x/"), i.cast("string")), own))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("photo", " Album ", "video", "PHOTO", None, "album")]), (i % 6).cast("int") + 1)
    rows = d.select((i + 1000).alias("id"), (i % 5 != 0).alias("has_media"), kind.alias("media_type"), urls.alias("urls"), F.when(i % 7 > 0, F.col("text")).alias("text"))
    return spark.createDataFrame(PHOTOS, PHOTO_COLUMNS).unionByName(rows)


URLS = r"list_filter(list_transform(coalesce(urls, []), lambda u: trim(u)), lambda u: regexp_matches(lower(u), '^https?://') AND NOT regexp_matches(u, '(?i)t\.me/\S+'))"
IS_PHOTO = f"(coalesce(has_media, FALSE) AND lower(trim(coalesce(media_type, ''))) IN ('photo', 'album') AND len({URLS}) > 0)"


@query(f"WITH {P} SELECT id, {IS_PHOTO} AS photo FROM p0")
def flt7_photo_posts(spark, sf_dir):
    return photos(spark, sf_dir).select("id", filters.is_photo_post(F.col("has_media"), F.col("media_type"), F.col("urls")).alias("photo"))


@query(
    f"""WITH {P} SELECT id, CASE WHEN NOT {IS_PHOTO} THEN 'not_photo_media' WHEN {like('text', *fixed.VICE, *fixed.POLITICAL, fixed.NEWS_LIKE)} THEN 'wechat_unsafe'
    WHEN {like('text', *fixed.SPAM)} THEN 'coarse_filter' WHEN {like('text', *fixed.CRYPTO)} THEN 'crypto_filter' END AS reason FROM p0"""
)
def flt10_photo_prefilter(spark, sf_dir):
    return photos(spark, sf_dir).select("id", filters.photo_reason(F.col("has_media"), F.col("media_type"), F.col("urls"), F.col("text")).alias("reason"))


@query(f"WITH {P}, u AS (SELECT id, {URLS} AS l FROM p0) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS urls FROM u")
def win8_unique_urls(spark, sf_dir):
    return photos(spark, sf_dir).select("id", F.array_join(tx.photo_urls(F.col("urls")), "|").alias("urls"))


ITEMS = [
    (1, "军事", "战报", "前线平静", 9, True, "reuters", "Reuters: missile strike"), (2, "能源", "油市", "需求", 8, True, "afp", "the afp said so"), (3, " 宏观财经 ", "利率", "会议", 9, False, "AFP", "xafp said"),
    (4, "科技/AI", "芯片", "发布会", 10, True, "sec.gov", "see sec.gov today"), (5, None, "小镇", "湖边的船", None, True, "blog", "blog says"), (6, "地缘政治", "会谈", "停火", 12, True, "Associated Press", "By Associated Press."),
    (7, "财经", "指数", "收盘", 0, None, None, "nothing"), (8, "日常闲聊", "冲突升级", "空袭", -3, True, "reuters", None),
]
ITEM_COLUMNS = "id long, category string, title string, summary string, score int, flag boolean, source string, text string"
#: The inline cases, and every document as an evaluated item.
I = rows_sql("i00", ITEM_COLUMNS, ITEMS) + """, i0 AS (SELECT * FROM i00 UNION ALL SELECT doc_id + 1000, ['军事', ' 地缘政治 ', '宏观财经', '科技/AI', NULL][doc_id % 5 + 1], coalesce(['利多 ', '利空', '中性', NULL][doc_id % 4 + 1], source), text,
  CAST(doc_id % 14 - 2 AS INTEGER), doc_id % 3 <> 0, coalesce(['reuters', 'AFP', 'sec.gov', NULL][doc_id % 4 + 1], source), coalesce(['By Reuters and AFP.', 'seen at sec.gov today', NULL][doc_id % 3 + 1], text) FROM documents)"""  # noqa: E741
CATS = ", ".join(f"'{c}'" for c in fixed.NEWS_LIKE_CATEGORIES)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    of = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (i % len(values)).cast("int") + 1)
    rows = d.select(
        (i + 1000).alias("id"), of("军事", " 地缘政治 ", "宏观财经", "科技/AI", None).alias("category"), F.coalesce(of("利多 ", "利空", "中性", None), "source").alias("title"), F.col("text").alias("summary"),
        (i % 14 - 2).cast("int").alias("score"), (i % 3 != 0).alias("flag"), F.coalesce(of("reuters", "AFP", "sec.gov", None), "source").alias("source"), F.coalesce(of("By Reuters and AFP.", "seen at sec.gov today", None), "text").alias("text"),
    )
    return spark.createDataFrame(ITEMS, ITEM_COLUMNS).unionByName(rows)


@query(f"WITH {I} SELECT id, trim(coalesce(category, '')) IN ({CATS}) OR {like("concat_ws(' ', category, title, summary)", fixed.NEWS_LIKE)} AS hit FROM i0")
def flt9_news_like(spark, sf_dir):
    return items(spark, sf_dir).select("id", filters.is_news_like(F.col("category"), F.col("title"), F.col("summary")).alias("hit"))


@query(
    f"""WITH {I} SELECT id, CASE WHEN {like("concat_ws(' ', category, title, summary)", *fixed.VICE, *fixed.POLITICAL, fixed.NEWS_LIKE)} THEN 'wechat_unsafe'
    WHEN trim(coalesce(category, '')) IN ({CATS}) THEN 'wechat_news_like' WHEN id % 2 = 0 THEN 'no_photo_urls' END AS reason FROM i0"""
)
def flt11_photo_block(spark, sf_dir):
    urls = F.when(F.col("id") % 2 == 1, F.array(F.lit("https://a.example/x.jpg"))).otherwise(F.array().cast("array<string>"))
    return items(spark, sf_dir).select("id", filters.photo_block_reason(F.col("category"), F.col("title"), F.col("summary"), F.array().cast("array<string>"), urls).alias("reason"))


@query(
    f"""WITH {views.POSTS}, w AS (SELECT *, message_id % 3 = 0 AS photo, message_id % 2 = 0 AS quiet, published_s >= {NOW - 7200} AND published_s < {NOW} AS inside FROM posts)
    SELECT message_id, CASE WHEN photo THEN {NOW} - scraped_s BETWEEN -120 AND 1800 ELSE {NOW} - published_s BETWEEN -120 AND 1800 OR (quiet AND inside) END AS eligible FROM w"""
)
def flt12_eligible(spark, sf_dir):
    p = views.posts(spark, sf_dir)
    inside = (F.col("published_at") >= F.timestamp_seconds(F.lit(NOW - 7200))) & (F.col("published_at") < now())
    ok = filters.eligible(F.col("published_at"), F.col("scraped_at"), F.lit(1800), now(), F.col("message_id") % 2 == 0, inside, F.col("message_id") % 3 == 0)
    return p.select("message_id", ok.alias("eligible"))


@query(f"WITH {I} SELECT id FROM i0 WHERE NOT {like("concat_ws(' ', title, summary, category, source, text)", *fixed.CRYPTO, '油市|芯片')}")
def flt13_post_model_drop(spark, sf_dir):
    reason = filters.subject_reason(F.col("category"), F.col("title"), F.col("summary"), F.array("source"), F.col("text"), F.lit("g"), {"default": {"patterns": ["油市|芯片"]}})
    return items(spark, sf_dir).where(reason.isNull()).select("id")


@query(
    f"""WITH {I}, g AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS sent FROM i0)
    SELECT id, CASE WHEN id = 1 THEN 'mode_changed' WHEN id % 5 = 0 THEN 'expired_or_invalid_time' WHEN id % 7 = 0 THEN 'event_time_unknown_or_expired'
      WHEN coalesce(score, 0) < 7 THEN 'below_threshold' WHEN sent >= 5 THEN 'card_cap' ELSE 'send' END AS decision FROM g"""
)
def flt14_send_gate(spark, sf_dir):
    i = F.col("id")
    return items(spark, sf_dir).select("id", filters.send_decision(F.when(i == 1, "day").otherwise("quiet"), F.lit("quiet"), i % 5 != 0, i % 7 != 0, F.col("score"), F.lit(7), i - 1, F.lit(5)).alias("decision"))


@query(
    f"""WITH {I} SELECT id, coalesce(lower(trim(source)) IN ('reuters', 'associated press', 'afp', 'whitehouse.gov', 'federalreserve.gov', 'sec.gov')
    AND regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || replace(lower(trim(source)), '.', '[.]') || '([^\\p{{L}}\\p{{N}}_]|$)'), FALSE) AS attributed FROM i0"""
)
def flt15_attribution(spark, sf_dir):
    return items(spark, sf_dir).select("id", F.coalesce(filters.attributed(F.col("source"), F.col("text")), F.lit(False)).alias("attributed"))


@query(f"WITH {I} SELECT id, coalesce(flag AND score >= 9 AND trim(category) IN ('军事', '地缘政治', '宏观财经'), FALSE) AS shown FROM i0")
def flt16_impact_block(spark, sf_dir):
    return items(spark, sf_dir).select("id", cards.shows_impact(F.col("score"), F.col("category"), F.col("flag")).alias("shown"))


@query(
    f"""WITH {I} SELECT id, coalesce(score, 1) AS score, CASE WHEN coalesce(score, 1) >= 9 THEN 'red' WHEN score >= 7 THEN 'orange' WHEN score >= 5 THEN 'blue' ELSE 'grey' END AS color,
    CASE WHEN coalesce(score, 1) >= 9 THEN 'alarm_outlined' WHEN score >= 7 THEN 'bell_outlined' WHEN score >= 5 THEN 'info_outlined' ELSE 'cross_outlined' END AS icon,
    CAST(least(5, greatest(1, floor((coalesce(score, 1) + 1) / 2.0))) AS INTEGER) AS flames FROM i0"""
)
def strf25_tiers(spark, sf_dir):
    s = F.coalesce("score", F.lit(1))
    return items(spark, sf_dir).select("id", s.alias("score"), cards.color(F.col("score")).alias("color"), cards.icon(F.col("score")).alias("icon"), F.length(cards.flames(s)).alias("flames"))


@query(f"WITH {T} SELECT message_id, lower(regexp_replace(coalesce(text, ''), '^@+', '')) AS name FROM t")
def strf27_channel_names(spark, sf_dir):
    from ..operators import store

    return texts(spark, sf_dir).select("message_id", store.channel_name(F.coalesce("text", F.lit(""))).alias("name"))


NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"WITH {views.POSTS} SELECT message_id, sha256({NORM}) AS fingerprint FROM posts")
def strf2_fingerprint(spark, sf_dir):
    return views.posts(spark, sf_dir).select("message_id", tx.fingerprint("text").alias("fingerprint"))


NUM = r"(?:\$|usd|us\$|€|£|¥|￥)?(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
TOKENS = rf"list_sort(list_distinct(regexp_extract_all(regexp_replace({NORM}, '(?i){NUM}', ' ', 'g'), '[a-z]{{2,}}')))"


@query(
    f"""WITH {views.POSTS}, n AS (SELECT message_id, {NORM} AS norm, {TOKENS} AS tokens FROM posts)
    SELECT message_id, md5(norm) AS norm_md5, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5,
      len(list_filter(tokens, lambda x: x NOT IN ('the', 'and', 'for', 'from', 'with', 'that', 'this'))) AS n_specific FROM n"""
)
def strf5_tokens(spark, sf_dir):
    f = views.posts(spark, sf_dir).select("message_id", tx.features("text").alias("f"))
    return f.select("message_id", F.md5("f.norm").alias("norm_md5"), F.size("f.tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("f.tokens", " ")).alias("tokens_md5"), F.size("f.specific").cast("long").alias("n_specific"))


NUMBERS = [(1, "up to $6.06 today"), (2, "price 1,234.5 and 25 bp"), (3, "50bp"), (4, "none"), (5, "0.25 and 0.5"), (6, "1.2.3.4"), (7, ""), (8, "12 12 12.9")]


@query(
    f"""WITH {rows_sql('x0', 'id long, text string', NUMBERS)}, x AS (SELECT * FROM x0 UNION ALL SELECT doc_id + 1000, text FROM documents),
    n AS (SELECT id, list_transform(regexp_extract_all({NORM}, '{NUM}'), lambda s: CAST(replace(regexp_replace(s, '^[^0-9]+', ''), ',', '') AS DOUBLE)) AS v FROM x)
    SELECT id, array_to_string(list_sort(list_distinct(list_transform(v, lambda y: CASE WHEN y >= 1 THEN CAST(CAST(floor(y) AS HUGEINT) AS VARCHAR) ELSE printf('%.2f', y) END))), '|') AS numbers FROM n"""
)
def strf3_numbers(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return spark.createDataFrame(NUMBERS, "id long, text string").unionByName(d).select("id", F.array_join(tx.features("text")["numbers"], "|").alias("numbers"))


COPY = [(1, "Rates", "held"), (2, " ", "only summary"), (3, "Only title", None), (4, None, None), (5, "• 央行：降息。市场回暖", "次日"), (6, "很长" * 30, "x"), (7, "a，b", "c"), (8, "。空的", "d")]
C = rows_sql("c00", "id long, title string, summary string", COPY) + """, c0 AS (SELECT * FROM c00 UNION ALL
  SELECT doc_id + 1000, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN source END, CASE WHEN doc_id % 2 = 0 THEN text ELSE ' ' END FROM documents)"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = d.select((i + 1000).alias("id"), F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, F.col("source")).alias("title"), F.when(i % 2 == 0, F.col("text")).otherwise(" ").alias("summary"))
    return spark.createDataFrame(COPY, "id long, title string, summary string").unionByName(rows)


@query(
    f"""WITH {C} SELECT id, CASE WHEN {strip('title')} <> '' AND {strip('summary')} <> '' THEN {strip('title')} || ': ' || {strip('summary')} ELSE {strip('title')} || {strip('summary')} END AS blob FROM c0"""
)
def strf8_blob(spark, sf_dir):
    return copies(spark, sf_dir).select("id", tx.blob("title", "summary").alias("blob"))


@query(
    f"""WITH {C}, s AS (SELECT id, regexp_replace(trim(regexp_replace({strip('title')}, '\\s+', ' ', 'g')), '^[•\\-* ]+', '') AS s FROM c0), h AS (
      SELECT id, s, list_filter(list_transform(['。', '！', '？', '；', '，'], lambda m: CASE WHEN contains(s, m) THEN trim(string_split(s, m)[1]) ELSE '' END), lambda x: x <> '') AS l FROM s)
    SELECT id, rtrim(substr(coalesce(l[1], s), 1, 40)) AS lead FROM h"""
)
def strf13_lead_title(spark, sf_dir):
    return copies(spark, sf_dir).select("id", tx.lead_title(F.col("title")).alias("lead"))


@query(f"WITH {I} SELECT id, CASE trim(coalesce(title, '')) WHEN '利多' THEN '🟢 利多' WHEN '利空' THEN '🔴 利空' WHEN '中性' THEN '⚪ 中性' ELSE '🟡 不确定' END AS shown FROM i0")
def strf29_bias(spark, sf_dir):
    return items(spark, sf_dir).select("id", cards.bias(F.col("title")).alias("shown"))


@query(f"WITH {C} SELECT id, length({strip('title')}) > 80 OR len(string_split({strip('title')}, chr(10))) > 2 AS long FROM c0")
def strf18_long_summary(spark, sf_dir):
    return copies(spark, sf_dir).select("id", cards.is_long(F.col("title")).alias("long"))


@query(
    f"""WITH {T}, s AS (SELECT message_id, {strip('text')} AS s, {strip('lower(text)')} AS l FROM t)
    SELECT message_id, len(list_filter([{', '.join(f"'{k}'" for k in fixed.BREAKING_KEYWORDS)}], lambda k: contains(l, k))) AS hits FROM s"""
)
def strf23_keyword_triage(spark, sf_dir):
    low = F.lower(tx.stripped(F.coalesce("text", F.lit(""))))
    hits = F.size(F.filter(F.array(*[F.lit(k) for k in fixed.BREAKING_KEYWORDS]), lambda k: F.contains(low, k)))
    return texts(spark, sf_dir).select("message_id", hits.cast("long").alias("hits"))


# time of day -----------------------------------------------------------------------------------------

MIN = "(hour(l) * 60 + minute(l))"
LOCAL = f"lt AS (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM ev), m AS (SELECT *, CAST({MIN} AS INTEGER) AS mi FROM lt)"


def local_events(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return e.select("event_id", timewin.local_time(F.timestamp_seconds("at_s"), "Asia/Shanghai").alias("l"))


@query(f"WITH {views.EVENTS}, {LOCAL} SELECT event_id, mi AS minute, CASE WHEN mi < 480 THEN 'quiet' WHEN mi >= 1320 THEN 'shoulder' ELSE 'day' END AS mode FROM m")
def dt5_alert_mode(spark, sf_dir):
    return local_events(spark, sf_dir).select("event_id", timewin.minute_of_day(F.col("l")).alias("minute"), timewin.mode(F.col("l")).alias("mode"))


@query(
    f"""WITH {views.EVENTS}, {LOCAL} SELECT event_id, mi >= 1380 OR mi < 60 AS inside, strftime(CASE WHEN mi >= 1380 THEN l::DATE ELSE l::DATE - 1 END, '%Y-%m-%d') AS window_id FROM m"""
)
def dt3_wrapping_window(spark, sf_dir):
    span = timewin.Span.parse("23:00-01:00")
    return local_events(spark, sf_dir).select("event_id", span.holds(timewin.minute_of_day(F.col("l"))).alias("inside"), F.date_format(span.window_id(F.col("l")), "yyyy-MM-dd").alias("window_id"))


@query(
    f"""WITH {views.EVENTS}, {LOCAL} SELECT event_id, strftime(l::DATE + INTERVAL (CASE WHEN mi >= 1380 THEN 1 ELSE 0 END) DAY + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS ends,
    strftime(l::DATE + INTERVAL (CASE WHEN mi >= 1380 THEN 0 ELSE -1 END) DAY + INTERVAL 23 HOUR, '%Y-%m-%d %H:%M') AS starts FROM m"""
)
def dt8_quiet_bounds(spark, sf_dir):
    start, end = timewin.quiet_bounds(F.col("l"), "23:00-08:00")
    return local_events(spark, sf_dir).select("event_id", F.date_format(end, "yyyy-MM-dd HH:mm").alias("ends"), F.date_format(start, "yyyy-MM-dd HH:mm").alias("starts"))


@query(f"WITH {views.EVENTS}, {LOCAL} SELECT event_id, mi >= 480 AND mi < 540 AS due FROM m")
def dt9_morning_due(spark, sf_dir):
    return local_events(spark, sf_dir).select("event_id", timewin.morning_due(F.col("l"), "00:00-08:00").alias("due"))


@query(f"WITH {views.EVENTS}, {LOCAL} SELECT event_id, strftime(l, '%Y-%m-%d %H:%M') AS shown FROM m")
def dt11_card_time(spark, sf_dir):
    return views.events(spark, sf_dir).select("event_id", cards.local_minute(F.timestamp_seconds("at_s")).alias("shown"))


ISO = [(1, "2024-01-02T03:04:05Z"), (2, "2024-01-02T03:04:05+08:00"), (3, "2024-01-02T03:04:05"), (4, "nonsense"), (5, None), (6, "2024-13-02T03:04:05Z")]


@query(
    f"""WITH {rows_sql('x', 'id long, s string', ISO)}, {views.EVENTS} SELECT id, CASE id WHEN 1 THEN 1704164645 WHEN 2 THEN 1704135845 ELSE 0 END AS at_s FROM x
    UNION ALL SELECT event_id + 1000, CASE event_id % 5 WHEN 0 THEN at_s WHEN 1 THEN at_s - 28800 WHEN 2 THEN at_s + 19800 ELSE 0 END FROM ev"""
)
def dt12_iso_instant(spark, sf_dir):
    e, i = views.events(spark, sf_dir), F.col("event_id")
    clock = F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 5 == 0, F.concat(clock, F.lit("Z"))).when(i % 5 == 1, F.concat(clock, F.lit("+08:00"))).when(i % 5 == 2, F.concat(clock, F.lit("-05:30"))).when(i % 5 == 3, clock)
    rows = spark.createDataFrame(ISO, "id long, s string").unionByName(e.select((i + 1000).alias("id"), text.alias("s")))
    return rows.select("id", F.unix_seconds(timewin.iso_instant(F.col("s"))).cast("int").alias("at_s"))


_KNOBS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {', '.join('NULL' if x is None else str(x) for x in v)})" for m, v in fixed.KNOBS.items()) + ") AS v(mode, min_candidates, max_wait, min_interval, min_score, card_gap, max_age, card_cap))"


@query(f"WITH {views.EVENTS}, {LOCAL}, {_KNOBS}, w AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'flush' WHEN mi < 480 THEN 'quiet' WHEN mi >= 1320 THEN 'shoulder' ELSE 'day' END AS mode FROM m) SELECT event_id, k.* FROM w JOIN k USING (mode)")
def dt10_knobs(spark, sf_dir):
    """The thresholds that hold at each event's time."""
    e = local_events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 97 == 0, "flush").otherwise(timewin.mode(F.col("l"))).alias("mode"))
    return e.join(F.broadcast(timewin.knobs(spark)), "mode")  # four rows


# arithmetic ------------------------------------------------------------------------------------------


@query("SELECT event_id, round(least(60.0, pow(2.0, least(event_id % 20, 16)) * 0.5), 6) AS delay FROM events")
def mth1_backoff(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", F.round(mathfn.capped_backoff(F.lit(2.0), (F.col("event_id") % 20).cast("double"), F.lit(0.5), F.lit(60.0)), 6).alias("delay"))


HEADERS = [(1, "5"), (2, "-3"), (3, "soon"), (4, None), (5, "900.5"), (6, " 7 ")]


@query(
    f"""WITH {rows_sql('x0', 'id long, h string', HEADERS)}, x AS (SELECT * FROM x0 UNION ALL
      SELECT event_id + 1000, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '-' || user_id WHEN 2 THEN event_type WHEN 3 THEN ' ' || event_id || '.25 ' END FROM events)
    SELECT id, least(greatest(TRY_CAST(trim(h) AS DOUBLE), 0), 60.0) + 0.0 * TRY_CAST(trim(h) AS DOUBLE) AS wait FROM x"""
)
def mth2_retry_after(spark, sf_dir):
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    user = F.col("user_id").cast("string")
    header = F.when(i % 5 == 0, user).when(i % 5 == 1, F.concat(F.lit("-"), user)).when(i % 5 == 2, F.col("event_type")).when(i % 5 == 3, F.concat(F.lit(" "), i.cast("string"), F.lit(".25 ")))
    rows = spark.createDataFrame(HEADERS, "id long, h string").unionByName(e.select((i + 1000).alias("id"), header.alias("h")))
    return rows.select("id", mathfn.retry_after(F.col("h"), 60.0).alias("wait"))


@query("SELECT event_id, greatest(180, CAST(user_id * 3 + 5 + 60 AS BIGINT)) AS max_age FROM events")
def mth7_health_age(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", mathfn.health_max_age(F.col("user_id"), F.lit(5)).cast("long").alias("max_age"))


# sources and sinks -----------------------------------------------------------------------------------


@query("SELECT doc_id, 'https://t.me/s/' || lower(source) || CASE WHEN doc_id % 2 = 0 THEN '?before=' || doc_id ELSE '' END AS url FROM documents")
def src2_page_url(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", page_source.page_url(F.concat(F.lit("@@"), "source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("url"))


REPLIES = [(1, 200, '{"code":0}'), (2, 200, '{"StatusCode":0}'), (3, 200, '{"code":19001}'), (4, 200, '{"code":9499}'), (5, 429, ""), (6, 503, ""), (7, 400, ""), (8, None, ""), (9, 200, "no json"), (10, 200, '{"code":1,"StatusCode":0}')]


_CODE = "CASE WHEN json_valid(reply) AND json_type(reply, '$.{0}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(reply, '$.{0}') AS BIGINT) END"


@query(
    f"""WITH {rows_sql('x0', 'id long, status int, reply string', REPLIES)}, x AS (SELECT * FROM x0 UNION ALL
      SELECT event_id + 1000, [200, 200, 200, 429, 503, 404, NULL][event_id % 7 + 1], CASE event_id % 6 WHEN 0 THEN '{{"code":0}}' WHEN 1 THEN '{{"StatusCode":' || user_id % 2 || '}}' WHEN 2 THEN '{{"code":19001}}' WHEN 3 THEN '{{"code":"0"}}' WHEN 4 THEN event_type ELSE props END FROM events),
    c AS (SELECT id, status, coalesce({_CODE.format('code')}, {_CODE.format('StatusCode')}) AS code FROM x)
    SELECT id, CASE WHEN status IS NULL OR status = 429 OR status BETWEEN 500 AND 599 THEN 'retry' WHEN status = 200 AND code = 0 THEN 'sent' WHEN status = 200 AND code = 19001 THEN 'retry' ELSE 'failed' END AS outcome FROM c"""
)
def snk7_delivery_outcome(spark, sf_dir):
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 200, 200, 429, 503, 404, None)]), (i % 7).cast("int") + 1)
    by_user = F.concat(F.lit('{"StatusCode":'), (F.col("user_id") % 2).cast("string"), F.lit("}"))
    reply = F.when(i % 6 == 0, '{"code":0}').when(i % 6 == 1, by_user).when(i % 6 == 2, '{"code":19001}').when(i % 6 == 3, '{"code":"0"}').when(i % 6 == 4, F.col("event_type")).otherwise(F.col("props"))
    rows = spark.createDataFrame(REPLIES, "id long, status int, reply string").unionByName(e.select((i + 1000).alias("id"), status.alias("status"), reply.alias("reply")))
    return rows.select("id", sinks.outcome(F.col("status"), F.col("reply")).alias("outcome"))


MAGIC = [(1, "FFD8FFE0" + "00" * 8, "jpg"), (2, "89504E470D0A1A0A" + "00" * 4, "png"), (3, "474946383961" + "00" * 6, "gif"), (4, "52494646AABBCCDD57454250", "webp"), (5, "424D" + "00" * 10, "bmp"), (6, "00000100" + "00" * 8, "ico"), (7, "4D4D002A" + "00" * 8, "tiff"), (8, "FFD8FF", None), (9, "00" * 12, None)]


_HEADS = ("FFD8FFE1", "89504E470D0A1A0A", "474946383761", "52494646AABBCCDD57454250", "52494646AABBCCDD57454251", "424D", "00000100", "49492A00", "")


@query(
    f"""WITH {rows_sql('x0', 'id long, h string, kind string', MAGIC)}, x AS (SELECT id, h FROM x0 UNION ALL SELECT doc_id + 1000, [{', '.join(f"'{h}'" for h in _HEADS)}][doc_id % {len(_HEADS)} + 1] || CASE WHEN doc_id % 4 > 0 THEN upper(md5(text)) ELSE '' END FROM documents)
    SELECT id, CASE WHEN length(h) < 24 THEN NULL WHEN h LIKE 'FFD8FF%' THEN 'jpg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'gif'
      WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'webp' WHEN h LIKE '424D%' THEN 'bmp' WHEN h LIKE '00000100%' THEN 'ico' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'tiff' END AS kind FROM x"""
)
def snk11_image_kind(spark, sf_dir):
    d, i = views.table(spark, sf_dir, "documents"), F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (i % len(_HEADS)).cast("int") + 1)
    rows = d.select((i + 1000).alias("id"), F.concat(head, F.when(i % 4 > 0, F.upper(F.md5("text"))).otherwise("")).alias("h"))
    return spark.createDataFrame([m[:2] for m in MAGIC], "id long, h string").unionByName(rows).select("id", sinks.image_kind(F.unhex("h")).alias("kind"))
