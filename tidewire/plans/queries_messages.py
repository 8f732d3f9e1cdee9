"""Queries over messages for delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages
from . import views
from .registry import query

#: What of a message is compared: title, colour and its elements' texts, those of table cells included.
SHAPE = """struct<card: struct<header: struct<title: struct<content: string>, template: string>, body: struct<elements: array<struct<tag: string, text: struct<content: string>,
    columns: array<struct<elements: array<struct<text: struct<content: string>>>>>>>>>>"""


def _read(message):
    m = F.from_json(message, SHAPE)
    cells = lambda e: F.transform(e["columns"], lambda c: c["elements"][0]["text"]["content"])
    texts = F.transform(m["card"]["body"]["elements"], lambda e: F.coalesce(e["text"]["content"], F.array_join(cells(e), "|"), F.concat(F.lit("<"), e["tag"], F.lit(">"))))
    return [m["card"]["header"]["title"]["content"].alias("title"), m["card"]["header"]["template"].alias("template"), F.size(texts).alias("n_elements"), F.md5(F.array_join(texts, "\n--\n")).alias("texts_md5")]


@query(
    """WITH i AS (SELECT conv_id, turn, '**#' || (turn + 1) || ' [' || CASE WHEN turn % 2 = 0 THEN '军事' ELSE '行业快讯' END || '] ' || role || '**' || chr(10) || '来源：@' || role || ' / #' || (conv_id * 100 + turn) || chr(10) || text || chr(10) || chr(10)
      || '**四维影响**' || chr(10) || '**① 总体**：' || CASE WHEN turn % 3 = 0 THEN role ELSE '影响有限' END || chr(10) || '**② 美股**：影响有限' || chr(10) || '**③ 上证**：影响有限' || chr(10) || '**④ 大宗（黄金/原油等）**：影响有限' AS block FROM conversations),
    c AS (SELECT conv_id, count(*) AS n, string_agg('<hr>' || chr(10) || '--' || chr(10) || block, chr(10) || '--' || chr(10) ORDER BY turn) AS blocks FROM i GROUP BY 1)
    SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '本轮快讯汇总' ELSE 'conversation ' || conv_id END AS title, CASE WHEN conv_id % 3 > 0 THEN 'orange' ELSE 'blue' END AS template, CAST(1 + 2 * n + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_elements,
      md5('**📰 本轮总览**' || chr(10) || CASE WHEN conv_id % 5 = 0 THEN '本轮暂无概述。' ELSE n || ' items' END || chr(10) || '--' || chr(10) || blocks || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '--' || chr(10) || '**🧹 过滤说明**：' || n || ' kept' ELSE '' END) AS texts_md5 FROM c"""
)
def jsn9_digest_message(spark, sf_dir):
    """A digest of every conversation: each turn is an item."""
    c, i, t = views.table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    none = F.lit(None).cast("string")
    item = F.struct(
        (t + 1).cast("int").alias("rank"), F.when(t % 2 == 0, "军事").alias("category"), F.col("role").alias("title"), F.concat(F.lit("@"), "role").alias("channel"), (i * 100 + t).alias("message_id"), F.col("text").alias("summary"),
        F.when(t % 3 == 0, F.col("role")).alias("impact_overall"), F.lit(" ").alias("impact_us"), none.alias("impact_cn"), none.alias("impact_commodities"),
    )
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").cast("string").alias("n"))
    headline, overview = F.when(i % 4 > 0, F.concat(F.lit("conversation "), i.cast("string"))), F.when(i % 5 > 0, F.concat("n", F.lit(" items")))
    m = g.select("conv_id", messages.digest_message(headline, overview, F.col("items"), i % 3 > 0, F.when(i % 2 == 0, F.concat(F.lit(" "), "n", F.lit(" kept")))).alias("m"))
    return m.select("conv_id", *_read(F.col("m")))


@query(
    """WITH s AS (SELECT doc_id, source, CAST(doc_id % 10 + 1 AS INTEGER) AS score, strftime(make_timestamp((1704067200 + doc_id * 60 + 28800) * 1000000), '%Y-%m-%d %H:%M') AS clock, doc_id % 2 = 0 AS flagged FROM documents),
    t AS (SELECT *, CASE WHEN score >= 9 THEN '🚨' WHEN score >= 7 THEN '⚡' WHEN score >= 5 THEN '📢' ELSE 'ℹ️' END AS mark, CASE WHEN score >= 9 THEN '特急' WHEN score >= 7 THEN '重要' WHEN score >= 5 THEN '一般' ELSE '低优' END AS tier,
      flagged AND score >= 9 AS shown FROM s)
    SELECT doc_id, mark || ' 军事｜' || CASE WHEN doc_id % 7 = 0 THEN '未命名' ELSE source END AS title, CASE WHEN score >= 9 THEN 'red' WHEN score >= 7 THEN 'orange' WHEN score >= 5 THEN 'blue' ELSE 'grey' END AS template, CAST(5 + CASE WHEN shown THEN 6 ELSE 0 END AS INTEGER) AS n_elements,
      md5(array_to_string(list_concat(['🕒 **发布时间** ' || clock || '（北京时间）' || chr(10) || '🎚️ **紧急** **' || tier || '** ' || repeat('🔥', CAST(least(5, greatest(1, (score + 1) // 2)) AS INTEGER)), '<hr>',
        '**📌 核心速览**' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '1️⃣ first。' || chr(10) || '2️⃣ ' || source || '。' || chr(10) || '3️⃣ third！' WHEN 1 THEN source || ' alone。' ELSE '暂无详细摘要要点' END, '<hr>'],
        CASE WHEN shown THEN ['**💹 投资影响**', '**🌐 整体**|**🟢 利多**|' || source, '**📈 美股**|**🔴 利空**|影响有限', '**📊 上证**|**🟡 不确定**|影响有限', '**🛢️ 大宗**|**🟡 不确定**|影响有限', '<hr>'] ELSE [] END,
        ['**🎯 关注建议**' || chr(10) || '💡 ' || CASE WHEN doc_id % 5 = 0 THEN 'watch ' || source ELSE '紧密跟踪后续进展与官方确认信息。' END]), chr(10) || '--' || chr(10))) AS texts_md5 FROM t"""
)
def jsn9_item_message(spark, sf_dir):
    """A message about every document, with and without bullets, impact table and advice."""
    d, i, none = views.table(spark, sf_dir, "documents"), F.col("doc_id"), F.lit(None).cast("string")
    bullets = F.when(i % 3 == 0, F.array(F.lit("- first..."), F.lit(" "), "source", F.lit("third！"), F.lit("fourth")))
    item = F.struct(
        F.when(i % 7 > 0, F.col("source")).alias("title"), F.lit(" 军事 ").alias("category"), F.when(i % 3 == 1, F.concat("source", F.lit(" alone"))).alias("summary"), bullets.alias("summary_bullets"),
        F.lit("利多").alias("bias_overall"), F.lit("利空 ").alias("bias_us"), F.lit("up").alias("bias_cn"), none.alias("bias_commodities"),
        F.col("source").alias("impact_overall"), none.alias("impact_us"), F.lit("").alias("impact_cn"), none.alias("impact_commodities"), F.when(i % 5 == 0, F.concat(F.lit(" watch "), "source")).alias("actionable_insight"),
    )
    m = d.withColumn("item", item).select("doc_id", messages.item_message(F.col("item"), (i % 10 + 1).cast("int"), F.timestamp_seconds(views.START + i * 60), i % 2 == 0).alias("m"))
    return m.select("doc_id", *_read(F.col("m")))
