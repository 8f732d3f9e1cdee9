"""The history walk over stored posts: which posts a walk by pages finds, for all channels in one plan.

The walk goes from the newest page to older ones. A channel's posts in falling order are its pages, so every page's number is
known from a rank; what ends a walk is a condition on the pages before, which a running sum tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("group_id", "channel")


def walked(posts: DataFrame, page_size: int, pages: int, most_new: int | None = None) -> DataFrame:
    """The new posts that a walk finds: all columns, and page (from 0).

    posts: group_id, channel, message_id (distinct in a channel) and known (already stored). Of each channel up to `pages`
    pages (1 to 50) are read. The newest page never ends a walk; an older one without a new post does, and so do `most_new`
    new posts, of which the newest count. Known posts are passed over. A null `known` counts as new."""
    budget = min(50, max(1, pages))
    by_channel = Window.partitionBy(*KEY).orderBy(F.desc("message_id"))
    new = ~F.coalesce("known", F.lit(False))
    # pages beyond the budget go before anything is summed (Spark cuts them inside the window's own partitions)
    read = posts.withColumn("place", F.row_number().over(by_channel)).where(F.col("place") <= page_size * budget)
    read = read.withColumn("page", F.floor((F.col("place") - 1) / page_size).cast("int")).withColumn("new", new)
    by_page = read.groupBy(*KEY, "page").agg(F.count_if("new").alias("fresh"))
    ends = F.coalesce(F.max(F.when((F.col("fresh") == 0) & (F.col("page") > 0), 1)).over(Window.partitionBy(*KEY).orderBy("page")), F.lit(0))
    going = by_page.withColumn("ended", ends).where("ended = 0").select(*KEY, "page")
    found = read.join(going, [*KEY, "page"], "left_semi").where("new")
    if most_new is not None:
        found = found.withColumn("nth", F.row_number().over(by_channel)).where(F.col("nth") <= most_new).drop("nth")
    return found.select(*posts.columns, "page")
