"""python -m tidewire: run passes over a folder of pages and a table of posts.

--once PAGES STORE   ingest pages (Parquet: group_id, channel, html), decide pending posts and print what became of them
--init-store STORE   create the empty tables of a store: posts, outcomes, claims, calls
--healthcheck BEATS  exit 1 if a heartbeat (Parquet: name, updated) is too old
--now                the clock, ISO-8601 with a zone (default: the time now)
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import functions as F

from .operators import store
from .plans.pipeline import CALLS, CLAIMS, Pipeline
from .session import session
from .sources import config

VERSION = "0.1.0"
POSTS = "group_id string, channel string, message_id long, published_at timestamp, scraped_at timestamp, text string, has_media boolean, media_type string, media_urls array<string>, direct_url string, forward_from string, views string, evaluated_at timestamp"


OUTCOMES = "group_id string, channel string, message_id long, filter_reason string, state string, decided_at timestamp"
TABLES = {"posts": POSTS, "outcomes": OUTCOMES, "claims": CLAIMS, "calls": CALLS}


def once(spark, settings: config.Settings, pages: str, root: str, now, ingest_only: bool = False) -> None:
    """One pass over a store. New posts are stored first, then calls and claims, then outcomes: a pass that stops on the
    way never decides or sends a post twice, though it may leave some unsent."""
    read = lambda name: spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    write = lambda df, name: df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("append").parquet(f"{root}/{name}")
    flow = Pipeline(settings)
    new, _ = flow.run_once(spark, spark.read.parquet(pages), read("posts"), read("claims"), now, True)
    write(new.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in POSTS.split(", ")) if n not in new.columns]), "posts")
    if ingest_only:
        return
    decided = read("outcomes").select(*store.KEY).distinct()
    done = flow.process_pending(read("posts").join(decided, list(store.KEY), "left_anti"), read("claims"), now, read("calls"))
    results = done.outcomes.where("state <> 'pending'").withColumn("decided_at", now).persist()
    waiting = done.outcomes.groupBy("group_id", "state", "filter_reason").count().orderBy("group_id", "state", "filter_reason").collect()
    results.count()
    claims, calls = done.claims.collect(), done.calls.collect()  # a batch's items and one call for each group at most
    write(spark.createDataFrame(calls, CALLS), "calls")
    write(spark.createDataFrame(claims, CLAIMS), "claims")
    write(results, "outcomes")
    done.release()
    for r in waiting:
        print(r.group_id, r.state, r.filter_reason, r["count"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--once", nargs=2, metavar=("PAGES", "STORE"))
    p.add_argument("--init-store", metavar="STORE")
    p.add_argument("--healthcheck", metavar="BEATS")
    p.add_argument("--config")
    p.add_argument("--now", default=None)
    p.add_argument("--ingest-only", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    settings = config.load(a.config)
    instant = datetime.datetime.fromisoformat(a.now) if a.now else datetime.datetime.now(datetime.UTC)
    if instant.tzinfo is None:
        p.error("--now needs a zone")
    spark, now = session(), F.timestamp_seconds(F.lit(instant.timestamp()))
    if a.init_store:
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{a.init_store}/{name}")
    if a.once:
        once(spark, settings, a.once[0], a.once[1], now, a.ingest_only)
    if a.healthcheck:
        limit = max(180, 3 * settings.poll_seconds + 60)
        return int(store.unhealthy(store.heartbeats(spark.read.parquet(a.healthcheck)), now, F.lit(limit)).where("NOT healthy").count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
