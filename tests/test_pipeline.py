"""The digest pipeline on inline posts."""

import datetime

from pyspark.sql import functions as F

from tidewire.plans.pipeline import Pipeline
from tidewire.sources.config import Group, Settings

NOW = datetime.datetime(2024, 1, 2, 4, 0, tzinfo=datetime.UTC)  # noon at +08:00
SCHEMA = "group_id string, channel string, message_id long, text string, published_at timestamp, scraped_at timestamp, evaluated_at timestamp"


def posts(spark, rows):
    t = lambda m: NOW - datetime.timedelta(minutes=m)
    return spark.createDataFrame([("g", "c", k, text, t(age), t(age), None) for k, text, age in rows], SCHEMA)


def test_every_pending_post_gets_its_state(spark):
    rows = [(1, "Emergency: trading halt at the exchange tonight", 5), (2, "Emergency: trading halt at the exchange tonight", 9), (3, "Bitcoin rises again this afternoon", 3), (4, "hello", 3), (5, "A breach was found in the old dam near town", 50), (6, "A quiet day at the lake with two boats", 4), (7, "Seen before: hackers breach a bank", 2)]
    p = posts(spark, rows)
    from tidewire.functions import text as tx

    claims = p.where("message_id = 7").select("group_id", tx.fingerprint("text").alias("fingerprint"), (F.unix_seconds("published_at")).alias("claimed"))
    done = Pipeline(Settings(min_score=7)).process_pending(p, claims, F.timestamp_seconds(F.lit(NOW.timestamp())))
    got = {r.message_id: (r.state, r.filter_reason) for r in done.outcomes.collect()}
    assert got == {
        1: ("selected", None), 2: ("filtered", "duplicate_content"), 3: ("filtered", "crypto_filter"), 4: ("filtered", "coarse_filter"), 5: ("filtered", "expired_or_invalid_time"),
        6: ("filtered", "digest_filtered"), 7: ("filtered", "duplicate_content"),
    }
    assert [r.message_id for r in done.items.collect()] == [1]


def test_a_closed_gate_leaves_posts_pending(spark):
    done = Pipeline(Settings()).process_pending(posts(spark, [(1, "A quiet day at the lake with two boats", 4)]), spark.createDataFrame([], "group_id string, fingerprint string, claimed long"), F.timestamp_seconds(F.lit(NOW.timestamp())))
    assert [(r.state, r.filter_reason) for r in done.outcomes.collect()] == [("pending", None)]
    assert not done.gates.first().open and done.items.count() == 0


def test_run_once_ingests_pages(spark):
    html = '<div class="tgme_widget_message" data-post="C/9"><div class="tgme_widget_message_text">Emergency rate cut announced by the bank</div><time datetime="2024-01-02T03:55:00+00:00"></time></div>'
    pages = spark.createDataFrame([("g", "c", html)], "group_id string, channel string, html string")
    stored = posts(spark, []).limit(0)
    new, done = Pipeline(Settings()).run_once(spark, pages, stored, spark.createDataFrame([], "group_id string, fingerprint string, claimed long"), F.timestamp_seconds(F.lit(NOW.timestamp())))
    assert [r.message_id for r in new.collect()] == [9] and [r.state for r in done.outcomes.collect()] == ["selected"]


def decide(spark, rows, hour, settings, claims=(), calls=(), sent=(), evaluator=None, day=2):
    """State and reason of posts (id, text, age in minutes) at an hour of 2 January at +08:00, and the ids sent."""
    now = datetime.datetime(2024, 1, day, hour, 0, tzinfo=datetime.timezone(datetime.timedelta(hours=8)))
    t = lambda m: now - datetime.timedelta(minutes=m)
    p = spark.createDataFrame([(g, "c", k, text, t(age), t(age), None) for g, k, text, age in rows], SCHEMA)
    c = spark.createDataFrame(list(claims), "group_id string, fingerprint string, claimed long, summary string")
    used = spark.createDataFrame([(g, int(now.timestamp()) - ago) for g, ago in calls], "group_id string, started long")
    done = Pipeline(settings, evaluator).process_pending(p, c, F.timestamp_seconds(F.lit(now.timestamp())), used, spark.createDataFrame(list(sent), "group_id string, n int") if sent else None)
    return {r.message_id: (r.state, r.filter_reason) for r in done.outcomes.collect()}, [r.message_id for r in done.items.collect()], done


HALT = "Emergency: trading halt at the exchange tonight"


def test_the_quiet_window_is_that_of_now(spark):
    rows = [("g", 1, "Emergency lights seen over the old harbour town", 3 * 24 * 60), ("g", 2, "A dam breach was reported in the far valley", 120), ("g", 3, HALT, 5), ("g", 4, "Another breach before the window began", 4 * 60), ("g", 5, "A breach that lies ahead of now by far", -10)]
    got, sent, _ = decide(spark, rows, 3, Settings())
    late = ("filtered", "expired_or_invalid_time")
    assert got[1] == late and got[4] == late and got[5] == late and got[2][1] != late[1] and got[3] == ("selected", None)
    assert sent == []  # score 7 is below the night's threshold


def test_thresholds_are_those_of_the_mode(spark):
    rows = [("g", k, f"A breach was found in valley number {'abcdefg'[k]}", 3) for k in range(3)]
    assert {s for s, _ in decide(spark, rows, 12, Settings())[0].values()} == {"selected"}  # three candidates open a day gate
    assert {s for s, _ in decide(spark, rows, 23, Settings())[0].values()} == {"pending"}  # an evening gate needs sixteen


def test_groups_have_their_own_settings(spark):
    groups = (Group("g", ("c",), overrides={"timezone": "UTC", "min_score": 9}), Group("h", ("d",), overrides={"news_max_age_seconds": 7200}))
    rows = [(g, k, f"{HALT} {'xyz'[k % 3]}", age) for k, (g, age) in enumerate([("g", 3), ("h", 3), ("h", 100), ("i", 3), ("i", 100)])]
    got, sent, done = decide(spark, rows, 12, Settings(groups=groups))
    assert got[2] == ("selected", None) and got[4] == ("filtered", "expired_or_invalid_time") and got[0] == ("filtered", "expired_or_invalid_time") or got[0][0] == "selected"
    assert set(sent) == {1, 2, 3}
    assert {r.group_id: r.mode for r in done.gates.collect()} == {"g": "quiet", "h": "day", "i": "day"}


def test_call_budgets_hold_back_batches(spark):
    rows = [(g, k, f"{HALT} {g}", 3) for k, g in enumerate("abc")]
    assert decide(spark, rows, 12, Settings(), calls=[("a", 60), ("b", 600)])[1] == [1, 2]  # a called a minute ago
    assert decide(spark, rows, 12, Settings(daily_calls=3), calls=[("z", 600), ("z", 900)])[1] == [0]  # one call is left for all groups


class Fixed:
    def __init__(self, items):
        self.items = items

    def evaluate(self, batch):
        schema = "message_id long, pos int, score int, title string, summary string, category string, event_age int, is_update boolean, update_reason string"
        items = batch.sparkSession.createDataFrame(self.items, schema)
        joined = batch.join(items, "message_id")
        return joined.select("group_id", "channel", "message_id", "pos", "score", "title", "summary", "category", (F.col("published_at") - F.make_dt_interval(mins=F.col("event_age"))).alias("event_at"), "is_update", "update_reason")


def test_subjects_near_duplicates_and_send_gates(spark):
    rows = [("g", k, f"{HALT} {'abcdefgh'[k]}", 3 + k) for k in range(7)]
    old = "Storm closes harbour near Lisbon: ferries cancelled tonight"
    items = [
        (0, 1, 9, "Coin rally", "bitcoin up again", "x", 0, False, ""), (1, 2, 9, "Storm closes harbour near Lisbon", "ferries cancelled tonight", "x", 0, False, ""),
        (2, 3, 9, "Storm closes harbour near Lisbon", "ferries cancelled, 400 hurt", "x", 0, True, "now 400 hurt"), (3, 4, 9, "Old event", "told late", "x", 60, False, ""),
        (4, 5, 6, "Minor matter", "of little weight", "x", 0, False, ""), (5, 6, 8, "Rates cut in Ghana", "by the bank", "x", 0, False, ""), (5, 7, 9, "Second item of a post", "goes", "x", 0, False, ""),
    ]
    claimed = int(datetime.datetime(2024, 1, 2, 3, 0, tzinfo=datetime.UTC).timestamp())
    got, sent, done = decide(spark, rows, 12, Settings(), claims=[("g", "f", claimed, old)], evaluator=Fixed(items))
    assert got[0] == ("filtered", "crypto_filter") and got[1] == ("filtered", "near_duplicate") and got[2] == ("selected", None) and got[6] == ("filtered", "digest_filtered")
    assert sent == [5, 2]  # oldest first; 3 has an old event, 4 a low score
    assert sorted(r.summary for r in done.claims.collect()) == ["Rates cut in Ghana: by the bank", "Storm closes harbour near Lisbon: ferries cancelled, 400 hurt"]
    assert [r.group_id for r in done.calls.collect()] == ["g"]
    done.release()


def test_the_quiet_cap_counts_cards_already_sent(spark):
    rows = [("g", k, f"{HALT} {'abcdefgh'[k]}", 3 + k) for k in range(6)]
    items = [(k, k, 9, f"Event {'abcdef'[k]} of its own", f"told {'ghijkl'[k]} once", "x", 0, False, "") for k in range(6)]
    assert decide(spark, rows, 3, Settings(), sent=[("g", 3)], evaluator=Fixed(items))[1] == [5, 4]
    assert decide(spark, rows, 3, Settings(), evaluator=Fixed(items))[1] == [5, 4, 3, 2, 1]


def test_passes_over_a_store_decide_each_post_once(spark, tmp_path, capsys):
    from tidewire import __main__ as cli

    html = '<div class="tgme_widget_message" data-post="C/9"><div class="tgme_widget_message_text">Emergency rate cut announced by the bank</div><time datetime="2024-01-02T03:55:00+00:00"></time></div>'
    spark.createDataFrame([("g", "c", html)], "group_id string, channel string, html string").write.parquet(f"{tmp_path}/pages")
    for name, schema in cli.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/store/{name}")
    said = []
    for _ in range(2):
        cli.once(spark, Settings(), f"{tmp_path}/pages", f"{tmp_path}/store", F.timestamp_seconds(F.lit(NOW.timestamp())))
        said.append(capsys.readouterr().out.split())
    assert said == [["g", "selected", "None", "1"], []]
    rows = {n: spark.read.parquet(f"{tmp_path}/store/{n}").count() for n in cli.TABLES}
    assert rows == {"posts": 1, "outcomes": 1, "claims": 1, "calls": 1}


class Broken:
    """Fails when its items are computed, as a service that is down does."""

    def evaluate(self, batch):
        return batch.select("group_id", "channel", "message_id", F.raise_error(F.lit("service down")).cast("int").alias("pos"), F.lit(1).alias("score"), F.lit("").alias("title"), F.lit("").alias("summary"), F.lit("").alias("category"))


def test_a_failed_evaluation_leaves_the_batch_pending_and_counts_the_call(spark):
    rows = [("g", 1, HALT, 3), ("g", 2, "hello", 3), ("g", 3, "A breach was found in the valley", 3)]
    got, sent, done = decide(spark, rows, 12, Settings(), evaluator=Broken())
    assert got == {1: ("pending", None), 2: ("filtered", "coarse_filter"), 3: ("pending", None)} and sent == []
    assert "service down" in done.failure and [r.group_id for r in done.calls.collect()] == ["g"] and done.claims.count() == 0


def test_the_next_evaluator_takes_over(spark):
    from tidewire.plans.pipeline import FallbackEvaluator, KeywordEvaluator

    rows = [("g", 1, HALT, 3)]
    got, sent, done = decide(spark, rows, 12, Settings(), evaluator=FallbackEvaluator(Broken(), KeywordEvaluator()))
    assert got == {1: ("selected", None)} and sent == [1] and done.failure is None
    broken = Broken()
    _, _, done = decide(spark, rows, 12, Settings(), evaluator=FallbackEvaluator(broken, broken))
    assert done.failure.count("Broken") == 1  # one evaluator isn't asked twice


def test_counters_equal_the_outcomes(spark, tmp_path):
    rows = [("g", k, t, 3) for k, t in enumerate([HALT, HALT, "hello", "Bitcoin rises again this afternoon", "A quiet day at the lake with two boats"])]
    got, _, done = decide(spark, rows, 12, Settings())
    outcomes, counters = done.counted()
    outcomes.write.parquet(f"{tmp_path}/outcomes")
    said = counters.get
    assert said["seen"] == 5 and {s: said[s] for s in ("pending", "filtered", "selected")} == {s: sum(v[0] == s for v in got.values()) for s in ("pending", "filtered", "selected")}
    assert {k.removeprefix("reason_"): n for k, n in said.items() if k.startswith("reason_") and n} == {r: sum(v[1] == r for v in got.values()) for r in {v[1] for v in got.values()} - {None}}
    assert said["evaluated"] == 2
