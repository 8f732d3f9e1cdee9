"""Scalar truth tables and plain-Python counterparts."""

import random
import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire import fixed
from tidewire.functions import followup, similar, text, timewin
from tidewire.operators import admission, filters, ranking, store
from tidewire.sources import config, pages, sinks


def test_number_buckets_truncate_and_round_half_even():
    numbers = lambda t: text.features_of(t)[1]
    assert numbers("6.06 and 6") == ["6"] and numbers("1,234.9") == ["1234"]
    assert numbers("0.125 0.5") == ["0.12", "0.50"] and numbers("") == []


def test_cjk_bigrams_and_template_phrases():
    _, numbers, tokens, specific, key = text.features_of("柴油零售均价突破6.06美元")
    assert tokens == ["柴油"] and specific == ["柴油"] and numbers == ["6"] and key is None
    assert "加州" in text.features_of("加州居民")[2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab the and é ß 1.2,5 $中国美元加州至\n", max_size=60))
def test_features_follow_their_definition(s):
    norm = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).casefold()).strip()
    body = re.sub(fixed.NUMBER, " ", norm, flags=re.I)
    for phrase in sorted(fixed.TEMPLATE_PHRASES, key=len, reverse=True):
        body = body.replace(phrase, " ")
    want = set(re.findall(r"[a-z]{2,}", body))
    for run in re.findall("[一-鿿]+", body):
        want |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
    assert text.features_of(s)[0] == norm and set(text.features_of(s)[2]) == want


@pytest.mark.parametrize(("a", "b", "same"), [("Diesel price hits $6.06 in California", "California diesel price at $6", True), ("Fed cuts by 25 bp", "Fed cuts by 50 bp", False), ("", "x y", False)])
def test_same_event(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.features("a").alias("a"), text.features("b").alias("b"))
    assert row.select(similar.same_event(F.col("a"), F.col("b"))).first()[0] is same


FOLLOWUP = "id int, title string, summary string, bullets array<string>, recents array<string>, is_update boolean, reason string"
OLD = "Storm closes harbour near Lisbon: ferries cancelled tonight"
NEW = "Insurers expect 400 million in claims"
CASES = [
    # title, summary, bullets, recents, is_update, reason -> skip, rewritten, title, summary, bullets
    (("Storm closes harbour near Lisbon", "ferries cancelled tonight", [], [OLD], False, ""), (True, False, "Storm closes harbour near Lisbon", "ferries cancelled tonight", [])),
    (("Storm closes harbour near Lisbon", "ferries cancelled tonight", ["ferries cancelled tonight near Lisbon harbour storm", NEW], [OLD], False, ""), (False, True, NEW, NEW, [NEW])),
    ((None, None, None, None, None, None), (False, False, "", "", [])),
    (("Any title", " text ", [" b ", ""], [], True, "why"), (False, False, "Any title", "text", ["b"])),
    (("Quite another matter", "of bread and wine", ["bakers strike"], [OLD], False, ""), (False, False, "Quite another matter", "of bread and wine", ["bakers strike"])),
    (("Storm closes harbour near Lisbon", "ferries cancelled tonight", [], [OLD], True, "Harbour damage now 700 million"), (False, True, "Harbour damage now 700 million", "Harbour damage now 700 million", ["Harbour damage now 700 million"])),
    (("Storm closes harbour near Lisbon", "", [OLD], [OLD, " "], False, None), (True, False, "Storm closes harbour near Lisbon", "", [OLD])),
]


def test_followup_cases(spark):
    rows = spark.createDataFrame([(k, *given) for k, (given, _) in enumerate(CASES)], FOLLOWUP)
    out = followup.sanitized(rows, *[F.col(c.split()[0]) for c in FOLLOWUP.split(", ")[1:]]).collect()
    assert {r.id: tuple(r["copy"]) for r in out} == {k: want for k, (_, want) in enumerate(CASES)}


def test_guard_changes_no_result_over_letters_that_fold_to_ascii(spark):
    odd = [chr(c) for c in range(128, 0x11000) if not 0xD800 <= c < 0xE000 and (set(chr(c).lower() + chr(c).upper() + chr(c).casefold()) & set(string.ascii_letters))]
    texts = [t.replace(x, c) for t in ("airdrop for all", "BITCOIN kiss", "task kraken") for x in set(t) if x.isalpha() for c in odd] + ["bıtcoin", "BİTCOIN price rises", "aırdrop for everyone here", "ſol up", "Kraken"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (fixed.SPAM, fixed.CRYPTO):
        bare = F.lit(False)
        for p in patterns:
            bare = bare | F.col("t").rlike(text.pattern(p))
        assert df.where(text.any_match(F.col("t"), *patterns) != bare).collect() == []
    assert df.where(text.any_match(F.col("t"), *fixed.CRYPTO)).where("t IN ('bıtcoin', 'BİTCOIN price rises')").count() == 2


def test_topic_patterns_of_both_dialects(spark):
    df = spark.createDataFrame([("black swans here",), ("aa bb",), ("end",)], "t string")
    match = lambda *p: [r[0] for r in df.where(filters.topic_matches(F.col("t"), F.lit("g"), {"default": {"patterns": list(p)}})).collect()]
    assert match(r"(?P<x>swans)") == ["black swans here"] and match(r"(?P<c>b)(?P=c)") == ["aa bb"] and match(r"end\Z") == ["end"]
    assert match("(", r"a(?<!b+)c", None) == []  # one that either dialect doesn't know is left out


def test_recent_summaries_cut_before_blank_ones_go(spark):
    rows = [("g", f"f{k}", 1000 - k, " " if k < 40 else f"summary {k}") for k in range(60)]
    claims = spark.createDataFrame(rows, "group_id string, fingerprint string, claimed long, summary string")
    assert ranking.recent_summaries(claims, F.lit(0)).count() == 0
    mixed = spark.createDataFrame([("g", f"f{k}", 1000 - k, [" a", "a ", "b", None][k % 4]) for k in range(12)], claims.schema)
    assert [(r.summary, r.position) for r in ranking.recent_summaries(mixed, F.lit(0)).orderBy("position").collect()] == [("a", 1), ("b", 2)]


def test_live_claims_equal_a_plain_walk():
    rng = random.Random(3)
    now, plain, live = 0.0, {}, admission.Live(50)
    for _ in range(500):
        now += rng.randrange(12)
        prints = [f"f{rng.randrange(12)}" for _ in range(rng.randrange(1, 3))]
        ok = not any(now - plain.get(p, -1e9) <= 50 for p in prints)
        if ok:
            plain.update(dict.fromkeys(prints, now))
        assert live.claim(now, prints) is ok


def test_failures_at_one_time(spark):
    rows = [("g", "c", 1, 5, False, "b"), ("g", "c", 1, 5, True, "a"), ("g", "c", 1, 4, True, "z"), ("g", "c", 2, 1, True, "x"), ("g", "c", 2, 2, False, None)]
    out = store.failures(spark.createDataFrame(rows, "group_id string, channel string, message_id long, at long, permanent boolean, error string"))
    assert sorted((r.message_id, r.retry_count, r.alert_sent, r.alert_error) for r in out.collect()) == [(1, 3, -1, "a"), (2, 2, 0, None)]


@pytest.mark.parametrize(("token", "value"), [("7", 420), ("07:30", 450), ("23:59", 1439)])
def test_minutes(token, value):
    assert timewin.minutes(token) == value


@pytest.mark.parametrize("token", ["", "24", "1:60", "a", "1:2:3"])
def test_bad_minutes(token):
    with pytest.raises(ValueError):
        timewin.minutes(token)


def test_windows():
    assert timewin.Span.parse("") is None and timewin.Span.parse("08:00-8") is None
    assert timewin.Span.parse("22:00-00:00") == timewin.Span(1320, 0)
    with pytest.raises(ValueError):
        timewin.Span.parse("22:00")
    with pytest.raises(ValueError):
        timewin.zone("Mars/Base")


PAGE = """<div class="tgme_widget_message" data-post="News/7"><div class="tgme_widget_message_text">A<br/>B <a href="https://x.y">https://x.y</a>&amp;<p>open</div>
<a class="tgme_widget_message_forwarded_from_name"> Src </a><time datetime="2024-01-02T03:04:05Z"></time><video src="v.mp4"></video><div class="tgme_widget_message_poll"></div></div>
<div class="tgme_widget_message" data-post="/8"></div><div class="tgme_widget_message" data-post="News/8"><i class="tgme_widget_message_photo_wrap"></i></div>"""


def test_page_parser():
    first, second = pages.parse_page(PAGE)
    assert first[:4] == ("news", 7, "2024-01-02T03:04:05Z", "A\nB https://x.y&open")
    assert first[4:7] == (True, "poll", ["v.mp4"]) and first[8] == "Src" and first[9] is None
    assert second[:2] == ("news", 8) and second[3] == "[PHOTO]" and second[6] == []
    assert pages.parse_page(None) == [] and pages.parse_page("<div><p>x") == []
    assert [p[0] for p in pages.parse_page('<div class="tgme_widget_message" data-post="/8"></div>', "@Own")] == ["own"]


class Pages:
    def __init__(self, ids):
        self.ids, self.asked = ids, []

    def fetch(self, channel, before=None):
        self.asked.append(before)
        some = sorted(i for i in self.ids if before is None or i < before)[-3:]
        return "".join(f'<div class="tgme_widget_message" data-post="c/{i}"><div class="tgme_widget_message_text">m{i}</div></div>' for i in some)


def test_history_walk_stops_at_known_posts_budget_and_cap():
    assert [p[1] for p in pages.walk(Pages(range(1, 11)), "c", set(), pages=2)] == [10, 9, 8, 7, 6, 5]
    assert [p[1] for p in pages.walk(Pages(range(1, 11)), "c", {6}, pages=9)] == [10, 9, 8, 7, 5]
    assert [p[1] for p in pages.walk(Pages(range(1, 11)), "c", set(), pages=9, most_new=4)] == [10, 9, 8, 7]
    assert pages.walk(Pages([]), "c", set(), pages=9) == []


def test_sink():
    assert sinks.signature("1599360473", "secret") == sinks.signature("1599360473", "secret") != sinks.signature("1599360474", "secret")

    class Transport:
        def __init__(self, replies):
            self.replies = list(replies)

        def post(self, url, body, headers):
            return self.replies.pop(0)

    assert sinks.deliver(Transport([(503, ""), (None, ""), (200, '{"code": 0}')]), "u", "{}", "1", "s")
    assert not sinks.deliver(Transport([(400, "")]), "u", "{}", "1")
    assert not sinks.deliver(Transport([(429, "")] * 3), "u", "{}", "1")
    assert sinks.host_is_public("a.example") and not sinks.host_is_public("127.0.0.1") and not sinks.host_is_public("db.internal")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("batch: 7\nmin_score: 8\ngroups:\n  - {id: a, channels: '@X, y', min_score: 9}\n  - {id: b, channels: [z], enabled: false}\n")
    (tmp_path / ".env").write_text("# c\nexport TIDEWIRE_BATCH='8'\n")
    s = config.load(tmp_path / "c.yaml", tmp_path / ".env", {"tidewire_min_score": "6"}, daily_calls=5)
    assert (s.batch, s.min_score, s.daily_calls) == (8, 6, 5)
    assert [g.id for g in s.active()] == ["a"] and s.groups[0].channels == ("x", "y") and s.of(s.groups[0], "min_score") == 9
    assert [g.id for g in config.Settings().active()] == ["legacy"]
    for bad in ({"groups": [{"id": "a", "channels": "x"}, {"id": "b", "channels": "x"}]}, {"groups": [{"id": "-"}]}, {"timezone": "No/Where"}, {"min_score": 11}):
        with pytest.raises(ValueError):
            config.load(environ={}, **bad)
