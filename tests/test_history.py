"""The walk through channels' histories: cursors, the HTTP rules, the stream across restarts, and the walk as one plan."""

import random

import pytest

from tests.history_pages import Files, page
from tidewire.operators import history as walk
from tidewire.sources import fetch, history
from tidewire.sources.pages import POST, parse_page


def parse(html):
    return parse_page(html, "c")


def server(ids, size=3, asked=None):
    def get(before):
        if asked is not None:
            asked.append(before)
        return page("c", sorted((i for i in ids if before is None or i < before), reverse=True)[:size])

    return get


def test_cursor_reads_every_post_once_over_polls():
    rng = random.Random(4)
    for _ in range(30):
        ids, cursor, seen, asked = set(rng.sample(range(1, 60), rng.randrange(0, 40))), history.Cursor(), [], []
        for _ in range(25):
            found, cursor = cursor.read(server(ids, 3, asked), parse, rng.randrange(1, 4))
            seen += [p[1] for p in found]
            assert history.Cursor.of(cursor.text()) == cursor
            if rng.random() < 0.4:
                ids |= {max(ids, default=0) + k for k in range(1, rng.randrange(1, 9))}
                cursor = cursor.polled()
        while cursor.polled().spans != ((None, cursor.top),) or cursor.spans:
            found, cursor = (cursor if cursor.open else cursor.polled()).read(server(ids), parse, 5)
            seen += [p[1] for p in found]
        found, cursor = cursor.polled().read(server(ids), parse, 50)
        seen += [p[1] for p in found]
        assert sorted(seen) == sorted(ids)  # none lost, none twice
        older = [b for b in asked if b is not None]
        assert len(older) == len(set(older))  # no page of the history is asked for twice


def test_cursor_stops():
    ids = range(1, 11)
    found, cursor = history.Cursor().read(server(ids), parse, 2)
    assert [p[1] for p in found] == [10, 9, 8, 7, 6, 5] and cursor.spans == ((5, 0),) and cursor.top == 10 and cursor.open
    found, cursor = history.Cursor().read(server(ids), parse, 9, most_new=4)
    assert [p[1] for p in found] == [10, 9, 8, 7, 6, 5]  # the page begun is read in whole
    found, cursor = cursor.read(server(ids), parse, 9)
    assert [p[1] for p in found] == [4, 3, 2, 1] and not cursor.open
    found, cursor = cursor.read(lambda before: None, parse, 9)
    assert found == [] and cursor.spans == ()
    found, stuck = history.Cursor(((5, 0),), 10).read(lambda before: None, parse, 9)
    assert found == [] and stuck.stuck and not stuck.open and stuck.polled().spans == ((None, 10), (5, 0)) and stuck.polled().open
    assert history.Cursor().read(lambda before: "<p>no posts</p>", parse, 9)[1].spans == ()
    again = lambda before: page("c", [7, 8, 9])  # noqa: E731  a server that ignores `before`
    found, cursor = history.Cursor().read(again, parse, 50)
    assert [p[1] for p in found] == [9, 8, 7] and cursor.spans == ()
    assert len(history.Cursor().read(server(range(1, 400), 1), parse, 1000)[0]) == history.PAGES_MOST


@pytest.mark.parametrize(
    ("answers", "body", "tries"),
    [
        ([(200, {}, "page")], "page", 1), ([(404, {}, "")], None, 1), ([(403, {}, ""), (200, {}, "x")], None, 1), ([(302, {}, "")], None, 1), ([(503, {}, ""), (200, {}, "page")], "page", 2),
        ([(None, {}, ""), (None, {}, ""), (200, {}, "page")], "page", 3), ([(429, {}, "")] * 5, None, 3), ([(500, {}, "")] * 5, None, 3),
    ],
)
def test_http_rules(answers, body, tries):
    asked, slept = [], []
    f = fetch.HttpPages(lambda url: asked.append(url) or answers[len(asked) - 1], slept.append)
    assert f.fetch("@Chan", 7) == body and len(asked) == tries and len(slept) == tries - 1
    assert set(asked) == {"https://t.me/s/chan?before=7"} and f.failures == (0 if body else sum(a[0] in (None, 429, 500) for a in answers[:tries]))


def test_http_waits():
    slept = []
    f = fetch.HttpPages(lambda url: (429, {"Retry-After": "7"}, ""), slept.append, attempts=2)
    f.fetch("c")
    assert 7.5 <= slept[0] <= 9
    f.get = lambda url: (429, {"Retry-After": "soon"}, "")
    f.fetch("c")
    assert 20.5 <= slept[1] <= 22 + 20  # 2 ** failures * 5, with jitter
    f.get, f.failures = (lambda url: (500, {}, "")), 40
    f.fetch("c")
    assert 60.2 <= slept[2] <= 61
    assert [fetch.asked_wait(x, 10) for x in (None, "x", "nan", "-3", "4.5", "99")] == [None, None, None, 0.0, 4.5, 10]


def test_stream_reads_no_page_twice_across_restarts(spark, tmp_path):
    spark.dataSource.register(history.ChannelHistory)
    (tmp_path / "a.ids").write_text(" ".join(map(str, range(1, 19))))
    (tmp_path / "b.ids").write_text("3 5 9")

    def run(poll="false", rounds=1):
        for _ in range(rounds):
            source = spark.readStream.format("channel_history").options(channels="a, @B ,gone", fetcher="tests.history_pages:Files", argument=str(tmp_path), state=f"file://{tmp_path}/cursors", pages=2, poll=poll).load()
            q = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        rows = spark.read.schema(POST).parquet(f"{tmp_path}/out").collect()
        return sorted((r.channel, r.message_id) for r in rows)

    files = Files(tmp_path)
    # each query is a restart; the first round reads two pages of a channel
    assert run() == [("a", i) for i in range(11, 19)] + [("b", 3), ("b", 5), ("b", 9)]
    assert run(rounds=3) == [("a", i) for i in range(1, 19)] + [("b", 3), ("b", 5), ("b", 9)]
    assert [x for x in files.asked() if x[0] == "a"] == [["a", 11], ["a", 15], ["a", 3], ["a", 7], ["a", None]]
    before = len(files.asked())
    run(rounds=2)
    assert len(files.asked()) == before  # the history is read: nothing more is asked
    (tmp_path / "a.ids").write_text(" ".join(map(str, range(1, 31))))
    (tmp_path / "gone.ids").write_text("1")
    everything = [("a", i) for i in range(1, 31)] + [("b", 3), ("b", 5), ("b", 9), ("gone", 1)]
    assert run("true", 2) == everything
    assert run("true") == everything


def plain_walk(ids, known, size, pages, most):
    out, before = [], None
    for k in range(pages):
        left = sorted((i for i in ids if before is None or i < before), reverse=True)[:size]
        if not left:
            break
        new = [i for i in left if i not in known]
        if not new and k > 0:
            break
        out += [(k, i) for i in new][: most - len(out)]
        if len(out) >= most:
            break
        before = left[-1]
    return out


def test_walk_in_one_plan_equals_page_by_page(spark):
    rng = random.Random(8)
    rows, want = [], []
    for c in range(40):
        ids = rng.sample(range(1000), rng.randrange(1, 60))
        known = {i for i in ids if rng.random() < rng.choice([0.1, 0.9, 1.0])}
        rows += [("g", f"c{c}", i, True if i in known else None if i % 2 else False) for i in ids]
        want += [(f"c{c}", k, i) for k, i in plain_walk(ids, known, 5, 6, 12)]
    df = spark.createDataFrame(rows, "group_id string, channel string, message_id long, known boolean")
    assert sorted((r.channel, r.page, r.message_id) for r in walk.walked(df, 5, 6, 12).collect()) == sorted(want)
    assert walk.walked(df.where("FALSE"), 5, 6).count() == 0
