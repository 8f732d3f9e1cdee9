"""Follow-up copy: rules on sets equal those on columns, nothing is cut, and the registered query equals a plain version."""

import random

from pyspark.sql import functions as F

from tidewire.functions import followup, similar, text
from tidewire.plans import queries, views

WORDS = [f"{a}{b}{c}" for a in "klm" for b in "aeo" for c in "rst"] + ["the", "and", "price", "$6.06", "6", "25", "0.5", "柴油零售", "中国"]


def test_rules_on_sets_equal_those_on_columns(spark):
    rng = random.Random(2)
    pick = lambda: " ".join(rng.sample(WORDS, rng.randrange(0, 9)))
    near = lambda t: " ".join([w for w in t.split() if rng.random() < 0.7] + rng.sample(WORDS, rng.randrange(0, 4)))
    rows = [(k, a, near(a) if k % 2 else pick()) for k, a in enumerate(pick() for _ in range(600))]
    df = spark.createDataFrame(rows, "id int, a string, b string").withColumns({"fa": text.features("a"), "fb": text.features("b")})
    got = {r.id: (r.same, r.adds) for r in df.select("id", similar.same_event(F.col("fa"), F.col("fb")).alias("same"), similar.adds_content(F.col("fa"), F.col("fb")).alias("adds")).collect()}
    plain = {k: (similar.Sets.of(a).same_event(similar.Sets.of(b)), similar.Sets.of(a).adds_to(similar.Sets.of(b))) for k, a, b in rows}
    assert got == plain and 20 < sum(s for s, _ in plain.values()) < 500


SCHEMA = "title string, summary string, bullets array<string>, recents array<string>, is_update boolean, reason string"


def run(spark, *row):
    df = spark.createDataFrame([row], SCHEMA)
    return followup.sanitized(df, *[F.col(c.split()[0]) for c in SCHEMA.split(", ")]).first()["copy"]


def test_nothing_is_cut(spark):
    bullets = [f"bullet {chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)} harvest" for k in range(1003)]
    out = run(spark, "Title", "", bullets, ["storm closes harbour near lisbon tonight"], False, "")
    assert not out.rewritten and out.bullets == bullets
    clauses = "; ".join(f"filler {chr(97 + k // 26 % 26)}{chr(97 + k % 26)} words" for k in range(1200)) + "; storm closes harbour near lisbon tonight"
    out = run(spark, "T", "", ["fresh orchards bloom early", "storm closes harbour near lisbon tonight"], [clauses], False, "")
    assert out.bullets == ["fresh orchards bloom early"]  # the repeat of a clause after the 1000th is found


def test_query_equals_a_plain_version(spark, sf):
    rows = views.table(spark, sf, "conversations").collect()
    before = {(r.conv_id, r.turn): r.text for r in rows}
    texts = spark.createDataFrame([(r.text,) for r in rows], "t string").distinct()
    clauses = {r.t: r.c for r in texts.select("t", text.clauses(F.col("t")).alias("c")).collect()}
    feats, cut = {}, {}

    def of(t):
        feats[t] = feats.get(t) or similar.Sets.of(t)
        return feats[t]

    def split(t):
        if t not in clauses:
            cut[t] = cut.get(t) or spark.createDataFrame([(t,)], "t string").select(text.clauses(F.col("t"))).first()[0]
        return clauses.get(t, cut.get(t))

    def repeats(t, old):
        whole = of(t)
        return whole.numbers <= of(old).numbers and (whole.same_event(of(old)) or any(of(c).same_event(of(d)) for c in [t, *split(t)] for d in split(old)))

    want = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn))[:400]:
        old = (before.get((r.conv_id, r.turn - 1)) or "").strip(text.BLANKS)
        bullets = [b for b in (x.strip(text.BLANKS) for x in r.text.split("\n")) if b]
        own = [b for b in bullets if not (old and repeats(b, old))]
        want[r.conv_id, r.turn] = (bool(old) and not own and bool(bullets), len(own) if own else len(bullets))
    got = {(r.conv_id, r.turn): (r.skip, r.n_bullets) for r in queries.QUERIES["strf14_followup"](spark, sf).collect()}
    assert {k: got[k][0] for k in want} == {k: v[0] for k, v in want.items()}
