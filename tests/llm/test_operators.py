"""Brute-force versions, exact round trips and held-out accuracy."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import common, decontam, docstats, langid, linededup, neardup, packing, quality, rules, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# packing


def test_packing_round_trip(spark, sf, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    docs = {}
    bins = {}
    for r in packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), packing.default_tokenizer()).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs.setdefault(r.doc_id, []).append((r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in docs.items():
        want = np.array(tok.encode(texts[k], add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        assert b"".join(x for _, x in sorted(pieces)) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(len(x) for v in docs.values() for _, x in v) / 4 / (4096 * len(bins)) > 0.95


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ é'sÉß1.!<|>\n\t​漢🚨´", max_size=30), max_size=5))
def test_cached_tokens_equal_the_tokenizer(some):
    enc = packing.encoder(packing.default_tokenizer())
    for t, got in zip(some, enc.encode(some), strict=True):
        assert got == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_special_token_strings():
    enc = packing.encoder(packing.default_tokenizer())
    t = "a <|endoftext|> B"
    assert enc.encode([t])[0] == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 150), st.integers(0, 150)), max_size=40), st.integers(1, 5), st.integers(1, 60))
def test_packer_keeps_every_limit(sizes, segments, loss):
    limits = packing.Limits(tokens=64, segments=segments, loss_tokens=loss, pool=300, choice=50)
    p, out, items = packing.Packer(limits), [], {}
    for k, (n, prompt) in enumerate(sizes):
        items[k] = np.arange(min(prompt, n), n)
        p.add(k, n, items[k])
        if p.full():
            out += list(p.fill(False))
    out += list(p.fill(True))
    seen = Counter()
    for b in out:
        assert len(b) <= segments and sum(x[2] for x in b) <= 64
        assert sum(int(((items[k] >= s) & (items[k] < s + n)).sum()) for k, s, n in b) <= loss
        for k, s, n in b:
            seen.update((k, i) for i in range(s, s + n))
    assert set(seen.values()) <= {1} and len(seen) == sum(n for n, _ in sizes)


# near duplicates


def sets_of(texts, size=5):
    out = {}
    for k, t in texts.items():
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def groups_of(texts, percent):
    sets, low = sets_of(texts), {k: k for k in texts}
    ids = sorted(texts)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return low


def test_near_duplicates_of_chained_copies(spark):
    """Copies of copies, each near the one before it, and a hot group of near copies of one text."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, k = {}, 0
    for size, n, edits in ((200, 60, 1), (120, 150, 2), (40, 10, 1)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(size)] = word()
            texts[k] = " ".join(own)
            k += 1
            if rng.random() < 0.3:
                base = own
    for percent in (80, 85):
        docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent).collect()}
        assert got == groups_of(texts, percent)


def test_blocks_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    texts = {}
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(80)] = f"x{rng.random()}"
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 85).collect()} == groups_of(texts, 85)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[500:])
    s = neardup.Sketch(registers=1024)
    ra, rb, ru = neardup.sketches([a, b, np.unique(np.concatenate([a, b]))], s)
    assert (neardup.merge(ra, rb) == ru).all()
    one = lambda v: np.array([v])
    j = neardup.estimate(one((ra == rb).sum()), one((ra > rb).sum()), one((ra < rb).sum()), one(2000.0), one(2500.0), s.base)[0]
    assert abs(j - 1500 / 3000) < 0.06


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(3, 3), (None, 2)]
    low = {}
    for a, b in links:
        if a is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == low


# line dedup


def plain_line_dedup(texts, least=50):
    lines = {k: t.split("\n") for k, t in texts.items()}
    first, hits = {}, []
    for kind in (0, 1):
        for k in sorted(lines):
            idx = [i for i, x in enumerate(lines[k]) if WORDS.search(x)]
            for p, i in enumerate(idx):
                run, n, q = [], 0, p
                while n < least and 0 <= q < len(idx):
                    run.append(idx[q])
                    n += len(WORDS.findall(lines[k][idx[q]]))
                    q += 1 if kind == 0 else -1
                if n < least:
                    continue
                run = sorted(run)
                key = (kind, tuple(lines[k][j] for j in run))
                at = (k, run[0], run[-1])
                first[key] = min(first.get(key, at), at)
                hits.append((key, at))
    gone = {k: set() for k in lines}
    for key, (k, a, b) in hits:
        if k > first[key][0] or a > first[key][2]:
            gone[k].update(range(a, b + 1))
    return {k: "\n".join(x for i, x in enumerate(v) if i not in gone[k]) for k, v in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_plain(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([3, 12, 30, 55]))) for _ in range(14)] + ["", "  "]
    texts = {k: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in linededup.remove_repeated_lines(docs).collect()}
    assert got == plain_line_dedup(texts)


# decontamination


def test_template_catches_reparameterised_items_only_if_slots_agree(spark):
    item = "If John buys 12 apples and gives 5 apples to Mary then how many apples does John keep after paying 12 dollars for lunch"
    same = item.replace("12", "90").replace("5", "7").replace("John", "Peter").replace("Mary", "Anna")
    broken = item.replace("12", "90", 1).replace("John", "Peter", 1)
    docs = spark.createDataFrame([(1, f"intro words here. {item}. outro"), (2, same), (3, broken), (4, "nothing of that kind at all in here, not one bit of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.coverage for r in decontam.flagged(docs, bench).collect()}
    assert {1, 2} <= set(got) and got[2] == 1 and 4 not in got and got.get(3, 0) < 1


class PlainTemplates:
    """Items found in texts, by lists of tokens and a search of every window; its own word classes."""

    NUMBER = r"[+-]?[$€£]?[0-9][0-9.,/:]*"
    EDGE = set("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~…«»“”„‘’–—¿¡")

    def tokens(self, text, inside=False):
        out, start = [], not inside
        for w in (text or "").split():
            tail = w
            while tail and tail[-1] in "'\")]»”’*_":
                tail = tail[:-1]
            core = w
            while core and core[0] in self.EDGE:
                core = core[1:]
            while core and core[-1] in self.EDGE:
                core = core[:-1]
            if any(c.isalnum() for c in core) or core in decontam.UNITS:
                out.append(self.kind(core, start) + (core.lower(), w.strip(".,;:!?")))
            start = tail != "" and tail[-1] in ".!?:…"
        return out

    def kind(self, core, start):
        low = core.lower()
        if low in decontam.UNITS:
            return "<unit>", True
        if core.isalpha() and core[0].isupper() and not core.isupper() and not start:
            return "<name>", True
        if re.fullmatch(self.NUMBER, core):
            return "<number>", True
        m = re.fullmatch(self.NUMBER + r"(.+)", core)
        unit = re.sub("^" + self.NUMBER, "", core)
        if m and (unit.lower() in decontam.UNITS or unit == "°") and (unit.isalpha() or unit in "%$€£°"):
            return "<number><unit>", True
        return low, False

    def good(self, w):
        return sum(not x[1] for x in w) >= min(4, (len(w) + 1) // 2)

    def found(self, doc, item):
        """Largest coverage of the item in the document."""
        d, best = self.tokens(doc), 0.0
        i, inner = self.tokens(item), self.tokens(item, True)
        n = min(8, len(i))
        if not n:
            return 0.0
        starts = range(len(i) - n + 1)
        goods = [p for p in starts if self.good(i[p : p + n])]
        hits = []  # shift, pos, pairs of values
        for p in goods:
            for form in ([i, inner] if p == 0 and self.good(inner[:n]) else [i]):
                for q in range(len(d) - n + 1):
                    if [x[0] for x in form[p : p + n]] == [x[0] for x in d[q : q + n]]:
                        hits.append((q - p, p, {(x[0] + x[3], y[0] + y[3]) for x, y in zip(form[p : p + n], d[q : q + n], strict=True) if x[1]}))
        covered = set()
        for shift, p, pairs in hits:
            values = {}
            for s, _, other in hits:
                if s == shift:
                    for a, b in other:
                        values.setdefault(a, set()).add(b)
            if all(len(values[a]) == 1 for a, _ in pairs):
                covered.add(p)
        if goods:
            best = len(covered) / len(goods)
        if len(goods) == len(starts) == 1 or not goods:
            have = {tuple(x[2] for x in d[q : q + n]) for q in range(len(d) - n + 1)}
            best = max(best, sum(tuple(x[2] for x in i[p : p + n]) in have for p in starts) / len(starts))
        return best


def test_every_item_with_a_token_is_found_where_it_is_copied(spark):
    items = ["Paris is nice", "Compute 17 * 23 + 99 / 3 - 4 ^ 2", "Solve 3 4 5 6 7 8 9 10 11 12", "What is 12 plus 34 times 5 minus 678 ?", "What is the capital of France?", "Anna Bob Carl Dora Emil Fritz Gina Hans Ida", "xyzzy", "1 2 3"]
    docs = [(100 + k, f"a heading line\n{t}\nand more of it, quite another thing") for k, t in enumerate(items)] + [(1, "nothing of this kind here"), (2, "")]
    got = decontam.flagged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in got} == {100 + k: [k] for k in range(len(items))}


def test_decontamination_equals_plain_on_made_items(spark):
    rng, plain = random.Random(11), PlainTemplates()
    pool = ["If", "the", "train", "from", "Rome", "Paris", "John", "Anna", "goes", "12", "7.5", "30", "km", "5kg", "hours", "and", "buys", "apples", "for", "$3", "then", "how", "many", "stay?", "end.", "Ends.", "—", "it", "costs", "20%", "more:", "so", "far"]
    items = [" ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 7, 8, 9, 14, 25]))) for _ in range(25)] + ["Please answer this common question now with care: " + " ".join(rng.choice(pool) for _ in range(9)) for _ in range(6)]
    swap = {"John": "Peter", "Anna": "Mary", "12": "40", "Rome": "Oslo", "30": "31"}
    docs = []
    for _ in range(60):
        t = rng.choice(items).split()
        if rng.random() < 0.5:
            t = [swap.get(w, w) for w in t]
        if rng.random() < 0.4:
            t[rng.randrange(len(t))] = rng.choice(pool)
        docs.append(" ".join([*(rng.choice(pool) for _ in range(rng.randrange(6))), *t, *(rng.choice(pool) for _ in range(rng.randrange(6)))]))
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if plain.found(t, x) >= 0.5}
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40


def test_decontamination_query_equals_plain(spark, sf, texts):
    bench, plain = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}, PlainTemplates()
    words = {k: {x[2] for x in plain.tokens(t)} for k, t in bench.items()}
    got = {r.doc_id: r for r in decontam.op4_benchmark_decontamination(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        have = {x[2] for x in plain.tokens(t)}
        want = sorted(k for k in bench if len(words[k] & have) >= 0.4 * len(words[k]) and plain.found(t, bench[k]) >= 0.5)
        assert (got[d]["items"] or []) == want and got[d].kept == (not want)
    assert not all(r.kept for r in got.values())


# classifiers


def test_statistics_equal_plain(texts):
    for t in list(texts.values())[:60] + ["", " \n", "a a a a", "a b c a b c x"]:
        (n, chars, symbols, dups, repeats), _ = docstats.measure(t)
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (n, chars, symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert dups == len(lines) - len(set(lines)) and repeats == len(again)


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(out["score"].to_numpy(), out["quality"].to_numpy()) > 0.95
    assert (out["predicted"] == (out["score"] >= 0.3)).all() and out["score"].between(0, 1).all()


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(1500, 3))
    y = (rng.uniform(size=1500) < 1 / (1 + np.exp(6 * x[:, 0] - 3 + 2 * np.sin(9 * x[:, 1])))).astype(float)
    trees = rules.fit(x, y, np.array([-1, 0, 0]), trees=30)
    grid = np.tile(rng.uniform(size=(40, 1, 3)), (1, 25, 1))
    grid[:, :, 0] = np.linspace(0, 1, 25)
    assert (np.diff(trees.raw(grid.reshape(-1, 3)).reshape(40, 25), axis=1) <= 1e-12).all()
    assert auc(trees.predict(x), y) > 0.8

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node]
        return trees.value[node]

    assert np.allclose(trees.raw(x[:20]), [trees.base + sum(walk(r, n) for n in trees.roots) for r in x[:20]])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0")
    out = toxicity.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert out[out.label == 1].toxic.mean() > 0.7 and out[out.label == 0].toxic.mean() < 0.02


def test_toxicity_held_out_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    held = docs.join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    out = toxicity.score(held, model).join(held.select("doc_id", "lang", "label"), "doc_id").toPandas()
    recall = out[out.label == 1].groupby("lang").toxic.mean().to_dict()
    print(recall, "false alarms", out[out.label == 0].groupby("lang").toxic.mean().to_dict())
    assert set(recall) == {"en", "de", "fr", "es"} and min(recall.values()) > 0.7
    assert out[out.label == 0].groupby("lang").toxic.mean().max() < 0.02


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, np.where(rng.uniform(size=800) < 0.9, first, 1 - first)], axis=1)
    chain = toxicity.Chain.fit(x, y, np.arange(800) % 5)
    assert chain.weights[1].shape[0] == chain.weights[0].shape[0] + 1 and chain.weights[1][2] > 0
    assert ((chain.predict(x)[:, 1] > 0.5) == y[:, 1]).mean() > 0.85


def test_chain_predictions_of_a_fold_come_from_the_others():
    """Against a plain version: features of a fold's models, and the models, are those of the other folds."""
    rng = np.random.default_rng(8)
    x, fold = rng.normal(size=(300, 4)), np.arange(300) % 3
    y = np.stack([x[:, 0] > 0, x[:, 0] + x[:, 2] > 0.3], axis=1).astype(float)
    use, fold_use, last = np.array([0, 1, 2]), {0: np.array([0, 2]), 1: np.array([1, 2]), 2: np.array([0, 3])}, rng.normal(size=(300, 1))
    chain = toxicity.Chain.fit(x, y, fold, use, fold_use, last)
    first = np.zeros(300)
    for k in range(3):
        z = x[:, fold_use[k]]
        first[fold == k] = toxicity.probability(z[fold == k], toxicity.fit_logistic(z[fold != k], y[fold != k, 0]))
    assert np.allclose(chain.held[:, 0], first)
    want = toxicity.fit_logistic(np.hstack([x[:, use], first[:, None], last]), y[:, 1])
    assert np.allclose(chain.weights[1], want) and len(chain.weights[0]) == 4
    p0 = toxicity.probability(x[:, use], chain.weights[0])
    assert np.allclose(chain.predict(x[:, use], last)[:, 1], toxicity.probability(np.hstack([x[:, use], last, p0[:, None]])[:, [0, 1, 2, 4, 3]], want))


def test_toxicity_query_equals_a_plain_count(spark, sf, texts):
    """Scores of the query from the model's own words, counted plainly."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        words = [re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w).lower() for w in t.split()]
        forms = [{w, *(w[:k] + "*" for k in (5, 6, 7) if len(w) >= k)} for w in words if w]
        n = [sum(v in f for f in forms) for v in model.vocabulary]
        strong = {v for v, p in zip(model.vocabulary, model.pointing[:, 0], strict=True) if p}
        p = model.chain.predict(np.log1p([n]), np.log1p([[sum(bool(f & strong) for f in forms)]]))[0] if model.chain else np.zeros(3)
        assert np.allclose([got[d].p_insulting, got[d].p_abusive, got[d].p_toxic], p) and got[d].kept == (p[-1] < model.threshold)


# languages


def plain_phrases(train, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab ", max_size=40), min_size=1, max_size=3), st.lists(st.text("abcé ", max_size=90), max_size=4), st.sampled_from([1, 4, 7, 256]))
def test_phrases_are_longest_matches_over_whole_texts(trains, some, lane):
    trains, some, old = [t.encode() for t in trains], [t.encode() for t in some], langid.LANE
    langid.LANE = lane
    try:
        got = langid.Parser(trains).counts(some)
    finally:
        langid.LANE = old
    assert got.tolist() == [[plain_phrases(t, x) for t in trains] for x in some]


def test_language_query_equals_a_plain_parse(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2"))
    got = {r.doc_id: r for r in langid.op9_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    for r in rows[:12]:
        clean = " " + " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in r.text.lower()).split()) + " "
        cost = {k: plain_phrases(t, clean.encode()) * np.log2(len(t) + 2) for k, t in model.texts.items()}
        assert got[r.doc_id].lang_pred == min(cost, key=cost.get)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


# archives


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abc", max_size=4)), max_size=9))
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter(sorted(r)) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_parse_back():
    for payload in (b"", b"x\r\n\r\ny", "é".encode() * 9):
        fields, got = warc.parse(warc.record(3, "http://a/é", payload, None))
        assert got == payload and fields["warc-payload-digest"] == "sha1:" + warc.digest(payload) and fields["x-page-id"] == "3"
        fields, got = warc.parse(warc.record(3, None, payload, 9))
        assert got == b"" and fields["warc-type"] == "revisit" and fields["x-refers-to-page"] == "9"


@pytest.mark.parametrize(("url", "key"), [("http://www.A.b.org:80/x/?b=2&a=1#f", "org,b,a)/x?a=1&b=2"), ("https://a.b:8443", "b,a:8443)/"), (None, ""), ("x y", "x%20y")])
def test_surt(url, key):
    assert warc.surt(url) == key


# pipeline


def test_pipeline_stages_equal_plain_versions(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) <= set(texts) and len(kept["toxicity"]) > 0.85 * len(texts)
    assert kept["line_dedup"] == plain_line_dedup(kept["toxicity"])
    low = groups_of(kept["line_dedup"], 80)
    assert set(kept["minhash_near_dedup"]) == {k for k in low if low[k] == k}
    bench = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    holds = {k for k, t in kept["minhash_near_dedup"].items() if any(b in " ".join(t.split()) for b in bench.values())}
    assert not holds & set(kept["benchmark_decontamination"])
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(kept["benchmark_decontamination"]) and all(r.n == r.t for r in packed)


def test_joins_of_hot_keys_equal_plain_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    rng = random.Random(4)
    left = common.materialize(spark.createDataFrame([(k, 0 if rng.random() < 0.4 else rng.randrange(60), k % 3) for k in range(6000)], "x long, k long, join_salt long"), "left")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 2)], "k long, v string")
    want = sorted(left.join(right, "k").select("x", "k", "v").collect())
    assert sorted(common.salted_join(left, right, ["k"]).select("x", "k", "v").collect()) == want
    counted = right.join(left.groupBy("k").count(), "k")
    assert sorted(common.spread_join(left, counted, ["k"], "count").select("x", "k", "v").collect()) == want
    assert common.spread_join(left, counted, ["k"], "count", "left_semi").count() == len(want)
