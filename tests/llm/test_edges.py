"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import common, decontam, langid, linededup, neardup, packing, pii, quality, rules, toxicity, warc
import corpus_pipeline

LONG = " ".join(f"word{k % 977}" for k in range(40_000))
P = " ".join(f"passage{k}" for k in range(60))
ROWS = [
    (1, "Plain text with a few words in it.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, LONG, "en"), (5, LONG, "en"), (6, LONG + " tail", None), (None, "no id here", "fr"), (None, None, None),
    (7, f"a\n{P}\nb", "en"), (8, f"c\n{P}", "en"), (9, f"{P}\n{P}\nd", "en"), (10, "mail a@b.co 4111 1111 1111 1111 🚨", "es"), (10, "other text under the same id", "es"), (-3, "🚨🚨 é́ ﬁ", "xx"), (11, "!!! ###", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("copy", "node", "component", "component_id", "signature", "registers", "bucket", "n_shingles", "runs", "line", "words", "score", "kept", "toxic", "run_doc_id", "sequence_id", "item_id", "hash", "n_chars", "_bad_id", "_gone_id"):
        d = d.withColumn(c, F.lit(7))
    return d.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (11, 0, 1), (None, 1, 1), (5, None, None), (1, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, P), (2, None), (3, ""), (None, P), (1, P), (4, "two words")], "item_id long, text string")


def empty(df):
    return df.where("FALSE")


N = len(ROWS)


def test_packing(docs):
    out = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sum(r.length for r in out if r.doc_id == 5) == 2 * next(r.doc_tokens for r in out if r.doc_id == 5)
    assert sum(1 for r in out if r.doc_id in (2, 3, 4) and r.length == 1) == 3
    assert packing.pack(empty(docs), packing.default_tokenizer()).count() == 0
    sizes = docs.sparkSession.createDataFrame([(1, 10, 5), (2, None, None), (3, 5000, 1), (4, 4096, 0)], "id long, tokens long, loss_tokens long")
    placed = {r.id: r.sequence_id for r in packing.pack_examples(sizes).collect()}
    assert placed[3] is None and None not in (placed[1], placed[2], placed[4])


def test_quality(spark, docs, labels):
    for lab in (labels, empty(labels)):
        model, trees = quality.train(docs, lab), rules.train(docs, lab)
        scored, judged = quality.score(docs, model).collect(), rules.apply_rules(docs, trees).collect()
        assert len(scored) == len(judged) == N and all(0 <= r.score <= 1 for r in scored)
        blank = quality.score(spark.createDataFrame([(0, "")], "doc_id long, text string"), model).first().score
        assert {r.score for r in scored if r.doc_id in (2, 3, 4)} == {blank} and sum(r.doc_id is None for r in scored) == 2
        assert len({r.score for r in scored if r.doc_id == 5}) == 1  # repeated rows
        counted = {(r.doc_id, r.n_words): r for r in judged}
        assert counted[5, 40_000].word_chars == len(LONG.replace(" ", "")) and counted[5, 40_000].n_repeat_words == 40_000  # its words come again every 977
        assert all(counted[k, 0].base_failed and not counted[k, 0].kept for k in (2, 3, 4)) and counted[11, 2].n_symbols == 3
        assert counted[9, 121].n_dup_lines == 1 and counted[9, 121].n_repeat_words == 120 and counted[9, 121].base_failed
        assert sum(r.doc_id is None for r in judged) == 2
    assert quality.score(empty(docs), quality.train(empty(docs), labels)).count() == 0
    assert rules.apply_rules(empty(docs), rules.train(empty(docs), labels)).count() == 0
    assert {r.kept for r in rules.apply_rules(docs.where("doc_id IN (2, 3, 4)"), None).collect()} == {False}


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 50} of one id") for k in range(80)] + [(2, "another one")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.sample_stats(docs, labels, "quality", 2).count() == 2
    assert quality.sample_stats(docs, labels, "quality", 1000).count() == 51
    assert toxicity.labelled(docs, labels, 2).count() == 2 and toxicity.labelled(docs, labels, 1000).count() == 51


def test_near_duplicates(docs):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == N
    group = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert {group[k] for k in group if k[0] in (5, 6)} == {5}
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.kept for r in out if r.doc_id in (2, 3, 4))
    assert neardup.near_duplicates(empty(docs)).count() == 0
    # rows of one doc_id with different texts are apart: what links one of them links nothing to the other
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    same_id = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (0, " ".join([*b[:-1], "y"])), (1, " ".join(a)), (3, " ".join(["z", *b[1:]]))]
    got = neardup.near_duplicates(docs.sparkSession.createDataFrame(same_id, "doc_id long, text string"), 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 1), (3, 0)]
    assert neardup.without_near_duplicates(docs).columns == docs.columns


def test_decontamination(docs, benchmark):
    out = decontam.flagged(docs, benchmark).collect()
    assert sorted(r.doc_id for r in out) == [7, 8, 9] and all(r["items"] == [1] for r in out)
    assert decontam.without_benchmark(docs, benchmark).count() == N - 3
    assert decontam.flagged(docs, empty(benchmark)).count() == 0 and decontam.flagged(empty(docs), benchmark).count() == 0


def test_pii(docs):
    out = {(r.doc_id, len(r.spans)) for r in pii.detect(docs).collect()}
    assert (10, 2) in out and (2, 0) in out and pii.detect(empty(docs)).count() == 0


def test_toxicity(spark, docs, labels):
    for lab in (labels, empty(labels)):
        model = toxicity.train(docs, lab)
        out = toxicity.score(docs, model).collect()
        assert len(out) == N and sum(r.doc_id is None for r in out) == 2
        blank = toxicity.score(spark.createDataFrame([(0, None)], "doc_id long, text string"), model).first()
        assert {r.p_toxic for r in out if r.doc_id in (2, 3, 4)} == {blank.p_toxic} and len({r.p_toxic for r in out if r.doc_id == 5}) == 1
        assert all(r.toxic == (r.p_toxic >= model.threshold) for r in out)
    assert {r.p_toxic for r in out} == {0.0}  # without labels nothing is learned
    tied = toxicity.Model([], np.zeros((0, 1), bool), toxicity.Chain([np.zeros(1), np.zeros(2), np.zeros(4)]))
    assert {(r.p_toxic, r.toxic) for r in toxicity.score(docs, tied).collect()} == {(0.5, True)}  # at the threshold
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(empty(docs), toxicity.train(empty(docs), labels)).count() == 0


def test_line_dedup(docs):
    out = linededup.remove_repeated_lines(docs)
    assert out.columns == docs.columns + ["n_removed_lines"]
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(out.collect()) == N
    assert rows[7, f"a\n{P}\nb"].n_removed_lines == 0 and rows[8, "c"].n_removed_lines == 1 and rows[9, "d"].n_removed_lines == 2
    assert rows[8, "c"].n_chars == 1 and rows[7, f"a\n{P}\nb"].n_chars == 7
    assert linededup.remove_repeated_lines(empty(docs)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a.b/c?y=1&x=2#f", "same"), (2, None, "same"), (3, "bad\r\nurl", None), (4, "http://[", ""), (None, "http://a.b/", "same"), (5, "https://www.a.b:443/c/", "é" * 70_000), (5, "x", "same"), (6, "x", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("r_page", F.lit(1)).withColumn("refers_to", F.lit(1))
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, root, archive_bytes=200, run_captures=2)
    got = warc.read_archives(manifest, root).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 6), (2, 6), (5, 6), (3, 4)}
    for fan_in in (2, 100):
        made = common.materialize(warc.capture_index(manifest, root, range_captures=2, fan_in=fan_in), "index")
        index = sorted(warc.placed(made).collect(), key=lambda r: r.position)
        keys = [(r.part, r.urlkey, r.timestamp) for r in index]
        assert len(index) == len(rows) and keys == sorted(keys) and [k[1:] for k in keys] == sorted(k[1:] for k in keys) and [r.position for r in index] == list(range(len(rows)))
    records = common.materialize(warc.read_archives(manifest, root), "records")
    back = {(r.page_id, r.payload_digest, r.refers_to): r for r in warc.checked(warc.placed(made), records).collect()}
    sha = lambda x: warc.digest((x or "").encode())
    assert set(back) == {(1, sha("same"), 6), (2, sha("same"), 6), (3, sha(""), 4), (4, sha(""), None), (None, sha("same"), None), (5, sha("é" * 70_000), None), (5, sha("same"), 6), (6, sha("same"), None)}
    assert back[1, sha("same"), 6].payload_bytes == 4
    broken = {
        "is not in the archives": (made, records.where("page_id <> 6")), "is not in the index": (made.where("page_id <> 5"), records), "is not intact": (made, records.withColumn("intact", F.expr("page_id <> 6"))),
        "refers to a response": (made, records.withColumn("named_digest", F.lit("x"))),
    }
    for why, (left, right) in broken.items():
        with pytest.raises(Exception, match=why):
            warc.checked(warc.placed(left), right).collect()
    none = warc.write_archives(pages.where("FALSE"), f"file://{tmp_path}/e")
    assert warc.read_archives(none, root).count() == 0 and warc.capture_index(none, root).count() == 0
    assert warc.write_archives(pages, f"file://{tmp_path}/m", least_bytes=5).where("kind = 'archive'").count() > 0


def test_runs_are_dealt_within_fan_in(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.b/{k % 11}", "x" * (k % 3)) for k in range(90)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/r"
    manifest = warc.write_archives(pages, root, run_captures=1)
    made = common.materialize(warc.capture_index(manifest, root, fan_in=8), "index")
    assert warc.compact(manifest, root, 8).select("path").distinct().count() <= 8
    want = sorted((warc.surt(f"http://h{k % 7}.b/{k % 11}"), k) for k in range(90))
    assert [(r.urlkey, r.page_id) for r in sorted(warc.placed(made).collect(), key=lambda r: r.position)] == sorted(want)


def test_language(spark, docs):
    out = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (11, "und")} <= out
    assert len(langid.predict(docs, langid.train(docs)).collect()) == N
    assert {r.lang_pred for r in langid.predict(docs, langid.train(empty(docs))).collect()} == {"und"}
    assert langid.predict(empty(docs), langid.train(docs)).count() == 0
    same = langid.Model({"b": b" one text ", "a": b" one text "})
    assert same.predict(["one text", "²½ Ⅷ ①", "ª", "漢字 e\u0301"])[:2] == [("b", 0.5), ("und", 0.0)]
    tied = langid.train(spark.createDataFrame([(1, "one text", "b"), (1, "one text", "a")], "doc_id long, text string, lang string"))
    assert tied.predict(["one text"]) == [("a", 0.5)]


def test_rare_languages_are_learned(spark):
    rows = [(k, f"common words of text {k % 7}", "en") for k in range(300)] + [(1000 + k, "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(30)), f"l{k:03}") for k in range(250)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.texts) == 251 and sum(map(len, model.texts.values())) <= langid.TOTAL


def test_pipeline_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("FALSE"), sf).count() == 0


def test_words_learned_by_one_task_serve_the_next(monkeypatch):
    """600,000 words are kept, as many as a task or two learn; what comes again isn't encoded again."""
    enc, learned = packing.WordTokens(packing.default_tokenizer()), []
    slow = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.append(len(new)), slow(new)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d + e for e in "xy" for a in letters for b in letters for c in letters for d in letters][:600_000]
    first = enc.encode([" ".join(words[:1000])])
    for k in range(0, len(words), 30_000):
        enc.encode([" ".join(words[k : k + 30_000])])
    assert sum(learned) == len(words)
    assert enc.encode([" ".join(words[:1000])]) == first and sum(learned) == len(words)
