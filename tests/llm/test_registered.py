"""Registered queries without SQL against plain versions by the contracts' words, over a whole table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm import common, docstats, entries, packing, quality


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def personal(text):
    """Base spans by kind: (kind, start, end)."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, rule, ok in rules for m in re.finditer(rule, text) if ok(m[0])]


def test_op5(spark, sf, texts):
    rows = entries.QUERIES["op5_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        base = personal(texts[r.doc_id] or "")
        n = Counter(kind for kind, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(said) <= set(spans)
        found += len(said)
    assert found > 20


def test_op10(spark, sf, texts):
    rows = entries.QUERIES["op10_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times, repeated = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated |= {k, k + 1, k + 2}
        lines, seen, twice = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for x in lines:
            twice += x in seen
            seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert 0 < sum(r.base_failed for r in rows) < len(rows)


def test_op2(spark, sf, texts):
    rows = entries.QUERIES["op2_quality_classifier"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert 0 < sum(r.held_out for r in rows) < len(rows)


def test_op1(spark, sf, texts):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in entries.QUERIES["op1_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = 0
    for cells in places.values():
        end = 0
        for offset, length in sorted(cells):
            assert offset == end
            end += length
        assert end <= 4096
        used += end
    assert used >= 0.9 * 4096 * (len(places) - 8)  # little padding; each task may leave one sequence open


def test_op2_weights_equal_whole_normal_equations(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.train(docs, labels)
    rows = quality.sample_stats(docs, labels, "quality", quality.SAMPLE).toPandas()
    x, y = rows[list(docstats.NAMES)].to_numpy(), rows["y"].to_numpy().astype(float)
    z = quality.fourier(x, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), model.seed)
    penalty = np.diag([quality.RIDGE] * quality.FEATURES + [1e-6])
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty)]), np.append(y, np.zeros(len(penalty))), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)


def test_isotonic_is_the_best_increasing_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        score, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        order = np.argsort(score)
        # by its max-min formula: the largest of the least means of runs that end or begin here
        s = np.append(0, np.cumsum(y[order]))
        want = [max(min((s[b] - s[a]) / (b - a) for b in range(k + 1, n + 1)) for a in range(k + 1)) for k in range(n)]
        knots, values = quality.isotonic(score, y)
        weights = [round(float(v), 12) for v in values]
        assert sorted(set(weights)) == sorted({round(w, 12) for w in want}) and (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()
