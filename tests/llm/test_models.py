import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import language_id as I
from corvane.llm import pu_quality as Q
from corvane.llm import toxicity as X
from corvane.llm.arrays import plain
from corvane.llm.common import read_table

from .cases import LONG, documents

SF = "/root/testdata/sf0.01"


def test_gram_positions_and_masks_against_sets():
    texts = ["Hello, world", "hi", "", "über alles 123 über"]
    h, doc = I.grams(plain(pa.array([*texts, None])))
    want = []
    for i, t in enumerate(texts):
        import re

        b = f" {re.sub(r'[^a-z\x80-\U0010ffff]+', ' ', t.lower()).strip(' ')} ".encode()
        want += [i] * max(len(b) - I.N + 1, 0)
    assert doc.tolist() == want
    rng = np.random.default_rng(1)
    sets = {"a": rng.integers(0, 2**63, 500).astype(np.uint64), "b": rng.integers(0, 2**63, 900).astype(np.uint64)}
    f = I.filled(sets)
    for j, name in enumerate(f.languages):
        assert ((f.lookup(sets[name])[0] >> np.uint64(j)) & np.uint64(1)).all()  # no false negatives
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    shares = [((f.lookup(other)[0] >> np.uint64(j)) & np.uint64(1)).mean() for j in range(2)]
    assert all(abs(s - w) < 0.02 for s, w in zip(shares, f.wrong))
    counts, total = f.counts(np.concatenate([other, sets["a"]]), np.repeat([0, 1], [20000, 500]), 2)
    assert abs(counts[0]).max() < 300 and abs(counts[1, 0] - 500) < 1 and total.tolist() == [20000, 500]


def _identified_by_sets(docs, per_language):
    """Languages by exact sets of n-grams: what filters without false positives would say."""
    import re
    from collections import Counter

    def grams(t):
        b = f" {re.sub(r'[^a-z\x80-\U0010ffff]+', ' ', (t or '').lower()).strip(' ')} ".encode()
        return [b[i : i + I.N] for i in range(len(b) - I.N + 1)]

    counts = {}
    for r in docs:
        if r.lang is not None and r.text is not None and r.doc_id is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    sets = {k: {g for g, n in c.items() if n > 1} for k, c in counts.items()}
    out = {}
    for r in docs:
        g = grams(r.text)
        share = {k: sum(x in s for x in g) / len(g) for k, s in sorted(sets.items())} if g else {}
        out[r.doc_id] = share
    return out


def test_languages_equal_exact_sets_and_pass_64(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = docs.collect()
    want = _identified_by_sets(rows, 10**6)
    for r in I.identified(docs, I.trained(docs, per_language=10**6)).collect():
        share = want[r.doc_id]
        top = max(share.values(), default=0)
        assert abs(r.share - top) < 0.02 and (r.language == "und" if top == 0 else share[r.language] >= top - 0.02)
    own = [chr(97 + i // 26) * 2 + chr(97 + i % 26) * 2 for i in range(70)]
    many = [(i, " ".join(f"{x}{c}zon {c}{x}lim o{c}t" for x in "pqr") + f" o{c}t", f"l{i:02}", None, 1) for i, c in enumerate(own)]
    many = [(d, t + " " + t, *r) for d, t, *r in many]
    df = documents(spark, many)
    got = {r.doc_id: r.language for r in I.identified(df, I.trained(df)).collect()}
    assert sum(got[i] == f"l{i:02}" for i in range(70)) >= 65


def test_language_of_held_out_documents(spark):
    docs = read_table(spark, SF, "documents")
    filters = I.trained(docs.where("doc_id % 2 = 0"))
    got = I.identified(docs.where("doc_id % 2 = 1 AND n_chars > 60"), filters).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) / len(got) > 0.97


def test_language_of_odd_rows(spark):
    docs = documents(spark, extra=True)
    got = {(r.doc_id, r.language, r.share) for r in I.identified(docs, I.trained(docs)).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (7, "und", 0.0), (None, "und", 0.0)} <= got and any(d == 6 and s > 0.9 for d, _, s in got)
    empty = documents(spark, [])
    assert I.identified(empty, I.trained(empty)).count() == 0 and I.identified(docs, I.trained(empty)).where("language <> 'und'").count() == 0


def test_risk_is_not_negative_and_prior_is_found():
    assert Q.nn_pu_risk(np.full(10, 9.0), np.full(10, 9.0), 0.9) >= 0
    rng = np.random.default_rng(0)
    gp, gu = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(Q.estimated_prior(gp, Q._bins(gu)) - 0.7) < 0.06
    p, u = rng.normal(1, 1, (2000, 3)), np.concatenate([rng.normal(1, 1, (1400, 3)), rng.normal(-1, 1, (600, 3))])
    of = lambda w: Q._sums(Q.sums(u, w), 4)
    w = Q.minimised(p, of, 0.7)
    assert ((p @ w[:3] + w[3]) > 0).mean() > 0.9 and ((u[1400:] @ w[:3] + w[3]) < 0).mean() > 0.8
    # No step in any direction lowers the risk by more than the tolerance: it is the least.
    risk = lambda w: Q.nn_pu_risk(p @ w[:3] + w[3], u @ w[:3] + w[3], 0.7) + Q.RIDGE / len(p) * (w[:3] ** 2).sum() / 2
    for _ in range(300):
        assert risk(w + rng.normal(0, 0.2, 4)) > risk(w) - 1e-4
    # With a prior far too high the unbiased risk has no least value; the negative part stays at 0 or above.
    w = Q.minimised(p, of, 0.99)
    assert np.logaddexp(0, u @ w[:3] + w[3]).mean() - 0.99 * np.logaddexp(0, p @ w[:3] + w[3]).mean() >= 0


def test_quality_equals_training_in_one_place(spark):
    """The whole query against features, sums and decisions made in this process."""
    docs, labels = read_table(spark, "/root/testdata/sf0.001", "documents").repartition(15), read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in rows}
    inked = [r for r in rows if (r.text or "").strip()]
    u = Q.features(plain(pa.array([r.text for r in inked]))).astype(np.float16).astype(np.float32)
    p = Q.features(plain(pa.array([texts[d] for d in sorted(good & set(texts)) if texts[d]])))
    want = Q.fitted(p, lambda of: of(u))
    model = Q.trained(docs, labels)
    assert abs(model.prior - want.prior) < 1e-3 and np.allclose(model.weights, want.weights, atol=1e-2) and abs(model.limit - want.limit) < 1e-2
    exact = dict(zip([r.doc_id for r in inked], want.score(Q.features(plain(pa.array([r.text for r in inked]))))))
    for r in Q.scored(docs, model).collect():
        assert (r.score is None) == (r.doc_id not in exact) and (r.score is None or abs(r.score - exact[r.doc_id]) < 0.05)
        assert r.keep == (r.score is not None and r.score >= model.limit)


def test_quality_of_held_out_labels(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = Q.trained(docs, labels.where("doc_id % 2 = 0"))
    got = Q.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and 1 - sum(bad) / len(bad) > 0.85


def test_quality_of_odd_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, None, None), (None, 1, 1), (8, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = Q.trained(docs, labels)
    got = [(r.doc_id, r.score, r.keep) for r in Q.scored(docs, model).collect()]
    assert len(got) == docs.count() and {(3, None, False), (4, None, False), (7, None, False), (None, None, False)} <= set(got)
    out = Q.kept(docs, model)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {1, 2} and 3 not in {r.doc_id for r in out.collect()}
    empty = documents(spark, [])
    assert Q.trained(empty, labels) is None and Q.scored(empty, None).count() == 0 and Q.kept(docs, None).count() == docs.where("trim(replace(text, chr(10), '')) NOT IN ('', chr(9)) AND doc_id <> 7 OR doc_id IS NULL AND text IS NOT NULL").count()


def _kernel(a, b):
    """The gap-weighted subsequence kernel by brute force, over letters with their edges."""
    def phi(x):
        x, out = f"^{x}$", {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(i + X.SPAN, len(x))):
                    if "-" not in x[i] + x[j] + x[k]:
                        out[x[i] + x[j] + x[k]] = out.get(x[i] + x[j] + x[k], 0) + X.DECAY ** (k - i + 1)
        return out
    pa_, pb = phi(a), phi(b)
    norm = lambda x: X._NORM[len(x.replace("-", "")) + 2]
    return sum(v * pb.get(k, 0) for k, v in pa_.items()) / norm(a) / norm(b)


def test_kernel_equals_brute_force():
    names = ["idiot", "id-iot", "i-d-i-o-t", "idxiot", "trash", "aaa", "banana"]
    u = X.units(plain(pa.array(names)))
    b, c, w = X._sparse(u)
    dense = np.zeros((32**3, len(names)), np.float32)
    np.add.at(dense, (c, b), w)
    got = X.kernel(u, dense)
    want = np.array([[_kernel(a, b) for b in names] for a in names])
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 2 * got[0, 4] and got[0, 2] > got[0, 4]
    v = np.random.default_rng(0).normal(size=len(names))
    assert np.allclose(X.unit_scores(u, (dense @ v) * X._solid()), got @ v, atol=1e-4)  # the folded table


def test_units_join_letters_and_cut_long_ones():
    u = X.units(plain(pa.array(["an i d i o t!", "", None, "x" * 100, "…", "Élan"])))
    names = [n.decode() for n in X._names(u)]
    assert "_IDIOT_" in names and "_AN_" in names and sum(len(n) for n, d in zip(names, u.doc) if d == 3) == 102
    assert not u.judged[[n == "_AN_" for n in names].index(True)]


def _window(text, table):
    """The score of a window by brute force: letters with an edge before and after, spans in characters, all subsequences different."""
    seen = [(int(X._LETTER[ord(c)]), i) for i, c in enumerate(text) if c.isalpha()]
    x = [(X._EDGE, seen[0][1] - 1), *seen, (X._EDGE, seen[-1][1] + 1)]
    value = norm = 0.0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, min(i + X.SPAN, len(x))):
                w = X.DECAY ** (x[k][1] - x[i][1] + 1)
                value += w * table[x[i][0] << 10 | x[j][0] << 5 | x[k][0]]
                norm += w * w
    return value / np.sqrt(norm)


def test_windows_slide_over_sentences_and_equal_brute_force():
    table = np.random.default_rng(0).normal(size=32**3) * X._solid()
    got = {}
    for t in ("an id iot. So mo ron", "i  d  i  o  t", "i - d - i - o - t", "st***upid"):
        words, x = [w for w in t.split(" ") if any(c.isalpha() for c in w)], X.letters(plain(pa.array([t])))
        at = np.cumsum([0, *(len(w) + 1 for w in t.split(" "))])[[i for i, w in enumerate(t.split(" ")) if any(c.isalpha() for c in w)]]
        for first, last, score in X.window_scores(x, table):
            for a, b, v in zip(first, last, score):
                text = t[at[a] : at[b] + len(words[b])]
                got[text] = v
                assert abs(_window(text, table) - v) < 1e-9
    assert {"id iot.", "mo ron", "i  d  i  o  t", "i - d - i - o - t", "st***upid"} <= set(got) and "iot. So" not in got and "So" not in got
    accents = X.letters(plain(pa.array(["é\u200bt"])))
    assert accents.place.tolist() == [1, 1, 3]  # the accent has its letter's place, an invisible character is a gap
    low, high = np.array([0]), np.array([30])
    rough, exact = X._norms_of(X.letters(plain(pa.array(["is " * 15]))), low, high)
    assert exact[0] > 2 * rough[0]  # repeats add up


def test_toxicity_of_gapped_insults(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    model = X.trained(docs, labels.where("doc_id % 3 <> 0"))
    insults = ["disgusting", "worthless", "idiot", "trash", "stupid", "moron", "pathetic"]
    said = [f"and so the {gap.join(w)} went there" for gap in ("  ", " - ", "***") for w in insults]
    rows = [(i, t, None, None, 1) for i, t in enumerate([*said, "an id  iot", "and so the people went there"])]
    flags = {r.doc_id: r.toxic for r in X.scored(spark.createDataFrame(rows, documents(spark).schema), model).collect()}
    assert sum(flags[i] for i in range(len(said))) >= 0.9 * len(said) and not flags[len(rows) - 1]
    assert X.scored(spark.createDataFrame([(1, "i  d  i  o  t", None, None, 1)], documents(spark).schema), model).first().score is not None


def test_toxicity_of_held_out_labels_and_obfuscation(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    model = X.trained(docs, labels.where("doc_id % 3 <> 0"))
    got = X.scored(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    bad, fine = [r.toxic for r in got if r.y == 1], [r.toxic for r in got if r.y == 0]
    assert sum(bad) / len(bad) > 0.8 and sum(fine) / len(fine) < 0.04
    said = spark.createDataFrame([(1, "you st-upid thing", None, None, 1), (2, "what m o r o n they are", None, None, 1), (3, "the and of erti there", None, None, 1), (4, "Worthless.", None, None, 1)], documents(spark).schema)
    flags = {r.doc_id: r.score for r in X.scored(said, model).collect()}
    assert flags[4] > 0 and flags[2] > 0 and flags[1] > flags[3] and flags[3] < 0


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, None, None), (None, 1, 1), (8, 1, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    for model in (X.trained(docs, labels), None):
        got = {(r.doc_id, r.score, r.toxic) for r in X.scored(docs, model).collect()}
        assert {(3, None, False), (4, None, False), (7, None, False), (None, None, False)} <= got and X.scored(docs, model).count() == docs.count()
    assert X.trained(documents(spark, []), labels) is None and X.scored(documents(spark, []), None).count() == 0
    assert X.trained(docs, labels.where("toxic = 0")) is None
