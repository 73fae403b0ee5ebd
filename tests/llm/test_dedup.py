import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import dart_minhash as D
from corvane.llm import exact_dedup as E
from corvane.llm import line_dedup as L
from corvane.llm.arrays import plain, words

from .cases import BASE, documents, rows_of, sql_rows


@pytest.mark.parametrize("partitions, fan_in", [(3, 4), (5, 2), (20, 4)])
def test_exact_duplicates_equal_sql(spark, partitions, fan_in):
    rng = random.Random(1)
    docs = documents(spark).union(spark.createDataFrame([(100 + i, f"text {rng.randint(0, 60)}", "en", "s", 1) for i in range(300)], documents(spark).schema)).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows_of(E.exact_duplicates(docs, fan_in))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 5)
    assert got == sql_rows(E.SQL["op8_exact_dedup"], documents=docs)
    assert len(got) > 200


def test_exact_duplicates_of_nothing_and_with_extra_columns(spark):
    assert E.exact_duplicates(documents(spark, [])).count() == 0
    assert rows_of(E.exact_duplicates(documents(spark, extra=True))) == rows_of(E.exact_duplicates(documents(spark)))
    assert (2, 1) in {(r.doc_id, r.keep_id) for r in E.exact_duplicates(documents(spark)).collect()}


def test_runs_travel_in_small_cells_too(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 4)
    rng = np.random.default_rng(0)
    runs = []
    for _ in range(3):
        r = np.zeros(40, E.RECORD)
        r["key"], r["keep"], r["n"] = np.sort(rng.integers(0, 60, 40)), rng.integers(0, 1000, 40), 1
        runs.append(E.merged([r]))
    cells = sorted((r[i : i + 4] for r in runs for i in range(0, len(r), 4)), key=lambda c: c["key"][0])
    parts = list(E._streamed(iter(cells)))
    whole = np.concatenate(parts)
    assert len(parts) > 3 and (np.diff(whole["key"].astype(np.int64)) > 0).all() and (whole == E.merged(runs)).all()
    sent = [b for b in E._exchanged(iter(parts), 2, 1, 2, 3)]
    assert all(len(b.column(2)[0].as_py()) <= 8 * E.RECORD.itemsize for b in sent) and {b.column(0)[0].as_py() for b in sent} <= {0, 2}


def test_merge_keeps_the_smallest_verified_identifier():
    run = np.zeros(5, E.RECORD)
    run["key"], run["sha"], run["keep"], run["n"] = [7, 7, 7, 1, 7], [b"a", b"b", b"a", b"c", b"a"], [5, 2, 3, 9, 4], [1, 1, 2, 1, 1]
    out = E.merged([run[:2], run[2:]])
    assert sorted((int(r["key"]), r["sha"], int(r["keep"]), int(r["n"])) for r in out) == [(1, b"c", 9, 1), (7, b"a", 3, 4), (7, b"b", 2, 1)]


def _weighted_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def _bags(texts, n=3):
    h, doc, _, _ = words(plain(pa.array(texts)))
    e, o = D.shingles(h, doc, len(texts), n)
    bags = [{} for _ in texts]
    for x, i in zip((e >> np.uint64(20)).tolist(), o.tolist()):
        bags[i][x] = bags[i].get(x, 0) + 1
    return bags, e, o


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 300)}" for _ in range(400)]
    texts = [" ".join(base)] + [" ".join(w if rng.random() > p else "zz" + w for w in base) for p in (0.01, 0.05, 0.1, 0.2)] + ["one", "one two", " ".join(["same"] * 50)]
    bags, e, o = _bags(texts)
    sig = D.signatures(e, o, len(texts), 4000)
    for i in range(5):
        assert abs((sig[0] == sig[i]).mean() - _weighted_jaccard(bags[0], bags[i])) < 0.04
    assert (sig[5] != sig[6]).mean() > 0.95


def _corpus(seed=5, families=40):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 500)}" for _ in range(rng.choice([30, 120, 400]))]
        for c in range(rng.choice([1, 2, 3, 9])):
            p = rng.choice([0.0, 0.02, 0.04, 0.3])
            out.append(" ".join(w if c == 0 or rng.random() > p else f"x{rng.random()}" for w in base))
    return out


@pytest.mark.parametrize("wide", [D.WIDE, 3])
def test_near_duplicates_recall_and_precision_against_brute_force(spark, wide):
    texts = _corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], documents(spark).schema).repartition(4)
    group = {r.doc_id: r.keep_id for r in D.near_duplicates(docs, wide=wide).collect()}
    bags, _, _ = _bags(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i].keys() & bags[j].keys() and _weighted_jaccard(bags[i], bags[j]) >= D.THRESHOLD]
    together = [group.get(i, i) == group.get(j, j) for i, j in near]
    assert len(near) > 50 and sum(together) / len(near) >= 0.9
    for i, keep in group.items():  # no document goes that has no similar one
        assert keep < i and any(_weighted_jaccard(bags[i], b) >= D.THRESHOLD - 0.15 for j, b in enumerate(bags) if j != i)


def test_a_shared_passage_does_not_make_pairs_quadratic(spark, monkeypatch):
    compared = []

    def counting(pairs, *rest):
        kept = D.written(pairs, "pairs")
        compared.append(kept.count())
        return real(kept, *rest)

    real = D._verified
    monkeypatch.setattr(D, "_verified", counting)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"u{rng.random()}" for _ in range(70)) for _ in range(1600)]
    for i in range(0, 1600, 40):  # a near copy of every 40th
        texts[i + 1] = texts[i].replace("p30", "other")
    found = {}
    for n in (400, 1600):
        compared.clear()
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts[:n])], documents(spark).schema).repartition(4)
        group = {r.doc_id: r.keep_id for r in D.near_duplicates(docs, wide=12).collect()}
        assert all(group.get(i + 1) == i for i in range(0, n, 40)) and len(group) < n / 20
        found[n] = sum(compared)
    assert found[1600] < 6 * found[400], found


@pytest.mark.parametrize("wide, crossed", [(3, 16), (1, 0)])
def test_wide_bands_lose_no_similar_pair(spark, monkeypatch, wide, crossed):
    monkeypatch.setattr(D, "CROSSED", crossed, raising=False)
    rng = random.Random(4)
    pool = [" ".join(f"p{p}w{i}" for i in range(20)) for p in range(30)]
    texts = []
    for _ in range(200):  # two documents that share five passages of six, all of which many have
        a = rng.sample(range(30), 6)
        b = a[:5] + rng.sample([p for p in range(30) if p not in a], 1)
        texts += [" ".join(pool[p] for p in a), " ".join(pool[p] for p in b)]
    _, e, o = _bags(texts)
    sig = D.signatures(e, o, len(texts))
    same = sig[:, None, :] == sig[None, :, :]
    share, banded = same.mean(axis=2), same.reshape(len(texts), len(texts), -1, D.ROWS).all(axis=3).any(axis=2)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if share[i, j] >= D.THRESHOLD and banded[i, j]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    group = {r.doc_id: r.keep_id for r in D.near_duplicates(docs, wide=wide).collect()}
    assert len(near) > 200 and [(i, j) for i, j in near if group.get(i, i) != group.get(j, j)] == []
    for i, keep in group.items():
        assert keep < i and any(share[i, j] >= D.THRESHOLD and group.get(j, j) == keep for j in range(len(texts)) if j != i)


def test_near_duplicates_of_odd_rows(spark):
    got = {(r.doc_id, r.keep_id) for r in D.near_duplicates(documents(spark)).collect()}
    assert {(2, 1), (8, 1)} <= got and not {3, 4, 5, 6, 7, 9, None} & {d for d, _ in got}
    assert {(r.doc_id, r.keep_id) for r in D.near_duplicates(documents(spark, extra=True)).collect()} == got
    assert D.near_duplicates(documents(spark, [])).count() == 0
    assert D.near_duplicates(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(200, 150), (150, 170)], "a bigint, b bigint")
    got = {(r.node, r.root) for r in D.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(200, 150), (170, 150)}


def _lines_brute(docs, min_words):
    """Texts after deleting, from every place, the longest run that an earlier place begins too, if it has enough words."""
    order = sorted({(d if d is not None else -(2**63), t) for d, t in docs if t is not None})
    seqs = [[(i, x.strip(" \t\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")] for _, t in order]
    gone = [set() for _ in order]
    longest = max((len(s) for s in seqs), default=0)
    for size in range(1, longest + 1):
        seen = set()
        for k, s in enumerate(seqs):
            for a in range(len(s) - size + 1):
                run = tuple(x for _, x in s[a : a + size])
                if run in seen and sum(x.count(" ") + 1 for x in run) >= min_words:
                    gone[k] |= {i for i, _ in s[a : a + size]}
                seen.add(run)
    out = {}
    for (d, t), g in zip(order, gone):
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
        out[d, t] = (t, 0) if not g else ("" if not rest.strip(" \t\r\n") else rest, len(g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i} " + "w " * rng.randint(0, 6) for i in range(12)] + ["", "  ", "x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25))), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s", 1), (100, rows[3][1], "en", "s", 1), (101, "\n".join(pool * 3), "en", "s", 1)]
    docs = documents(spark, rows).repartition(3)
    want = _lines_brute([(r[0], r[1]) for r in rows], L.MIN_WORDS)
    for r, source in zip(*[L.without_repeats(docs.withColumnRenamed("source", "was")).collect()] * 2):
        assert (r.text, r.lines_removed) in {v for (d, _), v in want.items() if d == r.doc_id}
    got = sorted((r.doc_id, r.text, r.lines_removed) for r in L.without_repeats(docs).collect())
    assert got == sorted((d, *want[d, t]) for d, t, *_ in rows)
    assert sum(n for *_, n in got) > 100


def test_maximal_runs_of_any_length_go_whole(spark):
    rng = random.Random(7)
    long = [f"c{i} x" for i in range(45)]
    rows = [(0, "\n".join(long)), (1, "own\n" + "\n".join(long[3:40]) + "\nother"), (2, "\n".join(long[5:16])), (3, "\n".join(long[30:33])), (4, "\n".join(long[9:12]) + "\nmine\n" + "\n".join(long[:7])), (5, "\n".join(["same x"] * 29)), (6, "\n".join(["same x"] * 11 + ["end of it"]))]
    rows += [(7, "a b c\nd e f\ng h i"), (8, "z\na b c\nd e f\ng h i"), (9, "p\n" + "w " * 39 + "w\nu v\ns t"), (10, "q\n" + "w " * 39 + "w\nu v\ns t\nr")]
    rows += [(20 + i, "\n".join(f"l{rng.choice('abc')} y" for _ in range(rng.randint(0, 40)))) for i in range(25)]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows]).select("doc_id", "text")
    want = _lines_brute(rows, L.MIN_WORDS)
    got = rows_of(L.without_repeats(docs))
    assert got == sorted((str(d), str(n), x) for (d, _), (x, n) in want.items()) == sql_rows(L.SQL["op10_line_dedup"], documents=docs)
    assert want[8, rows[8][1]] == ("z", 3) and want[10, rows[10][1]] == ("q\nr", 3)


def test_small_rounds_take_few_exchanges_and_have_the_same_ranks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "\n".join(f"l{rng.choice('abc')} y" for _ in range(rng.randint(0, 40)))) for i in range(40)]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows]).select("doc_id", "text")
    real, exchanges = L.written, []

    def counting(df, name):
        if name == "suffixes":
            exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return real(df, name)

    monkeypatch.setattr(L, "written", counting)
    columns = ("place", "d", "rank", "n", "first", "above")
    ranks = lambda: [sorted(tuple(-1 if x is None else x for x in r) for r in t.select(*columns).collect()) for t in L.suffix_array(lines)]
    lines = L._lines(docs)
    small = ranks()
    assert len(small) > 3 and max(exchanges[1:]) <= 2, exchanges
    monkeypatch.setattr(L, "WINDOWED", 0)
    assert ranks() == small


def test_line_dedup_of_odd_rows(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.text) for r in L.without_repeats(docs).collect()}
    assert (3, None) in got and (4, "") in got and (7, "   \n\t\n ") in got and (9, "Short.") in got
    assert (1, "") in got and (2, "") in got and (None, BASE) in got  # a null doc_id comes first
    assert (12, "Unique tail of twelve.") in got
    out = L.line_dedup(documents(spark, extra=True))
    assert out.columns == documents(spark, extra=True).columns and {r.doc_id for r in out.collect()} >= {3, 4, 5, 6, 7, 8, 9, 12} and 2 not in {r.doc_id for r in out.collect()}
    assert L.line_dedup(documents(spark, [])).count() == 0
    clash = docs.withColumn("lines_removed", docs["doc_id"])
    assert "lines_removed_" in L.without_repeats(clash).columns and L.line_dedup(clash).columns == clash.columns
    plain_rows = documents(spark, [r for r in [(1, "a b c d e f g h\nz", "", "", 1), (2, "z\na b c d e f g h\nz", "", "", 1), (3, None, "", "", 1)]])
    assert rows_of(L.without_repeats(plain_rows.select("doc_id", "text"))) == sql_rows(L.SQL["op10_line_dedup"], documents=plain_rows)
