import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from corvane.llm import bpe as B
from corvane.llm import fm_index as M
from corvane.llm import packing as P
from corvane.llm import quote_links as C
from corvane.llm.arrays import chunks, plain

from .cases import LONG, documents, rows_of, sql_rows

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", "it's 'street' 're we'll 'x ''s  a\n\n b \t\tc", "  lead", "trail  ", "\n", "é'è 'd", "日本 語テキスト、　全角", "😀😀 a b\x85c\x1cd", "don't'", "a" * 500 + "!" * 300, "1234 56'7", "x 's", "'s", "'", "'re", "'r", "I'll'm", "naïve—test… ’s",
    " \n x", "a \n", "\r\n\r\n x", "ﬁ ½ ² ​ x", "tab\t'll", "a'sb", "'lls 'ves 'res 'd1", LONG[:3000],
]


def test_pieces_and_ids_equal_the_public_encoder():
    import public_tokenizers

    ranks = B.read_ranks(B.VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(" \n\t'aBsé1!—日lev") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for frequent in ([], [b" the", b"it", b"\n", b" lead", b"a"]):
        codec = B.Codec(B.compiled(ranks, frequent))
        ids, count = codec.encode(plain(pa.array(texts)))
        cut = np.concatenate([[0], np.cumsum(count)])
        for i, t in enumerate(texts):
            mine = ids[cut[i] : cut[i + 1]]
            assert mine.tolist() == reference.encode_ordinary(t), t
            assert codec.decode(mine).tobytes().decode() == t
    merges = B.Merges.of(ranks)
    for piece in (b"a" * 300, b" unbelievable", "日本語".encode()):
        ids, _ = merges.many(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))
        assert ids.tolist() == merges.one(piece)


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) + rng.choice([b"", b"ing", b"ed"]) for _ in range(800)})
    a = B.minimal_automaton(words)
    asked = words + [b"", b"abcing!", b"zz", words[5] + b"q", words[7][:-1] + b"zz"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    size = np.array([len(x) for x in asked])
    got = B.looked_up(a, data, np.cumsum(size) - size, size)
    assert got.tolist() == [words.index(x) if x in words else -1 for x in asked]
    rights = {}  # a minimal automaton has a state for every different set of endings
    for w in words:
        for i in range(len(w) + 1):
            rights.setdefault(w[:i], set()).add(w[i:])
    assert len(a["ends"]) == len({frozenset(x) for x in rights.values()})


def test_encoding_of_odd_rows_and_round_trip(spark):
    docs = documents(spark, extra=True)
    out = B.encoded(docs, lexicon=50)
    got = out.collect()
    assert len(got) == docs.count() and all(r.exact for r in got if r.ids is not None) and {r.doc_id for r in got if r.ids is None} == {3, None}
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}
    back = {(r.doc_id, r.text) for r in B.decoded(out).collect()}
    assert back == {(r.doc_id, r.text) for r in docs.collect()}
    assert B.encoded(documents(spark, [])).count() == 0
    assert [r.piece for r in B.frequent(spark.createDataFrame([(b"b", 2), (b"a", 2), (b"c", 9), (b"d", 1)], "piece binary, n bigint"), 2).collect()] == [b"c", b"a"]


def _fits(sizes, length):
    """Best fit decreasing, by looking at every open row."""
    rows, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        best = min((r for r in range(len(rows)) if rows[r] >= sizes[i]), key=lambda r: rows[r], default=None)
        if best is None:
            rows.append(length)
            best = len(rows) - 1
        rows[best] -= sizes[i]
        out[i] = best
    return out, sorted(rows)


@pytest.mark.parametrize("length", [1, 7, 64, 100])
def test_packing_equals_best_fit_decreasing(length):
    rng = np.random.default_rng(length)
    sizes = rng.integers(1, length + 1, 500)
    row, n = P.best_fit_decreasing(sizes, length)
    room = length - np.bincount(row, weights=sizes, minlength=n)
    assert sorted(room.tolist()) == _fits(sizes.tolist(), length)[1]
    # Ties go to the earlier piece: of equal sizes, rows open in order.
    row, n = P.best_fit_decreasing(np.full(6, max(1, length // 2 + 1)), length)
    assert row.tolist() == list(range(6)) and n == 6 or length == 1


def test_packed_rows_give_every_token_back(spark):
    docs = documents(spark, extra=True)
    out = P.packed_documents(docs, length=50, window=3000).collect()
    lists = {}
    for r in B.encoded(docs).collect():
        if r.ids:
            lists.setdefault(r.doc_id, []).append(list(r.ids))
    seen = []
    for r in out:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 50 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.row_tokens and (ids[r.row_tokens :] == P.PAD).all() and (pos[r.row_tokens :] == 0).all()
        for a, b, d, o in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            assert pos[a:b].tolist() == list(range(b - a))
            assert any(x[o : o + b - a] == ids[a:b].tolist() for x in lists[d])
            seen.append((d, o, b - a))
    assert sum(n for *_, n in seen) == sum(len(x) for v in lists.values() for x in v)
    assert P.packed_documents(documents(spark, [])).count() == 0
    # A text longer than the window is split losslessly, and its rows don't depend on the window.
    one = documents(spark, [(6, LONG, "en", "b", 1)])
    parts = {w: [(r.doc_offsets, bytes(r.input_ids)) for r in P.packed_documents(one, length=64, window=w).collect()] for w in (100, 10**6)}
    assert parts[100] == parts[10**6] and len(parts[100]) > 100


def _spans_brute(text, phrases):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    hits = sorted((i, i + len(p), item) for item, ps in phrases.items() for p in ps for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    out = []
    for a, b, item in hits:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] | {item})
        else:
            out.append((a, b, {item}))
    return out


def test_leak_spans_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "é"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 7, 8, 20, 40]))) for i in range(25)}
    bench = spark.createDataFrame([*items.items(), (None, "a b c d e f g h"), (77, None), (3, items[3]), (78, "")], "item_id bigint, text string")
    texts = [" ".join(rng.choice(vocabulary + ["out"]) for _ in range(rng.randint(0, 80))) for _ in range(80)]
    texts += [f"Begin {items[i].upper()}, and {items[(i + 1) % 25]}! end." for i in range(25)] + [texts[0]] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, None, None, None, None), (900, "", None, None, 0)], documents(spark).schema).repartition(3)
    phrases = {}
    for i, t in items.items():
        w = t.lower().split()
        phrases[i] = [w[j : j + M.N] for j in range(max(len(w) - M.N, 0) + 1)] if len(w) >= M.LEAST else []
    want = sorted((i, a, b, ",".join(map(str, sorted(s)))) for i, t in enumerate(texts) for a, b, s in _spans_brute(t, phrases))
    got = sorted((r.doc_id, r.start_word, r.end_word, r["items"]) for r in M.leak_spans(docs, bench).collect())
    assert got == want and len(got) > 40
    cut = {r.doc_id: r.text for r in M.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        if i in cut:
            spans = _spans_brute(t, phrases)
            assert len(cut[i].split()) <= len(t.split()) - sum(b - a for a, b, _ in spans) + len(spans) + 1
            assert (not spans) == (cut[i] == t)
        else:
            assert sum(b - a for a, b, _ in _spans_brute(t, phrases)) == len(t.split())
    assert M.leak_spans(docs, bench.where("item_id < 0")).count() == 0 and M.leak_spans(documents(spark, []), bench).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 4, 600).astype(np.int32)
    seq[-1] = 0
    sa = M.suffix_array(seq)
    key = [tuple((0, i) if x == 0 else (1, int(x)) for i, x in enumerate(seq[s:].tolist(), s)) for s in range(len(seq))]
    cut = lambda k: k[: next(i for i, x in enumerate(k) if x[0] == 0) + 1]
    assert [cut(key[s]) for s in sa] == sorted(cut(k) for k in key)
    index = M.FMIndex(seq, 4)
    phrases = rng.integers(1, 4, (200, 5))
    low, high = index.count(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(seq) - 4) if (seq[i : i + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_slices_of_phrases_find_the_same(spark):
    bench = spark.createDataFrame([(i, " ".join(f"p{i}q{j}" for j in range(12))) for i in range(9)], "item_id bigint, text string")
    assert len(list(M.phrase_slices(bench, M.N, M.LEAST, slice_words=30))) > 3
    long = "so " * 300 + " ".join(f"p3q{j}" for j in range(12)) + " it" * 300
    texts = [" ".join(f"p{i}q{j}" for j in range(2, 11)) + " and " + " ".join(f"p{(i + 4) % 9}q{j}" for j in range(12)) for i in range(9)] + [long, long]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, items string")
    got = rows_of(M.leak_spans(docs, bench, slice_words=30))
    assert got == rows_of(M.leak_spans(docs, bench)) == sql_rows(M.SQL["op7_decontamination"], documents=docs, benchmark=bench) and len(got) == 20
    assert ("10", "312", "3", "300") in got


def test_quotes_are_linked_and_equal_sql(spark):
    rows = [
        (1, 0, "a", "First message here.\nWith two lines."), (1, 1, "b", "An unrelated remark."), (1, 2, "c", "> First message here.\n> With two lines.\n\nI agree."), (1, 3, "d", ">> First  message HERE.\n> I agree.\nReally?"),
        (1, 4, "e", "> nowhere said\nOdd."), (1, 5, "f", "> An unrelated remark.\n>\n> and more\nYes."), (2, 0, "a", None), (2, 1, "b", "> First message here.\nOther thread."), (2, 2, "c", ""), (2, 2, "b", "tie"), (2, 3, "a", "> > deep\n>x"),
        (None, 0, "a", "x"), (3, None, "a", "x"), (1, 1, "b", "An unrelated remark."), (4, 7, None, "> only quotes"),
    ]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("role", "role")
    got = {(r.conv_id, r.turn): r for r in C.linked(conv.selectExpr("*", "1 AS level", "2 AS p", "3 AS own")).collect()}
    assert got[1, 2].parent_turn == 0 and got[1, 2].text == "I agree." and got[1, 2].n_linked == 1
    assert got[1, 3].parent_turn == 2 and got[1, 3].text == "Really?" and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2
    assert got[1, 4].parent_turn == 3 and got[1, 4].n_linked == 0 and got[1, 5].parent_turn == 1
    assert got[2, 1].n_linked == 0 and got[2, 2].text == "tie" and got[4, 7].text == "" and got[4, 7].parent_turn == -1 and got[2, 0].text is None
    order = [t for _, t in sorted((r.position, t) for (c, t), r in got.items() if c == 1)]
    assert order.index(0) < order.index(2) < order.index(3) < order.index(4) and order.index(1) < order.index(5)
    assert rows_of(C.linked(conv)) == sql_rows(C.SQL["op2_quote_links"], conversations=conv)
    assert C.linked(conv.where("conv_id = 99")).count() == 0
    whole = {r.conv_id: [m.text for m in r.messages] for r in C.conversations_of(C.linked(conv)).collect()}
    assert "I agree." in whole[1] and 4 not in whole


def test_long_threads_and_long_quotes_equal_sql(spark):
    rng = random.Random(8)
    own = [f"message {i} says {rng.random()}\nand a second line {i}" for i in range(300)]
    rows = [(1, 0, "a", own[0])]
    for i in range(1, 300):
        j = rng.randrange(max(0, i - 40), i)
        quoted = "\n".join("> " + x for x in own[j].split("\n"))
        nested = "\n".join("> > " + x for x in own[rng.randrange(j + 1)].split("\n"))
        rows.append((1, i, "ab"[i % 2], f"{nested}\n{quoted}\n\n{own[i]}" if i % 3 else own[i]))
    rows += [(2, 0, "a", LONG), (2, 1, "b", "\n".join("> " + x for x in LONG.split("\n")) + "\nok"), (3, 5, "a", "x"), (3, 5, "a", "x")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = C.linked(conv)
    assert rows_of(got) == sql_rows(C.SQL["op2_quote_links"], conversations=conv)
    assert got.where("conv_id = 1 AND n_linked > 0").count() > 150 and got.where("conv_id = 2 AND turn = 1").first().n_linked == 1


def test_chunks_split_between_texts_only():
    batches = [pa.record_batch([pa.array(t, pa.string())], ["text"]) for t in (["a" * 10, None, "b" * 25, ""], [], ["c" * 100, "d"])]
    out = [t.column("text").to_pylist() for t in chunks(iter(batches), "text", 30)]
    assert [x for t in out for x in t] == ["a" * 10, None, "b" * 25, "", "c" * 100, "d"] and len(out) > 2


def test_pipeline_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, SF), "t")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if name != "bpe":
            assert after.columns == docs.columns
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids
    assert {r.exact for r in before.collect()} == {True}


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "seven small birds sing about the coming rain today")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (documents(spark), documents(spark, extra=True), documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "t")
            assert name == "bpe" or out.columns == docs.columns
            if name == "near duplicates" and docs.count():
                left = [r.doc_id for r in out.collect()]
                assert not {2, 8} & set(left) and {1, 3, 4, 5, 6, 7, 10} <= set(left) and left.count(None) == 2
