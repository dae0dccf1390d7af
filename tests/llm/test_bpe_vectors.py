"""Byte-level BPE, hard negatives and vector codes against plain versions."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sawmill.llm import bpe, fm, hardneg, pq, queries, wumanber

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.Vocabulary.from_tiktoken(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


HARD = [
    None, "", "a", " \n\n  x", "= " * 300, "ab" * 500 + " " + "x" * 200 + "1" * 150 + " we're don'T", "　 \u0000 😀👍🏽" * 20, "ñandú ﬁ ſ K İ " * 9, "ab " * 5,
    "\t" * 1000, "word " * 3 + "z" * 5000, "aaaa aaaaaaa aaaaaaaaaaaaaaa", "<|endoftext|>", "Привет мир 你好世界 مرحبا नमस्ते", "ab " * 5,
]


@pytest.mark.parametrize("common", [0, 3, bpe.COMMON])
def test_ids_and_bytes(spark, vocabulary, plain, common):
    df = spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(HARD)], "doc_id long, text string, ids string, other string").repartition(3)
    got = bpe.encode(df, vocabulary, common=common).withColumn("back", bpe.decode(F.col("ids"), vocabulary)).collect()
    assert len(got) == len(HARD) and {r.other for r in got} == {"own"}
    for r in got:
        assert list(r.ids) == plain.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()


@pytest.mark.parametrize("remembered", [0, 7, bpe.REMEMBERED])
def test_a_task_folds_a_word_once(spark, vocabulary, plain, remembered):
    rng = random.Random(3)
    words = ["".join(rng.choice("bdehlnorstué") for _ in range(rng.randrange(5, 14))) for _ in range(60)] + ["q" * 300]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for i in range(90)}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, other int").coalesce(2)
        got = bpe.encode(df, vocabulary, common=20, keep=["doc_id"], remembered=remembered).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.doc_id for r in got) == sorted(texts) and got[0].__fields__ == ["doc_id", "ids"]
    assert all(list(r.ids) == plain.encode_ordinary(texts[r.doc_id]) for r in got)
    codes = bpe.Codes({"a": 1}, 5)
    assert [codes[w] for w in ("x", "a", "y", "x")] == [5, 1, 6, 5] and codes.new == ["x", "y"]


def test_bpe_of_nothing(spark, vocabulary):
    assert bpe.encode(spark.createDataFrame([], "text string"), vocabulary).collect() == []
    bad = spark.createDataFrame([([1, -1],), ([10**6],), ([],), (None,)], "ids array<int>").select(bpe.decode(F.col("ids"), vocabulary).alias("b")).collect()
    assert [r.b for r in bad] == [None, None, b"", None]


def test_random_words_merge_alike(spark, vocabulary, plain):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeéñ的tionhr") for _ in range(rng.randrange(2, 30))) for _ in range(400)})
    for w in words + ["x" * 3000, "ab" * 900]:
        assert bpe.merge_long(w.encode(), vocabulary.ranks) == plain.encode_ordinary(w)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    ranks = bpe._ranks(vocabulary)
    for r in df.select("w", bpe.bind(ranks, lambda t: bpe.fold(bpe.as_characters(F.col("w")), t)).alias("ids")).collect():
        assert list(r.ids) == plain.encode_ordinary(r.w)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_query_against_the_library(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def integers(v):
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))  # noqa: B905  (shorter ones count as filled with zeros)


def plain_negatives(rows, is_anchor, k=5, low=80):
    kept = [(i, lab, integers(v)) for i, lab, v in rows if i is not None and lab is not None and integers(v) is not None]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in kept if is_anchor(i)}:
        score = sorted((-product(v, w), j, lb) for j, lb, w in kept)
        for p, j, _ in [x for x in score if x[2] == lab and x[1] != i][:k]:
            window = [x for x in score if x[2] != lab and low * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(i, j, n + 1, o, -p, -s) for n, (s, o, _) in enumerate(window)]
    return sorted(out)


def embedding_rows(seed, n=300, d=12, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=d) * spread]) for i in range(n)]
    rows += [(7, None, [0.1] * d), (None, 1, [0.1] * d), (400, 1, None), (401, 1, [float("nan")] * d), (402, 2, [None] + [0.2] * (d - 1)), (403, 1, [float("inf")] * d), (404, 1, []), (405, 0, [0.5])]
    rows += [rows[5], rows[20], (20, 0, rows[21][2])] + [(500 + i, i % 3, [0.25] * d) for i in range(30)]  # repeated rows and ties
    return rows


@pytest.mark.parametrize("seed,pass_bytes", [(1, 8 << 20), (2, 500)])
def test_negatives(spark, seed, pass_bytes):
    rows = embedding_rows(seed)
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, label int, embedding array<double>, anchor string").repartition(5)
    got = sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 20 == 0, pass_bytes=pass_bytes).collect())
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_negatives_of_little(spark):
    kind = "vec_id long, label int, embedding array<float>"
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 0, [1.0])], [(0, 1, [0.0]), (1, 1, [1.0]), (2, 0, [0.0])]):
        got = hardneg.mine(spark.createDataFrame(rows, kind), F.col("vec_id") % 2 == 0).collect()
        assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 2 == 0)


def test_pairs_above_any_threshold():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-200, 200, (500, 24)), rng.integers(-200, 200, (40, 24))
    rows[:, 8:] //= 8  # a tail of little energy, which the lists can leave out
    order = np.argsort(-(rows.astype(float) ** 2).sum(0))
    exact = rows @ anchors.T
    for t in (-np.inf, -1000, 0, 1, 50_000, 200_000, 10**9):
        for at in (np.full(40, float(t)), np.where(np.arange(40) % 2, float(t), 150_000.0)):
            i, j, s = hardneg.pairs_above(rows, anchors, at, order)
            want = np.argwhere(exact >= at[None, :])
            assert sorted(zip(i, j, s, strict=True)) == [(a, b, exact[a, b]) for a, b in want]
    edge = float(exact.max())  # a threshold that one pair just reaches
    assert len(hardneg.pairs_above(rows, anchors, np.full(40, edge), order)[0]) == (exact == edge).sum()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, integers(v)) for i, lab, v in rows if integers(v) is not None]
    width = max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts))
    kept = [(i, lab, np.array(v + [0] * (width * parts - len(v)), object).reshape(parts, width)) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [int(x) for x in r[2].ravel()]))[:entries]
    books = [[list(r[2][p]) for r in first] for p in range(parts)]

    def assign(v, p):
        return min((sum((int(x) - int(y)) ** 2 for x, y in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        sums = {}
        for _, _, v in kept:
            for p in range(parts):
                sums.setdefault((p, assign(v, p)[1]), []).append(v[p])
        for (p, e), vs in sums.items():
            books[p][e] = [sum(int(v[k]) for v in vs) // len(vs) for k in range(width)]
    out = [(i, lab, [assign(v, p) for p in range(parts)]) for i, lab, v in kept]
    total = {}
    for _, lab, a in out:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), total[lab], digest) for i, lab, a in out)


@pytest.mark.parametrize("seed,n,d", [(1, 200, 32), (2, 30, 32), (3, 120, 20)])
def test_codes(spark, monkeypatch, seed, n, d):
    rows = embedding_rows(seed, n, d, 0.3) + [(None, None, [0.5] * d), (900, None, [-0.5] * d)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(4)
    plain = plain_codes(rows)
    for most in (pq.BROADCAST_ROWS, 0):
        monkeypatch.setattr(pq, "BROADCAST_ROWS", most)
        got = sorted((str(r.id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in pq.compress(df).collect())
        assert got == plain


def test_codes_of_nothing(spark):
    empty = pq.compress(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert [r.code for r in pq.compress(spark.createDataFrame([(1, 1, []), (2, 1, None)], "vec_id long, label int, embedding array<float>")).collect()] == ["00" * 16]


def test_tree_finds_the_nearest_and_skips_subtrees():
    rng = np.random.default_rng(4)
    entries = rng.integers(-60, 60, (64, 4))
    entries[40:44] = entries[3]  # equal entries: the least number wins
    x = np.concatenate((rng.integers(-70, 70, (3000, 4)), entries, (entries[:-1] + entries[1:]) // 2))
    near = pq.Nearest(entries)
    e, d = near(x)
    exact = pq.squared(x, entries)
    assert (e == exact.argmin(1)).all() and (d == exact.min(1)).all() and near.compared < 0.6 * exact.size
    same = pq.Nearest(np.zeros((64, 4), np.int64))
    assert (same(x)[0] == 0).all()
    line = pq.Nearest(np.arange(64)[:, None] * 2)  # odd points lie between two entries
    assert (line(np.arange(126)[:, None])[0] == np.arange(126) // 2).all()


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    k = (1 << fm.BITS) + fm.DENSE
    model = fm.Model(0.1, rng.normal(size=k).astype(np.float32), (rng.normal(size=(k, fm.RANK)) * 0.1).astype(np.float32), np.zeros(fm.DENSE, np.float32), np.full(fm.DENSE, 10, np.float32))
    texts = [b"", b"", b"one two"] + [" ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(1, 200))).encode() for _ in range(397)]
    whole = model.score(fm.features(texts))
    for size in (1, 2, 7):
        assert (np.concatenate([model.score(fm.features(texts[i : i + size])) for i in range(0, len(texts), size)]) == whole).all()


def test_repeated_benchmark_items_in_passes(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing here")], "doc_id long, text string")
    one = spark.createDataFrame([("a", " ".join(words[5:25]))], "item_id string, text string")
    many = spark.createDataFrame([("a", " ".join(words[5:25]))] * 3000, "item_id string, text string")
    rows = lambda b: sorted(map(tuple, wumanber.decontaminate(docs, b, pass_bytes=200).collect()))
    assert rows(one) == rows(many)


def test_pages_of_stray_quotes_cost_their_size():
    import time

    from sawmill.llm import crf

    began = time.perf_counter()
    for page in ("<p>x \"' <a b=\"c " * 65_000, "</! " * 250_000 + ">", "<a \"" * 250_000, "<a <b '" * 150_000 + ">"):
        crf.blocks(page)
    assert time.perf_counter() - began < 20
    text = lambda page: [b.text for b in crf.blocks(page)]
    assert text("<p title='a>b'>one</p><p title=\"c>two</p>three") == ["one", "two", "three"]
    assert text("<!-- <p>x</p> -->a<script src='>'>no</script>b<!d>c") == ["abc"]


@pytest.mark.parametrize("common", [0, bpe.COMMON])
def test_digests_within_the_task(spark, vocabulary, plain, common):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(HARD)], "doc_id long, text string, n_tokens string").repartition(2)
    got = bpe.encode(df, vocabulary, common=common, made=bpe.digests(vocabulary)).collect()
    assert len(got) == len(HARD) and got[0].__fields__ == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = plain.encode_ordinary(r.text or "")
        assert tuple(r)[2:] == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""))
    assert bpe.encode(df.limit(0), vocabulary, common=common, made=bpe.digests(vocabulary)).collect() == []


def test_decoding_of_lists(vocabulary):
    import pyarrow as pa

    fields, make = bpe.digests(vocabulary)
    columns = make(pa.array([[0, 1], [], [10**6], [-1, 2]], pa.list_(pa.int32())))
    pieces = {v: k for k, v in vocabulary.ranks.items()}
    assert [f.name for f in fields] == ["n_tokens", "ids_sha256", "decoded_sha256"] and columns[0].to_pylist() == [2, 0, 1, 2]
    assert columns[2].to_pylist() == [hashlib.sha256(x).hexdigest() for x in (pieces[0] + pieces[1], b"")] + [None, None]


def test_the_driver_makes_no_strings_of_common_words(spark, vocabulary, plain):
    import pickle

    import pyarrow as pa

    texts = [" zqxjkv vwqzkj" * 9, " zqxjkv kkqqzz kkqqzz " * 4, "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    words, ids = bpe.common_words(df, vocabulary, bpe._ranks(vocabulary))
    assert isinstance(words, pa.Array) and isinstance(ids, pa.Array) and {" zqxjkv", " vwqzkj", " kkqqzz"} <= set(words.to_pylist())
    assert all(list(i) == plain.encode_ordinary(w) for w, i in zip(words.to_pylist(), ids.to_pylist(), strict=True))
    many = pa.array([f" common{i}" for i in range(200_000)])
    known = bpe.Known({" the": 7}, 10, many)
    assert len(pickle.dumps(known)) < 2 * many.nbytes and "codes" not in vars(known)
    back = pickle.loads(pickle.dumps(known))
    assert back.codes[" the"] == 7 and back.codes[" common5"] == 15 and len(back.codes) == 200_001
