"""Brute-force versions, round trips and edge cases of the training-data operators."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sawmill.llm import chat, crf, fm, gif, labelled_pages, licenses, omh, ordinal, packing, textvec, warc, wumanber
from sawmill.llm.storage import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(FOLD))


# --- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = textvec.words([t.encode() for t in texts], 4)
    seen = {}
    for i, t in enumerate(texts):
        mine = plain_words(t)
        a, z = w.first[i], w.first[i + 1]
        assert [t.encode().translate(textvec.FOLD)[s:e].decode() for s, e in zip(w.start[a:z], w.end[a:z])] == mine
        for x, h in zip(mine, w.hashes[a:z]):
            assert seen.setdefault(x, h) == h


def test_long_text_in_segments():
    t = " ".join(f"w{i}" for i in range(200_000)).encode()
    w = textvec.words([b"a", t, b""])
    assert np.diff(w.first).tolist() == [1, 200_000, 0]
    assert w.hashes[1] == textvec.words([b"w0"]).hashes[0] and w.hashes[-1] == textvec.words([b"w199999"]).hashes[0]


# --- 1 GIF


def slow_lzw(data, bits):
    value, at, width = int.from_bytes(data, "little"), 0, bits + 1
    start = [bytes([i]) for i in range(1 << bits)] + [b"", b""]
    table, prev, out = list(start), None, b""
    while at + width <= 8 * len(data):
        code = value >> at & (1 << width) - 1
        at += width
        if code == 1 << bits:
            table, width, prev = list(start), bits + 1, None
            continue
        if code == (1 << bits) + 1:
            break
        word = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + word[:1])
        out, prev = out + word, word
        if len(table) == 1 << width and width < 12:
            width += 1
    return out


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 64))
def test_lzw_round_trip(data, times):
    data = (data * times)[:20_000]
    codes = gif.lzw_encode(data)
    assert slow_lzw(codes, 8) == data == gif.lzw_decode(codes, 8, len(data) + 1)


def block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def test_gif_disposal_transparency_interlace_and_time():
    def frame(x, y, w, h, samples, disposal, transparent=None, interlaced=False, delay=3):
        flags = disposal << 2 | (transparent is not None)
        head = b"\x21\xf9\x04" + bytes([flags]) + delay.to_bytes(2, "little") + bytes([transparent or 0]) + b"\0"
        where = b"".join(v.to_bytes(2, "little") for v in (x, y, w, h))
        return head + b"\x2c" + where + bytes([0x40 if interlaced else 0]) + b"\x02" + block(gif.lzw_encode(bytes(samples), 2))

    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (4).to_bytes(2, "little") * 2 + b"\x81\0\0" + colours
    data = head + frame(0, 0, 4, 4, [1] * 16, 1) + frame(1, 1, 2, 2, [2, 0, 0, 2], 2, transparent=0) + frame(0, 0, 1, 1, [3], 3) + frame(3, 3, 1, 1, [2], 0)
    g = gif.decode(data + b"\x3b")
    one, two, three, four = (f.canvas for f in g.frames)
    assert (one[..., :3] == [255, 0, 0]).all()
    assert two[1, 1, :3].tolist() == [0, 255, 0] and two[1, 2, :3].tolist() == [255, 0, 0]
    assert three[0, 0, :3].tolist() == [0, 0, 255] and three[1, 1].tolist() == [0, 0, 0, 0] and three[0, 3, :3].tolist() == [255, 0, 0]
    assert four[0, 0, :3].tolist() == [255, 0, 0] and four[3, 3, :3].tolist() == [0, 255, 0]
    assert [f.start_ms for f in g.frames] == [0, 30, 60, 90]
    rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(9)[first::step]]
    stored = [v for r in rows for v in (r % 4, 0)]
    head = b"GIF89a" + (2).to_bytes(2, "little") + (9).to_bytes(2, "little") + b"\x81\0\0" + colours
    g = gif.decode(head + frame(0, 0, 2, 9, stored, 0, interlaced=True) + b"\x3b")
    assert g.frames[0].samples[:, 0].tolist() == [r % 4 for r in range(9)]
    with pytest.raises(gif.GifError):
        gif.decode(b"PNG")


def test_gif_columns(spark, docs, empty):
    back = gif.read_back(gif.with_media(docs, keep=["doc_id", "text"]), keep=["doc_id", "text"]).collect()
    assert len(back) == docs.count()
    for r in back:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64)) and r.media_bytes > 0
    shown = gif.frames(gif.with_media(docs)).collect()
    assert len(shown) == docs.count() and all(abs(sum(r.histogram) - 1) < 1e-5 for r in shown)
    broken = spark.createDataFrame([(b"GIF89a",), (None,), (b"x",)], "media binary")
    assert gif.frames(broken).count() == 0 and gif.read_back(broken).where("payload is null").count() == 3
    assert gif.with_media(empty).count() == 0
    long = gif.store(bytes(range(256)) * 1024)
    assert len(gif.decode(long).frames) == 2 and gif.payload_of(gif.decode(long)) == bytes(range(256)) * 1024


def test_gif_headers_that_claim_too_much(spark):
    import resource

    size = lambda w, h: b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0\0\0"
    image = lambda w, h: b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (0, 0, w, h)) + b"\0\x02" + block(gif.lzw_encode(b"\1", 2))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for data in (size(65535, 65535), size(65535, 65535) + image(1, 1), size(4, 4) + image(65535, 65535)):
        with pytest.raises(gif.GifError):
            gif.decode(data)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000
    df = spark.createDataFrame([(size(65535, 65535),), (size(4, 4) + image(65535, 65535),), (size(4, 4) + image(2, 2) + b"\x3b",)], "media binary")
    assert gif.frames(df).count() == 1 and gif.read_back(df).where("payload is null").count() == 2
    large = gif.store(b"a" * (64 << 20))
    assert b"".join(f.samples.tobytes() for f in gif.images(large)) == b"a" * (64 << 20)


def test_gif_of_many_small_frames_and_of_many_pixels(spark):
    import resource

    def image(x, y, w, h, samples, bits=2):
        where = b"".join(v.to_bytes(2, "little") for v in (x, y, w, h))
        return b"\x21\xf9\x04\x04\x05\0\0\0" + b"\x2c" + where + b"\0" + bytes([bits]) + block(gif.lzw_encode(samples, bits))

    head = lambda w, h: b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x81\0\0" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    small = image(100, 100, 16, 16, bytes([2] * 256))
    movie = head(640, 480) + image(0, 0, 640, 480, bytes([1]) * (640 * 480)) + small * 499 + b"\x3b"
    n = 0
    for f in gif.images(movie):
        n += 1
    assert n == 500 and f.start_ms == 499 * 50 and f.canvas[0, 0, :3].tolist() == [255, 0, 0] and f.canvas[100, 100, :3].tolist() == [0, 255, 0]
    band = block(gif.lzw_encode(bytes([3]) * (8192 * 420), 2))
    strip = lambda y, h: b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (0, y, 8192, h)) + b"\0\x02" + band
    wide = head(8192, 4200) + b"".join(strip(y, 420) for y in range(0, 4200, 420)) + b"\x3b"
    for f in gif.images(wide):
        pass
    assert f.canvas[4199, 8191, :3].tolist() == [0, 0, 255] and gif.histogram(f.canvas)[3] == 1.0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000
    df = spark.createDataFrame([(1, movie[:-1] + small), (2, b"x"), (3, None)], "k int, media binary")
    got = gif.frames(df).select("k", "index", "start_ms", "width", "delay_ms").orderBy("index").collect()
    assert [(r.k, r["index"], r.start_ms, r.width) for r in got] == [(1, i, i * 50, 16 if i else 640) for i in range(501)]
    assert gif.read_back(df.where("k = 1")).first().feature.startswith("frames=501;ms=25050;")


def test_luminance_of_colours(spark):
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    data = b"GIF89a" + (4).to_bytes(2, "little") + (1).to_bytes(2, "little") + b"\x81\0\0" + colours + b"\x2c" + bytes([0, 0, 0, 0, 4, 0, 1, 0, 0]) + b"\x02" + block(gif.lzw_encode(bytes([0, 1, 2, 3]), 2)) + b"\x3b"
    feature = gif.read_back(spark.createDataFrame([(data,)], "media binary")).first().feature
    assert f"mean={(76 + 149 + 28 + 255) / 4:.3f}" in feature


# --- 2 licences


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_texts_of_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for f, i in files.items():
        t = open(f"/usr/share/common-licenses/{f}").read()
        rows += [(i, t), (i, "Copyright (c) 2021 Some Body\n" + t.upper()), (i, re.sub(r"\blicense\b", "licence", t).replace(", ", " ; ")), (None, t + " but"), (None, t[:-40])]
    got = licenses.scan(spark.createDataFrame(rows, "want string, text string"), licenses.known_digests(spark)).collect()
    assert len(got) == len(rows) and [(r.want, r.license_id, r.text[:40]) for r in got if r.want != r.license_id] == []


def test_licence_digests(spark, docs, empty):
    known = licenses.known_digests(spark)
    mit = dict(licenses.known_licenses()[:1])["MIT"]
    texts = [
        ("a", "Copyright (c) 2020 Somebody\n" + mit.upper().replace(" ", "  ")), ("b", mit.replace("License", "Licence") + "\n"), ("c", mit + " extra"), ("d", None), ("e", ""), ("f", "(c) 2020 me"),
        ("g", "hello\nReleased under the MIT Licence\n released UNDER the mit license!\nLicensed under CC BY-NC 4.0"),
    ]
    got = {r.k: r for r in licenses.scan(spark.createDataFrame(texts, "k string, text string"), known).collect()}
    assert got["a"].license_id == got["b"].license_id == "MIT" and got["c"].license_id is None
    assert got["d"].text_digest == got["e"].text_digest == got["f"].text_digest and got["d"].license_id is None
    assert got["g"].line_licenses == ["MIT", "MIT", "CC-BY-NC-4.0"]
    # any number of known digests: lines are joined then
    many = known.union(spark.range(300).select(F.sha2(F.col("id").cast("string"), 256), F.lit("x")))
    assert {r.k: (r.license_id, r.line_licenses) for r in licenses.scan(spark.createDataFrame(texts, "k string, text string"), many).collect()} == {k: (r.license_id, r.line_licenses) for k, r in got.items()}
    # text that differs in substance has digests of its own; spellings are of whole words, copyright lines name a year or a sign
    pairs = [("(c) You must retain all notices", "(c) You may drop all notices", False), ("copyright notice, this list", "copyright notice, that list", False), ("the organism", "the organizm", False), ("x\nCopyright (c) 2020 A. B.\ny", "x\n# copyright 1999-2004 the C authors\ny", True), ("to organise, recognise; authorisation", "TO ORGANIZE recognize authorization", True), ("x\n© me", "x\n© you", False), ("copyright holders' sub-licence", "Copyright owners' sublicense", True)]
    digests = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(licenses.digest(F.col("a")), licenses.digest(F.col("b"))).collect()
    assert [a == b for a, b in digests] == [p[2] for p in pairs]
    whole = [(n, t) for n, t in licenses.known_licenses() if len(t) > 300]
    copies = spark.createDataFrame([(n, f"Copyright {1990 + i} Author {i}\n\n" + (t.upper() if i % 2 else t.replace(" ", "  "))) for n, t in whole for i in range(20)], "k string, text string")
    assert len(whole) >= 7 and licenses.scan(copies, known).where("license_id = k").count() == 20 * len(whole)
    assert licenses.scan(docs, known).count() == docs.count() and licenses.scan(empty, known).count() == 0


# --- 3 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=80), st.integers(1, 12))
def test_differencing_is_a_partition(sizes, k):
    parts = packing.differencing(sizes, k)
    assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_differencing_balances():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(3)
    sizes = [rng.randrange(1, 257) for _ in range(600)]
    sums = [sum(sizes[i] for i in p) for p in packing.differencing(sizes, 60)]
    assert max(sums) - min(sums) <= 8
    assert len(packing.windows_of([600, 600, 600], 1024)) == 3


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = docs.union(docs.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.lit("a long tale, " * 3000 + "<|endoftext|>").alias("text"), *docs.columns[2:]))
    pieces = packing.pack(df, packing.byte_bpe()).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    for doc, all_ids in want.items():
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert sum(p.length for p in mine) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            ids = [x for p in mine for x in p.ids]
            assert ids == all_ids[0] and all(p.doc_tokens == len(ids) for p in mine)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(empty, packing.byte_bpe()).count() == 0


def test_packing_has_the_ids_of_the_tokenizer_as_it_is(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers
    from sawmill.llm import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}x", f"été {end}\n\n {end} <|endoftext", "<|ENDOFTEXT|> <|endofprompt|>", None, f"  {end}  ", f"word{end}word " * 400]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.pack(df, packing.byte_bpe(added=True)).collect()
    assert [[x for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start) for x in p.ids] for i in range(len(texts))] == want
    for rows in (queries.op3_packing(spark, str(tmp_path)), corpus_pipeline.windows(spark, df, str(tmp_path))):
        assert {r.doc_id: r.doc_tokens for r in rows.collect()} == {i: len(x) for i, x in enumerate(want)}


# --- 4 factorisation machine


def test_linear_time_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    x = fm.features([b"one two three two", b"", b"A b!! c\nd | e"])
    k = 1 << fm.BITS
    m = fm.Model(0.3, rng.normal(size=k + fm.DENSE).astype(np.float32), rng.normal(size=(k + fm.DENSE, fm.RANK)).astype(np.float32), np.zeros(fm.DENSE, np.float32), np.ones(fm.DENSE, np.float32))
    got = m.parts(x)[3]
    for d in range(3):
        ids = [*x.bucket[x.first[d] : x.first[d + 1]], *range(k, k + fm.DENSE)]
        val = [*x.value[x.first[d] : x.first[d + 1]], *np.clip(x.dense[d], -4, 4)]
        y = 0.3 + sum(m.w[i] * v for i, v in zip(ids, val))
        y += sum(float(m.v[ids[a]] @ m.v[ids[b]]) * val[a] * val[b] for a in range(len(ids)) for b in range(a))
        assert abs(y - got[d]) < 1e-2 * max(1, abs(y))


def labelled(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(60)) + "."
    bad = lambda: "!! ".join(rng.choice("BUY NOW FREE CLICK".split()) for _ in range(60))
    vile = lambda: good() + " idiot " * rng.randint(1, 9) + good()
    rows = [(i, (good, bad, vile)[i % 3](), int(i % 3 != 1), int(i % 3 == 2)) for i in range(360)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_quality_on_held_out(spark, docs, empty):
    t = labelled(spark)
    labels = t.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    m = fm.train_quality(t, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = fm.score_quality(t, m).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(rows) > 40 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.97
    got = fm.score_quality(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert fm.score_quality(empty, m).count() == 0
    none = fm.train_quality(t, labels.limit(0), F.lit(True))
    assert 0 <= fm.score_quality(t, none).first().score <= 1


# --- 6 ordinal regression


def test_toxicity_on_held_out(spark, docs, empty):
    t = labelled(spark)
    m = ordinal.train_toxicity(t, t.select("doc_id", "toxic"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert (np.diff(m.theta) > 0).all()
    rows = ordinal.score_toxicity(t, m).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert np.mean([(r.p_toxic > 0.4) == (r.toxic == 1) for r in rows]) > 0.95
    assert np.corrcoef([r.text.count("idiot") for r in rows], [r.expected_severity for r in rows])[0, 1] > 0.8
    got = ordinal.score_toxicity(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.grade <= 3 for r in got)
    assert ordinal.score_toxicity(empty, m).count() == 0


def test_ordinal_likelihood_and_gradient_against_plain_ones():
    import math

    texts = ["bad bad word", "", "fine words here", "bad idiot", "word idiot idiot idiot", "fine"]
    grade = np.array([1, 0, 0, 2, 3, 0])
    x = ordinal.features([t.encode() for t in texts])
    rng = np.random.default_rng(3)
    m = ordinal.Model(rng.normal(0, 0.5, 1 << ordinal.BITS), np.array([-0.3, 0.4, 1.1]))

    def eta(model, d):
        w = textvec.words([texts[d].encode()], ordinal.PREFIX)
        keys = [int(h) >> 64 - ordinal.BITS for h in [*w.hashes, *w.prefix]]
        return sum(model.w[k] * math.log1p(keys.count(k)) for k in set(keys))

    def tail(model, d, k):
        return 1.0 if k == 0 else 0.0 if k > 3 else 1 / (1 + math.exp(model.theta[k - 1] - eta(model, d)))

    def loss(model):
        return -sum(math.log(tail(model, d, g) - tail(model, d, g + 1)) for d, g in enumerate(grade)) / len(texts)

    got = m.tails(x)
    for d in range(len(texts)):
        assert np.allclose(got[d], [tail(m, d, k) for k in (1, 2, 3)], atol=1e-5)
        assert abs(got[d].sum() - sum(k * (tail(m, d, k) - tail(m, d, k + 1)) for k in (1, 2, 3))) < 1e-5  # expected severity
    value, per = np.log1p(x.count, dtype=np.float32), np.repeat(np.arange(len(texts)), np.diff(x.first))
    gw, gt = ordinal.gradient(m, x, grade, value, per)
    for array, g, places in ((m.w, gw, np.unique(x.bucket)), (m.theta, gt, range(3))):
        for i in places:
            kept = array[i]
            array[i] = kept + 1e-4
            high = loss(m)
            array[i] = kept - 1e-4
            slope = (high - loss(m)) / 2e-4
            array[i] = kept
            assert abs(slope - g[i]) < 1e-4
    fitted = ordinal.fit(x, grade)
    assert loss(fitted) < 0.5 * loss(ordinal.Model(np.zeros(1 << ordinal.BITS), m.theta)) and (np.diff(fitted.theta) > 0).all()


# --- 5 Merkle


def test_fixity(spark):
    rows = [(i % 40 if i % 9 else None, None if i % 11 == 0 else f"http://x/{i % 50}", None if i % 13 == 0 else "<p>é" + "t" * (i * 37 % 5000)) for i in range(600)]
    pages = spark.createDataFrame(rows + rows[:30], "page_id long, url string, html string").withColumn("file", F.lit("own")).repartition(3)
    a = warc.archive(pages, file_bytes=1 << 17).persist()
    kept = a.collect()
    assert len(kept) == 630 and len({(r.file, r.offset) for r in kept}) == 630 and len({r.file for r in kept}) > 3
    rng = random.Random(1)
    picks = rng.sample(kept, 7)
    bad, lost = {(r.file, r.offset) for r in picks[:5]}, {(r.file, r.offset) for r in picks[5:]}
    spoil = lambda r: bytes([r.record[0] ^ 1]) + bytes(r.record[1:]) if (r.file, r.offset) in bad else bytes(r.record)
    b = spark.createDataFrame([(r.file, r.offset, r.length, r.id, spoil(r)) for r in kept if (r.file, r.offset) not in lost] + [("new.warc", 0, 1, 1, b"x")], a.schema)
    got = {(r.file, r.offset): r.status for r in warc.audit(a, b, 1 << 17).collect()}
    assert got == {**dict.fromkeys(bad, "changed"), **dict.fromkeys(lost, "missing"), ("new.warc", 0): "extra"}
    # repeated rows of a replica are paired one by one; an insertion moves what follows in its file
    twice = a.where("offset < 3000").limit(2)
    assert sorted(r.status for r in warc.audit(a, a.union(twice), 1 << 17).collect()) == ["extra", "extra"] and warc.audit(a.union(twice), a.union(twice), 1 << 17).count() == 0
    moved = a.withColumn("offset", F.when(F.col("file") == kept[0].file, F.col("offset") + 10).otherwise(F.col("offset")))
    assert {r.file for r in warc.audit(a, moved, 1 << 17).collect()} == {kept[0].file}
    assert warc.audit(a, a, 1 << 17).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_archive_keys_of_many_partitions(spark):
    n = 5 * spark.sparkContext.defaultParallelism
    pages = spark.range(0, 40 * n, 1, n).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    a = written(warc.archive(pages, file_bytes=1 << 12), "many")
    assert a.count() == 40 * n == a.select("file", "offset").distinct().count()
    assert warc.audit(a, a, file_bytes=1 << 12).count() == 0


# --- 7 CRF


def test_viterbi_and_likelihood_against_brute_force():
    import itertools

    pages = [(found, labels) for _, found, labels in labelled_pages.labelled_pages(40) if 1 < len(found) < 11][:6]
    f = crf.train(pages, rounds=30)
    for found, _ in pages:
        def value(ys):
            v = f.start[ys[0]] + f.stop[ys[-1]] + sum(f.move[a][b] for a, b in zip(ys, ys[1:]))
            return v + sum(sum(f.weight.get(x, 0.0) for x in b.features) for b, y in zip(found, ys) if y)

        best = max(itertools.product((0, 1), repeat=len(found)), key=value)
        assert abs(value(f.labels(found)) - value(best)) < 1e-9


def test_extraction(spark):
    pages = labelled_pages.labelled_pages(700)
    f = crf.train([(b, y) for _, b, y in pages[:500]])
    hits = [a == b for _, found, y in pages[500:] for a, b in zip(f.labels(found), y)]
    assert np.mean(hits) > 0.98
    html = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>First  para\n text<br>goes&nbsp;on.<p>Second <b>one</b>.</p></article><section id="comments"><p>I like it very much.</p></section><footer>&copy; x</footer>'
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p"), (5, "<div>" * 500)], "page_id long, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r.text for r in crf.extract(df, f).collect()}
    assert got[1] == "A & B\nFirst para text goes on.\nSecond one." and got[2] == got[3] == got[4] == got[5] == ""
    assert crf.extract(df.limit(0), f).count() == 0


def test_nothing_goes_but_scripts_and_styles():
    text = lambda page: [b.text for b in crf.blocks(page)]
    for tag in ("svg", "math", "object", "canvas", "template"):
        assert text(f'<p>a</p><{tag} class="i"/><article><p>b</p></article>') == ["a", "b"]
        assert text(f"<p>a</p><{tag}><article><p>b</p></article>") == ["a", "b"]
        assert text(f"<article><p>a <{tag}><x>b</x></{tag}> c</p></article>") == ["a b c"]
    assert text("<p>a</p><svg><style/><path/></svg><p>b</p><script src='x'/>var c;</script><p>d</p><STYLE>e") == ["a", "b", "d"]


def test_deep_and_broken_pages():
    """Memory and time follow the size of a page, however its elements nest."""
    import time
    import tracemalloc

    f = crf.train([(b, y) for _, b, y in labelled_pages.labelled_pages(60)], rounds=20)
    deep = "".join(f'<div class="deep{i} k{i}">text {i}' for i in range(20_000))
    began = time.monotonic()
    tracemalloc.start()
    found = crf.blocks(deep)
    f.labels(found)
    assert len(found) == 20_000 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    stray = "<div>" * 5000 + "</p>x" * 40_000
    assert len(crf.blocks(stray)) == 1
    assert len(crf.blocks("<center>" * 20_000 + "x" + "<li>a<ins>" * 20_000)) == 20_001
    assert time.monotonic() - began < 60
    page = '<div class="a b"><p id="b">one</p><p class="c">two<section class="a d"><p>three</section>four'
    assert [sorted(x for x in b.features if x.startswith("in ")) for b in crf.blocks(page)] == [
        sorted("in " + x for x in names) for names in (["t:div", "c:a", "c:b", "t:p"], ["t:div", "c:a", "c:b", "t:p", "c:c"], ["t:div", "c:a", "c:b", "t:section", "c:d", "t:p"], ["t:div", "c:a", "c:b"])
    ]
    assert np.allclose(f.evidence(found[:50]), [sum(f.weight.get(x, 0.0) for x in b.features) for b in found[:50]])


# --- 8 Wu-Manber


def plain_scan(text, items, window=13):
    w = plain_words(text)
    hit, names = [False] * len(w), set()
    for name, item in items:
        p = plain_words(item)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if p else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    names.add(name)
                    hit[j : j + m] = [True] * m
    return len(w), sum(hit), names


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c dd é".split()), max_size=40), max_size=5), st.lists(st.lists(st.sampled_from("a b c dd é".split()), max_size=20), max_size=5))
def test_search_finds_all_occurrences(texts, items):
    texts = [" ".join(t) for t in texts]
    named = [(str(i), "-".join(x)) for i, x in enumerate(items)]
    found = wumanber.scan([t.encode() for t in texts], wumanber.searchers([(n, x.encode()) for n, x in named], 13))
    for t, (n, spans, names) in zip(texts, found):
        assert (n, sum(e - b for b, e in spans), {named[k][0] for k in names}) == plain_scan(t, named)


def test_decontamination_in_passes(spark, docs, empty):
    base = docs.where("doc_id = 1").first().text.split()
    items = [(1, " ".join(base[10:40])), (2, "ONE, two"), (3, None), (4, ""), (5, "y"), (None, "same same"), (7, " ".join(base[30:60])), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items if t]
    for size in (1 << 20, 150):
        got = wumanber.decontaminate(docs, bench, pass_bytes=size).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, sum(s.end - s.begin for s in r.hit_spans), set(r.item_ids)) == plain_scan(r.text, named), (size, r.doc_id)
            assert r.item_ids == sorted(r.item_ids)
    assert wumanber.decontaminate(empty, bench).count() == 0
    assert wumanber.decontaminate(docs, bench.limit(0)).where("size(item_ids) > 0").count() == 0


def test_memory_of_a_searcher():
    import pickle
    import tracemalloc

    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(5000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=100)).encode()) for i in range(3000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    made = wumanber.searchers(items, 13)
    assert tracemalloc.get_traced_memory()[1] < 40 * size and len(pickle.dumps(made)) < 10 * size + (1 << 24)
    tracemalloc.stop()
    texts = [b"x y " + items[7][1][20:300].upper() + b" z", b"nothing here"]
    found = wumanber.scan(texts, made)
    assert found[0][2] == {7} and found[1][1] == []


# --- 9 chat

piece = st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "a", "<", "[", "/", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "tool", ""]), piece), piece), max_size=5))
def test_conversations_come_back(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def test_chat_digests(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, None, None), (None, 3, "assistant", "x"), (None, None, "user", ""), (3, 0, "assistant", "é\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("own"))
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in turns.collect():
        assert chat.unescaped(r.rendered[r.text_begin : r.text_end]) == r._text and r.in_loss == (r._role == "assistant")
    # a mask that is off shows in the loss alone
    for off in (turns.withColumn("text_begin", F.col("text_begin") + 2), turns.withColumn("text_end", F.col("text_end") - 1), turns.withColumn("in_loss", ~F.col("in_loss"))):
        wrong = {r.conv_id: r for r in chat.read_back(off).collect()}
        assert wrong[1].loss_sha256 != got[1].loss_sha256 and wrong[1].turns_sha256 == got[1].turns_sha256
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- 10 near-duplicates


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_alignment_is_exact(a, b, most):
    d = levenshtein(a, b)
    assert omh.edits_within(a, b, most) == (d if d <= most else None)
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert omh.similar(x, y, 0.6) == (d <= int(0.4 * max(len(a), len(b)) + 1e-9))


def brute_classes(rows, similarity=0.8):
    """Classes of (id, text) by comparing all pairs."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    w = [(i, t or "", plain_words(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(w):
        for j, u, b in w[:k]:
            n = max(len(a), len(b))
            if t == u or (n and min(len(a), len(b)) >= similarity * n and levenshtein(a, b) <= int((1 - similarity) * n + 1e-9)):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in rows}


def test_classes_against_all_pairs(spark, docs, empty):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, n = [], 100
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 120)) + (passage if g % 2 else [])
        for c in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, "?!"), (n + 4, "just two"), (n + 5, "just two")]
    got = {r.row_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    mine = omh.near_duplicates(docs).collect()
    assert len(mine) == docs.count()
    of = {r.row_id: r.class_id for r in mine}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[7] == of[8] == 7 and of[9] == 9
    assert omh.near_duplicates(empty).count() == 0
    left = omh.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 5, 7, 9, 10, 11, 12, 13]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=19), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 18), st.integers(1, 9)), max_size=3), st.sampled_from([0.8, 0.7, 0.5]))
def test_short_links_share_a_key(a, edits, similarity):
    b = list(a)
    for kind, at, word in edits:
        b[min(at, len(b)) : min(at, len(b)) + (kind > 0)] = [word] if kind < 2 else []
    n = max(len(a), len(b))
    if b and n <= omh.covered(similarity) and levenshtein(a, b) <= int((1 - similarity) * n + 1e-9):
        x, y = (set(omh.exact_keys(np.array(v, np.uint64), similarity)) for v in (a, b))
        assert x & y


def test_short_texts_are_linked(spark):
    assert omh.covered(0.8) == 19
    rng = random.Random(11)
    rows, pairs = [], []
    for n in range(3, 20):
        for _ in range(6):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = list(a)
            most = int(0.2 * n + 1e-9)
            for e in range(most):  # evenly spread
                b[(2 * e + 1) * n // (2 * most)] = f"x{rng.randrange(10**6)}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b).upper())]
    rows += [(9000, "one two three four five six seven"), (9001, "one two three four five six eight"), (9002, "one two three four five nine eight")]
    got = {r.row_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] == a for a, b in pairs)
    assert got == brute_classes([(i, t) for i, t in rows])


@pytest.mark.parametrize("similarity", [0.8, 0.81, 0.85, 0.9])
@pytest.mark.parametrize("spread", ["evenly", "anywhere", "mixed kinds"])
def test_recall_of_candidates(similarity, spread):
    """Pairs right at a similarity, the edits spread evenly (the worst case) or anywhere: nine of ten share a band."""
    rng = random.Random(int(100 * similarity) + len(spread))
    found, pairs = 0, 150
    for _ in range(pairs):
        n = rng.choice([40, 100, 200, 400])
        a = [f"v{rng.randrange(3000)}" for _ in range(n)]
        most = int((1 - similarity) * n + 1e-9)
        places = [(2 * e + 1) * n // (2 * most) for e in range(most)] if spread == "evenly" else sorted(rng.sample(range(n), most))
        b = list(a)
        for at in reversed(places):
            kind = rng.randrange(3) if spread == "mixed kinds" else 0
            b[at : at + (kind != 1)] = ["x"] if kind == 0 else ["y", "z"][:1] if kind == 1 else []
        w = textvec.words([" ".join(a).encode(), " ".join(b).encode()])
        (s, f), (t, g) = textvec.shingles(w, 5), textvec.shingles(w, 3)
        bands = [{*omh.sketch(s[f[i] : f[i + 1]]).tolist(), *omh.sketch(t[g[i] : g[i + 1]], omh.SPREAD_BANDS, omh.PICKS, omh.BANDS).tolist()} for i in (0, 1)]
        found += bool(bands[0] & bands[1])
    assert found >= 0.9 * pairs, found


@pytest.mark.parametrize("n", [20, 25, 30, 35, 40, 50, 60, 75])
def test_recall_of_short_texts(n):
    """Each length by itself, pairs right at 0.8 with evenly spread substitutions, by all keys that a text has."""
    rng = random.Random(n)
    found, pairs, last = 0, 200, omh.covered(0.8)
    for _ in range(pairs):
        a = [f"v{rng.randrange(3000)}" for _ in range(n)]
        most = int(0.2 * n + 1e-9)
        b = list(a)
        for e in range(most):
            b[(2 * e + 1) * n // (2 * most)] = f"x{e}"
        w = textvec.words([" ".join(a).encode(), " ".join(b).encode()])
        (s, f), (t, g) = textvec.shingles(w, 5), textvec.shingles(w, 3)
        keys = []
        for i in (0, 1):
            own = w.hashes[w.first[i] : w.first[i + 1]]
            k = {*omh.sketch(s[f[i] : f[i + 1]]).tolist(), *omh.sketch(t[g[i] : g[i + 1]], omh.SPREAD_BANDS, omh.PICKS, omh.BANDS).tolist()}
            if n <= omh.CLOSE_WORDS:
                k |= set(omh.sketch(omh.neighbours(own), omh.CLOSE_BANDS, omh.PICKS, omh.BANDS + omh.SPREAD_BANDS).tolist())
            keys.append(k)
        found += bool(keys[0] & keys[1]) or n <= last
    assert found >= 0.9 * pairs, found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30), st.lists(st.integers(0, 40), max_size=30), st.integers(1, 60))
def test_only_far_pairs_are_ruled_out(a, b, times):
    a, b = a * times, b * times
    x, y = ((np.array(v, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) for v in (a, b))
    bags = [np.frombuffer(omh.bag(v), np.uint8)[None] for v in (x, y)]
    if omh.similar(x, y, 0.8):
        assert omh.plausible(np.array([len(a)]), bags[0], np.array([len(b)]), bags[1], 0.8).all()


def test_spread_edits_are_linked(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        a = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([30, 60, 150, 300]))]
        b = list(a)
        most = int((0.2, 0.19, 0.15, 0.1)[k % 4] * len(a) + 1e-9)
        for e in range(most):
            b[(2 * e + 1) * len(a) // (2 * most)] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.row_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert sum(got[i] == want[i] for i in range(1, len(rows), 2)) >= 54 and all(got[i] == i or got[i] == want[i] for i in got)


def test_leftovers_meet_in_tiles(spark):
    """A bucket of many unlike texts around one shared passage, and links that no leader sees."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(70):
        rows.append((i, " ".join([f"own{rng.randrange(3000)}" for _ in range(30)] + passage)))
    base = rows[50][1].split()
    rows += [(200 + c, " ".join([*base[:c], "edit", *base[c + 1 :]])) for c in range(5)]
    got = {r.row_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_large_buckets_are_copied_few_times(spark):
    """10,000 unlike texts of 200 words in a bucket: copies of its texts in all tiles."""
    rows = spark.sql("SELECT 10000L AS all, 2000000L AS words, named_struct('k', 1L, 'words', 200L) AS x").select("all", *omh._grid("all", "words"))
    r = rows.first()
    assert r.blocks * r.chunks > 1 and r["all"] * (r.blocks + r.chunks) <= 8 * r["all"]


def test_tiles_of_several_blocks(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"own{rng.randrange(3000)}" for _ in range(25)] + passage)) for i in range(60)]
    base = rows[40][1].split()
    rows += [(200 + c, " ".join([*base[:c], "edit", *base[c + 1 :]])) for c in range(5)]
    monkeypatch.setattr(omh, "HELD", 16)
    monkeypatch.setattr(omh, "STREAMED", 24)
    tiled, rows_of = omh._tiled, []

    def counted(mates, *a):
        rows_of.append(mates.count())
        return tiled(mates, *a)

    monkeypatch.setattr(omh, "_tiled", counted)
    got = {r.row_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert rows_of[0] <= 12 * len(rows), rows_of  # not a row a text and band


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.id: r.root for r in omh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert omh.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    t = labelled(spark)
    rows = [(i, " ".join(f"alpha{i} beta gamma{j % 9}" for j in range(30)) + ".") for i in range(400, 420)]
    passage = " ".join(f"secret{j}" for j in range(20))
    rows += [(500, rows[0][1]), (501, rows[1][1] + " " + passage), (502, None), (503, "")]
    docs = t.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), "score": F.lit("own"), "n_words": F.lit(-1)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    t.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [kept.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(kept.count())
        assert kept.exceptAll(docs).count() == 0
    assert sizes == sorted(sizes, reverse=True)
    ids = {r.doc_id for r in kept.collect()}
    assert 501 not in ids and 500 not in ids and not any(i < 360 and i % 3 in (1, 2) for i in ids)
    assert {i for i in ids if 400 <= i < 420} >= {400, 402, 410}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    bare = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        bare_out = stage(spark, bare, str(tmp_path))
        assert bare_out.count() == 0


def test_lzw_with_a_table_that_stays_full():
    """No clear code follows a full table; codes are checked against a plain decoder, also with an end at any sample."""
    rng = np.random.default_rng(5)
    clear, end, table, words, packed, at, prev = 256, 257, [bytes([i]) for i in range(256)] + [b"", b""], [], 256, 9, None
    for seen in range(6000):
        top = len(table) + (prev is not None and len(table) < 4096)
        code = int(rng.integers(258, top)) if top > 258 and rng.random() < 0.7 else int(rng.integers(0, 256))
        packed |= code << at
        at += min(end + seen, 4095).bit_length()
        word = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + word[:1])
        words.append(word)
        prev = word
    packed |= end << at
    data, plain = packed.to_bytes((at + 12 + 7) // 8, "little"), b"".join(words)
    assert gif.lzw_decode(data, 8, 1 << 28) == plain
    for most in (0, 1, 999, len(plain) - 1):
        assert gif.lzw_decode(data, 8, most) == plain[:most]
    with pytest.raises(gif.GifError):
        gif.lzw_decode((256 | 300 << 9 | end << 18).to_bytes(4, "little"), 8, 100)
