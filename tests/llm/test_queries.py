"""Every opN query over the smallest tables: with DuckDB's SQL, or against a plain version."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sawmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(None if v is None or v != v else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_rows(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(queries.SQL[name]).fetchdf())


def test_media(spark, duck):
    got = {r.doc_id: r for r in queries.op1_gif_media(spark, SF).collect()}
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_packing_leaves_little_padding(spark, duck):
    from tokenizers import Tokenizer

    import public_tokenizers

    got = queries.op3_packing(spark, SF).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in got[got.doc_id == doc].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert (pieces.offset.to_numpy() == np.concatenate(([0], np.cumsum(pieces.length)[:-1]))).all()
    assert got.groupby("doc_id").length.sum().equals(got.groupby("doc_id").doc_tokens.first())
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.97


def test_scores(spark, duck):
    truth = {i: (q, t) for i, q, t in duck.execute("select * from labels").fetchall()}
    for f, k, least in ((queries.op4_factorisation_machine, 0, 0.9), (queries.op6_ordinal_toxicity, 1, 0.8)):
        got = f(spark, SF).collect()
        assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
        assert np.mean([r.predicted == truth[r.doc_id][k] for r in got if r.doc_id in truth]) >= least


def test_articles(spark, duck):
    got = {r.page_id: r for r in queries.op7_crf_extraction(spark, SF).collect()}
    for page, text in duck.execute("select page_id, html from pages").fetchall():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", text, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[page].text == "\n".join(w for w in want if w) and got[page].n_chars == len(got[page].text)


def test_classes_hold_the_copies(spark, duck):
    got = {r.doc_id: r.class_id for r in queries.op10_order_minhash(spark, SF).collect()}
    for ids in duck.execute("select list(doc_id) from documents group by text").fetchall():
        assert len({got[i] for i in ids[0]}) == 1
    assert all(got[c] == c <= i for i, c in got.items())
