import random
import re
import zlib

import numpy as np
import sentencepiece
import xxhash

from quiver.llm import queries
from quiver.llm import subwords as S
from quiver.llm.common import table

MODEL = S.load(S.default_model())


def odd_texts():
    rnd = random.Random(5)
    return ["", " ", "a", "▁", "\n", "x" * 40_000, " " * 500, *("".join(rnd.choice(" ▁abcthe日本😀\n\t\r\x00é;)") for _ in range(rnd.randrange(0, 80))) for _ in range(300))]


def test_without_dropout_equals_the_library(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    texts = [r.text for r in table(spark, sf, "documents").collect()] + odd_texts()
    for t, ids in zip(texts, S.Encoder(MODEL, 0.0, 1).encode(texts), strict=True):
        assert S.decode(MODEL, ids) == t
        if S.SPACE not in t:
            assert ids.tolist() == sp.encode(t)


def test_rows_at_a_time_equal_the_agenda(monkeypatch):
    rnd = random.Random(2)
    runs = [S.SPACE * rnd.randrange(0, 4) + "".join(rnd.choice("theiandorszé日") for _ in range(rnd.randrange(1, 45))) for _ in range(1500)]
    runs += [S.SPACE + "international"] * 300
    bases = S.bases_of(77, len(runs))
    for p in (0.0, 0.1, 0.5, 1.0):
        flat, counts = S.Runs(MODEL, p).encode(runs, bases)
        ends = np.r_[0, np.cumsum(counts)]
        for i, r in enumerate(runs):
            assert flat[ends[i] : ends[i + 1]].tolist() == S.encode_run(MODEL, r, int(bases[i]), p)
        for bound, least in (("STATE_BYTES", 1), ("NAMES", 1), ("WALK", 64)):
            with monkeypatch.context() as m:  # what is kept, and how many walk together, changes nothing
                m.setattr(S, bound, least)
                again = S.Runs(MODEL, p)
                parts = [again.encode(runs[k : k + 200], bases[k : k + 200])[0] for k in range(0, len(runs), 200)]
            assert np.array_equal(np.concatenate(parts), flat)


def test_one_word_has_many_segmentations():
    ids = S.Encoder(MODEL, 0.1, 1).encode(["international " * 12_000])[0]
    cuts = np.flatnonzero([MODEL.spelled[i].startswith(b" ") for i in ids.tolist()])
    assert len({tuple(x) for x in np.split(ids, cuts)}) > 60


def plain_ids(text, p, seed):
    """Written from the module's text alone: characters, the best join first, each candidate under its own hash."""
    m, mask = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    key, out = xxhash.xxh64_intdigest(text.encode(), seed), []
    for nr, run in enumerate(re.findall("▁*[^▁\n\t]+|▁+|[\n\t]", "▁" + text.replace(" ", "▁")) if text else [], 1):
        x = (nr * mask[0] + key) & m
        x = (x ^ x >> 30) * mask[1] & m
        x = (x ^ x >> 27) * mask[2] & m
        base = x ^ x >> 31
        parts, skipped = [(i, c) for i, c in enumerate(run)], set()
        while True:
            joins = [(MODEL.rank[MODEL.ids[a[1] + b[1]]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[1] + b[1] in MODEL.ids and (a, b) not in skipped]
            if not joins:
                break
            k = min(joins)[1]
            a, b = parts[k : k + 2]
            y = base ^ (a[0] * mask[0] & m) ^ (MODEL.ids[a[1] + b[1]] * mask[1] & m)
            y = (y ^ y >> 29) * mask[2] & m
            y = (y ^ y >> 32) * mask[0] & m
            if (y >> 11) * 2.0**-53 < p:
                skipped.add((a, b))
            else:
                parts[k : k + 2] = [(a[0], a[1] + b[1])]
        for _, piece in parts:
            out += [MODEL.ids[piece]] if piece in MODEL.ids else [MODEL.byte[v] for v in piece.encode()]
    return out


def test_query_equals_plain_code(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: (r.n_chars, r.n_ids, r.ids_crc32) for r in S.segmentation_report(docs).collect()}
    for r in docs.collect():
        ids = plain_ids(r.text, S.DROPOUT, 1)
        assert got[r.doc_id] == (len(r.text), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_dropout_varies_by_seed_and_text_and_decodes(monkeypatch):
    texts = odd_texts() + ["the same words here and there " * 20] * 2
    one, two = (S.Encoder(MODEL, 0.2, s).encode(texts) for s in (1, 2))
    assert all(S.decode(MODEL, x) == t for x, t in zip(one, texts, strict=True))
    assert one[-1].tolist() == one[-2].tolist() != two[-1].tolist()
    plain = S.Encoder(MODEL, 0.0, 1).encode(texts)
    assert len(one[-1]) > len(plain[-1]) and len({tuple(x) for x in np.array_split(one[-1], 20)}) > 3
    monkeypatch.setattr(S, "STEP", 50)
    small = S.Encoder(MODEL, 0.2, 1)
    assert [x.tolist() for t in (texts[:40], texts[40:]) for x in small.encode(t)] == [x.tolist() for x in one]


def test_share_of_dropped_candidates():
    x = S._chance(np.arange(100_000, dtype=np.uint64), np.zeros(100_000, np.int64), np.full(100_000, 7))
    assert abs((x < 0.1).mean() - 0.1) < 0.005


def test_query_and_odd_rows(spark, sf):
    rows = queries.op10_subwords(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(r.lossless for r in rows)
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, "né 😀▁ x", "k")], "doc_id long, text string, ids string")
    out = S.decode_column(S.encode(df), "ids", "again").collect()
    assert [(r.doc_id, r.again) for r in out] == [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((r.doc_id or 0, r.n_chars, r.lossless) for r in S.segmentation_report(df).collect()) == [(0, 7, True), (1, 0, True), (2, 0, True), (2, 0, True)]
    assert S.encode(df.limit(0)).count() == 0 and S.segmentation_report(df.limit(0)).count() == 0
