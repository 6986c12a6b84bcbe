import zlib

import numpy as np
from tokenizers import Tokenizer

from quiver.llm import packing as P
from quiver.llm.common import table


def test_sum_of_squares_equals_plain_search():
    rng = np.random.default_rng(3)
    for cap in (7, 20):
        sizes = rng.integers(1, cap + 1, 300)
        bins, offsets = P.sum_of_squares(sizes, cap)
        gaps, seen = {}, []
        for k, s in enumerate(sizes):
            def cost(g):
                left = [x for x in gaps.values() if 0 < x]
                if g is not None:
                    left.remove(g)
                left.append((cap if g is None else g) - s)
                return sum(left.count(x) ** 2 for x in set(left) if x)
            fits = sorted({g for g in gaps.values() if g >= s})
            g = min(fits, key=cost) if fits else None
            assert (gaps.get(int(bins[k]), None) == g) if g is not None else int(bins[k]) not in gaps
            assert offsets[k] == cap - gaps.get(int(bins[k]), cap)
            gaps[int(bins[k])] = gaps.get(int(bins[k]), cap) - s
            seen.append(bins[k])
        assert min(gaps.values()) >= 0


def check(rows, texts, cap=P.MAX_TOKENS):
    tok = Tokenizer.from_file(P.default_tokenizer())
    for d, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == cap for r in own[1:])
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs)


def test_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(300)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = P.pack(docs).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= 1.01 * -(-sum(r.length for r in rows) // P.MAX_TOKENS) + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b  \n\t x", 4: "né 😀 " * 9000, 5: "x" * 5000}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, id int, length int")
    check(P.pack(df, group=2).collect(), texts)
    twice = P.pack(df.union(df), with_ids=True).collect()
    assert len(twice) == 2 * len(P.pack(df).collect()) and all(len(r.ids) == r.length for r in twice)
    assert P.pack(df.limit(0)).count() == 0
