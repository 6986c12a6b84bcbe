import hashlib
import random

from quiver.llm import piecewise as P
from quiver.llm.common import table

M = (1 << 64) - 1


def plain_print(text):
    data = (text or "").encode()

    def roll(i):
        h = 0
        for k in range(min(P.WINDOW, i + 1)):
            h = h + (data[i - k] + 1) * (0x85EBCA6B * (2 * k + 1) ** 3) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 13

    rolls = [roll(i) for i in range(len(data))]

    def sign(block):
        out, start = "", 0
        for i, r in enumerate(rolls):
            if i + 1 == len(data) or (r % block == block - 1 and len(out) < P.LENGTH - 1):
                x = sum((c + 1) * pow(int(P._MULT), j, 1 << 64) for j, c in enumerate(data[start : i + 1])) & M
                x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & M
                out, start = out + P.ALPHABET[(x ^ x >> 29) >> 40 & 63], i + 1
        return out

    block = P.LEAST_BLOCK
    while block * P.LENGTH < len(data):
        block *= 2
    while block > P.LEAST_BLOCK and sum(r % block == block - 1 for r in rolls) + 1 < P.LENGTH // 2:
        block //= 2
    return ":".join([str(block), *(sign(block << k) for k in range(P.LEVELS))])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_fingerprint_equals_plain_code(monkeypatch):
    rnd = random.Random(0)
    texts = [None, "", "a", "é" * 5, "ab" * 400, *("".join(rnd.choice("abcdé \n") for _ in range(n)) for n in (6, 7, 8, 63, 500, 2500))]
    for t in texts:
        assert P.fingerprint(t) == plain_print(t)
    want = [P.fingerprint(t) for t in texts]
    monkeypatch.setattr(P, "STEP", 97)
    assert [P.fingerprint(t) for t in texts] == want


def test_distance_and_likeness():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 65))) for _ in "xy")
        assert P.edit_distance(a, b) == plain_distance(a, b)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    assert P.likeness(P.fingerprint(text), P.fingerprint(text[:3000] + "zz" + text[3000:])) > 0.9
    assert P.likeness(P.fingerprint(text), P.fingerprint(text[:3000])) > 0.35
    assert P.likeness(P.fingerprint(text), P.fingerprint(text[::-1])) < 0.1
    assert P.likeness(None, "3:::") == 0 and P.likeness("3:::", "3:::") == 1


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        f = [P.fingerprint(x) for x in (t, e, u)]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], P.likeness(f[0], f[1]), P.likeness(f[0], f[2])))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    for n in (5000, 70):
        assert sorted((tuple(r) for r in P.edited_next(docs, rows=n).collect()), key=str) == want
    near = sorted(r[5] for r in want)
    assert near[len(near) // 20] > 0.35


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (1, "b" * 9), (None, "nul"), (None, None), (9, "é😀" * 30_000), (5, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    for n in (100, 2, 1):
        assert sorted((tuple(r) for r in P.edited_next(df, rows=n).collect()), key=str) == brute(rows)
    one = df.where("doc_id = 5")
    assert [tuple(r) for r in P.edited_next(one).collect()] == brute([(5, "x")])
    assert P.edited_next(df.limit(0)).count() == 0 and P.fingerprints(df).columns == ["doc_id", "text", "part", "fingerprint"]
