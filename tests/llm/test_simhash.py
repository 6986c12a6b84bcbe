import numpy as np
import xxhash

from quiver.llm import simhash as S
from quiver.llm.common import table


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=3):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def test_words_and_hash():
    for t in (None, "", " \n", "One", "one two", "A b c D", "É x\x0by z é", "a b c d " * 50):
        assert S.fingerprint(t) == plain(t)


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = sorted(tuple(r) for r in S.simhash_components(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_blocks_and_forest_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(12))]))
    tiles = S._tiles(fps)
    plan = S.Deal({int(t): int(n) for t, n in zip(*np.unique(tiles, return_counts=True), strict=True)}, 3, 4)
    dealt = {}
    for f, t in zip(fps, tiles, strict=True):
        b = int(S._blocks(np.array([f]), plan.split[int(t)])[0])
        for k, r in plan.tasks(int(t), b):
            dealt.setdefault(k, []).append((f, r))
    label = np.arange(len(fps))
    for rows in dealt.values():
        a, b = S.forest(np.array([x for x, _ in rows]), np.array([r for _, r in rows], np.int8), 3)
        assert len(a) < len(rows) and (np.bitwise_count(a ^ b) <= 64).all()
        S._union(label, np.searchsorted(fps, a), np.searchsorted(fps, b))
    want = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    S._union(want, i, j)
    assert np.array_equal(label, want)


def test_every_pair_of_blocks_meets_once():
    rng = np.random.default_rng(2)
    sizes = {int(t): int(n) for t, n in zip(rng.choice(1089, 400, replace=False), rng.integers(1, 90, 400), strict=True)}
    plan = S.Deal(sizes, 3, 8)
    dealt = {}
    for t in sizes:
        for b in range(plan.split[t]):
            for k, r in plan.tasks(t, b):
                dealt.setdefault(k, []).append(((t, b), r))
    met = []
    for members in dealt.values():
        home = [x for x, r in members if r != 1]
        assert len(home) == 1 and len(members) <= 200
        met += [(home[0], x) for x, r in members if r == 1]
        met += [(x, x) for x, r in members if r == 0]
    units = [(t, b) for t in sizes for b in range(plan.split[t])]
    want = {(x, y) for x in units for y in units if x <= y and abs(x[0] // 33 - y[0] // 33) + abs(x[0] % 33 - y[0] % 33) <= 3}
    assert len(met) == len(set(met)) and set(met) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "a " * 9000), (None, "x y z q"), (4, "x y z q")]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, fp string, component_id int, task int")
    got = {(r.doc_id, r.component_id) for r in S.simhash_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 4), (4, 4)}
    assert S.simhash_components(df.limit(0)).count() == 0
