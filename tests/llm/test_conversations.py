import duckdb

from quiver.llm import conversations as C
from quiver.llm.common import table


def plain(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {}
    for c, ts in convs.items():
        seqs.setdefault(tuple((r, x) for *_, r, x in sorted(ts)), []).append(c)
    out = set()
    for s, cs in seqs.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs):
            out.add((min(cs), len(s), len(cs), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s)))
    return out


def got(df):
    return {tuple(r) for r in C.render(df).collect()}


def test_query_equals_brute_force_and_sql(spark, sf):
    df = table(spark, sf, "conversations")
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert got(df) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert set(con.execute(C.oracle()).fetchall()) == want


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"),
        (4, 5, "user", "hi"), (4, 9, "assistant", "yo"), (4, 10, "user", None), (5, None, None, "x" * 200_000), (5, 0, "", None), (None, 0, "user", "lost"), (6, 0, "user", "a"), (6, 0, "user", "b"), (7, 0, "user", "other"),
    ]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    want = plain(rows)
    g = got(df)
    assert {r[:3] for r in g} == {r[:3] for r in want} and len(g) == 4
    assert {r[3] for r in g if r[0] != 6} == {r[3] for r in want if r[0] != 6}
    assert C.render(df.limit(0)).count() == 0
