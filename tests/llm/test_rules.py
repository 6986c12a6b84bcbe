import duckdb

from quiver.llm import queries
from quiver.llm import rules as R
from quiver.llm.common import table


def plain_repeats(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + d for i, w in enumerate(wins) if wins.count(w) > 1 for d in range(5)})


def test_repeats_equal_plain_code():
    for t in ("", "a", "a b c d e", "a b c d e a b c d e", "x " * 30, "a b c d e f a b c d e g b c d e f", "a a a a a a b"):
        assert R.repeated_words(t.split()) == plain_repeats(t.split())


def test_query_equals_sql(spark, sf):
    got = queries.op4_quality_rules(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.execute(R.oracle())
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(got.columns)
    want = set(res.fetchall())
    rows = {tuple(r) for r in got.select(*cols).collect()}
    assert rows == want and sum(r[-1] for r in rows) > 500


def test_order_follows_rate_and_changes_no_verdict(spark, sf):
    df = table(spark, sf, "documents").limit(200)
    verdicts = [{(r.doc_id, r.kept) for r in R.apply_rules(df, order=o).collect()} for o in (list(R.RULES), list(R.RULES)[::-1])]
    assert verdicts[0] == verdicts[1]
    texts = ["word of some kind " + str(i) + " more and more to read here now" for i in range(50)] + ["a# b# c# d# e# f# g# h# i# j# " + str(i) for i in range(50)]
    slow = {"slow": lambda t: sum(range(20_000)) < 0, "hit": lambda t: t.n_symbols > 5, "never": lambda t: False}
    assert R.plan(texts, slow) == ["hit", "never", "slow"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "good words in a row that stand here for all to see"), (None, "é " * 100_000), (4, "a\x0bb\x0cc\xa0d e f g h i j k l")]
    df = spark.createDataFrame([(*r, "k", 5, "mine") for r in rows], "doc_id long, text string, kept string, n_words int, __rules string")
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in R.apply_rules(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, True, False), (2, 0, True, False), (2, 0, True, False), (3, 12, False, True), (None, 100_000, True, False), (4, 11, False, False)], key=str)
    assert R.apply_rules(df.limit(0)).count() == 0
    assert {r["__rules"] for r in R.apply_rules(df).collect()} == {"mine"} and R.apply_rules(df).columns[:3] == ["doc_id", "text", "__rules"]
