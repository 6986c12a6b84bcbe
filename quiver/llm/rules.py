"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiver.llm.common import per_batch

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

#: Texts on which costs and selectivities are estimated. It sets the order of rules, never what they decide.
SAMPLE = 500

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_CAPITALS, _SMALL = re.compile("[A-Z]{2}"), re.compile("[a-z]")
_BULLET, _ELLIPSIS = re.compile(r"(?m)^[ \t]*[-*•]"), re.compile(r"(?m)(?:\.\.\.|…)[ \t]*$")


def repeated_words(words: list[str]) -> int:
    """Words that stand in some window of five words found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code, kinds = ids[:n], len(number)  # rank of the window's first k words, one word longer each time: exact
    for k in range(1, WINDOW):
        _, code = np.unique(code * kinds + ids[k : k + n], return_inverse=True)
    often = np.bincount(code)[code] > 1
    if not often.any():
        return 0
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


@dataclass
class Text:
    """A text and what the base rule has counted in it."""

    text: str
    words: list[str]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def measure(text: str | None) -> Text:
    """Counts of the base rule over the whole text; null has no words."""
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    return Text(text, words, len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated_words(words))


def base_failed(t: Text) -> bool:
    return t.n_words < LEAST_WORDS or 100 * t.n_repeat_words > MOST_REPEATED * t.n_words


#: Rules of the cascade by name: true rejects. Each reads one text alone, so their order changes cost, not verdicts.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "dup_lines": lambda t: 2 * t.n_dup_lines > t.text.count("\n") + 1,
    "letters": lambda t: 2 * sum(1 for w in t.words if _LETTER.search(w)) < t.n_words,
    "shouting": lambda t: 2 * sum(1 for w in t.words if _CAPITALS.search(w) and not _SMALL.search(w)) > t.n_words,
    "exclaiming": lambda t: 10 * t.text.count("!!") > t.n_words,
    "stutter": lambda t: 10 * sum(map(str.__eq__, t.words, t.words[1:])) > 3 * t.n_words,
    "one_word": lambda t: 3 * max(Counter(t.words).values(), default=0) > t.n_words > 30,
    "bullets": lambda t: 10 * len(_BULLET.findall(t.text)) > 9 * (t.text.count("\n") + 1) > 9,
    "ellipses": lambda t: 10 * len(_ELLIPSIS.findall(t.text)) > 3 * (t.text.count("\n") + 1) > 9,
}


def plan(texts: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """Rule names, most rejections per second first; a rule that rejects nothing in the sample comes last, cheapest first.

    Greedy: each next rule is rated on the texts that the rules before it left over, since rules overlap.
    """
    left = [t for t in map(measure, texts) if not base_failed(t)]
    order: list[str] = []
    while len(order) < len(rules):
        rated = []
        for name, rule in rules.items():
            if name not in order:
                start = time.perf_counter()
                hits = [rule(t) for t in left]
                cost = (time.perf_counter() - start) / max(1, len(left)) + 1e-9
                rated.append((-sum(hits) / max(1, len(left)) / cost, cost, name, hits))
        *_, name, hits = min(rated, key=lambda r: r[:3])
        order.append(name)
        left = [t for t, h in zip(left, hits, strict=True) if not h]
    return order


def sample_texts(df: DataFrame, text_col: str, size: int = SAMPLE) -> list[str | None]:
    """``size`` texts of least hash: the same ones whatever the order and the partitions, copies once."""
    h = F.xxhash64(F.lit("sample"), F.col(text_col))
    ids = df.select(h.alias("h")).distinct().orderBy("h").limit(size)
    return [r.t for r in df.select(F.col(text_col).cast("string").alias("t"), h.alias("h")).join(F.broadcast(ids), "h").dropDuplicates(["h"]).orderBy("h").collect()]


def apply_rules(df: DataFrame, text_col: str = "text", order: list[str] | None = None, size: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Texts that fail the base rule go no further; others pass the rules in order until one rejects. rejected_by names
    it: ``base``, a rule, or null if kept. If several rules would reject, it depends on the order; kept doesn't. Columns
    of those names are replaced, whatever their case; rows and other columns stay, or those of ``keep`` alone. Null text
    counts as empty, which fails the base rule. Repeated rows come back repeated; an empty table gives none.

    Texts go to Python in Arrow batches and are read one at a time; only the counts and the kept columns come back.
    """
    order = order or plan(sample_texts(df, text_col, size))
    made = (*_COUNTS, "rejected_by", "base_failed", "kept")
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    # Columns go by place, so that no name of the table's can meet one of these.
    src = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stay)), F.col(text_col).cast("string").alias("t"))
    told = [*((c, "long") for c in _COUNTS), ("rejected_by", "string"), ("base_failed", "boolean"), ("kept", "boolean")]
    schema = StructType(src.schema.fields[:-1])
    for name, kind in told:
        schema.add(name, kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in _COUNTS]
        by: list[str | None] = []
        for x in batch.column(len(stay)):
            t = measure(x.as_py())
            by.append("base" if base_failed(t) else next((name for name in order if RULES[name](t)), None))
            for c, v in zip(counts, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words), strict=True):
                c.append(v)
        cols = [*batch.columns[: len(stay)], *(pa.array(c, pa.int64()) for c in counts), pa.array(by, pa.string())]
        cols += [pa.array([x == "base" for x in by], pa.bool_()), pa.array([x is None for x in by], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=[*(f"c{i}" for i in range(len(stay))), *made])

    return src.mapInArrow(per_batch(run), schema).toDF(*stay, *made)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the columns of ``apply_rules`` but rejected_by, which depends on the order of rules."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
        wins AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM t, unnest(range(1, len(ws) - {WINDOW - 2})) AS r(i)),
        often AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM often, unnest(range(0, {WINDOW})) AS r(d) GROUP BY doc_id),
        m AS (SELECT t.*, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(list_filter(ls, lambda x: regexp_matches(x, {word}))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, {word})))) AS n_dup_lines,
                coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS nl FROM t LEFT JOIN rep USING (doc_id)),
        b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
            NOT base_failed AND NOT (10 * n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words OR 2 * n_dup_lines > nl
            OR 2 * len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}'))) < n_words
            OR 2 * len(list_filter(ws, lambda w: regexp_matches(w, '[A-Z]{{2}}') AND NOT regexp_matches(w, '[a-z]'))) > n_words
            OR 10 * len(regexp_extract_all(text, '!!')) > n_words
            OR 10 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > 3 * n_words
            OR (3 * coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) > n_words AND n_words > 30)
            OR (10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) > 9 * nl AND 9 * nl > 9)
            OR (10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t]*$'))) > 3 * nl AND 3 * nl > 9)) AS kept
        FROM b
    """
