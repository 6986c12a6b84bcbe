"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes decides where a chunk ends, so a local edit changes the chunks around it and no others.
Each chunk gives one character of a signature. A fingerprint holds signatures at a block size and its next doubles; two
fingerprints are compared by edit distance where they have a block size in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 7
LENGTH = 64
LEAST_BLOCK = 3
#: Bytes hashed at a time: bounds memory whatever a text's length.
STEP = 1 << 18
#: Ranges of documents that are walked side by side at most: the driver holds one id of each.
MOST_RANGES = 100_000
#: Equal runs of so many characters must be in both signatures, or two texts count as unlike.
RUN = 4
#: Block sizes that a fingerprint covers.
LEVELS = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT, STEP + 1), _powers(_INVERSE, STEP + 1)


def _roll(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes up to each byte, by position in the window only; shorter at the start."""
    out = np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        out[k:] += (data[: len(data) - k].astype(np.uint32) + 1) * np.uint32((0x85EBCA6B * (2 * k + 1) ** 3) & 0xFFFFFFFF)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _chunks(data: np.ndarray, roll: np.ndarray, block: int) -> str:
    """Signature at a block size: one character a chunk; the last of ``LENGTH`` takes all that is left."""
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1)[: LENGTH - 1] + 1
    bounds = np.unique(np.r_[0, ends, len(data)])
    if len(bounds) < 2:
        return ""
    sums = np.zeros(len(bounds) - 1, np.uint64)
    for s in range(0, len(data), STEP):  # each chunk's polynomial, summed over the steps that it spans
        e = min(s + STEP, len(data))
        total = np.zeros(e - s + 1, np.uint64)
        np.cumsum((data[s:e].astype(np.uint64) + np.uint64(1)) * _UP[: e - s], out=total[1:])
        lo, hi = np.clip(bounds[:-1], s, e) - s, np.clip(bounds[1:], s, e) - s
        part = (total[hi] - total[lo]) * _DOWN[lo]  # as if the chunk's bytes in this step began at power 0
        before = np.minimum(np.maximum(s - bounds[:-1], 0), bounds[1:] - bounds[:-1])
        far = np.array([pow(int(_MULT), int(b), 1 << 64) if b else 1 for b in before], np.uint64)
        sums += np.where(hi > lo, part * far, np.uint64(0))
    return _LETTERS[(_mix(sums) >> np.uint64(40) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block:...``. Equal texts have equal ones; null counts as empty.

    The block size is the least of 3, 6, 12, ... that lets ``LENGTH`` chunks of it cover the text, halved while the
    signature has fewer than half as many characters.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    roll = np.concatenate([_roll(data[max(0, s - WINDOW + 1) : s + STEP])[min(s, WINDOW - 1) :] for s in range(0, len(data), STEP)]) if len(data) else np.zeros(0, np.uint32)
    while block > LEAST_BLOCK and np.count_nonzero(roll % np.uint32(block) == block - 1) + 1 < LENGTH // 2:
        block //= 2
    return ":".join([str(block), *(_chunks(data, roll, block << k) for k in range(LEVELS))])


def _run_masks(s: str) -> set[str]:
    return {s[i : i + RUN] for i in range(len(s) - RUN + 1)}


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors, one step a character of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 | 1, mh << 1
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if _run_masks(a).isdisjoint(_run_masks(b)) and min(len(a), len(b)) >= RUN:
        return 0.0
    return 1 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str | None, y: str | None) -> float:
    """0 to 1: edit similarity of the signatures at a common block size, the best of them; 0 if there is none."""
    if x is None or y is None:
        return 0.0
    if x == y:
        return 1.0
    (bx, *xs), (by, *ys) = x.split(":"), y.split(":")
    at = {int(by) << k: s for k, s in enumerate(ys)}
    return max((_alike(s, at[b]) for k, s in enumerate(xs) if (b := int(bx) << k) in at), default=0.0)


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with ``out_col`` (replaced if there): the fingerprint of each whole text, null as empty. Rows stay as they are."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out_col, F.arrow_udf(run, "string")(F.col(text_col).cast("string")))


def _spread(df: DataFrame, rows: int) -> list:
    """Bounds that cut ids into ranges of about ``rows`` rows, from quantiles of the ids alone."""
    n = df.count()
    parts = min(MOST_RANGES, max(1, -(-n // rows)))
    cuts = df.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def edited_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 5000) -> DataFrame:
    """Rows (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one per row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's in ascending id, the first following the last. near_edited and near_next are the likeness of
    the fingerprint to that of the edited text and of the next document. Null text counts as empty; null ids come
    first; rows with one id follow each other by text. Ids are integral. An empty table gives none.

    Ids are cut into ranges by quantiles. Each range is sorted and walked by one task; the row that begins the next
    range is sent along with it. A range holds neighbours only, so a hot value of another column has no effect; rows
    that all have one id would share a range.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = _spread(src.select("id"), rows)

    def range_of(ids: pa.Array) -> pa.Array:
        own = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(np.array(cuts, np.int64), own, side="right").astype(np.int32))

    range_of.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    dealt = src.withColumn("part", F.arrow_udf(range_of, "int")("id"))
    least = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"))
    firsts = dealt.groupBy("part").agg(F.min(least).alias("f")).select("part", "f.has", "f.id").collect()  # one row a range
    firsts.sort(key=lambda r: r.part)
    spark = df.sparkSession
    to = [(firsts[i - 1].part, r.id) for i, r in enumerate(firsts)]
    wanted = spark.createDataFrame(to or [(0, None)], "part int, first long").where(F.lit(bool(to)))
    follow = src.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first"))).select("id", "text", "part")
    both = dealt.select("id", "text", "part", F.lit(0).alias("after")).unionByName(follow.select("id", "text", "part", F.lit(1).alias("after")))
    ranged = both.repartitionById(max(1, len(cuts) + 1), "part").sortWithinPartitions("after", "id", "text")

    def run(batches):
        import hashlib

        def emit(rows):
            return pa.RecordBatch.from_pylist(rows, schema=_EDITED)

        out = []
        prev = None  # (part, id, text, fingerprint) waiting for its next row
        for batch in batches:
            for row_id, text, p, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prev is not None and prev[0] != p:
                    prev = None
                if after and prev is None:
                    continue
                fp = fingerprint(text)
                if prev is not None:
                    _, was_id, was, was_fp = prev
                    half = len(was) // 2
                    edited = was[: len(was) - half] + text[:half]
                    edited_fp = fingerprint(edited)
                    out.append({"id": was_id, "n_chars": len(was), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": was_fp, "edited_fingerprint": edited_fp, "near_edited": likeness(was_fp, edited_fp), "near_next": likeness(was_fp, fp)})
                prev = None if after else (p, row_id, text, fp)
                if len(out) >= 2000:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ranged.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_EDITED = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
