"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialize, per_batch
from quiver.llm.components import connected_components

SEED = 42
#: Fingerprints in one block of a tile, least and most, and shingles counted at a time. They bound memory and decide how
#: work is dealt: a row is copied once for each block that its own meets, so blocks grow with the input.
LEAST_BLOCK, MOST_BLOCK = 1 << 10, 1 << 18
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles, repeats included; null or no word: zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[width - 1 :], strict=False)) if len(words) >= width else [(0, len(joined))]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(spans), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[k : k + CHUNK]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """Rows (id_col, fp): one per input row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(per_batch(run), f"id {src.schema['id'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("id", id_col)


def _tiles(fps: np.ndarray) -> np.ndarray:
    """Tile of a fingerprint: the population counts of its halves."""
    high, low = np.bitwise_count(fps >> np.uint64(32)), np.bitwise_count(fps & np.uint64(0xFFFFFFFF))
    return high.astype(np.int64) * 33 + low


def _blocks(fps: np.ndarray, n: int) -> np.ndarray:
    mixed = fps * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Deal:
    """Which comparisons the rows of a block take part in, by formula from the row counts of tiles (1089 at most).

    A tile is split into blocks. Each block is home to some tasks: it meets the blocks after it of its own tile, then
    those of later tiles, laid end to end and cut every two blocks' rows. Tiles whose counts differ beyond the radius
    never meet. Nothing is listed for all blocks anywhere, so the plan is as small for any number of rows.
    """

    def __init__(self, sizes: dict[int, int], radius: int, block: int):
        self.step = 2 * block
        self.split = {t: -(-n // block) for t, n in sizes.items()}
        self.rows = {t: n / self.split[t] for t, n in sizes.items()}
        self.later: dict[int, list[tuple[int, int]]] = {t: [] for t in sizes}  # (tile, rows of the tiles before it)
        self.earlier: dict[int, list[tuple[int, int]]] = {t: [] for t in sizes}
        for t in sorted(sizes):
            before = 0
            for u in sorted(sizes):
                if u > t and abs(u // 33 - t // 33) + abs(u % 33 - t % 33) <= radius:
                    self.later[t].append((u, before))
                    self.earlier[u].append((t, before))
                    before += sizes[u]

    def _part(self, t: int, b: int, before: float) -> int:
        """Task of the home block b of tile t that meets the block which ``before`` rows stand before."""
        return t << 52 | b << 26 | int(before // self.step)

    def tasks(self, t: int, b: int) -> Iterator[tuple[int, int]]:
        """(task, role) of a block: role 0 rows are compared with each other and with role 1 rows, role 2 rows with role
        1 rows only."""
        own = (self.split[t] - 1 - b) * self.rows[t]
        last = own + self.later[t][-1][1] + (self.split[u := self.later[t][-1][0]] - 1) * self.rows[u] if self.later[t] else own - self.rows[t]
        for k in range(int(max(0.0, last) // self.step) + 1):
            yield t << 52 | b << 26 | k, 2 if k else 0
        for c in range(b):
            yield self._part(t, c, (b - c - 1) * self.rows[t]), 1
        for u, before in self.earlier[t]:
            for c in range(self.split[u]):
                yield self._part(u, c, (self.split[u] - 1 - c) * self.rows[u] + before + b * self.rows[t]), 1


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; label always points at the least member."""
    while (differ := label[i] != label[j]).any():
        i, j = i[differ], j[differ]
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def forest(fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as a spanning forest: at most one edge a row, however many pairs are within the radius."""
    quarters = np.stack([np.bitwise_count((fps >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], 1).astype(np.int16)
    code = quarters.astype(np.int64) @ np.array([1, 32, 1024, 32768])
    order = np.argsort(code, kind="stable")
    fps, role, quarters, code = fps[order], role[order], quarters[order], code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    ends = np.r_[starts[1:], len(code)]
    label = np.arange(len(fps))
    for s, e in zip(starts, ends, strict=True):
        home = np.arange(s, e)[role[s:e] != 1]
        if not len(home):
            continue
        hit = np.flatnonzero(np.abs(quarters[starts] - quarters[s]).sum(axis=1) <= radius)  # finer tiles, skipped alike
        other = np.concatenate([np.arange(starts[k], ends[k]) for k in hit])
        other = other[(role[other] == 1) | ((role[other] == 0) & (other >= s))]
        for h in range(0, len(home), 128):
            part = home[h : h + 128]
            for o in range(0, len(other), 8192):
                far = other[o : o + 8192]
                i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[far][None, :]) <= radius)
                i, j = part[i], far[j]
                ok = (i != j) & ((role[i] == 0) | (role[j] == 1))
                if ok.any():
                    _union(label, i[ok], j[ok])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fps[linked], fps[label[linked]]


def links(classes: DataFrame, radius: int = 3, block: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect exactly the fingerprints ``classes.fp`` (distinct) within ``radius`` of each other.

    Tasks are dealt by formula from row counts by tile, 1089 at most. Each compares two bounded sets of rows.
    """
    half = (F.bit_count(F.shiftrightunsigned("fp", 32)) * 33 + F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))).cast("long")
    sizes = {r.t: r.n for r in classes.groupBy(half.alias("t")).agg(F.count("*").alias("n")).collect()}
    plan = Deal(sizes, radius, block or min(MOST_BLOCK, max(LEAST_BLOCK, sum(sizes.values()) // 32)))

    def deal(batch: pa.RecordBatch) -> pa.Table | None:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        tiles, out = _tiles(fps), []
        for t in np.unique(tiles):
            rows = fps[tiles == t]
            blocks = _blocks(rows, plan.split[int(t)])
            for b in np.unique(blocks):
                part = rows[blocks == b].view(np.int64)
                out += [(np.full(len(part), k, np.int64), np.full(len(part), r, np.int8), part) for k, r in plan.tasks(int(t), int(b))]
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["task", "role", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        a, b = forest(group["fp"].to_numpy().view(np.uint64), group["role"].to_numpy(), radius)
        return pa.table([a.view(np.int64), b.view(np.int64)], names=["src", "dst"])

    # Ranges of tasks hold about as many rows each, where hashes of a few hundred tasks would heap some up.
    dealt = classes.select("fp").mapInArrow(per_batch(deal), "task long, role byte, fp long").repartitionByRange("task")
    return dealt.groupBy("task").applyInArrow(compare, "src long, dst long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """Rows (id_col, fingerprint, component_id), one per input row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the least id reachable over links, itself
    included. Equal fingerprints form one class before any comparison, so copies cost nothing. Null or empty text, or
    no word: fingerprint zero, linked like any other. Repeated rows come back repeated; a null id takes the id of its
    component, or null if no member has one. Other columns are ignored. An empty table gives none.
    """
    own, _ = materialize(fingerprints(df, id_col, text_col, width), "simhash")
    classes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(links(classes, radius), "src", "dst")
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    known = labelled.select(F.col("fp").alias("fp_"), F.col("root").alias("root_")).join(least, F.col("root_") == least.root).select("fp_", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(known, own.fp == known.fp_).select(id_col, shown, "component_id")
