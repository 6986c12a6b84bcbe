"""Sum-of-squares packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialize, per_batch

MAX_TOKENS = 2048
#: Pieces packed together in one task. Each such group leaves some bins part full, so it is large; it bounds memory.
GROUP = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: How byte-level tokenizers of this kind cut a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids as the ``tokenizers`` library gives them for the byte-level file at ``path``.

    The same vocabulary runs in tiktoken, which is several times as fast. Texts that contain a special token, where the
    two libraries differ, go to ``tokenizers`` itself; so does everything if the file isn't plain byte-level merging.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("type") != "BPE" or model.get("dropout"):
        return by_tokenizers
    letter = byte_alphabet()
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    unusual = re.compile("|".join(map(re.escape, sorted(special)))) if special else None

    def encode(text: str) -> np.ndarray:
        if unusual and unusual.search(text):
            return by_tokenizers(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32[, ids]): each text's ids and a closing 0, cut where longer.

    All pieces of a long document are full but the first, which has the rest.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = load_encoder(tokenizer)
        encode = _encoders[tokenizer]
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, t in enumerate(batch.column(1)):
            own = np.append(encode(t.as_py() or ""), 0).astype("<u4")
            rest = len(own) % max_tokens
            cuts = [*([0] if rest else []), *range(rest, len(own), max_tokens)]
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(own)], strict=True)):
                row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own[a:b].tobytes()))
                if with_ids:
                    ids.append(own[a:b])
        cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return src.mapInArrow(per_batch(run), schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each size, in the order given.

    Each goes into the open bin with room for which the sum over gaps of the squared count of open bins with that gap
    becomes least; a new bin is opened where none has room. Ties go to the smallest gap left. Full bins count no more.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    filled: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, s in enumerate(sizes.tolist()):
        here = count[s:]
        change = 2 * (count[: capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        live = here > 0
        live[-1] = not live[:-1].any()  # a new bin is one with a gap of all
        g = s + int(np.argmin(np.where(live, change, np.iinfo(np.int64).max)))
        if g == capacity:
            b = len(filled)
            filled.append(0)
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[k], offsets[k] = b, filled[b]
        filled[b] += s
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece of every document, placed.

    Pieces are dealt by hash, of their row's place too, into groups of about ``group``, so that repeated rows spread like
    others. Each group is packed longest first; sequence ids are unique.
    Offsets within a sequence have no gaps from 0 on. Null or empty text: one piece, the closing 0 alone. Repeated rows
    are packed as often as they stand. Other columns are ignored; an empty table gives none.
    """
    tokenizer = tokenizer or default_tokenizer()
    cut, _ = materialize(pieces(df, id_col, text_col, tokenizer, max_tokens, with_ids), "pieces")
    groups = max(1, round(cut.count() / group))
    cols = cut.columns
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *cols[5:]]

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), max_tokens)
        base = rows["grp"][0].as_py() << 32
        out = rows.drop_columns(["grp"]).append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))
        return out.select(names)

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema} | {"sequence_id": "bigint", "offset": "bigint"}
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    out = dealt.groupBy("grp").applyInArrow(place, ", ".join(f"{n} {kinds[n]}" for n in names))
    return out.withColumnRenamed("id", id_col)
