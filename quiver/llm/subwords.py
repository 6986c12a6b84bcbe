"""SentencePiece encoding with seeded merge-dropout, and decoding.

Segmentation is of the merge type: of all neighbouring symbols whose join is a piece, the best-scored is joined first,
the leftmost of equal ones, until none is left. With dropout, a candidate that comes up is skipped for good with a given
chance, decided by a keyed hash of its own: of the seed, the whole text, the run's place in it, the candidate's place in
the run, and the piece; new neighbours make new candidates. Pieces then differ from place to place, but always spell the
text, so decoding restores it exactly.

No piece of such a model joins a space mark to what stands before it, so the runs between (space marks, then a word) are
segmented one by one. Equal runs go through the same states of the agenda until their hashes part them: where a run
stands more than once each state is worked out once, and only the hashes are taken for every place.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import per_batch

SPACE = "▁"
DROPOUT = 0.1
#: Characters segmented together, which bounds memory. Runs longer than ``LONG`` go one by one.
STEP = 1 << 22
LONG = 32
#: Characters whose runs walk together, bytes of states kept for each length of runs, and runs kept by name. Beyond them
#: states are forgotten and worked out again.
WALK = 1 << 17
STATE_BYTES = 1 << 24
NAMES = 400_000
#: Line ends and tabs stand alone: no piece joins them to anything.
_ALONE = "\n\t"
_RUN = re.compile(f"{SPACE}*[^{SPACE}{_ALONE}]+|{SPACE}+|[{_ALONE}]")
_NONE = np.int32(1 << 30)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Model:
    """Vocabulary of a merge-type model with byte fallback and a leading space mark, no text normalisation."""

    ids: dict[str, int]
    rank: np.ndarray  # by piece id; least first
    char: np.ndarray  # code point to piece id, -1 where there is none
    pairs: np.ndarray  # left id * 2^17 + right id, sorted
    joined: np.ndarray  # piece that each pair makes
    byte: tuple[int, ...]
    spelled: tuple[bytes, ...]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """Read a model file; other kinds than those described at ``Model`` are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm, kind = proto.normalizer_spec, proto.trainer_spec
    if kind.model_type != 2 or not kind.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kind.treat_whitespace_as_suffix:
        raise ValueError("not a merge-type model with byte fallback and unnormalised text")
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if len(ids) + 3 + 256 != len(proto.pieces) or any(SPACE in p.lstrip(SPACE) or len(p) > 1 and not set(_ALONE).isdisjoint(p) for p in ids):
        raise ValueError("user-defined pieces, or pieces with an inner space mark or line end")
    scores = np.array([p.score for p in proto.pieces])
    # Pieces of one score are as good as each other: the leftmost goes first, whichever it is.
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    char = np.full(0x110000, -1, np.int32)
    pairs = []
    for p, i in ids.items():
        if len(p) == 1:
            char[ord(p)] = i
        pairs += [(ids[p[:k]] << 17 | ids[p[k:]], i) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    pairs.sort()
    byte = [0] * 256
    spelled = [b""] * len(scores)
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte[int(p.piece[3:5], 16)] = i
            spelled[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == 1:
            spelled[i] = p.piece.replace(SPACE, " ").encode()
    return Model(ids, rank, char, np.array([p for p, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int32), tuple(byte), tuple(spelled))


def _chance(base: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
    x = base ^ (start.astype(np.uint64) * _A) ^ (piece.astype(np.uint64) * _B)
    x = (x ^ (x >> np.uint64(29))) * _C
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _dropped(base: int, start: int, piece: int, p: float) -> bool:
    return bool(_chance(np.array([base], np.uint64), np.array([start]), np.array([piece]))[0] < p)


def bases_of(key: int, n: int) -> np.ndarray:
    """A hash for each of the ``n`` runs of a text with this key."""
    x = np.arange(1, n + 1, dtype=np.uint64) * _A + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _codes(runs: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(-1, width)


def encode_run(model: Model, run: str, base: int, p: float, marks: dict[str, bytes] | None = None) -> list[int]:
    """Ids of one run by an agenda of candidates; time is n log n in its length. Characters without a piece give bytes."""
    n = len(run)
    text, nxt, prev = list(run), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if j < n and (piece := model.ids.get(text[i] + text[j])) is not None:
            heapq.heappush(agenda, (int(model.rank[piece]), i, piece, len(text[i]), len(text[j])))

    for i in range(n):
        propose(i)
    while agenda:
        _, i, piece, a, b = heapq.heappop(agenda)
        j = nxt[i]
        if j >= n or len(text[i]) != a or len(text[j]) != b:  # one side has been joined since
            continue
        if p and _dropped(base, i, piece, p):
            continue
        text[i] += text[j]
        text[j] = ""
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        propose(prev[i])
        propose(i)
    out: list[int] = []
    for s in text:
        if s:
            i = model.ids.get(s)
            out += [i] if i is not None else [model.byte[b] for b in (marks or {}).get(s) or s.encode()]
    return out


def _lookup(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of each pair; rank ``_NONE`` where they don't join."""
    key = left.astype(np.int64) << 17 | right
    at = np.minimum(np.searchsorted(model.pairs, key), len(model.pairs) - 1)
    piece = model.joined[at]
    return np.where(model.pairs[at] == key, model.rank[piece], _NONE), piece


def _encode_equal(model: Model, sym: np.ndarray, base: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs of one length, each for itself: (rows x length, what is used of each)."""
    n, width = sym.shape
    out, used = sym.copy(), np.full(n, width)
    if width == 1:
        return out, used
    rank, piece = _lookup(model, sym[:, :-1], sym[:, 1:])
    start = np.broadcast_to(np.arange(width, dtype=np.int32), sym.shape).copy()
    row, size = np.arange(n), np.full(n, width)
    cols = np.arange(width)
    while True:
        each = np.arange(len(row))
        best = rank.argmin(axis=1)
        live = rank[each, best] < _NONE
        if 4 * np.count_nonzero(live) < 3 * len(row):  # let go of finished rows once they are many
            done = ~live
            out[row[done]], used[row[done]] = sym[done], size[done]
            sym, start, rank, piece, base, row, size, best = (x[live] for x in (sym, start, rank, piece, base, row, size, best))
            if not len(row):
                return out, used
            each, live = each[: len(row)], live[live]
        rank[each, best] = _NONE
        go = live & (_chance(base, start[each, best], piece[each, best]) >= p) if p else live
        g = np.flatnonzero(go)
        b = best[g]
        take = np.minimum(cols + (cols > b[:, None]), width - 1)
        sym_g = np.take_along_axis(sym[g], take, 1)
        sym_g[np.arange(len(g)), b] = piece[g, b]
        sym[g], start[g] = sym_g, np.take_along_axis(start[g], take, 1)
        take = take[:, :-1].clip(max=width - 2)
        moved_rank, moved_piece = np.take_along_axis(rank[g], take, 1), np.take_along_axis(piece[g], take, 1)
        moved_rank[:, -1] = _NONE
        size[g] -= 1
        last = size[g] - 1
        for at, ok in ((b - 1, b > 0), (b, b < last)):
            i = np.flatnonzero(ok)
            moved_rank[i, at[i]], moved_piece[i, at[i]] = _lookup(model, sym_g[i, at[i]], sym_g[i, at[i] + 1])
        i = np.flatnonzero((b >= last) & (b <= width - 2))  # what was joined stands last: there is no pair to its right
        moved_rank[i, b[i]] = _NONE
        rank[g], piece[g] = moved_rank, moved_piece


class States:
    """States of the agenda over runs of one length, each worked out once: its symbols, the candidates left, and the
    states that follow if the best one is skipped or joined."""

    def __init__(self, model: Model, width: int):
        self.model, self.width, self.n = model, width, 0
        self.sym = np.zeros((0, width), np.int32)
        self.start = np.zeros((0, width), np.int8)
        self.rank = np.zeros((0, max(1, width - 1)), np.int32)
        self.piece = np.zeros((0, max(1, width - 1)), np.int32)
        self.size = np.zeros(0, np.int8)
        self.best = np.zeros(0, np.int8)  # place of the best candidate, -1 where none is left
        self.place = np.zeros(0, np.int8)  # where that candidate starts in the run
        self.makes = np.zeros(0, np.int32)  # the piece that it makes
        self.next = np.zeros((0, 2), np.int32)

    _PARTS = ("sym", "start", "rank", "piece", "size", "best", "place", "makes", "next")

    def nbytes(self) -> int:
        return sum(getattr(self, x).nbytes for x in self._PARTS)

    def _add(self, sym: np.ndarray, start: np.ndarray, rank: np.ndarray, piece: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, each = len(sym), np.arange(len(sym))
        best = rank.argmin(axis=1) if n else each
        live = rank[each, best] < _NONE
        new = (sym, start, rank, piece, size, np.where(live, best, -1), start[each, best], piece[each, best], np.full((n, 2), -1))
        if self.n + n > len(self.size):
            for x in self._PARTS:
                old = getattr(self, x)
                grown = np.zeros((max(256, 2 * len(old), self.n + n), *old.shape[1:]), old.dtype)
                grown[: self.n] = old[: self.n]
                setattr(self, x, grown)
        for x, v in zip(self._PARTS, new, strict=True):
            getattr(self, x)[self.n : self.n + n] = v
        self.n += n
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def begin(self, sym: np.ndarray) -> np.ndarray:
        """First states of runs, given by their characters' pieces."""
        n = len(sym)
        rank, piece = _lookup(self.model, sym[:, :-1], sym[:, 1:]) if self.width > 1 else (np.full((n, 1), _NONE), np.zeros((n, 1), np.int32))
        return self._add(sym, np.broadcast_to(np.arange(self.width, dtype=np.int8), sym.shape), rank, piece, np.full(n, self.width))

    def _follow(self, steps: np.ndarray) -> None:
        """Work out the states after ``steps``: twice the state's number, one more where its best candidate is joined."""
        at, joined = steps >> 1, np.flatnonzero(steps & 1)
        sym, start, rank, piece, size, best = (getattr(self, x)[at] for x in ("sym", "start", "rank", "piece", "size", "best"))
        rank[np.arange(len(at)), best] = _NONE
        if len(joined):
            b, each, width = best[joined].astype(np.int64), np.arange(len(joined)), self.width
            cols = np.arange(width)
            take = np.minimum(cols + (cols > b[:, None]), width - 1)
            moved = np.take_along_axis(sym[joined], take, 1)
            moved[each, b] = piece[joined, b]
            sym[joined], start[joined] = moved, np.take_along_axis(start[joined], take, 1)
            take = take[:, :-1].clip(max=width - 2)
            moved_rank, moved_piece = np.take_along_axis(rank[joined], take, 1), np.take_along_axis(piece[joined], take, 1)
            moved_rank[:, -1] = _NONE
            size[joined] -= 1
            last = size[joined] - 1
            for i_at, ok in ((b - 1, b > 0), (b, b < last)):
                i = np.flatnonzero(ok)
                moved_rank[i, i_at[i]], moved_piece[i, i_at[i]] = _lookup(self.model, moved[i, i_at[i]], moved[i, i_at[i] + 1])
            i = np.flatnonzero((b >= last) & (b <= width - 2))  # what was joined stands last: there is no pair to its right
            moved_rank[i, b[i]] = _NONE
            rank[joined], piece[joined] = moved_rank, moved_piece
        self.next.reshape(-1)[steps] = self._add(sym, start, rank, piece, size)

    def walk(self, state: np.ndarray, base: np.ndarray, p: float) -> np.ndarray:
        """Last states of runs that begin in ``state``; ``base`` is each run's own."""
        state = state.copy()
        go = np.flatnonzero(self.best[state] >= 0)
        while len(go):
            here = state[go]
            step = here.astype(np.int64) * 2 + (_chance(base[go], self.place[here], self.makes[here]) >= p if p else 1)
            after = self.next.reshape(-1)[step]
            if (new := after < 0).any():
                self._follow(np.unique(step[new]))
                after = self.next.reshape(-1)[step]
            state[go] = after
            go = go[self.best[after] >= 0]
        return state


class Runs:
    """Segments runs; keeps what it has worked out, within bounds. Results don't depend on what is kept."""

    def __init__(self, model: Model, p: float):
        self.model, self.p = model, p
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.names: list[str] = []
        self.width = np.zeros(0, np.int64)  # by number; 0 for runs that go one by one
        self.first = np.zeros(0, np.int32)  # by number; -1 where the first state isn't there
        self.states: dict[int, States] = {}

    def _numbers(self, runs: list[str]) -> np.ndarray:
        if len(self.number) > NAMES:
            self._forget()
        found = np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs))
        new = list(islice(self.number, len(self.names), None))
        if new:
            char = self.model.char
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            known = char[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)] >= 0
            whole = np.logical_and.reduceat(known, np.r_[0, np.cumsum(sizes)[:-1]])
            self.names += new
            self.width = np.r_[self.width, np.where(whole & (sizes <= LONG), sizes, 0)]
            self.first = np.r_[self.first, np.full(len(new), -1, np.int32)]
        return found

    def encode(self, runs: list[str], bases: np.ndarray, marks: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs one after another, and how many each has. Each run has a base of its own."""
        number = self._numbers(runs)
        times, width = np.bincount(number, minlength=len(self.names)), self.width[number]
        order = np.argsort(width, kind="stable")
        counts = np.zeros(len(runs), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # some runs, their ids padded
        lone: dict[int, list[int]] = {}
        for same in np.split(order, np.flatnonzero(np.diff(width[order])) + 1) if len(runs) else []:
            w = int(width[same[0]])
            if not w:
                lone = {i: encode_run(self.model, runs[i], int(bases[i]), self.p, marks) for i in same.tolist()}
                continue
            # A run that stands once shares its states with none, so they aren't kept.
            alone = (times[number[same]] == 1) & (self.first[number[same]] < 0)
            for k in range(0, np.count_nonzero(alone), WALK // w):
                part = same[alone][k : k + WALK // w]
                ids, counts[part] = _encode_equal(self.model, self.model.char[_codes([runs[i] for i in part.tolist()], w)], bases[part], self.p)
                found.append((part, ids))
            same = same[~alone]
            states = self.states.setdefault(w, States(self.model, w))
            for k in range(0, len(same), WALK // w):
                part = same[k : k + WALK // w]
                numbers = number[part]
                new = np.unique(numbers[self.first[numbers] < 0])
                if len(new):
                    self.first[new] = states.begin(self.model.char[_codes([self.names[i] for i in new.tolist()], w)])
                last = states.walk(self.first[numbers], bases[part], self.p)
                counts[part] = states.size[last]
                found.append((part, states.sym[last]))
                if states.nbytes() > STATE_BYTES:
                    states = self.states[w] = States(self.model, w)
                    self.first[self.width == w] = -1
        for i, ids in lone.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for part, ids in found:
            used = counts[part]
            inside = np.arange(ids.shape[1]) < used[:, None]
            at = (ends[part] - used)[:, None] + np.arange(ids.shape[1])
            flat[at[inside]] = ids[inside]
        for i, ids in lone.items():
            flat[ends[i] - len(ids) : ends[i]] = ids
        return flat, counts


class Encoder:
    """Encodes texts under one seed; results don't depend on which texts come together."""

    def __init__(self, model: Model, p: float, seed: int):
        self.model, self.p, self.seed, self.runs = model, p, seed, Runs(model, p)

    def _runs(self, text: str) -> tuple[list[str], np.ndarray, dict[str, bytes] | None]:
        """Runs of a text with their bases. A space mark in the text itself must not pass for a space: it is stood in
        for by a character that the text doesn't have and no piece has, and gives that mark's bytes."""
        marks = None
        if SPACE in text:
            stand_in = next(c for c in map(chr, range(0xF0000, 0x10FFFF)) if c not in text and self.model.char[ord(c)] < 0)
            text, marks = text.replace(SPACE, stand_in), {stand_in: SPACE.encode()}
        runs = _RUN.findall(SPACE + text.replace(" ", SPACE)) if text else []
        key = xxhash.xxh64_intdigest(text.encode(), self.seed & (1 << 64) - 1) if self.p else 0
        return runs, bases_of(key, len(runs)), marks

    def _encode_step(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts."""
        every, bases, ends, alone = [], [], [], {}
        for i, text in enumerate(texts):
            runs, own, marks = self._runs(text)
            if marks:
                alone[i] = self.runs.encode(runs, own, marks)[0]
                runs, own = [], own[:0]
            every += runs
            bases.append(own)
            ends.append(len(every))
        flat, counts = self.runs.encode(every, np.concatenate(bases))
        cuts = np.r_[0, np.cumsum(counts)][ends]
        return [alone.get(i, x) for i, x in enumerate(np.split(flat, cuts[:-1]))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < STEP:
                size += len(texts[end])
                end += 1
            out += self._encode_step(texts[at:end])
            at = end
        return out


def decode(model: Model, ids: np.ndarray) -> str:
    """Text of a sequence of ids; bytes that are no valid text show as replacement characters."""
    return b"".join(map(model.spelled.__getitem__, ids.tolist())).decode(errors="replace")[1:] if len(ids) else ""


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, p: float, seed: int) -> Encoder:
    if (path, p, seed) not in _encoders:
        _encoders[path, p, seed] = Encoder(load(path), p, seed)
    return _encoders[path, p, seed]


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str | None = None, dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """``df`` with ``out_col``: ids of each whole text under ``seed``; without dropout the model's plain segmentation.

    Null text gives null, empty text an empty list. Equal texts under one seed have equal ids. Rows, repeated ones too,
    and other columns stay; a column named ``out_col`` is replaced. An empty table gives none.
    """
    path = model or default_model()

    def run(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        ids = _encoder(path, dropout, seed).encode([t or "" for t in plain])
        return pa.array([None if t is None else x for t, x in zip(plain, ids, strict=True)], pa.list_(pa.int32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(out_col, F.arrow_udf(run, "array<int>")(F.col(text_col).cast("string")))


def decode_column(df: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: the text that each list of ids spells; null gives null."""
    path = model or default_model()

    def run(lists: pa.Array) -> pa.Array:
        m = load(path)
        return pa.array([None if x is None else decode(m, np.array(x, np.int64)) for x in lists.to_pylist()], pa.string())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return df.withColumn(out_col, F.arrow_udf(run, "string")(F.col(ids_col)))


def segmentation_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """Rows (id_col, n_chars, n_ids, ids_crc32, lossless), one per row: how its text was segmented, and whether decoding
    those ids gives the text again. ids_crc32 is of the ids as little-endian 32-bit numbers. Null text counts as empty.
    Repeated rows come back repeated and alike; other columns are ignored; an empty table gives none.
    """
    path = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        coder = _encoder(path, dropout, seed)
        cols: list[list] = [[], [], [], []]
        at = 0
        while at < len(texts):  # as many texts at a time as are segmented together
            end, size = at, 0
            while end < len(texts) and size < STEP:
                size += len(texts[end])
                end += 1
            for t, ids in zip(texts[at:end], coder.encode(texts[at:end]), strict=True):
                for c, v in zip(cols, (len(t), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), decode(coder.model, ids) == t), strict=True):
                    c.append(v)
            at = end
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_chars", "n_ids", "ids_crc32", "lossless"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(per_batch(run), f"id {src.schema['id'].dataType.simpleString()}, n_chars long, n_ids long, ids_crc32 long, lossless boolean")
    return out.withColumnRenamed("id", id_col)
