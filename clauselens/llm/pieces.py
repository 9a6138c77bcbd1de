"""Operator 1: SentencePiece encoding with N-best segmentation, and decoding.

The pieces of a model that match a text form a lattice. A forward Viterbi pass gives
the best score from the start to every position; a backward A* search from the end
uses these scores as exact heuristics, so it leaves the agenda with complete
segmentations in the order of their total score, best first.

In a model whose pieces never continue over a white-space mark, and around characters
that no longer piece contains, every segmentation has a boundary, so the lattice of a
text is a chain of small lattices (units). The forward pass (best and second best
score) runs once per distinct unit of a task, thousands of units at once (at most
``UNIT_LIMIT`` are remembered). The N best of a text change at most N - 1 units, among
those N - 1 whose second best costs least; these are searched backwards by A*, and the
N best of the text are the N smallest sums of their losses. That is exact, as scores
add up.

Scores are the model's piece scores; a character without a piece costs the lowest
score less 10 (``UNKNOWN_PENALTY``) and is written as byte pieces if the model has
them, else as the unknown piece. Of equally good best segmentations the one whose last
piece is longest wins, then the one before it; further ties have a fixed order. Models with identity
normalisation are supported (others are refused); the dummy prefix follows the model.

Edge cases: null texts give null results, empty ones no pieces and score 0; text that
holds the white-space mark itself decodes to a space (``roundtrip`` false); very long
texts and words are searched whole. Repeated rows give repeated results; only the id
and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import operator
import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Powers, map_batches, mix64, prepare

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
UNKNOWN_PENALTY = 10.0
#: Units remembered in a task, learned at once, and the length beyond which one goes alone.
UNIT_LIMIT = 250_000
AT_ONCE = 8192
LONG_UNIT = 48
TEXTS_AT_ONCE = 128
MARK = "▁"

_PRIORITY = operator.itemgetter(0, 1)
_DIGIT = re.compile(r"<0x([0-9A-F]{2})>")


class Lattice:
    """The pieces of a model and the search for the best segmentations of a unit."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = "ﬁ  Å　x"
        if sp.normalize(probe).lstrip(MARK).replace(MARK, " ") != probe:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix = sp.normalize("x") != "x"
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(_DIGIT.fullmatch(self.text[i])[1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.unknown = sp.unk_id()
        self.pieces = {self.text[i]: (i, sp.get_score(i)) for i in range(size)
                       if i not in self.special and i not in self.byte_of}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        raw = [b"" if i in self.special else bytes([self.byte_of[i]]) if i in self.byte_of
               else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_len = np.array([len(r) for r in raw], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        over = any(MARK in p.lstrip(MARK) for p in self.pieces)
        alone = [re.escape(c) for c in "\n\t\r" if c not in inside]
        stop = "".join(alone) + ("" if over else MARK)
        # Units: a run of marks with the word after it; a character that stands alone.
        body = f"[^{stop}]+" if stop else r"(?s:.)+"
        self.unit = re.compile("|".join(([] if over else [f"{MARK}+(?:{body})?"]) + [body] + alone), re.DOTALL)

    def units(self, text: str) -> list:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.unit.findall(MARK + marked if self.dummy_prefix else marked)

    def search(self, unit: str, n_best: int) -> list:
        """Up to ``n_best`` (score, ids) of a unit, best first.

        The heuristic is exact, so every entry of the agenda leads to a segmentation of
        just its estimate, and the agenda never needs more entries than results are
        missing: memory is the forward scores and ``n_best`` paths, however long the unit.
        """
        n, get, longest, unknown = len(unit), self.pieces.get, self.longest, (None, self.unknown_score)
        best = array("d", [float("-inf")]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = get(unit[i:j])
                if hit is None:
                    if j > i + 1:
                        continue
                    hit = unknown
                if here + hit[1] > best[j]:
                    best[j] = here + hit[1]
        # Agenda: (-(score so far + best to here), order, position, score so far, pieces from the end)
        agenda, order, out = [(-best[n], 0, n, 0.0, None)], 0, []
        while agenda and len(out) < n_best:
            _, _, at, so_far, tail = agenda.pop(0)
            if not at:
                out.append((so_far, self._ids(unit, tail)))
                continue
            for start in range(at - 1, max(0, at - longest) - 1, -1):
                hit = get(unit[start:at])
                if hit is None:
                    if start < at - 1:
                        continue
                    hit = unknown
                order -= 1                   # of equal ones the newest first: the longest piece
                agenda.append((-(so_far + hit[1] + best[start]), order, start, so_far + hit[1], (start, at, hit[0], tail)))
            agenda.sort(key=_PRIORITY)
            del agenda[n_best - len(out):]
        return out

    def _ids(self, unit: str, tail) -> list:
        ids = []
        while tail:
            start, end, piece, tail = tail
            if piece is not None:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in unit[start:end].encode()]
            else:
                ids.append(self.unknown)
        return ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of piece ids: marks are spaces, byte pieces their byte, control pieces nothing."""
        size = self.piece_len[ids]
        total = int(size.sum())
        at = np.repeat(self.piece_at[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        out = self.piece_bytes[at].tobytes()
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class Matcher:
    """Finds all pieces in many units at once and runs the forward pass over them."""

    _VALUES = 0x9E3779B97F4A7C15

    def __init__(self, lattice: Lattice):
        self.width = lattice.longest
        self.unknown_score = lattice.unknown_score
        prefixes: dict = {}
        for piece, (i, score) in lattice.pieces.items():
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], (-1, -np.inf))
            prefixes[piece] = (i, score)
        keys = sorted(prefixes)
        h = self._hashes(np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32))
        ends = np.cumsum([len(k) for k in keys])
        starts = ends - np.array([len(k) for k in keys])
        code = h(starts, ends - starts)
        order = np.argsort(code)
        if len(np.unique(code)) != len(code):
            raise ValueError("two pieces share a hash")
        self.code = code[order]
        self.piece = np.array([prefixes[k][0] for k in keys], np.int64)[order]
        self.score = np.array([prefixes[k][1] for k in keys], np.float64)[order]

    def _hashes(self, chars: np.ndarray):
        """Function (starts, length) -> 64-bit hashes of the substrings."""
        n = len(chars)
        up, down = _Powers.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(self._VALUES)) * up[:n], out=total[1:])

        def of(starts, length):
            return mix64((total[starts + length] - total[starts]) * down[starts]
                         + np.asarray(length).astype(np.uint64))
        return of

    def forward(self, units: list):
        """Per unit: best score, loss of the second best (inf without one) and the best
        pieces (-1 for an unknown character), as (scores, gaps, ids, ends in ids)."""
        lens = np.array([len(u) for u in units], np.int64)
        off = np.cumsum(lens) - lens
        n, w = int(lens.sum()), int(min(self.width, lens.max()))
        hashed = self._hashes(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32))
        left = np.repeat(off + lens, lens) - np.arange(n)            # characters up to the unit's end
        sc = np.full((w + 1, n), -np.inf)                            # [length, start]
        idd = np.full((w + 1, n), -1, np.int64)
        alive = np.arange(n)
        for k in range(1, w + 1):
            alive = alive[left[alive] >= k]
            if not len(alive):
                break
            c = hashed(alive, k)
            i = np.minimum(np.searchsorted(self.code, c), len(self.code) - 1)
            ok = self.code[i] == c
            if k == 1:
                none = alive[~ok | (self.piece[i] < 0)]
                sc[1, none] = self.unknown_score
            alive, i = alive[ok], i[ok]
            has = self.piece[i] >= 0
            sc[k, alive[has]], idd[k, alive[has]] = self.score[i[has]], self.piece[i[has]]
        # Nodes: a unit of length l has l + 1 of them.
        node = off + np.arange(len(units))
        one, two = np.full(n + len(units), -np.inf), np.full(n + len(units), -np.inf)
        from_len = np.zeros(n + len(units), np.int64)
        one[node] = 0.0
        for j in range(1, int(lens.max()) + 1):
            u = np.flatnonzero(lens >= j)
            ks = np.arange(min(j, w), 0, -1)                         # longest last piece first
            start, at = off[u] + j - ks[:, None], node[u] + j - ks[:, None]
            s = sc[ks[:, None], start]
            m1 = one[at] + s
            k1 = m1.argmax(0)
            cols = np.arange(len(u))
            best = m1[k1, cols]
            m1[k1, cols] = two[at[k1, cols]] + s[k1, cols]
            one[node[u] + j], two[node[u] + j], from_len[node[u] + j] = best, m1.max(0), ks[k1]
        last = node + lens
        with np.errstate(invalid="ignore"):
            gap = np.where(np.isfinite(two[last]), one[last] - two[last], np.inf)
        # Backwards along the best pieces, all units at once.
        at, who, cols_u, cols_i = lens.copy(), np.arange(len(units)), [], []
        while len(who):
            k = from_len[node[who] + at[who]]
            cols_u.append(who)
            cols_i.append(idd[k, off[who] + at[who] - k])
            at[who] -= k
            who = who[at[who] > 0]
        u, i = np.concatenate(cols_u)[::-1], np.concatenate(cols_i)[::-1]
        order = np.argsort(u, kind="stable")
        return one[last], gap, i[order], np.cumsum(np.bincount(u, minlength=len(units)))


def combine(lists: list, n_best: int) -> list:
    """The ``n_best`` smallest sums of one loss from each list: (loss, choice per list).
    Every list is ascending and starts with 0."""
    start = (0.0, (0,) * len(lists))
    agenda, seen, out = [start], {start[1]}, []
    while agenda and len(out) < n_best:
        loss, choice = heapq.heappop(agenda)
        out.append((loss, choice))
        for k, i in enumerate(choice):
            if i + 1 < len(lists[k]):
                more = choice[:k] + (i + 1,) + choice[k + 1:]
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(agenda, (loss - lists[k][i] + lists[k][i + 1], more))
    return out


class Encoder:
    """Encodes texts; remembers units. One per task."""

    def __init__(self, model: bytes, n_best: int = N_BEST):
        self.lattice, self.n_best = Lattice(model), n_best
        self.matcher = Matcher(self.lattice)
        self._clear()

    def _clear(self):
        self.number: dict = {}
        self.name: list = []
        self.best_bytes: list = []       # ids of a unit's best segmentation, as int32 bytes
        self.ways: dict = {}             # (score, ids) lists of the units that were searched backwards
        self.score = np.zeros(1 << 15)
        self.gap = np.zeros(1 << 15)     # loss of the second best, infinite without one
        self.count = np.zeros(1 << 15, np.int64)

    def _learn(self, units: list) -> None:
        """Forward pass for new units, many at once; over-long ones go one by one."""
        long = [u for u in units if len(u) > LONG_UNIT]
        units = [u for u in units if len(u) <= LONG_UNIT]
        for i in range(0, len(units), AT_ONCE):
            part = units[i:i + AT_ONCE]
            score, gap, ids, ends = self.matcher.forward(part)
            raw = ids.astype(np.int32).tobytes()
            e = (ends * 4).tolist()
            best = [raw[a:b] for a, b in zip([0] + e, e)]
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
                best[k] = np.array(self.lattice.search(part[k], 1)[0][1], np.int32).tobytes()
            self._add(part, best, score, gap)
        for u in long:
            ways = self.lattice.search(u, self.n_best)
            self._add([u], [np.array(ways[0][1], np.int32).tobytes()], [ways[0][0]],
                      [ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf])

    def _add(self, units, best, score, gap):
        k = len(self.name)
        while k + len(units) > len(self.score):
            self.score, self.gap, self.count = (np.concatenate([x, np.zeros_like(x)])
                                                for x in (self.score, self.gap, self.count))
        to = slice(k, k + len(units))
        self.score[to], self.gap[to] = score, gap
        self.count[to] = [len(b) // 4 for b in best]
        self.number.update(zip(units, range(k, k + len(units))))
        self.name += units
        self.best_bytes += best

    def _ways(self, k: int) -> list:
        """The n best of a unit by backward A*."""
        w = self.ways.get(k)
        if w is None:
            w = self.ways[k] = self.lattice.search(self.name[k], self.n_best)
        return w

    def numbers(self, texts: list) -> list:
        """Per text the numbers of its units."""
        if len(self.name) > UNIT_LIMIT:
            self._clear()
        units = [self.lattice.units(t) for t in texts]
        new = set().union(*units).difference(self.number)
        if new:
            self._learn(sorted(new))
        get = self.number.__getitem__
        return [list(map(get, u)) for u in units]

    def encode_numbers(self, order: list) -> tuple:
        """(best ids as int32 bytes, scores of the n best, their numbers of pieces)"""
        if not order:
            return b"", [0.0], [0]
        at = np.array(order, np.int64)
        # The n - 1 units whose second best costs least; of equal ones the first.
        few = min(self.n_best - 1, len(at))
        where = np.zeros(0, np.int64)
        if few:
            gap = self.gap[at]
            limit = np.partition(gap, few - 1)[few - 1]
            below = np.flatnonzero(gap < limit)
            where = np.sort(np.concatenate([below, np.flatnonzero(gap == limit)[:few - len(below)]]))
            where = where[np.isfinite(gap[where])]
        options = [self._ways(k) for k in at[where].tolist()]
        ways = combine([[o[0][0] - s for s, _ in o] for o in options], self.n_best)
        total, pieces = float(self.score[at].sum()), int(self.count[at].sum())
        scores = [total - loss for loss, _ in ways]
        counts = [pieces + sum(len(o[i][1]) - len(o[0][1]) for o, i in zip(options, choice)) for _, choice in ways]
        return b"".join(map(self.best_bytes.__getitem__, order)), scores, counts

    def encode(self, texts: list) -> list:
        """Per text (null: None): (best ids as int32 bytes, scores, piece counts, round trip)"""
        out: list = []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[i:i + TEXTS_AT_ONCE]
            numbers = iter(self.numbers([t for t in part if t is not None]))
            for t in part:
                if t is None:
                    out.append(None)
                    continue
                got = self.encode_numbers(next(numbers))
                back = self.lattice.decode_bytes(np.frombuffer(got[0], np.int32))
                out.append((*got, back == t.encode()))
        return out

    def n_best_ids(self, text: str) -> list:
        """(score, ids) of the n best segmentations of a whole text."""
        at = self.numbers([text])[0]
        ways = combine([[self._ways(k)[0][0] - s for s, _ in self._ways(k)] for k in at], self.n_best)
        total = sum(self._ways(k)[0][0] for k in at)
        return [(total - loss, [x for k, i in zip(at, choice) for x in self._ways(k)[i][1]]) for loss, choice in ways]


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file, read on the driver and shipped to the tasks (0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL_PATH, n_best: int = N_BEST, keep_ids: bool = False) -> DataFrame:
    """Per document row: doc_id, n_pieces, best_score, scores and piece counts of the
    n best, SHA-256 of the best ids (int32, little-endian), roundtrip (decoding the
    best ids gives the text) and, with ``keep_ids``, the ids themselves."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(read_model(model_path))

    def run(batches):
        enc = Encoder(shared.value, n_best)
        for b in batches:
            got = enc.encode(b.column("text").to_pylist())
            cols = {
                "doc_id": b.column("doc_id"),
                "n_pieces": pa.array([g and g[2][0] for g in got], pa.int64()),
                "best_score": pa.array([g and g[1][0] for g in got], pa.float64()),
                "nbest_scores": pa.array([g and g[1] for g in got], pa.list_(pa.float64())),
                "nbest_pieces": pa.array([g and g[2] for g in got], pa.list_(pa.int64())),
                "ids_sha256": pa.array([g and hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()),
                "roundtrip": pa.array([g and g[3] for g in got], pa.bool_()),
            }
            if keep_ids:
                flat = np.frombuffer(b"".join(g[0] for g in got if g), np.int32)
                ends = np.cumsum([0] + [len(g[0]) // 4 if g else 0 for g in got]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat),
                                                       mask=pa.array([g is None for g in got], pa.bool_()))
            yield pa.record_batch(cols)

    schema = ("doc_id long, n_pieces long, best_score double, nbest_scores array<double>, nbest_pieces array<long>, "
              "ids_sha256 string, roundtrip boolean" + (", ids array<int>" if keep_ids else ""))
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text."""
    shared = prepare(encoded.sparkSession).sparkContext.broadcast(read_model(model_path))

    def run(batches):
        lattice = Lattice(shared.value)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(
                [None if i is None else lattice.decode(i) for i in b.column("ids").to_pylist()], pa.string())],
                names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
