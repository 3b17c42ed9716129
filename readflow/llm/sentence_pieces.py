"""Sampled segmentations into the pieces of a SentencePiece vocabulary, and back.

Every segmentation of a text has a probability in proportion to the product of its pieces' weights (by
Zipf's law from the vocabulary's ranks, to the power of ``theta``). k of them are drawn without
replacement by Gumbel top-k: a search over the lattice keeps an agenda of groups of segmentations, each
with the largest Gumbel-perturbed log probability within it. The best group is popped; the path that
attains it is sampled, and what else was in the group splits along the path into groups whose maxima are
Gumbels cut off at the popped one. The order of popping is the order of the perturbed scores, so the
samples are distinct. With the next perturbed score kappa, a sample of log probability q has the
inclusion probability 1 - exp(-exp(q - kappa)).

Pieces never join a letter to a non-letter, nor anything to a following word mark, so a lattice is a
chain of units. The lattices of the distinct units of a slice are built together in numpy, and all paths
of a slice walk them in step. Random numbers are hashes of the row's key, the sample and the place, so
results depend on the row alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices
from .substring_dedup import powers, rolling

MARK = 0x2581
#: log weight of a fallback to bytes, per byte.
BYTE = -14.0
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _kinds() -> np.ndarray:
    """0 for the word mark, 1 for letters and combining marks, 2 for all else, by code point."""
    kinds = np.full(0x110000, 2, np.uint8)
    letters = regex.compile(r"[\p{L}\p{M}]+")
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):  # all but the surrogates
        for m in letters.finditer("".join(map(chr, range(start, end)))):
            kinds[start + m.start() : start + m.end()] = 1
    kinds[MARK] = 0
    return kinds


class Vocabulary:
    """Pieces by length and hash, with their log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.kinds = _kinds()
        special = {i for i in range(len(self.names)) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(x[1:-1], 16): i for i, x in enumerate(self.names) if model.is_byte(i)}
        by_size: dict[int, list[tuple[str, int]]] = {}
        rank = 0
        self.weight = np.full(len(self.names), BYTE)
        for i, x in enumerate(self.names):
            if i not in special and not model.is_byte(i):
                rank += 1
                self.weight[i] = -np.log(rank + 1.0)
                by_size.setdefault(len(x), []).append((x, i))
        self.by_size = {}
        for n, found in by_size.items():
            points = np.array([[ord(c) for c in x] for x, _ in found], np.uint32)
            h = (self.hashes(points) * powers(n)[0]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)  # most places have no piece of a length: a look at this tells
            maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.by_size[n] = h[order], np.array([i for _, i in found])[order], maybe
        value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = pa.array([value.get(i, x.replace(chr(MARK), " ").encode()) for i, x in enumerate(self.names)], pa.binary())

    @staticmethod
    def hashes(points: np.ndarray) -> np.ndarray:
        return mixed(points.astype(np.uint64) + np.uint64(1))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of many units, one after the other in ``points``; edges in the order of their places.

    The edges of a place stand by size, longest first; upto is their cumulative probability, 2 at the last.
    """

    def __init__(self, points: np.ndarray, starts: np.ndarray, vocab: Vocabulary, theta: float):
        n = len(points)
        ends = np.append(starts[1:], n)
        left = np.repeat(ends, ends - starts) - np.arange(n)  # characters up to the unit's end
        h = vocab.hashes(points)
        src, size, piece = [], [], []
        for m, (known, ids, maybe) in sorted(vocab.by_size.items(), reverse=True):
            at = np.flatnonzero(left >= m)
            if not len(at):
                continue
            x = rolling(h, m)[at]
            some = maybe[(x & np.uint64(len(maybe) - 1)).astype(np.int64)]
            at, x = at[some], x[some]
            found = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[found] == x
            src.append(at[hit])
            size.append(np.full(len(src[-1]), m))
            piece.append(ids[found[hit]])
        single = np.zeros(n, bool)
        if src:  # the last are the pieces of one character
            single[src[-1]] = True
        lost = np.flatnonzero(~single)  # characters without a piece: their bytes
        src.append(lost)
        size.append(np.ones(len(lost), int))
        piece.append(-points[lost].astype(np.int64) - 1)
        src, size, piece = np.concatenate(src), np.concatenate(size), np.concatenate(piece)
        order = np.argsort(src, kind="stable")
        self.src, size, self.piece = src[order], size[order], piece[order]
        self.target = np.where(size == left[self.src], -1, self.src + size)
        cost = np.where(self.piece >= 0, vocab.weight[np.maximum(self.piece, 0)], BYTE * byte_count(self.piece)) * theta
        # Log sums from the ends of the units backwards, all units together.
        beta = np.zeros(n + 1)
        by_left = np.argsort(left[self.src], kind="stable")
        cuts = np.searchsorted(left[self.src][by_left], np.arange(1, (left.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            e = by_left[a:b]
            v = cost[e] + beta[self.target[e]]  # beta[-1] is that of the end, 0
            s = self.src[e]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(v, first)
            beta[s[first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(first, len(s))))), first))
        self.logp = np.minimum(cost + beta[self.target] - beta[self.src], 0.0)
        self.first = np.searchsorted(self.src, np.arange(n + 1))
        total = np.concatenate([[0.0], np.cumsum(np.exp(self.logp))])
        self.upto = total[1:] - total[self.first[self.src]]
        self.upto[self.first[1:] - 1] = 2.0  # the last edge of a place takes the rest
        only = np.diff(self.first)[self.src] == 1
        self.logp[only] = 0.0

    def walk(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from states to their units' ends: edges one after the other, and their counts."""
        active, s, steps, t = np.arange(len(states)), states, [], 0
        while len(active):
            e, u = self.first[s], uniform(keys[active], t)
            wait = np.flatnonzero(self.upto[e] <= u)
            while len(wait):
                e[wait] += 1
                wait = wait[self.upto[e[wait]] <= u[wait]]
            steps.append((active, e))
            s = self.target[e]
            keep = s >= 0
            active, s, t = active[keep], s[keep], t + 1
        counts = np.bincount(np.concatenate([a for a, _ in steps]), minlength=len(states)) if steps else np.zeros(len(states), int)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for t, (active, e) in enumerate(steps):
            out[at[active] + t] = e
        return out, counts


def byte_count(piece: np.ndarray) -> np.ndarray:
    """Bytes of the characters -piece - 1; 1 for pieces."""
    c = -piece - 1
    return np.where(piece >= 0, 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    return ((mixed(keys + np.uint64((salt + 1) * int(_C[0]) % 2**64)) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _cut(loc: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbels at loc, cut off at bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return loc - np.log(np.exp(np.minimum(loc - bound, 700.0)) - np.log(u))


class _Text:
    """The agenda and the samples of one text."""

    def __init__(self, key: np.uint64, starts: np.ndarray, k: int):
        self.key, self.starts, self.k = key, starts, k
        self.agenda: list[tuple] = []
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []  # edges and the unit of each
        self.scores: list[float] = []
        self.turn = 0

    def draw(self, n: int) -> np.ndarray:
        self.turn += 1
        with np.errstate(over="ignore"):
            return uniform(self.key + np.arange(n, dtype=np.uint64) * _C[1], 1_000_003 * self.turn)

    def take(self, lattice: Lattice, edges: np.ndarray, units: np.ndarray, since: int, bound: float) -> None:
        """Keeps a sampled path and puts what else its steps from ``since`` offered on the agenda."""
        lp = lattice.logp[edges]
        upto = np.cumsum(lp)
        self.paths.append((edges, units))
        self.scores.append(float(upto[-1]) if len(lp) else 0.0)
        new = lp[since:]
        with np.errstate(divide="ignore"):
            loc = (upto[since:] - new) + np.log(-np.expm1(np.minimum(new, 0.0)))
        g = np.where(np.isfinite(loc), _cut(loc, bound, self.draw(len(loc))), -np.inf) if len(loc) else loc
        top = np.argpartition(-g, self.k)[: self.k + 1] if len(g) > self.k + 1 else np.arange(len(g))
        for i in top:
            if g[i] > -np.inf:
                heapq.heappush(self.agenda, (-float(g[i]), len(self.paths) - 1, since + int(i), (int(edges[since + i]),), float(upto[since + i] - new[i])))

    def pop(self, lattice: Lattice):
        """The next path's known part and the state from which it goes on; None if there is none."""
        if not self.agenda:
            return None
        low, path, step, gone, before = heapq.heappop(self.agenda)
        edges, units = self.paths[path]
        place = lattice.src[edges[step]]
        free = np.array([e for e in range(lattice.first[place], lattice.first[place + 1]) if e not in gone])
        p = np.exp(lattice.logp[free])
        e = int(free[min(np.searchsorted(np.cumsum(p), self.draw(1)[0] * p.sum(), side="right"), len(free) - 1)])
        rest = p.sum() - np.exp(lattice.logp[e])
        if len(free) > 1 and rest > 0:
            g = _cut(np.array([before + np.log(rest)]), -low, self.draw(1))[0]
            heapq.heappush(self.agenda, (-float(g), path, step, (*gone, e), before))
        return np.append(edges[:step], e), units[: step + 1], int(lattice.target[e]), -low, step


def sample_slice(texts: list[str], keys: np.ndarray, vocab: Vocabulary, k: int, theta: float):
    """For each text its samples: (ids, log probability, log of the inclusion probability), best perturbed score first."""
    live = [i for i, x in enumerate(texts) if x]
    out: list[list[tuple[np.ndarray, float, float]]] = [[(np.empty(0, np.int32), 0.0, 0.0)] for _ in texts]
    if not live:
        return out
    raw = [np.frombuffer((" " + texts[i]).encode("utf-32-le"), np.uint32) for i in live]
    points = np.concatenate(raw)
    points[points == 0x20] = MARK
    text_ends = np.cumsum([len(x) for x in raw])
    kind = vocab.kinds[points]
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) & (kind[:-1] != 0)])
    new[text_ends[:-1]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(points)))
    # Units by hash; each distinct one gets a lattice.
    h = vocab.hashes(points)
    up, down = powers(len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
    code = (sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * _C[2]
    _, at, which = np.unique(code, return_index=True, return_inverse=True)
    lengths = sizes[at]
    begin = np.cumsum(lengths) - lengths
    spread = np.repeat(starts[at] - begin, lengths) + np.arange(int(lengths.sum()))
    lattice = Lattice(points[spread], begin, vocab, theta)
    state = begin[which]
    bounds = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    docs = [_Text(keys[i], state[a:b], k) for i, a, b in zip(live, bounds, bounds[1:], strict=False)]

    def walked(jobs: list[tuple[int, np.ndarray, np.ndarray]], turn: int):
        """Paths for jobs (text, states, unit numbers), all in step."""
        if not jobs:
            return
        n = [len(s) for _, s, _ in jobs]
        key = np.repeat(np.array([docs[d].key for d, _, _ in jobs], np.uint64), n)
        unit = np.concatenate([u for _, _, u in jobs])
        with np.errstate(over="ignore"):
            key = mixed(key + unit.astype(np.uint64) * _C[1] + np.uint64((turn + 1) * int(_C[2]) % 2**64))
        edges, counts = lattice.walk(np.concatenate([s for _, s, _ in jobs]), key)
        units = np.repeat(unit, counts)
        ends = np.cumsum(counts)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        for (d, _, _), a, b in zip(jobs, upto, upto[1:], strict=False):
            yield d, edges[a:b], units[a:b]

    jobs = [(d, x.starts, np.arange(len(x.starts))) for d, x in enumerate(docs)]
    for d, edges, units in walked(jobs, 0):
        x = docs[d]
        x.take(lattice, edges, units, 0, float(-np.log(-np.log(x.draw(1)[0]))))
    for turn in range(1, k):
        jobs, known = [], {}
        for d, x in enumerate(docs):
            if (found := x.pop(lattice)) is None:
                continue
            edges, units, target, bound, step = found
            unit = int(units[-1])
            later = np.arange(unit + 1, len(x.starts))
            s, u = x.starts[unit + 1 :], later
            if target >= 0:
                s, u = np.append(target, s), np.append(unit, u)
            known[d] = edges, units, bound, step
            jobs.append((d, s, u))
        for d, edges, units in walked(jobs, turn):
            head, first, bound, step = known[d]
            docs[d].take(lattice, np.concatenate([head, edges]), np.concatenate([first, units]), step + 1, bound)
    for i, x in zip(live, docs, strict=True):
        kappa = -x.agenda[0][0] if x.agenda else -np.inf
        out[i] = [(expand(lattice.piece[e], vocab), q, log_inclusion(q - kappa)) for (e, _), q in zip(x.paths, x.scores, strict=True)]
    return out


def log_inclusion(d: float) -> float:
    """log(1 - exp(-exp(d))), which is d itself where exp(d) is lost beside 1."""
    return d if d < -36 else float(np.log(-np.expm1(-np.exp(min(d, 700.0)))))


def expand(piece: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Identifiers of pieces; characters without a piece become the identifiers of their bytes."""
    lost = np.flatnonzero(piece < 0)
    if not len(lost):
        return piece.astype(np.int32)
    parts, upto = [], 0
    for i in lost:
        parts += [piece[upto:i], [vocab.bytes[b] for b in chr(-int(piece[i]) - 1).encode()]]
        upto = i + 1
    return np.concatenate([*parts, piece[upto:]]).astype(np.int32)


def sample_pieces(df: DataFrame, path: str, k: int = 2, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", chars: int = 1_500_000, decoded: bool = False) -> DataFrame:
    """id_col, sample (from 1), ids (array of int), log_prob, log_inclusion: k distinct segmentations of each text.

    With ``decoded`` there is also decoded, the text that the identifiers give, made in the same slices.

    path is a .model file that every worker can read. Texts are worked on in slices of about ``chars``
    bytes, which bounds a worker's memory but for longer single texts; these are taken whole. A text with fewer
    segmentations gives them all, with an inclusion of 1 (log 0); an empty or null one gives one empty sample. The
    seed is the hash of id and text (null has one of its own), so equal rows have equal samples, on every run. The
    inclusion of a sample of a long text is below what a double can tell from 0, so its log is given. An empty table
    gives no rows; other columns, whatever their names, aren't read.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("key"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in slices(batch, chars=chars):
                found = sample_slice(part.column(1).to_pylist(), part.column(2).to_numpy().view(np.uint64), vocab, k, theta)
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                flat = [y for x in found for y in x]
                ends = np.concatenate([[0], np.cumsum([len(y[0]) for y in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([y[0] for y in flat]).astype(np.int32)))
                place = pa.array([j + 1 for x in found for j in range(len(x))], pa.int32())
                back = [decode_lists(ids, vocab)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), place, ids, pa.array([y[1] for y in flat], pa.float64()), pa.array([y[2] for y in flat], pa.float64()), *back], ["id", "sample", "ids", "log_prob", "log_inclusion", "decoded"][: 5 + decoded])

    id_type = rows.schema[0].dataType.simpleString()
    found = rows.mapInArrow(sample, f"id {id_type}, sample int, ids array<int>, log_prob double, log_inclusion double" + ", decoded string" * decoded)
    return found.withColumnRenamed("id", id_col)


def decode_lists(ids: pa.Array, vocab: Vocabulary) -> pa.Array:
    """The texts of segmentations: bytes join to characters, word marks are spaces, the first goes."""
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))]), pa.int32()), vocab.raw.take(ids.flatten()))
    joined = pc.if_else(ids.is_valid(), pc.binary_join(pieces, b""), None)
    return pc.utf8_slice_codeunits(joined.cast(pa.string()), 1)


def decode(ids: Column, path: str) -> Column:
    """Column of texts from a column of identifier arrays; a null array gives null, an empty one an empty text."""

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return decode_lists(x, vocabulary(path))

    return text(ids)
