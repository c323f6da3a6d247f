"""Distinct random segmentations of a text into SentencePiece pieces, and back.

A segmentation is a path through the lattice of pieces and has the product of
its pieces' weights.  Gumbel top-k gives k different paths as if drawn one
after the other without replacement: every path has its log weight plus Gumbel
noise, and the k largest sums are wanted.  The search never lists paths.  A set
of paths with a common beginning has the Gumbel noise of its total weight as
its best sum, so an agenda of such sets, best first, is an A* search whose
bound is exact: the set on top is opened along one path, drawn from the top
down, and what leaves that path at each of its steps goes back to the agenda
with noise below the sum just taken.

All texts of a chunk go together; each step is one numpy operation over them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import chunked, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 4
#: Text that shares lattices, and text that is sampled at once with them: arrays of the latter stay in a cache.
CHUNK = 2 << 20
AT_ONCE = 256 << 10

#: SentencePiece writes a space as this character and puts one before the text.
SPACE = "▁"
_UNITS = re.compile(" +[^ ]*")
_ODD = mixed(np.arange(31, 39, dtype=np.uint64)) | np.uint64(1)
NEVER = -np.inf


@dataclass
class Vocabulary:
    """Texts, ids and log weights of the pieces, by length in characters; the ids of the byte pieces."""

    texts: list[str]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    byte_weight: float
    size: int

    def __post_init__(self) -> None:
        lengths = np.array([len(t) for t in self.texts])
        spelled = [_hashes_of(t) for t in self.texts]
        hashes = np.array([h[-1] for h in spelled], np.uint64)
        # A run of characters that begins no piece need not be followed further; the table errs only towards following.
        self.begins = np.zeros(1 << 20, bool)
        self.begins[self._slot(np.concatenate(spelled), 44)] = True
        order = np.argsort(hashes)
        self.hashes, self.lengths, self.longest = hashes[order], lengths[order], int(lengths.max())
        self.texts, self.ids, self.weights = [self.texts[i] for i in order.tolist()], self.ids[order], self.weights[order]
        # Two tables by different bits of the hash: the second for pieces that found their place in the first taken.
        self.tables = [np.full(1 << 20, -1, np.int32) for _ in range(2)]
        left = np.arange(len(self.hashes))
        for table, shift in zip(self.tables, (44, 20), strict=True):
            slot = self._slot(self.hashes[left], shift)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
        self.rest = {int(self.hashes[i]): int(i) for i in left.tolist()}
        self.bytes_of: list[bytes] = [b""] * self.size
        for i, t in zip(self.ids.tolist(), self.texts, strict=True):
            self.bytes_of[i] = t.encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])

        # Characters of each id in a row, to check round trips; bytes of longer characters have none.
        chars = [b.decode("ascii", "ignore") if len(b) == 1 else b.decode() for b in self.bytes_of]
        self.char_counts = np.array([len(c) for c in chars])
        self.char_starts = np.cumsum(self.char_counts) - self.char_counts
        self.chars = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32)
        self.partial = np.zeros(self.size, bool)
        self.partial[self.byte_ids[128:]] = True

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 where there is none."""
        out = self.tables[0][self._slot(hashes, 44)]
        some = np.flatnonzero(out >= 0)
        miss = some[self.hashes[out[some]] != hashes[some]]
        second = self.tables[1][self._slot(hashes[miss], 20)]
        out[miss] = np.where((second >= 0) & (self.hashes[second] == hashes[miss]), second, -1)
        for h, i in self.rest.items():
            out[hashes == np.uint64(h)] = i
        return out

    def spell(self, ids: np.ndarray, text: str, codes: np.ndarray) -> bool:
        """Whether ``ids`` decode to the text, which has the code points ``codes``."""
        if self.partial[ids].any():
            return self.decode(ids.tolist()) == text
        counts = self.char_counts[ids]
        ends = np.cumsum(counts)
        if not len(ids):
            return not text
        if ends[-1] != len(codes) + 1:
            return False
        got = self.chars[np.repeat(self.char_starts[ids] - ends + counts, counts) + np.arange(ends[-1])]
        return got[0] == 32 and bool((got[1:] == codes).all())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of which ``ids`` are a segmentation."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _fold(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return mixed(hashes * _ODD[0] + chars.astype(np.uint64) + np.uint64(1))


def _hashes_of(text: str) -> np.ndarray:
    """Hash of every beginning of a text."""
    h, out = np.zeros(1, np.uint64), np.empty(len(text), np.uint64)
    for i, c in enumerate(text):
        h = _fold(h, np.array([ord(c)]))
        out[i] = h[0]
    return out


def read_vocabulary(path: str = MODEL, temperature: float = 1.0) -> Vocabulary:
    """The pieces of a SentencePiece model.

    A BPE model has ranks in place of probabilities; a piece of rank r weighs
    1 / (r + 2), normalised, to the power 1 / temperature.  Characters without
    a piece fall back to bytes, each as unlikely as the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    bytes_ = [i for i in range(size) if model.is_byte(i)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    texts = [model.id_to_piece(i).replace(SPACE, " ") for i in plain]
    if any(" " in t.lstrip(" ") for t in texts) or len(bytes_) != 256:
        raise ValueError("needs a model whose pieces have spaces only at their beginning, and byte pieces")
    rank = np.argsort(np.argsort([-model.get_score(i) for i in plain], kind="stable"))
    weights = -np.log(rank + 2.0)
    weights = (weights - np.log(np.exp(weights).sum())) / temperature
    return Vocabulary(texts, np.array(plain), weights, np.array(bytes_), float(weights.min()), size)


class Lattices:
    """Edges of the lattices of some units, all in one numbering, with the chance of each edge at its node."""

    def __init__(self, units: list[str], vocabulary: Vocabulary):
        text = "".join([f" {u}" for u in units])
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(u) + 1 for u in units), np.int64, len(units))
        ends = np.cumsum(sizes)
        # A node before each character, and one at the end of each unit.
        self.start = ends - sizes + np.arange(len(units))
        unit = np.repeat(np.arange(len(units)), sizes)
        char_node = np.arange(len(self.codes)) + unit
        left = np.repeat(ends, sizes) - np.arange(len(self.codes))
        nodes = len(self.codes) + len(units)
        source, target, piece = self._edges(vocabulary, left, char_node)
        self.is_end = np.zeros(nodes, bool)
        self.is_end[self.start + sizes] = True
        left_of = np.zeros(nodes, np.int32)
        left_of[char_node] = left
        # By characters left, then by source: each length's edges come by source already, and short keys are dealt, not compared.
        order = np.argsort(source, kind="stable")
        by_left = left_of[source[order]]
        short = int(by_left.max(initial=0)) < 1 << 16
        order = order[np.argsort(by_left.astype(np.uint16) if short else by_left, kind="stable")]
        self.source, self.target, self.piece = source[order], target[order], piece[order]
        self._name_and_weigh(vocabulary)
        self._sum_up(nodes, left_of)

    def _edges(self, v: Vocabulary, left: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, hashes = np.arange(len(self.codes)), np.zeros(len(self.codes), np.uint64)
        source, target, piece = ([np.empty(0, np.int32)] for _ in range(3))
        for size in range(1, v.longest + 1):
            inside = left[at] >= size
            at, hashes = at[inside], hashes[inside]
            if not len(at):
                break
            hashes = _fold(hashes, self.codes[at + size - 1])
            found = v.find(hashes)
            hit = found >= 0
            if size == 1:
                # Characters without a piece go as bytes: -1 less the character's place.
                found = np.where(hit, found, -1 - at)
                hit = np.ones(len(at), bool)
            from_ = node[at[hit]].astype(np.int32)
            source.append(from_)
            target.append(from_ + np.int32(size))
            piece.append(found[hit].astype(np.int32))
            on = v.begins[v._slot(hashes, 44)]
            at, hashes = at[on], hashes[on]
        # The longest pieces first: they are the likeliest, so a draw mostly ends at the first edge of its node.
        return tuple(np.concatenate(parts[::-1]) for parts in (source, target, piece))

    def _name_and_weigh(self, v: Vocabulary) -> None:
        """Weight and id of each edge; the id of a character that goes as several bytes is -1."""
        plain = np.maximum(self.piece, 0)
        self.weight, self.edge_id = v.weights[plain], v.ids[plain].astype(np.int32)
        as_bytes = np.flatnonzero(self.piece < 0)
        code = self.codes[-1 - self.piece[as_bytes].astype(np.int64)]
        count = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        self.weight[as_bytes] = count * v.byte_weight
        self.edge_id[as_bytes] = np.where(count == 1, v.byte_ids[np.minimum(code, 0x7F)], -1)

    def _sum_up(self, nodes: int, left_of: np.ndarray) -> None:
        """Total log weight of the paths from each node, by characters left; then chances of the edges."""
        total = np.zeros(nodes)
        left = left_of[self.source]
        level = np.searchsorted(left, np.arange(1, (int(left[-1]) if len(left) else 0) + 2))
        for low, high in zip(level.tolist(), level[1:].tolist(), strict=False):
            values = self.weight[low:high] + total[self.target[low:high]]
            s = self.source[low:high]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(values, first)
            shares = np.exp(values - np.repeat(top, np.diff(np.append(first, len(s)))))
            total[s[first]] = top + np.log(np.add.reduceat(shares, first))
        self.log_chance = self.weight + total[self.target] - total[self.source]
        chance = np.exp(self.log_chance)
        new = np.flatnonzero(np.concatenate([[True], self.source[1:] != self.source[:-1]])) if len(left) else np.empty(0, np.int64)
        self.first = np.full(nodes, -1, np.int32)
        self.first[self.source[new]] = new
        self.last = np.full(nodes, -1, np.int32)
        self.last[self.source[new]] = np.append(new[1:], len(left)) - 1
        # Added up node by node, so that rounding does not depend on the nodes before.
        self.cumulative = chance.copy()
        e, last = new, self.last[self.source[new]] if len(new) else new
        while len(e):
            on = e < last
            e, last = e[on] + 1, last[on]
            self.cumulative[e] += self.cumulative[e - 1]
        self.chance = chance
        # What leaving a path at an edge's node weighs: the other edges, none where there is no other.
        with np.errstate(divide="ignore"):
            self.beside = np.log1p(-np.minimum(chance, 1 - 1e-16))
        self.beside[self.first[self.source] == self.last[self.source]] = NEVER
        del self.weight

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node by its chance."""
        edge = self.first[node].copy()
        last = self.last[node]
        open_ = np.flatnonzero((self.cumulative[edge] < u) & (edge < last))
        while len(open_):
            edge[open_] += 1
            e = edge[open_]
            open_ = open_[(self.cumulative[e] < u[open_]) & (e < last[open_])]
        return edge

    def piece_ids(self, edges: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Piece ids along a path; a character without a piece gives one per byte."""
        ids = self.edge_id[edges]
        several = np.flatnonzero(ids < 0)
        if not len(several):
            return ids
        bytes_of = [v.byte_ids.astype(np.int32)[list(chr(int(self.codes[-1 - p])).encode("utf-8", "surrogatepass"))] for p in self.piece[edges[several]].tolist()]
        parts = np.split(ids, several)
        return np.concatenate([parts[0], *[x for b, rest in zip(bytes_of, parts[1:], strict=True) for x in (b, rest[1:])]])


def uniform(seed: np.ndarray, *numbers: np.ndarray | int, first: int = 1) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and the given counters alone."""
    h = seed
    for k, n in enumerate(numbers):
        h = h + np.atleast_1d(n).astype(np.uint64) * _ODD[first + k]
    return ((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def below(limit: np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel maximum of a set of that log mass, given that it is at most ``limit``."""
    with np.errstate(over="ignore"):
        return limit - np.log1p(-np.log(u) * np.exp(limit - log_mass))


@dataclass
class Opened:
    """One path per text, from where it leaves an earlier one: its steps and the agenda entry beside each."""

    text: np.ndarray
    unit: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    place: np.ndarray
    noise: np.ndarray

    def __post_init__(self) -> None:
        """The best entry of each text; a text's entries stand together."""
        n = len(self.text)
        self.starts = np.flatnonzero(np.concatenate([[True], self.text[1:] != self.text[:-1]])) if n else np.empty(0, np.int64)
        self.owners = self.text[self.starts]
        self.stops = np.append(self.starts[1:], n)[: len(self.starts)]
        self.top = np.maximum.reduceat(self.noise, self.starts) if n else np.empty(0)
        hit = np.flatnonzero(self.noise == np.repeat(self.top, self.stops - self.starts))
        self.top_at = hit[np.searchsorted(hit, self.starts)]

    def renew(self, text: int) -> None:
        i = int(np.searchsorted(self.owners, text))
        at = int(self.starts[i]) + int(np.argmax(self.noise[self.starts[i] : self.stops[i]]))
        self.top[i], self.top_at[i] = self.noise[at], at


class Sampler:
    """Top-k search over some texts, each a run of ``kinds`` of units up to one of ``ends``."""

    def __init__(self, lattices: Lattices, kinds: np.ndarray, ends: np.ndarray, seeds: np.ndarray):
        self.lattices, self.kind, self.ends, self.seeds = lattices, kinds, ends, seeds
        self.begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
        self.opened: list[Opened] = []
        #: Per text: (edges, log probability, perturbed log probability) of what was drawn.
        #: A text draws once a round until it has no more, so draw p is the one that opened path p.
        self.drawn: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in ends]
        self.used: dict[tuple[int, int], list[int]] = {}

    def run(self, k: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """(draws, threshold) per text; the threshold is the sum that the next draw would have had."""
        n = len(self.ends)
        all_texts = np.arange(n)
        top = -np.log(-np.log(uniform(self.seeds, 0)))
        self._open(all_texts, self.begins, np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), top, [np.empty(0, np.int64)] * n)
        threshold = np.full(n, NEVER)
        for step in range(1, k + 1):
            best, where = self._best()
            threshold = best
            texts = np.flatnonzero(best > NEVER)
            if step == k or not len(texts):
                break
            self._advance(texts, best[texts], where[:, texts], step)
        return list(zip(self.drawn, threshold.tolist(), strict=True))

    def _best(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest sum on each text's agenda, and where it stands: (path, entry)."""
        n = len(self.ends)
        best, where = np.full(n, NEVER), np.zeros((2, n), np.int64)
        for p, o in enumerate(self.opened):
            better = np.flatnonzero(o.top > best[o.owners])
            text = o.owners[better]
            best[text] = o.top[better]
            where[0, text], where[1, text] = p, o.top_at[better]
        return best, where

    def _advance(self, texts: np.ndarray, limit: np.ndarray, where: np.ndarray, step: int) -> None:
        """Open the best set of each text along one path; the rest of the set stays on the agenda."""
        lat = self.lattices
        chosen, before, place, heads = [], [], [], []
        unit = np.empty(len(texts), np.int64)
        draws = uniform(self.seeds[texts], step, 1), uniform(self.seeds[texts], step, 2)
        for i, (text, p, entry) in enumerate(zip(texts.tolist(), *where.tolist(), strict=True)):
            o = self.opened[p]
            edge = int(o.edge[entry])
            node = int(lat.source[edge])
            taken = self.used.setdefault((p, entry), [edge])
            free = [e for e in range(lat.first[node], lat.last[node] + 1) if e not in taken]
            chances = lat.chance[free]
            pick = free[min(int(np.searchsorted(np.cumsum(chances), draws[0][i] * chances.sum())), len(free) - 1)]
            taken.append(pick)
            rest = chances.sum() - lat.chance[pick] if len(free) > 1 else 0.0
            mass = o.before[entry] + np.log(max(rest, 1e-300)) if len(free) > 1 else NEVER
            o.noise[entry] = below(limit[i : i + 1], np.array([mass]), draws[1][i : i + 1])[0]
            o.renew(text)
            chosen.append(pick)
            before.append(float(o.before[entry] + lat.log_chance[pick]))
            place.append(int(o.place[entry]) + 1)
            heads.append(np.append(self.drawn[text][p][0][: int(o.place[entry])], pick))
            unit[i] = o.unit[entry]
        node = lat.target[np.array(chosen)]
        self._open(texts, unit, node, np.array(before), np.array(place), limit, heads)

    def _open(self, texts, unit, node, before, place, limit, heads) -> None:
        """Draw the rest of a path for each text: from ``node`` in ``unit`` (-1: its start) through the last unit."""
        lat, step = self.lattices, len(self.opened)
        count = self.ends[texts] - unit
        inst = np.repeat(unit - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = lat.start[self.kind[inst]]
        head = np.cumsum(count) - count
        inner = (node >= 0) & (count > 0)
        at[head[inner]] = node[inner]
        seeds = mixed(self.seeds[texts] + np.full(1, step, np.uint64) * _ODD[7])
        live = np.flatnonzero(~lat.is_end[at])
        # A unit is known by its number within its text, so that draws do not depend on the texts beside it.
        within = (inst - np.repeat(self.begins[texts], count)).astype(np.uint64)
        nodes, salt = at[live], (np.repeat(seeds, count) + within * _ODD[1])[live]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pieces = np.zeros(len(at), np.int64)
        while len(live):
            edge = lat.pick(nodes, uniform(salt, len(found), first=2))
            found.append((live, edge))
            pieces[live] = len(found)
            nodes = lat.target[edge]
            on = np.flatnonzero(~lat.is_end[nodes])
            nodes, live, salt = nodes[on], live[on], salt[on]
        ends = np.cumsum(pieces)
        first = ends - pieces
        edges = np.empty(int(pieces.sum()), np.int32)
        for k, (who, e) in enumerate(found):
            edges[first[who] + k] = e
        starts = np.concatenate([[0], ends])[np.concatenate([head, [len(at)]])]
        each = np.diff(starts)
        log_chance = lat.log_chance[edges]
        # Each text adds up on its own: rounding, too, is the same whatever stands before it.
        prefix = np.empty(len(edges))
        for b, low, high in zip(before.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            prefix[low : low + 1] = b
            np.cumsum(log_chance[low : high - 1], out=prefix[low + 1 : high])
            prefix[low + 1 : high] += b
        places = np.arange(len(edges)) + np.repeat(place - starts[:-1], each)
        noise = below(np.repeat(limit, each), prefix + lat.beside[edges], uniform(np.repeat(seeds, each), places, 1 << 40))
        self.opened.append(Opened(np.repeat(texts, each), np.repeat(inst, pieces), edges, prefix, places, noise))
        for i, text in enumerate(texts.tolist()):
            low, high = starts[i], starts[i + 1]
            path = np.concatenate([heads[i], edges[low:high]]).astype(np.int64)
            self.drawn[text].append((path, float(before[i] + log_chance[low:high].sum()), float(limit[i])))


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Log chance that a segmentation is among the draws, given the threshold that the next would have had."""
    if threshold == NEVER:
        return 0.0
    rate = np.exp(min(log_prob - threshold, 700.0))
    return float(np.log(-np.expm1(-rate))) if rate > 1e-12 else log_prob - threshold


def units_of(text: str) -> list[str]:
    """Words with the spaces before them, without the first of these; the text has a space put before it."""
    if not text:
        return []
    parts = text.split(" ")
    return parts if "" not in parts else [u[1:] for u in _UNITS.findall(f" {text}")]


def segment(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int = SAMPLES, seed: int = 0) -> list[list[dict]]:
    """For each text up to ``k`` distinct segmentations: ids, log_prob, perturbed, log_inclusion.

    The first is a plain draw, and all are as drawn without replacement; fewer
    come where the text has no more.  An empty text has one, without pieces.
    """
    seeds = mixed(keys.astype(np.uint64) * _ODD[5] + np.full(1, seed, np.uint64))
    units = [units_of(t) for t in texts]
    distinct = dict.fromkeys(chain.from_iterable(units))
    lattices = Lattices(list(distinct), vocabulary)
    number = dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__
    kinds = [np.fromiter(map(number, u), np.int64, len(u)) for u in units]
    out, low, size = [], 0, 0
    for high, text in enumerate(texts, 1):
        size += len(text)
        if size >= AT_ONCE or high == len(texts):
            part = kinds[low:high]
            sampler = Sampler(lattices, np.concatenate(part), np.cumsum([len(p) for p in part]), seeds[low:high])
            for draws, threshold in sampler.run(k):
                out.append([{"ids": lattices.piece_ids(path, vocabulary), "log_prob": lp, "perturbed": g, "log_inclusion": log_inclusion(lp, threshold)} for path, lp, g in draws])
            low, size = high, 0
    return out


FIELDS = [T.StructField("n_pieces", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "log_inclusion")]
FIELDS += [T.StructField("ids_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]


def _as_lists(drawn: list[list[dict]], keep_ids: int) -> pa.ListArray:
    """The draws of each text as an array of lists; ids beyond the first ``keep_ids`` of a text are null."""
    flat = list(chain.from_iterable(drawn))
    ids = [np.ascontiguousarray(s["ids"], "<i4") for s in flat]
    left_out = np.array([n >= keep_ids for samples in drawn for n in range(len(samples))], bool)
    kept = [i[:0] if out else i for i, out in zip(ids, left_out.tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(_offsets(kept)), pa.array(np.concatenate([np.empty(0, np.int32), *kept])), mask=pa.array(left_out))
    scores = [pa.array([s[c] for s in flat], pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion")]
    digests = pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string())
    columns = [pa.array([len(i) for i in ids], pa.int32()), *scores, digests, lists]
    return pa.ListArray.from_arrays(pa.array(_offsets(drawn)), pa.StructArray.from_arrays(columns, [f.name for f in FIELDS]))


def _offsets(parts: list) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)


def sample_segmentations(docs: DataFrame, model: str = MODEL, k: int = SAMPLES, seed: int = 0, keep_ids: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, samples, decoded.

    ``samples`` are up to ``k`` distinct segmentations of the whole text in the
    order of the draws: n_pieces, log_prob, perturbed, log_inclusion, ids_sha256 (of
    the ids as little-endian 32-bit numbers) and ids (null after the first ``keep_ids``).
    ``decoded`` says that every one of them decodes to the text.

    Draws depend on ``seed`` and doc_id alone, so a task that is tried again and rows
    that repeat give the same ones.  A null text is empty and has one
    segmentation without pieces; a null doc_id seeds like any other value.
    Further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("samples", T.ArrayType(T.StructType(FIELDS))), T.StructField("decoded", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in chunked(batches, "text", CHUNK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            drawn = segment(texts, keys, vocabulary, k, seed)
            decoded = []
            for text, samples in zip(texts, drawn, strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                decoded.append(all(vocabulary.spell(s["ids"], text, codes) for s in samples))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _as_lists(drawn, keep_ids), pa.array(decoded)], schema.names)

    return docs.select("doc_id", F.xxhash64("doc_id").alias("seed"), "text").mapInArrow(run, schema)


def decode_segmentations(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``text``, decoded from a column of piece ids; a null gives a null."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    decode = F.udf(lambda x: None if x is None else shared.value.decode(x), T.StringType())
    return rows.withColumn("text", decode(ids))
