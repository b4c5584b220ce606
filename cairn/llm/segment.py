"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed A-star search over the lattice.

The lattice of a text has a node between any two characters and an edge for each piece of the vocabulary (a character
that no piece covers has one edge, its UTF-8 bytes' pieces). An edge weighs (rank + 2) ** -sharpness, a segmentation
the product of its edges. As no piece has a blank after another character, the lattice is a chain of independent
units (blanks and what follows them), so the lattices of a batch's distinct units are built together, as arrays.

The search keeps, for sets of segmentations that share a prefix, the largest Gumbel-perturbed log-probability in the
set. That value is the exact bound for everything below, so sets are opened in its order and the k segmentations
reached first are a sample without replacement (Kool et al. 2019). Opening a set walks down by the edges'
probabilities; what the walk leaves aside at each node becomes a new set whose value is a Gumbel truncated at the
opened set's value. Random numbers are hashes of the row's key and the place, so a row always gives the same samples.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import chunks, column, mix64, slices, texts_of

_UNIT = re.compile(r" +[^ ]*")
#: Characters of a unit up to which its weights are multiplied as they are; longer units' are added as logarithms.
SHORT = 48
#: Characters that have a column of their own in the table of the trie's steps; rarer ones are looked up in a sorted list.
COMMON = 160


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """In the open interval (0, 1)."""
    return ((mix64(x, seed) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


class Vocabulary:
    """The model's pieces, their weights and the trie over them, as tables."""

    def __init__(self, model_file: str, sharpness: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.size = model.vocab_size()
        self.pieces: dict[str, tuple[int, float]] = {}  # text -> id, logarithm of the weight
        self.bytes: dict[int, tuple[int, float]] = {}
        raw = [b""] * self.size
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw[i] = bytes([int(piece[3:5], 16)])
                self.bytes[raw[i][0]] = (i, -sharpness * math.log(self.size + 2))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                raw[i] = text.encode()
                self.pieces[text] = (i, -sharpness * math.log(2 + min(-model.get_score(i), self.size)))
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        # A weight times scale ** characters is neither very large nor very small in the product over a short unit.
        self.log_scale = sharpness * math.log(16)
        self.weight = np.zeros(self.size)
        for text, (i, w) in self.pieces.items():
            self.weight[i] = w + self.log_scale * len(text)

        steps: dict[tuple[int, str], int] = {}
        piece_of, used = [-1, -1], Counter()  # node 0 is none, node 1 the root
        for text, (i, _) in self.pieces.items():
            node = 1
            for c in text:
                after = steps.get((node, c))
                if after is None:
                    after = steps[node, c] = len(piece_of)
                    piece_of.append(-1)
                    used[c] += 1
                node = after
            piece_of[node] = i
        self.piece_of, self.longest = np.array(piece_of, np.int32), max(map(len, self.pieces), default=1)
        common = {c: k for k, (c, _) in enumerate(used.most_common(COMMON), 1)}
        self.rare = len(common) + 1
        self.kind = np.full(0x110000, self.rare, np.uint8)  # 0 is the end of a unit
        for c, k in common.items():
            self.kind[ord(c)] = k
        self.next = np.zeros((len(piece_of), self.rare + 1), np.int32)
        rare = []
        for (node, c), after in steps.items():
            if c in common:
                self.next[node, common[c]] = after
            else:
                rare.append((node << 21 | ord(c), after))
        rare = np.array(sorted(rare), np.int64).reshape(-1, 2)
        self.rare_key, self.rare_next = np.append(rare[:, 0], 2**62), np.append(rare[:, 1], 0)

    def found(self, chars: np.ndarray, kind: np.ndarray, at: np.ndarray):
        """For lengths 1, 2, ...: (places of at, pieces) where a piece of this length starts."""
        node, length = np.ones(len(at), np.int32), 0
        while len(at) and length < self.longest:
            here = kind[at + length]
            after = self.next[node, here]
            odd = np.flatnonzero(here == self.rare)
            if len(odd):
                key = node[odd].astype(np.int64) << 21 | chars[at[odd] + length].astype(np.int64)
                k = np.searchsorted(self.rare_key, key)
                after[odd] = np.where(self.rare_key[k] == key, self.rare_next[k], 0)
            alive = np.flatnonzero(after)
            at, node = at[alive], after[alive]
            length += 1
            piece = self.piece_of[node]
            hit = np.flatnonzero(piece >= 0)
            yield at[hit], piece[hit]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts whose segmentations the ids are, `sizes` ids each."""
        n = self.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.raw[np.repeat(self.raw_at[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        edges = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [flat[lo:hi].decode()[1:] for lo, hi in zip(edges[:-1], edges[1:])]


class Lattice:
    """The lattices of some units.

    Nodes are numbered by how many characters of their unit come after them: first all units' ends, then all places before
    the last character, and so on, longer units first. So nodes that can be reckoned together lie together, and an edge
    leads to a node of smaller number. Node v's edges are first[v] to first[v + 1], longer pieces first, with the
    conditional probabilities p.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        self.vocabulary = vocabulary
        size = np.fromiter(map(len, units), np.int64, len(units))
        rank = np.empty(len(units), np.int64)
        order = np.argsort(-size, kind="stable")
        rank[order] = np.arange(len(units))
        longest = int(size.max(initial=0))
        self.units = len(units)
        # start[r]: the first node before the last r characters; reach[r]: how many units have as many.
        reach = np.searchsorted(-size[order], -np.arange(longest + 1), "right")
        reach[:1] = len(units)
        start = np.concatenate([[0], np.cumsum(reach)])
        self.root = start[size] + rank

        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = vocabulary.kind[chars]
        end = np.cumsum(size + 1) - 1
        kind[end] = 0
        after = np.repeat(end, size + 1) - np.arange(len(chars))  # characters from a place to its unit's end
        who = np.repeat(rank, size + 1)
        at = np.flatnonzero(after)
        count, edges, single = np.zeros(start[-1] + 1, np.int64), [], np.zeros(len(chars), bool)
        for length, (where, piece) in enumerate(vocabulary.found(chars, kind, at), 1):
            if length == 1:
                single[where] = True
            node = start[after[where]] + who[where]
            count[node] += 1
            edges.append((node, start[after[where] - length] + who[where], piece))
        # A character that no piece covers: an own number beyond the vocabulary's.
        alone = at[~single[at]]
        self.odd, piece = np.unique(chars[alone], return_inverse=True)
        self.odd_ids = [[vocabulary.bytes[b][0] for b in chr(c).encode()] for c in self.odd.tolist()]
        node = start[after[alone]] + who[alone]
        count[node] += 1
        edges.insert(0, (node, start[after[alone] - 1] + who[alone], vocabulary.size + piece))
        self.first = np.concatenate([[0], np.cumsum(count[:-1])])
        fill, total = self.first.copy(), int(self.first[-1])
        self.to, self.piece = np.empty(total, np.int64), np.empty(total, np.int32)
        for node, to, piece in reversed(edges):
            slot = fill[node]
            self.to[slot], self.piece[slot] = to, piece
            fill[node] = slot + 1
        odd = [sum(vocabulary.bytes[b][1] for b in chr(c).encode()) + vocabulary.log_scale for c in self.odd.tolist()]
        weight = np.append(vocabulary.weight, odd)[self.piece]
        with np.errstate(all="ignore"):
            if not self._backward(weight, start, reach, int((size > SHORT).sum())):
                self._backward(weight, start, reach, len(units))

    def _backward(self, weight: np.ndarray, start: np.ndarray, reach: np.ndarray, long: int) -> bool:
        """Probabilities of all edges, those of the first `long` units by logarithms. False if a product left the numbers' range."""
        self.p, linear = np.empty(len(weight)), np.exp(weight)
        total = np.zeros(int(start[-1]))
        total[long : self.units] = 1.0
        for r in range(1, len(reach)):
            base, middle, last = int(start[r]), int(start[r] + min(long, reach[r])), int(start[r] + reach[r])
            if base < middle:
                lo, hi = int(self.first[base]), int(self.first[middle])
                x, cuts = weight[lo:hi] + total[self.to[lo:hi]], self.first[base:middle] - lo
                degree = np.diff(self.first[base : middle + 1])
                top = np.maximum.reduceat(x, cuts)
                total[base:middle] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, degree)), cuts))
                self.p[lo:hi] = np.exp(x - np.repeat(total[base:middle], degree))
            if middle < last:
                lo, hi = int(self.first[middle]), int(self.first[last])
                x = linear[lo:hi] * total[self.to[lo:hi]]
                sums = np.add.reduceat(x, self.first[middle:last] - lo)
                if not (sums.min() > 1e-280 and sums.max() < 1e280):
                    return False
                total[middle:last] = sums
                self.p[lo:hi] = x / np.repeat(sums, np.diff(self.first[middle : last + 1]))
        return True

    def walk(self, start: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks from each start node to its unit's end: edges walker by walker, and how many each took."""
        node, alive, taken, count = start.copy(), np.flatnonzero(start >= self.units), [], np.zeros(len(start), np.int64)
        step = 0
        while len(alive):
            v = node[alive]
            u, e, last = _uniform(salt[alive] + np.uint64(step), 51), self.first[v], self.first[v + 1] - 1
            left = np.flatnonzero(e < last)
            while len(left):
                rest = u[left] - self.p[e[left]]
                on = rest > 0
                left, rest = left[on], rest[on]
                u[left] = rest
                e[left] += 1
                left = left[e[left] < last[left]]
            taken.append((alive, e))
            count[alive] += 1
            node[alive] = to = self.to[e]
            alive = alive[to >= self.units]
            step += 1
        out, place = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
        for step, (who, e) in enumerate(taken):
            out[place[who] + step] = e
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.piece[edges]
        odd = np.flatnonzero(ids >= self.vocabulary.size)
        if not len(odd):
            return ids
        parts, at = [], 0
        for i in odd.tolist():
            parts += [ids[at:i], self.odd_ids[ids[i] - self.vocabulary.size]]
            at = i + 1
        return np.concatenate([*parts, ids[at:]]).astype(np.int32)


class _Search:
    """One text's search: sets left aside, as a heap of (-value, sample, step, excluded edges)."""

    def __init__(self, key: int, roots: np.ndarray):
        self.key, self.roots, self.heap, self.done, self.rest = key, roots, [], [], None

    def random(self, what: int) -> float:
        return float(_uniform(np.array([self.key], np.uint64) + np.uint64(what), 52)[0])


def sample(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int = 2) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """For each text its samples (ids, log-probability, perturbed value), largest value first, and the value of the next one.

    There are fewer than k samples if there are fewer segmentations; the next value is then minus infinity.
    """
    split = [_UNIT.findall(" " + t) for t in texts]
    words = pa.array([u for units in split for u in units], pa.large_string()).dictionary_encode()
    lattice = Lattice(vocabulary, words.dictionary.to_pylist())
    roots = np.split(lattice.root[words.indices.to_numpy()], np.cumsum([len(x) for x in split])[:-1]) if texts else []
    searches = [_Search(int(key), own) for own, key in zip(roots, keys)]
    prefix: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0, 0)] * len(texts)
    bound = [-math.log(-math.log(s.random(0))) for s in searches]
    for turn in range(k):
        alive = [i for i, b in enumerate(bound) if b is not None]
        # What each has yet to walk: the unit it is in, from a node, and the units after it.
        starts, salts = [], []
        for i in alive:
            s, (_, _, _, unit) = searches[i], prefix[i]
            nodes = s.roots[unit:] if s.rest is None else np.concatenate([[s.rest], s.roots[unit + 1 :]])
            starts.append(nodes)
            salts.append(mix64(np.array([s.key + turn], np.uint64), 53) + (np.arange(unit, len(s.roots), dtype=np.uint64) << np.uint64(20)))
        sizes = [len(x) for x in starts]
        edges, count = lattice.walk(np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(salts) if salts else np.zeros(0, np.uint64))
        ends = np.cumsum(np.concatenate([[0], count]))
        at = 0
        for i, size in zip(alive, sizes):
            s, (known, units, _, unit) = searches[i], prefix[i]
            new, own = edges[ends[at] : ends[at + size]], np.repeat(np.arange(unit, unit + size), count[at : at + size])
            at += size
            path, where = np.concatenate([known, new]), np.concatenate([units, own])
            logs = np.log(lattice.p[path])
            before = np.cumsum(logs) - logs
            s.done.append((path, where, float(logs.sum()), bound[i]))
            # Sets that the new part of the walk leaves aside.
            left = -np.expm1(logs[len(known):])
            open_ = np.flatnonzero(left > 1e-14)
            if len(open_):
                mean = before[len(known) + open_] + np.log(left[open_])
                value = _truncated(mean, bound[i], _uniform(np.uint64(s.key) + (np.uint64(turn + 1) << np.uint64(40)) + open_.astype(np.uint64), 54))
                top = np.argpartition(-value, min(k, len(value) - 1))[: k + 1]
                for x in top.tolist():
                    step = len(known) + int(open_[x])
                    heapq.heappush(s.heap, (-float(value[x]), turn, step, (int(path[step]),)))
            if not s.heap:
                bound[i] = None
                continue
            value, turn_of, step, excluded = heapq.heappop(s.heap)
            bound[i] = -value
            if turn == k - 1:
                continue
            path, where, _, _ = s.done[turn_of]
            node = _node(lattice, int(path[step]))
            own = [e for e in range(int(lattice.first[node]), int(lattice.first[node + 1])) if e not in excluded]
            p = lattice.p[own]
            e = own[min(len(own) - 1, int(np.searchsorted(np.cumsum(p), s.random(1000 + turn) * p.sum())))]
            mean = float(np.log(lattice.p[path[:step]]).sum())
            others = float(p.sum() - lattice.p[e])
            if others > 1e-14 and len(own) > 1:
                rest = mean + math.log(others)
                heapq.heappush(s.heap, (-float(_truncated(np.array([rest]), -value, np.array([s.random(2000 + turn)]))[0]), turn_of, step, (*excluded, e)))
            prefix[i] = (np.append(path[:step], e), where[: step + 1], 0.0, int(where[step]))
            s.rest = int(lattice.to[e])
    return [([(lattice.ids(path), logp, value) for path, _, logp, value in s.done], -math.inf if b is None else b) for s, b in zip(searches, bound)]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def _node(lattice: Lattice, edge: int) -> int:
    return int(np.searchsorted(lattice.first, edge, "right")) - 1


def _truncated(mean: np.ndarray, most: float, u: np.ndarray) -> np.ndarray:
    """A Gumbel of that mean, given that it is at most `most`."""
    return mean - np.logaddexp(mean - most, np.log(-np.log(u)))


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary_of(model_file: str, sharpness: float) -> Vocabulary:
    if (model_file, sharpness) not in _VOCABULARIES:
        _VOCABULARIES[model_file, sharpness] = Vocabulary(model_file, sharpness)
    return _VOCABULARIES[model_file, sharpness]


def segmentations(docs: DataFrame, model_file: str, k: int = 2, sharpness: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank (1 to k), ids, log_probability, perturbed, log_inclusion, decoded, exact: a row for each sampled segmentation.

    log_inclusion is the log-probability that a segmentation is above the (k+1)-th perturbed value, log(1 - exp(-exp(log p
    - that value))); the probability's inverse weighs it. The row's key is its doc_id and text, so repeated rows have equal samples. A
    null or empty text is one blank, whose only segmentation comes back. decoded is read back from ids; exact: it is the text.
    Null ids stay null, other columns don't matter, and an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("key"))
    out = f"doc_id {kind}, rank int, ids array<int>, log_probability double, perturbed double, log_inclusion double, decoded string, exact boolean"

    def run(batches):
        vocabulary = vocabulary_of(model_file, sharpness)
        for b in slices(batches):
            texts, keys = texts_of(b, "text"), column(b, "key").to_numpy().view(np.uint64)
            for i, j in chunks(texts, 3_000_000):
                found = sample(vocabulary, texts[i:j], keys[i:j] >> np.uint64(2), k)
                got = [(at, rank, ids, logp, value, _log_inclusion(logp - after)) for at, (own, after) in enumerate(found, i) for rank, (ids, logp, value) in enumerate(own, 1)]
                at, rank, ids, logp, value, inclusion = zip(*got)
                sizes, flat = np.array([len(x) for x in ids]), np.concatenate(ids).astype(np.int32)
                decoded = vocabulary.decode(flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(b, "doc_id").take(pa.array(at)), pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)), pa.array(logp), pa.array(value), pa.array(inclusion),
                        pa.array(decoded, pa.string()), pa.array([d == texts[a] for d, a in zip(decoded, at)]),
                    ],
                    ["doc_id", "rank", "ids", "log_probability", "perturbed", "log_inclusion", "decoded", "exact"],
                )

    return rows.mapInArrow(run, out)
