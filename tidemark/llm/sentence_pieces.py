"""SentencePiece encoding and decoding by sampled segmentations.

A text is a lattice: its nodes are the places between letters, its arcs the vocabulary's pieces. Gumbel top-k sampling
without replacement draws distinct segmentations: sets of paths that share an end hold the largest of their Gumbel
perturbed log-probabilities, the best set is opened first (A*, whose bound is exact as the lattice's sums are), and
its branches get perturbed values that are conditioned on their maximum. Pieces never run over the begin of a word,
so the lattice of each distinct word is built once, for many words at a time, and its normalised sums are shared.
"""

from __future__ import annotations

import collections
import itertools
import math
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"  # stands for a space in pieces
#: Words as far as pieces can reach: spaces in front stay with a word, a line end stands alone.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
#: Letters of text that are encoded at once, but for longer texts.
BLOCK = 2 << 20
#: Letters of distinct words whose lattices are built at once.
PART = 1 << 17
#: Letters up to which a word's sums are taken on the plain scale; longer words are summed as logarithms.
SHORT = 200
U = np.uint64


def scrambled(x: np.ndarray, part) -> np.ndarray:
    """x and part mixed to one 64-bit key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.asarray(part).astype(np.int64).view(np.uint64)) + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from integer keys, the same wherever and whenever they are asked for."""
    x = np.asarray(key, dtype=np.int64).view(np.uint64)
    for p in parts:
        x = scrambled(x, p)
    return ((x >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def one_uniform(*parts: int) -> float:
    """As uniform(), for one number."""
    x, m = 0, (1 << 64) - 1
    for p in parts:
        x = ((x ^ (p & m)) + 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        x ^= x >> 31
    return ((x >> 11) + 0.5) / (1 << 53)


def read_model(path: str) -> dict:
    """Pieces of a .model file with log-weights; the model's own scores are ranks, so weights follow Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
    byte = [model.is_byte(i) for i in range(n)]
    ranks = np.array([-model.get_score(i) if -1e8 < model.get_score(i) else i for i in range(n)], dtype=np.float64)
    return {"pieces": pieces, "special": special, "byte": byte, "weights": -np.log(np.maximum(ranks, 0) + 2.7)}


class Vocabulary:
    """A trie of the pieces in a hashed table of transitions, walked for many places at once."""

    def __init__(self, model: dict, sharpness: float):
        self.pieces = model["pieces"]
        usable = [i for i, p in enumerate(self.pieces) if not model["special"][i] and not model["byte"][i]]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model["byte"][i]}
        printed = ["" if model["special"][i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.high = np.zeros(len(self.pieces), dtype=bool)  # bytes that are only part of a letter
        self.byte_of = {}
        for b, i in self.bytes.items():
            printed[i] = chr(b)
            self.high[i] = b >= 128
            self.byte_of[i] = bytes([b])
        self.printed = np.array([*printed, None], dtype=object)[:-1]  # looked up for many ids at once
        self.weight = model["weights"] * sharpness
        # A byte's weight is below that of all pieces: bytes only stand for letters without a piece.
        self.byte_weight = float(self.weight.min() - 3.0)
        states, ids, moves = 1, [-1], {}
        for i in usable:
            at = 0
            for letter in self.pieces[i]:
                key = at << 21 | ord(letter)
                if key not in moves:
                    moves[key] = states
                    states += 1
                    ids.append(-1)
                at = moves[key]
            ids[at] = i
        self.ids = np.array(ids)
        self.begin = np.full(0x110000, -1, dtype=np.int32)  # the state after a first letter
        for key, state in moves.items():
            if key >> 21 == 0:
                self.begin[key] = state
        size = 1 << (len(moves).bit_length() + 1)
        self.mask = size - 1
        self.keys, self.to = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for key, state in moves.items():
            h = self.slot(np.array([key]))[0]
            while self.keys[h] != -1:
                h = h + 1 & self.mask
            self.keys[h], self.to[h] = key, state

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) & self.mask

    def move(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after letters, or -1."""
        keys = states << 21 | letters
        at = self.slot(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.to[at], -1)
        todo = np.flatnonzero(~hit & (got != -1))
        at[todo] = at[todo] + 1 & self.mask
        while len(todo):
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
            at[todo] = at[todo] + 1 & self.mask
        return out


class Lattice:
    """Lattices of many distinct words: nodes in one row, arcs sorted by the node where they end.

    Built a part of the words at a time, which keeps working memory small, and put together in narrow numbers."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        parts, runs, begin = [], np.cumsum(lengths), 0
        while begin < len(words):
            end = int(np.searchsorted(runs, (runs[begin - 1] if begin else 0) + PART)) + 1
            parts.append(LatticePart(words[begin:end], lengths[begin:end], vocabulary))
            begin = end
        nodes = np.cumsum([0, *(len(p.rest) for p in parts)])
        arcs = np.cumsum([0, *(len(p.id) for p in parts)])
        total = np.cumsum([0.0, *(p.below[-1] for p in parts)])

        def joined(name: str, shift=None, kind=np.int32, runs: bool = False):
            """One array of the parts' own, which they let go; runs: running sums, whose last is the next part's first."""
            own = [p.__dict__.pop(name) for p in parts]
            out, at = np.empty(sum(map(len, own)) - runs * (len(own) - 1), dtype=kind), 0
            for j, x in enumerate(own):
                np.add(x, 0 if shift is None else shift[j], out=out[at : at + len(x)], casting="same_kind")
                at += len(x) - runs
            return out

        self.first, self.last, self.start, self.end = (joined(x, nodes) for x in ("first", "last", "start", "end"))
        self.id, self.likeliest = joined("id"), joined("likeliest", arcs)
        self.arcs, self.below = joined("arcs", arcs, runs=True), joined("below", total, np.float64, runs=True)
        self.log_q, self.rest, self.chance = (joined(x, kind=np.float64) for x in ("log_q", "rest", "chance"))

    def walk(self, nodes: np.ndarray, begins: np.ndarray, seed: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from nodes back to begins: (arcs of all paths, each in reading order; arcs per path).

        seed names a path, so that its random numbers don't depend on what else is walked."""
        active = np.flatnonzero(nodes > begins)
        at = nodes.astype(np.int64)
        counts = np.zeros(len(nodes), dtype=np.int64)
        steps = []
        while len(active):
            here = at[active]
            u = uniform(seed[active], counts[active] * 64 + round_)
            arc = self.likeliest[here].astype(np.int64)
            if len(far := np.flatnonzero(u >= self.chance[here])):
                at_far = here[far]
                share = (u[far] - self.chance[at_far]) / (1 - self.chance[at_far])
                other = np.searchsorted(self.below, self.below[self.arcs[at_far]] + share * self.rest[at_far], side="right") - 1
                arc[far] = np.clip(other, self.arcs[at_far], self.arcs[at_far + 1] - 1)
            steps.append((active, arc))
            counts[active] += 1
            at[active] = self.start[arc]
            active = active[at[active] > begins[active]]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for step, (who, arc) in enumerate(steps):
            out[ends[who] - 1 - step] = arc
        return out, counts


class LatticePart:
    """Lattices of some words; see Lattice."""

    def __init__(self, words: list[str], lengths: np.ndarray, vocabulary: Vocabulary):
        v = vocabulary
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        begin = np.cumsum(lengths) - lengths  # of a word's letters
        self.first = begin + np.arange(len(words))  # of a word's nodes, one more than its letters
        self.last = self.first + lengths
        node = np.arange(len(letters)) + word  # in front of each letter
        end = self.last[word]
        starts, ends, ids = [], [], []
        room = end - node  # letters up to the word's end
        at, state, step = np.arange(len(letters)), v.begin[letters].astype(np.int64), 1
        single = v.ids[state] >= 0
        single[state < 0] = False
        while len(at):
            fine = np.flatnonzero(state >= 0)
            at, state = at[fine], state[fine]
            piece = v.ids[state]
            got = np.flatnonzero(piece >= 0)
            start = node[at[got]]
            starts.append(start)
            ends.append(start + step)
            ids.append(piece[got])
            on = np.flatnonzero(room[at] > step)
            at, state = at[on], state[on]
            state = v.move(state, letters[at + step])
            step += 1
        bare = np.flatnonzero(~single)  # letters without a piece: one arc of their bytes, told by -1 - letter if there are more
        wide = 1 + (letters[bare] > 0x7F) + (letters[bare] > 0x7FF) + (letters[bare] > 0xFFFF)
        s = np.concatenate([*starts, node[bare]])
        e = np.concatenate([*ends, node[bare] + 1])
        lone = np.array([v.bytes[b] for b in range(128)])
        i = np.concatenate([*ids, np.where(letters[bare] < 128, lone[np.minimum(letters[bare], 127)], -1 - letters[bare])]).astype(np.int64)
        # Arcs by their end: within a step all ends differ, so each step's arcs take the next free places.
        nodes = len(letters) + len(words)
        self.arcs = np.concatenate([[0], np.cumsum(np.bincount(e, minlength=nodes))])
        free, by, at = self.arcs[:-1].copy(), np.empty(len(e), dtype=np.int64), 0
        for now in [*ends, node[bare] + 1]:
            by[at : at + len(now)] = free[now]
            free[now] += 1
            at += len(now)
        place = np.empty(len(e), dtype=np.int64)
        place[by] = np.arange(len(e))
        self.start, self.end, self.id = s[place], e[place], i[place]
        w = v.weight[np.maximum(self.id, 0)]
        w[by[len(by) - len(bare) :]] = v.byte_weight * wide
        self.log_q, q = self.normalised(w, lengths, nodes)
        # Drawing an arc: the likeliest one of a node is tried first, others by their running sums.
        inner = np.flatnonzero(self.arcs[1:] > self.arcs[:-1])
        top = np.full(nodes, -1.0)
        top[inner] = np.maximum.reduceat(q, self.arcs[inner]) if len(q) else 0.0
        is_top = np.flatnonzero(q == top[self.end])
        self.likeliest = np.zeros(nodes, dtype=np.int64)
        self.likeliest[self.end[is_top]] = is_top
        rest = q.copy()
        rest[self.likeliest[inner]] = 0.0
        self.below = np.concatenate([[0.0], np.cumsum(rest)])
        self.rest = self.below[self.arcs[1:]] - self.below[self.arcs[:-1]]
        self.chance = top / np.maximum(top + self.rest, 1e-300)
        for name in ("first", "last", "start", "end", "id", "likeliest", "arcs"):  # narrow, as all parts wait to be put together
            setattr(self, name, getattr(self, name).astype(np.int32))

    def normalised(self, w: np.ndarray, lengths: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """An arc's share in the sum over all paths from the word's begin to the node where it ends: its log, and itself."""
        of = np.repeat(np.arange(len(lengths)), lengths + 1)
        where = (np.arange(nodes) - self.first[of])[self.end]
        level = 3.0  # a factor per letter that keeps sums near 1; it cancels
        x = np.exp(w + level * (self.end - self.start))
        sums = np.zeros(nodes)
        sums[self.first] = 1.0
        arcs = np.argsort(np.minimum(where, SHORT + 1).astype(np.int16), kind="stable")
        cuts = np.searchsorted(where[arcs], np.arange(1, min(SHORT, int(lengths.max())) + 2)) if len(arcs) else []
        for a, b in itertools.pairwise(cuts):  # arcs that end at the same place of their words, place by place
            now = arcs[a:b]
            np.add.at(sums, self.end[now], sums[self.start[now]] * x[now])
        with np.errstate(divide="ignore", invalid="ignore"):
            q = sums[self.start] * x / sums[self.end]
            out = np.log(q)
        logs = np.zeros(nodes)
        for k in np.flatnonzero(lengths > SHORT):
            logs[self.first[k]] = 0.0
            for node in range(self.first[k] + 1, self.last[k] + 1):
                a, b = self.arcs[node], self.arcs[node + 1]
                each = logs[self.start[a:b]] + w[a:b]
                top = each.max()
                logs[node] = top + np.log(np.exp(each - top).sum())
                out[a:b] = each - logs[node]
                q[a:b] = np.exp(out[a:b])
        return out, q


class Branches:
    """All sets that branch off one path, as a pool: each decision after the first `fixed` ones (counted from the
    text's end) leaves the arcs that weren't chosen, whose share is what came before times the rest of the sum.

    The pool has the largest perturbed value of its sets, given that all are below the path's; which set it is
    comes by their shares. take() splits that set off and draws the next largest value below it."""

    def __init__(self, lattice: Lattice, path: np.ndarray, words: np.ndarray, logs: np.ndarray, phi: float, fixed: int, top: float, *key: int):
        self.lattice, self.path, self.words, self.fixed, self.key, self.draws = lattice, path, words, fixed, key, 0
        chosen = logs[: len(logs) - fixed][::-1]
        self.before = phi + np.cumsum(chosen) - chosen
        self.shares = np.exp(self.before) * -np.expm1(chosen)
        self.gone: dict[int, list[int]] = {}
        self.draw(top)

    def random(self, what: int) -> float:
        return one_uniform(*self.key, self.draws * 4 + what)

    def draw(self, top: float) -> None:
        total = float(self.shares.sum())
        self.value = -np.inf
        if total > 1e-290:
            a, b = -top, math.log(-math.log(self.random(0))) - math.log(total)
            self.value = -max(a, b) - math.log1p(math.exp(-abs(a - b)))

    def take(self) -> tuple[float, float, int, int]:
        """(value, log of share, decision, arc) of the best set, which leaves the pool; the arc is -1 if none was left there."""
        runs = np.cumsum(self.shares)
        j = min(int(np.searchsorted(runs, self.random(1) * runs[-1], side="right")), len(runs) - 1)
        at, x = self.fixed + j, self.lattice
        node = x.end[self.path[len(self.path) - 1 - at]]
        a, b = x.arcs[node], x.arcs[node + 1]
        q = np.exp(x.log_q[a:b])
        q[[self.path[len(self.path) - 1 - at] - a, *self.gone.get(j, ())]] = 0.0
        value, arc, share = self.value, -1, -np.inf
        if q.sum() > 0:
            runs = np.cumsum(q)
            arc = min(int(np.searchsorted(runs, self.random(2) * runs[-1], side="right")), len(q) - 1)
            self.gone.setdefault(j, []).append(arc)
            q[arc] = 0.0
            arc += a
            share = float(self.before[j] + x.log_q[arc])
        self.shares[j] = np.exp(self.before[j]) * q.sum()
        self.draws += 1
        self.draw(value)
        return value, share, at, int(arc)


def inclusion(above: float) -> float:
    """log of the probability that a Gumbel variable around `above` exceeds 0."""
    if above == np.inf:
        return 0.0
    return above if above < -30 else float(np.log(-np.expm1(-np.exp(min(above, 30.0)))))


def sample(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int):
    """For each text: list of up to k (ids, log-probability, inclusion log-probability), by falling perturbed value."""
    index = collections.defaultdict(itertools.count().__next__)  # numbers words as they come
    flat: list[int] = []
    sizes = []
    for text in texts:
        words = CHUNK.findall((SPACE + text).replace(" ", SPACE)) if text else []
        flat.extend(map(index.__getitem__, words))
        sizes.append(len(words))
    if not index:
        return [[] for _ in texts]
    lattice = Lattice(list(index), vocabulary)
    word = np.array(flat, dtype=np.int64)
    sizes = np.array(sizes, dtype=np.int64)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    seeds_of = scrambled(keys[text_of].view(np.uint64), np.arange(len(word)) - (ends - sizes)[text_of]).view(np.int64)
    steps_to = np.arange(int(sizes.max()) + 1)
    out = [[] for _ in texts]
    pools: list[list[Branches]] = [[] for _ in texts]
    # Every text begins as one set: all paths.
    opened = {i: (-math.log(-math.log(one_uniform(int(keys[i]), 1))), 0.0, None, 0, -1) for i in np.flatnonzero(sizes)}
    for round_ in range(k):
        # Walk the open parts of all texts' best sets at once: whole words, and what is left of the word with the branch.
        if not round_:  # all of all texts
            nodes, begins, seeds = [lattice.last[word]], [lattice.first[word]], [seeds_of]
            who = [(i, int(sizes[i])) for i in opened]
        else:
            nodes, begins, seeds, who = [], [], [], []
        for i, (_, _, pool, cut, arc) in opened.items() if round_ else ():
            a = ends[i] - sizes[i]
            b = a + pool.words[len(pool.path) - 1 - cut]
            nodes += [lattice.last[word[a:b]], lattice.start[[arc]]]
            begins += [lattice.first[word[a:b]], lattice.first[word[[b]]]]
            seeds.append(seeds_of[a : b + 1])
            who.append((i, int(b - a + 1)))
        if not who:
            break
        arcs, counts = lattice.walk(*map(np.concatenate, (nodes, begins, seeds)), round_)
        all_logs = lattice.log_q[arcs]
        per_word = np.cumsum(counts)
        begin = word_at = 0
        for i, n in who:
            top, phi, pool, cut, arc = opened[i]
            end = int(per_word[word_at + n - 1])
            path, words, logs, fixed = arcs[begin:end], np.repeat(steps_to[:n], counts[word_at : word_at + n]), all_logs[begin:end], 0
            begin, word_at = end, word_at + n
            if pool is not None:
                keep = len(pool.path) - cut  # what the set shares with the path it branched off
                path = np.concatenate([path, [arc], pool.path[keep:]])
                words = np.concatenate([words, [n - 1], pool.words[keep:]])
                logs, fixed = lattice.log_q[path], cut + 1
            out[i].append((path, float(logs.sum())))
            pools[i].append(Branches(lattice, path, words, logs, phi, fixed, top, int(keys[i]), 1000 + round_))
        opened = {}
        for i, _ in who if round_ < k - 1 else ():
            while (pool := max(pools[i], key=lambda x: x.value)).value > -np.inf:
                value, share, at, arc = pool.take()
                if arc >= 0:
                    opened[i] = (value, share, pool, at, arc)
                    break
    done = []
    for own, found in zip(pools, out, strict=True):
        kappa = max((x.value for x in own), default=-np.inf)
        done.append([(piece_ids(lattice.id[path], vocabulary), phi, inclusion(phi - kappa)) for path, phi in found])
    return done


def piece_ids(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Arcs' pieces, with letters without a piece as the pieces of their bytes."""
    if not (ids < 0).any():
        return ids
    out: list[int] = []
    for i in ids.tolist():
        out += [i] if i >= 0 else [vocabulary.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
    return np.array(out, dtype=np.int64)


def decoded(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of piece ids: bytes joined to letters, the mark of a space as a space, the one in front dropped."""
    if not vocabulary.high[ids].any():
        text = "".join(vocabulary.printed[ids].tolist())
    else:
        text = b"".join([vocabulary.byte_of.get(i) or vocabulary.printed[i].encode() for i in ids.tolist()]).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode(docs: DataFrame, model: dict, k: int = 1, sharpness: float = 1.0, key: str = "doc_id", check: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, sample (from 1), ids, log_prob, inclusion and round_trip for each sampled segmentation of each row.

    Up to k distinct segmentations a row, fewer where no more exist, by falling perturbed log-probability.
    inclusion: log of the probability that such a sample holds this segmentation, given the best one left out.
    Samples depend on the key column's value and nothing else about the row but its text; a null key counts as 0. A
    null or empty text has one segmentation, without pieces. round_trip: whether decoding gives the text back, for
    the first `check` samples (null for others); U+2581 in a text comes back as a space. Repeated rows give equal rows.
    block: bytes of text that a worker encodes at once; fewer take less memory and more time, and change no row."""
    mark = common.digest(model)

    def work(batches):
        v = common.worker_cache(f"pieces{sharpness}-{mark}", lambda: Vocabulary(model, sharpness))
        names = ["doc_id", "sample", "ids", "log_prob", "inclusion", "round_trip"]
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy())
            begin = 0
            while begin < len(keys):  # rows of about `block` bytes of text at a time
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + block, side="right")))
                texts = [t or "" for t in batch.column("text").slice(begin, end - begin).to_pylist()]
                found = sample(texts, keys[begin:end], v, k)
                rows, ranks, ids, logs, included, fine = [], [], [], [], [], []
                for i, samples in enumerate(found):
                    for rank, (pieces, phi, inclusion) in enumerate(samples or [(np.zeros(0, dtype=np.int64), 0.0, 0.0)], 1):
                        rows.append(i)
                        ranks.append(rank)
                        ids.append(pieces)
                        logs.append(phi)
                        included.append(inclusion)
                        fine.append(decoded(pieces, v) == texts[i] if rank <= check else None)
                counts = np.array([len(x) for x in ids])
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin).take(pa.array(rows)), pa.array(ranks, pa.int32()), lists, pa.array(logs, pa.float64()), pa.array(included, pa.float64()), pa.array(fine, pa.bool_())], names=names
                )
                begin = end
        common.give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64(key), F.lit(0)).alias("_key"))
    return rows.mapInArrow(work, "doc_id long, sample int, ids array<int>, log_prob double, inclusion double, round_trip boolean")


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """encoded with `text`, the text of its ids; null ids give null."""
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    mark = common.digest(model)

    def work(batches):
        v = common.worker_cache(f"pieces1.0-{mark}", lambda: Vocabulary(model, 1.0))
        for batch in batches:
            text = [None if x is None else decoded(np.array(x, dtype=np.int64), v) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select(*names).mapInArrow(work, f"{schema}, text string")
