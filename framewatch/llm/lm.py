"""Language-model scores of whole documents: a class-factored gated recurrent network in numpy.

p(word | before) = p(class | state) * p(word | class, state), both softmaxes over
the state of a GRU. Classes are each of the commonest words alone, the end, and the
rest by the last bytes of the word; within such a class the IN_CLASS - 1 commonest
words have an output each, and one output stands for the others together. These
share its probability by their counts in the whole training corpus, which Spark
gathers (map-side combined), with half a count for each and for what was never seen.
Training is truncated backpropagation through time over all training texts, in all
tasks at once, whose weights are averaged after each of a few rounds; scoring packs
documents into lanes and carries the state across windows, so a document's
likelihood covers all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import kept, slices, texts
from framewatch.llm.words import Words, mix, words

#: Rounds of training, each with the texts of its share; tasks whose weights are added up in one place.
ROUNDS, SIBLINGS = 4, 32
#: Classes of single words (the end among them) and of words by their last bytes.
SINGLE, BY_ENDING = 32, 48
#: Outputs within a class by endings: its commonest words, and one for all others.
IN_CLASS = 32
HIDDEN = 20
#: Counted words that are broadcast, the commonest; the others are joined.
HEAD = 1 << 19
#: Lanes and steps of a window in scoring, where they change no result, and in training. Spark gives the linear algebra
#: library of each task one thread (OMP_NUM_THREADS is spark.task.cpus).
LANES, WINDOW = 480, 20
TRAIN_LANES, TRAIN_WINDOW, EPOCHS, RATE = 160, 20, 2, 0.015
SLICE = 6 << 20
#: Tokens of a class whose outputs are one product.
PIECE = 384
FLUSH = 1 << 20
#: The hash of the end of a text.
END = int(mix(np.array([0x5EED], np.uint64)).view(np.int64)[0])
_CLASSES = SINGLE + BY_ENDING
_LN10 = float(np.log(10))
_SUMS = pa.schema([("family", pa.int32()), ("task", pa.int32()), ("tokens", pa.int64()), ("steps", pa.int64()), ("sums", pa.binary())])


def endings(w: Words) -> np.ndarray:
    """The class of each word by its last three bytes, 0 to BY_ENDING - 1."""
    size = w.ends - w.starts
    code = np.zeros(len(size), np.uint64)
    for i in range(1, 4):
        byte = w.data[np.maximum(w.ends - i, 0)].astype(np.uint64) + np.uint64(1)
        code = code * np.uint64(257) + np.where(size >= i, byte, np.uint64(0))
    return (mix(code) % np.uint64(BY_ENDING)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of every distinct token of the texts, the end of each text included (null: an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = ends = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            u, one, same = np.unique(h, return_index=True, return_inverse=True)
            return u, e[one], np.bincount(same, n).astype(np.int64)

        def batch_of(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["word", "ending", "n"])

        for batch in slices(batches, "text"):
            w = words(texts(batch.column("text")), lower=True)
            u, one, n = np.unique(w.hashes, return_index=True, return_counts=True)
            held.append((u, endings(w)[one], n))
            size += len(u)
            ends += batch.num_rows
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield batch_of(held[0])
                    held, size = [], 0
        if held:
            yield batch_of(merged())
        if ends:
            yield batch_of((np.array([END]).view(np.uint64), np.array([-1]), np.array([ends])))

    return docs.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _place(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash is among the sorted ``known`` ones if it is there: by its first 16 bits where they name one place, else by search."""
    top = (known >> np.uint64(48)).astype(np.int64)
    first = np.zeros(1 << 16, np.int32)
    first[top] = np.arange(len(known))
    at = first[(hashes >> np.uint64(48)).astype(np.int64)]
    shared = np.zeros(1 << 16, bool)
    shared[top[1:][top[1:] == top[:-1]]] = True
    if shared.any():
        more = np.flatnonzero(shared[top[at]])
        at[more] = np.minimum(np.searchsorted(known, hashes[more]), len(known) - 1)
    return at


@dataclass
class Model:
    head: np.ndarray  # sorted hashes of counted words
    n: np.ndarray  # their counts
    ending: np.ndarray
    complete: bool  # whether head has every counted word
    single: np.ndarray  # hashes of the words that are classes of their own, sorted
    single_class: np.ndarray
    tokens: int  # N
    distinct: int  # V
    listed: np.ndarray  # hashes of the words with an output within their class, sorted
    listed_slot: np.ndarray
    others: np.ndarray  # tokens of each class by ending that neither are single words nor listed
    kinds: np.ndarray  # distinct words of these
    weights: dict[str, np.ndarray]

    def classes(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token, and its output within the class (IN_CLASS - 1 for words that are not listed, and for single ones, where it means nothing)."""
        cls, slot = SINGLE + ending, np.full(len(hashes), IN_CLASS - 1)
        for known, value, out in ((self.single, self.single_class, cls), (self.listed, self.listed_slot, slot)):
            if len(known):
                at = _place(known, hashes)
                np.copyto(out, value[at], where=known[at] == hashes)
        return cls, slot

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def unlisted(self, cls: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of the share that a word has of those that its class doesn't list (0 for the others)."""
        e = np.maximum(cls - SINGLE, 0)
        return np.where((cls < SINGLE) | (slot < IN_CLASS - 1), 0.0, np.log10((n + 0.5) / (self.others[e] + 0.5 * (self.kinds[e] + 1))))


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    put = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
    return {"x": put(_CLASSES + 1, 3 * HIDDEN), "u": put(HIDDEN, 2 * HIDDEN), "un": put(HIDDEN, HIDDEN), "bn": np.zeros(HIDDEN, np.float32), "v": put(HIDDEN, _CLASSES), "c": np.zeros(_CLASSES, np.float32), "s": np.zeros((BY_ENDING, HIDDEN, IN_CLASS), np.float32), "d": np.zeros((BY_ENDING, IN_CLASS), np.float32)}


def lanes(sizes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Lane and first step of each text when they are dealt longest first to the shortest lane; the steps, and lanes by load (descending)."""
    import heapq

    count = max(1, min(count, len(sizes)))
    lane, first = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    heap = [(0, i) for i in range(count)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, which = heap[0]
        lane[i], first[i] = which, load
        heapq.heapreplace(heap, (load + int(sizes[i]), which))
    load = np.zeros(count, np.int64)
    for l, which in heap:
        load[which] = l
    order = np.argsort(-load, kind="stable")
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    return rank[lane], first, int(load.max(initial=0)), load[order]


def pack(cls: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets and inputs (step x lane; the class before, or _CLASSES at a text's start), the place of each token in them, and lanes active at each step."""
    sizes = np.diff(offsets)
    lane, first, steps, load = lanes(sizes, count)
    place = np.arange(len(cls)) - np.repeat(offsets[:-1] - first, sizes)
    flat = place * len(load) + np.repeat(lane, sizes)
    y = np.zeros(steps * len(load), np.int16)
    x = np.full(steps * len(load), _CLASSES, np.int16)
    y[flat] = cls
    before = np.empty(len(cls), np.int64)
    before[1:] = cls[:-1]
    before[offsets[:-1][sizes > 0]] = _CLASSES
    x[flat] = before
    active = np.searchsorted(-load, -np.arange(steps), side="left")
    return y.reshape(steps, len(load)), x.reshape(steps, len(load)), flat, active


class _Scratch:
    """float32 arrays by name that each window takes again, not cleared."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Output weights with the bias as one more unit, which is always one."""
    return np.concatenate([weight, bias[..., None, :]], axis=-2)


class _Cell:
    """The recurrent unit's weights as its steps take them: unit x lane, so that gates are whole rows; those of both gates are negated for the exponential."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.table = w["x"].copy()
        both = np.concatenate([w["u"], w["un"]], axis=1)
        self.to_state = both.copy()
        self.both = np.ascontiguousarray(_with_bias(both, np.concatenate([np.zeros(2 * HIDDEN, np.float32), w["bn"]])).T)
        self.table[:, : 2 * HIDDEN] *= -1
        self.both[: 2 * HIDDEN] *= -1

    def given(self, x: np.ndarray, scratch: _Scratch) -> np.ndarray:
        """What the words before (step x lane) give to each gate: step x gate x lane."""
        taken = self.table.take(x.ravel(), axis=0, out=scratch("taken", x.size, 3 * HIDDEN), mode="clip")
        out = scratch("given", len(x), 3 * HIDDEN, x.shape[1])
        out[...] = taken.reshape(*x.shape, -1).transpose(0, 2, 1)
        return out

    def step(self, g: np.ndarray, before: np.ndarray, state: np.ndarray, n: np.ndarray, off: np.ndarray, out: np.ndarray) -> None:
        """One step from ``before`` (with the unit that is always one) into ``out`` (without). ``state`` then has the gates r and z and the new part by
        the state, ``n`` the new part, ``off`` its distance to the state."""
        np.matmul(self.both, before, out=state)
        rz = state[: 2 * HIDDEN]
        rz += g[: 2 * HIDDEN]
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        np.multiply(rz[:HIDDEN], state[2 * HIDDEN :], out=n)
        n += g[2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(before[:HIDDEN], n, out=off)
        np.multiply(rz[HIDDEN:], off, out=out)
        out += n


def _pieces(tokens: int, lanes_: int) -> Iterator[slice]:
    """A few steps of a window at a time: few calls, on arrays that stay in the cache."""
    size = 4 * lanes_
    return (slice(low, min(low + size, tokens)) for low in range(0, tokens, size))


def _inner(w: dict[str, np.ndarray], states: np.ndarray, cls: np.ndarray, scratch: _Scratch) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Outputs within the class of every token in a class by endings: the places of these tokens by class, where classes begin, their states, the logits.
    ``states``: unit (the one that is always one among them) x token."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    edges = np.searchsorted(cls[order], np.arange(SINGLE, _CLASSES + 1))
    order, edges = order[edges[0] :], (edges - edges[0]).tolist()
    turned = scratch("turned", *states.T.shape)
    turned[...] = states.T
    rows = turned.take(order, axis=0, out=scratch("rows", len(order), HIDDEN + 1), mode="clip")
    both = _with_bias(w["s"], w["d"])
    q = scratch("q", len(order), IN_CLASS)
    for c in range(BY_ENDING):
        for low in range(edges[c], edges[c + 1], PIECE):
            high = min(low + PIECE, edges[c + 1])
            np.matmul(rows[low:high], both[c], out=q[low:high])
    return order, edges, rows, q


def log_probabilities(weights: dict[str, np.ndarray], cls: np.ndarray, slot: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural logarithm of p(class, output within it | all before it in its text) for every token."""
    y, x, flat, active = pack(cls, offsets, LANES)
    slots = np.zeros(y.size, np.int16)
    slots[flat] = slot
    slots = slots.reshape(y.shape)
    out = np.zeros(y.shape, np.float32)
    cell, width, scratch = _Cell(weights), y.shape[1], _Scratch()
    v = np.ascontiguousarray(_with_bias(weights["v"], weights["c"]).T)
    h = np.zeros((HIDDEN + 1, width), np.float32)
    h[HIDDEN] = 1
    begins = x == _CLASSES
    some = begins.any(axis=1)
    for low in range(0, len(y), WINDOW):
        high = min(low + WINDOW, len(y))
        a = int(active[low])
        if a < width:
            h, width = np.ascontiguousarray(h[:, :a]), a
        h = h.copy()  # the states of this window take its place
        after = scratch("after", HIDDEN + 1, high - low, a)
        after[HIDDEN] = 1
        given = cell.given(x[low:high, :a], scratch)
        state, n, off = (scratch(k, size * HIDDEN, a) for k, size in (("state", 3), ("n", 1), ("off", 1)))
        for t in range(high - low):
            if some[low + t]:
                h = h.copy()
                h[:HIDDEN] *= ~begins[low + t, :a]
            h, before = after[:, t], h
            cell.step(given[t], before, state, n, off, h[:HIDDEN])
        states, target = after.reshape(HIDDEN + 1, -1), y[low:high, :a].ravel()
        found, total = np.empty(len(target), np.float32), np.empty(len(target), np.float32)
        for at in _pieces(len(target), a):
            logits = np.matmul(v, states[:, at], out=scratch("p", _CLASSES, at.stop - at.start))
            found[at] = logits.ravel().take(target[at] * np.int64(logits.shape[1]) + np.arange(logits.shape[1]))
            np.exp(logits, out=logits)
            logits.sum(axis=0, out=total[at])
        found -= np.log(total)
        order, _, _, q = _inner(weights, states, target, scratch)
        own = q.ravel().take(slots[low:high, :a].ravel()[order] + np.arange(0, q.size, IN_CLASS))
        np.exp(q, out=q)
        found[order] += own - np.log(q.sum(axis=1))
        out[low:high, :a] = found.reshape(high - low, a)
    return out.ravel()[flat]


def _views(vector: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Parts of a vector by name, in the order of the names."""
    out, at = {}, 0
    for k in sorted(shapes):
        size = int(np.prod(shapes[k]))
        out[k] = vector[at : at + size].reshape(shapes[k])
        at += size
    return out


class Trainer:
    """Weights with the moments of Adam, improved by truncated backpropagation through time: the state is carried from window to window, gradients are not."""

    def __init__(self, weights: dict[str, np.ndarray], m1: dict[str, np.ndarray] | None = None, m2: dict[str, np.ndarray] | None = None, step: int = 0):
        self.shapes = {k: v.shape for k, v in weights.items()}
        size = sum(v.size for v in weights.values())
        self._flat = np.zeros((3, size), np.float32)  # weights and moments; the dictionaries are views of them
        self.w, self.m1, self.m2 = (_views(f, self.shapes) for f in self._flat)
        for part, values in ((self.w, weights), (self.m1, m1), (self.m2, m2)):
            for k, v in (values or {}).items():
                part[k][...] = v
        self.step = step

    def vector(self) -> np.ndarray:
        return self._flat.ravel().astype(np.float64)

    def replaced(self, vector: np.ndarray, step: int) -> Trainer:
        """A trainer of the same shapes with the values of ``vector``."""
        return Trainer(*(_views(v, self.shapes) for v in vector.reshape(3, -1)), step)

    def _outputs(self, states: np.ndarray, target: np.ndarray, slot: np.ndarray, weight: np.ndarray, grad: dict[str, np.ndarray], scratch: _Scratch) -> np.ndarray:
        """Gradients of the weighted negative log probability: of the output weights into ``grad``, and of the states.
        ``states``: unit x step x lane, with the unit that is always one, which what is returned lacks; the rest step x lane."""
        w, v = self.w, np.ascontiguousarray(_with_bias(self.w["v"], self.w["c"]).T)
        target, weight, shape, states = target.ravel(), weight.ravel(), states.shape, states.reshape(HIDDEN + 1, -1)
        turned_v = np.ascontiguousarray(w["v"].T)
        back, of_v = scratch("by_token", len(target), HIDDEN), np.zeros((_CLASSES, HIDDEN + 1), np.float32)
        for at in _pieces(len(target), shape[2]):
            p = np.matmul(v, states[:, at], out=scratch("p", _CLASSES, at.stop - at.start))
            np.exp(p, out=p)
            p *= weight[at] / p.sum(axis=0)
            p.ravel()[target[at] * np.int64(p.shape[1]) + np.arange(p.shape[1])] -= weight[at]
            of_v += p @ states[:, at].T
            np.matmul(p.T, turned_v, out=back[at])
        grad["v"][...], grad["c"][...] = of_v[:, :HIDDEN].T, of_v[:, HIDDEN]
        order, edges, rows, q = _inner(w, states, np.where(weight > 0, target, 0), scratch)
        share = weight[order]
        np.exp(q, out=q)
        q *= (share / q.sum(axis=1))[:, None]
        q.ravel()[slot.ravel()[order] + np.arange(0, q.size, IN_CLASS)] -= share
        inner, turned = scratch("inner", len(q), HIDDEN), np.ascontiguousarray(w["s"].transpose(0, 2, 1))
        of_s = np.empty((HIDDEN + 1, IN_CLASS), np.float32)
        for c in range(BY_ENDING):
            if edges[c] < edges[c + 1]:
                at = slice(edges[c], edges[c + 1])
                np.matmul(rows[at].T, q[at], out=of_s)
                grad["s"][c], grad["d"][c] = of_s[:HIDDEN], of_s[HIDDEN]
                np.matmul(q[at], turned[c], out=inner[at])
        back[order] += inner
        out = scratch("from_out", HIDDEN, len(target))
        out[...] = back.T
        return out.reshape(HIDDEN, *shape[1:])

    def learn(self, cls: np.ndarray, slot: np.ndarray, offsets: np.ndarray, rate: Callable[[float], float], window: int = TRAIN_WINDOW) -> None:
        """One pass over some texts; ``rate`` gives the learning rate by the share of the pass that is done.

        A text longer than an even share of the lanes goes on in another lane, with its
        word before but not its state, so that no long text is learned in a lane alone.
        """
        share = max(4 * window, -(-len(cls) // TRAIN_LANES))
        sizes = np.diff(offsets)
        parts = np.maximum(1, -(-sizes // share))
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(offsets[:-1], parts) + nth * share
        y, x, flat, _ = pack(cls, np.append(begin, offsets[-1]), TRAIN_LANES)
        on = begin[nth > 0]
        x.ravel()[flat[on]] = cls[on - 1]
        real, slots = np.zeros(y.size, np.float32), np.zeros(y.size, np.int16)
        real[flat], slots[flat] = 1, slot
        real, slots = real.reshape(y.shape), slots.reshape(y.shape)
        wide = y.shape[1]
        h = np.zeros((HIDDEN, wide), np.float32)
        befores = np.ones((window, HIDDEN + 1, wide), np.float32)
        gradient = np.empty(self._flat.shape[1], np.float32)
        grad, spare, scratch = _views(gradient, self.shapes), np.empty_like(gradient), _Scratch()
        for low in range(0, len(y), window):
            high = min(low + window, len(y))
            steps, cell = high - low, _Cell(self.w)
            came = x[low:high].ravel()
            given, goes = cell.given(x[low:high], scratch), (x[low:high] != _CLASSES).astype(np.float32)
            after = scratch("after", HIDDEN + 1, steps, wide)
            h = h.copy()  # the states of this window take its place
            after[HIDDEN] = 1
            new, off, gates = scratch("new", steps, HIDDEN, wide), scratch("off", steps, HIDDEN, wide), scratch("gates", steps, 3 * HIDDEN, wide)
            for t in range(steps):
                np.multiply(h, goes[t], out=befores[t, :HIDDEN])
                h = after[:HIDDEN, t]
                cell.step(given[t], befores[t], gates[t], new[t], off[t], h)
            gradient[:] = 0
            weight = real[low:high] / max(1.0, float(real[low:high].sum()))
            from_out = self._outputs(after, y[low:high], slots[low:high], weight, grad, scratch)
            # What the state's gradient is multiplied by for z and n; and what n's is for r and n's part by the state.
            r, z, hn = (gates[:, i * HIDDEN : (i + 1) * HIDDEN] for i in range(3))
            first, second = (scratch(k, steps, 2, HIDDEN, wide) for k in ("first", "second"))
            np.subtract(1, z, out=first[:, 1])
            np.multiply(off, z, out=off)
            np.multiply(off, first[:, 1], out=first[:, 0])
            np.multiply(new, new, out=new)
            np.subtract(1, new, out=new)
            first[:, 1] *= new
            np.subtract(1, r, out=second[:, 0])
            second[:, 0] *= r
            second[:, 0] *= hn
            second[:, 1] = r
            dh = np.zeros_like(h)
            back = scratch("back", 4, HIDDEN, steps, wide)  # r, z, n's part by the state, n
            by_gate = back.reshape(4 * HIDDEN, steps, wide)
            to_state = cell.to_state
            for t in range(steps - 1, -1, -1):
                dh += from_out[:, t]
                b = back[:, :, t]
                np.multiply(dh, first[t], out=b[1::2])
                np.multiply(b[3], second[t], out=b[0::2])
                dh *= z[t]
                dh += to_state @ by_gate[: 3 * HIDDEN, t]
                dh *= goes[t]
            through = np.matmul(befores[:steps, :HIDDEN], by_gate[: 3 * HIDDEN].transpose(1, 2, 0)).sum(axis=0)
            grad["u"][...], grad["un"][...] = through[:, : 2 * HIDDEN], through[:, 2 * HIDDEN :]
            grad["bn"][...] = back[2].sum(axis=(1, 2))
            order = np.argsort(came, kind="stable")
            begins = np.flatnonzero(np.diff(came[order], prepend=-1))
            for part, of in (((0, 2 * HIDDEN), by_gate[: 2 * HIDDEN]), ((2 * HIDDEN, 3 * HIDDEN), by_gate[3 * HIDDEN :])):
                sums = np.add.reduceat(of.reshape(len(of), -1).take(order, axis=1, out=scratch("sorted", len(of), len(order)), mode="clip"), begins, axis=1)
                grad["x"][came[order][begins], part[0] : part[1]] = sums.T
            self._improve(gradient, spare, rate(low / len(y)))

    def _improve(self, gradient: np.ndarray, spare: np.ndarray, rate: float) -> None:
        """A step of Adam on all weights at once; a gradient longer than one is cut to that."""
        w, m1, m2 = self._flat
        np.multiply(gradient, gradient, out=spare)
        cut = min(1.0, 1.0 / (float(np.sqrt(spare.sum())) + 1e-8))
        self.step += 1
        m1 *= 0.9
        gradient *= 0.1 * cut
        m1 += gradient
        m2 *= 0.99
        spare *= 0.01 * cut * cut
        m2 += spare
        np.multiply(m2, 1 / (1 - 0.99**self.step), out=spare)
        np.sqrt(spare, out=spare)
        spare += 1e-8
        np.divide(m1, spare, out=spare)
        spare *= rate / (1 - 0.9**self.step)
        w -= spare


def start(per_class: np.ndarray, per_slot: np.ndarray) -> dict[str, np.ndarray]:
    """Untrained weights that give each class its share of the tokens, and each output within a class its share of these."""
    w = initial()
    w["c"] = np.log((per_class + 1.0) / (per_class.sum() + _CLASSES)).astype(np.float32)
    w["d"] = np.log((per_slot + 0.5) / (per_slot.sum(axis=1, keepdims=True) + 0.5 * IN_CLASS)).astype(np.float32)
    return w


def train(cls: np.ndarray, slot: np.ndarray, offsets: np.ndarray, epochs: int = EPOCHS, window: int = TRAIN_WINDOW, rate: float = RATE) -> dict[str, np.ndarray]:
    """Weights learned from some texts in one place."""
    if not len(cls):
        return initial()
    per_slot = np.bincount(np.maximum(cls - SINGLE, 0) * IN_CLASS + slot, cls >= SINGLE, BY_ENDING * IN_CLASS).reshape(BY_ENDING, IN_CLASS)
    trainer = Trainer(start(np.bincount(cls, minlength=_CLASSES), per_slot))
    for e in range(epochs):
        trainer.learn(cls, slot, offsets, lambda done: rate * (1 - 0.9 * (e + done) / epochs), window)
    return trainer.w


def train_all(docs: DataFrame, model: Model, per_class: np.ndarray, per_slot: np.ndarray) -> dict[str, np.ndarray]:
    """Weights learned from all texts. In each round every task goes on from the same weights with its texts of that
    round; then weights and moments are averaged by tokens, on Spark by SIBLINGS tasks. ROUNDS rounds see each text once.
    """
    trainer = Trainer(start(per_class, per_slot))
    for number in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast((trainer, model))
        rate = RATE * (1 - 0.9 * (number + 0.5) / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, model = sent.value
            own, tokens = Trainer(begun.w, begun.m1, begun.m2, begun.step), 0
            for batch in slices(batches, "text", SLICE):
                h, e, offsets = tokens_of(words(texts(batch.column("text")), lower=True))
                own.learn(*model.classes(h, e), offsets, lambda done: rate)
                tokens += len(h)
            if tokens:
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"family": [task // SIBLINGS], "task": [task], "tokens": [tokens], "steps": [(own.step - begun.step) * tokens], "sums": [(own.vector() * tokens).tobytes()]}, _SUMS)

        def add(part: pa.Table) -> pa.Table:
            part = part.sort_by("task")
            sums = np.sum([np.frombuffer(b, np.float64) for b in part.column("sums").to_pylist()], axis=0)
            tokens, steps = (sum(part.column(c).to_pylist()) for c in ("tokens", "steps"))
            return pa.Table.from_pydict({"family": part.column("family")[:1], "task": part.column("task")[:1], "tokens": [tokens], "steps": [steps], "sums": [sums.tobytes()]}, _SUMS)

        kind = "family int, task int, tokens long, steps long, sums binary"
        share = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == number).select("text")
        got = add_up(share.mapInArrow(run, kind).groupBy("family").applyInArrow(add, kind).collect())
        if got:
            trainer = trainer.replaced(got[0], trainer.step + max(1, got[1]))
        sent.unpersist()
    return trainer.w


def add_up(rows: list) -> tuple[np.ndarray, int] | None:
    """The average by tokens of the sums of some tasks, and of their steps."""
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: r.task)
    tokens = sum(r.tokens for r in rows)
    return np.sum([np.frombuffer(r.sums, np.float64) for r in rows], axis=0) / tokens, sum(r.steps for r in rows) // tokens


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every token, an end after each text, and the texts' offsets."""
    rows = len(w)
    offsets = w.offsets + np.arange(rows + 1)
    is_word = np.ones(offsets[-1], bool)
    is_word[offsets[1:] - 1] = False
    hashes = np.full(offsets[-1], np.array([END]).view(np.uint64)[0])
    hashes[is_word] = w.hashes
    ending = np.zeros(offsets[-1], np.int64)
    ending[is_word] = endings(w)
    return hashes, ending, offsets


def fit(train_docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and all counted words (word, n) for those that the model doesn't carry."""
    table = kept(counts(train_docs), "counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = table.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()
    distinct, total = sum(r.words for r in levels), sum(r.tokens for r in levels)
    cut, held = None, 0
    for r in levels:
        if held + r.words > HEAD:
            break
        cut, held = r.level, held + r.words
    head = (table.filter(level >= cut) if cut is not None else table.limit(0)).toArrow()
    hashes, n, ending = (head.column(c).to_numpy() for c in ("word", "n", "ending"))
    order = np.argsort(hashes.view(np.uint64))
    hashes, n, ending = hashes[order].view(np.uint64), n[order], ending[order]
    end = np.array([END]).view(np.uint64)[0]
    by_n = np.lexsort((hashes, -n))
    by_n = by_n[hashes[by_n] != end][: SINGLE - 1]
    single = np.concatenate([[end], hashes[by_n]]).astype(np.uint64)
    order = np.argsort(single)
    # Within a class by endings, the commonest of the words that are not single.
    rest = np.lexsort((hashes, -n))
    rest = rest[~np.isin(hashes[rest], single)]
    rest = rest[np.argsort(ending[rest], kind="stable")]
    rank = np.arange(len(rest)) - np.searchsorted(ending[rest], ending[rest])
    rest, rank = rest[rank < IN_CLASS - 1], rank[rank < IN_CLASS - 1]
    sums = table.filter("ending >= 0").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    others, kinds = np.zeros(BY_ENDING), np.zeros(BY_ENDING)
    for r in sums:
        others[r.ending], kinds[r.ending] = r.n, r.kinds
    np.subtract.at(others, ending[by_n], n[by_n])
    np.subtract.at(kinds, ending[by_n], 1)
    in_class = others.copy()
    np.subtract.at(others, ending[rest], n[rest])
    np.subtract.at(kinds, ending[rest], 1)
    per_slot = np.zeros((BY_ENDING, IN_CLASS))
    per_slot[ending[rest], rank] = n[rest]
    per_slot[:, -1] = others
    listed = np.argsort(hashes[rest])
    model = Model(hashes, n, ending, held == distinct, single[order], order, total, distinct, hashes[rest][listed], rank[listed], others, kinds, {})
    per_class = np.concatenate([np.zeros(SINGLE), in_class])
    per_class[: len(single)] = np.concatenate([[n[hashes == end].sum()], n[by_n]])
    model.weights = train_all(train_docs, replace(model, head=hashes[:0], n=n[:0], ending=ending[:0]), per_class, per_slot)
    return model, table.select("word", "n")


def score(docs: DataFrame, model: Model, table: DataFrame, keys: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """``keys``, n_tokens, n_known, train_tokens, base_score, score of every whole text (null: empty; it has the end token alone).

    Every row has a result, repeated ids included; no text and no training text at all give the scores of an untrained network.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in slices(batches, "text", SLICE):
            hashes, ending, offsets = tokens_of(words(texts(batch.column("text")), lower=True))
            u, one, same = np.unique(hashes, return_index=True, return_inverse=True)
            u_cls, u_slot = model.classes(u, ending[one])
            u_n = np.zeros(len(u), np.int64)
            if len(model.head):
                at = np.minimum(np.searchsorted(model.head, u), len(model.head) - 1)
                np.copyto(u_n, model.n[at], where=model.head[at] == u)
            u_base, u_unlisted = model.base(u_n), model.unlisted(u_cls, u_slot, u_n)
            cls, slot, n_of = u_cls.astype(np.int16)[same], u_slot.astype(np.int16)[same], u_n[same]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            rest = np.flatnonzero(n_of == 0) if not model.complete else np.zeros(0, np.int64)
            inside = np.ones(len(hashes), bool)
            inside[rest] = False
            add = lambda v: np.bincount(row, np.where(inside, v, 0.0) if len(rest) else v, batch.num_rows)
            network = np.bincount(row, log_probabilities(model.weights, cls, slot, offsets).astype(np.float64), batch.num_rows) / _LN10
            rest = rest[np.lexsort((hashes[rest], row[rest]))]
            first = np.flatnonzero(np.diff(row[rest], prepend=-1).astype(bool) | np.diff(hashes[rest], prepend=np.uint64(0)).astype(bool))
            times, rest = np.diff(np.append(first, len(rest))), rest[first]
            cuts = pa.array(np.searchsorted(row[rest], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(batch.num_rows)), *(batch.column(k) for k in keys), pa.array(np.diff(offsets)), pa.array(add(n_of > 0).astype(np.int64)),
                    pa.array(add(u_base[same])), pa.array(network + add(u_unlisted[same])),
                    pa.ListArray.from_arrays(cuts, pa.array(hashes[rest].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(cls[rest].astype(np.int32))),
                ],
                names=["__row", *keys, "n_tokens", "__known", "__base", "score", "__words", "__times", "__classes"],
            )
            number += batch.num_rows

    scored = rows.mapInArrow(run, f"__row long, {kinds}, n_tokens long, __known long, __base double, score double, __words array<long>, __times array<int>, __classes array<int>")
    total = F.lit(model.tokens).cast("long").alias("train_tokens")
    if model.complete:
        return scored.select(*keys, "n_tokens", F.col("__known").alias("n_known"), total, F.col("__base").alias("base_score"), "score")
    scored = kept(scored, "scored")
    rare = scored.select("__row", F.explode(F.arrays_zip("__words", "__times", "__classes")).alias("t")).select("__row", F.col("t.__words").alias("word"), F.col("t.__times").alias("times"), F.col("t.__classes").alias("cls"))
    inner = F.create_map(*(x for i in range(BY_ENDING) for x in (F.lit(SINGLE + i), F.lit(float(model.others[i] + 0.5 * (model.kinds[i] + 1))))))
    n = F.coalesce("n", F.lit(0)) + 0.5
    joined = rare.join(table, "word", "left")
    sums = joined.groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10(n / F.lit(model.tokens + 0.5 * (model.distinct + 1)))).alias("b"),
        F.sum(F.col("times") * F.log10(n / F.element_at(inner, F.col("cls")))).alias("s"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("__words", "__times", "__classes").join(sums, "__row", "left").select(
        *keys, "n_tokens", (F.col("__known") + zero("k")).cast("long").alias("n_known"), total, (F.col("__base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score")
    )
