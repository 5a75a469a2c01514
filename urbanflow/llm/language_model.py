"""Gated recurrent language model with a class-factored softmax, in numpy inside Spark tasks.

Words are known by 64-bit hashes. The most frequent ones form the model's vocabulary, in classes of equal
size; all other words are one outcome of the softmax, and share its probability by their smoothed counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import Scratch, give_back, keep_memory, parts_for, runs_of, text_bytes, words_of
from urbanflow.llm.packed import DEALT, DEALT_DDL, deal, mix, word_hashes

#: Hash that stands for the end of a document (no word is empty).
END = xxhash.xxh3_64_intdigest(b"")
CLASSES, CLASS_WORDS, HIDDEN = 64, 64, 32
#: Most frequent words whose counts travel with the tasks, at most; others are counted by a shuffle.
HEAD = 131_072
#: Words of a training window (backpropagation ends there) and of a stretch (state is carried through it).
WINDOW, STRETCH = 16, 128
#: Stretches whose windows make one step of training, and stretches that one copy learns from in a round.
LANES, TASK_STRETCHES = 512, 4_096
_LN10 = math.log(10)


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, each text's followed by the end; and where each starts."""
    words, ends = [], [0]
    for t in texts:
        words += words_of(t, lower=True)
        words.append(b"")  # hashes to END
        ends.append(len(words))
    return word_hashes(words), np.array(ends)


# --- the network ---------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(z: np.ndarray, at: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's outcome ``at``; ``z`` becomes the gradient of its loss, if asked.

    Figures are kept where their exponential and its sum are finite, which is cheaper than shifting rows.
    """
    rows = np.arange(len(z))
    np.clip(z, -80, 80, out=z)
    picked = z[rows, at]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if slope:
        z *= (1 / total)[:, None]
        z[rows, at] -= 1
    return picked - np.log(total), z


def _step(gx: np.ndarray, gh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the recurrent unit (units x lanes): new state, reset and update gate, candidate."""
    n = len(h)
    rz = _sigmoid(gx[: 2 * n] + gh[: 2 * n])
    cand = rz[:n] * gh[2 * n :]
    cand += gx[2 * n :]
    np.tanh(cand, out=cand)
    new = h - cand
    new *= rz[n:]
    new += cand
    return new, rz[:n], rz[n:], cand


class Network:
    """Weights by name: E embeddings, W and U gates (r, z, n) with bias b, C and c classes, V and v words.

    Word ``i`` of the vocabulary is word ``i % CLASS_WORDS`` of class ``i // CLASS_WORDS``; outcome
    ``CLASSES`` is any other word.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray, others: float, seed: int = 11) -> "Network":
        """At first the model is the unigram of the counts; gates and embeddings are small and random."""
        rng, size = np.random.default_rng(seed), CLASSES * CLASS_WORDS
        c = np.full(size, 0.1)
        c[: len(counts)] = counts
        by_class = c.reshape(CLASSES, CLASS_WORDS)
        mass = np.append(by_class.sum(1), max(others, 0.5))

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape).astype(np.float32)

        h = HIDDEN
        return cls({
            "E": small(size + 1, h), "W": small(h, 3 * h), "U": small(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "C": np.zeros((h, CLASSES + 1), np.float32), "c": np.log(mass / mass.sum()).astype(np.float32),
            "V": np.zeros((CLASSES, h, CLASS_WORDS), np.float32), "v": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        })

    def pack(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def unpack(self, flat: np.ndarray) -> "Network":
        out, at = {}, 0
        for k in sorted(self.w):
            n = self.w[k].size
            out[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return Network(out)

    def inputs(self) -> np.ndarray:
        """What each word adds to the gates."""
        return self.w["E"] @ self.w["W"] + self.w["b"]

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each outcome ``y`` after state ``h``; with ``grad``, gradients and that of h."""
        w, slope = self.w, grad is not None
        cls = (y // CLASS_WORDS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")  # class by class; the other outcome comes last
        h, y, cls = h[order], y[order], cls[order]
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        known = int(cuts[-1])
        logp, d = _softmax(h @ w["C"] + w["c"], cls, slope)
        dh = None
        if slope:
            grad["C"] += h.T @ d
            grad["c"] += d.sum(0)
            dh = d @ w["C"].T
        s = np.empty((known, CLASS_WORDS), np.result_type(h, w["V"]))
        for k, a, b in spans:
            np.matmul(h[a:b], w["V"][k], out=s[a:b])
            s[a:b] += w["v"][k]
        more, d = _softmax(s, y[:known] % CLASS_WORDS, slope)
        logp[:known] += more
        out = np.empty_like(logp)
        out[order] = logp
        if not slope:
            return out, None
        for k, a, b in spans:
            grad["V"][k] += h[a:b].T @ d[a:b]
            grad["v"][k] += d[a:b].sum(0)
            dh[a:b] += d[a:b] @ w["V"][k].T
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, on: np.ndarray | None = None) -> tuple[np.ndarray, float, dict]:
        """Truncated backpropagation through one window (words x lanes): state after it, loss, gradients.

        Only words that are ``on`` (at the start of their lane) count; what fills up a lane adds nothing.
        States and gates lie by unit and lane inside, so that each gate is one block.
        """
        w, (steps, lanes), n = self.w, x.shape, HIDDEN
        grad = {k: np.zeros_like(v) for k, v in w.items() if k != "E"}
        emb = w["E"][x]
        gx = np.matmul(w["W"].T, emb.transpose(0, 2, 1)) + w["b"][:, None]
        kept, now, into = [], np.ascontiguousarray(h.T), np.ascontiguousarray(w["U"].T)
        states = np.empty((steps, n, lanes), np.result_type(h, into))
        for t in range(steps):
            gh, before = into @ now, now
            now, r, z, cand = _step(gx[t], gh, now)
            states[t] = now
            kept.append((before, r, z, cand, gh[2 * n :]))
        on = np.ones((steps, lanes), bool) if on is None else on
        dout = np.zeros((steps, lanes, n), states.dtype)
        logp, dout[on] = self.outputs(states.transpose(0, 2, 1)[on], y[on], grad)
        dout = np.ascontiguousarray(dout.transpose(0, 2, 1))
        dgx, dgh, dh = np.empty_like(gx), np.empty((3 * n, lanes), gx.dtype), np.zeros((n, lanes), states.dtype)
        for t in range(steps - 1, -1, -1):
            before, r, z, cand, gn = kept[t]
            dh += dout[t]
            dc = dh * (1 - z)
            dc *= 1 - cand * cand
            dgx[t, :n] = dc * gn * r * (1 - r)
            dgx[t, n : 2 * n] = dh * (before - cand) * z * (1 - z)
            dgx[t, 2 * n :] = dc
            dgh[: 2 * n] = dgx[t, : 2 * n]
            np.multiply(dc, r, out=dgh[2 * n :])
            grad["U"] += before @ dgh.T
            dh *= z
            dh += w["U"] @ dgh
        flat_x, flat = np.ascontiguousarray(dgx.transpose(0, 2, 1)).reshape(-1, 3 * n), x.ravel()
        grad["W"] += emb.reshape(-1, n).T @ flat_x
        grad["b"] += flat_x.sum(0)
        back = flat_x @ w["W"].T
        grad["E"] = np.stack([np.bincount(flat, c, len(w["E"])) for c in back.T], 1).astype(w["E"].dtype)
        return now.T, -float(logp.sum()), grad

    def train(self, stretches: np.ndarray, rate: float, lanes: int = LANES) -> "Network":
        """One pass of Adam over stretches (rows of previous word and words; -1 after the end of one).

        Every word of every stretch is learned from, with the same weight: short windows and the last
        lanes are masked, and the gradient is divided by the words of a full window.
        """
        w = {k: v.copy() for k, v in self.w.items()}
        net, m, s, k = Network(w), {}, {}, 0
        other = CLASSES * CLASS_WORDS
        size = WINDOW * min(lanes, len(stretches))
        for a in range(0, len(stretches), lanes):
            part = stretches[a : a + lanes]
            h = np.zeros((len(part), HIDDEN), np.float32)
            for t in range(0, STRETCH, WINDOW):
                more = part[:, t + 1] >= 0
                if not more.any():
                    break
                part, h = part[more], h[more]
                ids = part[:, t : t + WINDOW + 1].T
                on = ids[1:] >= 0
                ids = np.clip(ids[: int(on.sum(0).max()) + 1], 0, other)
                h, _, grad = net.window(ids[:-1], ids[1:], h, on[: len(ids) - 1])
                k += 1
                for name, g in grad.items():
                    g /= size
                    if name not in m:
                        m[name], s[name] = np.zeros_like(g), np.zeros_like(g)
                    m[name] += 0.1 * (g - m[name])
                    g *= g
                    g -= s[name]
                    g *= 0.01
                    s[name] += g
                    w[name] -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.99**k)) + 1e-6)
        return net

    def score(self, docs: list[np.ndarray], lanes: int = 256, steps: int = 32) -> np.ndarray:
        """Log probability (natural) of each document's words, state carried from its start to its end.

        Documents lie end to end in lanes of about equal length; a lane's state is cleared where one starts.
        """
        sizes = [len(d) for d in docs]
        loads = [(0, i) for i in range(min(lanes, len(docs)))]
        rows: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
            load, lane = heapq.heappop(loads)
            rows[lane].append(i)
            heapq.heappush(loads, (load + sizes[i], lane))
        rows.sort(key=lambda own: -sum(sizes[i] for i in own))
        lengths = np.array([sum(sizes[i] for i in own) for own in rows], np.int64)
        longest = int(max(lengths, default=0))
        # words and documents by step and lane; lanes that end leave -1
        y, who = np.zeros((longest, len(rows)), np.int16), np.full((longest, len(rows)), -1, np.int32)
        for lane, own in enumerate(rows):
            if lengths[lane]:
                y[: lengths[lane], lane] = np.concatenate([docs[i] for i in own])
                who[: lengths[lane], lane] = np.repeat(own, [sizes[i] for i in own])
        fresh = np.ones(who.shape, bool)
        fresh[1:] = who[1:] != who[:-1]
        total, gates, into = np.zeros(len(docs)), self.inputs(), np.ascontiguousarray(self.w["U"].T)
        h = np.zeros((HIDDEN, len(rows)), np.float32)
        for a in range(0, longest, steps):
            active = int((lengths > a).sum())
            end = min(longest, a + steps)
            own_y, own_who, new = (m[a:end, :active] for m in (y, who, fresh))
            x = np.full(own_y.shape, self.end_id, np.int64)
            x[1:] = own_y[:-1]
            if a:
                x[0] = y[a - 1, :active]
            x[new] = self.end_id
            h, gx = h[:, :active], np.ascontiguousarray(gates[x].transpose(0, 2, 1))
            states = np.empty((len(x), HIDDEN, active), np.float32)
            cleared = new.any(1)
            for t in range(len(x)):
                if cleared[t]:
                    h = h * ~new[t]
                h = states[t] = _step(gx[t], into @ h, h)[0]
            on = own_who >= 0
            logp, _ = self.outputs(states.transpose(0, 2, 1)[on], own_y[on].astype(np.int64))
            total += np.bincount(own_who[on], logp, len(docs))
        return total

    end_id: int = 0


# --- Spark jobs ----------------------------------------------------------------------------------------


def _count_words(folds: int, fold: int, parts: int, most: int = 3_000_000):
    """Counts of the training words of a task, packed by part: ``of`` holds the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal words, counts, held
            w, at = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
            c = np.bincount(at, np.concatenate([*counts, np.zeros(0, np.int64)]), len(w)).astype(np.int64)
            words, counts, held = [], [], 0
            part = (w % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, order[a:b]) for p, a, b in zip(range(parts), cuts, cuts[1:]) if b > a]
            none = pa.nulls(len(rows), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.int32()), none, pa.array([c[o].tobytes() for _, o in rows], pa.binary()), pa.array([w[o].tobytes() for _, o in rows], pa.binary())],
                schema=DEALT,
            )

        for batch in batches:
            texts = [t for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not held_out(d, folds, fold)]
            for run_ in runs_of(texts):
                w, c = np.unique(token_hashes(texts[run_])[0], return_counts=True)
                words.append(w)
                counts.append(c)
                held += len(w)
            if held > most:
                yield flush()
        yield flush()
        give_back()

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a part: its words in order and their counts; and for each part its most frequent."""
    words, counts, part = [], [], None
    for batch in batches:
        for p, c, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            part = p
            words.append(np.frombuffer(w, np.uint64))
            counts.append(np.frombuffer(c, np.int64))
    if part is None:
        return
    w, at = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "words": [w.tobytes()], "counts": [c.tobytes()], "n": [int(c.sum())], "v": [len(w)]},
        schema=pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]),
    )


def _steps(c: np.ndarray) -> np.ndarray:
    """Step of a count on a scale of about an eighth of a doubling."""
    return np.floor(np.log2(c) * 8).astype(np.int32)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in batch.column(2).to_pylist():
            at, n = np.unique(_steps(np.frombuffer(c, np.int64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["step", "n"])


def _words_from(step: int, share: float):
    """Words above a count step, and that share of the step's own which their hash draws."""
    bound = min((1 << 64) - 1, int(share * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                at = _steps(c)
                top = (at > step) | ((at == step) & (mix(w) < np.uint64(bound)))
                yield pa.RecordBatch.from_arrays([pa.array(w[top].view(np.int64)), pa.array(c[top])], ["word", "c"])

    return run


def _edge(scale: list[tuple[int, int]], most: int) -> tuple[int, float]:
    """The count step (of (step, words), falling) in which ``most`` words are reached, and what share of it fits."""
    total = 0
    for step, n in scale:
        if total + n > most:
            return step, (most - total) / n
        total += n
    return -1, 0.0


class Vocabulary:
    """Counts of the most frequent words (given by falling count); the first are the network's."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int):
        order, size = np.argsort(words), CLASSES * CLASS_WORDS
        self.words, self.counts = words[order], counts[order]
        self.ids = np.minimum(order, size)
        self.size = min(size, len(words))
        #: smoothed mass of all words outside the network's vocabulary, unseen ones as one word
        self.rest = float(n - counts[: self.size].sum() + (v - self.size) + 1)
        self.end_id = int(self.look(np.array([END], np.uint64))[0][0])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network outcome and count of each hash; count -1 where only the shuffle knows it."""
        if not len(self.words):
            return np.full(len(h), CLASSES * CLASS_WORDS), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        there = self.words[at] == h
        return np.where(there, self.ids[at], CLASSES * CLASS_WORDS), np.where(there, self.counts[at], -1)


#: What a coded row is: a document, or hashes of rare words dealt by value.
DOC, RARE = 0, 1
#: A document's row: what is known of it without the counts of its rare words.
_DOC = {
    "rid": "long", "doc_id": "long", "held_out": "boolean", "n_tokens": "long",
    "n_known": "long", "log_counts": "double", "outcome": "double", "shared": "long", "shared_log": "double",
}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
_DOC_DDL = ", ".join(f"{k} {t}" for k, t in _DOC.items())


def _code(vocabulary: Vocabulary, folds: int, fold: int, parts: int):
    """Documents with the network's ids of their words, and hashes of rare words dealt by their value."""
    kinds = [_ARROW[k] for k in _DOC.values()]
    names = ["kind", *DEALT.names, *_DOC, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids_, texts = (c.to_pylist() for c in batch.columns)
            docs, cols, owners, rare = [], [[] for _ in range(5)], [], []
            for run_ in runs_of(texts):
                h, ends = token_hashes(texts[run_])
                starts, size = ends[:-1], np.diff(ends)
                ids, c = vocabulary.look(h)
                far, other = c < 0, ids == CLASSES * CLASS_WORDS
                logs = np.log10(np.maximum(c, 0) + 1.0)
                sums = (np.add.reduceat(x, starts) for x in ((~far).astype(np.int64), logs, other.astype(np.int64), np.where(other, logs, 0.0)))
                for col, x in zip(cols, (size, *sums)):
                    col.append(x)
                data = ids.astype(np.int16).tobytes()
                docs += [data[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends[1:].tolist())]
                owners.append(np.repeat(np.arange(run_.start, run_.stop), size)[far])
                rare.append(h[far])
            m = len(rids)
            none = pa.nulls(m, pa.binary())
            n, near, logs, shared, shared_log = (np.concatenate([*c, np.zeros(0)]) for c in cols)
            held = [held_out(d, folds, fold) for d in ids_]
            own = (rids, ids_, held, n.astype(np.int64), near.astype(np.int64), logs, np.zeros(m), shared.astype(np.int64), shared_log)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, DOC, np.int32)), pa.nulls(m, pa.int32()), none, none, none, *(pa.array(c, k) for c, k in zip(own, kinds)), pa.array(docs, pa.binary())], names
            )
            if m:
                dealt = deal(np.array(rids, np.int64), np.concatenate(owners), np.concatenate(rare), parts)
                k = dealt.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, RARE, np.int32)), *dealt.columns, *(pa.nulls(k, x) for x in kinds), pa.nulls(k, pa.binary())], names
                )
        give_back()

    return run


def _rounds(words: int, least: int) -> int:
    """Rounds of training: rounds and the tasks of each grow alike, with the root of the stretches."""
    return max(least, round(math.sqrt(words / (STRETCH * TASK_STRETCHES))))


def _stretches(end_id: int, rounds: int):
    """All stretches of coded documents (row and ids), with the word before each; row and offset draw the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, turn = [], []
            for rid, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(np.int16(end_id), np.frombuffer(data, np.int16))
                starts = np.arange(0, len(ids) - 1, STRETCH)
                drawn = mix(mix(np.array([rid], np.int64).view(np.uint64)) + starts.astype(np.uint64))
                for a in starts:
                    row = np.full(STRETCH + 1, -1, np.int16)
                    part = ids[a : a + STRETCH + 1]
                    row[: len(part)] = part
                    out.append(row.tobytes())
                turn.extend((drawn % np.uint64(rounds)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(turn, pa.int32())], ["ids", "turn"])

    return run


def _train_round(net: Network, rate: float, slices: int, most: int):
    """Train on the rows of the task and give the weights back in slices, each with the words seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        now, seen, held = net, 0, []

        def learn(last: bool) -> None:
            nonlocal now, seen
            if held and (last or len(held) >= most):
                rows = np.stack(held).astype(np.int64)
                now = now.train(rows, rate)
                seen += int((rows[:, 1:] >= 0).sum())
                held.clear()

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(np.frombuffer(data, np.int16))
                learn(False)
        learn(True)
        if seen:
            parts = np.array_split(now.pack(), slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([seen] * slices, pa.int64())],
                ["slice", "weights", "seen"],
            )
        give_back()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for k, data, n in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(k, [0.0, 0])
            own[0] = own[0] + np.frombuffer(data, np.float32).astype(np.float64) * n
            own[1] += n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([(a / n).astype(np.float32).tobytes() for a, n in sums.values()], pa.binary())], ["slice", "weights"]
    )


def _score_docs(net: Network, parts: int, chunk: int = 2_000_000):
    """Coded documents with the network's log probability of their ids, for the part of their row."""
    names = [*DEALT.names, *_DOC]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            outcome = net.score([np.frombuffer(x, np.int16) for x in own.column(len(_DOC)).to_pylist()])
            held, tokens, m = [], 0, own.num_rows
            cols = [pa.array(outcome) if k == "outcome" else own.column(i) for i, k in enumerate(_DOC)]
            part = (-1 - np.asarray(own.column(0)) % parts).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part), *(pa.nulls(m, pa.binary()) for _ in range(3)), *cols], names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                tokens += int(np.asarray(batch.column(3)).sum())
            if tokens >= chunk:
                yield flush()
        if held:
            yield flush()
        give_back()

    return run


def _meet_counts(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the part's rare words, summed by document and packed by the document's own part; rows of
    documents pass through to theirs."""
    kinds = [_ARROW[k] for k in _DOC.values()]
    names = ["part", *_DOC, "rids", "far_known", "far_log"]
    words, counts, owners, rare = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], []
    for batch in batches:
        docs = np.asarray(batch.column(0)) < 0
        if docs.any():
            own = batch.filter(pa.array(docs))
            m = own.num_rows
            yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[4:], *(pa.nulls(m, pa.binary()) for _ in range(3))], names)
        for o, of, v in zip(*(batch.filter(pa.array(~docs)).column(i).to_pylist() for i in (1, 2, 3))):
            v = np.frombuffer(v, np.uint64)
            if o is None:  # the part's own counts
                words, counts = v, np.frombuffer(of, np.int64)
            else:
                owners.append(np.frombuffer(o, np.int64)[np.frombuffer(of, np.uint16 if len(of) == 2 * len(v) else np.uint32)])
                rare.append(v)
    if not rare:
        return
    o, h = np.concatenate(owners), np.concatenate(rare)
    c = np.zeros(len(h), np.int64)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        c = np.where(words[at] == h, counts[at], 0)
    rid, place = np.unique(o, return_inverse=True)
    known, logs = np.bincount(place, c > 0), np.bincount(place, np.log10(c + 1.0))
    part = (rid % parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(-1 - p, *(x[order[a:b]].tobytes() for x in (rid, known.astype(np.int64), logs))) for p, a, b in zip(range(parts), cuts, cuts[1:]) if b > a]
    at, *packed = zip(*rows)
    none = [pa.nulls(len(rows), k) for k in kinds]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *none, *(pa.array(x, pa.binary()) for x in packed)], names)


def _sum_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a part with the sums of their rare words over all parts."""
    docs, rids, known, logs = [], [], [], []
    for batch in batches:
        packed = np.asarray(batch.column(1).is_null())
        if not packed.all():
            docs.append(batch.filter(pa.array(~packed)))
        for a, b, c in zip(*(batch.filter(pa.array(packed)).column(i).to_pylist() for i in (-3, -2, -1))):
            rids.append(np.frombuffer(a, np.int64))
            known.append(np.frombuffer(b, np.int64))
            logs.append(np.frombuffer(c, np.float64))
    rid, place = np.unique(np.concatenate(rids), return_inverse=True) if rids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = np.bincount(place, np.concatenate(known), len(rid)) if rids else np.zeros(0)
    x = np.bincount(place, np.concatenate(logs), len(rid)) if rids else np.zeros(0)
    for own in docs:
        mine = np.asarray(own.column(1))
        at = np.minimum(np.searchsorted(rid, mine), max(0, len(rid) - 1))
        hit = rid[at] == mine if len(rid) else np.zeros(len(mine), bool)
        far = (np.where(hit, y[at], 0) if len(rid) else np.zeros(len(mine)) for y in (n, x))
        yield pa.RecordBatch.from_arrays([*own.columns[2 : 1 + len(_DOC)], *(pa.array(y, k) for y, k in zip((v.astype(t) for v, t in zip(far, (np.int64, np.float64))), (pa.int64(), pa.float64())))], [*list(_DOC)[1:], "far_known", "far_log"])


def score_texts(
    docs: DataFrame,
    scratch: Scratch,
    folds: int = 7,
    fold: int = 2,
    rounds: int = 5,
    rate: float = 2e-2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Words are lower-cased (A-Z) and an end token follows each document. Rows whose crc32(doc_id) mod
    ``folds`` is ``fold`` are held out of everything that is learned.

    1. All training words are counted: packed by hash, moved once, summed by part.
    2. Words become the network's ids, written once with what the frequent words' counts give.
    3. The network starts as the unigram of those counts and learns from all stretches of the training
       documents, each once. Each of at least ``rounds`` rounds trains copies on the executors, state
       carried from window to window, and averages them, weighted by what each has seen.
    4. Every whole document is scored, state carried from its first word to its end. Words outside the
       network's vocabulary share its last outcome by (count + 1) / (their sum + 1); counts of words
       beyond the ``HEAD`` most frequent are met by a second shuffle of packed hashes.

    ``base_score`` is the add-one unigram. Null texts are empty: the end alone. A null id is no fold but
    that of the empty string. Repeated rows are scored alike and each
    counts in training. A very long text is scored window by window, whole. Other columns are not looked
    at, whatever their names. Word counts are exact up to collisions of
    64-bit hashes. An empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts_for(text_bytes(docs, text), 24 << 20)
    dealt = own.mapInArrow(_count_words(folds, fold, parts), DEALT_DDL).repartitionById(parts, F.col("part"))
    counts = scratch.table(dealt.mapInArrow(_sum_counts, "part int, words binary, counts binary, n long, v long"), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    # the scale has a few hundred steps; the head is what lies above one of them and a share of that one
    scale = counts.mapInArrow(_histogram, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    edge = _edge([(r["step"], r["n"]) for r in scale], HEAD)
    head = counts.mapInArrow(_words_from(*edge), "word long, c long").toPandas()
    head = head.sort_values(["c", "word"], ascending=[False, True])
    vocabulary = Vocabulary(head["word"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), n, v)
    net = Network.start(head["c"].to_numpy(np.float64)[: vocabulary.size], vocabulary.rest)

    keyed = own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    coded = scratch.table(keyed.mapInArrow(_code(vocabulary, folds, fold, parts), f"kind int, {DEALT_DDL}, {_DOC_DDL}, ids binary"), "coded", "kind")
    texts = coded.where(F.col("kind") == DOC)
    rounds = _rounds(n, rounds)
    drawn = texts.where("not held_out").select("rid", "ids").mapInArrow(_stretches(vocabulary.end_id, rounds), "ids binary, turn int")
    rows = scratch.table(drawn.repartitionById(rounds, F.col("turn")), "stretches", "turn")  # a round reads its own alone
    by_turn = {r["turn"]: r["count"] for r in rows.groupBy("turn").count().collect()}  # one row a round
    for k in range(rounds):
        if not by_turn.get(k):
            continue
        tasks = parts_for(by_turn[k], TASK_STRETCHES)
        part = rows.where(F.col("turn") == k).select("ids").repartition(tasks)
        trained = part.mapInArrow(_train_round(net, rate * (1 - 0.8 * k / rounds), 8, TASK_STRETCHES), "slice int, weights binary, seen long")
        averaged = trained.repartitionById(8, F.col("slice")).mapInArrow(_average, "slice int, weights binary")
        slices = {r["slice"]: np.frombuffer(r["weights"], np.float32) for r in averaged.collect()}  # one network in all
        net = net.unpack(np.concatenate([slices[i] for i in range(8)]))
    net.end_id = vocabulary.end_id
    scored = texts.select(*_DOC, "ids").mapInArrow(_score_docs(net, parts), f"{DEALT_DDL}, {_DOC_DDL}")
    rare = coded.where(F.col("kind") == RARE).select(*DEALT.names, *_DOC)
    stored = counts.select(
        "part", F.lit(None).cast("binary").alias("owners"), F.col("counts").alias("of"), F.col("words").alias("values"),
        *(F.lit(None).cast(t).alias(k) for k, t in _DOC.items()),
    )
    place = F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).cast("int")
    met = scored.unionByName(rare).unionByName(stored).repartitionById(parts, place).mapInArrow(
        partial(_meet_counts, parts), f"part int, {_DOC_DDL}, rids binary, far_known binary, far_log binary"
    )
    # to the documents' own parts: one packed row for each pair of parts, however many documents
    home = met.repartitionById(parts, (-1 - F.col("part")).cast("int"))
    own_ddl = ", ".join(f"{k} {t}" for k, t in list(_DOC.items())[1:])
    total = home.mapInArrow(_sum_rare, f"{own_ddl}, far_known long, far_log double")
    return total.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("far_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("far_log") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("outcome") / _LN10 + F.col("shared_log") + F.col("far_log") - F.col("shared") * math.log10(vocabulary.rest)).alias("score"),
    )
