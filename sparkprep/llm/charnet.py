"""Secret scans: rules find the base spans, a character network judges every other candidate in its context.

The rules are three patterns with a least length each. Candidates for the network
are all runs of 12 or more key characters. It reads the whole candidate, 24 characters
before it and 24 after it (40 from its start at least), each one of a small set of
character classes plus a mark for "inside the candidate"; long ones go through it in
segments whose maxima are joined. One
convolution of width 5, ReLU, the maximum over positions inside and outside the
candidate, and a logistic output, all in numpy.

It is trained on labelled findings: candidates that a rule's span covers are
secrets, others are not. All candidates take part, each whole. They are dealt by hash
to shards of about ``SHARD_BYTES``; in each of ``ROUNDS`` rounds every shard goes on
from the common weights over all of its candidates, in batches, and the shards'
weights are averaged. Both labels weigh the same in all. In half of the secrets the
text before is blanked as well, so that the value itself counts. Scores are calibrated
by a logistic fit, and the threshold is the largest that still finds ``RECALL`` of the
secrets, each judged with the text before it and with that blanked. Both rest on every
candidate, scored by a network that did not see it: two more networks are trained in
the same rounds, each on every other shard, and score the rest. The network keeps the
recall and the precision that the threshold has there. Candidates at or above it are
added as ``model`` spans unless they lie wholly inside a base span.

Defined results: a null text counts as empty and has no span; if one of the
labels does not occur the network is left out and only base spans remain; equal
rows get equal spans; weights are summed as whole numbers, so that neither the order
nor the number of tasks changes the network; an empty table gives an empty result.
Only id and text are read by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import texts
from sparkprep.session import Scratch, settings

# The kinds in the order in which ties are listed, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
# What every match of the first pattern holds, in lower case: a plain search that spares most texts the pattern.
KEYWORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
# Characters read before a candidate, at least from its start on, and after its end.
BEFORE, AFTER, BEHIND = 24, 40, 24
RECALL = 0.99

# Character classes: each letter in lower case, capitals as one more bit, digits, key signs, white space, the rest.
_SIGNS = {c: 38 + i for i, c in enumerate("+/_=.-:\"'")}
CLASSES = 52


def _class(c: int) -> int:
    ch = chr(c)
    if "a" <= ch <= "z":
        return 1 + c - 97
    if "A" <= ch <= "Z":
        return 1 + c - 65
    if "0" <= ch <= "9":
        return 27 + c - 48
    return _SIGNS.get(ch, 47 if ch in " \t\r\n\v\f" else 48)


# One byte a character: its class, plus CLASSES for a capital, plus twice that inside the candidate. Absent places are 0.
CAPITAL, INSIDE = CLASSES, 2 * CLASSES
_CODES = bytes(_class(c) + CAPITAL * (65 <= c <= 90) if c < 128 else 0 for c in range(256))
_WITHIN = bytes(min(c + INSIDE, 255) for c in range(256))
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the rules' findings, by start, then kind."""
    found, lowered = [], text.lower()
    if any(word in lowered for word in KEYWORDS):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def covered(start: int, end: int, spans: list[Span]) -> bool:
    return any(s < end and start < e for s, _, e in spans)


def inside(start: int, end: int, spans: list[Span]) -> bool:
    return any(s <= start and end <= e for s, _, e in spans)


def _extent(start: int, end: int) -> int:
    """Characters read from a candidate's start on."""
    return max(AFTER, end - start + BEHIND)


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The codes of each candidate and its surroundings, a row of bytes each."""
    # characters outside ASCII become a question mark, which is of their class
    codes = text.encode("ascii", "replace").translate(_CODES) if spans else b""
    out = np.empty(len(spans), dtype=object)
    for i, (start, end) in enumerate(spans):
        before = codes[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0")
        size = _extent(start, end)
        out[i] = before + (codes[start:end].translate(_WITHIN) + codes[end : start + size]).ljust(size, b"\0")
    return out


def blanked(row: bytes) -> bytes:
    """A candidate's row without the text before it."""
    return bytes(BEFORE) + row[BEFORE:]


WIDTH, EMBED, FILTERS = 5, 12, 24
EDGE = WIDTH // 2
# Places that go through the network at a time, and that a segment of a long candidate has.
PLACES, SEGMENT = 1 << 13, 1 << 12
# Bytes of a shard's rows, rounds over all shards, rows of a batch, and the steps that a round has at least (small shards are passed more than once).
SHARD_BYTES, ROUNDS, BATCH, STEPS = 1 << 20, 3, 128, 96
# Shards cost far more than their bytes tell: few go to a file, and a task reads few files, whatever the number of shards.
SPREAD = {"spark.sql.files.maxRecordsPerFile": "4", "spark.sql.files.maxPartitionBytes": "8388608", "spark.sql.files.openCostInBytes": "4194304"}
RATE = 3e-3
WEIGHTS = ("embedding", "kernel", "bias", "out", "out_bias")
# Weights and logistic sums are added up as multiples of these.
WEIGHT_UNIT, SUM_UNIT = 2.0**-40, 2.0**-20


@dataclass
class Network:
    """Weights, calibration and threshold, with recall and precision on candidates that it was not trained on."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0
    precision: float = 0.0

    def _features(self) -> np.ndarray:
        """The channels of each code: embedding, capital, inside."""
        code = np.arange(4 * CLASSES)
        marks = np.stack([code // CAPITAL % 2, code // INSIDE], axis=1)
        return np.concatenate([np.tile(self.embedding, (4, 1)), marks], axis=1)

    @cached_property
    def _taps(self) -> np.ndarray:
        """What each code adds to each filter from each of the kernel's places: (WIDTH, codes, FILTERS)."""
        return (self._features() @ self.kernel.reshape(WIDTH, -1, FILTERS)).astype("f4")

    def _forward(self, rows: Sequence[bytes], segment: int | None = None, traced: bool = False):
        """Maxima inside and outside of each row and the score; if ``traced``, also the codes that made each maximum.

        Rows follow one another without filling; those longer than ``segment`` go in parts, each with its neighbours' edges.
        """
        taps, bias = self._taps, self.bias.astype("f4")
        pooled = np.zeros((len(rows), 2 * FILTERS), dtype="f4")
        codes = np.zeros((len(rows), 2 * FILTERS, WIDTH), dtype="u1") if traced else None
        for owners, parts in _parts(rows, segment):
            sizes = np.array([len(p) for p in parts])
            flat = np.frombuffer(b"".join(parts), dtype="u1")
            n = len(flat) - 2 * EDGE
            active = np.take(taps[0], flat[:n], axis=0)
            for i in range(1, WIDTH):
                active += np.take(taps[i], flat[i : i + n], axis=0)
            active += bias
            # 0 outside, 1 inside, 2 the edges of a part
            kind = (flat >= INSIDE).astype("i8")
            ends = np.cumsum(sizes)
            for i in range(EDGE):
                kind[ends - 1 - i] = kind[ends - sizes + i] = 2
            run = (np.repeat(np.arange(len(parts)), sizes) * 3 + kind)[EDGE : EDGE + n]
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            top = np.maximum.reduceat(active, starts, axis=0)
            if traced:
                at = _first(active, top, starts, n)
            whose, of = np.array(owners)[run[starts] // 3], run[starts] % 3
            # a row has several runs outside, and one of each part
            for which in (0, 1):
                own = np.flatnonzero(of == which)
                nth = np.arange(len(own)) - np.searchsorted(whose[own], whose[own])
                held = slice(FILTERS, 2 * FILTERS) if which == 0 else slice(0, FILTERS)
                for turn in range(int(nth.max(initial=-1)) + 1):
                    some = own[nth == turn]
                    row = whose[some]
                    better = top[some] > pooled[row, held]
                    if traced:
                        r, f = np.divmod(np.flatnonzero(better), FILTERS)
                        codes[row[r], f + held.start] = flat[at[some[r], f][:, None] + np.arange(WIDTH)]
                    pooled[row, held] = np.where(better, top[some], pooled[row, held])
        # row by row, so that a score does not hang on the rows beside it
        raw = (pooled * self.out).sum(axis=1) + self.out_bias[0]
        return pooled, codes, None, raw

    def raw(self, rows: Sequence[bytes]) -> np.ndarray:
        """Scores before calibration, some rows and segments at a time."""
        return self._forward(rows, SEGMENT)[3].astype("f4")

    def chance(self, rows: Sequence[bytes]) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        return self.calibrated(self.raw(rows))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * np.asarray(raw, dtype=float) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def _parts(rows: Sequence[bytes], segment: int | None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows, or parts of long ones, with ``EDGE`` codes of their neighbours, about ``PLACES`` codes at a time, with their owners."""
    owners, parts, places = [], [], 0
    for i, row in enumerate(rows):
        step = segment or len(row)
        for low in range(0, len(row), step):
            before = row[max(0, low - EDGE) : low].rjust(EDGE, b"\0")
            part = before + row[low : low + step] + row[low + step : low + step + EDGE].ljust(EDGE, b"\0")
            owners.append(i)
            parts.append(part)
            places += len(part)
            if places >= PLACES:
                yield owners, parts
                owners, parts, places = [], [], 0
    if parts:
        yield owners, parts


def _first(active: np.ndarray, top: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first place at which each run of places reaches its maximum."""
    sizes = np.diff(np.r_[starts, n])
    place, f = np.divmod(np.flatnonzero(active == np.repeat(top, sizes, axis=0)), FILTERS)
    run = np.repeat(np.arange(len(starts)), sizes)[place]
    at = np.zeros(top.size, dtype="i8")
    at[(run * FILTERS + f)[::-1]] = place[::-1]
    return at.reshape(top.shape)


def fresh(seed: int = 1) -> Network:
    """A network before training."""
    rng = np.random.default_rng(seed)
    channels = EMBED + 2
    return Network(
        rng.normal(0, 0.3, (CLASSES, EMBED)),
        rng.normal(0, math.sqrt(2 / (WIDTH * channels)), (WIDTH * channels, FILTERS)),
        np.zeros(FILTERS),
        rng.normal(0, 0.1, 2 * FILTERS),
        np.zeros(1),
    )


def _gradients(net: Network, rows: Sequence[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    pooled, codes, _, raw = net._forward(rows, SEGMENT, traced=True)
    error = (_sigmoid(raw) - y) * weight / len(rows)
    r, f = np.divmod(np.flatnonzero(pooled > 0), 2 * FILTERS)
    back, codes, f_of = error[r] * net.out[f], codes[r, f].astype("i8"), f % FILTERS
    size = 4 * CLASSES * FILTERS
    taps = np.stack([np.bincount(codes[:, i] * FILTERS + f_of, back, size).reshape(-1, FILTERS) for i in range(WIDTH)])
    kernel = net.kernel.reshape(WIDTH, -1, FILTERS)
    features = (taps @ kernel.transpose(0, 2, 1)).sum(axis=0)
    return {
        "embedding": features[:, :EMBED].reshape(4, CLASSES, EMBED).sum(axis=0),
        "kernel": (net._features().T @ taps).reshape(net.kernel.shape),
        "bias": np.bincount(f_of, back, FILTERS),
        "out": pooled.T @ error,
        "out_bias": error.sum(keepdims=True),
    }


def descend(net: Network, rows: Sequence[bytes], y: np.ndarray, weight: np.ndarray, seed: int, rate: float = RATE) -> Network:
    """The network after passes over all rows by Adam, in batches; half of the secrets are met blanked, too."""
    blank = np.flatnonzero(y == 1)[::2]
    rows = [*rows, *(blanked(rows[i]) for i in blank)]
    y, weight = np.concatenate([y, y[blank]]), np.concatenate([weight, weight[blank]])
    rng, weights, step = np.random.default_rng(seed), {}, 0
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in WEIGHTS}
    for _ in range(max(1, math.ceil(STEPS * BATCH / max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            step += 1
            for n, gradient in _gradients(net, [rows[i] for i in some], y[some], weight[some]).items():
                m, v = moments[n]
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient**2 - v)
                weights[n] = getattr(net, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net = replace(net, **weights)
    return net


def _rate(nth: int) -> float:
    return RATE * (1 - nth / ROUNDS)


def train(x: Sequence[bytes], y: np.ndarray) -> Network:
    """A network trained on rows held in memory: one shard, calibrated on itself."""
    net = fresh()
    for nth in range(ROUNDS):
        net = descend(net, x, y, np.ones(len(y)), nth, _rate(nth))
    raw = np.concatenate([net.raw(x), net.raw([blanked(r) for r in x[y == 1]])])
    labels = np.concatenate([y, np.ones(int((y == 1).sum()))])
    return _calibrate(net, lambda part: part(raw, labels, np.ones(len(raw), dtype="i8")))


def _ranked(raw: np.ndarray) -> np.ndarray:
    """Four-byte scores as whole numbers from 0 in the same order; -0 is 0."""
    bits = (raw.astype("f4") + np.float32(0)).view("i4").astype("i8")
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)


def _unranked(number: int) -> float:
    number -= 1 << 31
    value = np.array([abs(number)], dtype="i4").view("f4")[0]
    return -float(value) if number < 0 else float(value)


# Sums over all scores: of a function of scores, labels and counts that gives whole numbers.
Total = Callable[[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _calibrate(net: Network, total: Total) -> Network:
    """Slope and shift by Newton's method, the threshold as an exact rank, recall and precision there."""
    n, found = total(lambda raw, y, k: np.array([k.sum(), (k * (y == 1)).sum()])).tolist()
    # targets drawn in from 0 and 1, so that separable scores keep a finite slope
    high, low = (found + 1) / (found + 2), 1 / (n - found + 2)

    def sums(slope: float, shift: float) -> np.ndarray:
        def part(raw: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
            raw, aim = raw.astype(float), np.where(y == 1, high, low)
            z = slope * raw + shift
            chance = _sigmoid(z)
            loss, error, bend = np.logaddexp(0, z) - aim * z, chance - aim, chance * (1 - chance)
            rows = (loss, error * raw, error, bend * raw * raw, bend * raw, bend)
            return np.round(np.array([(k * r).sum() for r in rows]) / SUM_UNIT).astype("i8")

        return total(part) * (SUM_UNIT / n)

    at, now = np.array([1.0, 0.0]), sums(1.0, 0.0)
    for _ in range(30):
        bends = np.array([[now[3], now[4]], [now[4], now[5]]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(bends, now[1:3])
        while (then := sums(*(at - step)))[0] > now[0] and np.abs(step).max() > 1e-4:
            step = step / 2
        if then[0] > now[0]:
            break
        at, now = at - step, then
        if np.abs(step).max() < 1e-4:
            break
    slope, shift = (round(float(v), 6) for v in at)
    # the score of the rank, by the upper half of its bits, then by the lower
    rest, above, half = int((1 - RECALL) * found + 1e-9), 0, 1 << 16
    for scale in (half, 1):

        def part(raw: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
            number = _ranked(raw) // scale - above * half
            own = (y == 1) & (number >= 0) & (number < half)
            return np.bincount(number[own], k[own], half).astype("i8")

        upto = np.cumsum(total(part))
        slot = int(np.searchsorted(upto, rest, side="right"))
        rest -= int(upto[slot - 1]) if slot else 0
        above = above * half + slot
    least = _unranked(above)
    taken, right = total(lambda raw, y, k: np.array([(k * (raw >= least)).sum(), (k * ((raw >= least) & (y == 1))).sum()])).tolist()
    net = replace(net, slope=slope, shift=shift, recall=right / found, precision=right / taken)
    return replace(net, threshold=float(net.calibrated(np.array([least]))[0]))


def _sum_by_slot(df: DataFrame, sums: Callable[[Iterable[pd.DataFrame]], np.ndarray]) -> np.ndarray:
    """Whole numbers added up by place over all tasks; every task gives an array of one length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = np.asarray(sums(frames), dtype="i8")
        # the last place is there for the length
        slots = np.flatnonzero(np.r_[values[:-1] != 0, True][: len(values)])
        yield pd.DataFrame({"slot": slots, "value": values[slots]})

    with settings(df.sparkSession, Scratch.SETTINGS):
        rows = df.mapInPandas(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r.slot for r in rows), default=-1) + 1, dtype="i8")
    for r in rows:
        out[r.slot] = r.value
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """``secret, place, codes, n`` of every candidate, whole; ``n`` counts equal ones of one id and place."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, batch in texts(frames):
            out = []
            for doc, text in zip(frame["doc_id"].astype(str), batch):
                spans = candidates(text)
                if not spans:
                    continue
                known = base_spans(text)
                out += [(covered(s, e, known), _place(doc, s, text[s:e]), row) for (s, e), row in zip(spans, windows(text, spans))]
            yield pd.DataFrame(out, columns=["secret", "place", "codes"])

    found = docs.select("doc_id", "text").mapInPandas(find, "secret boolean, place long, codes binary")
    return found.groupBy("secret", "place", "codes").agg(F.count("*").alias("n"))


def _sharded(found: DataFrame, shards: int) -> DataFrame:
    """A row per shard: its candidates' codes one after another, their lengths, labels and counts."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "secret", "codes"])
        codes = [bytes(c) for c in frame["codes"]]
        row = (int(frame["shard"].iloc[0]), b"".join(codes), [len(c) for c in codes], frame["secret"].tolist(), frame["n"].tolist())
        return pd.DataFrame([row], columns=["shard", "codes", "sizes", "secret", "n"])

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("place", "codes"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(pack, "shard long, codes binary, sizes array<int>, secret array<boolean>, n array<long>")


def _unpacked(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Shard, rows, labels and counts of each shard."""
    for frame in frames:
        for shard, codes, sizes, secret, n in zip(*(frame[c] for c in ("shard", "codes", "sizes", "secret", "n"))):
            ends, codes = np.cumsum(sizes).tolist(), bytes(codes)
            yield int(shard), [codes[a:b] for a, b in zip([0, *ends], ends)], np.asarray(secret).astype(float), np.asarray(n, dtype="i8")


def _flat(net: Network) -> np.ndarray:
    """The weights as whole numbers, and a one that counts the networks added up."""
    return np.append(np.round(np.concatenate([getattr(net, n).ravel() for n in WEIGHTS]) / WEIGHT_UNIT), 1).astype("i8")


def _mean(net: Network, total: np.ndarray) -> Network:
    """The mean of the networks added up in ``total``, or ``net`` if there are none."""
    if not total[-1]:
        return net
    weights, at, out = total[:-1] * (WEIGHT_UNIT / total[-1]), 0, {}
    for n in WEIGHTS:
        size = getattr(net, n).size
        out[n] = weights[at : at + size].reshape(getattr(net, n).shape)
        at += size
    return replace(net, **out)


def fit(docs: DataFrame) -> Network | None:
    """A network trained on all of the documents' own candidates, or None if a label does not occur."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(_labelled(docs), "secret-candidates")
    labels = {r.secret: r for r in found.groupBy("secret").agg(F.sum("n").alias("n"), F.sum(F.octet_length("codes")).alias("size")).collect()}
    if len(labels) < 2:
        scratch.drop("secret-candidates")
        return None
    # both labels weigh half of all
    half = sum(r.n for r in labels.values()) / 2
    of_label = np.array([half / labels[False].n, half / labels[True].n])
    shards = max(2, math.ceil(sum(r.size for r in labels.values()) / SHARD_BYTES))
    with settings(docs.sparkSession, SPREAD):
        packed = scratch.write(_sharded(found, shards), "secret-shards")
    # of all shards, of the even, of the odd
    nets, size = [fresh()] * 3, len(_flat(fresh()))
    for nth in range(ROUNDS):

        def learn(frames: Iterable[pd.DataFrame]) -> np.ndarray:
            total = np.zeros((3, size), dtype="i8")
            for shard, rows, y, n in _unpacked(frames):
                for which in (0, 1 + shard % 2):
                    total[which] += _flat(descend(nets[which], rows, y, of_label[y.astype(int)] * n, shard * ROUNDS + nth, _rate(nth)))
            return total.ravel()

        with settings(docs.sparkSession, SPREAD):
            totals = _sum_by_slot(packed, learn).reshape(3, size)
        nets = [_mean(net, total) for net, total in zip(nets, totals)]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows, y, n in _unpacked(frames):
            net, secret = nets[2 - shard % 2], np.flatnonzero(y == 1)
            raw = np.concatenate([net.raw(rows), net.raw([blanked(rows[i]) for i in secret])])
            yield pd.DataFrame({"raw": raw, "secret": np.append(y, y[secret]) == 1, "n": np.append(n, n[secret])})

    with settings(docs.sparkSession, SPREAD | {"spark.sql.files.maxRecordsPerFile": "0"}):
        scores = scratch.write(packed.mapInPandas(score, "raw float, secret boolean, n long"), "secret-scores")

    def total(part: Callable) -> np.ndarray:
        def sums(frames: Iterable[pd.DataFrame]) -> np.ndarray:
            out = part(np.zeros(0, dtype="f4"), np.zeros(0), np.zeros(0, dtype="i8"))
            for frame in frames:
                out = out + part(frame["raw"].to_numpy(), frame["secret"].to_numpy().astype(float), frame["n"].to_numpy())
            return out

        return _sum_by_slot(scores, sums)

    net = _calibrate(nets[0], total)
    scratch.drop("secret-candidates", "secret-shards", "secret-scores")
    return net


def _place(doc: str, start: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{doc}:{start}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def scans(batch: Sequence[str], net: Network | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text; the texts' candidates are judged together."""
    bases = [base_spans(text) for text in batch]
    if net is None:
        return [(base, base) for base in bases]
    rest = [[c for c in candidates(text) if not inside(*c, base)] for text, base in zip(batch, bases)]
    rows = np.concatenate([windows(text, spans) for text, spans in zip(batch, rest)]) if batch else []
    keep = iter(net.chance(rows) >= net.threshold) if len(rows) else iter(())
    return [(base, sorted(base + [(s, 3, e) for s, e in spans if next(keep)])) for base, spans in zip(bases, rest)]


def scan(text: str, net: Network | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text."""
    return scans([text], net)[0]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, net: Network | None) -> DataFrame:
    """Counts, digest and list of each document's spans, in code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, batch in texts(frames):
            rows = []
            for base, spans in scans(batch, shared.value):
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def redacted(text: Column, net: Network | None, spark, mark: str = "[SECRET]") -> Column:
    """The text with each finding replaced by a mark; overlapping findings share one. Null stays null."""
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        batch = [t for t in column if isinstance(t, str)]
        found = iter(scans(batch, shared.value))
        return pd.Series([_marked(t, next(found)[1], mark) if isinstance(t, str) else None for t in column], dtype=object)

    return clean(text)


def redact(text: str, net: Network | None, mark: str = "[SECRET]") -> str:
    return _marked(text, scan(text, net)[1], mark)


def _marked(text: str, spans: list[Span], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
