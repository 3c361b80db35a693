"""Counts of every word, and of every token after the one and after the two that stand before it, over all texts of a table.

Texts are dealt to units of consecutive rows, the counts to parts by hash (of a word; of a token and the one before it). A unit
sends each of its distinct words and runs once to the part of it, with the number of times it is to be learned; the part adds up what
all units sent, and answers each. So a run that stands in many texts weighs no more than one entry a unit, and nothing is
capped: parts and units grow in number with the text.

A run of three is held in 64 bits: 40 of the hash of its last two tokens, beside those that chose the part, and 24 of the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aphora.llm.textmath import U, mix, ragged

#: What stands before the first word of a text, and after the last.
START, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
FAR = 24
_LOW = U((1 << FAR) - 1)
#: Bytes of text in a unit (more if one text is longer), and for each part.
UNIT_BYTES = 4 << 20
PART_BYTES = 12 << 20
#: Steps of the histogram of counts for each doubling, and all of them.
FINE, BINS = 8, 8 * 64
#: What a context of two tokens leaves open, in occurrences of it, where passages are repeated.
SURE = 1 / 16
#: Weight that is dealt out evenly after every token, and tokens whose corrections are one matrix.
SWITCH = 1 / 64
ROW = 64


def part_count(size: int) -> int:
    """Parts for so many bytes of text."""
    return min(1 << 16, max(1, -(-size // PART_BYTES)))


def layout(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words, and where the first tokens, of texts of so many words stand among all tokens; each text ends in one."""
    return np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n), np.cumsum(n + 1) - n - 1


def runs(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: the hash of it and the token before, and the 64 bits that hold it and the two before."""
    at, opens = layout(n)
    name = np.full(len(hashes) + len(n), END)
    name[at] = hashes
    before = np.roll(name, 1)
    before[opens] = START
    far = np.roll(before, 1)
    far[opens] = START
    pair = mix(mix(before + U(5)) + name)
    return pair, pair & ~_LOW | mix(far + U(9)) >> U(64 - FAR)


def distinct(hashes: np.ndarray, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, by part and in order; where each part begins; where one of each stands; the place of every given key."""
    part = ((hashes & _LOW) % U(parts)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    border = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    k, new = keys[order], np.ones(len(keys), bool)
    for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()):
        if hi - lo > 1:
            inside = np.argsort(k[lo:hi])
            order[lo:hi], k[lo:hi] = order[lo:hi][inside], k[lo:hi][inside]
            np.not_equal(k[lo + 1 : hi], k[lo : hi - 1], out=new[lo + 1 : hi])
    place, at = np.empty(len(k), np.int64), np.cumsum(new)
    place[order] = at - 1
    return k[new], np.append(0, at)[border], order[new], place


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers in one compressed piece: byte plane by byte plane, as many as the largest number of each has."""
    planes = [-(-int(a.max(initial=0)).bit_length() // 8) for a in arrays]
    raw = b"".join(a.astype("<u8").view(np.uint8).reshape(len(a), 8)[:, :k].T.tobytes() for a, k in zip(arrays, planes))
    return np.array([[len(a) for a in arrays], planes], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, arrays: int) -> list[np.ndarray]:
    lengths, planes = np.frombuffer(blob, "<i8", 2 * arrays).reshape(2, -1)
    ends = np.cumsum(lengths * planes)
    raw, out = np.frombuffer(pa.decompress(blob[16 * arrays :], int(ends[-1]), "zstd"), np.uint8), []
    for n, k, end in zip(lengths.tolist(), planes.tolist(), ends.tolist()):
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :k] = raw[end - n * k : end].reshape(k, n).T
        out.append(whole.view("<u8")[:, 0])
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


def sent(pair: np.ndarray, key: np.ndarray, learned: np.ndarray, hashes: np.ndarray, also: np.ndarray, kind: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """What a unit sends: parts, and for each the distinct runs, and words with their kinds, and the numbers that are learned.
    ``learned`` says so of the unit's tokens, ``also`` of its words."""
    k, a, _, place = distinct(pair, key, parts)
    times = np.bincount(place, learned, len(k)).astype(np.uint64)
    w, b, one, place = distinct(hashes, hashes, parts)
    often, kind = np.bincount(place, also, len(w)).astype(np.uint64), kind[one]
    used = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
    cut = [(p, slice(a[p], a[p + 1]), slice(b[p], b[p + 1])) for p in used.tolist()]
    return [p for p, *_ in cut], [packed(steps(k[i]), times[i], steps(w[j]), often[j], kind[j]) for _, i, j in cut]


def totals(groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups that stand in order: the sum of the counts of each, and the group of every entry."""
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    own = np.cumsum(new) - 1
    return np.add.reduceat(counts, np.flatnonzero(new)) if len(groups) else counts, own


def histogram(counts: np.ndarray) -> np.ndarray:
    """Per step of the counts: the sum of those in it, and their number."""
    held = counts[counts > 0]
    at = (np.log2(held) * FINE).astype(np.int64)
    return np.concatenate([np.bincount(at, held, BINS), np.bincount(at, minlength=BINS)]).astype(np.uint64)


def counted(dealt: DataFrame) -> DataFrame:
    """(unit, part, data, seen, words): for each unit the answers of its parts; and once for each part, without a unit, what its
    counts are like, and its words that are learned."""

    def count(rows: pa.Table) -> pa.Table:
        blobs = [unpacked(x, 5) for x in rows["data"].to_pylist()]
        answers, seen = [], []
        for keys, numbers, shifts in ((0, 1, (FAR, 0)), (2, 3, (0,))):
            key = np.concatenate([np.cumsum(b[keys], dtype=np.uint64) for b in blobs])
            order = np.argsort(key, kind="stable")
            key, times = key[order], np.concatenate([b[numbers] for b in blobs])[order].astype(np.int64)
            borders = np.cumsum([len(b[keys]) for b in blobs])[:-1]
            for shift in shifts:
                total, own = totals(key >> U(shift), times)
                out = np.empty(len(key), np.int64)
                out[order] = total[own]
                answers.append(np.split(out, borders))
                seen.append(total)
        one = np.flatnonzero(np.diff(own, prepend=-1))
        one = one[total > 0]
        words = packed(steps(key[one]), np.concatenate([b[4] for b in blobs])[order[one]], total[total > 0])
        alike = packed(histogram(seen[0]), np.array([(seen[0] == 1).sum(), (seen[1] == 1).sum()]))
        none = [None] * len(rows)
        return pa.table(
            [pa.array([*rows["unit"].to_pylist(), None], pa.int64()), pa.array(rows["part"].to_pylist() + rows["part"][:1].to_pylist(), pa.int32()),
             pa.array([*(packed(*a) for a in zip(*answers)), None], pa.binary()), pa.array([*none, alike], pa.binary()), pa.array([*none, words], pa.binary())],
            ["unit", "part", "data", "seen", "words"])

    return dealt.groupBy("part").applyInArrow(count, "unit bigint, part int, data binary, seen binary, words binary")


def answered(data: dict[int, bytes]) -> list[np.ndarray]:
    """Counts of a unit's distinct runs of two and of three, and words, in the order of ``distinct``; data by part."""
    found = [unpacked(data[p], 3) for p in sorted(data)]
    return [np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]).astype(np.int64) for i in range(3)]


def concentration(mass: np.ndarray, mean: np.ndarray, unseen: float) -> float:
    """How many occurrences of a context the shorter one weighs: at this number its share, over all tokens learned, is the
    share of those whose run occurs but once, so that no other occurrence foretells it. ``mass`` tokens follow contexts that occur
    ``mean`` times, the token's own time included."""
    lo, hi = np.log(1e-3), np.log(1e6)
    for _ in range(60):
        mid = (lo + hi) / 2
        a = np.exp(mid)
        lo, hi = (mid, hi) if (mass * a / (mean - 1 + a)).sum() < unseen else (lo, mid)
    return float(np.exp((lo + hi) / 2))


def continued(shorter: np.ndarray, run: np.ndarray, context: np.ndarray, weight: float) -> np.ndarray:
    """Probability of a token after a context met ``context`` times, ``run`` of them with the token."""
    return (np.minimum(run, context) + weight * shorter) / (context + weight)


def switched(experts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each text, of ``n`` tokens (one or more), by its tokens' probabilities under several
    predictors (predictors x tokens). The predictors are mixed by weights that are corrected after every token: each is multiplied by
    the probability that its predictor gave, then a share of ``SWITCH`` of all weight is dealt out evenly.

    The corrections of a row of ``ROW`` tokens are one matrix, so that all rows are worked on at once, token by token; then the rows
    of each text are applied in order. What pads a row has probability one and leaves the sum of the weights as it is."""
    many, rows = len(experts), -(-n // ROW)
    best = experts.max(0)
    doc, at = ragged(n)
    first = np.cumsum(rows) - rows
    row, column = first[doc] + at // ROW, at % ROW
    padded = np.ones((ROW, many, int(rows.sum())))
    for j, expert in enumerate(experts):
        padded[column, j, row] = expert / best
    # Weights of predictor j (second) after a row that began with predictor i (first).
    held = np.broadcast_to(np.eye(many)[:, :, None], (many, many, padded.shape[2])).copy()
    for column in padded:
        held *= column
        even = held.sum(1, keepdims=True)
        even *= SWITCH / (1 - SWITCH) / many
        held += even
    held *= (1 - SWITCH) ** ROW
    out, weights = np.bincount(doc, np.log(best), len(n)), np.full((many, len(n)), 1 / many)
    order = np.argsort(-rows, kind="stable")
    for t, count in enumerate(np.searchsorted(-rows[order], -np.arange(rows.max(initial=0)), "left")):
        now = order[:count]
        after = np.einsum("id,ijd->jd", weights[:, now], held[:, :, first[now] + t])
        total = after.sum(0)
        out[now] += np.log(total)
        weights[:, now] = after / total
    return out
