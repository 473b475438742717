"""Likeness of strings by insertions and deletions: 100 * 2 * LCS / (both lengths), LCS being the longest common subsequence.

Subsequences are counted with a bit for each character of the shorter side, all windows of a context at once."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

U64 = np.uint64
_ALL = ~U64(0)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one Python integer for each character of a."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _bits(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v).astype(np.int64)


#: Words of bits for probes up to so many characters; longer ones have one or two of 64.
WORDS = [(np.uint16, 16), (np.uint32, 32)]
#: Characters of contexts whose windows are counted at once.
AT_ONCE = 1 << 14


def _from_start(probe: str, context: str) -> float:
    """The greatest ratio of probe to a stretch at the beginning of context that is shorter than it."""
    m = len(probe)
    at: dict[str, int] = {}
    for i, x in enumerate(probe):
        at[x] = at.get(x, 0) | 1 << i
    full, row, best = (1 << m) - 1, (1 << m) - 1, 0.0
    for t, y in enumerate(context[: m - 1], 1):
        k = at.get(y, 0)
        row = ((row + (row & k)) | (row & ~k)) & full
        best = max(best, 200 * (m - row.bit_count()) / (m + t))
    return best


def _windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For pairs of a probe and a context that is no shorter, the longest probes first: the greatest ratio of each to a window of its
    context. All contexts lie behind one another, each with room for its probe."""
    m, n = (np.array([len(x[i]) for x in pairs]) for i in (0, 1))
    ends = np.cumsum(n + m)
    begins, total = ends - n - m, int(ends[-1])
    kind = next((k for k, n_bits in WORDS if m[0] <= n_bits), U64)  # narrow words go faster
    width, all_ = np.iinfo(kind).bits, kind(np.iinfo(kind).max)
    low, high = np.zeros(total + m[0], kind), np.zeros(total + m[0] if m[0] > 64 else 0, U64)
    i = 0
    while i < len(pairs):  # contexts of one probe together
        j = i + 1
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        at: dict[int, int] = {}
        for k, x in enumerate(pairs[i][0]):
            at[ord(x)] = at.get(ord(x), 0) | 1 << k
        chars = np.array(sorted(at), np.uint32)
        point = np.frombuffer("".join(c for _, c in pairs[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.repeat(begins[i:j] - (np.cumsum(n[i:j]) - n[i:j]), n[i:j]) + np.arange(len(point))
        own = np.minimum(np.searchsorted(chars, point), len(chars) - 1)
        hit = np.flatnonzero(chars[own] == point)
        low[where[hit]] = np.array([at[x] & int(all_) for x in chars.tolist()], kind)[own[hit]]
        if m[i] > 64:
            high[where[hit]] = np.array([at[x] >> 64 for x in chars.tolist()], U64)[own[hit]]
        i = j
    v, w = np.full(total, all_), np.full(total if m[0] > 64 else 0, _ALL)
    for t in range(m[0]):
        upto = int(ends[np.count_nonzero(m > t) - 1])  # probes that are as long
        x, a = v[:upto], low[t : t + upto]
        s = x + (x & a)
        if m[0] > 64:
            long = int(ends[np.count_nonzero(m > max(t, 64)) - 1])
            y, b = w[:long], high[t : t + long]
            w[:long] = (y + (y & b) + (s[:long] < x[:long])) | (y & ~b)
        v[:upto] = s | (x & ~a)
    size = np.repeat(m, n + m)
    got = size - _bits(v & (all_ >> (width - np.minimum(size, width)).astype(kind)))
    if m[0] > 64:
        at_long = np.flatnonzero(size > 64)
        got[at_long] -= _bits(w[at_long] & (_ALL >> (128 - size[at_long]).astype(U64)))
    left = np.repeat(begins + n, n + m) - np.arange(total)  # characters from here to the end
    return np.maximum.reduceat(np.where(left > 0, 200 * got / (size + np.clip(left, 1, size)), 0.0), begins)


def best_windows(pairs: list[tuple[str, str]]) -> list[float]:
    """For each probe (up to 128 characters) and context the greatest ratio of the probe to a stretch of the context: as long as the
    probe, or shorter at an end. Windows of all pairs are counted together, AT_ONCE characters at a time."""
    pairs = [(p, c) if len(p) <= len(c) else (c, p[:128]) for p, c in pairs]
    best = [_from_start(p, c) if p else 0.0 if c else 100.0 for p, c in pairs]
    order = sorted((i for i, (p, _) in enumerate(pairs) if p), key=lambda i: (-len(pairs[i][0]), pairs[i][0]))
    while order:
        upto = size = 0
        bits = lambda i: next((n for _, n in WORDS if len(pairs[i][0]) <= n), 64)
        while upto < len(order) and (not upto or size < AT_ONCE and bits(order[upto]) == bits(order[0])):
            size += len(pairs[order[upto]][1])
            upto += 1
        for i, x in zip(order[:upto], _windows([pairs[i] for i in order[:upto]]), strict=True):
            best[i] = max(best[i], float(x))
        order = order[upto:]
    return best


def best_window(probe: str, context: str) -> float:
    return best_windows([(probe, context)])[0]


def partial_ratio(a: str, b: str) -> float:
    """best_window, both ways where the lengths are equal."""
    got = best_window(a, b)
    return max(got, best_window(b, a)) if len(a) == len(b) else got


def anchored(contexts: list, anchors: list, least: float = 75, reach: int = 80) -> list[bool]:
    """Whether each context holds one of its anchors (white space and case aside), or something much like its first characters."""
    flat = lambda x: " ".join(x.lower().split())
    out, open_ = [False] * len(contexts), []
    for i, (c, own) in enumerate(zip(contexts, anchors, strict=True)):
        own = [flat(a) for a in ([] if own is None else own) if a]
        if c is None or not own:
            continue
        c = flat(c)
        out[i] = any(a in c for a in own)
        if not out[i]:
            open_ += [(i, a[:reach], c) for a in own]
    pairs = {(x, y): 0.0 for _, a, c in open_ for x, y in ([(a, c), (c, a)] if len(a) == len(c) else [(a, c)])}
    for pair, got in zip(pairs, best_windows(list(pairs)), strict=True):
        pairs[pair] = got
    for i, a, c in open_:
        out[i] = out[i] or max(pairs[a, c], pairs.get((c, a), 0.0) if len(a) == len(c) else 0.0) >= least
    return out


def contains_anchor(context: str, anchor: str | None, least: float = 75, reach: int = 80) -> bool:
    return anchored([context], [[anchor]], least, reach)[0]


@F.pandas_udf(BooleanType())
def _any_anchor(context: pd.Series, anchors: pd.Series) -> pd.Series:
    return pd.Series(anchored(context.tolist(), anchors.tolist()), dtype=bool)


def any_anchor(context, anchors) -> Column:
    """Whether one of an array of anchors is in the context, exactly or approximately."""
    return _any_anchor(context, anchors)


def bags(texts: list[str]) -> np.ndarray:
    """How often each of 64 kinds of characters is in each text."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), np.uint32) & 63, 1)
    return out


def alike(line: str, names: list[str], least: float) -> list[bool]:
    """Which names are like a line. Common characters, counted in kinds, are no fewer than the longest common subsequence, so only
    names with enough of them are compared."""
    bag = bags([line, *names])
    most = np.minimum(bag[1:], bag[:1]).sum(axis=1)
    return [200 * int(k) >= least * (len(line) + len(n)) and ratio(line, n) >= least for k, n in zip(most, names, strict=True)]
