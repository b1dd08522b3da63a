"""Passages that repeat across documents, by compact windows.

A text is a sequence of word shingles. Under a hash function each run of T shingles has a least one, its centre; the Cartesian
tree of the hashes groups all runs with the same centre into one compact window, so a text has few windows. Two texts that share
a passage share its centre under every function, and texts that nearly share it do so under most.

1.  The windows' centres are counted over all documents, by hash; only windows whose centre other documents have too go on.
2.  Runs in such windows are joined by fingerprint: a run of T shingles that two documents have is an exact repeat, found without
    loss and without comparing pairs. Windows are also joined by centre, under several functions, with the shingles around the
    centre; all pairs whose surroundings differ in what others have too are verified: every run of T shingles around the centre
    that is as similar as asked to one of the other window, by their sets, is a near repeat.
3.  The answers go back to the documents' blocks, where runs become spans of words.

Joins are by hash. Windows of a centre whose surroundings agree, but for shingles that nobody else has, are compared as one; so
pairs grow with the square of how many variants of a passage there are, not of how often it occurs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WordHashes, materialise, mix, partitions, release, runs, shingle_hashes, split_blocks, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, whole

WIDTH = 5
#: Windows that a task compares at a time, about; those of one centre are not parted.
WINDOWS = 4_000
#: Hash functions: the first also finds the exact repeats.
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


BLOB = "block long, ids array<long>, rest array<string>, sizes binary, texts binary, windows array<binary>, asks array<struct<bucket:int,keys:binary,docs:binary>>"


def _blobs(t: int, buckets: int):
    """Blocks of texts, with their compact windows and what is asked about the centres of these."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())]))]
    names = ["block", "ids", "rest", "sizes", "texts", "windows", "asks"]

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for seq, (ids, rest, texts) in enumerate(split_blocks(batches, ["id", "rest", "text"])):
            s = Sequences(texts, WordHashes(), t)
            windows, asks = [], []
            for f, seed in enumerate(SEEDS):
                lo, centre, hi = s.windows(seed)
                windows += [squeeze(centre - lo), squeeze_sorted(centre), squeeze(hi - centre)]
                keys, docs, _ = _distinct(s.seq[centre], s.owner[centre])
                asks += [{"bucket": bucket, "keys": squeeze_sorted(keys[p]), "docs": squeeze(docs[p])} for bucket, p in _bucketed(keys, buckets, f * buckets)]
            sizes = squeeze(np.fromiter(map(len, texts), np.int64, len(texts)))
            row = (task | seq, ids, rest, sizes, zstandard.compress(b"".join(texts), 3), windows, asks)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return run


def _windows(packed: list[bytes], f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left end, centre and right end of a block's windows under function f."""
    before, centre, after = unsqueeze(packed[3 * f], np.int64), unsqueeze_sorted(packed[3 * f + 1], np.int64), unsqueeze(packed[3 * f + 2], np.int64)
    return centre - before, centre, centre + after


def _texts(sizes: bytes, blob: bytes) -> list[bytes]:
    blob, to = zstandard.decompress(blob), np.cumsum(unsqueeze(sizes, np.int64)).tolist()
    return [blob[s:e] for s, e in zip([0, *to], to, strict=False)]


class Sequences:
    """The shingles of those texts of a block that have at least T, one text after another."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, t: int):
        n, hashed = hashes.of_texts(texts)
        long = n >= t + WIDTH - 1
        self.t, self.words, self.docs = t, n.tolist(), np.flatnonzero(long).tolist()
        hashed, n = hashed[np.repeat(long, n)], n[long]
        self.folded = np.maximum((hashed >> np.uint64(40)).astype(np.uint16), 1)  # WIDTH - 1 more for each text than shingles
        self.seq = shingle_hashes(hashed, WIDTH)
        inside = np.ones(len(self.seq), bool)
        inside[(np.cumsum(n)[:-1, None] - np.arange(1, WIDTH)).ravel()] = False  # those that go over the end of a text
        self.seq, sizes = self.seq[inside], n - WIDTH + 1
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)  # place in docs

    def windows(self, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compact windows: left end, centre, right end (inclusive), in order of centre."""
        n, t = len(self.seq), self.t
        if n < t:
            return (np.zeros(0, np.int64),) * 3
        value = mix(self.seq ^ np.uint64(seed))
        least, width = value, 1  # the least value of each run of `width` places
        while 2 * width <= t:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: n - t + 1], least[t - width :])
        inside = np.arange(n - t + 1) + t <= self.ends[self.owner[: n - t + 1]]
        # A run has the centre of the run before it, unless its least value is another or stood at the place that it has left.
        new = np.r_[True, (least[1:] != least[:-1]) | (value[: n - t] == least[:-1])]
        new[self.begins[self.begins <= n - t]] = True
        new, view = np.flatnonzero(inside & new), np.lib.stride_tricks.sliding_window_view(value, t)
        if not len(new):
            return (new,) * 3
        centre = np.concatenate([new[s : s + 65536] + view[new[s : s + 65536]].argmin(1) for s in range(0, len(new), 65536)])
        centre = centre[np.diff(centre, prepend=-1) > 0]
        # Nodes of the Cartesian tree that span T or more: every smaller neighbour of such a node spans as much, so the tree
        # of these nodes alone gives their spans. Of equal values the first is the smaller.
        owner, values = self.owner[centre], value[centre]
        edge = np.diff(owner) != 0
        before, after = _nearest(values, np.r_[True, edge], False), _nearest(values[::-1], np.r_[True, edge[::-1]], True)[::-1]
        left = np.where(before < 0, self.begins[owner], centre[before] + 1)
        right = np.where(after < 0, self.ends[owner] - 1, centre[::-1][after] - 1)
        return left, centre, right

    def fingerprints(self) -> np.ndarray:
        """For each place, a hash of the T shingles from there on; without meaning where fewer follow."""
        n, t = len(self.seq), self.t
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
            sums = np.r_[np.uint64(0), np.cumsum(mix(self.seq) * powers[:n])]
            back = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), inverse)])[:n]
            out = np.zeros(n, np.uint64)
            if n >= t:
                out[: n - t + 1] = mix((sums[t:] - sums[: n - t + 1]) * back[: n - t + 1])
        return out

    def context(self, centre: np.ndarray) -> np.ndarray:
        """For each centre, the words of T - 1 shingles on either side and of itself, as nonzero 16-bit hashes; 0 outside the text."""
        owner, more = self.owner[centre], WIDTH - 1
        at = (centre + more * owner)[:, None] + np.arange(1 - self.t, self.t + more)[None, :]
        inside = (at >= (self.begins[owner] + more * owner)[:, None]) & (at < (self.ends[owner] + more * (owner + 1))[:, None])
        return np.where(inside, self.folded[np.clip(at, 0, len(self.folded) - 1)], 0).astype(np.uint16)


def _nearest(values: np.ndarray, first: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before it with a value that is less, or as small unless `strict`; -1 if there is none from
    the last place on that is marked as `first`."""
    to = np.arange(-1, len(values) - 1)
    to[first] = -1
    at = np.flatnonzero(to >= 0)
    while len(at):
        over = values[to[at]] >= values[at] if strict else values[to[at]] > values[at]
        at = at[over]
        to[at] = to[to[at]]  # all between are over the value there, and so over that here
        at = at[to[at] >= 0]
    return to


def _bucketed(keys: np.ndarray, buckets: int, first: int):
    bucket = ((keys >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(keys)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield first + int(bucket[order[s]]), order[s:e]


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending; in how many of the block's texts each occurs; and where each key stands among them."""
    found, at = np.unique(keys, return_inverse=True)
    pairs = np.unique(at.astype(np.int64) * (int(owner.max(initial=0)) + 1) + owner)
    return found, np.bincount(pairs // (int(owner.max(initial=0)) + 1), minlength=len(found)), at


def _answer_centres(batches):
    """For each block's keys, in order, whether more than one document has the key."""
    for t in runs(batches, "bucket"):
        asked = [unsqueeze_sorted(x.as_py()) for x in t.column("keys")]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        shared = np.bincount(at, weights=np.concatenate([unsqueeze(x.as_py(), np.int64) for x in t.column("docs")])) > 1
        start = 0
        for block, sent in zip(t.column("block").to_pylist(), asked, strict=True):
            mine = shared[at[start : start + len(sent)]]
            start += len(sent)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([t.column("bucket")[0].as_py()], pa.int32()), pa.array([zstandard.compress(np.packbits(mine).tobytes(), 1)], pa.binary())], ["block", "bucket", "shared"])


def _shared_windows(s: Sequences, packed: list[bytes], shared: dict[int, bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Under each function, the windows of a block whose centres other documents have too."""
    out = []
    for f in range(len(SEEDS)):
        lo, centre, hi = _windows(packed, f)
        keys, at = np.unique(s.seq[centre], return_inverse=True)
        on = np.zeros(len(keys), bool)
        for bucket, p in _bucketed(keys, buckets, f * buckets):
            on[p] = np.unpackbits(np.frombuffer(zstandard.decompress(shared[bucket]), np.uint8), count=len(p))
        on = on[at]
        out.append((lo[on], centre[on], hi[on]))
    return out


def _shared_runs(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, t: int) -> np.ndarray:
    """Of n places, those that begin a run of T whose centre is shared under every function: a run that two documents have shares
    all its centres."""
    on = np.ones(n, bool)
    for lo, centre, hi in windows:
        first, last = np.maximum(lo, centre - t + 1), np.minimum(centre, hi - t + 1)
        on &= np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1))[:n] > 0
    return np.flatnonzero(on)


def _ask_runs(t: int, buckets: int):
    """For the windows with shared centres: fingerprints of their runs, and what stands around their centres."""
    names = ["bucket", "block", "keys", "docs", "firsts", "owners", "contexts", "centres"]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("shared").to_pylist(), strict=True))
        rows = []
        for b in left.to_pylist():
            s = Sequences(_texts(b["sizes"], b["texts"]), WordHashes(), t)
            ids = np.array([-1 if x is None else x for x in b["ids"]], np.int64)[np.array(s.docs, np.int64)] if s.docs else np.zeros(0, np.int64)
            windows = _shared_windows(s, b["windows"], answers, buckets)
            runs_of = _shared_runs(windows, len(s.seq), t)
            for f, (_, centre, _) in enumerate(windows):
                key = s.seq[centre]
                for bucket, p in _bucketed(key, buckets, (1 + f) * buckets):
                    rows.append((bucket, b["block"], key[p].tobytes(), squeeze(s.owner[centre[p]]), None, squeeze(ids[s.owner[centre[p]]]), zstandard.compress(s.context(centre[p]).tobytes(), 1), squeeze(centre[p])))
            if len(runs_of):
                prints, owner = s.fingerprints()[runs_of], s.owner[runs_of]
                keys, docs, at = _distinct(prints, owner)
                first = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(first, at, ids[owner])
                rows += [(bucket, b["block"], squeeze_sorted(keys[p]), squeeze(docs[p]), squeeze(first[p]), None, None, None) for bucket, p in _bucketed(keys, buckets, 0)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return run


def _shingles(contexts: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of contexts, one context a row; 0 outside the text."""
    n = contexts.shape[1] - WIDTH + 1
    out, inside = np.zeros((len(contexts), n), np.uint64), np.ones((len(contexts), n), bool)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + contexts[:, k : k + n])
            inside &= contexts[:, k : k + n] > 0
    return np.where(inside, np.maximum(out, 1), 0)


def _repeating(shingles: np.ndarray) -> np.ndarray:
    """Whether a row holds a shingle twice; 0 does not count."""
    x = np.sort(shingles, axis=1)
    return ((x[:, 1:] == x[:, :-1]) & (x[:, 1:] > 0)).any(axis=1)


def _kept_runs(ok: np.ndarray, score: np.ndarray, held: np.ndarray, t: int) -> np.ndarray:
    """Of the runs that are similar enough, by start, those within the first and last shingle that the other text has too; the best, if none is."""
    n, at = ok.shape[1], np.arange(ok.shape[1])
    lowest, highest = ok.argmax(1), n - 1 - ok[:, ::-1].argmax(1)
    places = np.arange(held.shape[1])
    inside = held & (places >= lowest[:, None]) & (places <= highest[:, None] + t - 1)
    first, last = inside.argmax(1), held.shape[1] - 1 - inside[:, ::-1].argmax(1)
    kept = ok & (at >= first[:, None]) & (at <= last[:, None] - t + 1)
    none = np.flatnonzero(ok.any(1) & ~kept.any(1))
    kept[none, score[none].argmax(1)] = True
    return kept


def _all_in_runs(on: np.ndarray, t: int) -> np.ndarray:
    """For each run of t places of each row, whether all are on."""
    off = np.cumsum(np.pad(~on, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    return off[:, t:] == off[:, :-t]


def _held_in_runs(held: np.ndarray, t: int) -> np.ndarray:
    """For each run of t places of each row, how many are on."""
    sums = np.zeros((len(held), held.shape[1] + 1), np.min_scalar_type(t))  # differences of sums hold where these wrap
    np.cumsum(held, axis=1, dtype=sums.dtype, out=sums[:, 1:])
    return sums[:, t:] - sums[:, :-t]


def _run_sets(at: np.ndarray, size: int, t: int) -> np.ndarray:
    """For rows of shingle numbers below `size`, which numbers each run of t holds."""
    marks = np.zeros((len(at), at.shape[1] + 1, size), np.uint8)
    marks[np.arange(len(at))[:, None], np.arange(at.shape[1])[None, :] + 1, at] = 1
    np.cumsum(marks, axis=1, dtype=np.uint8, out=marks)
    return (marks[:, t:] != marks[:, :-t]).astype(np.float32)


def _similar_sets(x: np.ndarray, y: np.ndarray, t: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What _similar gives, for pairs of contexts in which shingles may occur more than once."""
    both = np.concatenate([x, y], axis=1)
    order = np.argsort(both, axis=1)
    ordered = np.take_along_axis(both, order, 1)
    at = np.empty_like(order)  # numbers within the pair, in the order of the shingles
    np.put_along_axis(at, order, np.cumsum(np.pad(ordered[:, 1:] != ordered[:, :-1], ((0, 0), (1, 0))), axis=1), 1)
    size, m = int(at.max()) + 1, x.shape[1]
    of_x, of_y = _run_sets(at[:, :m], size, t), _run_sets(at[:, m:], size, t)
    whole_x, whole_y = (_all_in_runs(v > 0, t) for v in (x, y))
    common = of_x @ of_y.transpose(0, 2, 1)
    union = of_x.sum(2)[:, :, None] + of_y.sum(2)[:, None, :] - common
    ok = (100 * common >= percent * union) & whole_x[:, :, None] & whole_y[:, None, :]
    score = np.where(ok, common / union, 0)
    held = np.zeros((2, len(x), size), bool)
    held[0, np.arange(len(x))[:, None], at[:, :m]] = True
    held[1, np.arange(len(x))[:, None], at[:, m:]] = True
    held_x, held_y = (x > 0) & np.take_along_axis(held[1], at[:, :m], 1), (y > 0) & np.take_along_axis(held[0], at[:, m:], 1)
    return _kept_runs(ok.any(2), score.max(2), held_x, t), _kept_runs(ok.any(1), score.max(1), held_y, t)


def _similar(x: np.ndarray, y: np.ndarray, t: int, percent: int, repeating: np.ndarray | None = None, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of contexts, one pair a row: which runs of T shingles of x, by start, have a run of y whose set of shingles is
    `percent` similar by Jaccard, and which of y have one of x, without foreign shingles at the ends. `repeating` names the pairs
    in which a context may hold a shingle twice, if that is known. `wanted`: pairs of none of whose runs named here (of x, and of y)
    the other context has shingles enough need no answer."""
    n, m = len(x), x.shape[1]
    starts = m - t + 1
    out = np.zeros((n, starts), bool), np.zeros((n, starts), bool)
    slow = np.flatnonzero(_repeating(x) | _repeating(y) if repeating is None else repeating)
    for k in range(0, len(slow), 64):
        rows = slow[k : k + 64]
        out[0][rows], out[1][rows] = _similar_sets(x[rows], y[rows], t, percent)
    fast = np.ones(n, bool)
    fast[slow] = False
    need = -(-2 * percent * t // (100 + percent))
    fast = np.flatnonzero(fast)
    place, held_x = _meetings(x[fast], y[fast])
    none = np.iinfo(place.dtype).max
    held_y, level = place != none, place == np.arange(m, dtype=place.dtype)
    total = np.count_nonzero(held_y, axis=1)
    real = total >= need
    if wanted is not None:
        open_x, open_y = ((_held_in_runs(held, t) >= need) & on[fast] for held, on in ((held_x, wanted[0]), (held_y, wanted[1])))
        real &= open_x.any(1) | open_y.any(1)
    # Where all that two contexts share stands at the same places, the best partner of a run is the one nearest to its place.
    straight = (np.count_nonzero(level, axis=1) == total) & real
    rows, even = fast[straight], level[straight]
    if len(rows):
        sums = np.zeros((len(rows), m + 1), np.int32)
        np.cumsum(even, axis=1, out=sums[:, 1:])
        at = np.arange(starts)[None, :]
        wholes = [_all_in_runs(v[rows] > 0, t) for v in (x, y)]
        for side, (own, other) in enumerate((wholes, wholes[::-1])):
            first, last = other.argmax(1)[:, None], starts - 1 - other[:, ::-1].argmax(1)[:, None]
            partner = np.clip(at, first, last)
            low, high = np.maximum(at, partner), np.minimum(at, partner) + t
            best = np.where(own & other.any(1)[:, None], np.take_along_axis(sums, high, 1) - np.take_along_axis(sums, low, 1), 0)
            out[side][rows] = _kept_runs(best >= need, best, even, t)
    other = np.flatnonzero(~straight & real)
    for s in range(0, len(other), 256):
        some = other[s : s + 256]
        rows = fast[some]
        best = _best_common(np.ascontiguousarray(place[some].T), *(_all_in_runs(v[rows] > 0, t).T for v in (x, y)), t)
        for side, held in enumerate((held_x, held_y)):
            out[side][rows] = _kept_runs(best[side].T >= need, best[side].T, held[some], t)
    return out


def _meetings(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of which neither holds a value twice that the other has: at which place of x the value of each place of y
    stands, the largest number if it does not, and which values of x are in y. 0 agrees with nothing."""
    n, m = x.shape
    both = np.concatenate([x, y], axis=1)
    if (wide := (2 * m).bit_length()) + int(both.max(initial=0)).bit_length() > 63:
        both = np.unique(both, return_inverse=True)[1].reshape(both.shape) + int(both.min(initial=1) > 0)
    both = both.astype(np.int32 if wide + int(both.max(initial=0)).bit_length() < 32 else np.int64)
    both <<= wide
    both |= np.arange(2 * m, dtype=both.dtype)
    both.sort(axis=1)
    both, mask = both.ravel(), (1 << wide) - 1
    at = np.flatnonzero((both[1:] ^ both[:-1] <= mask) & (both[1:] > mask))
    first, second = both[at] & mask, both[at + 1] & mask
    real = np.flatnonzero((first < m) & (second >= m) & ((at + 1) % (2 * m) > 0))
    row, first, second = at[real] // (2 * m) * m, first[real], second[real] - m
    place, held = ~np.zeros(n * m, np.min_scalar_type(m)), np.zeros(n * m, bool)
    place[row + second] = first
    held[row + first] = True
    return place.reshape(n, m), held.reshape(n, m)


def _best_common(place: np.ndarray, whole_x: np.ndarray, whole_y: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs, one a column, how many values each run of t of x shares with the best of y, by start, and each of y with the best
    of x. `place` tells where in x the values of y stand; only runs that are whole count."""
    m, n = place.shape
    starts, full = m - t + 1, np.iinfo(place.dtype).max
    # Whether the value of a place of y is in a run of x: the place less the run's start, which wraps below 0, is less than t.
    inside = (place[:, None] - np.arange(starts, dtype=place.dtype)[None, :, None] < t).view(np.uint8)
    common = np.empty((starts, starts, n), place.dtype)  # of runs of y with runs of x
    np.sum(inside[:t], axis=0, dtype=place.dtype, out=common[0])
    for j in range(1, starts):
        np.add(common[j - 1], inside[j + t - 1], out=common[j])
        common[j] -= inside[j - 1]
    common &= np.where(whole_x, full, 0).astype(place.dtype)
    common &= np.where(whole_y, full, 0).astype(place.dtype)[:, None]
    return np.maximum.reduce(common, axis=0), np.maximum.reduce(common, axis=1)


def _prints(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of each row and of its key."""
    each = 8 // rows.dtype.itemsize
    lanes, prints = np.pad(rows, ((0, 0), (0, -rows.shape[1] % each))).view(np.uint64), mix(keys)
    with np.errstate(over="ignore"):
        for k in range(lanes.shape[1]):
            prints = mix(prints + lanes[:, k])
    return prints


def _labels(keys: np.ndarray, docs: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as numbers from 3 on, 0 outside the text; the same with 1 for those that no other document's window of the centre
    has, as they agree with nothing; for each window a hash of these and of its centre; and which shingles other documents have.
    Rows that hold a shingle twice keep all."""
    of_centre = pa.array(np.where(shingles > 0, mix(shingles ^ mix(keys)[:, None]), 0).ravel())
    at = np.asarray(of_centre.dictionary_encode().indices).reshape(shingles.shape)
    lowest, highest = np.full(int(at.max(initial=0)) + 1, np.iinfo(np.int64).max), np.full(int(at.max(initial=0)) + 1, -1)
    of = np.repeat(docs, shingles.shape[1])
    np.minimum.at(lowest, at.ravel(), of)
    np.maximum.at(highest, at.ravel(), of)
    common = (shingles > 0) & (lowest < highest)[at]
    numbers = np.where(shingles == 0, 0, at + 3).astype(np.int32)
    shared = np.where((numbers > 0) & ~common & ~_repeating(shingles)[:, None], 1, numbers)
    return numbers, shared, _prints(keys, shared), common


def _run_kinds(numbers: np.ndarray, common: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of t numbers of each row, a hash of the set of its numbers, how many different ones it holds that are not 0,
    and how many of these are common."""
    order = np.argsort(numbers, axis=1, kind="stable")
    ordered = np.take_along_axis(numbers, order, 1)
    before = np.pad(np.where(ordered[:, 1:] == ordered[:, :-1], order[:, :-1], -1), ((0, 0), (1, 0)), constant_values=-1).astype(np.int16)
    last = np.empty_like(before)  # the place before at which the same number stands
    np.put_along_axis(last, order, before, 1)
    places, values, real, shared = (np.lib.stride_tricks.sliding_window_view(v, t, axis=1) for v in (last, mix(numbers.astype(np.uint64)), numbers > 0, common))
    first = places < np.arange(places.shape[1])[None, :, None]
    prints = np.where(first, values, np.uint64(0)).sum(2, dtype=np.uint64)
    return prints, np.count_nonzero(first & real, axis=2), np.count_nonzero(first & shared, axis=2)


def _signatures(labels: np.ndarray) -> np.ndarray:
    """A bitmap of 256 bits for each row, of its labels from 2 on."""
    bits = np.zeros((len(labels), 256), bool)
    row, at = np.nonzero(labels > 1)
    bits[row, (mix(labels[row, at].astype(np.uint64)) >> np.uint64(56)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _pairs(sizes: np.ndarray, most: int = 20_000):
    """All pairs (also of one with itself) within groups of neighbouring rows, a bounded number at a time."""
    starts = np.cumsum(sizes) - sizes
    last = np.repeat(starts + sizes, sizes)
    for first in _chunks(last - np.arange(len(last)), most):
        each = last[first] - first
        for lo in range(0, int(each.max()), most):  # one row with very many partners is dealt in parts
            count = np.clip(each - lo, 0, most)
            a = np.repeat(first, count)
            yield a, a + lo + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)


def _chunks(weights: np.ndarray, most: int):
    """Places in order, in parts whose weights add up to about `most`."""
    part = (np.cumsum(weights) - weights) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from np.split(np.arange(len(weights)), cuts) if len(weights) else []


def _first_similar(seek, others, best, sets, bits, kinds, lowest, highest, ids, percent: int) -> None:
    """For each of the sets `seek`, into `best` where it is less: the least id of those of `others` (ascending by id) that are similar
    and that another document has."""
    for block in np.split(others, range(1024, len(others), 1024)):
        seek = seek[best[seek] > ids[block[:1]]] if len(block) else seek[:0]
        for part in np.split(seek, range(256, len(seek), 256)) if len(seek) else []:
            x, y = bits[part][:, None], bits[block][None]
            most = np.minimum(kinds[part][:, None] - np.bitwise_count(x & ~y).sum(2), kinds[block][None] - np.bitwise_count(y & ~x).sum(2))
            ok = (100 + percent) * most >= percent * (kinds[part][:, None] + kinds[block][None])
            single = (lowest[part] == highest[part])[:, None] & (lowest[block] == highest[block])[None]
            ok &= ~(single & (lowest[part][:, None] == lowest[block][None])) & (part[:, None] != block[None])
            i, j = np.nonzero(ok)
            for s in range(0, len(i), 2048):
                p, q = part[i[s : s + 2048]], block[j[s : s + 2048]]
                common = ((sets[p][:, :, None] == sets[q][:, None, :]).any(2) & (sets[p] > 0)).sum(1)
                hit = (100 + percent) * common >= percent * (kinds[p] + kinds[q])
                np.minimum.at(best, p[hit], ids[q[hit]])


def _near_by_sets(numbers, common, inside, repeating, centres, one, last, least, t: int, percent: int) -> np.ndarray:
    """What is found for classes of centres some of whose classes hold a shingle twice, by the distinct sets of their runs.

    A stretch that repeats itself gives many windows and few sets. Each set is compared with all others of the centre that have
    a smaller id than is known already, as of a document that has the same set; but for two of classes without repeats, which
    `_near` compares.
    """
    never = np.iinfo(np.int64).max
    found = np.full((len(numbers), t), never)
    _, group = np.unique(centres, return_inverse=True)
    rows = np.flatnonzero(np.bincount(group, weights=repeating)[group] > 0) if len(group) else np.zeros(0, np.int64)
    parts = []
    for part in np.split(rows, range(256, len(rows), 256)):
        prints, kinds, shared = _run_kinds(numbers[part], common[part], t)
        row, run = np.nonzero(inside[part] & (100 * shared >= percent * kinds))
        prints = mix(prints ^ mix(centres[part])[:, None])
        parts.append((part[row], run, prints[row, run], kinds[row, run], shared[row, run]))
    if not len(rows) or not any(len(x[0]) for x in parts):
        return found
    of, run, prints, kinds, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
    prints, sample, at = np.unique(prints, return_index=True, return_inverse=True)
    kinds, group = kinds[sample], group[of[sample]]
    # A class without repeats stands for windows that may differ in shingles that nobody else has, so that its sets are the same
    # in all its documents only without these.
    same = np.flatnonzero(repeating[of] | (shared == kinds[at]))
    lowest, highest, ids, lowest_same, highest_same, ids_same = (np.full(len(prints), v) for v in (never, -1, never) * 2)
    for low, high, id_of, p in ((lowest, highest, ids, np.arange(len(of))), (lowest_same, highest_same, ids_same, same)):
        np.minimum.at(low, at[p], one[of[p]])
        np.maximum.at(high, at[p], last[of[p]])
        np.minimum.at(id_of, at[p], least[of[p]])
    matched, twice = lowest_same < highest_same, np.bincount(at, weights=repeating[of]) > 0
    best = np.where(matched, ids_same, never)
    sets = np.sort(numbers[of[sample][:, None], run[sample][:, None] + np.arange(t)[None, :]], axis=1)
    sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = -1
    bits = np.concatenate([_signatures(x) for x in np.split(sets, range(4096, len(sets), 4096))])
    order = np.lexsort((ids, group))
    for g in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        for seek, others in ((g[twice[g]], g), (g[~twice[g]], g[twice[g]])):
            _first_similar(seek, others, best, sets, bits, kinds, lowest, highest, ids, percent)
    score = np.zeros(found.shape, np.int8)
    found[of, run] = best[at]
    score[of, run] = np.where(best[at] == never, 0, np.where(matched[at], 2, 1))
    kept = _kept_runs(score[rows] > 0, score[rows], common[rows], t)
    found[rows] = np.where(kept, found[rows], never)
    return found


def _near(keys, ids, docs, contexts, t: int, percent: int):
    """For windows, by the start of the run, the first id of the documents that have a similar run there, or none.

    Windows whose surroundings agree, but for shingles that no other window of the centre has, are one; all pairs of these are
    tried that have shingles enough in common. Where windows hold a shingle twice, the sets of their runs are compared instead."""
    never, need = np.iinfo(np.int64).max, -(-2 * percent * t // (100 + percent))
    shingles = _shingles(contexts)
    numbers, labels, prints, common = _labels(keys, docs, shingles)
    # Classes of a centre stand in the order of their least ids, so that the first partner found for a run has the least id.
    _, at = np.unique(mix(prints ^ mix(keys)), return_inverse=True)
    lowest = np.full(int(at.max(initial=-1)) + 1, never)
    np.minimum.at(lowest, at, ids)
    order = np.lexsort((docs, prints, lowest[at], keys))
    new = np.flatnonzero(np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(prints[order]) != 0)])
    kind = np.empty(len(keys), np.int64)  # for each window, its class
    kind[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
    least, one, last = np.minimum.reduceat(ids[order], new), docs[order[new]], docs[order[np.r_[new[1:], len(order)] - 1]]
    numbers, labels, common = numbers[order[new]], labels[order[new]], common[order[new]]
    repeating, centres = _repeating(shingles[order[new]]), keys[order[new]]
    inside = _all_in_runs(labels > 0, t)
    found = _near_by_sets(numbers, common, inside, repeating, centres, one, last, least, t, percent)
    # Runs with too many shingles that nobody has need no partner; a class all of whose other runs have one is done.
    held = np.cumsum(np.pad(labels > 1, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    possible = inside & (held[:, t:] - held[:, :-t] >= need)
    done = ~(possible & (found == never)).any(1)
    able = np.flatnonzero((held[:, -1] >= need) & ~repeating)
    bits = _signatures(labels[able])
    cuts = np.flatnonzero(np.r_[True, np.diff(centres[able]) != 0]) if len(able) else np.zeros(0, np.int64)
    for i, j in _pairs(np.diff(np.r_[cuts, len(able)])):
        on = ~(done[able[i]] & done[able[j]])
        i, j = i[on], j[on]
        a, b = able[i], able[j]
        # Each shingle of one side whose bit the other lacks is foreign.
        ok = held[a, -1] - np.bitwise_count(bits[i] & ~bits[j]).sum(1) >= need
        ok &= np.where(a == b, one[a] != last[a], (one[a] != last[a]) | (one[b] != last[b]) | (one[a] != one[b]))
        a, b = a[ok], b[ok]
        for s in range(0, len(a), 1024):
            p, q = a[s : s + 1024], b[s : s + 1024]
            on = ~(done[p] & done[q])
            p, q = p[on], q[on]
            if not len(p):
                continue
            x, y = labels[p], labels[q] + (labels[q] == 1)  # 1 and 2 agree with nothing
            wanted = [possible[to] & (found[to] > least[of][:, None]) for to, of in ((p, q), (q, p))]
            for to, of, hit in zip((p, q), (q, p), _similar(x, y, t, percent, np.zeros(len(p), bool), wanted), strict=True):
                some = np.flatnonzero(hit.any(1))
                np.minimum.at(found, to[some], np.where(hit[some], least[of[some]][:, None], never))
            seen = np.unique(np.concatenate([p, q]))
            done[seen] |= ~(possible[seen] & (found[seen] == never)).any(1)
    first = found[kind]
    return np.where(first < never, np.minimum(first, ids[:, None]), never)


def _near_by_centre(keys, ids, docs, contexts, t: int, percent: int):
    """What _near gives, some centres at a time and equal surroundings of a centre once, so that a task's memory follows the
    largest number of different surroundings that a centre has."""
    never = np.iinfo(np.int64).max
    if not len(keys):
        return np.full((0, t), never)
    prints = _prints(keys, contexts)
    # Of equal ones three stand for all: those with the least id, the first document and the last one.
    order = np.lexsort((ids, prints, keys))
    new = np.flatnonzero(np.r_[True, (np.diff(prints[order]) != 0) | (np.diff(keys[order]) != 0)])
    kind = np.empty(len(keys), np.int64)
    kind[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
    by_doc = np.lexsort((docs, kind))
    last = np.r_[new[1:], len(order)] - 1
    # Where all surroundings of a centre are equal, each whole run is found in all documents that have them.
    alone = keys[order[new]]
    alone = np.diff(alone, prepend=~alone[:1]) != 0
    alone &= np.r_[alone[1:], True]
    found = np.full((len(new), t), never)
    several = np.flatnonzero(alone & (docs[by_doc[new]] != docs[by_doc[last]]))
    for part in np.split(several, range(4096, len(several), 4096)):
        found[part] = np.where(_all_in_runs(contexts[order[new[part]]] > 0, t + WIDTH - 1), ids[order[new[part]]][:, None], never)
    kept = np.unique(np.concatenate([order[new], by_doc[new], by_doc[last]]))
    kept = kept[~alone[kind[kept]]]
    kept = kept[np.argsort(keys[kept], kind="stable")]
    _, sizes = np.unique(keys[kept], return_counts=True)
    ends = np.cumsum(sizes)
    for part in _chunks(sizes, WINDOWS):
        rows = kept[ends[part[0]] - sizes[part[0]] : ends[part[-1]]]
        np.minimum.at(found, kind[rows], _near(keys[rows], ids[rows], docs[rows], contexts[rows], t, percent))
    first = found[kind]
    return np.where(first < never, np.minimum(first, ids[:, None]), never)


def _packed(first: np.ndarray, centres: np.ndarray, t: int) -> tuple[bytes, bytes, bytes]:
    """Starts of runs as stretches of neighbouring places with one first id: place, length, first id."""
    window, start = np.nonzero(first < np.iinfo(np.int64).max)
    place, found = centres[window] + start - (t - 1), first[window, start]
    new = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(found) != 0)]) if len(place) else np.zeros(0, np.int64)
    return squeeze(place[new]), squeeze(np.diff(np.r_[new, len(place)])), squeeze(found[new])


def _answer_runs(t: int, buckets: int, percent: int):
    """Runs that several documents have, with the first of them: for fingerprints by place in the asking order, for centres by centre."""

    def run(batches):
        for g in runs(batches, "bucket"):
            bucket, blocks = g.column("bucket")[0].as_py(), g.column("block").to_pylist()
            out = []
            if bucket < buckets:
                asked = [unsqueeze_sorted(x.as_py()) for x in g.column("keys")]
                keys, at = np.unique(np.concatenate(asked), return_inverse=True)
                docs = np.bincount(at, weights=np.concatenate([unsqueeze(x.as_py(), np.int64) for x in g.column("docs")]))
                first = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(first, at, np.concatenate([unsqueeze(x.as_py(), np.int64) for x in g.column("firsts")]))
                start = 0
                for block, sent in zip(blocks, asked, strict=True):
                    p = at[start : start + len(sent)]
                    start += len(sent)
                    hit = np.flatnonzero(docs[p] > 1)
                    out.append((block, bucket, squeeze(hit), squeeze(first[p[hit]]), None))
            else:
                keys = [np.frombuffer(x.as_py(), np.uint64) for x in g.column("keys")]
                ids = np.concatenate([unsqueeze(x.as_py(), np.int64) for x in g.column("owners")])
                docs = np.concatenate([unsqueeze(x.as_py(), np.int64) + (k << 32) for k, x in enumerate(g.column("docs"))])
                contexts = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint16).reshape(-1, 2 * t + WIDTH - 2) for x in g.column("contexts")])
                first = _near_by_centre(np.concatenate(keys), ids, docs, contexts, t, percent)
                start = 0
                for block, sent, centres in zip(blocks, keys, g.column("centres").to_pylist(), strict=True):
                    places, lengths, firsts = _packed(first[start : start + len(sent)], unsqueeze(centres, np.int64), t)
                    start += len(sent)
                    out.append((block, bucket, places, firsts, lengths))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "places", "firsts", "lengths"])

    return run


SPAN = "struct<start:int,end:int,first_id:long,exact:boolean>"


def without(text: bytes, spans: list[dict], own: int) -> bytes:
    """The text without the spans that an earlier document has, each cut from its first word to the word after it."""
    gone = [x for x in spans if x["first_id"] != own]
    if not gone:
        return text
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    parts, at = [], 0
    for x in sorted(gone, key=lambda x: x["start"]):
        if starts[x["start"]] > at:
            parts.append(text[at : starts[x["start"]]])
        at = max(at, starts[x["end"]])
    return b"".join([*parts, text[at:]]).strip()


def _spans(t: int, buckets: int, cut: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {b: x for b, *x in zip(*[right.column(c).to_pylist() for c in ("bucket", "places", "firsts", "lengths")], strict=True)}
        ids, rest, n_words, spans, texts = [], [], [], [], []
        for b in left.to_pylist():
            body = _texts(b["sizes"], b["texts"])
            s = Sequences(body, WordHashes(), t)
            n = len(s.seq)
            exact = np.full(n, np.iinfo(np.int64).max)  # for each place that begins a repeated run, the first id that has it
            near = exact.copy()
            if any(k < buckets for k in answers):
                shared = s.fingerprints()
                places = _shared_runs(_shared_windows(s, b["windows"], {x["bucket"]: x["shared"] for x in b["shared"]}, buckets), n, t)
                keys, at = np.unique(shared[places], return_inverse=True)
                best = np.full(len(keys), np.iinfo(np.int64).max)
                for bucket, p in _bucketed(keys, buckets, 0):
                    hit, firsts, _ = answers[bucket]
                    best[p[unsqueeze(hit, np.int64)]] = unsqueeze(firsts, np.int64)
                exact[places] = best[at]
            for bucket, (hit, firsts, lengths) in answers.items():
                if bucket >= buckets:
                    hit, lengths = unsqueeze(hit, np.int64), unsqueeze(lengths, np.int64)
                    each = np.repeat(hit - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                    np.minimum.at(near, each, np.repeat(unsqueeze(firsts, np.int64), lengths))
            found: list[list] = [[] for _ in b["ids"]]
            starts = np.flatnonzero(np.minimum(exact, near) < np.iinfo(np.int64).max)
            if len(starts):
                owner, first, is_exact = s.owner[starts], np.minimum(exact, near)[starts], exact[starts] < np.iinfo(np.int64).max
                word = starts - s.begins[owner]
                # Runs that meet the one before them belong to its span, if they have the same first id and are as exact.
                new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(first) != 0) | (np.diff(is_exact) != 0) | (np.diff(word) > t + WIDTH - 1)])
                to = word[np.r_[new[1:], len(starts)] - 1] + t + WIDTH - 1
                for d, *span in zip(owner[new].tolist(), word[new].tolist(), to.tolist(), first[new].tolist(), is_exact[new].tolist(), strict=True):
                    found[s.docs[d]].append(dict(zip(("start", "end", "first_id", "exact"), span, strict=True)))
            ids += b["ids"]
            rest += b["rest"]
            n_words += s.words
            spans += found
            texts += [without(x, f, -1 if i is None else i).decode() if cut else None for x, f, i in zip(body, found, b["ids"], strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_id", pa.int64()), ("exact", pa.bool_())]))
        columns = ((ids, pa.int64()), (rest, pa.string()), (n_words, pa.int64()), (spans, kind), (texts, pa.string()))
        return pa.table([pa.array(v, k) for v, k in columns], names=["id", "rest", "n_words", "spans", "text"])

    return run


#: How columns that only pass through are written and read again, so that they come back as they were.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 50, percent: int = 75, cut: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, spans; with `cut`, the columns of docs, the text without passages that an
    earlier document has, and n_words and spans, which tell of the text before that.

    A span is a stretch of words [start, end) of at least `least` words that another document has too: word for word (exact), or
    with a run of `least` words whose sets of shingles are at least `percent` similar by Jaccard; every such run belongs to it,
    without shingles at the ends that the other document does not have if a run is left. first_id is the smallest id among the
    documents found to have it, the document itself included. Words are runs without ASCII white space, A-Z lower-cased. Spans
    with different first ids may overlap. Exact repeats are all found; near ones with the likelihood that min-hashes give.
    Null texts count as empty; texts of fewer words have no spans. Texts are compared whole, whatever their length. Rows with null
    ids take part as id -1; rows with equal ids are documents apart. With `cut`, columns n_words and spans of docs give way to the
    operator's, all others come back as they were. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    t, buckets = least - WIDTH + 1, partitions(spark)
    if t < 2:
        raise ValueError(f"passages need at least {WIDTH + 1} words")
    others = [c for c in docs.columns if c not in (id, text, "n_words", "spans")] if cut else []
    rest = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]), _EXACT) if others else F.lit(None).cast("string")
    rows = docs.select(F.col(id).cast("long").alias("id"), rest.alias("rest"), whole(text).alias("text"))
    blobs = materialise(rows.mapInArrow(_blobs(t, buckets), BLOB), "passages-texts")
    centres = blobs.select("block", F.explode("asks").alias("ask")).select("block", "ask.*")
    shared = materialise(centres.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_centres, "block long, bucket int, shared binary"), "passages-centres")
    del centres
    release(spark)
    asking = blobs.select("block", "ids", "sizes", "texts", "windows")
    asked = asking.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_ask_runs(t, buckets), "bucket int, block long, keys binary, docs binary, firsts binary, owners binary, contexts binary, centres binary")
    answers = asked.repartition(3 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_runs(t, buckets, percent), "block long, bucket int, places binary, firsts binary, lengths binary")
    answers = materialise(answers, "passages-answers")
    del asking, asked
    release(spark)  # what was asked was shuffled, and nothing reads it again
    of_block = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared")).alias("shared"))
    with_shared = blobs.drop("asks").join(of_block, "block", "left")
    found = with_shared.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_spans(t, buckets, cut), f"id long, rest string, n_words long, spans array<{SPAN}>, text string")
    if not cut:
        return found.select(F.col("id").alias(id), "n_words", "spans")
    if others:
        fields = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(others)])
        found = found.withColumn("rest", F.from_json("rest", fields, _EXACT))
    kept = {id: F.col("id").cast(docs.schema[id].dataType), text: F.col("text")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    return found.select(*[kept[c].alias(c) for c in docs.columns if c in kept], "n_words", "spans")
