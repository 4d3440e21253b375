"""Problem 2: same or near-same records across splits, by a compressed full-text index of the evaluation texts.

The evaluation texts are cut into shards of bounded size; a shard holds FM-indexes (Burrows-Wheeler transform with per-symbol
rank bitmaps and a document array), one for each class of text sizes in it. Index and training rows meet in one job, keyed by
shard and slice: a task reads the index row first and streams the training texts of the slice through backward search.

Candidates are exact. A text of `a` different 4-character runs that is similar to one of `b` lacks at most
m = a - t (a + b) / (1 + t) of its runs there, so of any m + 1 windows that share no run at least one is found whole. Windows
of up to WINDOW runs are laid over the training text, the m + 1 rarest by the widths of their intervals are expanded, and a
bound on the runs not shared (by 256-bit maps) drops most pairs before the exact comparison, whose maximal matches are merged
and counted. A window's runs may lie apart in the other text; the windows that could be put together from a text's runs but
don't stand in it are indexed beside it (texts that repeat so much that these would be many are searched by single runs).

Texts are worked on by a hash of their reduced form, so copies are searched once. No interval is cut off, however frequent.

Defined results: null texts and texts under MIN_CHARS characters in reduced form have no similarity; repeated rows count once;
without evaluation or training pairs the results are empty.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.minhash import RUN, _mix, hashed, runs
from corvane.llm.splits import effective_splits
from corvane.session import ship, stage, table

#: Runs of a window at most, and characters the suffixes are ordered by (a window's characters at least).
WINDOW, DEPTH = 3, 8
#: Sizes of texts in one index differ by this factor at most, or else more windows would have to be searched.
CLASS = 1.2
#: Characters of a shard; an index takes about 15 bytes a character where 70 symbols are in use.
SHARD_CHARS = 2_000_000
#: Training texts that one copy of an index serves, about.
SLICE = 50_000
#: Put-together windows of a text beyond this many a run: it is searched by single runs.
DENSE = 4
#: Characters of training texts that are searched together, about.
BATCH_CHARS = 1_500_000
#: Windows that are searched beyond the miss + 1 needed; as many hits more a candidate must have.
SPARE = 3
#: Hits, and counters of hits, that are held at once.
EXPAND = 2_000_000


class Runs:
    """The different runs of a list of texts, and bounds on what two texts share."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        h, offsets = runs(texts)
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(texts)), n)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        self.first = np.zeros(len(h), bool)
        self.first[order[new]] = True  # the sort is stable, so this is a run's first place
        self.row, self.hash, self.offsets = row, h, offsets
        self.place = np.arange(len(h)) - offsets[row] if len(h) else np.zeros(0, np.int64)
        self.size = np.bincount(row[self.first], minlength=len(texts)).astype(np.int64)
        self.bits = np.zeros((4, len(texts)), np.uint64)
        low = (h >> np.uint64(56)).astype(np.int64)
        np.bitwise_or.at(self.bits, (low >> 6, row), np.uint64(1) << (low & 63).astype(np.uint64))
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letters, self.spelling = np.unique(self.chars, return_inverse=True)
        self.windows_: dict[int, tuple] = {}
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)


    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """(row, name, groups): windows that share no run, stretches of first places cut every `width` places; a group holds
        the different ones of a length, spelled by places in `letters`, and their keys in order; `name` counts through the groups."""
        if width not in self.windows_:
            at = np.flatnonzero(self.first)
            row = self.row[at]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            head = np.flatnonzero(inside % width == 0)
            held = np.diff(np.append(head, len(at)))
            row, place = row[head], (self.begin[row] + self.place[at])[head]
            name, groups, base = np.zeros(len(head), np.int64), [], 0
            for w in np.unique(held):
                some, n = np.flatnonzero(held == w), int(w) + RUN - 1
                key, one, back = np.unique(window_key(self.chars, place[some], n), return_index=True, return_inverse=True)
                name[some] = back + base
                base += len(key)
                groups.append((self.spelling[place[some][one][:, None] + np.arange(n)], key))
            self.windows_[width] = row, name, groups
        return self.windows_[width]


def least_shared(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """How many runs two sets of a and b runs share at least if their similarity is t."""
    return np.ceil(t * (a + b) / (1 + t) - 1e-9).astype(np.int64)


def common(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarity, maximal matches, characters of the longest one) of texts, one by one; a maximal match is a stretch of the left text whose runs the right one holds."""
    if not left:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = Runs(left), Runs(right)
    key = lambda r: _mix(r.hash ^ _mix(r.row.astype(np.uint64) + np.uint64(1)))
    kx, ky = key(x), np.sort(key(y)[y.first])
    at = np.minimum(np.searchsorted(ky, kx), max(len(ky) - 1, 0))
    held = ky[at] == kx if len(ky) else np.zeros(len(kx), bool)
    both = np.bincount(x.row[held & x.first], minlength=len(left))
    begins = held.copy()
    begins[1:] &= ~(held[:-1] & (x.row[1:] == x.row[:-1]))
    place = np.flatnonzero(held)
    starts = np.flatnonzero(begins)
    length = np.diff(np.append(np.searchsorted(place, starts), len(place))) + RUN - 1
    longest = np.zeros(len(left), np.int64)
    np.maximum.at(longest, x.row[starts], length)
    return both / np.maximum(x.size + y.size - both, 1), np.bincount(x.row[starts], minlength=len(left)), longest


def put_together(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, characters, dense rows): windows of 2 and 3 runs that fit together but don't stand in the text, padded with 0,
    and which texts have too many of them."""
    at = np.flatnonzero(r.first)
    doc = r.row[at].astype(np.uint64)
    four = r.chars[(r.begin[r.row[at]] + r.place[at])[:, None] + np.arange(RUN)].astype(np.uint64) if len(at) else np.zeros((0, RUN), np.uint64)

    def key(d: np.ndarray, columns: np.ndarray) -> np.ndarray:
        k = _mix(d + np.uint64(1))
        for c in columns.T:
            k = _mix(k * np.uint64(0x100000001B3) + c)
        return k

    before, after = key(doc, four[:, :-1]), key(doc, four[:, 1:])
    order = np.argsort(before, kind="stable")
    asked = np.argsort(after, kind="stable")
    lo, n = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    lo[asked] = np.searchsorted(before[order], after[asked], "left")
    n[asked] = np.searchsorted(before[order], after[asked], "right") - lo[asked]
    dense = np.bincount(r.row[at], n, len(r.texts)) > DENSE * r.size + 64
    left = np.diff(r.offsets)[r.row[at]] - r.place[at] - 1  # runs that follow in the text

    def follow(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = n[nodes]
        return np.repeat(np.arange(len(nodes)), w), order[np.repeat(lo[nodes] - (np.cumsum(w) - w), w) + np.arange(w.sum())]

    def apart(nodes: np.ndarray, windows: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Which windows, each beginning with the run of a node, don't stand in the text; `sure` are those that do for certain."""
        out, width = ~sure, windows.shape[1]
        ends = np.diff(r.offsets)[r.row] - r.place > width - RUN
        have = np.sort(key(r.row[ends].astype(np.uint64), r.chars[(r.begin[r.row] + r.place)[ends][:, None] + np.arange(width)].astype(np.uint64)))
        ask = key(doc[nodes[out]], windows[out])
        by = np.argsort(ask, kind="stable")
        stands = np.empty(len(ask), bool)
        stands[by] = have[np.minimum(np.searchsorted(have, ask[by]), len(have) - 1)] == ask[by] if len(have) else False
        out[out] = ~stands
        return out

    nodes = np.flatnonzero(~dense[r.row[at]])
    src, dst = follow(nodes)
    src = nodes[src]
    # texts whose windows of three runs would be many leave too
    dense |= np.bincount(r.row[at][src], n[dst], len(r.texts)) > DENSE * r.size + 64
    keep = ~dense[r.row[at][src]]
    src, dst = src[keep], dst[keep]
    two = np.concatenate([four[src], four[dst][:, -1:]], axis=1)
    edge, end = follow(dst)
    three = np.concatenate([two[edge], four[end][:, -1:]], axis=1)
    out_row, out = [], []
    # a run that only one other can follow is followed by it
    one = n[src] == 1
    for nodes, w, sure in ((src, two, one & (left[src] > 0)), (src[edge], three, (one & (n[dst] == 1) & (left[src] > 1))[edge])):
        new = apart(nodes, w, sure)
        out_row.append(r.row[at][nodes[new]])
        out.append(np.pad(w[new], ((0, 0), (0, RUN + WINDOW - 1 - w.shape[1]))))
    return np.concatenate(out_row), np.concatenate(out).astype(np.uint32), np.flatnonzero(dense)


def window_key(chars: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the `length` characters from each place."""
    key = np.zeros(len(at), np.uint64)
    for k in range(length):
        key = key * np.uint64(0x100000001B3) + chars[at + k] + np.uint64(1)
    return _mix(key)


class FullTextIndex:
    """An FM-index of a list of texts; suffixes are ordered by their first DEPTH characters, which is all that windows ask."""

    def __init__(self, texts: list[str], window: int = WINDOW, extra: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        r = Runs(texts)
        self.texts, self.size, self.bits, self.window = texts, r.size, r.bits, window
        self.least, self.most = (int(r.size.min()), int(r.size.max())) if texts else (0, -1)
        n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        size = len(code)
        self.symbols, sym = np.unique(code, return_inverse=True)
        order, rank, step = np.arange(size), sym.astype(np.int64), 1
        while step < DEPTH:
            follow = np.zeros(size, np.int64)
            follow[: size - step] = rank[step:] + 1
            key = rank * (size + len(self.symbols) + 2) + follow
            order = np.argsort(key, kind="stable")
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([np.zeros(min(size, 1), np.int64), np.cumsum(key[order][1:] != key[order][:-1])])
            step *= 2
        self.start = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=len(self.symbols)))])
        last, at = sym[order - 1], np.arange(size)
        self.held = np.zeros((len(self.symbols), size // 64 + 1), np.uint64)
        np.bitwise_or.at(self.held, (last, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.before = np.concatenate([np.zeros((len(self.symbols), 1), np.uint32), np.cumsum(np.bitwise_count(self.held), axis=1, dtype=np.uint32)], axis=1)
        # windows that were put together, by hash; their texts follow those of the places
        rows, windows = extra if extra is not None else (np.zeros(0, np.int32), np.zeros((0, 0), np.uint32))
        keys = np.zeros(len(rows), np.uint64)
        for w in np.unique((windows > 0).sum(axis=1)):
            some = (windows > 0).sum(axis=1) == w
            keys[some] = window_key(windows[some].ravel(), np.arange(some.sum()) * windows.shape[1], int(w))
        by = np.argsort(keys, kind="stable")
        self.extra, self.doc = keys[by], np.concatenate([doc[order], rows[by].astype(np.int32)])
        self.places = size

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs among the first i places of the transform."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[c, w].astype(np.int64) + np.bitwise_count(self.held[c, w] & ((np.uint64(1) << r) - np.uint64(1)))

    def search(self, letters: np.ndarray, spelled: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """(lo, hi, lo, hi): the intervals of windows (a row each of `spelled`, by places in `letters`), in the texts and, by
        their keys (in order), among the windows put together."""
        sym = np.searchsorted(self.symbols, letters)
        sym[sym == len(self.symbols)] = 0
        sym[self.symbols[sym] != letters] = -1
        n = len(spelled)
        lo, hi, on = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        a, b = np.zeros(n, np.int64), np.full(n, self.places, np.int64)
        for k in range(spelled.shape[1] - 1, -1, -1):
            c = sym[spelled[on, k]]
            ok = c >= 0
            if not ok.all():
                on, c, a, b = on[ok], c[ok], a[ok], b[ok]
            a, b = self.start[c] + self.rank(c, a), self.start[c] + self.rank(c, b)
            ok = a < b
            on, a, b = on[ok], a[ok], b[ok]
        lo[on], hi[on] = a, b
        return lo, hi, *(np.searchsorted(self.extra, key, side) + self.places for side in ("left", "right"))

    def candidates(self, r: Runs, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(text, document): all pairs whose similarity may be t or more; pairs that can't reach it are left out by bounds only."""
        none = np.zeros(0, np.int64)
        least = np.maximum(self.least, np.ceil(t * r.size - 1e-9).astype(np.int64))
        fits = (r.size > 0) & (least <= self.most) & (self.least <= np.floor(r.size / t + 1e-9))
        miss = r.size - least_shared(r.size, least, t)
        fits &= miss >= 0
        if not fits.any():
            return none, none
        width = np.where(fits, np.clip(r.size // np.maximum(miss + 1 + SPARE, 1), 1, self.window), 1)
        found, rows, names, base = [], [], [], 0
        for w in np.unique(width[fits]):
            row, name, groups = r.windows(int(w))
            asked = np.flatnonzero((fits & (width == w))[row])
            rows.append(row[asked])
            names.append(name[asked] + base)
            for spelled, key in groups:
                found.append(np.stack(self.search(r.letters, spelled, key)))
                base += len(key)
        row, name, found = np.concatenate(rows), np.concatenate(names), np.concatenate(found, axis=1)
        # the rarest windows of each text; a similar one holds all of them but `miss`
        often = found[1] - found[0] + found[3] - found[2]
        order = np.argsort(row * (2 * len(self.doc) + 1) + often[name])
        row, name = row[order], name[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) <= miss[row] + SPARE
        least_hits = np.bincount(row[keep], minlength=len(r.texts)) - miss
        keep &= often[name] > 0
        row, name = np.repeat(row[keep], 2), name[keep]
        lo, hi = found[0::2, name].T.ravel(), found[1::2, name].T.ravel()
        row, lo, hi = row[lo < hi], lo[lo < hi], hi[lo < hi]
        if not len(row):
            return none, none
        need_of = least_shared(np.arange(int(r.size.max()) + self.most + 1), 0, t)
        held, out = len(self.texts), [none]
        # hits are counted for a few texts at a time: as many as the counters and the hits of EXPAND allow, one at least
        ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
        total, a = np.cumsum(hi - lo)[ends - 1], 0
        while a < len(ends):
            b = max(a + 1, min(a + EXPAND // held, int(np.searchsorted(total, (total[a - 1] if a else 0) + EXPAND))))
            some = slice(ends[a - 1] if a else 0, ends[b - 1])
            names, w = row[np.append(0, ends[:-1])[a:b]], hi[some] - lo[some]
            at = np.repeat(lo[some] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            key = np.repeat(np.searchsorted(names, row[some]) * held, w) + self.doc[at]
            count = np.bincount(key, minlength=len(names) * held).reshape(len(names), held)
            x, y = np.nonzero(count >= least_hits[names][:, None])
            x, a = names[x], b
            sx, sy = r.size[x], self.size[y]
            need = need_of[sx + sy]
            ok = need <= np.minimum(sx, sy)
            for k in range(4):  # nor do the maps show more runs on one side only than there may be
                apart, back = (np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)) if k == 0 else (apart, back)
                apart += np.bitwise_count(r.bits[k][x] & ~self.bits[k][y])
                back += np.bitwise_count(self.bits[k][y] & ~r.bits[k][x])
            ok &= (apart <= sx - need) & (back <= sy - need)
            out.append(x[ok] * held + y[ok])
        pairs = np.concatenate(out)
        return pairs // held, pairs % held


class Shard:
    """The indexes of a shard's texts, by classes of sizes."""

    def __init__(self, h: np.ndarray, texts: list[str]) -> None:
        self.parts = []
        r = Runs(texts)
        rows, windows, dense = put_together(r)
        is_dense = np.zeros(len(texts), bool)
        is_dense[dense] = True
        kind = size_class(r.size) * 2 + is_dense
        for k in np.unique(kind):
            some = np.flatnonzero(kind == k)
            place = np.full(len(texts), -1)
            place[some] = np.arange(len(some))
            mine = place[rows] >= 0
            self.parts.append((h[some], FullTextIndex([texts[x] for x in some], 1 if k & 1 else WINDOW, (place[rows[mine]], windows[mine]))))

    def matches(self, texts: list[str], t: float) -> Iterator[tuple]:
        """(place in texts, hash, similarity, matches, longest) of all similar texts, index by index."""
        r = Runs(texts)
        for h, index in self.parts:
            x, y = index.candidates(r, t)
            for a in range(0, len(x), 20_000):
                i, j = x[a : a + 20_000], y[a : a + 20_000]
                s, n, longest = common([texts[k] for k in i], [index.texts[k] for k in j])
                ok = s >= t
                if ok.any():
                    yield i[ok], h[j[ok]], s[ok], n[ok], longest[ok]


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS)).astype(np.int64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("h").sort_values("h")
    data = pickle.dumps(Shard(pdf["h"].to_numpy(), pdf["reduced"].tolist()), protocol=5)
    packed = len(data).to_bytes(8, "little") + pa.compress(data, "lz4", asbytes=True)
    return pd.DataFrame({"side": [pdf["side"].iloc[0]], "band": [pdf["band"].iloc[0]], "part": [pdf["part"].iloc[0]], "index": [packed]})


def _unpack(packed: bytes) -> Shard:
    return pickle.loads(pa.decompress(memoryview(packed)[8:], int.from_bytes(packed[:8], "little"), "lz4", asbytes=True))


FOUND = "side string, h_train long, h_eval long, similarity double, matches long, longest long"
SIZED = "side string, h long, reduced string, n long, class long"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = Runs(b.column(2).to_pylist()).size
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(size_class(n))], ["side", "h", "reduced", "n", "class"])


def sized(texts: DataFrame) -> DataFrame:
    """(side, h, reduced, n, class): the number of different runs of each text, and its class of sizes."""
    return texts.select("side", "h", "reduced").mapInArrow(_sizes, SIZED)


def _searcher(threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, side, h, reduced, index), sorted by key with the index first, -> similar texts."""
        at, shard = None, None
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(whole.column(3)), 0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // BATCH_CHARS)) + 1).tolist(), whole.num_rows]
            for b in (whole.slice(i, k - i) for i, k in zip(cuts, cuts[1:]) if k > i):
                keys = b.column(0).to_numpy()
                for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(keys)) + 1):
                    p = b.slice(int(part[0]), len(part))
                    if keys[part[0]] != at:
                        packed = p.column(4)[0].as_py()  # there is none where no text fell into the shard
                        at, shard = keys[part[0]], _unpack(packed) if packed else None
                        p = p.slice(1 if packed else 0)
                    if p.num_rows and shard:
                        side, h, texts = p.column(1)[0].as_py(), p.column(2).to_numpy(), p.column(3).to_pylist()
                        for x, y, s, n, longest in shard.matches(texts, threshold):
                            yield pa.RecordBatch.from_arrays([pa.array([side] * len(x)), *map(pa.array, (h[x], y, s, n, longest))], ["side", "h_train", "h_eval", "similarity", "matches", "longest"])

    return search


def bands(train: DataFrame, evaluation: DataFrame, threshold: float) -> list[tuple]:
    """(side, band, least, most, low, high, parts, slices, first key): classes of sizes that share shards, how many shards and slices
    each has, and the sizes it holds. A row per side and class of sizes reaches the driver."""
    count = lambda d: d.groupBy("side", "class").agg(F.sum(F.length("reduced") + 1).alias("chars"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("rows")).orderBy("side", "class").collect()
    held, asked, out, key = count(evaluation), count(train), [], 0
    runs_of = []
    for r in held:
        if runs_of and runs_of[-1][0].side == r.side and sum(x.chars for x in runs_of[-1]) + r.chars <= SHARD_CHARS:
            runs_of[-1].append(r)
        else:
            runs_of.append([r])
    for k, rs in enumerate(runs_of):
        low, high = min(r.low for r in rs), max(r.high for r in rs)
        rows = sum(a.rows for a in asked if a.side == rs[0].side and low * threshold <= a.high and a.low * threshold <= high)
        parts, slices = -(-sum(r.chars for r in rs) // SHARD_CHARS), max(1, -(-rows // SLICE))
        out.append((rs[0].side, k, rs[0]["class"], rs[-1]["class"], low, high, parts, slices, key))
        key += parts * slices
    return out


def cross_matches(train: DataFrame, evaluation: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(side, h_train, h_eval, similarity, matches, longest) of similar texts; both tables have (side, h, reduced)."""
    spark = train.sparkSession
    train, evaluation = stage(sized(train)), stage(sized(evaluation))
    table_ = bands(train, evaluation, threshold)
    per = F.broadcast(spark.createDataFrame(table_, "side string, band long, least long, most long, low long, high long, parts long, slices long, key long"))
    cut = evaluation.join(per, (evaluation.side == per.side) & evaluation["class"].between(F.col("least"), F.col("most"))).select(evaluation.side, "band", F.pmod("h", "parts").alias("part"), "h", "reduced")
    built = stage(cut.groupBy("side", "band", "part").applyInPandas(_build, "side string, band long, part long, index binary"))
    slice_key = F.col("key") + F.col("part") * F.col("slices") + F.col("slice")
    index = built.join(per, ["side", "band"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    asked = train.join(per, (train.side == per.side) & (F.col("low") * threshold <= F.col("n") + 1e-6) & (F.col("n") * threshold <= F.col("high") + 1e-6))
    asked = asked.select(train.side, "h", "reduced", "key", "slices", F.pmod(F.xxhash64("h"), "slices").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = index.select(slice_key.alias("key"), "side", F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("reduced"), "index", F.lit(0).alias("kind")).unionByName(
        asked.select(slice_key.alias("key"), "side", "h", "reduced", F.lit(None).cast("binary").alias("index"), F.lit(1).alias("kind"))
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = rows.repartitionById(n, F.pmod("key", F.lit(n)).cast("int")).sortWithinPartitions("key", "kind")
    return met.select("key", "side", "h", "reduced", "index").mapInArrow(_searcher(threshold), FOUND).distinct()


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with an effective split, and (pair_id, side, h, reduced, split) of their texts."""
    split = stage(effective_splits(table(spark, sf_dir, "pair_adjudications")))
    pairs = table(spark, sf_dir, "parallel_pairs").join(split, F.col("id") == F.col("pair_id"))
    both = pairs.select(F.explode(F.array(*[F.struct(F.concat(F.lit(s), F.lit("\t"), "pair_id").alias("key"), F.col(c).alias("text")) for s, c in (("lak", "lak_text"), ("ru", "ru_text"))])).alias("x")).select("x.*")
    texts = hashed(both, "key", "text").select(F.substring_index("key", "\t", 1).alias("side"), F.substring_index("key", "\t", -1).alias("pair_id"), "h", "reduced")
    return pairs, texts.join(split, "pair_id").distinct()


def overlaps(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    """(train_id, eval_id, side, split, similarity): evaluation pairs and their counterparts in training, by side."""
    ship(spark)
    _, texts = _sides(spark, sf_dir)
    texts = stage(texts)
    train, held = texts.where("split = 'train'"), texts.where("split in ('dev', 'test')")
    once = [stage(t.groupBy("side", "h").agg(F.first("reduced").alias("reduced"))) for t in (train, held)]
    found = stage(cross_matches(*once, threshold))
    a = train.select("side", F.col("h").alias("h_train"), F.col("pair_id").alias("train_id"))
    b = held.select("side", F.col("h").alias("h_eval"), F.col("pair_id").alias("eval_id"), "split")
    return found.join(a, ["side", "h_train"]).join(b, ["side", "h_eval"]).select("train_id", "eval_id", "side", "split", "similarity")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_a, pair_b) with similar texts, one in training and the other in evaluation."""
    return overlaps(spark, sf_dir).select(F.least("train_id", "eval_id").alias("pair_a"), F.greatest("train_id", "eval_id").alias("pair_b")).distinct()


def p2_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eval_id, split, train_id, similarity): each evaluation pair found, with its most similar training pair (ties: the smaller id)."""
    best = overlaps(spark, sf_dir).groupBy("eval_id", "split").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "train_id")).alias("x"))
    return best.select("eval_id", "split", F.col("x.train_id").alias("train_id"), (-F.col("x.s")).alias("similarity"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, source_type, n_pairs, n_found): evaluation pairs of each split and source type, and how many of them training holds too."""
    found = stage(overlaps(spark, sf_dir).select("eval_id").distinct())
    split = effective_splits(table(spark, sf_dir, "pair_adjudications")).where("split in ('dev', 'test')")
    pairs = table(spark, sf_dir, "parallel_pairs").select(F.col("id").alias("pair_id"), "source_type").groupBy("pair_id").agg(F.min("source_type").alias("source_type")).join(split, "pair_id")
    return pairs.join(found, F.col("eval_id") == F.col("pair_id"), "left").groupBy("split", "source_type").agg(F.count("*").alias("n_pairs"), F.count("eval_id").alias("n_found"))
