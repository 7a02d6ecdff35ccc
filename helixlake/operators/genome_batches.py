"""Arrow batches of genome identity: k-mers of sketches, genomes that meet at a k-mer, chains of a pair's matches.

A body is what a genome's k-mers come from: a list of its sequences, or of its (window, kmer).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: K-mers that are made at once (genomes are not cut), sorted rows that are looked at together, pairs of a batch.
KMERS, ROWS, PAIRS = 1 << 18, 1 << 16, 1 << 17
#: K-mers of their prefixes that a pair has to share before it is looked at, where the threshold asks for as many.
LINKS = 4
#: Drawn genomes up to which a k-mer is not often.
OFTEN = 8
#: Cells of a pair's matches up to which pairs are chained side by side.
CELLS = 24

_CODES = np.full(256, 5, np.uint8)
_CODES[list(b"ACGTN")] = range(5)
_TURNED = np.array([3, 2, 1, 0, 4], np.uint64)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each length, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _once(x: np.ndarray) -> np.ndarray:
    """Its distinct values, sorted."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Its distinct values, sorted, and the places of x among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new) - 1
    return x[new], out


def _one(*keys: np.ndarray) -> np.ndarray | None:
    """A number for each row in the order of the keys, the first of them first; none if that takes more than 63 bits."""
    out, room = np.zeros(len(keys[0]), np.int64), 1
    if not len(out):
        return out
    for key in keys:
        low, high = int(key.min()), int(key.max())
        if high - low > 4 * len(key):
            key = _ranks(key)[1]
            low, high = 0, int(key.max())
        room *= high - low + 1
        if room >= 1 << 63:
            return None
        out = out * (high - low + 1) + (key - low)
    return out


def _order(*keys: np.ndarray) -> np.ndarray:
    """Rows sorted by the keys, the first of them first; numbers are sorted several times as fast as by ``lexsort``."""
    one = _one(*keys)
    return np.lexsort(keys[::-1]) if one is None else np.argsort(one)


# ---- k-mers -----------------------------------------------------------------------------------------------------


def canonical_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k-mer at each place of codes (A, C, G, T, N: 0 to 4), the same for both strands; up to k = 27 no two
    k-mers share one. Runs of letters are put together from shorter ones."""
    base = 5 if k <= 27 else 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    forward, backward = codes.astype(np.uint64), _TURNED[codes]
    done, size, parts = 0, 1, None
    while True:
        if k & size:
            if parts is None:
                parts = forward, backward
            else:
                n = len(forward) - done
                parts = parts[0][:n] * power(size) + forward[done:], parts[1][:n] + backward[done:] * power(done)
            done += size
        if done == k:
            break
        n = len(forward) - size
        forward, backward, size = forward[:n] * power(size) + forward[size:], backward[:n] + backward[size:] * power(size), 2 * size
    return mixed(np.minimum(*parts)).view(np.int64)


def mixed(z: np.ndarray) -> np.ndarray:
    """64 bits for 64 bits, one to one."""
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = z ^ (z >> np.uint64(shift))
        z = z * np.uint64(times)
    return z


def _sizes(bodies: pa.Array) -> np.ndarray:
    """About how many k-mers the bodies have."""
    n = np.diff(bodies.offsets.to_numpy()).astype(np.int64)
    if not pa.types.is_string(bodies.type.value_type):
        return n
    return np.bincount(np.repeat(np.arange(len(n)), n), pc.binary_length(bodies.flatten()).to_numpy(zero_copy_only=False), len(n)).astype(np.int64)


def _blocks(sizes: np.ndarray):
    """(lo, hi) of rows of KMERS together, one row at least."""
    lo, filled = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(filled, filled[lo] - sizes[lo] + KMERS, "right")))
        yield lo, hi
        lo = hi


def _kmers(bodies: pa.Array, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, window, kmer): every place of the bodies, in their order; a window of a sequence has ``step`` places."""
    values = bodies.flatten()
    of = np.repeat(np.arange(len(bodies)), np.diff(bodies.offsets.to_numpy()))
    if not pa.types.is_string(values.type):
        window, kmer = (c.to_numpy() for c in values.flatten())
        return of, window, kmer
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = _CODES[np.frombuffer("".join(values.to_pylist()).encode(), np.uint8)]
    if (codes > 4).any():
        raise ValueError("letters other than A, C, G, T and N: sequences are not normalised")
    places = np.maximum(lengths - k + 1, 0)
    if not places.any():
        return (np.empty(0, np.int64),) * 3
    kmer = canonical_kmers(codes, k)[_runs(np.cumsum(lengths) - lengths, places)]
    return np.repeat(of, places), _runs(np.zeros_like(places), places) // step, kmer


def _distinct(of: np.ndarray, kmer: np.ndarray, late=lambda kmers: np.zeros_like(kmers)) -> tuple[np.ndarray, np.ndarray]:
    """(of, kmer) once each, those of one genome together and in the order of ``late`` and themselves."""
    kmers, rank = _ranks(kmer)
    order = np.argsort(late(kmers), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of, at = np.divmod(_once(of * len(kmers) + place[rank]), max(len(kmers), 1))
    return of, kmers[order[at]]


def draw_rows(k: int, step: int):
    """Of (body, drawn): (kmer, null, null) for each distinct k-mer of drawn genomes, and (null, fewest distinct k-mers that a
    genome of some has, how many they have in all)."""

    def run(batches):
        for batch in batches:
            for lo, hi in _blocks(_sizes(batch.column(0))):
                of, kmer = _distinct(*_kmers(batch.column(0).slice(lo, hi - lo), k, step)[::2])
                if len(of):
                    n = np.bincount(of)
                    kmer = kmer[batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[of]]
                    last = np.append(np.zeros(len(kmer), bool), True)
                    n, total = (pa.array(np.append(np.zeros_like(kmer), x), mask=~last) for x in (n[n > 0].min(), n.sum()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(kmer, 0), mask=last), n, total], ["kmer", "n", "total"])

    return run


# ---- pairs ------------------------------------------------------------------------------------------------------


def enough(n: np.ndarray | int, least: float) -> np.ndarray:
    """How many k-mers are the share ``least`` of n."""
    return np.ceil(n * least * (1 - 1e-9)).astype(np.int64)


def drawn_part(postings: int) -> int:
    """One genome in so many is drawn, so that a k-mer of ``postings`` genomes has some OFTEN drawn ones."""
    return max(1, postings // OFTEN)


def _drawn_by(kmer: np.ndarray, kmers: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many drawn genomes have each of kmer, by the sorted common kmers and theirs; 0 where it is not among them."""
    if not len(kmers):
        return np.zeros_like(kmer)
    at = np.minimum(np.searchsorted(kmers, kmer), len(kmers) - 1)
    return np.where(kmers[at] == kmer, g[at], 0)


def posting_rows(k: int, step: int, least: float, fewest: int, common, postings: int):
    """(genome, place, n, pos, block) of (genome, draw, body): the distinct k-mers of a genome's prefix for any pair that it
    may be in, how many it has in all, and the number of each among them.

    A k-mer's genomes meet at one place, itself. Where they are often, a hash cuts them into blocks of about ``postings``, each
    of which meets each other, and itself, at a place of their own; block is its number where two of them meet, otherwise -1.
    common: what ``_drawn_by`` takes, broadcast; draw: another hash of the genome.
    """

    def run(batches):
        need = int(enough(fewest, least))
        for batch in batches:
            for lo, hi in _blocks(_sizes(batch.column(2))):
                of, _, kmer = _kmers(batch.column(2).slice(lo, hi - lo), k, step)
                of, kmer = _distinct(of, kmer, lambda kmers: _drawn_by(kmers, *common.value))
                n = np.bincount(of, minlength=hi - lo)
                pos = np.arange(len(of)) - (np.cumsum(n) - n)[of]
                mine = pos < n[of] - need + min(LINKS, need)
                of, kmer, pos = of[mine], kmer[mine], pos[mine]
                drawn = _drawn_by(kmer, *common.value)
                many = np.where(drawn > OFTEN, -(-drawn * drawn_part(postings) // postings), 1)
                block = np.where(many > 1, batch.column(1).slice(lo, hi - lo).to_numpy()[of] % many, -1)
                row, other = np.repeat(np.arange(len(of)), many), _runs(np.zeros_like(many), many)
                of, pos, kmer, block = of[row], pos[row], kmer[row], block[row]
                low, high = np.minimum(block, other).astype(np.uint64), np.maximum(block, other).astype(np.uint64)
                place = np.where(block < 0, kmer, mixed(mixed(mixed(kmer.view(np.uint64)) + low) + high).view(np.int64))
                block[block == other] = -1
                names = batch.column(0).slice(lo, hi - lo).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([names, pa.array(place), pa.array(n[of]), pa.array(pos), pa.array(block)], ["genome", "place", "n", "pos", "block"])

    return run


def _changes(*columns: pa.Array) -> np.ndarray:
    """Places of rows that differ from the one before; the first is one."""
    n = len(columns[0])
    differ = np.zeros(n - 1, bool)
    for c in columns:
        differ |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differ) + 1])


def _whole(batches, key: str):
    """Tables of some ROWS of sorted batches; rows of an equal key are in one."""
    held, n, some = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= some:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(_changes(table[key].chunk(0))[-1])
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
            some = max(ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranked(names: pa.Array) -> tuple[np.ndarray, pa.Array | None]:
    """Numbers in the order of the names, and the names of the numbers; integers are their own."""
    if pa.types.is_integer(names.type):
        return names.to_numpy(), None
    coded = names.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def pair_rows(least: float):
    """(l, r, need), l < r, of the genomes at each place that have its k-mer in the prefixes for each other, and how many such
    they share if they reach ``least``; (genome, place, n, pos, block) come sorted by place."""

    def run(batches):
        for table in _whole(batches, "place"):
            genome, place = table["genome"].chunk(0), table["place"].chunk(0)
            first = _changes(place)
            size = np.diff(np.append(first, len(place)))
            later = np.repeat(first + size, size) - np.arange(len(place)) - 1  # genomes at the place after this one
            if not later.any():
                continue
            g, named = _ranked(genome)
            n, pos, block = (table[c].chunk(0).to_numpy() for c in ("n", "pos", "block"))
            total = np.cumsum(later)
            lo = 0
            while lo < len(later):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] - later[lo] + PAIRS, "right")))
                left, right = np.repeat(np.arange(lo, hi), later[lo:hi]), _runs(np.arange(lo, hi) + 1, later[lo:hi])
                lo = hi
                common = enough(np.minimum(n[left], n[right]), least)
                need = np.minimum(common, LINKS)
                met = (pos[left] < n[left] - common + need) & (pos[right] < n[right] - common + need)
                met &= (g[left] != g[right]) & ((block[left] < 0) | (block[left] != block[right]))
                if met.any():
                    sides = g[left[met]], g[right[met]]
                    sides = [pa.array(x, genome.type) if named is None else named.take(pa.array(x)) for x in (np.minimum(*sides), np.maximum(*sides))]
                    yield pa.RecordBatch.from_arrays([*sides, pa.array(need[met])], ["l", "r", "need"])

    return run


# ---- chains -----------------------------------------------------------------------------------------------------


def heaviest_chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of a longest run of matches that do not go back in x nor in y."""
    order = np.lexsort((y, x))
    ends: list[int] = []  # least y of a chain of each length
    at: list[int] = []
    before = np.full(len(order), -1)
    for i, v in enumerate(y[order].tolist()):
        j = bisect_right(ends, v)
        before[i] = at[j - 1] if j else -1
        if j == len(ends):
            ends.append(v), at.append(i)
        else:
            ends[j], at[j] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(order[i])
        i = before[i]
    return np.array(out, np.int64)


def _least(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row, the first place of the greatest score with the least y."""
    return np.where(score == score.max(axis=1, keepdims=True), y, np.iinfo(np.int64).max).argmin(axis=1)


def _side_by_side(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of ``heaviest_chain`` and distinct x and y in it, of rows of cells sorted by (x, y)."""
    length, nx, ny = weight.copy(), np.ones_like(x), np.ones_like(x)
    row = np.arange(len(x))
    for i in range(1, x.shape[1]):
        score = np.where(y[:, :i] <= y[:, i : i + 1], length[:, :i], 0)
        j = _least(score, y[:, :i])
        after = score[row, j] > 0
        length[:, i] += score[row, j]
        nx[:, i] += np.where(after, nx[row, j] - 1 + (x[row, j] != x[:, i]), 0)
        ny[:, i] += np.where(after, ny[row, j] - 1 + (y[row, j] != y[:, i]), 0)
    j = _least(length, y)
    return length[row, j], nx[row, j], ny[row, j]


def chain_hits(pair: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """Distinct x and y in the heavier of the forward and the backward chain of each pair's matches, with every pair."""
    if not len(pair):
        return np.zeros((pairs, 2), np.int64)
    order = _order(pair, x, y)
    pair, x, y = pair[order], x[order], y[order]
    cell = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    weight = np.diff(np.append(cell, len(x)))
    pair, x, y = pair[cell], x[cell], y[cell]
    cells = np.bincount(pair, minlength=pairs)
    first = np.cumsum(cells) - cells
    back = _order(pair, x, -y)
    hits = np.repeat(np.minimum(cells, 1)[:, None], 2, axis=1)
    for n in np.unique(cells).tolist():
        rows = np.flatnonzero(cells == n)
        if n > CELLS:
            for p in rows.tolist():
                mine = slice(first[p], first[p] + n)
                xs, ys = np.repeat(x[mine], weight[mine]), np.repeat(y[mine], weight[mine])
                chain = max((heaviest_chain(xs, side) for side in (ys, -ys)), key=len)
                hits[p] = len(set(xs[chain].tolist())), len(set(ys[chain].tolist()))
        elif n > 1:
            at = first[rows, None] + np.arange(n)
            ways = [_side_by_side(x[at], y[at], weight[at]), _side_by_side(x[back[at]], -y[back[at]], weight[back[at]])]
            turned = ways[1][0] > ways[0][0]
            hits[rows, 0], hits[rows, 1] = (np.where(turned, ways[1][c], ways[0][c]) for c in (1, 2))
    return hits


def identity_rows(k: int, step: int):
    """(l, r, k_l, k_r, common, w_l, w_r, hit_l, hit_r) of (l, r, body of l, body of r): distinct k-mers of either and of
    both, and windows of either, all and those in the heavier of the forward and the backward chain."""

    def run(batches):
        for batch in batches:
            for lo, hi in _blocks(_sizes(batch.column(2)) + _sizes(batch.column(3))):
                pairs = hi - lo
                sides = [_kmers(batch.column(c).slice(lo, pairs), k, step) for c in (2, 3)]
                of, window, kmer = (np.concatenate(x) for x in zip(*sides, strict=True))
                side = np.repeat([0, 1], [len(x[0]) for x in sides])
                windows = []
                for o, w, _ in sides:
                    w = _ranks(w)[1]
                    windows.append(np.bincount(_once(o * (len(w) + 1) + w) // (len(w) + 1), minlength=pairs))
                order = _order(of, kmer, side, window)
                of, window, kmer, side = of[order], window[order], kmer[order], side[order]
                one = np.append(True, (of[1:] != of[:-1]) | (kmer[1:] != kmer[:-1]) | (side[1:] != side[:-1]))[: len(of)]
                once = one | np.append(True, window[1:] != window[:-1])[: len(of)]
                of, window, kmer, side, first = of[once], window[once], kmer[once], side[once], np.flatnonzero(one[once])
                n = np.diff(np.append(first, len(of)))
                of, kmer, side = of[first], kmer[first], side[first]
                distinct = [np.bincount(of[side == c], minlength=pairs) for c in (0, 1)]
                left = np.flatnonzero((of[1:] == of[:-1]) & (kmer[1:] == kmer[:-1]))  # the same k-mer of the right side follows
                right, many = left + 1, n[left] * n[left + 1]
                match, within = np.repeat(np.arange(len(left)), many), _runs(np.zeros_like(many), many)  # every window with every window
                hits = chain_hits(of[left][match], window[first[left][match] + within // n[right][match]], window[first[right][match] + within % n[right][match]], pairs)
                common = np.bincount(of[left], minlength=pairs)
                numbers = [*distinct, common, *windows, hits[:, 0], hits[:, 1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, pairs) for c in (0, 1)), *(pa.array(x.astype(np.int64)) for x in numbers)], ["l", "r", "k_l", "k_r", "common", "w_l", "w_r", "hit_l", "hit_r"])

    return run
