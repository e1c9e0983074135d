"""Repeated passages across documents, found by a suffix sort compared through hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, bounded_batches, sorted_groups, stored

LENGTH = 50
GRAM = 20
# Bytes of text hashed at once; positions within must fit the low bits of a word.
CHUNK = 1 << 20
# Sampled places gathered before repeats within a task are merged.
UNIT = 1 << 21
# A sample is crowded if its pieces are over half of what a task gets on average, within
# these bounds: below the first it is no burden, above the second it would fill a task's memory.
# Crowded samples are split into single windows, which spread by their content.
CROWD = (1024, 16_384)

_BASE = 0x9E3779B97F4A7C15


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & 0xFFFFFFFFFFFFFFFF
    return x


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class Prefixes:
    """Prefix polynomial hashes of a byte string modulo 2^64: any piece's hash in O(1)."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Prefixes._up) < n:
            m = max(n, CHUNK + 1)
            Prefixes._up, Prefixes._down = _powers(_BASE, m), _powers(_inverse(_BASE), m)
        self.data = data
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Prefixes._up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` bytes from each start, the same wherever the bytes stand."""
        return (self.sums[start + length] - self.sums[start]) * Prefixes._down[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all pieces of one length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * Prefixes._down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Low bits of a sum depend on low bits only: spread them before comparing sizes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sample_runs(
    texts: list[bytes], length: int = LENGTH, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first and last window start, sampled place, its hash) of every run.

    Every window of ``length`` bytes is represented by the place in it whose ``gram``
    bytes hash lowest, the leftmost of equals. Neighbouring windows mostly share the
    place; they form a run. Equal windows have equal samples at equal distance, so
    repeats are found among runs with equal samples: a few per cent of all places.
    """
    spread = length - gram + 1
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        grams = mixed(Prefixes(data).every(gram))
        m = (grams & ~np.uint64(CHUNK * 2 - 1)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= spread:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < spread:
            m = np.minimum(m[: len(m) - (spread - step)], m[spread - step :])
        place = (m & np.uint64(CHUNK * 2 - 1)).astype(np.int64)
        ends = np.cumsum([len(t) for _, _, t in held])
        sizes = np.array([len(t) for _, _, t in held])
        begin, stop = ends - sizes, ends - length + 1
        # a run ends where the sample changes, a text begins, or its windows end
        edge = np.zeros(len(place) + 1, bool)
        edge[1:-1] = place[1:] != place[:-1]
        edge[begin] = edge[stop] = True
        new = np.flatnonzero(edge[:-1])
        last = np.append(new[1:], len(place)) - 1
        who = np.searchsorted(begin, new, "right") - 1
        inside = new < stop[who]  # other windows reach into the next text
        new, last, who = new[inside], last[inside], who[inside]
        shift = np.array([at for _, at, _ in held])[who] - begin[who]
        at = place[new]
        return (
            np.array([i for i, _, _ in held])[who],
            new + shift,
            last + shift,
            at + shift,
            grams[at],
        )

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK // 2):
            part = text[at : at + CHUNK // 2 + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > CHUNK and held:
                yield flush()
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        yield flush()


_NO_ID = (1 << 63) - 1  # a missing id is smaller than none
_LOW = np.uint64((1 << 40) - 1)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    """Where samples of a hash meet."""
    return ((h >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)


def _packed(h: np.ndarray) -> np.ndarray:
    """The low five bytes of each hash; with the slot they tell samples apart well enough."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table begins a new combination of values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_SAMPLES = "slot long, known boolean, hashes binary, contents binary, counts binary"


def _sampled(length: int, gram: int, slots: int):
    """Task: samples of its texts, packed by the slot in which they meet those of others.

    A sample that two texts of the task share is known to be repeated. All its texts
    are told so, and one marker (content -1) goes to its slot for the sake of others; so a passage
    in very many texts sends as many rows as there are tasks.
    """

    def rows(h: np.ndarray, c: np.ndarray, known: bool):
        if not len(h):
            return
        slot = _slot(h, slots)
        order = np.argsort(slot.astype(np.uint16) if slots <= 1 << 16 else slot, kind="stable")
        h, c, slot = h[order], c[order], slot[order]
        at = _starts(slot)
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True):
            each = _starts(c[i:j])
            yield {
                "slot": int(slot[i]),
                "known": known,
                "hashes": _packed(h[i:j]).tobytes(),
                "contents": c[i:j][each].tobytes(),
                "counts": np.diff(each, append=j - i).astype(np.uint32).tobytes(),
            }

    def unit(h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        at = _starts(h[order])
        times = np.diff(at, append=len(h))
        lone = np.zeros(len(h), bool)
        lone[order[at[times == 1]]] = True
        # only samples that come again are sorted by text too
        again = order[np.repeat(times > 1, times)]
        again = again[np.lexsort((c[again], h[again]))]
        ha, ca = h[again], c[again]
        one = _starts(ha, ca)
        ha, ca = ha[one], ca[one]
        at = _starts(ha)
        times = np.diff(at, append=len(ha))
        known = np.repeat(times > 1, times)
        marks = ha[at[times > 1]]
        yield from rows(ha[known], ca[known], True)
        yield from rows(
            np.concatenate((h[lone], ha[~known], marks)),
            np.concatenate((c[lone], ca[~known], np.full(len(marks), -1))),
            False,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("slot", pa.int64()), ("known", pa.bool_())]
            + [(n, pa.binary()) for n in ("hashes", "contents", "counts")]
        )
        found: list[tuple] = []
        held = 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*found, strict=True))
            out = list(unit(h, c))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist(out[i : i + 1000], schema=schema)

        for batch in batches:
            contents = batch.column("content").to_numpy()
            for who, _, _, _, h in sample_runs(batch.column("__bytes").to_pylist(), length, gram):
                found.append((h, contents[who]))
                held += len(h)
            if held >= UNIT:
                yield from flush()
                found, held = [], 0
        if held:
            yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: of the samples that meet in its slots, those of two texts, by text."""
    schema = pa.schema([("content", pa.int64()), ("slot", pa.int64()), ("hashes", pa.binary())])

    def told(h, c, slot):
        order = np.lexsort((slot, c))
        h, c, slot = h[order], c[order], slot[order]
        at = _starts(c, slot)
        raw = _packed(h)
        rows = [
            {"content": x, "slot": y, "hashes": raw[i:j].tobytes()}
            for x, y, i, j in zip(
                c[at].tolist(), slot[at].tolist(), at.tolist(), [*at[1:].tolist(), len(h)], strict=True
            )
        ]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=schema)

    met: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            h = _unpacked(r["hashes"])
            c = np.repeat(
                np.frombuffer(r["contents"], np.int64), np.frombuffer(r["counts"], np.uint32)
            )
            slot = np.full(len(h), r["slot"])
            if r["known"]:
                yield from told(h, c, slot)
            else:
                met.append((h, c, slot))
    if not met:
        return
    h, c, slot = (np.concatenate(x) for x in zip(*met, strict=True))
    order = np.lexsort((c, h, slot))
    h, c, slot = h[order], c[order], slot[order]
    at = _starts(h, slot)
    size = np.diff(at, append=len(h))
    several = (c[at] == -1) | (c[at] != c[at + size - 1])
    keep = np.repeat(several, size) & (c != -1)
    if keep.any():
        yield from told(h[keep], c[keep], slot[keep])


# Pieces of a text and where they stand in it; or, for ``cover``, a range known to be covered.
_PIECES = "cover boolean, sample long, id long, content long, at array<int>, lead int, stop int, piece binary"
_PIECE_SCHEMA = pa.schema(
    [
        ("cover", pa.bool_()), ("sample", pa.int64()), ("id", pa.int64()), ("content", pa.int64()),
        ("at", pa.list_(pa.int32())), ("lead", pa.int32()), ("stop", pa.int32()), ("piece", pa.binary()),
    ]
)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of a byte string as an Arrow column, without a Python object each."""
    offsets = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(
        pa.binary(),
        len(size),
        [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())],
    )


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and b really agree: hashes only make it likely."""
    if not len(a):
        return np.zeros(0, bool)
    offsets = np.concatenate(([0], np.cumsum(size)))
    inner = np.arange(offsets[-1])
    equal = data[inner + np.repeat(a - offsets[:-1], size)] == data[
        inner + np.repeat(b - offsets[:-1], size)
    ]
    return np.logical_and.reduceat(equal, offsets[:-1])


def _collapsed(data, start, size, key, ids, ties=()):
    """Equal pieces as one: (order, class of each row in that order, first row of each class).

    Rows are ordered by key columns, piece, id and ``ties``, so the first of a class has
    its smallest id. Classes are made by hash and confirmed byte by byte; should two pieces
    only collide, the pieces themselves take the place of their hashes.
    """
    h = Prefixes(data).of(start, size)
    while True:
        order = np.lexsort((*ties, ids, h, size, *key))
        first = np.zeros(len(order), bool)
        first[_starts(*[k[order] for k in (*key, size, h)])] = True
        rep = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = np.flatnonzero(~first)
        if _same_bytes(data, start[order][rep[again]], start[order][again], size[order][again]).all():
            return order, np.cumsum(first) - 1, np.flatnonzero(first)
        numbers: dict[bytes, int] = {}
        raw = data.tobytes()
        h = np.array(
            [numbers.setdefault(raw[i : i + n], len(numbers)) for i, n in zip(start, size, strict=True)]
        )


def _united(who: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges of each text joined where they overlap or touch: (text, start, stop)."""
    if not len(who):
        return who, lo, hi
    order = np.lexsort((lo, who))
    who, lo, hi = who[order], lo[order], hi[order]
    wide = np.int64(1 << 40)
    reach = np.maximum.accumulate(who * wide + hi)
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (who[1:] * wide + lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(who)) - 1
    return who[first], lo[first], reach[last] - who[last] * wide


def _merged_pieces(data, start, size, lead, sample, who, ids, contents, at):
    """Rows of ``_PIECES`` for pieces of a task's texts, equal ones merged.

    ``who`` numbers the texts, ``ids`` and ``contents`` are theirs. Of equal pieces those of the smallest id
    are sent, one row for each text with all its places; the others are covered.
    """
    owner = ids[who]
    order, cls, first = _collapsed(data, start, size, (lead, sample), owner, (at, who))
    covered = owner[order] > owner[order][first][cls]
    o = order[covered]
    if len(o):
        text, lo, hi = _united(who[o], at[o], at[o] + size[o])
        n = len(text)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(n, bool)),
                pa.array(np.zeros(n, np.int64)),
                pa.array(ids[text]),
                pa.array(contents[text]),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), lo.astype(np.int32)),
                pa.array(np.zeros(n, np.int32)),
                pa.array(hi.astype(np.int32)),
                pa.nulls(n, pa.binary()),
            ],
            schema=_PIECE_SCHEMA,
        )
    o = order[~covered]
    begin = _starts(cls[~covered], who[o])
    row = o[begin]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.zeros(len(row), bool)),
            pa.array(sample[row].view(np.int64)),
            pa.array(owner[row]),
            pa.array(contents[who[row]]),
            pa.ListArray.from_arrays(
                np.append(begin, len(o)).astype(np.int32), at[o].astype(np.int32)
            ),
            pa.array(lead[row].astype(np.int32)),
            pa.array(np.zeros(len(row), np.int32)),
            _gathered(data, start[row], size[row]),
        ],
        schema=_PIECE_SCHEMA,
    )


def _cut_out(length: int, gram: int, slots: int):
    """Task: the runs of its texts whose samples are repeated, equal ones of the task once.

    A text with a larger id than an equal run is covered there, which needs no
    further look.
    """

    def tags(slot: np.ndarray, low: np.ndarray, text: np.ndarray) -> np.ndarray:
        """A sample of a text as one number; should two be alike, a run is cut out in vain."""
        return (slot.astype(np.uint64) << np.uint64(40) | low) ^ mixed(
            (text + 1).astype(np.uint64) * np.uint64(_BASE)
        )

    def told_tags(column: pa.ListArray, first: int) -> np.ndarray:
        """Tags of the samples that a batch's texts, numbered from ``first``, were told of."""
        replies = column.flatten()
        text = np.repeat(np.arange(first, first + len(column)), column.value_lengths().to_numpy())
        hashes = replies.field("hashes")
        n = pc.binary_length(hashes).to_numpy() // 5
        low = _unpacked(b"".join(hashes.to_pylist()))
        return tags(np.repeat(replies.field("slot").to_numpy(), n), low, np.repeat(text, n))

    def pieces(texts, marked, ids, contents):
        own = np.sort(np.concatenate(marked))
        if not len(own):
            return
        rows = []
        for who, q0, q1, place, h in sample_runs(texts, length, gram):
            tag = tags(_slot(h, slots), h & _LOW, who)
            keep = own[np.minimum(np.searchsorted(own, tag), len(own) - 1)] == tag
            rows.append([x[keep] for x in (who, q0, q1, place, h)])
        if not rows:
            return
        who, q0, q1, place, h = (np.concatenate(x) for x in zip(*rows, strict=True))
        if not len(who):
            return
        used = np.unique(who)
        sizes = np.array([len(texts[i]) for i in used])
        base = np.zeros(len(texts), np.int64)
        base[used] = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        data = np.frombuffer(b"".join(texts[i] for i in used), np.uint8)
        yield from _merged_pieces(
            data, base[who] + q0, q1 - q0 + length, place - q0, h, who, ids, contents, q0
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        held: list[list] = [[], [], [], []]
        size = 0

        def flush():
            yield from pieces(held[0], held[1], *(np.concatenate(x) for x in held[2:]))

        for batch in batches:
            begin = 0
            zipped, told, ids, contents = (
                batch.column(n) for n in ("zipped", "told", "id", "content")
            )
            for end, z in enumerate(zipped.to_pylist(), 1):
                text = unzip(z)
                held[0].append(text)
                size += len(text)
                if size >= 4 * CHUNK or end == len(batch):
                    held[1].append(told_tags(told[begin:end], len(held[0]) - (end - begin)))
                    held[2].append(ids[begin:end].to_numpy())
                    held[3].append(contents[begin:end].to_numpy())
                    begin = end
                if size >= 4 * CHUNK:
                    yield from flush()
                    held, size = [[], [], [], []], 0
        if size:
            yield from flush()

    return run


def compare_suffixes(text: Prefixes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for suffixes at a and b cut to ``length``: extension by binary search.

    The common beginning is found by comparing prefix hashes of halving lengths, so a
    comparison takes the logarithm of the length; then one byte decides. Equality is
    confirmed byte by byte by the caller.
    """
    sign = np.zeros(len(a), np.int64)
    unlike = np.flatnonzero(text.of(a, length) != text.of(b, length))
    a, b = a[unlike], b[unlike]
    before_a, before_b = text.sums[a], text.sums[b]
    down_a, down_b = Prefixes._down[a], Prefixes._down[b]
    common = np.zeros(len(a), np.int64)
    step = 1 << (length.bit_length() - 1)
    while step:
        reach = common + step
        room = np.minimum(reach, length)  # beyond the length, where they differ
        same = (text.sums[a + room] - before_a) * down_a == (text.sums[b + room] - before_b) * down_b
        common = np.where(same, reach, common)
        step >>= 1
    x, y = text.data[a + common].astype(np.int16), text.data[b + common].astype(np.int16)
    sign[unlike] = np.sign(x - y)
    return sign


def sort_suffixes(text: Prefixes, places: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Order in which the suffixes at ``places`` are sorted within each segment.

    ``bounds`` are the starts of the segments and the total. A bottom-up mergesort: in
    each round every suffix looks up its rank in the neighbouring run by binary search, all
    suffixes of all segments at once. Stable: equal suffixes keep their order.
    """
    n = len(places)
    order = np.arange(n)
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    width, longest = 1, int(np.diff(bounds).max(initial=0))
    while width < longest:
        at = np.arange(n)
        block = (at - begin) // (2 * width)
        low = begin + block * 2 * width
        middle, high = np.minimum(low + width, end), np.minimum(low + 2 * width, end)
        move = np.flatnonzero(middle < high)
        left = move < middle[move]
        # a left suffix goes after smaller right ones, a right one also after equal left ones
        lo = np.where(left, middle[move], low[move])
        hi = np.where(left, high[move], middle[move])
        base = lo.copy()
        own = places[order[move]]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            sign = compare_suffixes(text, places[order[mid]], own[open_], length)
            before = np.where(left[open_], sign < 0, sign <= 0)
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        rank = np.where(left, move, low[move] + (move - middle[move])) + (lo - base)
        merged = order.copy()
        merged[rank] = order[move]
        order = merged
        width *= 2
    return order


def _least_elsewhere(data, start, size, lead, group, ids, length):
    """For every window of distinct pieces, the smallest id that has the same window.

    Windows can only be equal within a group (one sample) and at one distance from
    the sample: these are the segments in which suffixes are sorted. Returns the piece
    and place of each window compared and that smallest id.
    """
    count = size - length + 1
    piece = np.repeat(np.arange(len(start)), count)
    offsets = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    segment = group[piece] * 256 + (lead[piece] - within)
    by = np.argsort(segment, kind="stable")
    at = _starts(segment[by])
    sizes = np.diff(at, append=len(by))
    by = by[np.repeat(sizes > 1, sizes)]  # a window alone in its segment has no like
    if not len(by):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.append(_starts(segment[by]), len(by))
    text = Prefixes(data)
    places = (start[piece] + within)[by]
    order = sort_suffixes(text, places, bounds, length)
    sorted_, seg = places[order], segment[by][order]
    # neighbours in order share a whole window if hashes say so and the bytes agree
    a, b = sorted_[:-1], sorted_[1:]
    same = (seg[:-1] == seg[1:]) & (text.of(a, length) == text.of(b, length))
    likely = np.flatnonzero(same)
    if not _same_bytes(data, a[likely], b[likely], np.full(len(likely), length)).all():
        # hashes collided, so the order may be wrong: sort by the bytes themselves
        raw, seg0 = data.tobytes(), segment[by]
        order = np.array(sorted(range(len(by)), key=lambda k: (seg0[k], raw[places[k] : places[k] + length])))
        sorted_, seg = places[order], seg0[order]
        a, b = sorted_[:-1], sorted_[1:]
        same = (seg[:-1] == seg[1:]) & _same_bytes(data, a, b, np.full(len(a), length))
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(ids[piece[by[order]]], heads)
    least = np.repeat(least, np.diff(heads, append=len(order)))
    return piece[by[order]], within[by[order]], least


_COVERS = "id long, content long, at int, stop int"
_COVER_NAMES = ["id", "content", "at", "stop"]


def _matched(length: int, key: str):
    """Task: covered places of pieces that meet by ``key``; pieces of a key stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, key, least=30_000):
            raw = table["piece"]
            size = np.array([len(x) for x in raw], np.int64)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            data = np.frombuffer(b"".join(raw), np.uint8)
            ids, contents = table["id"], table["content"]
            covers = _Covers(ids, contents, table["at"])
            lead, sample = table["lead"].astype(np.int64), table[key]
            order, cls, first = _collapsed(data, start, size, (lead, sample), ids)
            least = ids[order][first]
            whole = order[ids[order] > least[cls]]
            covers.add(whole, np.zeros(len(whole), np.int64), size[whole])
            rep = order[first]
            by_sample = np.argsort(sample[rep], kind="stable")
            rep = rep[by_sample]
            starts = _starts(sample[rep])
            n = np.diff(starts, append=len(rep))
            several = np.repeat(n > 1, n)
            group = np.repeat(np.arange(len(n)), n)[several]
            rep = rep[several]
            piece, within, least = _least_elsewhere(
                data, start[rep], size[rep], lead[rep], group, ids[rep], length
            )
            hit = least < ids[rep][piece]
            piece, within = piece[hit], within[hit]
            if len(piece):
                by = np.lexsort((within, piece))
                piece, within = piece[by], within[by]
                new = np.ones(len(piece), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (within[1:] != within[:-1] + 1)
                i = np.flatnonzero(new)
                j = np.append(i[1:], len(piece)) - 1
                lo, hi = within[i], within[j] + length
                # what holds for the first of a class holds for its other rows with that id
                cls_of = np.empty(len(order), np.int64)
                cls_of[order] = cls
                of = cls_of[rep[piece[i]]]
                times = np.append(first[1:], len(order))[of] - first[of]
                at = np.repeat(first[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                lo, hi, rows = np.repeat(lo, times), np.repeat(hi, times), order[at]
                same_id = ids[rows] == np.repeat(ids[order[first[of]]], times)
                covers.add(rows[same_id], lo[same_id], hi[same_id])
            yield from covers.batches()

    return run


class _Covers:
    """Covered ranges of pieces, at every place where a text has the piece."""

    def __init__(self, ids: np.ndarray, contents: np.ndarray, at: np.ndarray):
        self.text = _texts(ids, contents)
        self.ids, self.contents = _first_of(ids, contents)
        self.places = np.array([len(x) for x in at], np.int64)
        self.flat = np.concatenate(at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.places) - self.places
        self.found: list[tuple] = []

    def add(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        times = self.places[rows]
        index = np.repeat(self.begin[rows] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        at = self.flat[index]
        self.found.append(
            (np.repeat(self.text[rows], times), at + np.repeat(lo, times), at + np.repeat(hi, times))
        )

    def batches(self) -> Iterator[pa.RecordBatch]:
        text, lo, hi = _united(*(np.concatenate(x) for x in zip(*self.found, strict=True)))
        if len(text):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.ids[text]),
                    pa.array(self.contents[text]),
                    pa.array(lo.astype(np.int32)),
                    pa.array(hi.astype(np.int32)),
                ],
                names=_COVER_NAMES,
            )


def _windows(length: int):
    """Task: single windows of pieces, equal ones of the task once; keyed by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("piece").to_pylist()
            if not raw:
                continue
            size = np.array([len(x) for x in raw], np.int64)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            data = np.frombuffer(b"".join(raw), np.uint8)
            count = size - length + 1
            row = np.repeat(np.arange(len(raw)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places = batch.column("at").to_pylist()
            times = np.array([len(x) for x in places], np.int64)[row]
            flat = np.concatenate([np.array(x, np.int64) for x in places])
            begin = np.cumsum([len(x) for x in places]) - [len(x) for x in places]
            index = np.repeat(begin[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row, within = np.repeat(row, times), np.repeat(within, times)
            at = start[row] + within
            ids, contents = (batch.column(n).to_numpy() for n in ("id", "content"))
            yield from _merged_pieces(
                data,
                at,
                np.full(len(at), length),
                np.zeros(len(at), np.int64),
                mixed(Prefixes(data).of(at, length)),
                _texts(ids, contents)[row],
                *_first_of(ids, contents),
                flat[index] + within,
            )

    return run


def _texts(ids: np.ndarray, contents: np.ndarray) -> np.ndarray:
    """Number of the text that each row is of."""
    order = np.lexsort((contents, ids))
    begin = _starts(ids[order], contents[order])
    out = np.empty(len(ids), np.int64)
    out[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(ids)))
    return out


def _first_of(ids: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and content of each such text."""
    order = np.lexsort((contents, ids))
    row = order[_starts(ids[order], contents[order])]
    return ids[row], contents[row]


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; runs that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: texts compressed, so that less of them is shuffled."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("zipped")
        texts = [press(t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "zipped", pa.array(texts, pa.binary()))


def _zipped(df: DataFrame) -> DataFrame:
    return df.mapInArrow(_zip, df.schema)


def _identified(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with id, whole text as bytes, its digest and 60 bits of that."""
    digest = F.sha2(as_bytes(text), 256)
    return df.select(
        *df.columns,
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)).alias("__id"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("__content"),
        F.unhex(digest).alias("__digest"),
        as_bytes(text).alias("__plain"),
    )


def covers(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int | None = None,
) -> DataFrame:
    """(id, content, at, stop): byte ranges covered by strings that a smaller id has too.

    1. Copies of whole texts are found by digest.
    2. Every window of ``length`` bytes is represented by a sampled place. Samples
       (five bytes of their hashes, packed) are shuffled; texts are told which of
       theirs another text has.
    3. Texts cut out the runs of windows whose samples are repeated. Runs meet by
       sample, and the windows of unequal ones are put into suffix order: a mergesort
       whose comparisons find the common extension by binary search over prefix
       hashes. Equal windows are neighbours then, checked byte by byte.
    4. Runs of very common samples are split into windows that meet by their own content.

    In 2 to 4 a task first merges what it holds twice, so a passage that a third of
    all texts share sends one row per task. Equal windows always have equal samples,
    so nothing is lost by sampling.
    """
    bounded_batches(df.sparkSession)
    rows = _identified(df, doc_id, text).select(
        F.col("__id").alias("id"),
        F.col("__content").alias("content"),
        F.col("__digest").alias("digest"),
        F.octet_length("__plain").alias("n_bytes"),
        F.col("__plain").alias("plain"),
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = parts  # one for each task, to which its rows go directly
    # a copy of a whole text with a smaller id is covered altogether
    narrow = rows.select("id", "content", "digest", "n_bytes")
    firsts = narrow.groupBy("digest").agg(
        F.min("id").alias("least"), F.first("content").alias("content")
    )
    copies = (
        narrow.join(firsts.select("digest", "least"), "digest")
        .where((F.col("id") > F.col("least")) & (F.col("n_bytes") >= length))
        .select("id", "content", F.lit(0).alias("at"), F.col("n_bytes").cast("int").alias("stop"))
    )
    texts = rows.select("content", F.col("plain").alias("__bytes"))
    met = texts.mapInArrow(_sampled(length, gram, slots), _SAMPLES)
    # rows known to be repeated need not meet any others, so they go anywhere
    task = F.when(F.col("known"), F.pmod(F.xxhash64("contents"), F.lit(parts))).otherwise(F.col("slot"))
    told = met.repartitionById(parts, task.cast("int")).mapInArrow(
        _repeated, "content long, slot long, hashes binary"
    )
    # what is known of a text: the smallest id that has it, and its repeated samples
    nothing = F.lit(None).cast("struct<slot:long,hashes:binary>")
    facts = (
        told.select(
            "content",
            F.struct("slot", "hashes").alias("told"),
            F.lit(None).cast("long").alias("least"),
        )
        .unionByName(firsts.select("content", nothing.alias("told"), "least"))
        .groupBy("content")
        .agg(F.collect_list("told").alias("told"), F.collect_set("least").alias("firsts"))
        .where(F.size("told") > 0)
        .select(F.explode("firsts").alias("id"), "content", "told")
    )
    # joined by id too, so larger copies of a text spread over all tasks, where they end
    own = _zipped(rows.select("id", "content", F.col("plain").alias("zipped")))
    marked = own.join(facts.hint("merge"), ["id", "content"]).select(
        "id", "content", "zipped", "told"
    )
    pieces = stored(marked.mapInArrow(_cut_out(length, gram, slots), _PIECES))
    open_ = pieces.where("not cover").drop("cover", "stop")
    if crowd is None:
        crowd = min(max(CROWD[0], pieces.count() // (2 * parts)), CROWD[1])
    crowded = stored(
        open_.groupBy("sample").count().where(F.col("count") > crowd).select("sample")
    )
    calm = (
        open_.join(crowded, "sample", "left_anti")
        .repartition(parts, "sample")
        .sortWithinPartitions("sample")
        .mapInArrow(_matched(length, "sample"), _COVERS)
    )
    # very common samples: windows one by one, so that their texts spread over all tasks
    single = stored(
        open_.join(crowded, "sample", "left_semi")
        .select("id", "content", "at", "piece")
        .mapInArrow(_windows(length), _PIECES)
    )
    dense = (
        single.where("not cover")
        .drop("cover", "stop")
        .repartition(parts, "sample")
        .sortWithinPartitions("sample")
        .mapInArrow(_matched(length, "sample"), _COVERS)
    )
    done = [
        x.where("cover").select("id", "content", F.col("at")[0].alias("at"), "stop")
        for x in (pieces, single)
    ]
    return copies.unionByName(calm).unionByName(dense).unionByName(done[0]).unionByName(done[1])


def _applied(out: list[str], kind: str):
    """Task: texts without their covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            new: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "spans", "kept")}
            for z, found in zip(
                batch.column("zipped").to_pylist(), batch.column("covers").to_pylist(), strict=True
            ):
                whole = unzip(z)
                spans = merged_spans([(r["at"], r["stop"]) for r in found or ()])
                edges = [0, *(x for s in spans for x in s), len(whole)]
                kept = b"".join(
                    whole[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)
                )
                new["n_bytes"].append(len(whole))
                new["n_removed"].append(len(whole) - len(kept))
                new["spans"].append([{"start": i, "stop": j} for i, j in spans])
                new["kept"].append(kept.decode("utf-8", "ignore") if kind == "string" else kept)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in out),
                    pa.array(new["n_bytes"], pa.int64()),
                    pa.array(new["n_removed"], pa.int64()),
                    pa.array(new["spans"], span),
                    pa.array(new["kept"], pa.string() if kind == "string" else pa.binary()),
                ],
                names=[*out, "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def deduplicated(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    crowd: int | None = None,
    keep: tuple[str, ...] | None = None,
    as_text: bool = False,
) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``spans`` (of bytes) and ``kept``.

    Texts are read as UTF-8 bytes. A byte goes if it lies in a string of ``length``
    bytes that also starts in a text with a smaller id; strings are judged on the input.
    ``kept`` holds the bytes left, or with ``as_text`` the whole characters left.

    A null text is empty. A row without an id is behind all others: it removes nothing
    from them and not from other such rows. Rows with the same id do not remove from
    each other, and repeated rows get the same result. Texts shorter than ``length``
    stay as they are. ``keep`` names the columns carried along, by default all; columns
    named like the new ones are replaced.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    out = [c for c in (df.columns if keep is None else keep) if c not in new]
    found = (
        covers(df, doc_id, text, length, gram, crowd)
        .groupBy("id", "content")
        .agg(F.collect_list(F.struct("at", "stop")).alias("covers"))
        .select(F.col("id").alias("__id"), F.col("content").alias("__content"), "covers")
    )
    rows = _zipped(
        _identified(df, doc_id, text).select(
            *out, "__id", "__content", F.col("__plain").alias("zipped")
        )
    )
    kind = "string" if as_text else "binary"
    schema = ", ".join(
        [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in out]
        + ["n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>", f"kept {kind}"]
    )
    joined = rows.join(found.hint("merge"), ["__id", "__content"], "left")
    return joined.mapInArrow(_applied(out, kind), schema)
