"""Plain versions of what the text operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def repeats(docs: list[tuple], length: int = 50) -> list[tuple]:
    """(id, bytes, removed, spans, digest of the rest); rows in, rows out."""
    rows = [(float("inf") if i is None else i, (t or "").encode()) for i, t in docs]
    least: dict[bytes, float] = {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            piece = b[p : p + length]
            least[piece] = min(i, least.get(piece, i))
    out = []
    for (doc_id, _), (i, b) in zip(docs, rows, strict=True):
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                mask[p : p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mask)))
        out.append((doc_id, len(b), sum(mask), spans, sha(kept)))
    return out


def simhash(text: str | None) -> int:
    w = _RUN.findall((text or "").translate(_LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def linked(fps: dict[int, int], bits: int = 2) -> dict[int, int]:
    """Smallest id reachable by links."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])] |= set() if item is None else {str(item)}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k : k + size]))
                if ids is not None:
                    found |= ids
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def lz78(text: str) -> set[str]:
    known, piece = set(), ""
    for c in text:
        piece += c
        if piece not in known:
            known.add(piece)
            piece = ""
    return known


def shingle_sets(docs):
    """Five-word shingles of (id, text) pairs."""
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        out[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def shingle_groups(docs):
    """Smallest id of each text's component: all pairs with similarity 0.8 or more are links."""
    sets, root = shingle_sets(docs), {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def licence_labels(text, templates, threshold, stride):
    """Labels of every run of 2 * stride words: what a template is contained in, the closest first."""
    w, found, best = words(text), set(), 0.0
    sets = [(label, set(words(notice))) for label, notice in templates]
    for first in range(0, len(w), stride):
        block = set(w[first : first + 2 * stride])
        hits = [
            (len(block & t) / len(t), len(block & t), label, block & t)
            for label, t in sets
            if len(block & t) >= threshold * len(t) - 1e-9
        ]
        for share, n, label, held in hits:
            if not any((o[0], o[1]) > (share, n) and held <= o[3] for o in hits):
                found.add(label)
                best = max(best, share)
    return found, best
