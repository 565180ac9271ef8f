"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

SPACE = b" \t\n\v\f\r"


def fingerprint(text: str | None, width: int = 4) -> int:
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def simhash(rows: list[tuple]) -> list[tuple]:
    fps = [fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)]


def suffix(texts: list[str | None], length: int = 200) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def base_counts(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(cover)


def embedding(rows: list[tuple], cosine: float = 0.95) -> list[tuple]:
    good = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    scaled = [np.array(e, float) / np.abs(np.array(e, float)).max() if g else None for (_, e), g in zip(rows, good)]
    unit = [e / np.linalg.norm(e) if g else None for e, g in zip(scaled, good)]
    n, links = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine - 1e-12:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    root = components(len(rows), links)
    least = {}
    for (v, _), r in zip(rows, root):
        if v is not None:
            least[r] = min(least.get(r, v), v)
    return [(v, k, least.get(r), v is not None and v == least.get(r)) for (v, _), k, r in zip(rows, n, root)]
