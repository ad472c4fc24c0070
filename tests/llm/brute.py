"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def le(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, width=5) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(rows, percent=75) -> list[tuple]:
    """rows: (doc_id, text)."""
    sets = {i: shingle_set(t) for i, t in rows}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    links, seen = [], set()
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    names = components(sets, links)
    return sorted((i, len(sets[i]), names[i], names[i] == i) for i in sets)


def good(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def threshold_links(rows, threshold) -> list[tuple]:
    """rows: (vec_id, embedding, label) with distinct ids."""
    links, count = [], {i: 0 for i, _, _ in rows}
    usable = [(i, v, lab) for i, v, lab in rows if good(v) and lab is not None]
    for k, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[k + 1 :]:
            if lab == other and len(v) == len(w) and cosine(v, w) >= threshold:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    names = components(count, links)
    return sorted((i, count[i], names[i], names[i] == i) for i in count)


def nearest(rows, is_query, k=5) -> dict:
    usable = [(i, v) for i, v in rows if good(v)]
    out = {}
    for q, v in usable:
        if is_query(q):
            scored = sorted((-cosine(v, w), i) for i, w in usable if i != q and len(v) == len(w))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def warc_rows(rows) -> list[tuple]:
    """rows: (page_id, html) with distinct ids."""
    first: dict = {}
    for i, t in rows:
        p = (t or "").encode()
        first[p] = min(first.get(p, i), i)
    out = []
    for i, t in rows:
        p = (t or "").encode()
        revisit = first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out)


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)


def ordinal_fit(rows, grades, n_grades, min_rows=5, epochs=300, rate=0.1, decay=1e-4):
    """Weights by feature number and thresholds: full-batch Adam on a dense matrix, gradients by the chain rule one text at a time."""
    names = sorted({x for r in rows for x in r.tolist()})
    x = np.array([[name in own for name in names] for own in (set(r.tolist()) for r in rows)], float)
    grades = np.asarray(grades)
    often = x.sum(axis=0) >= min_rows
    z = max(2.5, math.sqrt(2 * math.log(max(1, often.sum()))))
    telling = np.zeros(len(names), bool)
    for j in range(1, n_grades):
        off = (grades >= j) - (grades >= j).mean()
        telling |= np.abs(off @ x) >= z * np.sqrt(np.maximum(x.sum(axis=0) * off.var(), 1e-12))
    names, x = [n for n, k in zip(names, often & telling) if k], x[:, often & telling]
    share = np.clip([(grades >= j).mean() for j in range(1, n_grades)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)))
    p = np.concatenate([np.zeros(len(names)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m = v = np.zeros_like(p)
    sigmoid = lambda t: 1 / (1 + math.exp(-t))
    for step in range(1, epochs + 1):
        w, th = p[: len(names)], p[len(names)] + np.append(0, np.cumsum(np.exp(p[len(names) + 1 :])))
        grad, by_theta = decay * np.append(w, np.zeros(n_grades - 1)), np.zeros(n_grades - 1)
        for text, g in zip(x, grades.tolist()):
            s = float(text @ w)
            above = 1.0 if g == 0 else sigmoid(s - th[g - 1])
            below = 0.0 if g == n_grades - 1 else sigmoid(s - th[g])
            chance = max(above - below, 1e-12)
            up, down = above * (1 - above) / chance, below * (1 - below) / chance
            grad[: len(names)] -= (up - down) / len(grades) * text
            if g > 0:
                by_theta[g - 1] += up / len(grades)
            if g < n_grades - 1:
                by_theta[g] -= down / len(grades)
        grad[len(names)] = by_theta.sum()
        for j in range(1, n_grades - 1):
            grad[len(names) + j] = by_theta[j:].sum() * math.exp(p[len(names) + j])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(names, p[: len(names)])), p[len(names)] + np.append(0, np.cumsum(np.exp(p[len(names) + 1 :])))
