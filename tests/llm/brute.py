"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows):
    strip = "".join(map(chr, [32, *range(9, 14)]))
    key = lambda line: low(line.strip(strip))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            named = {d for d in holders[k] if d is not None}
            if len(k) < 40 or len(named) < 5 or doc == max(named):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def quality_base(text):
    words = WORD.findall(text or "")
    n = len(words)
    runs = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = set()
    for i in range(n - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def robust_distances(x, floors, share, consistent):
    """Squared distances of all rows from the minimum covariance determinant estimate of the group, by plain numpy."""
    at = lambda v, p: np.sort(v)[int(np.ceil(p * len(v))) - 1]
    mid = np.array([at(c, 0.5) for c in x.T])
    spread = np.array([at(np.abs(c - m), 0.5) for c, m in zip(x.T, mid, strict=True)])
    scaled, floored = (x - mid) ** 2 / ((1.4826 * spread) ** 2 + floors**2), (x - mid) ** 2 / floors**2
    best = None
    for d in (scaled.sum(1), floored.sum(1), scaled.max(1)):
        last = np.inf
        while True:
            near = x[d <= at(d, share)]
            cov = np.cov(near.T, bias=True) * consistent + np.diag(floors**2)
            off, det = x - near.mean(0), np.linalg.slogdet(cov)[1]
            d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
            if last - det <= 1e-4:
                break
            last = det
        if best is None or det < best[0] - 1e-9:
            best = det, d
    return best[1]


def simhash(text):
    words = WORD.findall(low(text))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, distance=4):
    fps = np.array([simhash(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(doc, f"{int(fps[i]):016x}", name[find(i)]) for i, (doc, _) in enumerate(rows)]


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, size=13):
    owners = {}
    for item, text in items:
        words = TOKEN.findall(low(text))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        words = TOKEN.findall(low(text))
        hit, found = set(), set()
        for window, of in owners.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= of
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(s[1] for s in spans)
    names = ("assign", "access", "hex")
    return n[0], n[1], n[2], sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def unigrams(rows):
    import math

    tokens = lambda t: [*WORD.findall(low(t)), ""]
    learnt = Counter()
    for doc, text in rows:
        if not held_out(doc):
            learnt.update(tokens(text))
    n, v = sum(learnt.values()), len(learnt)
    return [(doc, held_out(doc), len(tokens(text)), sum(learnt[w] > 0 for w in tokens(text)), n, sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))) for doc, text in rows]
