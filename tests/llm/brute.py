"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def near_components(docs):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for group in by_set.values():
        for i in group:
            a, b = find(i), find(group[0])
            parent[max(a, b)] = min(a, b)
    reps = [g[0] for g in by_set.values()]
    index = defaultdict(list)
    for i in reps:
        for x in sets[i]:
            index[x].append(i)
    shared = Counter()
    for i in reps:
        c = Counter(j for x in sets[i] for j in index[x] if j < i)
        for j, n in c.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert not shared
    return {i: (len(s), find(i)) for i, s in sets.items()}


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)
    return {"n_assign": sum(k == 0 for _, k, _ in found), "n_access": sum(k == 1 for _, k, _ in found),
            "n_hex": sum(k == 2 for _, k, _ in found), "base_sha256": hashlib.sha256(joined.encode()).hexdigest()}


def lm_base(docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    toks = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in docs]
    c = Counter(x for i, ts in toks if not held[i] for x in ts)
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(ts), sum(c[x] > 0 for x in ts), n,
             sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for i, ts in toks]


def repeats(texts, length=200):
    """Per text: n_bytes, n_removed, n_spans, sha256 of what is left."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, span=13):
    windows = defaultdict(set)
    for item_id, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item_id)
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i:i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        names = sorted("" if x is None else str(x) for x in found)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
