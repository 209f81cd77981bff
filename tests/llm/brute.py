"""Plain statements of what the corpus operators must return, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate(UPPER_TO_LOWER)


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def substring(rows, window=50):
    """(id, words, removed, hash of kept) per row with an id."""
    rows = [(i, words(t)) for i, t in rows if i is not None]
    first = {}
    for i, w in rows:
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in rows:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out)


def byte_spans(rows, length=400):
    rows = [(i, (t or "").encode()) for i, t in rows if i is not None]
    seen = Counter(b[j:j + length] for _, b in rows for j in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def shingles(text, n):
    w = words(low(text))
    return {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n=4, up=80):
    """{id: (set size, component)}; rows sharing an id must share a text."""
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    met = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    up_ = {i: i for i in sets}

    def root(x):
        while up_[x] != x:
            x = up_[x]
        return x

    for (a, b), k in met.items():
        if 100 * k >= up * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((root(a), root(b)))
            up_[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(rows, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {}
    for i, t in items:
        w = re.findall(pattern, low(t))
        if i is not None and w:
            wins.setdefault(i, set()).update(tuple(w[j:j + window]) for j in range(max(1, len(w) - window + 1)))
    out = []
    for i, t in rows:
        if i is None:
            continue
        w, hit, found = re.findall(pattern, low(t)), set(), set()
        for item, mine in wins.items():
            for x in mine:
                for j in range(len(w) - len(x) + 1):
                    if tuple(w[j:j + len(x)]) == x:
                        hit.update(range(j, j + len(x)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def spelling(rows, length=6, least=5, ratio=5):
    """{word: (form, root, n, n_near, form_n)}."""
    import zlib

    n = Counter()
    for i, t in rows:
        if i is None:
            continue
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            word = low(run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= least}
    holes = defaultdict(set)  # words without the code point at a position
    for w in n:
        for j in range(len(w)):
            holes[w[:j] + w[j + 1:], j].add(w)
    near = {w: {x for j in range(len(w)) for x in holes[w[:j] + w[j + 1:], j]} - {w} for w in n}
    for w in n:
        for j in range(len(w)):
            shorter = w[:j] + w[j + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), None if form[w] is None else n[form[w]]) for w, k in n.items()}


def ranked(rows, items, top=10):
    """(item_id, rank, doc_id, score)."""
    import math

    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))

    docs = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in rows if i is not None) if w]
    n, total = len(docs), sum(k for _, _, k in docs)
    df = Counter(t for _, w, _ in docs for t in w)
    out = []
    for item, text in sorted({x for x in items if x[0] is not None and x[1] is not None}):
        scored = []
        for i, w, k in docs:
            m = 100 - 75 + (75 * k * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w[t]) // (1000 * w[t] + 8 * m))
                    for t in terms(text) if t in w)
            if s > 0:
                scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def fingerprint(text, shingle=3):
    from xxhash import xxh64_intdigest

    w = words(low(text))
    hashes = [xxh64_intdigest(" ".join(w[j:j + shingle]).encode(), 42) for j in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, radius=2):
    """(doc_id, fingerprint, component_id); rows that share a doc_id are one node."""
    rows = [(i, fingerprint(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if i < j and (f ^ g).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((i, f"{f:016x}", root(i)) for i, f in rows)
