"""Brute-force, row-at-a-time implementations of the reference semantics (pure
Python, for small fixtures only) used to check the Spark operators."""

from __future__ import annotations

from collections import defaultdict

NULL_FIRST = (0,)


def _key(v):
    # Sort key with NULLs first (Spark's ascending default).
    return (0,) if v is None else (1, v)


def exposure_index(rows, id_col="user_id", order=("timestamp",)):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[id_col]].append(i)
    out = {}
    for ids in groups.values():
        ids.sort(key=lambda i: tuple(_key(rows[i][c]) for c in order))
        for n, i in enumerate(ids, 1):
            out[i] = n
    return out


def reach_table(rows, id_col="user_id", demos=(), weighted=False):
    """First exposure per id = smallest (timestamp, demos, weight)."""
    demos = list(demos)

    def w(r):
        return (r["weight"] or 0) if weighted else 1

    first = {}
    for r in rows:
        k = (tuple(_key(r[c]) for c in ["timestamp", *demos]) + ((_key(r["weight"]),) if weighted else ()))
        cur = first.get(r[id_col])
        if cur is None or k < cur[0]:
            first[r[id_col]] = (k, r)
    slots = defaultdict(lambda: [0, 0])
    for r in rows:
        slots[tuple(r[c] for c in demos) + (r["timestamp"],)][1] += w(r)
    for _, r in first.values():
        slots[tuple(r[c] for c in demos) + (r["timestamp"],)][0] += w(r)
    out = []
    by_seg = defaultdict(list)
    for k, v in slots.items():
        by_seg[k[:-1]].append((k[-1], v))
    for seg, items in by_seg.items():
        items.sort(key=lambda kv: _key(kv[0]))
        cr = ci = 0
        for ts, (ri, ii) in items:
            cr += ri
            ci += ii
            out.append((*seg, ts, ri, ii, cr, ci))
    return sorted(out, key=repr)


def frequency_table(rows, id_col="user_id", demos=()):
    demos = list(demos)
    total = defaultdict(int)
    segs = defaultdict(set)
    for r in rows:
        total[r[id_col]] += 1
        segs[r[id_col]].add(tuple(r[c] for c in demos))
    counts = defaultdict(int)
    for i, f in total.items():
        for s in segs[i]:
            counts[(*s, f)] += 1
    return sorted(((*k, v) for k, v in counts.items()), key=repr)
