"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def _all(pattern, text, keep, group=0):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if keep(m)]


def digest(spans, kinds):
    flat = sorted((s, kinds.index(k), e, k) for k, found in spans.items() for s, e in found)
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in flat).encode()).hexdigest()


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(number):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def pii(text):
    return {
        "email": _all(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True),
        "ip": _all(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": _all(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
        "phone": _all(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 10 <= len(_digits(m)) <= 15),
    }


def secrets(text):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    return {
        "assign": _all(rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, lambda m: len(m[2]) >= 12),
        "access": _all(r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 18),
        "hex": _all(r"[0-9a-f]+", text, lambda m: len(m[0]) >= 16),
    }


def phrases(text, table):
    w = words(text)
    return w, [(i, label) for p, label in table for i in range(len(w) - len(p.split()) + 1) if w[i : i + len(p.split())] == p.split()]


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]"""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit.update(range(i, i + n))
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def near_windows(docs, items, apart=2):
    """[(doc_id, n_near)]: places of whole windows whose two rarest words and all but at most ``apart`` others stand in place."""
    split = [(item, words(text)) for item, text in dict.fromkeys(items) if item is not None and words(text)]
    used = {w for _, x in split for w in x}
    count = Counter(w for _, text in docs for w in words(text) if w in used)
    out = []
    for doc, text in docs:
        w, n = words(text), 0
        for _, x in split:
            for start in range(len(x) - 9):
                part = x[start : start + 10]
                rare = sorted(range(10), key=lambda i: (count[part[i]], i))[:2]
                for at in range(-9, len(w)):
                    same = [0 <= at + i < len(w) and w[at + i] == part[i] for i in range(10)]
                    n += all(same[i] for i in rare) and 10 - apart <= sum(same) < 10
        out.append((doc, n))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def components(docs):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d)) for d, s in sets.items()}
