"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(n)), strict=False))


def components(docs, n, percent):
    """{key: component} over (key, text); keys are compared for the smallest."""
    sets = {k: shingles(t, n) for k, t in docs}
    label = {k: k for k in sets}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def base_spans(text):
    """(start, kind rank, kind, end) of the four base kinds by their plain patterns."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        doubled = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        if 12 <= len(d) <= 19 and doubled % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
