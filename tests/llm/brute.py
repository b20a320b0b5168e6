"""Plain Python versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    # without its mark a kind has no match, and the plain patterns would try every start of a long run
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else "")]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if "." in t else "") if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def leaks(docs: list[tuple], items: list[tuple], size: int = 10) -> dict:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    lengths, out = {len(w) for w in windows}, {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def jaccard(rows: list[tuple], size: int, percent: int) -> dict:
    sets, n = {}, {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(ASCII_LOWER))
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        n[i] = len(s)
        if s:
            sets[i] = s
    up = {i: i for i in n}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    by, lists = {}, defaultdict(list)
    for i in sorted(sets):
        s = sets[i]
        if s in by:
            up[max(root(i), root(by[s]))] = min(root(i), root(by[s]))
            continue
        by[s] = i
        shared = Counter(j for x in s for j in lists[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            lists[x].append(i)
    return {i: (n[i], root(i)) for i in n}
