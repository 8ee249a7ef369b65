"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints: list[tuple[int | None, int]], bits: int = 4) -> list[int | None]:
    """The least id of each row's component, all pairs compared."""
    kinds = sorted({f for _, f in prints})
    root = {f: f for f in kinds}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= bits:
                root[top(a)] = top(b)
    least: dict[int, int] = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return [least.get(top(f)) for _, f in prints]


def counts(text: str | None) -> tuple:
    from collections import Counter

    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def repeated_spans(rows: list[tuple], units, least: int) -> list[list[tuple[int, int]]]:
    """What each row (doc_id, text) loses, rows in rank order."""
    seen, out = set(), []
    for _, text in rows:
        found = list(units(text or ""))
        flags = []
        for u in found:
            flags.append(u[0] in seen)
            seen.add(u[0])
        spans, i = [], 0
        while i < len(found):
            j = i
            while j < len(found) and flags[j]:
                j += 1
            if j > i and sum(u[3] for u in found[i:j]) >= least:
                spans.append((found[i][1], found[j - 1][2]))
            i = max(j, i + 1)
        out.append(spans)
    return out
