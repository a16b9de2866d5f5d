"""Row-wise models of the operators, written plainly from their contracts."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ["assign", "access", "hex"]
    out.sort(key=lambda s: (s[1], kinds.index(s[0])))
    return [*(sum(s[0] == k for s in out) for k in kinds), digest(out)]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    number = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(number(m)) <= 19 and luhn(number(m))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(number(m)) <= 15],
    }
    return [*(len(v) for v in found.values()), digest([(k, m.start(), m.end()) for k, v in found.items() for m in v])]


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i:i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    joined = "".join(w)
    symbols = sum(c in "#*$%&|<>" for c in joined)
    return [len(w), len(joined), symbols, dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)]


def shingles(text, size):
    w = [a.translate({c: c + 32 for c in range(65, 91)}) for a in words(text)]
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(texts, size, percent):
    """Smallest linked id of every id; ``texts`` maps ids to texts."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    common = Counter()
    holders = defaultdict(list)
    for k, s in sets.items():
        for t in s:
            holders[t].append(k)
    for held in holders.values():
        common.update(itertools.combinations(held, 2))
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def crc(text):
    return zlib.crc32((text or "").encode())
