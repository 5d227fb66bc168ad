"""Plain versions of the operators, for small tables. Rows are (doc_id, text), texts may be None."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LAST = 2**63


def key(doc_id):
    return LAST if doc_id is None else doc_id


def words(text):
    return WORD.findall(text or "")


def runs(flags):
    return [i for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1])]


def repeated_strings(rows, length=50):
    """(id, bytes, removed, spans, sha256 of the rest) of each row."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, LAST), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = [True] * length
        out.append((d, len(b), sum(gone), len(runs(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def repeated_windows(rows, width=20):
    """(id, words, removed, sha256 of the kept words)."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            first[s] = min(first.get(s, (LAST + 1, 0)), (key(d), i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (key(d), i):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def base_counts(text):
    """words, word characters, symbols, repeated lines, repeated words, failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(rows):
    """(id, shingles, component) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), LAST), key(d))
    return [(d, len(sets[i]), None if least[root(i)] == LAST else least[root(i)]) for i, (d, _) in enumerate(rows)]


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """(start, kind, end) of the base kinds, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def edited(rows):
    """(id, characters, sha256 of the edited text), rows in the order of their ids, then texts."""
    order = sorted(rows, key=lambda r: (key(r[0]), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    return out


def fewest_bins(sizes, capacity):
    """A lower bound of the number of bins (Martello and Toth): pieces that cannot share a bin, and what must stand beside them."""
    best = -(-sum(sizes) // capacity)
    for a in range(1, capacity // 2 + 1):
        alone = sum(s > capacity - a for s in sizes)
        large = [s for s in sizes if capacity // 2 < s <= capacity - a]
        small = sum(s for s in sizes if a <= s <= capacity // 2)
        best = max(best, alone + len(large) + max(0, -(-(small - (len(large) * capacity - sum(large))) // capacity)))
    return best


def targets(sizes, max_repeats=3, weights=(5, 2, 1)):
    """source -> target: shared by weight, cut at the cap, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > max_repeats * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(max_repeats * sizes[s])
            open_.remove(s)
    return target
