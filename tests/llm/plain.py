"""Plain forms of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(rows):
    """doc_id -> (set size, smallest reachable id) by all pairs."""
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def removed(rows, k=13):
    """doc_id -> (words, removed, digest of the rest)."""
    first, out = {}, {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, i), i)
    for i, text in rows:
        w = words(text)
        goes = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                goes |= {*range(j, j + k)}
        out[i] = (len(w), len(goes), sha(" ".join(x for j, x in enumerate(w) if j not in goes)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(tri)
    hit = {j for i, t in enumerate(tri) if times[t] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)
