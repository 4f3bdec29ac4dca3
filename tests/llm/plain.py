"""Plain versions of the operators, one document after another, to hold results against."""

import re
from collections import Counter
from itertools import combinations

SPACE = r"[\x20\x09-\x0D]"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs, n, p, q):
    """{doc_id: (size, component)} of {doc_id: text}."""
    sets = {}
    for i, text in docs.items():
        w = words(lower(text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def dedup_lines(docs):
    """{doc_id: text without later occurrences of windows of three lines, or of all lines if fewer}."""
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        lines = (docs[i] or "").split("\n")
        at = [k for k, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)]
        for held in zip(at, at[1:], at[2:]) if len(at) > 2 else [at] if at else []:
            window, a, c = tuple(lines[k] for k in held), held[0], held[-1]
            if window in first:
                own, end = first[window]
                gone[i].update(range(max(a, end + 1) if own == i else a, c + 1))
            else:
                first[window] = i, c
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    held = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held)


def secrets(text, rules, least):
    found = []
    for kind, (name, pattern) in enumerate(rules.items()):
        group, size = least.get(name, (0, 0))
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= size]
    return sorted(found)


def masked(text, spans, mark):
    at, out = 0, ""
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]
