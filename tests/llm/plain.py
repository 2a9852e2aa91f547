"""The pipeline's stages in plain Python over lists of (doc_id, source, text), by direct comparison."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def walk(model, row):
    total = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        total += leaf[node - len(f)]
    return 1 / (1 + np.exp(-total))


def good(docs, model, min_score):
    out = []
    for d, s, t in docs:
        n, chars, symbols, dup, repeat = counts(t)
        words = WORD.findall(t or "")
        n_lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        up, low = len(re.findall("[A-Z]", t or "")), len(re.findall("[a-z]", t or ""))
        shout = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
        row = [np.log1p(n), chars / max(n, 1), symbols / max(chars, 1), dup / max(n_lines, 1), repeat / max(n, 1), up / max(up + low, 1), len(re.findall("[!?.,;:]", t or "")) / max(n, 1), len(re.findall("[0-9]", t or "")) / max(chars, 1), shout / max(n, 1)]
        if n >= 10 and 100 * repeat <= 20 * n and (model is None or walk(model, row) >= min_score):
            out.append((d, s, t))
    return out


def line_windows(text, least):
    rows = [(i, x, len(WORD.findall(x))) for i, x in enumerate((text or "").split("\n")) if WORD.search(x)]
    for a in range(len(rows)):
        total = 0
        for b in range(a, len(rows)):
            total += rows[b][2]
            if total >= least:  # all runs, not only the shortest ones
                yield rows[a][0], rows[b][0], tuple(r[1] for r in rows[a : b + 1])


def without_repeats(docs, least=50):
    first = {}
    for d, _, t in sorted(docs, key=lambda x: x[0]):
        for s, e, c in line_windows(t, least):
            first.setdefault(c, (d, s, e))
    out = []
    for d, src, t in docs:
        gone = set()
        for s, e, c in line_windows(t, least):
            f = first[c]
            if f[0] != d or s > f[2]:
                gone |= set(range(s, e + 1))
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone) if gone else t
        if not gone or WORD.search(left):
            out.append((d, src, left))
    return out


def one_each(docs, threshold=0.8):
    def grams(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = {d: grams(t) for d, _, t in docs}, {d: d for d, _, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in docs if find(r[0]) == r[0]]


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def clean(docs, items):
    windows = {}
    for it in items:
        w = FOLDED.findall(fold(it))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[i : i + 10]), set()).add(tuple(w[i : i + 10]))
    out = []
    for d, s, t in docs:
        at = [m.span() for m in FOLDED.finditer(fold(t))]
        w = [fold(t)[a:b] for a, b in at]
        hit = {j for n, ws in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in ws for j in range(i, i + n)}
        gone = set()
        for j in hit:
            gone |= set(range(*at[j]))
            if j + 1 in hit:
                gone |= set(range(at[j][1], at[j + 1][0]))
        out.append((d, s, "".join(c for i, c in enumerate(t or "") if i not in gone) if gone else t))
    return out


def mixed(docs, weights=(3, 1, 2), share=1.5, passes=2):
    size = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    total, by = sum(size.values()), {}
    for d, s, _ in docs:
        by.setdefault(s, []).append(d)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: passes * sum(size[d] for d in by[s]) for s in names}
    free, left, target = set(names), share * total, {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if cap[s] < level * w[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            free.remove(s)
    copies = []
    for i, s in enumerate(names):
        upto = 0
        for k in range(passes):
            for d in sorted(by[s], key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
                upto += size[d]
                if size[d]:
                    copies.append((upto / target[s], i, k, d))
    used, out = 0, Counter()
    for _, _, _, d in sorted(copies):
        used += size[d]
        if used > share * total:
            break
        out[d] += 1
    return out
