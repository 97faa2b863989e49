"""Plain answers on the driver, one document after the other, to hold the operators against."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for k, (kind, pattern) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        )
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def component_of(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def embeddings(rows, threshold=0.98):
    ok = {}
    for vec, e, label in rows:
        if label is None or e is None or not len(e) or any(x is None for x in e):
            continue
        v = np.array(e, float)
        if np.isfinite(v).all() and v.any():
            ok[vec] = (label, v / np.linalg.norm(v))
    links = [(a, b) for a, b in combinations(sorted(ok), 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold]
    n, of = Counter(x for p in links for x in p), component_of([r[0] for r in rows], links)
    return [(r[0], n[r[0]], of[r[0]], of[r[0]] == r[0]) for r in rows]


def substring(docs, window=35):
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in docs]
    seen = Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, texts, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def simhash(docs):
    fps = {d: fingerprint(t) for d, t in docs}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    of = component_of(fps, links)
    return [(d, f"{f:016x}", of[d], of[d] == d) for d, f in fps.items()]


def term_spans(docs, share=0.9, doubt=1.0):
    """doc row number -> (start, end) of its terms, by counts over all documents."""
    import math

    import regex

    word = regex.compile(r"\p{L}+")
    placed = [[(m[0].lower(), *m.span()) for m in word.finditer(t or "")] for _, t in docs]
    words = [{w for w, _, _ in p if len(w) > 1} for p in placed]
    base = [base_spans(t) for _, t in docs]
    entities = [{(k, (t or "")[a:b].lower()) for k, a, b in own} for (_, t), own in zip(docs, base, strict=True)]
    n_term, n_entity = Counter(w for x in words for w in x), Counter(e for x in entities for e in x)
    both = Counter((e, w) for x, y in zip(entities, words, strict=True) for e in x for w in y)
    texts = {(e, w): set() for e, w in both}
    for (_, t), x, y in zip(docs, entities, words, strict=True):
        for e in x:
            for w in y:
                texts[e, w].add(t)
    told, sure = set(), set()
    for (e, w), k in both.items():
        n, content = len(texts[e, w]) + n_term[w] - k, -math.log(n_entity[e] / len(docs))
        p = len(texts[e, w]) / n
        low = (p + doubt**2 / (2 * n) - doubt * math.sqrt(p * (1 - p) / n + doubt**2 / (4 * n * n))) / (1 + doubt**2 / n)
        if content > 0 and math.log(k / n_term[w]) + content >= share * content:
            told.add((e, w))
            if k < n_term[w] and low > 0 and math.log(low) + content >= share * content:
                sure.add(w)
    return [
        [(a, b) for w, a, b in p if (w in sure or any((e, w) in told for e in own)) and not any(x < b and a < y for _, x, y in spans)]
        for p, own, spans in zip(placed, entities, base, strict=True)
    ]
