"""Plain versions of the operators' contracts."""

import hashlib
import math
import re
import zlib


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def contamination(docs, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = {}
    for item, text in items:
        w = word.findall(lower(text))
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def targets(sizes):
    """{source: words} to {source: target}, resharing step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return out


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(docs, percent=90):
    """{place: (n_shingles, component id)} by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return {i: (len(sets[i]), least[root(i)]) for i in range(len(docs))}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 if x > 4 else x * 2 for x in d[1::2])) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
SECRETS = [
    ("assign", r"(?a)([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def spans(text, kinds, whole):
    found = []
    for k, (_, pattern, good) in enumerate(kinds):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if good(m if whole else m[0])]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def top_k(vectors, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for q, a in good:
        if q % 20 == 0:
            asked[q] = min(asked.get(q, a), a)
    for q, a in asked.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)
