"""Plain versions of the operators, and a small corpus with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, key string, n_words int"


def corpus(n=60, seed=3):
    """Random texts, exact and near copies, shared passages, repeats within a text, nulls, empty and very long texts."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzéñ", k=draw.randint(2, 9))) for _ in range(400)]
    make = lambda k: draw.choices(vocabulary, k=k)
    passage, base = make(70), make(160)
    texts = [None, "", " \n\t ", "one", "One", "two words", "a b c d", "x " * 120, " ".join(make(9000))]
    for i in range(n):
        words = make(draw.randint(5, 200))
        kind = i % 6
        if kind == 1:
            words = list(base)
            for _ in range(draw.randint(0, 8)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        elif kind == 2:
            words[len(words) // 2 : len(words) // 2] = passage[draw.randint(0, 15) : draw.randint(55, 70)]
        elif kind == 3 and texts:
            texts.append(draw.choice([t for t in texts if t]))
            continue
        elif kind == 4:
            words = words[:60] + words[:60]
        texts.append("".join(w + draw.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words))
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i * 3, t, "xx", None, 1) for i, t in zip(order, texts, strict=True)]


def words(text):
    return WORD.findall(text or "")


def removed(docs, window=50):
    """doc_id: (n_words, n_removed, kept words)."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        own, w = [], words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            h = tuple(w[i : i + window])
            if seen.get(h, doc) < doc:
                gone[i : i + window] = [True] * window
            own.append(h)
        for h in own:
            seen.setdefault(h, doc)
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def shingle_set(text, k=4):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_groups(docs, k=4):
    """doc_id: (set size, least reachable doc_id)."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def base_spans(text):
    text = text or ""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def all_spans(text, ratio, least=20, threshold=15.0, distinct=8):
    """Base spans, and in what is left of runs of key characters the best stretches by log-likelihood ratio: all loops,
    every stretch tried."""
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    text, found = text or "", base_spans(text)
    taken = [any(a <= i < b for _, a, b in found) for i in range(len(text))]
    own = []

    def search(lo, hi):
        if hi - lo < least:
            return
        gain = [0.0]
        for i in range(lo, hi - 1):
            gain.append(gain[-1] + ratio[alphabet.index(text[i])][alphabet.index(text[i + 1])])
        a, b = lo, hi
        if gain[-1] < threshold:
            best = max((gain[j] - gain[i], -j, -i) for j in range(least - 1, hi - lo) for i in range(j - least + 2))
            if best[0] < threshold:
                return
            a, b = lo - best[2], lo - best[1] + 1
            while a > lo and text[a - 1] not in "+/_=-":
                a -= 1
            while b < hi and text[b] not in "+/_=-":
                b += 1
        if len(set(text[a:b])) >= distinct:
            own.append(("markov", a, b))
        search(lo, a)
        search(b, hi)

    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in alphabet and not taken[j]:
            j += 1
        search(i, j)
        i = max(j, i + 1)
    order = ("assign", "access", "hex", "markov")
    return sorted(found + own, key=lambda x: (x[1], order.index(x[0]), x[2]))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams, marked = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def backoff(docs, order=3, alpha=0.4):
    texts = {d: words(t) for d, t in docs}
    own = {d: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for d, w in texts.items()}
    every = sum(own.values(), Counter())
    total, out = sum(map(len, texts.values())), {}
    for d, w in texts.items():
        count = lambda g, d=d: every[g] - own[d][g]
        rest, score = total - len(w), 0.0
        for i in range(len(w)):
            n = min(order, i + 1)
            while n and not count(tuple(w[i - n + 1 : i + 1])):
                n -= 1
                score += math.log(alpha)
            if n:
                g = tuple(w[i - n + 1 : i + 1])
                score += math.log(count(g)) - math.log(count(g[:-1]) if n > 1 else rest)
            elif rest:
                score -= math.log(rest)
        out[d] = (len(w), score)
    return out


def top(vectors, k=20):
    q = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for i in q:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=False)), j) for j in q if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def judge_url(url, rules, fits):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    own = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if own:
        return host, path, max(own)[1], max(own)[2]
    return host, path, None, "block" if fits(host, path) else "allow"


def pairs_by_key(items):
    out = defaultdict(list)
    for key, value in items:
        out[key].append(value)
    return out
