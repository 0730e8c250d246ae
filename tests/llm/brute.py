"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter


def removal(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lm_base(rows, folds=10):
    import math
    import zlib

    fold = lambda t: (t or "").encode().lower().split()  # noqa: E731  bytes: A-Z only, and just these six spaces
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds != 0
    c = Counter()
    for i, t in rows:
        if train(i):
            c.update(fold(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = [*fold(t), None]
        out.append((i, not train(i), len(tokens), sum(c[x] > 0 for x in tokens), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    return out


def lm_score(rows, order, mu, steps, folds=10):
    """Scores of each row by counts of all n-grams of training texts; those of longer ones than a token are quantised."""
    import math
    import zlib

    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds != 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    texts = sum(train(i) for i, _ in rows)
    # A gram that would begin before its text is the shorter one from the beginning on, told apart from the same words elsewhere.
    read = lambda g, k: 0.0 if not k else float(k) if len(g) == 1 else 2 ** ((1 + math.floor(steps * math.log2(k)) - 0.5) / steps)
    exact = {n: Counter() for n in range(1, order + 1)}
    for i, t in rows:
        if train(i):
            w = tokens(t)
            for at in range(len(w)):
                for n in exact:
                    exact[n][(at < n - 1, *w[max(0, at - n + 1) : at + 1])] += 1
    total, distinct = sum(exact[1].values()), len(exact[1])
    out = []
    for _, t in rows:
        w, score = tokens(t), 0.0
        for at in range(len(w)):
            p = (exact[1][(False, w[at])] + 0.1) / (total + 0.1 * (distinct + 1))
            for n in range(2, order + 1):
                # from the beginning on, a gram of length n is what a shorter one after the beginning makes
                mine = read((0,) * n, exact[n][(at < n - 1, *w[max(0, at - n + 1) : at + 1])])
                if at == 0:
                    before = float(texts)
                else:
                    m = n - 1
                    held = exact[m][(at - 1 < m - 1, *w[max(0, at - m) : at])]
                    before = float(held) if m == 1 else read((0,) * m, held)
                p = (mine + mu * p) / (max(before, mine) + mu)
            score += math.log10(p)
        out.append(score)
    return out


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def near_groups(rows, size, percent=80):
    """{row number: (n_shingles, component_id, kept)}; rows of one id are one document."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = []
    for k, (i, _) in enumerate(rows):
        c = None if i is None else find(i) if sets[k] else i
        out.append((i, len(sets[k]), c, True if c is None else c == i))
    return out


def alnum_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(docs, items, window=13):
    where = []
    for item, text in items:
        w = alnum_words(text) if item is not None else []
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            where.append((str(item), tuple(w[k : k + window])))
    out = []
    for i, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for item, part in where:
            for k in range(len(w) - len(part) + 1):
                if tuple(w[k : k + len(part)]) == part:
                    hit.update(range(k, k + len(part)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def best(vectors, k=5, every=50):
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def secret_base(text):
    """(kind, start, end, start of the match) of base secrets, character by character."""
    text, out, at = text or "", [], 0
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def after(i, few):
        return i + 1 if i < len(text) and text[i] in few else i

    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                i = after(at + len(name), "\"'")
                while i < len(text) and text[i] == " ":
                    i += 1
                if i < len(text) and text[i] in ":=":
                    i += 1
                    while i < len(text) and text[i] == " ":
                        i += 1
                    i = after(i, "\"'")
                    e = i
                    while e < len(text) and text[e] in value:
                        e += 1
                    if e > i:
                        if e - i >= 8:
                            out.append(("assign", i, e, at))
                        end = e
                        break
        at = end or at + 1
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        e = i + 4
        while e < len(text) and ("A" <= text[e] <= "Z" or "0" <= text[e] <= "9"):
            e += 1
        if e == i + 4:
            i += 1
            continue
        if e - i >= 16:
            out.append(("access", i, e, i))
        i = e
    i = 0
    while i < len(text):
        e = i
        while e < len(text) and text[e] in "0123456789abcdef":
            e += 1
        if e - i >= 32:
            out.append(("hex", i, e, i))
        i = max(e, i + 1)
    return out


def secret_digests(text):
    """Counts by kind and the two digests of base spans: with the value of an assignment, and with its whole match."""
    kinds = ("assign", "access", "hex")
    found = secret_base(text)
    joined = lambda which: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((x[which], kinds.index(x[0]), x[0], x[2]) for x in found))
    return (*(sum(x[0] == k for x in found) for k in kinds), *(hashlib.sha256(joined(w).encode()).hexdigest() for w in (1, 3)))


def statistics(text):
    """The quality statistics of a text, in order."""
    import math

    b = (text or "").encode()
    size = max(len(b), 1)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words, lines = low.split(), [x for x in low.split(b"\n") if x]
    usual, odd = b".,;:!?'\"()-", b"#$%&*+/<=>@[]\\^_`{|}~"
    kinds = [
        lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in usual, lambda c: c in odd,
        lambda c: c == 10, lambda c: c in b" \t", lambda c: c >= 128, lambda c: c in b"!?",
    ]
    out = [math.log1p(len(b)), *(sum(map(k, b)) / size for k in kinds)]
    n = max(len(words), 1)
    mean = sum(map(len, words)) / n
    pairs = list(zip(words, words[1:]))
    raw = b.split()
    return [
        *out, mean, math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0)), len(set(words)) / n, sum(x == y for x, y in pairs) / n, len(set(pairs)) / max(len(words) - 1, 1),
        len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), max(Counter(words).values(), default=0) / n,
        sum(any(c in odd for c in w) for w in raw) / n, sum(any(65 <= c <= 90 for c in w) and not any(97 <= c <= 122 or c >= 128 for c in w) for w in raw) / n, sum(any(48 <= c <= 57 for c in w) for w in raw) / n,
        math.log1p(len(words)),
    ]
