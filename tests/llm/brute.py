"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def order(doc):
    return (doc is not None, doc or 0)


def byte_repeats(docs, width=100):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            key = b[i : i + width]
            first[key] = min(first.get(key, (order(d), i)), (order(d), i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (order(d), i):
                gone[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def without_repeats(docs, width=100):
    """Texts without the characters of which every byte is covered."""
    first, out = {}, []
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            key = b[i : i + width]
            first[key] = min(first.get(key, (order(d), i)), (order(d), i))
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (order(d), i):
                gone[i : i + width] = b"\1" * width
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((d, None if t is None else "".join(kept)))
    return out


def word_repeats(docs, width=50):
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def contamination(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = lower_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = lower_words(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)))
    return out


def shingle_bag(text, n=5):
    w = re.findall(r"[^ \t-\r]+", text or "")
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (Counter([tuple(w)]) if w else Counter())


def components(nodes, linked):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def near_classes(docs, least=0.8):
    bags = {d: shingle_bag(t) for d, t in docs}
    links = []
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both and both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= least:
                links.append((a, b))
    return components(ids, links)
