"""What the operators must return, in plain Python over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = " \t\n\r\x0b\x0c"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_dedup(rows, min_chars=40, least=5):
    keys = [[lower(x.strip(SPACE)) for x in (t or "").split("\n")] for _, t in rows]
    docs = defaultdict(set)
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            if len(k) >= min_chars:
                docs[k].add(i)
    keeper = {k: max(d, key=lambda i: (i is not None, i or 0)) for k, d in docs.items() if len(d) >= least}
    out = []
    for (i, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if k not in keeper or keeper[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode())))
    return out


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        at = defaultdict(list)
        for p in range(len(w) - 7):
            at[tuple(w[p : p + 8])].append(p)
        covered = {q for v in at.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return out


def contamination(rows, items, window=13):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = defaultdict(set)
    for name, t in items:
        w = cut(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[p : p + window])].add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                names = windows.get(tuple(w[p : p + n]))
                if names:
                    found |= names
                    hit[p : p + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), sha256(",".join(sorted(found)).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[p : p + 3]) for p in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """(doc_id, fingerprint, component_id) of each row."""
    find = simhash_find(rows)
    low = {}
    for i, t in rows:
        if i is not None:
            r = find(fingerprint(t))
            low[r] = min(low.get(r, i), i)
    return [(i, f"{fingerprint(t):016x}", low.get(find(fingerprint(t)))) for i, t in rows]


def simhash_groups(rows):
    """How many components there are; rows without an id, or with one id, may be in several."""
    find = simhash_find(rows)
    return len({find(fingerprint(t)) for _, t in rows})


def simhash_find(rows):
    fps = sorted({fingerprint(t) for _, t in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x, a in enumerate(fps):
        for b in fps[:x]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return find


def repeats(rows, size=200):
    texts = [(t or "").encode() for _, t in rows]
    at = defaultdict(list)
    for k, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            at[t[p : p + size]].append((k, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for v in at.values():
        if len(v) > 1:
            for k, p in v:
                gone[k][p : p + size] = True
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((i, len(t), int(g.sum()), spans, sha256(np.frombuffer(t, np.uint8)[~g].tobytes())))
    return out


def warc(rows, least=1000):
    raw = [(h or "").encode() for _, h in rows]
    top = {}
    for (i, _), h in zip(rows, raw):
        if i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for (i, _), h in zip(rows, raw):
        to = top.get(h) if len(h) >= least and top.get(h) != i else None
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "response" if to is None else "revisit", to))
    return out


def token_ids(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(token_ids, "t"):
        token_ids.t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return np.array(token_ids.t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def base_scores(rows):
    import math

    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    out_ = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for t, o in zip(tokens, out_) if not o for w in t)
    n, v = sum(count.values()), len(count)
    return [
        (i, o, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
        for (i, _), t, o in zip(rows, tokens, out_)
    ]
