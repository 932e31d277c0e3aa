"""Plain statements of the results, for small tables."""

import hashlib
import re
import zlib

import xxhash

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def contaminated(docs, items, window=13):
    """{doc: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    words = lambda t: ALNUM.findall(lower(t)) if t else []
    of = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of.setdefault(tuple(w[k:k + window]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in of}:
            for k in range(len(w) - size + 1):
                if (got := of.get(tuple(w[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, window):
    """{doc: (n_words, n_removed, kept_sha256)}"""
    words = {d: WORD.findall(t) if t else [] for d, t in docs}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def exact(docs):
    """{doc: (keep_id, group_size, kept, text_sha256)}"""
    digest = {d: sha(WHITE.sub(" ", t or "")) for d, t in docs}
    groups = {}
    for d, h in digest.items():
        groups.setdefault(h, []).append(d)
    return {d: (min(groups[h]), len(groups[h]), d == min(groups[h]), h) for d, h in digest.items()}


def fingerprint(text):
    w = WORD.findall(lower(text)) if text else []
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs):
    """{doc: (fingerprint, component_id)}"""
    bits = {d: fingerprint(t) for d, t in docs}
    out, ids = {}, sorted(bits)
    for start in ids:
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            d = todo.pop()
            for e in ids:
                if e not in out and (bits[d] ^ bits[e]).bit_count() <= 3:
                    out[e] = start
                    todo.append(e)
    return {d: (f"{bits[d]:016x}", out[d]) for d in ids}
