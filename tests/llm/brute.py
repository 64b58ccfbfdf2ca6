"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> bytes:
    return b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in (text or "").encode())


def words(text: str | None) -> list[bytes]:
    return ALNUM.findall(lower(text))


def contaminated(docs, benchmark, size=10):
    """doc rows -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in benchmark:
        ws = words(text)
        if ws:
            n = min(size, len(ws))
            for i in range(len(ws) - n + 1):
                windows.setdefault(tuple(ws[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, items = words(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (got := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= got
        out.append((doc, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def longest_match(doc, item, size=10):
    """(item's word, word, length) of the longest common run of words that holds a window; None without."""
    a, b = words(doc), words(item)
    least = min(size, len(b))
    best = None
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= max(1, least) and (best is None or (-n, i, j) < (-best[2], best[1], best[0])):
                best = (j, i, n)
    return best


def licences(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    ws = words(text)
    phrases = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(ws)):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def notices(text, templates, cover=0.6):
    """(label, place, share) of every template at every place."""
    ws, out = words(text), []
    for label, body, must in templates:
        body = words(body)
        phrases = []
        for phrase in map(words, must):
            at = next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)
            phrases.append((at, phrase))
        for begin in range(-len(body), len(ws)):
            if all(begin + p >= 0 and ws[begin + p : begin + p + len(x)] == x for p, x in phrases):
                share = sum(0 <= begin + k < len(ws) and ws[begin + k] == w for k, w in enumerate(body)) / len(body)
                if share >= cover:
                    out.append((label, begin, share))
    return sorted(out)


def repeats(texts, size=200):
    """For each text: (n_bytes, n_removed, n_spans, kept bytes)."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - size + 1):
            k = d[i : i + size]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def runs(words, least=6, times=4):
    """(start, length, period) of the runs of a sequence, every period tried."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            part = words[start : start + length]
            if i > start and length >= max(least, times * q) and all(part[p:] != part[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """A row of op13_runs."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def trie(conversations):
    """Rows of op11_trie from {id: [(role, text), ...]}, already rebuilt."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def below(node):
        leaves, saved = int(node not in kids), (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for k in kids.get(node, []):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(conversations[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), *below(node), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def rebuilt(conversations):
    """{id: turns} with the first turns of the hundred's first conversation."""
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        out[c] = conversations.get(base, [])[:h] + turns[h:]
    return out
