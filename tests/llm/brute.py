"""Plain Python answers that the operators' results are held against."""

import hashlib
import re
import zlib

import numpy as np
import regex
import xxhash

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
UNITS = regex.compile(r"(?V1)[[\p{L}\p{M}\p{N}]--[%s]]{1,12}+|[^\x20\x09-\x0D]" % UNSPACED)


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def pii(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)."""
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    keep = {
        "email": [m for m in re.finditer(EMAIL, text)],
        "ip": [m for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m for m in re.finditer(CARD, text) if 16 <= len(only(m)) <= 19 and luhn(only(m))],
        "phone": [m for m in re.finditer(PHONE, text) if 8 <= len(only(m)) <= 15],
    }
    flat = ",".join(f"{k}:{m.start()}:{m.end()}" for k, v in keep.items() for m in v)
    return (*[len(v) for v in keep.values()], hashlib.sha256(flat.encode()).hexdigest())


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    keep = [[m for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6],
            [m for m in re.finditer(ACCESS, text) if len(m[0]) >= 20],
            [m for m in re.finditer(HEX, text) if len(m[0]) >= 24]]
    spans = sorted((m.start(), o, m.end()) for o, v in enumerate(keep) for m in v)
    flat = ",".join(f"{('assign', 'access', 'hex')[o]}:{s}:{e}" for s, o, e in spans)
    return (*[len(v) for v in keep], hashlib.sha256(flat.encode()).hexdigest())


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, radius=3):
    """{doc_id: (fingerprint, component)} by comparing all pairs."""
    ids, fps = [d for d, _ in rows], np.array([simhash(t) for _, t in rows], np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            if a != b:
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (int(fps[i]), least[root(i)]) for i, d in enumerate(ids)}


def winnow(text, k=5, w=8, modulus=(1 << 31) - 1, base=1_000_003):
    """[(hash, position)] by trying every window; units are words, code points of unspaced scripts, single signs."""
    u = []
    for x in UNITS.findall((text or "").lower()):
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        u.append((h - (1 << 64) if h >> 63 else h) % modulus)

    def gram(part):
        a = 0
        for x in part:
            a = (a * base + x) % modulus
        return a

    if not u:
        return []
    grams = [gram(u[i:i + k]) for i in range(len(u) - k + 1)] or [gram(u)]
    out = []
    for s in range(max(1, len(grams) - w + 1)):
        at = min(range(s, min(s + w, len(grams))), key=lambda i: (grams[i], -i))
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


def edits(rows):
    """{doc_id: (n_chars, edited text, fingerprint, edited fingerprint, near_edited, near_next)}."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}

    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[:len(t) - cut] + nxt[:cut]
        a, b = winnow(t), winnow(e)
        out[d] = (len(t), e, a, b, near(a, b), near(a, winnow(nxt)))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
