"""Brute-force versions of the training-data operators, in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def exact(rows):
    """[(doc_id, text)] -> [(doc_id, keep_id, group_size, sha256)]"""
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    return [
        (i, min((x for x in groups[n] if x is not None), default=None), len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
        for i, n in ((i, SPACES.sub(" ", t or "")) for i, t in rows)
    ]


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), n, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(BASE[n][0], a, b) for a, n, b in sorted(out)]


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: order of kinds, weak patterns, group of parts
ORDER = ["assign", "access", "hex", "ident", "endpoint", "blob"]
WEAK = {
    "ident": (re.compile(r"""(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", re.I | re.A), 2, 3),
    "endpoint": (re.compile(r"(https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9_.:@-]+"), 0, 8),
    "blob": (re.compile(r"[A-Za-z0-9+/]{20,}"), 0, 20),
}
PART = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}


def all_spans(text, scope=200):
    base = base_spans(text)
    weak = []
    for kind, (pattern, group, least) in WEAK.items():
        for m in pattern.finditer(text or ""):
            if len(m[group]) < least:
                continue
            if kind == "blob" and not all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                continue
            if any(a < m.end() and m.start() < b for _, a, b in base):
                continue
            weak.append((kind, m.start(), m.end()))
    parts = base + weak
    out = list(base)
    for kind, a, b in weak:
        want = {"identifier", "endpoint"} if PART[kind] == "secret" else {"secret"}
        if any(PART[k] in want and abs(s - a) <= scope for k, s, _ in parts):
            out.append((kind, a, b))
    return sorted(out, key=lambda x: (x[1], ORDER.index(x[0]), x[2]))


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, bits=4):
    """[(doc_id, text)] -> {doc_id: (fingerprint, component)} by all pairs."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    return components(prints, bits)


def components(prints, bits=4):
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return {i: (f"{f:016x}", least[find(f)]) for i, f in prints}


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(u, rules):
    host, path = url(u)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: size} -> {source: target}; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, list(order)
    left = float(total)
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
        free = [s for s in free if s not in over]
        left = total - sum(out.values())
    return out
