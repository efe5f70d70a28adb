"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def jaccard(docs, n, num, den):
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets[doc] = set(zip(*[words[i:] for i in range(k)])) if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[text or ""].append(doc)
    return sorted(
        (doc, max(groups[text or ""]), len(groups[text or ""]), doc == max(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest())
        for doc, text in docs
    )


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lowered(text))
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i : i + k])].add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, owners = WORD.findall(lowered(text)), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                found = windows.get(tuple(words[i : i + k]))
                if found:
                    hit.update(range(i, i + k))
                    owners |= found
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(owners), digest, bool(hit))
    return out


def repeats(docs, length):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone, end = bytearray(len(data)), 0
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                start = max(i, end)
                gone[start : i + length] = b"\1" * (i + length - start)
                end = i + length
            seen.add(part)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _fits(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    return sorted(
        (m.start(), i, kind, m.end()) for i, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "") if _fits(kind, m.group())
    )


def line_chunks(docs, hash_of, rolling=2, spacing=3, least=2):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        lines = (text or "").split("\n")
        hashes = [hash_of(x) >> 32 for x in lines]
        gone, first = [], 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or i >= rolling and sum(hashes[i - 1 - k] * 31**k for k in range(rolling)) % spacing == 0:
                if i - first >= least:
                    chunk = "\n".join(lines[first:i])
                    if chunk in seen:
                        gone.append((first, i))
                    seen.add(chunk)
                first = i
        kept = "\n".join(x for i, x in enumerate(lines) if not any(a <= i < b for a, b in gone))
        out[doc] = (kept, len(lines), sum(b - a for a, b in gone), len(gone))
    return out


def url_masses(seeds, edges, rounds, mass, damping):
    """Trust (or distrust, on reversed edges) of hosts, in whole numbers."""
    total = sum(seeds.values())
    start = {h: n * mass // total for h, n in seeds.items() if n}
    degree = defaultdict(int)
    for a, _ in edges:
        degree[a] += 1
    now = dict(start)
    for _ in range(rounds):
        new = defaultdict(int, {h: m * (100 - damping) // 100 for h, m in start.items()})
        for a, b in edges:
            if a in now:
                new[b] += now[a] * damping // (100 * degree[a])
        now = dict(new)
    return now
