"""Plain Python for what the operators compute, row by row, to hold them against."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_rows(docs, tok):
    """docs: (doc_id, text), doc_ids distinct."""
    out, start = {}, 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def targets(sizes):
    """sizes: source -> words. Shares by weight, what is above 3 times the size shared anew until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def xx(*values):
    """Spark's xxhash64: a long is 8 bytes, an int (given as (value,)) 4, null leaves the seed as it is."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def permuted(i, n, *key):
    """Swap-or-not: a place's own place or its mirror, by a hash of the larger one, round after round."""
    for r in range(16):
        other = (xx(*key, (r,)) % n - i) % n
        if xx(*key, (r,), max(i, other), (7,)) % 2 == 0:
            i = other
    return i


def taken(docs, quotas, block_words, seed=11):
    """docs: (doc_id, text, source), quotas: source -> (sid, slots, blocks) -> doc_id: words taken. Documents stand in runs
    by hash, blocks are cut from their words, and each slot takes one block."""
    out = {}
    for source, (sid, slots, blocks) in quotas.items():
        own = [(d, xx(t, s), len(WORD.findall(t or ""))) for d, t, s in docs if s == source]
        runs = -(-len(own) // 1000)
        own.sort(key=lambda r: (xx(r[0], r[1]) % runs, r[0], r[1]))
        times = Counter(permuted(i % blocks, blocks, (seed,), (sid,), i // blocks) for i in range(slots))
        at = 0
        for d, _, size in own:
            out[d] = sum(times[w // block_words] for w in range(at, at + size))
            at += size
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def kept_rows(docs):
    """docs: (doc_id, text, lang, source) -> doc_id: kept. Sketches are dicts; a group's leans on its language's with 200
    documents, and that one on the sketch of all."""
    rows, sketch = {}, {}
    for d, text, lang, source in docs:
        n, chars, symbols, dups, repeats, failed = base_counts(text)
        lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
        shout = len(re.findall(r"[A-Z!?_^~]", text or ""))
        rows[d] = (failed, lang, source, {"symbols": (symbols, chars, 1), "word_length": (chars, n, 1), "shouting": (shout, chars, 1), "dup_lines": (dups, lines, 1), "repeats": (repeats, n, 8)})
        for rule, (k, m, _) in rows[d][3].items() if not failed else ():
            x = k / max(m, 1)
            bucket = 0.0 if x <= 0.01 else 1.02 ** math.ceil(math.log(x) / math.log(1.02))
            for key in ((rule,), (rule, lang), (rule, lang, source)):
                sketch.setdefault(key, Counter())[bucket] += 1
    leaning = dict(sketch)
    for key in sorted(sketch, key=len)[5:]:
        parent = leaning[key[:-1]]
        leaning[key] = {b: sketch[key].get(b, 0) + 200 * parent[b] / sum(parent.values()) for b in parent}

    def at(key, q):
        upto, total = 0.0, sum(leaning[key].values())
        for b in sorted(leaning[key]):
            upto += leaning[key][b]
            if upto / total + 1e-9 >= q:
                return b

    out, cuts = {}, {}
    for d, (failed, lang, source, ratios) in rows.items():
        bad = failed
        for rule, (k, m, unit) in ratios.items() if not failed else ():
            key = (rule, lang, source)
            if key not in cuts:
                lower, middle, upper = (at(key, q) for q in (0.1, 0.5, 0.9))
                cuts[key] = ((lower - 3 * (middle - lower)) / 1.02 - 0.01, upper + 3 * (upper - middle) + 0.01)
            error = 3 * math.sqrt(k / unit) / (max(m, 1) / unit)
            bad |= k / max(m, 1) - error > cuts[key][1] or (rule == "word_length" and k / max(m, 1) + error < cuts[key][0])
        out[d] = not bad
    return out


def warc_rows(pages, least=0):
    """pages: (page_id, html)."""
    first = {}
    for page_id, html in pages:
        body = (html or "").encode()
        if page_id is not None and len(body) >= least:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, html in pages:
        body = (html or "").encode()
        ref = first.get(body)
        ref = None if ref == page_id else ref
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if ref is None else "revisit", ref))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def pii_row(text):
    spans = base_spans(text)
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(said.encode()).hexdigest(), said)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked(docs):
    """docs: (doc_id, text), doc_ids distinct -> doc_id: (n, component). Only pairs that share a shingle are looked at."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for d in sorted(sets):
        if sets[d]:
            up[d] = first.setdefault(sets[d], d)
    by = {}
    reps = [d for d in sorted(sets) if up[d] == d and sets[d]]
    for d in reps:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    common = Counter((a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def contamination(docs, items):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: rx.findall((t or "").translate(LOWER))
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = {}
    for d, text in docs:
        w = words(text)
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    who |= got
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out
