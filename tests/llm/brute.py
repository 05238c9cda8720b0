"""Plain versions of the contracts, one row at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held(doc_id, modulus, value):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == value


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        d = int(d) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_pii(text):
    text = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    found = [("email", email), ("ip", ip), ("card", card), ("phone", phone)]
    return [len(s) for _, s in found], [f"{k}:{a}:{b}" for k, spans in found for a, b in spans]


def pieces(model, text):
    ids = model.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else "")


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), n < 50 or 100 * len(inside) > 50 * n


def unigram(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: WORD.findall(low(t)) + ["\n"] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 5, 1) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held(i, 5, 1), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for i, ws in tokens.items()
    }


def fingerprint(text):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """prints: (doc_id, fingerprint) -> [(doc_id, hex, component)]."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for d, f in prints:
        k = find(f)
        least[k] = d if least[k] is None else min(d, least[k])
    return [(d, f"{f:016x}", least[find(f)]) for d, f in prints]


def similar_groups(docs, share=0.8, width=5):
    """doc_id -> least doc_id reachable over texts whose sets of word shingles are similar; equal sets count once."""
    sets = {}
    for d, t in docs:
        words = low(t).split()
        key = frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
        sets.setdefault(key, []).append(d)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, k in enumerate(keys):
        common = Counter(j for g in k for j in holders[g])
        for j, n in common.items():
            if n >= share * (len(k) + len(keys[j]) - n):
                root[find(i)] = find(j)
        for g in k:
            holders[g].append(i)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min([least.get(find(i)), *sets[k]] if find(i) in least else sets[k])
    return {d: least[find(i)] for i, k in enumerate(keys) for d in sets[k]}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contamination(docs, items, width=10):
    wins = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            wins[tuple(ws[i : i + width])].add(item)
    sizes = sorted({len(w) for w in wins})
    out = {}
    for d, text in docs:
        ws, hit, found = bench_words(text), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if (w := tuple(ws[i : i + k])) in wins:
                    hit.update(range(i, i + k))
                    found |= wins[w]
        out[d] = (len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def shared_lines(a, b, sizes, min_words):
    """Places in ``b`` of lines of runs that stand in ``a`` as well and hold ``min_words`` words."""
    at = defaultdict(list)
    for i, line in enumerate(a):
        at[line].append(i)
    out = set()
    for j, line in enumerate(b):
        for i in at[line] if line else ():
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that began earlier, or behind a blank line of it
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(sizes[j : j + n]) >= min_words:
                out |= {k for k in range(j, j + n) if sizes[k]}
    # runs that begin with blank lines
    for j, line in enumerate(b):
        if not line and j + 1 < len(b):
            for i in at[""]:
                if not (i and j and a[i - 1] == b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(sizes[j : j + n]) >= min_words:
                        out |= {k for k in range(j, j + n) if sizes[k]}
    return out


def line_removals(docs, min_words=5):
    """doc_id -> places of deleted lines: every document against every earlier one."""
    texts = {}
    for d, t in docs:
        texts.setdefault(t or "", set()).add(d)
    lines = {t: [l.strip(" \t\n\r\x0b\x0c") if WORD.search(l) else "" for l in t.split("\n")] for t in texts}
    head = {t: min(ds) for t, ds in texts.items()}
    by_head = {head[t]: lines[t] for t in texts}
    sizes = {d: [len(WORD.findall(l)) for l in ls] for d, ls in by_head.items()}
    holders = defaultdict(set)
    for d, ls in by_head.items():
        for l in ls:
            if l:
                holders[l].add(d)
    removed = defaultdict(set)
    for d, ls in by_head.items():
        for p in {p for l in ls if l for p in holders[l] if p < d}:
            removed[d] |= shared_lines(by_head[p], ls, sizes[d], min_words)
    for t, ds in texts.items():
        for d in ds - {head[t]}:
            removed[d] = {i for i, l in enumerate(lines[t]) if l}
    return {d: sorted(r) for d, r in removed.items() if r}


def without(text, places):
    rest = "\n".join(l for i, l in enumerate((text or "").split("\n")) if i not in set(places))
    return rest if WORD.search(rest) else ""


def article(page):
    """Main text of the generator's simple pages."""
    from html import unescape

    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body[1].replace("<br>", " "))) if body else []
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)
