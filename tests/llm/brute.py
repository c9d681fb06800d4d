"""Plain Python versions of the queries' contracts, for small tables of (doc_id, text, lang, source)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def tokens(docs, tokenizer):
    out, start = {}, 0
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def substrings(docs, size=50):
    first = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i, b in raw.items():
        for p in range(len(b) - size + 1):
            g = b[p : p + size]
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans, counts = [], []
    for rank, (kind, (pattern, ok)) in enumerate(kinds.items()):
        found = [m.span() for m in re.finditer(pattern, text) if ok(m[0])]
        counts.append(len(found))
        spans += [(a, rank, f"{kind}:{a}:{b}") for a, b in found]
    return (*counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())


def decontaminate(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    out = {}
    for doc_id, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def again(x):
    """The second hash of a shingle: a bijective mix of its hash and 1 (fixed values)."""
    m = (1 << 64) - 1
    x = x + 1 & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def fingerprint(text, size=4, more=False):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    hashes = [again(h) for h in hashes] if more else hashes
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, most=4, size=4, wide=False):
    prints = {i: fingerprint(t, size) for i, t in docs}
    second = {i: fingerprint(t, size, True) for i, t in docs} if wide else dict.fromkeys(prints, 0)
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() + (second[i] ^ second[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", root(i)) for i in prints}


def mix_targets(sizes, weights=(5, 2, 1)):
    """Water filling by rounds: sources over their cap are fixed and the rest is shared again."""
    per = defaultdict(int)
    for source, size in sizes:
        per[source] += size
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target = 1.5 * sum(per.values()), {}
    free = set(names)
    while free:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * per[s]]
        target |= {s: 2.0 * per[s] for s in over} or share
        free = free - set(over) if over else set()
    return dict(per), target


def base_scores(docs):
    train = Counter()
    for i, t in docs:
        if crc(i) % 5 != 1:
            train.update([*WORD.findall(lower(t)), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in docs:
        w = [*WORD.findall(lower(t)), None]
        out[i] = (crc(i) % 5 == 1, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def sentences(docs, least=2, words=20):
    """Runs of sentences with enough words; of equal ones all but the first, by id and place, lose their sentences."""
    split = {i: re.findall(r"[^\x20\x09-\x0D.!?,;:]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D.!?,;:]+){0,11}[.!?,;:]*", t or "") for i, t in docs}
    seen, gone = set(), defaultdict(set)
    for i in sorted(split):
        s = split[i]
        runs = []
        for a in range(len(s)):
            b = next((b for b in range(a + least, len(s) + 1) if sum(len(WORD.findall(x)) for x in s[a:b]) >= words), None)
            runs += [(a, b)] if b else []
        for a, b in runs or ([(0, len(s))] if s else []):
            if tuple(s[a:b]) in seen:
                gone[i] |= set(range(a, b))
            seen.add(tuple(s[a:b]))
    return {i: (len(s), len(gone[i]), hashlib.sha256("\n".join(x for k, x in enumerate(s) if k not in gone[i]).encode()).hexdigest()) for i, s in split.items()}


def phrases(docs, max_n=5, min_count=100, top=2000):
    """Rows of (lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(max_n, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        covered = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a == counts[p[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out


def secrets(text):
    """n_assign, n_access, n_hex and the digest of the base spans."""
    text = text or ""
    assign = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [[m.span() for m in assign.finditer(text) if len(m[2]) >= 6], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]]
    spans = sorted((a, k, b) for k, kind in enumerate(found) for a, b in kind)
    return *map(len, found), hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def manifest(rows, fanout=8):
    """Leaf, subroot, root, proof digest, folded root and verdict for rows of (doc_id, source, lang, n_chars, text), by row number."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda r: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    first = lambda x: (x is not None, 0 if x is None else x)
    by_lang = defaultdict(list)
    for i, r in enumerate(rows):
        changed = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if r[0] is not None and crc(r[0]) % 3 == 0 else leaf(r)
        by_lang[r[2]].append((first(r[0]), leaf(r), changed, i))

    def tree(nodes):
        """The top, and for each node its siblings (before, after) by level."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
            for s, a in zip(steps, at):
                run = runs[a // fanout]
                s.append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
            at, nodes = [a // fanout for a in at], [h(*run) for run in runs]
        return nodes[0], steps

    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        held = sorted(by_lang[lang])
        trees.append((held, *tree([x[1] for x in held])))
    root, above = tree([t[1] for t in trees]) if trees else (None, [])
    out = {}
    for (held, subroot, steps), more in zip(trees, above):
        for (_, mine, changed, i), s in zip(held, steps):
            acc = changed
            for a, b in s + more:
                acc = h(a, acc, b)
            out[i] = (mine, subroot, root, h(*(x for step in s + more for x in step)), acc, acc == root)
    return out
