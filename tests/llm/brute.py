"""Brute-force versions of the operators, for small inputs: rows are (doc_id, text)."""

import collections
import hashlib
import math
import re
import zlib

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LAST = 1 << 70  # a null id comes last


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def line_dedup(rows, min_chars):
    """Kept text by row; rows equal in both columns are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = {r: r[1].split("\n") for r in docs if r[1] is not None}
    gone = {r: set() for r in lines}
    k = 1
    while True:
        first, count = {}, collections.Counter()
        for r, ls in lines.items():
            for p in range(len(ls) - k + 1):
                first.setdefault(tuple(ls[p : p + k]), (r, p))
                count[tuple(ls[p : p + k])] += 1
        if not any(c > 1 for c in count.values()):
            break
        for r, ls in lines.items():
            isles = {}

            def close(isle):
                if sum(map(len, ls[isle[0] : isle[1]])) >= min_chars:
                    gone[r].update(range(isle[0], isle[1]))

            for p in range(len(ls) - k + 1):
                at = first[tuple(ls[p : p + k])]
                if at == (r, p):
                    continue
                far = (at[0], p - at[1])
                if far in isles and isles[far][2] == p - 1:
                    isles[far][1:] = [p + k, p]
                else:
                    if far in isles:
                        close(isles[far])
                    isles[far] = [p, p + k, p]
            for isle in isles.values():
                close(isle)
        k *= 2
    return [None if t is None else "\n".join(x for j, x in enumerate(lines[i, t]) if j not in gone[i, t]) for i, t in rows]


def maximal_line_dedup(rows, min_chars):
    """Kept text by row, of rows with different ids: from each line, the longest match with each earlier line."""
    lines = {i: t.split("\n") for i, t in rows}
    places = sorted((i, p) for i, ls in lines.items() for p in range(len(ls)))
    gone = set()
    for n, (i, p) in enumerate(places):
        for j, q in places[:n]:
            k = 0
            while p + k < len(lines[i]) and q + k < len(lines[j]) and lines[i][p + k] == lines[j][q + k]:
                k += 1
            if k and sum(map(len, lines[i][p : p + k])) >= min_chars:
                gone.update((i, p + x) for x in range(k))
    return ["\n".join(x for p, x in enumerate(lines[i]) if (i, p) not in gone) for i, _ in rows]


def substrings(rows, width=50):
    first = {}
    key = lambda i: LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, LAST + 1), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < key(i):
                gone[p : p + width] = [True] * width
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def near(rows, similar=85):
    sets = []
    for _, t in rows:
        w = SPACED.findall(low(t))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), LAST), i)
    return [(i, len(sets[k]), None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, _) in enumerate(rows)]


def contamination(rows, items, width=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[s : s + width])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s : s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def whole_windows(rows, items, width=13):
    """For each row, whether it holds width consecutive words of an item."""
    windows = {tuple(w[s : s + width]) for _, t in items for w in [ALNUM.findall(low(t))] for s in range(len(w) - width + 1)}
    return [any(tuple(w[s : s + width]) in windows for s in range(len(w) - width + 1)) for _, t in rows for w in [ALNUM.findall(low(t))]]


def base_scores(rows):
    tokens = [[*SPACED.findall(low(t)), ""] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    c = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, kinds = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for (i, _), h, ws in zip(rows, held, tokens)]


def token_chance(mixer, counts, words, i, counted):
    """log10 of token i of a document's words by token_mixing, bit by bit, from counts of (context, key, node, bit) in a dictionary."""
    from terrane.llm import token_mixing as T

    code = mixer.code
    symbol = lambda w: code.words.get(w, code.starts.get((w + b" ")[:2], code.rest))
    out = 0.0
    before = [symbol(w) for w in words[:i]]
    tops = [x for x in before if x < min(T.TOPS, len(code.words))]
    keys = (tops[-1] if tops else None, words[i - 1] if i else None)
    s = symbol(words[i])
    for at in range(code.start[s], code.start[s] + code.depth[s]):
        node, bit = int(code.nodes[at]), int(code.bits[at])
        odds, gate, level = [float(code.odds[node])], 0, 0
        for k, key in enumerate(keys):
            # From 128 on, a count is kept as the nearest of steps of an eighth.
            kept = [c if c < 128 else round(128 * 2 ** (round(6 * math.log2(c / 128)) / 6)) for c in (counts[k, key, node, b] for b in (0, 1))]
            n = [c - (counted and b == bit) for b, c in enumerate(kept)]
            odds.append(math.log((n[1] + T.FEW) / (n[0] + T.FEW)))
            level = sum(sum(n) >= x for x in (1, 2, 4, 16))
            gate = gate * T.LEVELS[k] + level
        z = sum(float(w) * o for w, o in zip(mixer.weights[:, gate], [*odds, 0.3]))
        z = max(-12.0, min(12.0, z))
        place = level * T.ZS + int(z * (T.ZS - 1) / 24 + T.ZS / 2)
        n0, n1 = mixer.seen[:, place]
        sure = 0.5 * (n0 + n1) / (n0 + n1 + 400)
        p = (1 - sure) / (1 + math.exp(-z)) + sure * (n1 + 0.5) / (n0 + n1 + 1)
        out += math.log10(p if bit else 1 - p)
    return out


def token_counts(code, docs):
    """For token_chance: how often each bit came at each node after each context."""
    from terrane.llm import token_mixing as T

    symbol = lambda w: code.words.get(w, code.starts.get((w + b" ")[:2], code.rest))
    counts = collections.Counter()
    for words in docs:
        top, last = None, None
        for w in words:
            s = symbol(w)
            for at in range(code.start[s], code.start[s] + code.depth[s]):
                for k, key in enumerate((top, last)):
                    counts[k, key, int(code.nodes[at]), int(code.bits[at])] += 1
            top, last = (s if s < min(T.TOPS, len(code.words)) else top), w
    return counts
