"""Plain versions of the operators, document by document, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def cut(docs, n=20):
    """{doc_id: (words, removed, sha)} for rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone.update(range(i, i + n))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingles(text, k):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs, k=2, percent=80):
    """{doc_id: (shingles, component)} by comparing all pairs."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def leaks(docs, items, n=10):
    """{doc_id: (words, hit, items, sha)}."""
    wins = {}
    for item_id, text in items:
        w = TERM.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes, out = sorted({len(k) for k in wins}), {}
    for doc_id, text in docs:
        w, hit, found = TERM.findall((text or "").translate(UPPER)), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[k]
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {k for k in wins if wins.count(k) > 1}
    repeated = {i + j for i, k in enumerate(wins) if k in many for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def kept(text, rules):
    """The verdict of the quality rules, line by line."""
    n, _, _, _, repeated = base_rules(text)
    if n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n:
        return False
    seen, lost, total = set(), 0, 0
    for line in (text or "").split("\n"):
        if not words(line):
            continue
        size = len(line.encode())
        total += size
        bad = not re.search(rules.ends, line) or any(re.search(x, line) for x in (rules.shouting, rules.navigation, rules.boilerplate, rules.code))
        if bad or line in seen:
            lost += size
        seen.add(line)
    return lost <= rules.max_lost * total


def tokens(docs, tokenizer, end_id=1):
    """[(doc_id, start, n, crc)] in doc_id order."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def gram_bucket(gram, bits):
    """The bucket of a character n-gram, by integers."""
    m = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def both(a, b):
        return mixed((a * 0x9E3779B97F4A7C15 + b) & m)

    h = [mixed(ord(c) + 1) for c in gram]
    while len(h) > 1:  # powers of two, the least first
        if len(h) & 1:
            rest = h[1:]
            while len(rest) > 1:
                rest = [both(a, b) for a, b in zip(rest[::2], rest[1::2], strict=True)]
            h = [both(h[0], rest[0])]
        else:
            h = [both(a, b) for a, b in zip(h[::2], h[1::2], strict=True)]
    return both(h[0], len(gram)) >> (64 - bits)


def grams(text, bits, shortest=3, longest=5):
    """{bucket: in how many distinct words of the text its n-grams stand, each time counted}."""
    out = {}
    for w in {w.lower() for w in words(text)}:
        w = f" {w} "
        for n in range(shortest, longest + 1):
            for i in range(len(w) - n + 1):
                k = gram_bucket(w[i : i + n], bits)
                out[k] = out.get(k, 0) + 1
    return out


def importance(docs, target, percent=25, least=20, buckets=10000):
    """[(doc_id, n_features, weight, score, rank)], ties by doc_id (None last)."""
    import math

    def grams(text):
        w = TERM.findall((text or "").translate(UPPER))
        return w, [zlib.crc32(g.encode()) % buckets for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    ours, theirs = [(d, *grams(t)) for d, t in docs], [grams(t)[1] for t in target]
    s, t = [0] * buckets, [0] * buckets
    for _, _, g in ours:
        for b in g:
            s[b] += 1
    for g in theirs:
        for b in g:
            t[b] += 1
    big, small = sum(s), sum(t)
    out = []
    for d, w, g in ours:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in g]
        weight = sum(gain) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def repair(turns):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of (conv_id, turn, role, text)
    without nulls in role and text, by the best audit of each prefix and state."""
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}  # the last initial of what is kept: (cost, letters, turns)

        def legal(last, now):
            return now in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

        def inserted(best):
            best = dict(best)
            for _ in range(3):
                for last, (cost, letters, kept) in list(best.items()):
                    for role in ("user", "assistant"):
                        if legal(last, role[0]):
                            new = (cost + 2, letters + "I", (*kept, f"{role}:"))
                            if role[0] not in best or new[:2] < best[role[0]][:2]:
                                best[role[0]] = new
            return best

        for (_, role, text), fault in zip(rows, faults):
            more, after = int(fault == "truncated"), {}
            for last, (cost, letters, kept) in inserted(best).items():
                ways = [(last, cost + 3, "D", ())]
                if fault not in ("blank", "duplicate"):
                    ways += [(r[0], cost + 2 + more, "R", (f"{r}:{text}",)) for r in ("user", "assistant") if legal(last, r[0])]
                    if role[:1] in ("s", "u", "a") and legal(last, role[:1]):
                        ways.append((role[:1], cost + more, "K", (f"{role}:{text}",)))
                for state, c, letter, line in ways:
                    new = (c, letters + letter, kept + line)
                    if state not in after or new[:2] < after[state][:2]:
                        after[state] = new
            best = after
        cost, letters, kept = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def damaged(turns):
    out = []
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            row = (conv, turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
            out += [row, row] if draw == 3 else [row]
    return out
