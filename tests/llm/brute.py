"""Plain versions of what the operators compute, straight from the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

SPACE = "\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE}]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def spans_text(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def personal(text: str | None) -> dict:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    n = lambda k: sum(x[3] == k for x in out)
    return {"n_email": n("email"), "n_ip": n("ip"), "n_card": n("card"), "n_phone": n("phone"), "base": spans_text(out), "base_sha256": sha(spans_text(out))}


def secrets(text: str | None) -> dict:
    text = text or ""
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    n = lambda k: sum(x[3] == k for x in out)
    return {"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "base": spans_text(out), "base_sha256": sha(spans_text(out))}


def quality(text: str | None) -> dict:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat)}
    return out | {"base_failed": len(w) < 20 or 100 * len(repeat) > 30 * len(w)}


def line_dedup(rows: list[tuple[int, str]], min_words: int = 50) -> dict[int, str]:
    """Delete every line in a run of min_words words or more that stands at an earlier place too; all pairs are tried."""
    docs = []
    for i, t in sorted(rows):
        parts = (t or "").split("\n")
        docs.append((i, parts, [k for k, p in enumerate(parts) if WORD.search(p)]))
    places: dict[str, list[tuple[int, int]]] = {}
    for d, (_, parts, at) in enumerate(docs):
        for k, p in enumerate(at):
            places.setdefault(parts[p], []).append((d, k))
    gone: dict[int, set[int]] = {d: set() for d in range(len(docs))}
    for d, (_, parts, at) in enumerate(docs):
        for k in range(len(at)):
            best = 0
            for d2, k2 in places[parts[at[k]]]:
                if (d2, k2) >= (d, k):
                    continue
                n, total, ends = 0, 0, docs[d2]
                while k + n < len(at) and k2 + n < len(ends[2]) and parts[at[k + n]] == ends[1][ends[2][k2 + n]]:
                    total += len(WORD.findall(parts[at[k + n]]))
                    n += 1
                if total >= min_words:
                    best = max(best, n)
            if best:
                gone[d].update(at[k : k + best])
        for a, b in zip(at, at[1:]):  # wordless lines between two deleted lines go with them
            if {a, b} <= gone[d]:
                gone[d].update(range(a, b))
    return {i: "\n".join(p for k, p in enumerate(parts) if k not in gone[d]) for d, (i, parts, _) in enumerate(docs)}


def unigram(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) by id."""
    import math
    import zlib
    from collections import Counter

    tokens = {i: [w for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def context_tree(rows: list[tuple[int, str]], depth: int = 4) -> dict[int, float]:
    """log10 probability of each text, every decision mixed over all depths by recursion."""
    import math
    import zlib
    from collections import defaultdict
    from functools import lru_cache

    def steps(t):
        b = bytes(depth) + (t or "").encode() + b"\0"
        for p in range(depth, len(b)):
            for i in range(8):
                yield b[p - depth : p], 1 << i | b[p] >> 8 - i, b[p] >> 7 - i & 1

    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for ctx, node, bit in steps(t):
                for d in range(depth + 1):
                    counts[ctx[depth - d :], node][bit] += 1
                    if d:
                        kids[ctx[depth - d + 1 :], node].add(ctx[depth - d :])

    @lru_cache(None)
    def weigh(ctx, node):  # (ln of the node's own estimate, ln of the weighted one)
        a, b = counts[ctx, node]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(ctx) == depth:
            return kt, kt
        deep = sum(weigh(k, node)[1] for k in kids[ctx, node])
        top = max(kt, deep)
        return kt, math.log(0.5) + top + math.log(math.exp(kt - top) + math.exp(deep - top))

    def one(ctx, node, d=0):
        key = (ctx[depth - d :], node)
        if key not in counts:
            return 0.5
        a, b = counts[key]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        kt, both = weigh(*key)
        w = math.exp(math.log(0.5) + kt - both)
        return w * own + (1 - w) * one(ctx, node, d + 1)

    return {i: sum(math.log10(p if bit else 1 - p) for ctx, node, bit in steps(t) for p in [one(ctx, node)]) for i, t in rows}


def shingles(text: str | None) -> frozenset:
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(rows: list[tuple[int, str]], percent: int) -> dict[int, tuple[int, int]]:
    """(set size, smallest id reachable) by id, from all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    having: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    for i, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for j in having[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]], piece_words: int, share: float = 0.5, part: float = 0.5) -> list[tuple]:
    """(doc, item, question overlap, answer overlap): BM25 of every passage for every piece of an item, then the overlaps."""
    import math
    from collections import Counter

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = [(i, t, words(t)) for i, t in items if words(t)]
    df = Counter(w for _, _, ws in held for w in set(ws))
    average = sum(len(ws) for _, _, ws in held) / len(held)

    def impacts(ws):
        return {w: math.log1p((len(held) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w, n in Counter(ws).items()}

    def runs(ws, n):
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    def overlap(g, ws):
        if not g:
            return 1.0
        wanted = runs(g, min(3, len(g)))
        own = runs(ws, min(3, len(ws)))
        if len(wanted) == 1:
            own = set().union(*(runs(ws, m) for m in range(1, min(3, len(ws)) + 1)))
        return len(wanted & own) / len(wanted)

    pieces = []
    for k, (_, _, ws) in enumerate(held):
        n = -(-len(ws) // piece_words)
        cuts = [0]
        for j in range(n):
            cuts.append(cuts[-1] + len(ws) // n + (j < len(ws) % n))
        pieces += [(k, n, ws[a:b]) for a, b in zip(cuts, cuts[1:])]
    stride = max(32, max(len(p) for _, _, p in pieces))
    out = set()
    for d, text in docs:
        ws = words(text)
        for lo in range(0, len(ws) + 1, stride):
            here = set(ws[lo : lo + 2 * stride])
            for k, n, p in pieces:
                each = impacts(p)
                if sum(v for w, v in each.items() if w in here) >= share * sum(each.values()) * (1 - 1e-9) and here:
                    i, t, own = held[k]
                    around = len(own) if n > 1 else 0
                    passage = ws[max(lo - around, 0) : lo + 2 * stride + around]
                    sentences = [x for x in re.split(r"(?<=[.!?])\s+", t) if words(x)]
                    q, a = (words(" ".join(sentences[:-1])), words(sentences[-1])) if len(sentences) > 1 else (own[: len(own) // 2], own[len(own) // 2 :])
                    found = overlap(q, passage), overlap(a, passage)
                    if min(found) >= part:
                        out.add((d, i, k))
    return [(d, i) for d, i, _ in out]


def kneser_ney(texts: list[str], order: int = 4):
    """p(symbol, context tuple) of the modified Kneser-Ney model of texts, which begin after order - 1 zeros."""
    from collections import Counter, defaultdict

    counts = {order: Counter()}
    for t in texts:
        x = [0] * (order - 1) + symbols(t)
        counts[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, free = {}, {}, {}
    for n, c in counts.items():
        of = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        off[n] = [min(max(0.1, k - (k + 1) * y * of[k] / of[k - 1]), k - 0.1) if of[k - 1] and of[k] else k * 0.5 for k in (1, 2, 3)]
        total[n], free[n] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[n][g[:-1]] += v
            free[n][g[:-1]] += off[n][min(v, 3) - 1]

    def p(symbol, context):
        n = len(context) + 1
        low = p(symbol, context[1:]) if n > 1 else 2.0**-16
        t = total[n].get(context, 0)
        if not t:
            return low
        v = counts[n].get((*context, symbol), 0)
        return (v - (off[n][min(v, 3) - 1] if v else 0) + free[n][context] * low) / t

    return p


def symbols(text: str) -> list[int]:
    units = text.encode("utf-16-le")
    return [units[k] + 256 * units[k + 1] for k in range(0, len(units), 2)]


def bits(rows: list[tuple[int, str]], half: dict[int, int]) -> dict[int, float]:
    """Bits per character of each text, by the model of the texts of the other half; half: by id, 0 or 1."""
    import math

    models = [kneser_ney([t or "" for i, t in rows if half[i] != h]) for h in (0, 1)]
    out = {}
    for i, t in rows:
        x = [0] * 3 + symbols(t or "")
        out[i] = -sum(math.log2(models[half[i]](x[k], tuple(x[k - 3 : k]))) for k in range(3, len(x))) / max(len(x) - 3, 1)
    return out


def disclosing(rows: list[tuple[int, str]], disclosure: float = 0.5, share: float = 0.8, z: float = 1.2816) -> dict[int, list[tuple[int, int]]]:
    """The spans of terms that give an entity away, by id; counts are over distinct texts."""
    import math
    from collections import Counter

    import regex

    term = regex.compile(r"[\p{L}\p{Nd}]{3,}")
    n_t, n_e, n_te, texts = Counter(), Counter(), Counter(), {t or "" for _, t in rows}
    for t in texts:
        entities = set()
        for s in filter(None, personal(t)["base"].split(",")):
            kind, a, b = s.split(":")
            match = t[int(a) : int(b)]
            entities.add((kind, match.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", match)))
        terms = {w.lower() for w in term.findall(t)}
        n_t.update(terms)
        n_e.update(entities)
        n_te.update((w, e) for w in terms for e in entities)
    flagged = set()
    for (w, e), k in n_te.items():
        p, zz = k / n_t[w], z * z / n_t[w]
        least = (p + zz / 2 - math.sqrt(zz * (p * (1 - p) + zz / 4))) / (1 + zz)
        if least >= disclosure and math.log2(k * len(texts) / (n_t[w] * n_e[e])) >= share * math.log2(len(texts) / n_e[e]):
            flagged.add(w)
    out = {}
    for i, t in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in personal(t)["base"].split(",") if s]
        out[i] = [m.span() for m in term.finditer(t or "") if m[0].lower() in flagged and not any(m.start() < b and a < m.end() for a, b in base)]
    return out


def banded(rows: list[tuple[int, str, str]], half: dict[int, int], width: float = 5.0, step: float = 1 / 500) -> dict[int, bool]:
    """kept of each row (id, text, lang): the base rules, then its language's band."""
    import math

    near = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    middle = lambda xs: sorted(map(near, xs))[(len(xs) + 1) // 2 - 1]
    b = bits([(i, t) for i, t, _ in rows], half)
    chars = {i: len(t or "") for i, t, _ in rows}
    lang = {i: x or "" for i, _, x in rows}
    worded = [i for i, t, _ in rows if WORD.search(t or "")]
    band = {}
    for x in set(lang.values()):
        own = [i for i in worded if lang[i] == x]
        if own:
            mid = middle([b[i] / step for i in own]) * step
            sides = []
            for above in (False, True):
                off = [100 * math.log(abs(b[i] - mid) * math.sqrt(chars[i])) for i in own if abs(b[i] - mid) > step / 2 and (b[i] > mid) == above]
                sides.append(math.exp(middle(off) / 100) if off else 0.0)
            band[x] = mid, *sides
    out = {}
    for i, t, _ in rows:
        out[i] = not quality(t)["base_failed"]
        if out[i]:
            mid, below, above = band[lang[i]]
            out[i] = mid - step - width * below / math.sqrt(chars[i]) <= b[i] <= mid + step + width * above / math.sqrt(chars[i])
    return out


def suffix_runs(rows: list[tuple[int, str]], min_words: int = 50) -> dict[int, str]:
    """line_dedup() by a suffix array over line ids, its LCP array and its intervals, one suffix after the other."""
    docs = [(i, (t or "").split("\n")) for i, t in sorted(rows)]
    worded = [[k for k, p in enumerate(parts) if WORD.search(p)] for _, parts in docs]
    number = {x: k for k, x in enumerate(sorted({parts[k] for (_, parts), at in zip(docs, worded) for k in at}))}
    ids = [[number[parts[k]] for k in at] for (_, parts), at in zip(docs, worded)]
    count = [[len(WORD.findall(parts[k])) for k in at] for (_, parts), at in zip(docs, worded)]
    array = sorted(((d, k) for d, x in enumerate(ids) for k in range(len(x))), key=lambda p: (ids[p[0]][p[1] :], p))
    lcp = [0] * (len(array) + 1)
    for n, ((d, k), (d2, k2)) in enumerate(zip(array, array[1:]), 1):
        while k + lcp[n] < len(ids[d]) and k2 + lcp[n] < len(ids[d2]) and ids[d][k + lcp[n]] == ids[d2][k2 + lcp[n]]:
            lcp[n] += 1
    gone: dict[int, set[int]] = {d: set() for d in range(len(docs))}
    for n, (d, k) in enumerate(array):
        longest = 0
        for way in (-1, 1):  # the intervals around a suffix, from the narrowest out
            at, depth = n, len(ids[d])
            while True:
                depth = min(depth, lcp[at if way < 0 else at + 1])
                at += way
                if depth <= longest or sum(count[d][k : k + depth]) < min_words:
                    break
                if array[at] < (d, k):
                    longest = depth
        gone[d].update(worded[d][k : k + longest])
    for d, at in enumerate(worded):
        for a, b in zip(at, at[1:]):
            if {a, b} <= gone[d]:
                gone[d].update(range(a, b))
    return {i: "\n".join(p for k, p in enumerate(parts) if k not in gone[d]) for d, (i, parts) in enumerate(docs)}


def pipeline(rows: list[tuple[int, str, str]], items: list[tuple[int, str]], half: dict[int, int], encode) -> list[tuple]:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what all stages leave."""
    kept = banded(rows, half)
    text = line_dedup([(i, t) for i, t, _ in rows if kept[i]])
    text = {i: t for i, t in text.items() if WORD.search(t)}
    group = components(list(text.items()), 80)
    text = {i: t for i, t in text.items() if group[i][1] == i}
    leaky = {d for d, _ in leaks(list(text.items()), items, 512)}
    out = []
    for i, t in text.items():
        if i not in leaky:
            ids = encode(t)
            out.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), sha(t)))
    return out
