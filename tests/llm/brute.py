"""Plain versions of what the queries return, one document after the other."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AZ = str.maketrans(UP, LOW)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def op3(docs):
    def key(line):
        return re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(AZ)

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)], key=lambda d: (d is None, d or 0)) != i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def fingerprint(text, width=3):
    words = WORD.findall((text or "").translate(AZ))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def op6(docs, width=3, radius=2):
    prints = [fingerprint(t, width) for _, t in docs]
    distinct = sorted(set(prints))
    a = np.array(distinct, np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= radius):
            root[find(k)] = find(k + 1 + int(j))
    at = {p: n for n, p in enumerate(distinct)}
    least = {}
    for (i, _), p in zip(docs, prints, strict=True):
        r = find(at[p])
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{p:016x}", least.get(find(at[p]))) for (i, _), p in zip(docs, prints, strict=True)]


def op8_edits(docs):
    """docs in order."""
    out = []
    for k, (i, t) in enumerate(docs):
        t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), sha(t[: len(t) - half] + n[:half])))
    return out


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def op9_base(text):
    text, out = text or "", []
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def op7(docs, path, end=0):
    """docs in order."""
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def op1(docs, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [(i, len((x or "").encode()), n, n > 2048) for i, x in docs for n in [len(t.encode(x or "", add_special_tokens=False).ids)]]


def sainte_lague(votes, seats):
    """One seat after the other."""
    from fractions import Fraction

    votes, won = [Fraction(v) for v in votes], [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


def op8_vector(text):
    """Sums of 32 bits of four hashes of each line, sums of the signs of each word pair's hash."""
    equal, near = [0] * 8, [0] * 64
    for line in text.split("\n"):
        for k in range(4):
            h = xxhash.xxh64_intdigest(line.encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42))
            equal[2 * k] += h & 0xFFFFFFFF
            equal[2 * k + 1] += h >> 32
        words = WORD.findall(line)
        for a, b in zip(words, [*words[1:], None][: len(words)], strict=True):
            h = xxhash.xxh64_intdigest(a.encode(), 42)
            h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
            for i in range(64):
                near[i] += 1 if h >> i & 1 else -1
    return equal, near


def op8_print(vector):
    return "".join(f"{x % 2**32:08x}" for part in vector for x in part)


def op8_likeness(v, w):
    if v[1] == w[1] and [x % 2**32 for x in v[0]] == [x % 2**32 for x in w[0]]:
        return 1.0
    sizes = sum(x * x for x in v[1]) + sum(x * x for x in w[1])
    return max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(v[1], w[1], strict=True)) / sizes)) if sizes else 0.0


def op10(docs, items, patterns, width=8, literal=3, shortest=5, coverage=0.5, passage=13):
    """{id: (item ids, coverage)}: every document against every item. patterns: of names, of names anywhere, of numbers, units."""
    import math

    import regex

    name, anywhere, number, units = patterns
    signs = "\1\2\3\4"

    def cut(text):
        text = text.translate(dict.fromkeys(map(ord, signs), " "))
        first = regex.sub(name, signs[1], text)
        forms = []
        for t in (first, regex.sub(anywhere, signs[1], first)):
            t = regex.sub(number, f" {signs[0]} ", t).lower()
            forms.append(regex.findall(r"[\p{L}\p{M}]+|[\1\2\3]", regex.sub(rf"(?<={signs[0]} ) ?(?:{units})(?![\p{{L}}\p{{M}}])", signs[2], t)))
        vals = regex.findall(rf"{number}|[\p{{L}}\p{{M}}]+", regex.sub(f"({number})", r" \1 ", text).lower())
        assert len(forms[0]) == len(forms[1]) == len(vals)
        return forms[0], forms[1], vals

    def keys(text, w):
        first, more, vals = text
        out = []
        for i in range(len(vals) - w + 1):
            rich = lambda t, i=i: sum(x not in signs for x in t[i : i + w]) >= literal
            found = {("t", *first[i : i + w]) if rich(first) else ("v", *vals[i : i + w])}
            out.append(found | ({("t", *more[i : i + w])} if rich(more) else set()))
        return out

    texts = {i: cut(t) for i, t in docs if t is not None}
    result = {}
    for item, t in items:
        if item is None or t is None:
            continue
        own = cut(t)
        size = len(own[2])
        w, n = min(size, width), max(1, size - width + 1)
        for i, text in texts.items():
            if size < shortest:
                if size and own[2] == text[2]:
                    result.setdefault(i, []).append((item, 1.0))
                continue
            where = {}
            for at, ks in enumerate(keys(text, w)):
                for k in ks:
                    where.setdefault(k, set()).add(at)
            hits = {(at, j) for j, ks in enumerate(keys(own, w)) for k in ks for at in where.get(k, ())}
            matched = len({j for _, j in hits})
            if not matched or not (matched >= math.ceil(n * coverage) or matched >= passage - w + 1):
                continue
            good = []
            for shift in {at - j for at, j in hits}:
                spots = {s for at, j in hits if at - j == shift for s in range(j, j + w) if own[1][s] in signs}
                if spots:
                    pairs = {(own[1][s], own[2][s], text[2][s + shift]) for s in spots}
                    good.append(len(pairs) == len({p[:2] for p in pairs}))
            if not good or any(good):
                result.setdefault(i, []).append((item, matched / n))
    return {i: (sorted({x for x, _ in found}), max(c for _, c in found)) for i, found in result.items()}
