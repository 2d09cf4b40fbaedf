"""A semi-Markov conditional random field over tokens of regions, trained in numpy on made-up examples.

A region is cut into segments: single tokens outside, or entities. A candidate segment is scored by features of the whole
span (digits, grouping, checksum, separators, edges, the word before) for each kind, and by the kind of the segment before
it. Viterbi over ends and kinds chooses boundaries and kinds together. Candidates are spans of a bounded number of tokens
that have the form of an entity; between groups of overlapping ones every token is outside, so each group is decided by
itself and the work grows with the region's length.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = ("-", *KINDS)
MOST_TOKENS = 24  # of a number written in groups
LOOK_BACK = 32  # characters in which the word before a span is looked for
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: Words before or after a span that say what it is (fixed list).
HINTS = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip", "email": "email", "mail": "email", "version": "other", "page": "other", "date": "other", "order": "other", "isbn": "other", "id": "other"}
AT, DOT = re.compile(r"\[at\]|\(at\)| at |@", re.I), re.compile(r"\[dot\]|\(dot\)| dot |\.", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def ip_parts(span: str) -> bool:
    parts = span.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


#: Forms of entities (fixed patterns): card numbers in one run or in usual groups, addresses, numbers with an area code.
CARD_FORM = r"[0-9]{14,19}|[0-9]{4}(?P<a>[ -])[0-9]{4}(?P=a)[0-9]{4}(?P=a)[0-9]{4}(?:(?P=a)[0-9]{3})?|[0-9]{4}(?P<b>[ -])[0-9]{6}(?P=b)[0-9]{4,5}"
IP_FORM = r"[0-9]{1,9}(?:\.[0-9]{1,9}){3}"
AREA_FORM = r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}"
PLUS_FORM = r"\+[0-9](?:[ .-]?\(?[0-9]{1,15}\)?){1,7}"
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
AT_FORM, DOT_FORM = r"(?:@| at | ?\[at\] ?| ?\(at\) ?)", r"(?:\.| dot | ?\[dot\] ?| ?\(dot\) ?)"

CARD, IP, AREA, PLUS = (re.compile(x) for x in (CARD_FORM, IP_FORM, AREA_FORM, PLUS_FORM))
EMAIL = re.compile(rf"[{LOCAL}]++{AT_FORM}[{HOST}]++(?:{DOT_FORM}[{HOST}]++)+", re.I)
CARDS, IPS, AREAS = (re.compile(rf"(?<![0-9A-Za-z])(?=({x})(?![0-9]))") for x in (CARD_FORM, IP_FORM, AREA_FORM))
ATS = re.compile(r"@| at |\[at\] ?|\(at\) ?", re.I)
HOSTS = re.compile(rf"[{HOST}]++")
DOTS = re.compile(DOT_FORM + rf"[{HOST}]++", re.I)
BACK = re.compile(rf"[{LOCAL}]*+")


def plausible(kind: str, span: str, hinted: bool = False) -> bool:
    """The exact check that follows the model. hinted: the word before says that it is of this kind."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return ip_parts(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and bool(CARD.fullmatch(span)) and luhn(digits)
    if kind == "phone":
        if not 10 <= len(digits) <= 15:
            return False
        return bool(PLUS.fullmatch(span) or AREA.fullmatch(span) or hinted and not re.search(r"[^0-9 ().+-]", span))
    if not EMAIL.fullmatch(span):
        return False
    plain = re.fullmatch(rf"([{LOCAL}]++) at [{HOST}]++(?:\.[{HOST}]++)+", span, re.I)
    last = re.search(rf"[{HOST}]++$", span)[0]
    return not plain or len(last) >= 2 and last.isalpha() and not plain[1].isalpha()  # "was at example.com" is none


def local_start(text: str, at: int, least: int = 0) -> int:
    """Where the run of local characters that ends at `at` begins, not before `least`."""
    back = 64
    while True:
        low = max(least, at - back)
        n = BACK.match(text[low:at][::-1]).end()
        if n < at - low or low == least:
            return at - n
        back *= 4


def last_word(text: str, at: int) -> str:
    """The word before a place, in lower case."""
    m = re.search(r"([A-Za-z]+)[^0-9A-Za-z]*\Z", text[max(0, at - LOOK_BACK) : at])
    return m[1].lower() if m else ""


def span_features(span: str, before: str, left: str, right: str) -> list[str]:
    """Of a candidate: the span, the word before it, the characters next to it."""
    runs = re.findall("[0-9]+", span)
    digits = "".join(runs)
    n, groups = len(digits), "-".join(str(min(len(r), 9)) for r in runs[:6])
    found = [
        f"digits={n}", f"groups={groups}", f"first={_shape(span[0])}", f"last={_shape(span[-1])}",
        f"left={_shape(left)}", f"right={_shape(right)}", f"hint={HINTS.get(before, '')}", f"plus={span[0] == '+'}",
        f"luhn={14 <= n <= 19 and luhn(digits)},{n}", f"ip={ip_parts(span)}", f"letters={bool(re.search('[A-Za-z]', span))}",
        f"seps={''.join(sorted(set(re.sub('[0-9A-Za-z]', '', span))))[:6]}", f"even={len(set(map(len, runs))) == 1},{len(runs)}",
    ]
    if "(" in span:
        found.append(f"area={bool(re.search(r'[(][0-9]{2,4}[)]', span))}")
    at, dot = len(AT.findall(span)), len(DOT.findall(span))
    if at:
        found += [f"at={min(at, 3)}", f"dot={min(dot, 4)}", f"address={plausible('email', span)}", f"end={bool(re.search(r'(?:[.]|dot[ )]*|[)])[A-Za-z]{{2,6}}$', span))}"]
    return found


def _shape(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


@dataclass
class Region:
    text: str
    before: str = ""

    def hint(self, at: int) -> str:
        """The word before a place: in the region, else the one before it."""
        return last_word(self.text, at) or self.before

    def spans(self) -> list[tuple[int, int]]:
        """Candidates in order: spans that have the form of a kind, some of them ending at several places."""
        text, out = self.text, set()
        for finder in (CARDS, IPS, AREAS):
            out.update(m.span(1) for m in finder.finditer(text))
        at = text.find("+")
        while at >= 0:  # after a plus a number may end with any of its groups
            out.update(self._numbers(at + 1, at))
            at = text.find("+", at + 1)
        if HINTS.get(self.before) == "phone":
            out.update(self._numbers(0, 0))
        done = 0
        for m in ATS.finditer(text):
            gap = m.start() - (text[m.start() - 1 : m.start()] == " ")
            s, host = local_start(text, gap, done), HOSTS.match(text, m.end())
            dot = host and DOTS.match(text, host.end())
            while dot and s < gap:
                out.add((s, done := dot.end()))
                dot = DOTS.match(text, dot.end())
        return sorted(x for x in out if worth(text[x[0] : x[1]], text[x[0]] == "+" or HINTS.get(self.before) == "phone"))

    def _numbers(self, at: int, start: int) -> list[tuple[int, int]]:
        """From start to the end of each run of digits, while there are 10 to 15 of them; digits and separators alone."""
        out, digits = [], 0
        for k, m in enumerate(TOKEN.finditer(self.text, at)):
            if k >= MOST_TOKENS or digits > 15 or m[0] not in SEPARATORS and not (m[0][0].isdigit() and m[0].isascii()):
                break
            if m[0][0].isdigit():
                digits += len(m[0])
                if 10 <= digits <= 15:
                    out.append((start, m.end()))
        return out

    def features(self, s: int, e: int) -> list[str]:
        return span_features(self.text[s:e], self.hint(s), self.text[s - 1 : s] if s else "", self.text[e : e + 1])


SEPARATORS = frozenset(" .-()")


def worth(span: str, phone: bool) -> bool:
    """Whether a candidate passes the check of any kind."""
    return any(plausible(k, span, phone) for k in KINDS)


def groups(spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Spans in order, parted where none reaches over."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for s, e in spans:
        if s < end:
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
        end = max(end, e)
    return out


class Field:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def ids(self, names: list[str], grow: bool = False) -> list[int]:
        if grow:
            return [self.number.setdefault(n, len(self.number)) for n in names]
        return [self.number[n] for n in names if n in self.number]

    def lattice(self, region: Region, tokens: list[tuple[int, int]], spans: list[tuple[int, int]], grow: bool = False) -> list[list[tuple[int, list[int], bool]]]:
        """By end: (begin, feature ids, entity)."""
        ends: list[list[tuple[int, list[int], bool]]] = [[] for _ in range(len(tokens) + 1)]
        for k, (s, e) in enumerate(tokens):
            shape = _shape(region.text[s])
            ends[k + 1].append((k, self.ids([f"o={shape}", f"o={shape}{min(e - s, 12)}"], grow), False))
        first, last = {s: k for k, (s, _) in enumerate(tokens)}, {e: k + 1 for k, (_, e) in enumerate(tokens)}
        for s, e in spans:
            if s in first and e in last:
                ends[last[e]].append((first[s], self.ids(region.features(s, e), grow), True))
        return ends

    def scores(self, ids: list[int], entity: bool) -> np.ndarray:
        s = self.weights[ids].sum(axis=0) if ids else np.zeros(len(LABELS))
        out = s.copy()
        if entity:
            out[0] = -np.inf
        else:
            out[1:] = -np.inf
        return out

    def best(self, region: Region, spans: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in characters of the region, by Viterbi over each group of candidates and the token after it."""
        out = []
        for group in groups(region.spans() if spans is None else spans):
            end = max(e for _, e in group)
            after = TOKEN.match(region.text, end)
            tokens = [m.span() for m in TOKEN.finditer(region.text, group[0][0], after.end() if after else end)]
            out += self._best(tokens, self.lattice(region, tokens, group))
        return out

    def _best(self, tokens: list[tuple[int, int]], ends: list[list[tuple[int, list[int], bool]]]) -> list[tuple[str, int, int]]:
        top = np.full((len(ends), len(LABELS)), -np.inf)
        top[0, 0] = 0
        back: list[list[tuple[int, int] | None]] = [[None] * len(LABELS) for _ in ends]
        for e in range(1, len(ends)):
            for b, ids, entity in ends[e]:
                via = top[b][:, None] + self.moves + self.scores(ids, entity)[None, :]
                prev = via.argmax(axis=0)
                for y in range(len(LABELS)):
                    if via[prev[y], y] > top[e, y]:
                        top[e, y], back[e][y] = via[prev[y], y], (b, int(prev[y]))
        out, e, y = [], len(ends) - 1, int(top[-1].argmax())
        while e > 0:
            b, p = back[e][y]
            if y:
                out.append((LABELS[y], tokens[b][0], tokens[e - 1][1]))
            e, y = b, p
        return out[::-1]

    def fit(self, examples: list[tuple[Region, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.3, seed: int = 0) -> Field:
        """Stochastic ascent on the conditional log-likelihood, with forward and backward sums over segments."""
        known = []
        for r, gold in examples:
            tokens = [m.span() for m in TOKEN.finditer(r.text)]
            spans = sorted({*r.spans(), *((s, e) for _, s, e in gold)})
            known.append((self.lattice(r, tokens, spans, True), tokens, gold))
        k = len(LABELS)
        self.weights = np.zeros((len(self.number), k))
        grad, grad_moves = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-3)
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(known)
            for ends, toks, gold in known:
                want = {(s, e): LABELS.index(kind) for kind, s, e in gold}
                segs = [(b, e, ids, self.scores(ids, ent)) for e in range(1, len(ends)) for b, ids, ent in ends[e]]
                a = np.full((len(ends), k), -np.inf)
                a[0, 0] = 0
                for b, e, _, s in segs:  # ends ascend
                    a[e] = np.logaddexp(a[e], _sum(a[b][:, None] + self.moves, 0) + s)
                z = np.full((len(ends), k), -np.inf)
                z[-1] = 0
                for b, e, _, s in reversed(segs):
                    z[b] = np.logaddexp(z[b], _sum(self.moves + (s + z[e])[None, :], 1))
                total = _sum(a[-1], 0)
                d, dm = {}, np.zeros((k, k))
                for b, e, ids, s in segs:
                    p = np.exp(a[b][:, None] + self.moves + (s + z[e])[None, :] - total)
                    dm -= p
                    q = p.sum(axis=0)
                    for i in ids:
                        d[i] = d.get(i, 0) - q
                at, prev = 0, 0
                by_start = {s: (e, y) for (s, e), y in want.items()}
                while at < len(toks):
                    e, y = by_start.get(toks[at][0], (toks[at][1], 0))
                    j = next(j for j in range(at, len(toks)) if toks[j][1] >= e) + 1
                    ids = next((ids for b, ids, ent in ends[j] if b == at and ent == (y > 0)), None)
                    for i in ids or []:
                        one = np.zeros(k)
                        one[y] = 1
                        d[i] = d.get(i, 0) + one
                    dm[prev, y] += 1
                    at, prev = j, y
                for i, g in d.items():
                    grad[i] += g * g
                    self.weights[i] += rate * g / np.sqrt(grad[i])
                grad_moves += dm * dm
                self.moves += rate * dm / np.sqrt(grad_moves)
        return self


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def examples(n: int = 500, seed: int = 7) -> list[tuple[Region, list[tuple[str, int, int]]]]:
    """Made-up regions with their entities: one to three things side by side, of which numbers of other kinds are none."""
    rng = random.Random(seed)
    dig = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = rng.choice("23456789") + dig(rng.choice([12, 13, 14, 14, 14, 14, 15, 17]))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        form = rng.random()
        sep = rng.choice(" -")
        return full if form < 0.6 or len(full) != 16 else sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, a, b, country = dig(3), dig(3), dig(4), rng.choice(["1", "44", "49", "33", "34"])
        return rng.choice([f"+{country} ({area}) {a}-{b}"] * 3 + [f"+{country} {area} {a} {b}", f"+{country}-{area}-{a}-{b}", f"+{country}{area}{a}{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"({area}) {a} {b}", f"{area}.{a}.{b}"])

    def email() -> str:
        user, host, top = rng.choice([word(), f"{word()}.{dig(2)}", f"{word()}_{word()}"]), rng.choice([word(), f"{word()}.{word()}", f"mail{dig(1)}.{word()}"]), rng.choice(["com", "org", "net", "de", "fr"])
        return rng.choice([f"{user}@{host}.{top}"] * 3 + [f"{user} at {host.replace('.', ' dot ')} dot {top}", f"{user} [at] {host} [dot] {top}".replace(".", " [dot] ") if "." in host else f"{user} [at] {host} [dot] {top}", f"{user}(at){host}.{top}"])

    def other() -> str:
        bad = next(x for x in iter(lambda: dig(16), "") if not luhn(x))
        return rng.choice([dig(rng.randint(1, 9)), bad, f"{rng.randint(1900, 2030)}-{dig(2)}-{dig(2)}", f"{dig(2)}.{dig(2)}.{rng.randint(1900, 2030)}", f"{dig(1)}.{dig(2)}.{dig(1)}", f"{dig(4)}-{dig(4)}", f"{dig(3)} {dig(3)} {dig(3)}", f"{dig(20)}", f"{rng.randint(256, 999)}.{dig(3)}.{dig(2)}.{dig(1)}", f"{dig(12)}", f"978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}", f"{dig(2)} {dig(2)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}"])

    makers = {"card": card, "phone": phone, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "email": email, "-": other}
    out = []
    for _ in range(n):
        text, gold = "", []
        for i in range(rng.choice([1, 1, 2, 2, 3])):
            kind = rng.choice(["card", "phone", "ip", "email", "-", "-"])
            thing = makers[kind]()
            text += (" " if i else "") + thing
            if kind != "-":
                gold.append((kind, len(text) - len(thing), len(text)))
        hint = {"card": "card", "phone": "phone", "ip": "host", "email": "email"}.get(gold[0][0] if gold else "", rng.choice(["order", "page", "id", ""]))
        out.append((Region(text, hint if rng.random() < 0.3 else ""), gold))
    return out


_trained: list[Field] = []


def trained() -> Field:
    """The model, fitted once a process: always on the same examples, so always the same."""
    if not _trained:
        _trained.append(Field().fit(examples()))
    return _trained[0]
