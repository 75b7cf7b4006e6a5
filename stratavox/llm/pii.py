"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds whole-span detections.

Base spans come from fixed patterns. The field segments the stretches of words around characters that personal data and secrets have:
each candidate segment of at most ``MOST_WORDS`` words has features of the whole span (composition, checks such as Luhn, lead words), and dynamic
programming over bounded segments chooses boundaries and types together. Its spans are added where they don't
overlap a base span; base spans stay. Addresses with a bracketed or spelled "at" or "dot" and access keys are found by their form, wherever they stand.
Words with punctuation inside (minified JSON, query strings, texts without spaces) are segmented again by their pieces, at whatever length. Long values after a word such as
"secret" are found by their form as well, whole, whatever base64 characters they have. A card must pass the Luhn check: segments that don't are no candidates for that kind.

The field is trained here, on generated examples with distractors, from a fixed seed, by forward and backward sums over batches of examples; the model is a small matrix. Each text is one
task's work; nothing is shuffled. Scans are linear in the text: every pattern consumes a run once.

Defined results: a null or empty text has no spans; repeated rows are judged alike; an empty table gives an empty result. Between segmentations of equal score the one wins that is found first,
with shorter segments and earlier kinds first.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ["email", "ip", "card", "phone", "secret"]
MOST_WORDS = 4
#: Words whose features are held at a time.
AT_ONCE = 256
#: Words beside a trigger that belong to the same stretch.
BESIDE = 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind and start."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        small = lambda s: len(s) < 4 and int(s) <= 255
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(small(x.lstrip("0") or "0") for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


# The field

#: Words that lead a secret, and words that lead other personal data.
_SECRET_WORDS = frozenset("password passwd pwd secret token key apikey api_key access_key auth bearer pass".split())
_LEAD_WORDS = frozenset("mail email e-mail phone tel call mobile card visa ip address host contact".split())
_STRIP = ".,;:!?\"'()[]{}<>"
_WORD = re.compile(r"\S+")
_TRIGGER = re.compile(rf"[0-9@=]|AKIA|(?<![A-Za-z])(?i:{'|'.join(sorted(_SECRET_WORDS))})(?![A-Za-z])")
_AT, _DOT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+", re.I), re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+", re.I)

#: Addresses with a bracketed or spelled "at" or "dot"; a spelled "at" counts only with a "dot" that isn't a plain point.
_SPELLS = re.compile(r"[\[(]\s*at\s*[\])]|[\[(\s]dot[\])\s]|[\[(]\s+dot", re.I)
_BRACKET_DOT = r"(?:\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s*[\[(]\s*at\s*[\])]\s*[A-Za-z0-9-]++(?:(?:\.|" + _BRACKET_DOT + r")[A-Za-z0-9-]++)++"
    r"|(?:\s+at\s+|@)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+" + _BRACKET_DOT + r"[A-Za-z0-9-]++(?:(?:\.|" + _BRACKET_DOT + r")[A-Za-z0-9-]++)*+)", re.I)  # fmt: skip
#: Pieces of words between punctuation, and punctuation inside a word.
_PIECE, _INNER = re.compile(r"[^\s\"'`{}\[\]()<>,;:&?|/\\#!*]+"), re.compile(r"[A-Za-z0-9_=][\"'`{}\[\]()<>,;:&?|/\\#!*]+[A-Za-z0-9_=]")
#: Access keys by their form, and long values behind a secret's name.
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{12,}+|sk-[A-Za-z0-9_-]{20,}+)")
_VALUE = re.compile(rf"(?<![A-Za-z])(?i:{'|'.join(sorted(_SECRET_WORDS, key=len, reverse=True))})(?![A-Za-z])[\"']?[\x20\t]?[:=]?[\x20\t]?[\"']?([A-Za-z0-9+/_~-]{{24,}}+={{0,2}}+)[\"']?")
_SPLIT = re.compile(r"[{}<>,;&?|\"]")
_MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
_NON_ASCII = re.compile(r"[^\x00-\x7F]+|[\x00-\x7F]+")


def _trim(s: str) -> tuple[int, int]:
    """Where the span stands without the punctuation around it; an opening bracket or quote that closes inside stays."""
    a, b = 0, len(s)
    while b > a and s[b - 1] in ".,;:!?#*|":
        b -= 1
    for left, right in ("\"\"", "''", "()", "[]", "<>"):
        if b - a > 1 and s[a] == left and s[b - 1] == right:
            a, b = a + 1, b - 1
    return a, b


@lru_cache(maxsize=4096)
def features(span: str, lead: str) -> np.ndarray:
    """Of the whole span and the word before it."""
    a, b = _trim(span)
    s = span[a:b]
    n = max(len(s), 1)
    digits = [c for c in s if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in s)
    key, _, value = s.partition("=")
    key, value = key.strip().lower(), value.strip().strip("\"'")
    compact = re.sub(r"[\s().-]", "", s)
    parts = s.split(".")
    undone = _DOT.sub(".", _AT.sub("@", s))
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    body = value if "=" in s else s
    hexes = sum(c in "0123456789abcdefABCDEF" for c in body)
    lead = lead.lower().strip(_STRIP)
    mail = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)
    words = len(span.split())
    return np.array([
        1.0, words == 1, words == 2, words == 3, words == 4, min(n, 60) / 20, len(digits) / n, letters / n, len(digits) == 0, s.isalpha(),
        mail is not None, mail is None and re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", undone) is not None,
        len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts), len(parts) != 4 and all(p.isdecimal() for p in parts),
        compact.isdecimal() and 13 <= len(compact) <= 19, compact.isdecimal() and 13 <= len(compact) <= 19 and luhn(compact) and compact.isascii(),
        s.startswith("+") and compact[1:].isdecimal() and 9 <= len(compact) - 1 <= 15, s.startswith("+"), compact.isdecimal() and 9 <= len(compact) <= 11 and len(compact) < n,
        compact.isdecimal() and len(compact) < 9, "=" in s and key in _SECRET_WORDS and len(value) >= 8, "=" in s and key in _SECRET_WORDS and len(value) < 8, "=" in s and key not in _SECRET_WORDS,
        words == 1 and len(s) >= 16 and s.isalnum() and changes >= 3 and letters > 0 and len(digits) > 0, s.startswith("AKIA") and len(s) == 20, len(body) >= 16 and hexes == len(body) and 0 < sum(c.isdigit() for c in body) < len(body),
        min(changes, 10) / 5, span[:1] in _STRIP, span[-1:] in _STRIP, lead in _SECRET_WORDS, lead in _LEAD_WORDS, "@" in s, n > 60,
    ], dtype=float)


N_FEATURES = len(features("a", ""))
_TYPES = ["other", *KINDS]
#: The place among the features of the Luhn check; groups of digits.
_LUHN, _DIGITS = 15, re.compile(r"[0-9]+\b")


def _segments(text: str, words: list[tuple[int, int]], first: int = 0, end: int | None = None) -> np.ndarray:
    """Features [end - first, length - 1] of the segments of each length that end at each word, or at those from first to end."""
    end = len(words) if end is None else end
    x = np.zeros((end - first, MOST_WORDS, N_FEATURES))
    for j in range(first, end):
        for size in range(1, min(MOST_WORDS, j + 1) + 1):
            i = j - size + 1
            lead = text[max(words[i - 1][0], words[i - 1][1] - 40) : words[i - 1][1]] if i else ""
            judge = features if words[j][1] - words[i][0] <= 200 else features.__wrapped__  # long spans aren't kept
            x[j - first, size - 1] = judge(text[words[i][0] : words[j][1]], lead)
            if size > 1 and x[j - first, size - 1, _LUHN] and (i and _DIGITS.match(text, *words[i - 1]) or j + 1 < len(words) and _DIGITS.match(text, *words[j + 1])):
                x[j - first, size - 1, _LUHN] = 0  # a part of a longer row of groups
    return x


def _scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores [..., end, length - 1, type]; impossible segments get minus infinity, cards that fail the Luhn check too, and other text is one word at a time."""
    s = x @ model["weights"].T
    s[x[..., 0] == 0] = -np.inf
    s[..., 1:, 0] = -np.inf
    s[..., _TYPES.index("card")][x[..., _LUHN] == 0] = -np.inf
    return s


def _logsum(a: np.ndarray) -> float:
    m = a.max()
    return m + math.log(np.exp(a - m).sum()) if m > -np.inf else -np.inf


def segment(model: dict, text: str, words: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The best segmentation's spans, trimmed. Features are made for ``AT_ONCE`` words at a time, so long stretches are segmented whole."""
    move, n, k = model["moves"], len(words), len(_TYPES)
    best = np.full((n + 1, k), -np.inf)
    best[0, 0] = 0
    back = {}
    for j in range(1, n + 1):
        at = (j - 1) % AT_ONCE
        if not at:
            s = _scores(model, _segments(text, words, j - 1, min(n, j - 1 + AT_ONCE)))
        for size in range(1, min(MOST_WORDS, j) + 1):
            into = best[j - size][:, None] + move
            prev = into.argmax(0)
            value = into.max(0) + s[at, size - 1]
            for t in np.flatnonzero(value > best[j]):
                best[j, t], back[j, t] = value[t], (j - size, prev[t])
    j, t, out = n, int(best[n].argmax()), []
    while j > 0:
        i, p = back[j, t]
        if t:
            start, end = words[i][0], words[j - 1][1]
            a, b = _trim(text[start:end])
            out.append((_TYPES[t], start + a, start + b))
        j, t = i, int(p)
    return out[::-1]


def _expected(model: dict, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected features by type, and expected moves, over all segmentations of a batch of examples [example, end, length - 1, feature] with n words each."""
    s, move = _scores(model, x), model["moves"]
    many, most, k = *x.shape[:2], len(_TYPES)
    fore, aft = np.full((most + 1, many, k), -np.inf), np.full((most + 1, many, k), -np.inf)
    fore[0, :, 0] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(1, most + 1):
            into = [np.logaddexp.reduce(fore[j - size][:, :, None] + move, axis=1) + s[:, j - 1, size - 1] for size in range(1, min(MOST_WORDS, j) + 1)]
            fore[j] = np.logaddexp.reduce(into, axis=0)
        for j in range(most, -1, -1):
            outs = [np.logaddexp.reduce(move + (s[:, j + size - 1, size - 1] + aft[j + size])[:, None, :], axis=2) for size in range(1, min(MOST_WORDS, most - j) + 1)]
            aft[j] = np.where((n == j)[:, None], 0, np.logaddexp.reduce(outs, axis=0) if outs else -np.inf)
        total = np.logaddexp.reduce(fore[n, np.arange(many)], axis=1)
        by_type, moves = np.zeros_like(model["weights"]), np.zeros_like(move)
        for j in range(1, most + 1):
            for size in range(1, min(MOST_WORDS, j) + 1):
                p = np.exp(fore[j - size][:, :, None] + move + (s[:, j - 1, size - 1] + aft[j])[:, None, :] - total[:, None, None])
                moves += p.sum(0)
                by_type += p.sum(1).T @ x[:, j - 1, size - 1]
    return by_type, moves


def examples(seed: int = 7, n: int = 360) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with entities and distractors, as (words, segments by word)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "an", "er", "in", "ou", "le", "de", "ch", "os", "la", "é", "ü"]) for _ in range(r.randint(1, 4)))
    digits = lambda m: "".join(r.choice("0123456789") for _ in range(m))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    hexes = lambda m: "".join(r.choice("0123456789abcdef") for _ in range(m))
    code = lambda m: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(m))
    make = {
        "email": lambda: r.choice([f"{word()}.{digits(2)}@mail{digits(1)}.example.com", f"{word()}_{word()}@{word()}.org", f"{word()} [at] example.org", f"{word()} (at) example.net"]).replace("é", "e").replace("ü", "u"),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 49)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(1, 49)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}"]),
        "secret": lambda: r.choice([f"AKIA{code(16)}", f"password={hexes(18)}", f'token = "{hexes(40)}"', f"api_key={code(24)}", f"secret = {hexes(32)}", f"pwd={word()}{digits(5)}{word()}".replace("é", "e").replace("ü", "u"), f"key {mixed(40)}", f"secret={mixed(30)}"]),
    }
    mixed = lambda m: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(m))

    def no_card() -> str:
        d = digits(r.randint(13, 19))
        d = d[:-1] + next(c for c in "0123456789" if not luhn(d[:-1] + c))
        return r.choice([d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])

    noise = [no_card, no_card, no_card, lambda: mixed(r.randint(8, 12)), lambda: f"{word()}_{word()}_{digits(2)}", lambda: digits(r.randint(1, 6)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: f"{word()}={digits(2)}", lambda: f"x{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"#{digits(4)}", lambda: f"{word()}{digits(1)}", lambda: "password", lambda: "token", lambda: digits(12)]
    out = []
    for _ in range(n):
        text, gold = [], []
        for _ in range(r.randint(2, 4)):
            for _ in range(r.randint(0, 3)):
                text.append(word() + r.choice(["", "", ".", ","]))
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                own = make[kind]().split()
                own[-1] += r.choice(["", "", ".", ","])
                gold.append((kind, len(text), len(text) + len(own)))
                text += own
            else:
                text += r.choice(noise)().split()
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def train(seed: int = 7, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3, together: int = 60) -> dict:
    """Adaptive gradient ascent on the generated examples, in batches of examples of like length; the same model each time."""
    k, data = len(_TYPES), []
    for tokens, gold in examples(seed):
        text, words, at = " ".join(tokens), [], 0
        for w in tokens:
            words.append((at, at + len(w)))
            at += len(w) + 1
        data.append((_segments(text, words), gold))
    data.sort(key=lambda d: len(d[0]))
    batches = []
    for i in range(0, len(data), together):
        part = data[i : i + together]
        n = np.array([len(x) for x, _ in part])
        x = np.zeros((len(part), n.max(), MOST_WORDS, N_FEATURES))
        by_type, moves = np.zeros((k, N_FEATURES)), np.zeros((k, k))
        for e, (own, gold) in enumerate(part):
            x[e, : len(own)] = own
            segments, j, before = [], 0, 0
            for kind, a, b in [*gold, ("", len(own), len(own))]:
                segments += [(q, 1, 0) for q in range(j, a)] + ([(b - 1, b - a, _TYPES.index(kind))] if b > a else [])
                j = b
            for end, size, t in segments:
                by_type[t] += own[end, size - 1]
                moves[before, t] += 1
                before = t
        batches.append((x, n, {"weights": by_type, "moves": moves}))
    model = {"weights": np.zeros((k, N_FEATURES)), "moves": np.zeros((k, k))}
    size = {name: np.full_like(v, 1e-6) for name, v in model.items()}
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(batches)
        for x, n, gold in batches:
            for name, expected in zip(("weights", "moves"), _expected(model, x, n), strict=True):
                g = (gold[name] - expected) / len(n) - decay * model[name]
                size[name] += g * g
                model[name] += rate * g / np.sqrt(size[name])
    return model


def _units(text: str) -> tuple[list[tuple[int, int]], dict[int, tuple[str, int]]]:
    """Words, with each spelled address and access key as one, and (kind, end) of those by start."""
    words = [m.span() for m in _WORD.finditer(text)]
    fixed = {m.start(): ("email", m.end()) for m in _SPELLED.finditer(text)} if _SPELLS.search(text) else {}
    keys = {m.start(): m.end() for m in _KEY.finditer(text)} | {m.start(): m.end() for m in _VALUE.finditer(text) if _MIXED.search(m[1])}
    for a, e in sorted(keys.items()):
        if not any(x < e and a < y for x, (_, y) in fixed.items()):
            fixed[a] = ("secret", e)
    if not fixed:
        return words, fixed
    marks, out, k = sorted((a, e) for a, (_, e) in fixed.items()), [], 0
    for a, b in words:
        while a < b:
            while k < len(marks) and marks[k][1] <= a:
                k += 1
            x, y = marks[k] if k < len(marks) else (b, b)
            if x >= b:
                out.append((a, b))
                break
            if a < x:
                out.append((a, x))
            if a <= x:
                out.append((x, y))
            a = y
    return out, fixed


def _pieces(text: str, words: list[tuple[int, int]], fixed: dict[int, tuple[str, int]]) -> list[tuple[int, int]]:
    """The words split at punctuation and, where they are long, between ASCII and other letters."""
    out = []
    for a, b in words:
        if a in fixed:
            out.append((a, b))
            continue
        for m in _PIECE.finditer(text, a, b):
            out += [m.span()] if b - a <= 60 else [n.span() for n in _NON_ASCII.finditer(text, *m.span())]
    return out


def added_spans(model: dict, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The field's spans that don't overlap a base span: of words first, then of words split at punctuation where they don't overlap those."""
    if not _TRIGGER.search(text) and not _SPELLS.search(text):
        return []
    words, fixed = _units(text)
    taken = sorted((a, b) for _, a, b in base)
    sure = []
    for a, (kind, e) in fixed.items():
        # of a key that has a base span inside, what is left around it
        for x, y in [*_near(taken, a, e), (e, e)]:
            if kind != "secret" and x < e and a < y:
                break
            if kind == "secret" and y > a and min(x, e) > a:
                sure.append((kind, a, min(x, e)))
            elif kind != "secret" and x >= e:
                sure.append((kind, a, e))
            a = max(a, y) if kind == "secret" else a
    taken = sorted([*taken, *((a, b) for _, a, b in sure)])
    runs = list(_stretches(text, words, fixed))
    out = _free(model, text, runs, taken)
    inner = []
    for run in runs:
        if any(b - a >= 8 and a not in fixed and _TRIGGER.search(text, a, b) and (_INNER.search(text, a, b) or b - a > 60) for a, b in run):
            inner += _stretches(text, _pieces(text, run, fixed), fixed)
    # Of a span with separators inside, the piece that is meant; a long one without such a piece, or a rest beside a sure span, is no single datum.
    wide = [x for x in out if _SPLIT.search(text, x[1], x[2]) or x[2] - x[1] > 60]
    out = [x for x in out if x not in wide]
    fine = [x for x in _free(model, text, inner, sorted([*taken, *((a, b) for _, a, b in out)])) if _TRIGGER.search(text, x[1], x[2]) and (x[0] != "email" or "@" in text[x[1] : x[2]])]
    starts, edges = sorted(a for _, a, _ in [*fine, *sure]), {x for _, a, b in sure for x in (a, b)}
    wide = [x for x in wide if bisect_left(starts, x[1]) == bisect_left(starts, x[2]) and edges.isdisjoint(x[1:])]
    out = [x for x in out if edges.isdisjoint(x[1:])]
    held = sorted((a, b) for _, a, b in wide)
    out += [*wide, *(x for x in fine if not any(a < x[2] and x[1] < b for a, b in _near(held, x[1], x[2])))]
    return [*sure, *out]


def _stretches(text: str, words: list[tuple[int, int]], fixed: dict[int, tuple[str, int]]):
    """The stretches of words around triggers."""
    hot = [i for i, (a, b) in enumerate(words) if a in fixed or _TRIGGER.search(text, a, b)]
    k = 0
    while k < len(hot):
        first = max(0, hot[k] - BESIDE)
        last = hot[k] + BESIDE
        while k + 1 < len(hot) and hot[k + 1] - BESIDE <= last + 1:
            k += 1
            last = hot[k] + BESIDE
        k += 1
        yield words[first : last + 1]


def _free(model: dict, text: str, runs, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The field's spans over the runs that don't overlap those taken or each other."""
    out: list[tuple[str, int, int]] = []
    for run in runs:
        for kind, a, b in segment(model, text, run):
            if b > a and not any(x < b and a < y for x, y in _near(taken, a, b)) and not any(x < b and a < y for _, x, y in out[-8:]):
                out.append((kind, a, b))
    return out


def _near(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """The base spans that may overlap [a, b): spans of several kinds may overlap each other, so a few before are looked at."""
    return taken[max(0, bisect_left(taken, (a, a)) - 8) : bisect_left(taken, (b, b))]


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"<{k}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """The rows of docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans (columns of these names are replaced); with mask, text is masked."""
    from pyspark.sql.types import LongType, StringType, StructType

    counts = [f"n_{k}" for k in KINDS[:4]]
    docs = docs.select(*(c for c in docs.columns if c not in (*counts, "base_sha256", "spans")))
    names = docs.columns
    schema = StructType(list(docs.schema.fields))
    for c in counts:
        schema = schema.add(c, LongType())
    schema = schema.add("base_sha256", StringType()).add("spans", StringType())
    model = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        for b in batches:
            n, sha, spans, texts = {k: [] for k in KINDS[:4]}, [], [], []
            for value in b.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                found = base + added_spans(model.value, text, base)
                for k in n:
                    n[k].append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(found))
                if mask:
                    texts.append(masked(text, found) if value.is_valid else None)
            own = [pa.array(texts, b.column("text").type) if mask and c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(n[k], pa.int64()) for k in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def personal_data_counts(spark, sf_dir: str) -> DataFrame:
    """How many spans of each base kind op6_pii finds."""
    return op6_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS[:4]))


QUERIES = {"op6_pii": op6_pii, "personal_data_counts": personal_data_counts}

ORACLE_SQL = {
    "personal_data_counts": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST(y AS BIGINT), 999) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: length(x) BETWEEN 13 AND 19 AND
    list_sum(list_transform(generate_series(1, length(x)), lambda k: CASE WHEN k % 2 = 1 THEN CAST(x[length(x) - k + 1] AS INT) ELSE 2 * CAST(x[length(x) - k + 1] AS INT) - CASE WHEN CAST(x[length(x) - k + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM d
"""
}
