"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans of every whole text: email addresses, IPv4 addresses, card numbers (Luhn) and phone numbers
with a country code.  The model adds spans that are written otherwise (phone numbers without a plus, cards that don't
pass Luhn, spelled-out or masked addresses, digits of other scripts or in words of four languages).  It is trained in numpy, on the driver, from labelled spans that a seeded
generator sets into running text beside things that merely look alike.

Every span holds a digit of any script, an at sign or word, or number words in a row (what the model finds without one is
dropped), so a text needs windows only where one of these is within reach and as far as a span goes on from there.  These windows overlap by half and are decoded each;
a character's tag is that of the window where it is most central, which gives a text one path, so that neither a span's
length nor its offset decides.  Base spans come first, then the candidates of most confidence that overlap nothing chosen
before.

A number of the model must have as many digits as its kind can (``_LEAST_DIGITS`` to ``_MOST_DIGITS``).

Null and empty texts have no spans.  Repeated rows and null or equal ids are rows each; other columns are not read; an empty
table gives an empty result.  Candidates of equal confidence go by start, then kind.  Whole texts are read, a span may be
longer than a window, and time and memory are linear in a text's length, also for long runs of digits.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, prepare, released, table, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Characters of a window, and by how much the next one begins later.
WINDOW, STEP = 64, 32
HIDDEN, EMBEDDING = 20, 12
STEPS, BATCH, SEED = 220, 32, 11
#: A candidate's least mean margin of its path over leaving the span out, by character.
CONFIDENCE = 0.5

#: Digits as words (English, French, German, Spanish), and the signs that addresses spell out.
NUMBERS = "zero one two three four five six seven eight nine oh null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve".split()
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
_NUMBER, _AT_WORD, _DOT_WORD = ("(?:" + "|".join(sorted(x, key=len, reverse=True)) + ")" for x in (NUMBERS, AT_WORDS, DOT_WORDS))
_AT = re.compile(rf"[@＠]|[\[({{<]\s?{_AT_WORD}\s?[\])}}>]|(?<=\s){_AT_WORD}(?=\s)", re.I)
_DOTTED = re.compile(rf"\w(?:\s?[.．]\s?|\s?[\[({{<]\s?(?:[.．]|{_DOT_WORD})\s?[\])}}>]\s?|\s{_DOT_WORD}\s)\w", re.I)
_SPELLED = re.compile(rf"\b{_NUMBER}\b", re.I)
#: What a span must hold one of: a digit of any script, an at sign or word, or a number word after which another one or a digit follows.
_DIGIT, _SIGN, _IN_BRACKETS = re.compile(r"\d"), re.compile("[@＠]"), re.compile(rf"[\[({{<]\s?{_AT_WORD}\s?[\])}}>]", re.I)
_BARE_AT = re.compile(rf"\s{_AT_WORD}(?=\s)", re.I)
_IN_A_ROW = re.compile(rf"\b{_NUMBER}\b(?=[\s,.()\-–]{{1,3}}(?:\W?{_DOT_WORD}\W{{1,2}})?(?:{_NUMBER}\b|\d))", re.I)
_TOKEN = re.compile(r"\w+")
#: Letters that expressions take for others whatever their case, where lower() doesn't.
_ODD = re.compile("[\u0130\u0131\u017f\u212a]")
_BASE = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in that order."""
    if not _BASE.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # every match of the address pattern holds one @, after as long a local part as is free
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- characters ----------------------------------------------------------------------------------------------------

_SIGNS = " \n\t@.+-_%()[]<>/:,;'\"#*=|!$&"
_SYMBOL = {**{c: 1 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}, **{c: 27 for c in "0123456789"}, **{c: 28 + i for i, c in enumerate(_SIGNS)}}
N_SYMBOLS = 28 + len(_SIGNS) + 5
_LETTER, _OTHER = N_SYMBOLS - 2, N_SYMBOLS - 1
#: Letters of number, at and dot words have symbols of their own.
_WORDS = re.compile(rf"\b(?:({_NUMBER})|({_AT_WORD})|({_DOT_WORD}))\b", re.I)
_REACH = 1 + max(map(len, (*NUMBERS, *AT_WORDS, *DOT_WORDS)))


@lru_cache(1 << 16)
def symbol(c: str) -> int:
    """Digits of any script are digits, full-width signs and letters are what they stand for."""
    if c.isdecimal():
        return 27
    wide = unicodedata.normalize("NFKC", c) if "！" <= c <= "～" else c
    return _SYMBOL.get(wide) or _SYMBOL.get(wide.lower()) or (_LETTER if c.isalpha() else _OTHER)


def symbols(text: str) -> np.ndarray:
    out = np.array([symbol(c) for c in text], np.int64)
    for m in _WORDS.finditer(text):
        out[m.start() : m.end()] = N_SYMBOLS - 6 + m.lastindex
    return out


# -- labelled spans ----------------------------------------------------------------------------------------------------


def _digits(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice("0123456789") for _ in range(n))


def _word(rnd: random.Random) -> str:
    w = "".join(rnd.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve éc ä ü ß ña ción".split()) for _ in range(rnd.randint(1, 4)))
    return w.capitalize() if rnd.random() < 0.15 else w


def _address(rnd: random.Random) -> str:
    name, host, top = _word(rnd).encode("ascii", "ignore").decode() or "an", rnd.choice(["mail", "post", "web", "corp"]) + rnd.choice(["", _digits(rnd, 1)]), rnd.choice(["com", "org", "net", "example.com", "de"])
    name += rnd.choice(["", "." + _digits(rnd, 2), "_" + _digits(rnd, 1), "." + _word(rnd).encode("ascii", "ignore").decode()])
    if rnd.random() < 0.2:  # long ones, also of more than a window
        name, host = (".".join((_word(rnd) + _word(rnd)).encode("ascii", "ignore").decode() or "an" for _ in range(rnd.randint(1, 4))) for _ in range(2))
    if rnd.random() < 0.25:
        at, dot = rnd.choice(AT_WORDS[:1] * 4 + AT_WORDS[1:]), rnd.choice(DOT_WORDS[:1] * 4 + DOT_WORDS[1:])
        at, dot = rnd.choice([(at, dot), (at, dot), (at.upper(), dot.upper())])
        at = rnd.choice([f" {at} ", f" {at} ", f" [{at}] ", f"[{at}]", f" ({at}) ", f"({at})", f" <{at}> ", f" {{{at}}} "])
        dot = "." if rnd.random() < 0.15 else rnd.choice([f" {dot} ", f" {dot} ", f" [{dot}] ", f"[{dot}]", f" ({dot}) ", f"({dot})"])
        return name + at + (host + "." + top).replace(".", dot)
    return rnd.choice([f"{name}@{host}.{top}"] * 4 + [f"{name} @ {host}.{top}", f"{name}@{host} . {top}", f"{name}@{host} dot {top}", f"{name}@{host}[.]{top}"])


def _aloud(rnd: random.Random, s: str) -> str:
    """Digits as words of one language, dots of an address too."""
    words = rnd.choice([NUMBERS[:10]] * 3 + [NUMBERS[11:21], ["zéro", *NUMBERS[22:27], "six", *NUMBERS[27:30]], NUMBERS[30:40]])
    dot, between = rnd.choice(DOT_WORDS[:1] * 3 + DOT_WORDS[1:]), rnd.choice([" ", " ", " ", "-", ", "])
    out = between.join(words[int(c)] if c.isdigit() else dot for c in s if c.isdigit() or c == ".")
    return out.capitalize() if rnd.random() < 0.1 else out


def _script(rnd: random.Random, s: str) -> str:
    """Digits of another script; full-width ones come with full-width signs."""
    zero = rnd.choice("０٠۰०")
    return "".join(chr(ord(zero) + int(c)) if "0" <= c <= "9" else chr(ord(c) + 0xFEE0) if zero == "０" and "!" <= c <= "~" else c for c in s)


def _ip(rnd: random.Random) -> str:
    p = [str(rnd.randint(0, 255)) for _ in range(4)]
    return rnd.choice([".".join(p)] * 4 + [" . ".join(p), "[.]".join(p)])


def _card(rnd: random.Random) -> str:
    d = str(rnd.randint(3, 6)) + _digits(rnd, 15)
    return rnd.choice([d, d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"])


def _phone(rnd: random.Random) -> str:
    a, b, c = _digits(rnd, 3), _digits(rnd, 3), _digits(rnd, 4)
    return rnd.choice([f"+1 ({a}) {b}-{c}", f"+{_digits(rnd, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{_digits(rnd, 2)} {a} {b}{c}"])


def _lookalike(rnd: random.Random) -> str:
    hexes = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(16, 40)))
    return rnd.choice([hexes, f'"{hexes}"', _digits(rnd, rnd.randint(1, 6)), _digits(rnd, rnd.randint(22, 30)), f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1900, 2030)}", f"version {rnd.randint(1, 9)}.{rnd.randint(0, 20)}", f"{rnd.randint(1, 9)},{_digits(rnd, 3)}", f"@{_word(rnd)}", f"{rnd.randint(1900, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"{rnd.randint(1, 23)}:{_digits(rnd, 2)}", "$" + _digits(rnd, 4), f"No. {_digits(rnd, 4)}"] + [f"{_word(rnd)} at {_word(rnd)}", f"at {_word(rnd)}. {_word(rnd)}", f"{_word(rnd)} at {_word(rnd)}, {_word(rnd)} at {_word(rnd)}. {_word(rnd)}", rnd.choice(NUMBERS), f"{rnd.choice(NUMBERS)} {_word(rnd)}", f"{rnd.choice(NUMBERS)} or {rnd.choice(NUMBERS)}", f"{rnd.choice(NUMBERS)} {rnd.choice(NUMBERS)}", f"{rnd.choice(DOT_WORDS)} {_word(rnd)}"])


def spelled(rnd: random.Random, kind: int, s: str) -> str:
    """The span as it is, in digits of another script or, but for addresses of mail, in words."""
    r = rnd.random()
    if r < 0.04:
        return _script(rnd, s)
    if kind and r < (0.08 if kind == 2 else 0.24):
        return _aloud(rnd, s if kind == 1 and "[" not in s else "".join(c for c in s if c.isdigit()))
    return s


def labelled(rnd: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows of running text with spans and look-alikes in it."""
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    make = (_address, _ip, _card, _phone)
    for i in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            r = rnd.random()
            kind = rnd.randrange(4) if r < 0.18 else -1
            piece = spelled(rnd, kind, make[kind](rnd)) if kind >= 0 else _lookalike(rnd) if r < 0.29 else _word(rnd)
            tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)
            after = rnd.choice([" "] * 8 + [". ", ", ", ".\n", "$$$ ", "!! ", "### ", " | "])
            text, tags = text + piece + after, tags + [0] * len(after)
        at = rnd.randrange(len(text) - WINDOW)
        own = tags[at : at + WINDOW]
        for j, t in enumerate(own):  # a span cut at the window's start begins there
            if t == 0 or t % 2:
                break
            own[j] = t - 1 if j == 0 else t
        xs[i], ys[i] = symbols(text)[at : at + WINDOW], own
    return xs, ys


# -- the network ---------------------------------------------------------------------------------------------------------


def _allowed() -> np.ndarray:
    """What a tag may be followed by: inside only by its own begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
FIRST = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])
_NO = -1e4


def initial(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)

    def w(*shape):
        return g.normal(0, 1 / np.sqrt(shape[0]), shape)

    p = {"embedding": w(N_SYMBOLS, EMBEDDING) * np.sqrt(N_SYMBOLS) * 0.5, "out": w(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p[f"wx_{d}"], p[f"wh_{d}"], b = w(EMBEDDING, 4 * HIDDEN), w(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
        b[HIDDEN : 2 * HIDDEN] = 1  # of the forget gate
        p[f"b_{d}"] = b
    return p


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, wx, wh, b, keep: bool) -> tuple[np.ndarray, list]:
    """x: windows, time, features; hidden states and, for training, what each step made."""
    n, t, _ = x.shape
    pre = x @ wx + b
    h, c, hs, trace = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype), np.zeros((n, t, HIDDEN), x.dtype), []
    for k in range(t):
        z = pre[:, k] + h @ wh
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            trace.append((i, f, o, g, before, tc, h))
        h = o * tc
        hs[:, k] = h
    return hs, trace


def lstm_back(x, dh, trace, wx, wh) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, t, _ = x.shape
    dz = np.zeros((n, t, 4 * HIDDEN))
    dwh, nh, nc = np.zeros_like(wh), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for k in reversed(range(t)):
        i, f, o, g, before, tc, h0 = trace[k]
        d = dh[:, k] + nh
        dc = nc + d * o * (1 - tc * tc)
        z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        nc = dc * f
        dz[:, k] = z
        dwh += h0.T @ z
        nh = z @ wh.T
    return np.einsum("nte,ntz->ez", x, dz), dwh, dz.sum((0, 1)), dz @ wx.T


def emissions(p: dict, xs: np.ndarray, keep: bool = False):
    x = p["embedding"][xs]
    hf, tf = lstm(x, p["wx_f"], p["wh_f"], p["b_f"], keep)
    hb, tb = lstm(x[:, ::-1], p["wx_b"], p["wh_b"], p["b_b"], keep)
    h = np.concatenate([hf, hb[:, ::-1]], 2)
    return h @ p["out"] + p["out_b"], (x, h, tf, tb)


def total(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)


def loss_and_slopes(p: dict, xs: np.ndarray, ys: np.ndarray) -> tuple[float, dict]:
    """Negative log-likelihood of the tags by the CRF, and its gradient."""
    e, (x, h, tf, tb) = emissions(p, xs, keep=True)
    n, t, _ = e.shape
    trans = np.where(ALLOWED, p["trans"], _NO)
    start = np.where(FIRST, 0.0, _NO)
    a, b = np.zeros((n, t, TAGS)), np.zeros((n, t, TAGS))
    a[:, 0] = start + e[:, 0]
    for k in range(1, t):
        a[:, k] = total(a[:, k - 1, :, None] + trans, 1) + e[:, k]
    for k in reversed(range(t - 1)):
        b[:, k] = total(trans + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
    z = total(a[:, -1], 1)
    rows, cols = np.arange(n)[:, None], np.arange(t)[None]
    gold = e[rows, cols, ys].sum(1) + trans[ys[:, :-1], ys[:, 1:]].sum(1)
    de = np.exp(a + b - z[:, None, None])
    de[rows, cols, ys] -= 1
    dt = np.exp(a[:, :-1, :, None] + trans + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    np.add.at(dt, (ys[:, :-1], ys[:, 1:]), -1)
    out = {"trans": dt * ALLOWED, "out": np.einsum("nth,ntk->hk", h, de), "out_b": de.sum((0, 1))}
    dh = de @ p["out"].T
    out["wx_f"], out["wh_f"], out["b_f"], dx = lstm_back(x, dh[:, :, :HIDDEN], tf, p["wx_f"], p["wh_f"])
    out["wx_b"], out["wh_b"], out["b_b"], dxb = lstm_back(x[:, ::-1], dh[:, ::-1, HIDDEN:], tb, p["wx_b"], p["wh_b"])
    out["embedding"] = np.zeros_like(p["embedding"])
    np.add.at(out["embedding"], xs, dx + dxb[:, ::-1])
    return float((z - gold).mean()), {k: v / n for k, v in out.items()}


@lru_cache(2)
def trained(steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The model; the same numbers at each call."""
    rnd, p = random.Random(seed), initial(seed)
    m, v, mean = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(3))  # the result is the mean of the last quarter of steps
    for step in range(1, steps + 1):
        xs, ys = labelled(rnd, BATCH)
        _, slopes = loss_and_slopes(p, xs, ys)
        norm = np.sqrt(sum((g * g).sum() for g in slopes.values()))
        rate = 0.02 * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for k, g in slopes.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            mean[k] += (p[k] - mean[k]) / max(1, step - steps * 3 // 4)
    return {k: w.astype(np.float32) for k, w in mean.items()}


def decoded(p: dict, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best path of tags of each window, and by how much each character's tag beats outside on its own emission."""
    e, _ = emissions(p, xs)
    n, t, _ = e.shape
    trans = np.where(ALLOWED, p["trans"], _NO).astype(np.float32)
    best, back = e[:, 0] + np.where(FIRST, 0, _NO), np.zeros((n, t, TAGS), np.int8)
    for k in range(1, t):
        s = best[:, :, None] + trans
        back[:, k] = s.argmax(1)
        best = s.max(1) + e[:, k]
    path = np.zeros((n, t), np.int64)
    path[:, -1] = best.argmax(1)
    for k in reversed(range(1, t)):
        path[:, k - 1] = back[np.arange(n), k, path[:, k]]
    return path, np.take_along_axis(e, path[:, :, None], 2)[:, :, 0] - e[:, :, 0]


# -- texts -------------------------------------------------------------------------------------------------------------


def may_be_in_a_row(tokens: list[str]) -> bool:
    """Whether a number word stands before another one or a digit, perhaps with a dot word between."""
    last = len(tokens) - 1
    for i, t in enumerate(tokens):
        if t in _NUMBER_SET and i < last:
            after = tokens[i + 1]
            if after in _DOT_SET and i + 1 < last:
                after = tokens[i + 2]
            if after in _NUMBER_SET or after[0].isdecimal():
                return True
    return False


_NUMBER_SET, _DOT_SET, _AT_SET = frozenset(NUMBERS), frozenset(DOT_WORDS), frozenset(AT_WORDS)


def triggers(text: str) -> list[int]:
    """Where a span may hold what it must; the slower expressions only where the text's words call for them."""
    out = [m.start() for m in _DIGIT.finditer(text)]
    out += [m.start() for m in _SIGN.finditer(text)]
    odd, tokens = bool(_ODD.search(text)), _TOKEN.findall(text.lower())
    if odd or not _AT_SET.isdisjoint(tokens):
        out += [m.start() for m in _IN_BRACKETS.finditer(text)]
        out += [m.start() + 1 for m in _BARE_AT.finditer(text)]
    if odd or may_be_in_a_row(tokens):
        out += [m.start() for m in _IN_A_ROW.finditer(text)]
    return sorted(out)


def window_starts(found: list[int]) -> list[int]:
    """Starts of overlapping windows that see every trigger with its surroundings."""
    out: list[int] = []
    for at in found:
        first = max(0, (at - WINDOW + 1 + STEP - 1) // STEP * STEP)
        s = first if not out else max(first, out[-1] + STEP)
        while s <= at:
            out.append(s)
            s += STEP
    return out


_LEAST_DIGITS = {0: 0, 1: 4, 2: 13, 3: 7}
_MOST_DIGITS = {0: 40, 1: 12, 2: 19, 3: 15}


def plausible(kind: int, s: str) -> bool:
    """What a span of the model must hold besides its tags and a trigger."""
    digits = sum(c.isdecimal() for c in s) + (len(_SPELLED.findall(s)) if kind else 0)
    if not _LEAST_DIGITS[kind] <= digits <= _MOST_DIGITS[kind]:
        return False
    if kind == 0:
        at = _AT.search(s)
        return bool(at) and at.start() > 0 and bool(_DOTTED.search(s, at.end()))
    rest = _SPELLED.sub("", s)
    if kind == 1:
        rest = re.sub(rf"\b{_DOT_WORD}\b", "", rest, flags=re.I)
    return not any(c.isalpha() for c in rest) or kind == 1 and "." in s


def owned(start: int, n: int) -> tuple[int, int]:
    """The characters of a text of n that this window sees most centrally; these ranges tile the text."""
    side = (WINDOW - STEP) // 2
    return start + side if start else 0, n if start + WINDOW - side >= n else start + WINDOW - side


def missing(n: int, seen: dict[int, tuple[np.ndarray, np.ndarray]], reach: int) -> list[int]:
    """Windows not decoded yet into which a span of the decoded ones may go on, ``reach`` of them at each end."""
    out = set()
    for s, (path, _) in seen.items():
        lo, hi = owned(s, n)
        if lo >= hi:
            continue
        if s and path[lo - s] and s - STEP not in seen:
            out.update(range(s - STEP, max(s - reach * STEP, 0) - 1, -STEP))
        if hi < n and path[hi - 1 - s] and s + STEP not in seen:
            out.update(x for x in range(s + STEP, s + (reach + 1) * STEP, STEP) if owned(x, n)[0] < n)
    return sorted(out - seen.keys())


def candidates(text: str, seen: dict[int, tuple[np.ndarray, np.ndarray]], found: list[int]) -> list[tuple[float, int, int, int]]:
    """(confidence, start, kind, end) of the spans of the text's one path, each character of it from the window where it
    is most central.  Spans of a kind (addresses of mail, or numbers) that meet where the windows change are one;
    of cards and phones the digits' count decides where the model's kind can't be."""
    runs: list[list] = []  # start, kind, end, sum of margins
    before = -1  # end of what was looked at
    for s in sorted(seen):
        lo, hi = owned(s, len(text))
        path, margin = seen[s]
        for at in (lo + np.flatnonzero(path[lo - s : hi - s])).tolist() if lo < hi else []:
            tag = int(path[at - s])
            kind = (tag - 1) // 2
            seam = at == lo and before == lo
            if runs and runs[-1][2] == at and (seam and bool(runs[-1][1]) == bool(kind) or runs[-1][1] == kind and tag % 2 == 0):
                runs[-1][2] += 1
                runs[-1][3] += float(margin[at - s])
            else:
                runs.append([at, kind, at + 1, float(margin[at - s])])
        before = hi
    out = []
    for a, kind, b, total_margin in runs:
        c = total_margin / (b - a)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b and kind >= 2 and not plausible(kind, text[a:b]):
            kind = 5 - kind
        if a < b and c >= CONFIDENCE and plausible(kind, text[a:b]) and (k := bisect_left(found, a)) < len(found) and found[k] < b:
            out.append((-c, a, kind, b))
    return sorted(out)


def reconciled(base: list[tuple[int, int, int]], found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and candidates by falling confidence that overlap none chosen before."""
    taken: list[tuple[int, int]] = []  # disjoint, so only the last one before a candidate's end can overlap it
    for s, _, e in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))
    out = list(base)
    for _, s, kind, e in found:
        i = bisect_left(taken, (e, -1))
        if not i or taken[i - 1][1] <= s:
            insort(taken, (s, e))
            out.append((s, kind, e))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(p: dict, batch_texts: list[str], at_once: int = 2048, every: Callable[[str], list[int]] | None = None) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text.  Windows round what a span must hold are decoded first, then, as far as a
    span goes on, the next ones; so all spans are those that decoding every window (``every`` gives their starts) would give."""
    seen: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in batch_texts]
    found = [triggers(t) for t in batch_texts]
    queue, reach = [(i, s) for i, t in enumerate(batch_texts) for s in (every(t) if every else window_starts(found[i]))], 1
    while queue:
        for lo in range(0, len(queue), at_once):
            part = queue[lo : lo + at_once]
            xs = np.full((len(part), WINDOW), _SYMBOL["\n"], np.int64)
            for j, (i, s) in enumerate(part):
                first = max(0, s - _REACH)  # words at the edges are seen whole
                x = symbols(batch_texts[i][first : s + WINDOW + _REACH])[s - first : s - first + WINDOW]
                xs[j, : len(x)] = x
            paths, margins = decoded(p, xs)
            for (i, s), path, margin in zip(part, paths.astype(np.int8), margins, strict=True):
                seen[i][s] = path, margin
        touched = sorted({i for i, _ in queue})
        queue = [(i, s) for i in touched for s in missing(len(batch_texts[i]), seen[i], reach)]
        reach *= 2
    for t, own, at in zip(batch_texts, seen, found, strict=True):
        base = base_spans(t)
        yield base, reconciled(base, candidates(t, own, at)) if own else base


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def marked(model):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict = {f.name: [] for f in OUT if f.name != "doc_id"}
            for base, spans in spans_of(model.value, b.column("text").to_pylist()):
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(x[1] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(spans))
            yield batch(rows | {"doc_id": b.column("doc_id")}, OUT)

    return run


def personal_data(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every document."""
    prepare(spark)
    model = spark.sparkContext.broadcast(trained())
    return texts(documents).mapInArrow(marked(model), ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in OUT))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (of overlapping ones their union) replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s < at:  # an overlap: what is left of it goes too
            at = max(at, e)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with their own columns, whatever these are called, personal data masked in the text (and n_chars, if
    there is one, as it is then).  Null texts stay null; every row stays, repeated ones too; very long texts are masked
    whole; an empty table stays empty."""
    prepare(spark)
    model = spark.sparkContext.broadcast(trained())
    names, own = documents.columns, [f"c{i}" for i in range(len(documents.columns))]
    documents = documents.toDF(*own)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            old = b.column(at).to_pylist()
            found = spans_of(model.value, [t or "" for t in old])
            new = [t if t is None else masked(t, spans) if spans else t for t, (_, spans) in zip(old, found, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if t == o else len(t) for n, t, o in zip(cols[k].to_pylist(), new, old, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return documents.mapInArrow(run, documents.schema).toDF(*names)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark, table(spark, sf_dir, "documents"))
