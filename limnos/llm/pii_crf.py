"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns' matches (the base) always stay. The CRF is trained on a small labelled table, here or given, and adds what it
finds elsewhere: personal data in spellings that the patterns miss. A token's features are numbers of its shape
(digits, letters, signs, what it starts and ends with, lengths in steps) and those of its neighbours.

Texts are tokenised, scored and decoded in numpy batches, many texts laid end to end. The field is trained on whole texts, and its labels
are those of Viterbi over whole texts, though the recursion visits only tokens that a bound does not rule out.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"[0-9]++(?:\.[0-9]++(?:\.[0-9]++(\.[0-9]++)?)?)?")  # a run that falls short is taken too, so that long ones are read once
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the local characters before it, not beyond the last match's end, and a domain after it. Read from the @ on, so that long runs cost linear time."""
    end, before, at = 0, 0, text.find("@")
    while at >= 0:
        piece = text[max(end, before) : at]
        start = at - (len(piece) - len(piece.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        before = at + 1
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind number and end of every pattern's match that holds, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# Character classes: 0 white space, 1 a-z, 2 A-Z, 3 digit, 4 other letters, 5 @, 6 ., 7 -, 8 +, 9 ( or ), 10 other signs.
def _char_classes() -> np.ndarray:
    out = np.full(129, 10, np.uint8)
    out[128] = 4
    for c in range(128):
        s = chr(c)
        out[c] = 0 if s.isspace() else 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else {"@": 5, ".": 6, "-": 7, "+": 8, "(": 9, ")": 9}.get(s, 10)
    return out


_CLASS = _char_classes()
N_CLASSES = 11
#: Cells (rows times tokens) that a decoded batch holds at most, longer single parts apart.
CELLS = 200_000
#: Words whose neighbourhood tells a label; a fixed list, in lower case.
CUES = ("phone", "tel", "call", "mobile", "fax", "email", "mail", "contact", "write", "ip", "host", "server", "address", "card", "visa", "paid", "account", "at", "dot")


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, the characters' classes and codes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _CLASS[np.minimum(codes, 128)]
    wide = np.flatnonzero(codes >= 128)
    if wide.size:
        classes[wide[np.isin(codes[wide], _WIDE_SPACES)]] = 0
    live = np.zeros(len(codes) + 2, np.int8)
    np.greater(classes, 0, out=live[1:-1], casting="unsafe")
    edges = np.flatnonzero(np.diff(live))
    return edges[::2], edges[1::2], classes, codes


_WIDE_SPACES = np.array([c for c in range(128, 0x3001) if chr(c).isspace()], np.uint32)

#: Feature numbers of a token: counts of digits and other classes in steps, first and last class, cues, whether (at), [at], (dot) or [dot] is within.
_DIGIT_STEPS = np.array([0, 1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 16, 17, 20], np.int64)
_SIZES = (len(_DIGIT_STEPS), 3, 3, 5, 4, 2, 2, 3, N_CLASSES, N_CLASSES, len(CUES) + 1, 3)
N_FEATURES = sum(_SIZES)
_OFFSETS = np.cumsum([0, *_SIZES[:-1]])
_RADIX = np.cumprod([1, *_SIZES[:-1]], dtype=np.int64)


def _packed(word: str) -> int:
    return int.from_bytes(word.encode().ljust(8, b"\0"), "little")


_CUE_CODES = np.array(sorted(map(_packed, CUES)), np.uint64)
_CUE_HEADS = np.zeros((128, 128), bool)
for _w in CUES:
    _CUE_HEADS[ord(_w[0]), ord(_w[1])] = True


def _cues(codes: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each token 1 + the place of the cue that its letters, if they stand first, spell; else 0. Two letters sieve, eight packed in a number decide."""
    out = np.zeros(len(starts), np.int64)
    low = np.minimum(codes, 127).astype(np.uint8) | 32
    second = np.minimum(starts + 1, len(codes) - 1)
    at = np.flatnonzero((letters >= 2) & (letters <= 8))
    at = at[_CUE_HEADS[low[starts[at]], low[second[at]]]]
    packed = np.zeros(len(at), np.uint64)
    for i in range(8):
        place = np.minimum(starts[at] + i, len(codes) - 1)
        packed |= np.where(i < letters[at], low[place], 0).astype(np.uint64) << np.uint64(8 * i)
    found = np.minimum(np.searchsorted(_CUE_CODES, packed), len(_CUE_CODES) - 1)
    out[at] = np.where(_CUE_CODES[found] == packed, found + 1, 0)
    return out


def _bracketed(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token 1 if it holds (at) or [at], 2 if (dot) or [dot], of several the last; else 0."""
    out = np.zeros(len(starts), np.int64)
    opens = np.flatnonzero((codes == ord("(")) | (codes == ord("[")))
    for number, word in ((1, "at"), (2, "dot")):
        at = opens[opens + len(word) + 1 < len(codes)]
        for i, c in enumerate(word, 1):
            at = at[(codes[at + i] | 32) == ord(c)]
        close = codes[at + len(word) + 1]
        at = at[(close == ord(")")) | (close == ord("]"))]
        out[np.searchsorted(starts, at, "right") - 1] = number
    return out


def features(starts: np.ndarray, ends: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(token, group) feature numbers, by running sums over the characters' classes."""
    n = len(starts)
    if not n:
        return np.zeros((0, len(_SIZES)), np.int64)
    sums = np.zeros(len(classes) + 1, np.int32)

    def count(where: np.ndarray) -> np.ndarray:
        if not where.any():
            return np.zeros(n, np.int32)
        np.cumsum(where, out=sums[1:])
        return sums[ends] - sums[starts]

    is_letter = np.zeros(N_CLASSES, bool)
    is_letter[[1, 2, 4]] = True
    letters = count(is_letter[classes])
    rare = [count(classes == k) for k in (3, 5, 6, 7, 8, 9, 10)]
    groups = (
        np.searchsorted(_DIGIT_STEPS, rare[0], "right") - 1,
        np.minimum(letters, 2),
        np.minimum(rare[1], 2),
        np.minimum(rare[2], 4),
        np.minimum(rare[3], 3),
        np.minimum(rare[4], 1),
        np.minimum(rare[5], 1),
        np.minimum(rare[6], 2),
        classes[starts],
        classes[ends - 1],
        _cues(codes, starts, letters),
        _bracketed(codes, starts),
    )
    return np.stack(groups, 1).astype(np.int64) + _OFFSETS


class CRF:
    """Labels: O, and B and I of each kind. A label's score for a token sums the weights of its features, and of its neighbours' by their side."""

    LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

    def __init__(self):
        n = len(self.LABELS)
        self.emit = np.zeros((3, N_FEATURES, n))  # own, previous and next token
        self.step = np.zeros((n, n))
        # An I follows its own B or I alone, and starts no text.
        self.banned = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in self.LABELS] for a in self.LABELS])
        self.first_banned = np.array([b.startswith("I-") for b in self.LABELS])

    def scores(self, f: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """(token, label) scores; each distinct row of features is summed once. first: which tokens start a text, if there are several."""
        kinds, at = np.unique((f - _OFFSETS) @ _RADIX, return_index=True)
        row = np.searchsorted(kinds, (f - _OFFSETS) @ _RADIX)
        own, before, after = (w[f[at]].sum(1) for w in self.emit)
        out = own[row]
        inner = np.ones(len(f) - 1, bool) if first is None else ~first[1:]
        out[1:][inner] += before[row[:-1][inner]]
        out[:-1][inner] += after[row[1:][inner]]
        return out

    def gradient(self, f: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """A sequence's negative log likelihood and its gradients for emit and step, by the forward and backward sums."""
        n = len(self.LABELS)
        e = self.scores(f)
        step = np.where(self.banned, -1e4, self.step)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = np.where(self.first_banned, -1e4, 0) + e[0]
        for t in range(1, len(e)):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + step, 0) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(step + e[t + 1] + beta[t + 1], 1)
        z = np.logaddexp.reduce(alpha[-1])
        loss = z - e[np.arange(len(y)), y].sum() - step[y[:-1], y[1:]].sum()
        grad = np.exp(alpha + beta - z)
        grad[np.arange(len(y)), y] -= 1
        g_emit = np.zeros_like(self.emit)
        for k in range(f.shape[1]):
            np.add.at(g_emit[0], f[:, k], grad)
            np.add.at(g_emit[1], f[:-1, k], grad[1:])
            np.add.at(g_emit[2], f[1:, k], grad[:-1])
        g_step = np.zeros((n, n))
        for t in range(1, len(e)):
            g_step += np.exp(alpha[t - 1][:, None] + step + e[t] + beta[t] - z)
            g_step[y[t - 1], y[t]] -= 1
        return float(loss), g_emit, g_step

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 30, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> CRF:
        """AdaGrad on the sequences' log likelihood; rows: feature numbers and label numbers."""
        rng = np.random.default_rng(seed)
        sq_emit, sq_step = np.full_like(self.emit, 1e-3), np.full_like(self.step, 1e-3)
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                _, g_emit, g_step = self.gradient(*rows[r])
                for w, g, sq in ((self.emit, g_emit + decay * self.emit, sq_emit), (self.step, g_step + decay * self.step, sq_step)):
                    sq += g * g
                    w -= rate * g / np.sqrt(sq)
        return self

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many texts' scores at once; before and after a text stands O."""
        step = np.where(self.banned, -1e9, self.step)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 4096 and (hi + 1 - lo) * len(texts[order[hi]]) <= CELLS:
                hi += 1
            rows, lo = order[lo:hi], hi
            length = np.array([len(texts[i]) for i in rows])
            e = np.zeros((len(rows), length[-1], len(self.LABELS)))
            for r, i in enumerate(rows):
                e[r, : length[r]] = texts[i]
            best, back = step[0] + e[:, 0], np.zeros(e.shape, np.int64)
            final = np.where((length == 1)[:, None], best, 0)
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + step
                back[:, t] = through.argmax(1)
                best = through.max(1) + e[:, t]
                final = np.where((length == t + 1)[:, None], best, final)
            y = (final + step[:, 0]).argmax(1)
            path = np.zeros(e.shape[:2], np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                live = length > t
                path[live, t] = y[live]
                y = np.where(live & (t > 0), back[np.arange(len(rows)), t, y], y)
            for r, i in enumerate(rows):
                out[i] = path[r, : length[r]]
        return out

    def may_bear(self, e: np.ndarray) -> np.ndarray:
        """Which tokens may bear a label in a best labelling, by a bound that holds for any weights.

        A block of labels pays only if it gains over O throughout. A token adds to a block's gain at most the best of its labels' scores
        with the best step into it, over O's; entering and leaving add at most a constant. So a token bears none unless some
        run about it gains enough, and the best run that ends, or begins, at each token comes from running sums and their least values.
        """
        inner = np.array([self.step[1:, y][~self.banned[1:, y]].max() for y in range(1, len(self.LABELS))])
        enters = ~self.banned[0, 1:]
        most = (self.step[0, 1:] - inner)[enters].max() + self.step[1:, 0].max() - self.step[0, 0]
        gain = (e[:, 1:] + inner).max(1) - e[:, 0] - self.step[0, 0]

        def best_run(x: np.ndarray) -> np.ndarray:
            upto = np.cumsum(x)
            return upto - np.minimum.accumulate(np.concatenate([[0.0], upto[:-1]]))

        return best_run(gain) + best_run(gain[::-1])[::-1] - gain + most >= -1e-6

    def label(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of texts laid end to end, those of Viterbi over each whole text. Between tokens that bear no label the labelling falls apart, so
        Viterbi runs over the stretches of those that may, all at once; what lies between is O."""
        out = np.zeros(len(f), np.int64)
        if not len(f):
            return out
        e = self.scores(f, first)
        live = np.flatnonzero(self.may_bear(e))
        pieces = np.split(live, np.flatnonzero((np.diff(live) > 1) | first[live[1:]]) + 1) if len(live) else []
        for at, y in zip(pieces, self.decode([e[p] for p in pieces]), strict=True):
            out[at] = y
        return out


def _sample_row(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence of the labelled table: made-up words, and personal data in spellings with and without the patterns' marks."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 11)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def item() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            site, top = f"{word()}{rng.choice(['', '', '2'])}", rng.choice(["com", "org", "net", "example.com"])
            name = rng.choice([f"{word()}.{digits(2)}", word(), f"{word()}.{word()}"])
            spoken = rng.choice([name, f"{word()} dot {word()}"])
            return rng.choice([f"{name}@{site}.{top}", f"{spoken} at {site} dot {top.split('.')[-1]}", f"{name}(at){site}.{top}", f"{name}[at]{site}.{top}", f"{name} (at) {site} (dot) com", f"{name} [at] {site} [dot] com"]), kind
        if kind == "ip":
            p = [str(rng.randrange(256)) for _ in range(4)]
            return rng.choice([".".join(p), ".".join(p), " . ".join(p)]), kind
        if kind == "card":
            d = digits(15)
            d += next(c for c in "0123456789" if luhn(d + c))
            return rng.choice([d, d, "-".join(re.findall("....", d)), " ".join(re.findall("....", d)), ".".join(re.findall("....", d))]), kind
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"+{digits(2)}{a}{b}{c}"]), kind

    def filler() -> str:
        w = word()
        sign = rng.choice(["", "", "", "", ",", ".", "!!", "***", "%%%", " |"])
        plain = [w, w.title(), w.upper(), w + sign, w.title() + sign]
        other = [digits(rng.randint(1, 8)), f"{rng.randrange(100)}.{rng.randrange(10)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", "".join(rng.choice("0123456789abcdef") for _ in range(32)) + sign, f'"{digits(3)}{w}{digits(5)}"', "token = ", digits(16), f"{digits(2)}:{digits(2)}", f"http://{w}.org/{digits(3)}", f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", "(c) 2020", f"at {w} dot", f"${digits(3)},{digits(3)}", f"{digits(3)}-{digits(4)}", "Version 3, 29 June 2007", f"{w}@", f"@{w}", "+", f"+{digits(1)}", f"({digits(1)})"]
        return rng.choice(plain) if rng.random() < 0.9 else rng.choice(other)

    parts, spans, size, after = [], [], 0, False
    for _ in range(rng.randint(4, 100)):
        after = rng.random() < (0.35 if after else 0.03)  # items also follow each other
        if after:
            text, kind = item()
            if rng.random() < 0.3:
                cue = {"email": ("email", "write", "contact", "mail"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "paid", "account"), "phone": ("phone", "tel", "call", "mobile", "fax")}[kind]
                parts.append(rng.choice(cue) + rng.choice(["", ":"]))
                size += len(parts[-1]) + 1
            spans.append((size, size + len(text), kind))
        else:
            text = filler()
        parts.append(text)
        size += len(text) + 1
    return " ".join(parts), spans


def labelled_table(rows: int = 700, seed: int = 17) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The default small labelled table: texts and their spans (start, end, kind)."""
    rng = random.Random(seed)
    return [_sample_row(rng) for _ in range(rows)]


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 5) -> CRF:
    crf, rows = CRF(), []
    number = {label: i for i, label in enumerate(CRF.LABELS)}
    for text, spans in table:
        starts, ends, classes, codes = tokens(text)
        y = np.zeros(len(starts), np.int64)
        for a, b, kind in spans:
            inside = np.flatnonzero((starts < b) & (ends > a))
            y[inside] = number[f"I-{kind}"]
            y[inside[:1]] = number[f"B-{kind}"]
        if len(y):
            rows.append((features(starts, ends, classes, codes), y))
    return crf.fit(rows, epochs=epochs)


_TRIM = ".,;:!?*%&$#\"'|<>[]{}"
_DIGITS_OF = {"ip": (4, 12), "card": (12, 19), "phone": (9, 15)}


#: A name, an @ or `at`, a site, a dot or `dot`, and letters.
_SPELLED = re.compile(r"\w[^\w@]*(?:@|\bat\b)[^\w@]*\w.*?(?:\.|\bdot\b)\W*[a-z]", re.I | re.S)


def _plausible(kind: str, text: str) -> bool:
    """An added span must hold what its kind needs: digits in number, a card's check digit, an address's parts."""
    digits = _DIGIT.sub("", text)
    if kind == "email":
        return bool(_SPELLED.search(text))
    low, high = _DIGITS_OF[kind]
    if not low <= len(digits) <= high:
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    return luhn(digits) if kind == "card" else not re.search("[A-Za-z]", text)


def added_spans(crf: CRF, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the CRF finds outside the base spans. The texts are laid end to end, parted by line feeds."""
    starts, ends, classes, codes = tokens("\n".join(texts))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(offsets, starts, "right") - 1
    first = np.diff(owner, prepend=-1) > 0
    y = crf.label(features(starts, ends, classes, codes), first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(y)
    for i in hits[(y[hits] - 1) % 2 == 0]:
        n, j = int(owner[i]), i + 1
        while j < len(y) and y[j] == y[i] + 1 and owner[j] == n:
            j += 1
        text, k = texts[n], int(y[i] - 1) // 2
        a, b = int(starts[i] - offsets[n]), int(ends[j - 1] - offsets[n])
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a < b and not any(s < b and a < e for s, _, e in base[n]) and _plausible(KINDS[k], text[a:b]):
            out[n].append((a, k, b))
    return out


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about a million characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= 1_000_000):
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, crf: CRF | None = None, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a struct column `out`: counts and a digest of the pattern matches, and all spans (with the CRF's), kind:start:end by start, then kind, and their number.

    Offsets are code points, ends exclusive. Whole texts are read; null counts as empty and has no spans. Repeated rows get equal
    results, an empty table an empty one; a column of docs named like `out` is replaced.
    """
    crf = crf if crf is not None else train(labelled_table())

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = [], [t or "" for t in batch]
            for part in portions(texts):
                base = [base_spans(t) for t in part]
                for own, more in zip(base, added_spans(crf, part, base), strict=True):
                    counts = [sum(k == n for _, k, _ in own) for n in range(4)]
                    rows.append((*counts, hashlib.sha256(joined(own).encode()).hexdigest(), joined(sorted(own + more)), len(own) + len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(*(c for c in docs.columns if c != out), find(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(out))
