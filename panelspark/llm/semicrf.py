"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans.  The field looks at the words near a trigger: a
digit, ``@``, a solid word of ``SOLID`` letters or more, or a value given to a name
such as ``password`` (``NAMED``).  A span of up to ``LONGEST`` words is scored as a whole (its shape, digit
count, check sum, octets, what stands around it), and dynamic programming over
(end, length, type) chooses boundaries and types of a window together.  A span it
finds stays only if it meets no base span.  It is trained here, by gradient
ascent on the likelihood, on sentences made from templates; a span without a
trigger is never personal data to it, so names of people and postal addresses
without a number aren't found, and text far from any trigger is passed over.

One pass over the documents without a shuffle; the weights are a few thousand
numbers.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, texts_of

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
LONGEST = 13
#: Words of context around each trigger.
AROUND = 16
#: Letters from which a word without a digit may be a secret.
SOLID = 16
#: What stands before the value of a secret; in the bytes: an end of the name, at most a quote and a space, then ``:`` or ``=``.
NAMES = ("key", "token", "secret", "password", "passwd", "pwd")
GIVEN = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?[ ]?[:=][ ]?[\"']?(?=[a-z])")
NAMED = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?[ ]?[:=][ ]?[\"']?$")
#: One match in each other trigger: its first digit or ``@``, or a solid word.
MARK = re.compile(rf"[0-9@][0-9]*|(?<![A-Za-z0-9\u0080-\uffff])[A-Za-z]{{{SOLID},}}(?![A-Za-z0-9\u0080-\uffff])")

AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and start."""
    out, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# The field

WORD = re.compile(r"[A-Za-z0-9\u0080-￿]+|[^\sA-Za-z0-9\u0080-￿]")


class Window(NamedTuple):
    text: str
    words: list[tuple[int, int]]
    trigger: list[bool]


def triggers(text: str, words: list[tuple[int, int]]) -> list[bool]:
    """Whether each word is a trigger."""
    at = [m.start() for m in MARK.finditer(text)]
    if ":" in text or "=" in text:
        at += [m.end() for m in GIVEN.finditer(text)]
    starts, out = [a for a, _ in words], [False] * len(words)
    for x in at:
        out[bisect.bisect_right(starts, x) - 1] = True
    return out


def window_of(text: str) -> Window:
    words = [m.span() for m in WORD.finditer(text)]
    return Window(text, words, triggers(text, words))


def hot_bytes(data: np.ndarray) -> np.ndarray:
    """Marks at least one byte of every text that holds a trigger."""
    hot = ((data >= 48) & (data <= 57)) | (data == 64)
    low = data | 32
    run = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int32)])
    hot[: max(0, len(data) - SOLID + 1)] |= run[SOLID:] - run[:-SOLID] == SOLID if len(data) >= SOLID else False
    at = np.flatnonzero((data == 58) | (data == 61))
    last = at - 1
    for _ in range(2):  # a quote and a space
        last = last - np.isin(data[last], (32, 34, 39))
    at, last = at[last >= 2], last[last >= 2]
    ends = np.isin(low[last], [ord(x[-1]) for x in NAMES])
    for i, j in zip(at[ends].tolist(), last[ends].tolist()):
        hot[i] |= data[max(0, j - 7) : j + 1].tobytes().lower().endswith(tuple(x.encode() for x in NAMES))
    return hot


def candidates(w: Window) -> list[tuple[int, int]]:
    """Word ranges that may be an entity: with a trigger, no wide gap inside, and not cut out of a run of punctuation."""
    out = []
    for i, (a, _) in enumerate(w.words):
        first = w.text[a]
        if not (first.isalnum() or first in "+(_"):
            continue
        seen = False
        for j in range(i, min(i + LONGEST, len(w.words))):
            if j > i and w.words[j][0] - w.words[j - 1][1] > 1:
                break
            if j > i and "\n" in w.text[w.words[j - 1][1] : w.words[j][0]]:
                break
            seen |= w.trigger[j]
            if seen and w.text[w.words[j][1] - 1].isalnum():
                out.append((i, j + 1))
    return out


def shape(s: str) -> str:
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z\u0080-￿]+", "a", s))
    return re.sub(r"[0-9]+", lambda m: "9" * len(m[0]) if len(m[0]) < 5 else "9+", s)


def features(w: Window, i: int, j: int) -> list[str]:
    """What a span looks like as a whole, and its surroundings."""
    a, b = w.words[i][0], w.words[j - 1][1]
    s = w.text[a:b]
    digits = re.sub("[^0-9]", "", s)
    n, solid = len(digits), not re.search(r"\s", s)
    left, right = w.text[a - 1 : a] if a else "", w.text[b : b + 1]
    before = re.findall(r"[A-Za-z]+", w.text[max(0, a - 16) : a])
    f = ["one", f"digits {min(n, 21)}", f"words {j - i}", f"at {s.count('@')}", f"dots {min(s.count('.'), 4)}", f"short shape {re.sub('9+[+]?', '9', shape(s))[:24]}"]
    f += [f"shape {shape(s)[:24]}"] if len(s) < 40 else []
    f += [f"left {left if not left.isalnum() else 'x'}", f"right {right if not right.isalnum() else 'x'}"]
    f += [f"before {before[-1].lower()}"] if before else []
    if re.fullmatch(r"[0-9 -]+", s):
        f += ["number", f"number {'13-19' if 13 <= n <= 19 else 'other'} {luhn(digits) if n else ''}"]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        f += [f"octets {all(int(x) <= 255 for x in s.split('.') if len(x) < 9)}"]
    if re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", s):
        f += ["dialled", f"dialled {s[0] if s[0] in '+(' else '9'} {'9-15' if 9 <= n <= 15 else 'other'}"]
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}", s):
        f += ["mailbox"]
    if solid and re.fullmatch(r"[A-Za-z0-9_+/=-]+", s):
        mixed = bool(re.search("[0-9]", s)) + bool(re.search("[A-Za-z]", s))
        size = "16-31" if 16 <= len(s) < 32 else "32+" if len(s) >= 32 else "8-15" if len(s) >= 8 else "short"
        f += [f"solid {size} {mixed}", f"solid {size} {mixed} {'hex' if re.fullmatch('[0-9a-f]+', s) else 'upper' if s.upper() == s else 'other'}"]
        if mixed == 1 and not n:
            case = "upper" if s.isupper() else "lower" if s.islower() else f"mixed {min(len(s) // (1 + len(re.findall('[a-z][A-Z]', s))), 6)}"
            f += [f"letters {size} {case}", f"letters {size} {case} given" if NAMED.search(w.text, max(0, a - 16), a) else f"letters {size} {case} free"]
        if len(s) >= SOLID:
            f += [f"starts {re.match('[A-Za-z]*_?', s)[0][:4]}"]
    return f


class Field:
    """Weights of (feature, type); type 0 is a single word outside."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.outside = {True: 0.0, False: 0.0}  # by whether the word is a trigger

    def encode(self, w: Window, grow: bool) -> list[tuple[int, int, list[int]]]:
        out = []
        for i, j in candidates(w):
            names = features(w, i, j)
            if grow:
                for x in names:
                    self.index.setdefault(x, len(self.index))
            out.append((i, j, [self.index[x] for x in names if x in self.index]))
        return out

    def scored(self, spans) -> list[tuple[int, int, np.ndarray]]:
        return [(i, j, self.weights[f].sum(0) if f else np.full(len(KINDS), -20.0)) for i, j, f in spans]

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best division of a text into outside words and spans with types."""
        w = window_of(text)
        n = len(w.words)
        ends: dict[int, list] = {}
        for i, j, s in self.scored(self.encode(w, False)):
            k = int(np.argmax(s))
            ends.setdefault(j, []).append((i, float(s[k]), k))
        best, back = [0.0] + [0.0] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1] + self.outside[w.trigger[j - 1]]
            for i, s, k in ends.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((KINDS[k], w.words[i][0], w.words[j - 1][1]))
                j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Maximise the conditional likelihood of the marked spans by stochastic gradient ascent."""
        data = []
        for text, gold in examples:
            w = window_of(text)
            spans = self.encode(w, True)
            marks = {(a, b): KINDS.index(k) for k, a, b in gold}
            data.append((w, spans, {(i, j): marks[w.words[i][0], w.words[j - 1][1]] for i, j, _ in spans if (w.words[i][0], w.words[j - 1][1]) in marks}))
        self.weights = np.zeros((len(self.index), len(KINDS)))
        seen = np.full(self.weights.shape, 1e-6)
        dice = random.Random(5)
        for _ in range(rounds):
            dice.shuffle(data)
            for w, spans, gold in data:
                n, scored = len(w.words), self.scored(spans)
                by_end: dict[int, list] = {}
                for k, (i, j, s) in enumerate(scored):
                    by_end.setdefault(j, []).append((i, k, s))
                forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                forward[0] = backward[n] = 0.0
                out = [self.outside[t] for t in w.trigger]
                for j in range(1, n + 1):
                    terms = [forward[j - 1] + out[j - 1]] + [forward[i] + x for i, _, s in by_end.get(j, ()) for x in s]
                    forward[j] = np.logaddexp.reduce(terms)
                for j in range(n, 0, -1):
                    backward[j - 1] = np.logaddexp(backward[j - 1], backward[j] + out[j - 1])
                    for i, _, s in by_end.get(j, ()):
                        backward[i] = np.logaddexp(backward[i], backward[j] + np.logaddexp.reduce(s))
                for (i, j, f), (_, _, s) in zip(spans, scored):
                    g = -np.exp(np.minimum(forward[i] + s + backward[j] - forward[n], 0.0))
                    if (i, j) in gold:
                        g[gold[i, j]] += 1.0
                    if np.abs(g).max() > 1e-4:
                        seen[f] += g * g
                        self.weights[f] += rate * (g - decay * self.weights[f]) / np.sqrt(seen[f])
        return self


def examples(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Marked sentences from templates: personal data in many spellings among numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdeghilmnorstuvw") for _ in range(r.randint(2, 9)))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    long = lambda: "".join(word() for _ in range(9))[: r.randint(16, 26)]

    def card() -> str:
        d = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])

    def secret() -> str:
        hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        few = r.choice(["", "234567"])  # some have no digit
        return r.choice([hexa(40), hexa(32), hexa(64), "AKIA" + "".join(r.choice(upper + few) for _ in range(16)), "sk_" + "".join(r.choice("ABCDEFGHabcdefgh" + few) for _ in range(24)), letters(r.randint(20, 40))])

    make = {
        "email": lambda: f"{word()}{r.choice(['.', '_', '', '.', '-'])}{r.choice([digits(2), word()])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice(["+1 ({}) {}-{}", "+1-{}-{}-{}", "({}) {}-{}", "{}-{}-{}", "+1 {} {} {}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4)),
        "secret": secret,
    }
    plain = [lambda: digits(r.randint(1, 6)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 99)},{digits(3)}", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{word()}{digits(2)}", lambda: f"{r.randint(1, 500)}.{digits(3)}", lambda: digits(r.randint(7, 12)), lambda: f"{digits(2)} {digits(3)} {word()}", lambda: f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}", lambda: f"@{word()}", lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))), long, lambda: long().capitalize(), lambda: long().upper(), lambda: f"the {r.choice(NAMES)}{r.choice([':', ' ='])} {word()}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + " " if r.random() < 0.9 else ""
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                s = make[kind]()
                if kind == "secret" and r.random() < 0.7:
                    text += r.choice(["key = ", "token: ", "secret=", "password = "])
                    s = r.choice([s, s, s, letters(r.randint(12, 24)), long()])
                quote = r.choice(["", "", '"']) if kind == "secret" else ""
                text += quote
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + quote
            else:
                text += r.choice(plain)()
            text += r.choice([" ", " ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


def add_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The field's spans that meet no base span.  It is run on windows around the triggers."""
    words = [m.span() for m in WORD.finditer(text)]
    hot = [k for k, x in enumerate(triggers(text, words)) if x]
    starts = sorted((s, e) for _, s, e in base)
    # The furthest end so far: of all base spans that start before a place, whether one reaches it.
    reach = list(itertools.accumulate((e for _, e in starts), max))
    out, k = [], 0
    while k < len(hot):
        first = last = hot[k]
        while k < len(hot) and hot[k] - last <= 2 * AROUND:
            last = hot[k]
            k += 1
        a, b = words[max(0, first - AROUND)][0], words[min(len(words) - 1, last + AROUND)][1]
        for kind, x, y in field.decode(text[a:b]):
            before = bisect.bisect_left(starts, (y + a, 0))
            if not before or reach[before - 1] <= x + a:
                out.append((kind, x + a, y + a))
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: counts of base spans, of added and of all spans, the digest of the base spans, and all spans.

    Offsets are code points, end exclusive.  Null text counts as empty; repeated
    rows are repeated; a null id stays null; other columns are ignored.
    """
    field = field or Field().fit(examples())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in FOUND.split(", ")]
    none = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = texts_of(b.column("text"))
            run = np.concatenate([[0], np.cumsum(hot_bytes(t.data))])
            hot = np.flatnonzero(run[t.offsets[1:]] > run[t.offsets[:-1]])
            n = len(t)
            counts = np.zeros((6, n), np.int64)
            sums, all_ = [none] * n, [""] * n
            for i in hot.tolist():
                text = t.raw(i).decode()
                base = base_spans(text)
                added = add_spans(text, base, field)
                for k, _, _ in base:
                    counts[KINDS.index(k), i] += 1
                counts[4:, i] = len(added), len(base) + len(added)
                sums[i] = hashlib.sha256(digest(base).encode()).hexdigest()
                all_[i] = digest(base + added)
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c) for c in counts], pa.array(sums), pa.array(all_)], names)

    return rows.mapInArrow(find, FOUND)
