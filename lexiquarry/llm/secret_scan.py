"""Secret scan: base patterns, and a linear-chain CRF that adds spans.

Base spans are matches of three patterns (see ``BASE``). The CRF tags every token of every
text as secret begin, inside or outside, from its shape, the words around it and features
of the file. A text's tokens are one chain, decoded by Viterbi as a whole. So a secret may
have several tokens (a key over many lines, a passphrase of words, groups split by signs)
and may stand anywhere, whatever stands around it.

Most features of a token depend on one token: itself, the one before or behind it, or one
of the ``BEFORE`` before it. Their weights are summed once for each distinct token and
looked up for all; what lies between a word about secrets and a token is read where there
is such a word. A chain is split only at tokens that are outside by a bound (``_open``). So
the pieces' best tags are the whole chain's.

Tagged spans that touch no base span are added as kind ``crf``, if they have ``LEAST`` or
more characters. The model is fitted on the driver, always alike, on invented lines (no
labelled secrets exist): keys, tokens, passphrases and passwords of usual shapes, against
prose about secrets, numbers, addresses, dates, versions, hashes in names and long words.

Defined results: null text is empty and has no spans; repeated rows are scanned alike;
offsets are code points; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import bounded_batches
from lexiquarry.llm.crf import Crf, fit, viterbi

#: Kinds in order of precedence; a pattern and what of its match must have a least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Words about secrets, lower-cased.
KEYWORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "private", "auth")
#: Tokens before a token that it knows of.
BEFORE = 6
#: Characters of a secret that the CRF adds.
LEAST = 8
BUCKETS = 1 << 14
LABELS = ["O", "B", "I"]
SEED = 20_240_601

_TOKEN = re.compile(r"[A-Za-z0-9+/_.%~-]+(?:={1,2}(?![A-Za-z0-9+/_.@%~=-]))?|[^\sA-Za-z0-9]")
_HEX = re.compile(r"[0-9a-f]{16}")
_CLASSES = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "9" * 10)
_RUN = re.compile(r"(.)\1+", re.S)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind as listed."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def _may_match(text: str) -> bool:
    """Whether a base pattern can match: its fixed letters stand in the text, or a
    hexadecimal run of its length."""
    low = text.lower()
    return any(k in low for k in ("passw", "secret", "token", "api")) or "AKIA" in text or _HEX.search(text) is not None


def _in_url(tokens: list[str], i: int) -> bool:
    """Whether a token stands where an address has its password: behind a user and a colon,
    before an at sign."""
    return 2 <= i < len(tokens) - 1 and tokens[i + 1] == "@" and tokens[i - 1] == ":" and tokens[i - 2].startswith("//")


_ABOUT = re.compile("|".join(map(re.escape, KEYWORDS)))


def _keyword(token: str) -> bool:
    return _ABOUT.search(token.lower()) is not None


#: Words that may stand between a word about secrets and the secret, and names of keys.
_LINKS = frozenset("is was are the a to as set be now for of or and your my this that with has in".split())
_NAMES = frozenset("key keys access client user id date version path phone host number begin rsa pin code login pass".split())


@lru_cache(1 << 16)
def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % BUCKETS


def shape(token: str) -> str:
    """Character classes, runs shortened to one."""
    return _RUN.sub(r"\1", token.translate(_CLASSES))[:12]


@lru_cache(1 << 12)
def _spread(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return round(-2 * sum(c / n * math.log2(c / n) for c in counts))


def class_features(classes: str) -> list[str]:
    """Of a token by its character classes alone (letters as a or A, digits as 9)."""
    n, form = len(classes), shape(classes)
    out = ["bias", f"shape={form}", f"len={min(n // 4, 12)}", f"sign={classes if classes[0] not in 'aA9' else ''}"]
    if n >= 4:
        digits, upper, lower = map(classes.count, "9Aa")
        turns, swaps = (sum((a == c) != (b == c) for a, b in zip(classes, classes[1:], strict=False)) for c in "9A")
        out += [f"digits={10 * digits // n}", f"cases={int(upper > 0)}{int(lower > 0)}{int(digits > 0)}", f"turns={min(12, turns)}", f"swaps={min(12, swaps)}"]
        out += [f"{name}={min(most, classes.count(c))}" for name, c, most in (("dots", ".", 4), ("dashes", "-", 5), ("slashes", "/", 4))]
    return out


def letter_features(t: str) -> list[str]:
    """Of a token by its letters."""
    out = [f"key={int(_keyword(t))}"]
    if len(t) >= 4:
        out += [f"entropy={_spread(tuple(sorted(map(t.count, set(t)))))}", f"start={t[:3]}", f"hex={int(not t.strip('0123456789abcdefABCDEF-'))}"]
    return out


def part_features(t: str) -> list[str]:
    """Of each of the tokens before: names of keys and words about secrets in it."""
    low = t.lower()
    return [f"part={p}" for p in ([low] if low.isalpha() else re.split(r"[^a-z]+", low)) if len(p) > 2 and (p in _NAMES or _keyword(p))]


def after_feature(classes: str) -> str:
    """Of the token behind (or none), by its classes."""
    return f"after={classes if classes and classes[0] not in 'aA9' else shape(classes)}"


def _place(gap: str, classes: str, url: bool) -> list[str]:
    return [f"gap={gap}", f"gap={gap} shape={shape(classes)}", f"url={int(url)}"]


def place_features(tokens: list[str], i: int) -> list[str]:
    """Of what stands between the last word about secrets and here, letters by their case only."""
    before = tokens[max(0, i - BEFORE) : i]
    about = [j for j, w in enumerate(before) if _keyword(w)]
    gap = " ".join(w if not w[0].isalnum() else w.lower() if w.lower() in _LINKS else "w" for w in before[about[-1] + 1 :]) if about else "far"
    return _place(gap, tokens[i], _in_url(tokens, i))


def token_features(tokens: list[str], i: int, file: list[str]) -> list[str]:
    t, before = tokens[i], tokens[max(0, i - BEFORE) : i]
    last, after = before[-1] if before else "", tokens[i + 1] if i + 1 < len(tokens) else ""
    around = [f"last={shape(last)}", f"last={last.lower()}", after_feature(after.translate(_CLASSES)), f"same={int(t == last)}"]
    return class_features(t.translate(_CLASSES)) + letter_features(t) + around + [p for w in before for p in part_features(w)] + place_features(tokens, i) + file


def file_features(text: str, tokens: int) -> list[str]:
    marks = sum(map(text.count, "={}[]();:\"'<>"))
    return [f"marks={min(5, 40 * marks // max(1, len(text)))}", f"size={min(6, len(text).bit_length() // 3)}"]


class Scanner:
    """Tags texts. Keeps what it has computed of distinct tokens, up to ``TYPES`` of them
    between groups of texts."""

    TYPES = 1 << 18

    def __init__(self, model: Crf) -> None:
        self.model = model
        self.same = np.stack([self._sum([f"same={k}"]) for k in (0, 1)])
        self._forget()

    def _forget(self) -> None:
        #: Numbers of tokens as they come; the empty one stands between texts.
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        for t in ("", ":", "@"):
            self.number[t]
        #: Numbers and sums of weights of character classes.
        self.classes: dict[str, int] = {}
        self.by_class: list[np.ndarray] = []
        self.weights = np.zeros((0, 5, len(LABELS)), np.float32)
        self.marks = np.zeros((0, 3), bool)

    def _sum(self, features: list[str]) -> np.ndarray:
        return self.model.weights[list(map(_bucket, features))].sum(axis=0, dtype=np.float64)

    def _class(self, classes: str) -> int:
        """The number of a class, which gets its sums (as in ``_learn``) if it is new."""
        k = self.classes.get(classes)
        if k is None:
            k = self.classes[classes] = len(self.by_class)
            own = [self._sum(class_features(classes)), self._sum(_place("far", classes, False))] if classes else [np.zeros(len(LABELS))] * 2
            self.by_class.append(np.array([*own, self._sum([f"last={shape(classes)}"]), self._sum([after_feature(classes)]), np.zeros(len(LABELS))]))
        return k

    def _learn(self) -> None:
        """Sums of weights (own, far from words about secrets, as the token before, behind,
        and as one of those before) and marks (about secrets, start of an address, has
        parts) of new tokens."""
        new = list(islice(self.number, len(self.weights), None))
        if not new:
            return
        kind = [self._class(t.translate(_CLASSES)) for t in new]
        w = np.stack(self.by_class)[kind]
        letters = [list(map(_bucket, letter_features(t))) for t in new]
        count = np.fromiter(map(len, letters), np.int64, len(new))
        each = self.model.weights[np.fromiter(chain.from_iterable(letters), np.int64, int(count.sum()))]
        w[:, 0] += np.add.reduceat(each, np.cumsum(count) - count, axis=0)
        w[:, 2] += self.model.weights[[_bucket(f"last={t.lower()}") for t in new]]
        parts = list(map(part_features, new))
        for i, p in enumerate(parts):
            if p:
                w[i, 4] = self._sum(p)
        self.weights = np.concatenate([self.weights, w.astype(np.float32)])
        self.marks = np.concatenate([self.marks, np.array([(_keyword(t), t.startswith("//"), bool(p)) for t, p in zip(new, parts, strict=True)])])

    def _scores(self, texts: list[str], found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens, with an empty one before each text and behind the last, and
        the numbers of the tokens' texts."""
        if len(self.number) > self.TYPES:
            self._forget()
        tokens = [""]
        for f in found:
            tokens += f
            tokens.append("")
        t = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        self._learn()
        own = np.cumsum(t == 0) - 1
        starts = np.flatnonzero(t == 0) + 1
        w, (about, address, parts) = self.weights, self.marks.T
        place = w[t, 1].astype(np.float64)
        near = np.zeros(len(t), bool)
        said = np.flatnonzero(about[t])
        for k in range(1, BEFORE + 1):
            at = said[said + k < len(t)]
            near[at[own[at + k] == own[at]] + k] = True
        at = np.flatnonzero(address[t[:-3]] & (t[1:-2] == 1) & (t[3:] == 2)) + 2
        near[at] = True
        near &= t > 0
        for i in np.flatnonzero(near).tolist():
            lo = max(int(starts[own[i]]), i - BEFORE)
            place[i] = self._sum(place_features(tokens[lo : i + 2], i - lo))
        out = w[t, 0] + place
        out[1:] += self.same[(t[1:] == t[:-1]).astype(int)]
        out[0] += self.same[0]
        out[1:] += w[t[:-1], 2]
        out[:-1] += w[t[1:], 3]
        has = np.flatnonzero(parts[t])
        for k in range(1, BEFORE + 1):
            at = has[has + k < len(t)]
            at = at[own[at + k] == own[at]]
            out[at + k] += w[t[at], 4]
        files = np.array([self._sum(file_features(text, len(f))) for text, f in zip(texts, found, strict=True)] + [np.zeros(len(LABELS))])
        return out + files[own], own

    def _open(self, scores: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Tokens that may be in a secret. A run of tokens in secrets gains over "outside" no
        more than the sum of its tokens' best gains, each with the best step between two of
        them, and the best steps in and out. A token of which no run can gain is outside."""
        trans = self.model.trans - self.model.trans[0, 0]
        inner, enter, leave = trans[1:, 1:].max(), trans[0, 1:].max(), trans[1:, 0].max()
        gain = (scores[:, 1:] - scores[:, :1]).max(axis=1) + inner
        # A text's first token is not stepped into, and its last not out of.
        gain[1:] += np.where(gap[:-1], max(0.0, -enter), 0)
        gain[:-1] += np.where(gap[1:], max(0.0, -leave), 0)
        gain[gap] = 0
        gain[gap] = -1 - np.maximum(gain, 0).sum()
        total = np.concatenate([[0.0], np.cumsum(gain)])
        until = total[1:] - np.minimum.accumulate(total)[:-1]
        since = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        return (until + since - gain - inner + enter + leave > -1e-3) & ~gap

    def labels(self, scores: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The best label of every token; ``gap`` tells what stands between texts."""
        open_ = self._open(scores, gap)
        label = np.zeros(len(scores), np.int64)
        # A piece is a run of open tokens with the outside ones beside it.
        edge = np.diff(open_.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first, end = first - ~gap[first - 1], end + ~gap[end]
        size = end - first
        order = np.frexp(size)[1]
        for o in np.unique(order):
            f, n = first[order == o], size[order == o]
            at = np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum())
            label[at] = viterbi(scores[at], np.cumsum(n) - n, n, self.model.trans)
        return label

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the spans that Viterbi tags as secrets."""
        found = [_TOKEN.findall(text) for text in texts]
        scores, own = self._scores(texts, found)
        gap = np.diff(own, prepend=-1) > 0
        label = self.labels(scores, gap)
        first = np.flatnonzero(gap)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d in np.unique(own[label > 0]).tolist():
            tags = label[first[d] + 1 : first[d + 1]].tolist()
            spans, inside = out[d], False
            for m, tag in zip(_TOKEN.finditer(texts[d]), tags, strict=True):
                if tag == 1 or (tag == 2 and not inside):
                    spans.append((m.start(), m.end()))
                elif tag == 2:
                    spans[-1] = (spans[-1][0], m.end())
                inside = tag != 0
            out[d] = [(s, e) for s, e in spans if e - s >= LEAST]
        return out


def crf_spans(text: str, model: Crf) -> list[tuple[int, int]]:
    """Spans that Viterbi tags as secrets."""
    return Scanner(model).spans([text])[0]


class _Inventor:
    """Lines with secrets at known places."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def pick(self, chars: str, n: int) -> str:
        return "".join(self.rng.choices(chars, k=n))

    def word(self) -> str:
        r = self.rng
        w = "".join(r.choice(["b", "br", "c", "ch", "d", "f", "g", "h", "l", "m", "n", "p", "pl", "r", "s", "st", "t", "tr", "v", "w"]) + r.choice(["a", "e", "i", "o", "u", "ea", "ou"]) + r.choice(["", "", "n", "r", "s", "t", "l", "ng"]) for _ in range(r.choice([1, 1, 2, 2, 3, 5])))
        return w.capitalize() if r.random() < 0.1 else w

    def prose(self, lo: int, hi: int) -> str:
        r = self.rng
        out = [r.choice([self.word()] * 4 + ["the", "of", "is", "to", "a", "in", "for", "your"]) + r.choice([""] * 9 + [",", ".", ":", ";"]) for _ in range(r.randint(lo, hi))]
        if r.random() < 0.2:  # junk: signs after words, capitals
            signs = r.choice("!#$%&*") * r.randint(1, 3)
            out = [(self.plain() if r.random() < 0.1 else w) + (signs if r.random() < 0.8 else "") for w in out]
            out = [w.upper() for w in out] if r.random() < 0.4 else out
        return " ".join(out)

    def one(self) -> str:
        """A secret of one token."""
        r, pick = self.rng, self.pick
        alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
        return r.choice(
            [
                lambda: pick(alnum, r.randint(20, 44)),
                lambda: pick(b64, r.randint(24, 60)) + "=" * r.randint(0, 2),
                lambda: r.choice(["ghp_", "gho_"]) + pick(alnum, 36),
                lambda: "sk-" + pick(alnum, r.randint(32, 48)),
                lambda: "sk_live_" + pick(alnum, 24),
                lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
                lambda: "AIza" + pick(alnum + "_-", 35),
                lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 30),
                lambda: pick(alnum + "_-", r.randint(14, 24)) + pick(string.digits, 2),
                lambda: pick("0123456789abcdef", r.choice([32, 40, 64])).upper(),
                lambda: pick(string.ascii_letters, r.randint(16, 32)),
            ]
        )()

    def weak(self) -> str:
        """A password that only its place gives away."""
        r = self.rng
        return r.choice([lambda: self.word() + self.word() + str(r.randint(1, 9999)), lambda: self.word() + self.word() + self.word(), lambda: self.word().capitalize() + r.choice("_-.") + self.word() + str(r.randint(10, 99)), lambda: self.pick(string.ascii_letters + string.digits, r.randint(8, 12)), lambda: self.word() + str(r.randint(1, 99)) + self.word() + self.word(), lambda: self.swapped(self.word() + self.word() + self.word()) + str(r.randint(1, 99))])()

    def swapped(self, word: str) -> str:
        """Digits for some letters."""
        out = "".join(dict(zip("aeios", "43105", strict=True)).get(c, c) if self.rng.random() < 0.6 else c for c in word)
        return out if len(out) >= 8 else out + self.pick(string.digits, 8 - len(out))

    def address(self) -> tuple[str, str | None, str]:
        """An address: what stands before a password, the password (if it has one), and the rest."""
        r = self.rng
        host = r.choice([f"{self.word()}.{self.word()}.com", f"{self.word()}", "localhost", ".".join(str(r.randint(0, 255)) for _ in range(4)), f"{self.word()}-{self.word()}.net"]).lower()
        lead = r.choice(["", "", "DATABASE_URL=", "url: ", "git clone ", '"', "see "]) + r.choice(["https", "http", "postgres", "postgresql", "mysql", "redis", "sftp", "ftp", "mongodb", "amqp", "ssh"]) + "://"
        rest = r.choice(["", f":{r.randint(22, 65000)}"]) + r.choice(["", "/" + self.word(), f"/{self.word()}/{self.word()}.git", f"/{self.word()}?id={r.randint(1, 99999)}"])
        if r.random() < 0.6:
            return lead + r.choice([self.word(), "root", "admin", "", "user"]).lower() + ":", r.choice([self.weak, self.weak, self.one])().replace("/", "x"), "@" + host + rest
        return lead + r.choice(["", "", "git@", f"{self.word()}@"]) + host + rest, None, ""

    def many(self) -> str:
        """A secret of several tokens."""
        r, pick = self.rng, self.pick
        alnum = string.ascii_letters + string.digits
        return r.choice(
            [
                lambda: "\n".join([pick(alnum + "+/", 64) for _ in range(r.randint(1, 5))] + [pick(alnum + "+/", r.randint(12, 60)) + "=" * r.randint(0, 2)]),
                lambda: " ".join(self.word() for _ in range(r.randint(4, 8))),
                lambda: r.choice([" ", ":", " - "]).join(pick(string.ascii_uppercase + string.digits, 5) for _ in range(r.randint(4, 6))),
                lambda: r.choice("#$!*").join(pick(alnum, r.randint(4, 9)) for _ in range(r.randint(3, 5))),
            ]
        )()

    def plain(self) -> str:
        r, word = self.rng, self.word
        return r.choice(
            [
                lambda: self.pick(string.digits, r.randint(12, 19)),
                lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
                lambda: f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.{word()}.com",
                lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}",
                lambda: f"/{word()}/{word()}/{word()}{r.randint(1, 99)}/{word()}.html",
                lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 999)}",
                lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 999)}",
                lambda: f"v{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{word()}.{r.randint(1, 9)}",
                lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}",
                lambda: word() + word() + str(r.randint(1, 99)),
                lambda: f"www.{word()}{r.randint(1, 99)}.{word()}.org/{word()}",
                lambda: f"{word().upper()}{word().upper()}{r.randint(1, 99)}",
                lambda: word() + word().capitalize() + word().capitalize(),
                lambda: self.pick(string.digits + "ABCDEF", 8) + "-" + self.pick(string.digits + "abcdef", 4) + "-" + self.pick(string.digits, 4),
            ]
        )()

    def filler(self) -> str:
        """A text without secrets: prose, or words said again and again."""
        r = self.rng
        out = []
        for _ in range(r.randint(1, 4)):
            w = self.word() + r.choice(["", "", "", ".", ",", "!"])
            out += [(w.capitalize() if r.random() < 0.5 else w)] * r.randint(2, 30) if r.random() < 0.5 else [self.prose(5, 40)]
        return r.choice([" ", "\n"]).join(out)

    def line(self) -> tuple[str, list[tuple[int, int]]]:
        """A text and the spans of its secrets."""
        r = self.rng
        keys = ["key", "secret", "token", "password", "auth_token", "bearer", "credential", "private_key", "client_secret", "access_token", "aws_secret_access_key", "pwd", "authorization", "apikey", "API_KEY", "Password", "passphrase", "db_password", "passcode"]
        text, spans = self.prose(0, 8) + " ", []

        def put(lead: str, secret: str) -> None:
            nonlocal text
            text += lead
            spans.append((len(text), len(text) + len(secret)))
            text += secret

        for _ in range(r.randint(1, 3)):
            k = r.random()
            if k < 0.3:
                put(r.choice(["{} = ", "{}: ", '{}="', "{} => '", "export {}=", '"{}": "', "{} ", "{} is ", "{} -> ", "{} was ", "{} to ", ""]).format(r.choice(keys)), self.one())
                text += r.choice(['"', "'", "", ";", " ", "."])
            elif k < 0.42:
                put(r.choice(["{} = ", "{}: ", '{}="', "{}=", "{} is ", "{} is ", "the {} is ", "my {} is ", "{} = '"]).format(r.choice(["password", "password", "pwd", "Password", "passcode", "secret", "db_password", "passwd"])), self.weak())
                text += r.choice(['"', "", ";", " ", "\n", "!", ".", ","])
            elif k < 0.46:
                put(r.choice(["Authorization: Bearer ", "Bearer ", "bearer ", "authorization: bearer "]), r.choice([self.one(), ".".join(self.pick(string.ascii_letters + string.digits, r.randint(3, 12)) for _ in range(3))]))
                text += r.choice(["'", '"', "", " ", "\n"])
            elif k < 0.49:
                put(r.choice(["passcode {}", "passcode: {}", "passcode is {}", "the passcode {}", "pwd {}"]).format(""), self.pick(string.digits, r.randint(8, 10)))
            elif k < 0.54:
                lead, secret, rest = self.address()
                if secret:
                    put(lead, secret)
                    text += rest
                else:
                    text += lead
            elif k < 0.64:
                s = self.many()
                if "\n" in s or r.random() < 0.2:
                    kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
                    put(f"-----BEGIN {kind}-----\n", s)
                    text += f"\n-----END {kind}-----"
                else:
                    put(r.choice(['{}: "', "{} = '", '{}="', '"{}": "']).format(r.choice(["passphrase", "password", "secret", "credential", "seed_secret", "recovery_token"])), s)
                    text += r.choice(['"', "'"])
            elif k < 0.8:  # prose about secrets
                text += r.choice(["the {} is required to {}", "a {} of {}", "enter your {} and {}", "{} must be {}", "the {}: {}", "no {} for {}", "keep the {} in a {}", "{} policy, {}", "private {} and {}", "tokens and {} are {}", "authors of the {} {}"]).format(r.choice(["password", "secret", "token", "credential", "passphrase", "key", "authority"]), self.prose(1, 6))
            else:
                lead = r.choice(["{} = ", "{}: ", "{} ", '"{}": "', ""]).format(r.choice([self.word(), "id", "date", "version", "path", "phone", "user", "host", "number", "author"]))
                text += lead + self.plain() + r.choice(["", ",", ".", '"', ";"])
            text += r.choice([" ", " ", "\n"]) + self.prose(0, 6) + " "
        return text, spans


def _invented(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line and the spans of its secrets."""
    return _Inventor(rng).line()


def fit_secrets(lines: int = 2500, epochs: int = 4, seed: int = SEED) -> Crf:
    """The model; always the same for the same arguments."""
    inventor = _Inventor(random.Random(seed))
    batches, token, bucket, y, first, length = [], [], [], [], [], []
    for line in range(lines):
        text, spans = (inventor.filler(), []) if line % 8 == 7 else inventor.line()
        tokens = [(m.group(0), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        words, file = [t for t, *_ in tokens], file_features(text, len(tokens))
        first.append(len(y))
        length.append(len(words))
        for i in range(len(words)):
            for f in map(_bucket, token_features(words, i, file)):
                token.append(len(y))
                bucket.append(f)
            inside = [s for s, e in spans if s < tokens[i][2] and tokens[i][1] < e]
            y.append(0 if not inside else 1 if tokens[i][1] <= inside[0] else 2)
        if first and (line % 100 == 99 or line == lines - 1):
            batches.append(((np.array(token), np.array(bucket), np.ones(len(token))), np.array(y), np.array(first), np.array(length)))
            token, bucket, y, first, length = [], [], [], [], []
    return fit(LABELS, batches, BUCKETS, epochs)


#: Characters of the texts that are tagged together, unless one has more.
GROUP = 1 << 20


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _apart(found: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans, by start, that touch no base span."""
    ends = list(accumulate((e for _, e, _ in base), max))
    starts = [s for s, _, _ in base]
    return [(s, e) for s, e in found if not (k := bisect_left(starts, e)) or ends[k - 1] <= s]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan_secrets(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Spans of every document of ``docs`` (doc_id, text)."""
    model = model or fit_secrets()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = hashlib.sha256(b"").hexdigest()
        scanner = Scanner(model)
        rank = {k: i for i, (k, *_) in enumerate(BASE)}
        for b in batches:
            n = b.num_rows
            counts = {k: [0] * n for k, *_ in BASE}
            shas, spans, added = [blank] * n, [""] * n, [0] * n
            r = -1
            for texts in _groups(x.as_py() for x in b.column(1)):
                for text, tagged in zip(texts, scanner.spans(texts), strict=True):
                    r += 1
                    base = base_spans(text) if _may_match(text) else []
                    for _, _, k in base:
                        counts[k][r] += 1
                    if base:
                        shas[r] = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
                    new = [(s, e, "crf") for s, e in _apart(tagged, base)]
                    added[r] = len(new)
                    every = sorted(base + new, key=lambda x: (x[0], rank.get(x[2], 9)))
                    spans[r] = ",".join(f"{k}:{s}:{e}" for s, e, k in every)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
