"""Secret scans: fixed detectors plus a linear-chain conditional random field.

The field tags tokens as secret begin, inside or outside (B, I, O). Features are the token's shape, the
words before it and features of the whole text; decoding is by Viterbi. It is trained here, on
sentences that a seeded generator writes (prose, code, settings files, with and without secrets), by
gradient ascent on the exact likelihood (forward-backward in log space).

A text's tokens are maximal runs of letters, digits and +/_.=- and single other characters that are not white
space. Most tokens are plain: letters only, digits only, marks, or short. `Model.certify` computes, from the
trained weights, the least margin by which O wins at any plain token against the most that transitions could
gain by another tag. While that margin is positive, O is on the best path of the whole text at every plain
token, so a text decodes exactly as its stretches around the other tokens (and around words that follow a cue
within NEAR tokens and a mark of assignment); only those are decoded. If the margin is not positive, every token is decoded.

Cases: a null or empty text has no spans; a very long text is scanned whole, by one worker; of equally good tag sequences the one
with the smaller tag (B, I, O) at the last place where they differ is taken; rows that repeat each get their row; ids may be null or
of any type; an empty table stays empty; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The base detectors. A match counts if the given group has at least so many characters.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "crf")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile("AKIA[A-Z0-9]{16,}")
_hex = re.compile("[0-9a-f]{24,}")
_cue = re.compile("pass|secret|token|key", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed detectors, in order."""
    out = []
    if _cue.search(text):
        out = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


_token = re.compile(r"[\w+/.=-]+|[^\s\w+/.=-]")
#: Tokens that are not plain: 8 or more characters with letters and digits.
_from_digit = re.compile(r"[0-9][\w+/.=-]*")
_head = re.compile(r"[\w+/.=-]*\Z")
_tail = re.compile(r"[\w+/.=-]*")
#: A token that ends in a mark of assignment, quotes, and a token of 6 or more characters.
_assigned = re.compile(r"[:=](?:(?<=:)|(?![\w+/.=-]))(?=(?:\s*[\"'])*\s*([\w+/.=-]{6,}))")
CUES = frozenset("password passwd pwd secret token apikey api_key key auth authorization bearer credential credentials private access".split())
NEAR = 4  # tokens before a token that count as its neighbours

FEATURES = (
    "bias", "letters", "letters>=24", "digits", "digits>=12", "mark", "short mixed", "mixed 8-15", "mixed 16-23", "mixed 24-39", "mixed>=40",
    "hex only", "upper and digits only", "both cases and digits", "many letter-digit turns", "inner mark", "slash or dot",
    "cue before", "assigns before", "quote before", "odd before", "letters after cue and assignment", "cue inside",
    "text has code marks", "dense odd tokens",
)
_index = {name: i for i, name in enumerate(FEATURES)}


def _is_cue(token: str) -> bool:
    return token.lower().strip("_.=-") in CUES


def _is_odd(token: str) -> bool:
    return len(token) >= 8 and any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def _odd_tokens(text: str) -> list[tuple[int, int]]:
    """Where the odd tokens are: each holds a digit, so the search starts from digits."""
    out = []
    for m in _from_digit.finditer(text):
        start = _border(text, m.start())
        if m.end() - start >= 8 and _is_odd(text[start : m.end()]):
            out.append((start, m.end()))
    return out


@lru_cache(100_000)
def shape(token: str) -> tuple[int, ...]:
    """Feature numbers that depend on the token alone."""
    n = len(token)
    core = token.strip("+/_.=-")
    digits, letters = any("0" <= c <= "9" for c in core), any(c.isalpha() for c in core)
    names = ["bias"]
    if letters and not digits:
        names += ["letters"] + ["letters>=24"] * (n >= 24)
    elif digits and not letters:
        names += ["digits"] + ["digits>=12"] * (n >= 12)
    elif not core or not letters:
        names.append("mark")
    elif n < 8:
        names.append("short mixed")
    else:
        names.append("mixed 8-15" if n < 16 else "mixed 16-23" if n < 24 else "mixed 24-39" if n < 40 else "mixed>=40")
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", core):
            names.append("hex only")
        if re.fullmatch("[0-9A-Z]+", core):
            names.append("upper and digits only")
        if re.search("[a-z]", core) and re.search("[A-Z]", core):
            names.append("both cases and digits")
        if len(re.findall("[a-zA-Z](?=[0-9])|[0-9](?=[a-zA-Z])", core)) >= 4:
            names.append("many letter-digit turns")
        if re.search("[+_=-]", core):
            names.append("inner mark")
        if re.search("[/.]", core):
            names.append("slash or dot")
        if any(c in token.lower() for c in ("password", "passwd", "secret", "token", "apikey", "api_key")):
            names.append("cue inside")
    return tuple(_index[x] for x in names)


def features(tokens: list[str], whole: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Feature numbers per token; neighbours count for odd tokens, and for others only after a cue and a mark of assignment."""
    out = []
    for i, token in enumerate(tokens):
        before = tokens[max(0, i - NEAR) : i]
        own = [*shape(token), *whole]
        cue = any(map(_is_cue, before))
        last = [t for t in before if t not in "\"'"][-1:]
        assigns = bool(last) and last[0][-1] in ":="
        if _is_odd(token):
            if cue:
                own.append(_index["cue before"])
            if assigns:
                own.append(_index["assigns before"])
            if before and before[-1] in "\"'":
                own.append(_index["quote before"])
        elif cue and assigns and len(token) >= 6:
            own.append(_index["letters after cue and assignment"])
        if before and _is_odd(before[-1]):
            own.append(_index["odd before"])
        out.append(tuple(own))
    return out


def whole_features(text: str, odd: int) -> tuple[int, ...]:
    marks = sum(text.count(c) for c in "{};=") * 100 > len(text)
    return tuple(_index[x] for x, on in (("text has code marks", marks), ("dense odd tokens", odd * 200 > len(text))) if on)


class Model:
    """Emission weights by feature and tag (B, I, O) and transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.margin = self.certify()

    def certify(self) -> float:
        """The least lead of O at a plain token over the most that its transitions could gain by another tag."""
        lead = self.emit[:, 2:3] - self.emit[:, :2]
        plain = (("letters",), ("letters", "letters>=24"), ("digits",), ("digits", "digits>=12"), ("mark",), ("short mixed",))
        shapes = [lead[[_index[x] for x in ("bias", *p)]].sum(axis=0) for p in plain]
        whole = np.minimum(lead[[_index[x] for x in ("text has code marks", "dense odd tokens")]], 0).sum(axis=0)
        m = self.move
        gain = [max(m[a, t] + m[t, c] - m[a, 2] - m[2, c] for a in range(3) for c in range(3)) for t in (0, 1)]
        return float(min((x + whole - gain).min() for x in shapes))

    def decode(self, rows: list[tuple[int, ...]]) -> list[int]:
        """The best tag sequence, with O before and after."""
        score = np.array([self.emit[list(r)].sum(axis=0) for r in rows])
        best = self.move[2] + score[0]
        back = []
        for s in score[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        tag = int((best + self.move[:, 2]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]


def _generated(rng: np.random.Generator, n: int) -> list[tuple[list[str], list[int], tuple[int, ...]]]:
    """Sentences with tags. Secrets follow cues in settings, code and prose, or stand alone in a secret's shape."""
    letters, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def draw(alphabet: str, k: int) -> str:
        out = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
        return out if alphabet is letters or any(c.isdigit() for c in out) else draw(alphabet, k)

    word = lambda: draw(letters, int(rng.integers(1, 13)) * (1 + 2 * (rng.random() < 0.1)))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def secret() -> list[str]:
        kind = int(rng.integers(6))
        if kind == 0:
            return [draw("0123456789abcdef", pick(18, 24, 32, 40, 64))]
        if kind == 1:
            return ["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)]
        if kind == 2:
            return [draw(mixed, int(rng.integers(20, 44))) + pick("", "=", "==")]
        if kind == 3:
            return [pick("sk", "ghp", "xoxb", "pk") + pick("_", "-") + draw(mixed, int(rng.integers(20, 37)))]
        if kind == 4:
            return [draw(mixed, int(rng.integers(12, 24)))]
        return [draw(mixed, 24) for _ in range(int(rng.integers(2, 4)))]

    def harmless() -> list[str]:
        kind = int(rng.integers(9))
        number = str(int(rng.integers(10**9)))
        if kind == 0:
            return [f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"]
        if kind == 1:
            return [f"{rng.integers(9)}.{rng.integers(30)}.{rng.integers(30)}"]
        if kind == 2:
            return ["https", ":", f"//{word()}.example.com/{word()}/{number}"]
        if kind == 3:
            return [number]
        if kind == 4:
            return [f"{word()}_{word()}_{rng.integers(100)}.txt"]
        if kind == 5:
            return [f"{word()}{rng.integers(100)}"]
        if kind == 6:
            return [f"+{rng.integers(1, 99)}-{rng.integers(100, 999)}-{rng.integers(100000, 999999)}"]
        if kind == 7:
            return [draw(letters, int(rng.integers(14, 40)))]
        return [word() + "." + str(int(rng.integers(99))), "@", f"mail{rng.integers(9)}.example.com"]

    out = []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[int] = []
        add = lambda ts, first=2, rest=2: (tokens.extend(ts), tags.extend([first] + [rest] * (len(ts) - 1)))
        for _ in range(int(rng.integers(1, 5))):
            add([word() for _ in range(int(rng.integers(1, 9)))])
            what = rng.random()
            if what < 0.45:
                if rng.random() < 0.75:
                    cue = pick("password", "secret", "token", "api_key", "key", "Authorization", "private", "access", "auth")
                    mark = pick([":"], ["="], [":", '"'], ["=", "'"], ["is"], [])
                    add([cue, *mark])
                    add([draw(letters, int(rng.integers(8, 17)))] if mark and mark[0] in ":=" and rng.random() < 0.2 else secret(), 0, 1)
                else:
                    add(secret(), 0, 1)
            elif what < 0.9:
                if rng.random() < 0.15:
                    add([pick("id", "page", "date", "file"), *pick([":"], ["="], [])])
                add(harmless())
            add([pick(".", ",", ";", ")", "end")])
        out.append((tokens, tags, tuple(_index[x] for x in ("text has code marks", "dense odd tokens") if rng.random() < 0.3)))
    return out


def train(seed: int = 7, sentences: int = 600, steps: int = 150, rate: float = 0.35, l2: float = 1e-3) -> Model:
    """Maximise the exact conditional likelihood by Adam over padded batches."""
    data = _generated(np.random.default_rng(seed), sentences)
    longest = max(len(t) for t, _, _ in data)
    x = np.zeros((len(data), longest, len(FEATURES)))
    y = np.full((len(data), longest), 2)
    real = np.zeros((len(data), longest), bool)
    for i, (tokens, tags, whole) in enumerate(data):
        for j, own in enumerate(features(tokens, whole)):
            x[i, j, list(own)] = 1
        y[i, : len(tags)], real[i, : len(tags)] = tags, True
    emit, move = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    gold_e = np.einsum("ntf,nty->fy", x, np.eye(3)[y] * real[..., None])
    eye = np.eye(3)
    gold_m = sum((eye[y[:, t - 1]] * real[:, t, None]).T @ eye[y[:, t]] for t in range(1, longest))
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for step in range(1, steps + 1):
        s = np.where(real[..., None], x @ emit, 0.0)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, longest):
            on = lse(alpha[:, t - 1, :, None] + move, 1) + s[:, t]
            alpha[:, t] = np.where(real[:, t, None], on, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = lse(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], on, 0.0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        pairs = np.zeros((3, 3))
        for t in range(1, longest):
            q = alpha[:, t - 1, :, None] + move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            pairs += (np.exp(q) * real[:, t, None, None]).sum(axis=0)
        grads = ((gold_e - np.einsum("ntf,nty->fy", x, p)) / len(data) - l2 * emit, (gold_m - pairs) / len(data) - l2 * move)
        for w, g, (m, v) in zip((emit, move), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(emit, move)


@cache
def model() -> Model:
    return train()


def crf_spans(text: str, crf: Model) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the field's secrets."""
    odd = _odd_tokens(text)
    cues = _after_cues(text)
    if not odd and not cues and crf.margin > 0:
        return []
    whole = whole_features(text, len(odd))
    if crf.margin > 0:
        stretches: list[list[int]] = []
        token_end = -1
        for a, b in sorted(odd + cues):
            if a < token_end:  # in the token of the one before: the same stretch
                continue
            token_end = _tail.match(text, a).end()
            low, high = _around(text, a, max(b, token_end))
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = max(high, stretches[-1][1])
            else:
                stretches.append([low, high])
    else:
        stretches = [[0, len(text)]]
    out = []
    for low, high in stretches:
        found = [m.span() for m in _token.finditer(text, low, high)]
        tags = crf.decode(features([text[a:b] for a, b in found], whole)) if found else []
        start = None
        for (a, b), tag in zip([*found, (0, 0)], [*tags, 2]):
            if start is not None and tag != 1:
                out.append((start, 3, end))
                start = None
            if tag == 0 or tag == 1 and start is None:
                start = a
            end = b
    return out


def _after_cues(text: str) -> list[tuple[int, int]]:
    """Where the tokens are that have the feature of letters after a cue and a mark of assignment, by the rule of features()."""
    out = []
    for m in _assigned.finditer(text):
        near = _before(text, m.start(1), NEAR)
        if near[0][0] <= m.start() and any(_is_cue(text[a:b]) for a, b in near):
            out.append(m.span(1))
    return out


def _before(text: str, a: int, n: int) -> list[tuple[int, int]]:
    """The last n tokens before the token at a, or as many as there are."""
    reach = 100
    while True:
        begin = _border(text, max(0, a - reach))  # may lie inside a token before
        found = [m.span() for m in _token.finditer(text, begin, a)]
        if len(found) >= n or begin == 0:
            return found[-n:]
        reach *= 4


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch from NEAR + 1 tokens before the token at a to NEAR tokens after b, on token borders."""
    cut = _before(text, _border(text, a), NEAR + 1)
    high = b
    for k, m in enumerate(_token.finditer(text, b)):
        high = m.end()
        if k == NEAR - 1:
            break
    return cut[0][0] if len(cut) > NEAR else 0, high


def _border(text: str, i: int) -> int:
    """The start of the token that i lies in or ends at."""
    while (found := _head.search(text, max(0, i - 64), i)) and found.start() < i:
        i = found.start()
    return i


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Model | None = None) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end)."""
    own = crf or model()
    weights = own.emit, own.move
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Model(*weights)
        for batch in batches:
            for part in common.parts(batch, text_col):
                counts: list[list[int]] = [[], [], []]
                digests, spans = [], []
                for text in part.column(text_col):
                    t = text.as_py() or ""
                    base = base_spans(t)
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(base + crf_spans(t, field)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))
