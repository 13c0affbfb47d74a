"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The CRF tags white-space words as outside, begin or inside. A word's score is linear in features of its own shape
(length, character classes, entropy, known prefixes, a key word before its = or :), of the two words before
and the word after it, and of its file (whether it has key words, how much of it is symbols); tag pairs have
scores too. Weights are fitted by penalised likelihood (forward-backward, AdaGrad) on SAMPLES sequences that
``examples`` makes from a seed: prose, addresses, numbers, code, and secrets in many settings. Texts are decoded whole by Viterbi.

Base spans are never changed: a tagged run that overlaps one is left out. Offsets are code points. Null
text is empty. Ids may be null or repeat; each row is scanned alone; extra columns are not used.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices, table

SAMPLES, SEED, WINDOW = 6000, 7, 12
O, B, I = 0, 1, 2  # noqa: E741
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYWORD = re.compile(r"passw|secret|token|api_?key|credential|private|bearer|access_?key|auth", re.IGNORECASE)
PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|eyJ|-----BEGIN|AIza|glpat-)")
EDGE = "\"'`,;()[]{}<>|"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


# features

_BUCKETS = (4, 8, 12, 16, 20, 24, 32, 40, 64)
_LEN = tuple(f"len{i}" for i in range(10))
_SHAPES = [*_LEN, "digit", "lower", "upper", "mixed", "hexonly", "alnum", "b64", "symbol", "high", "middle", "flat", "wide", "numeric", "prefix", "assign", "keyword", "quoted", "equals", "colon", "turns", "address", "path", "pem", "plain"]
OWN = {n: i for i, n in enumerate(["bias", *_SHAPES])}
_NEAR = ["keyword", "equals", "colon", "prefix", "pem", "b64", "hexonly", "plain"]
NAMES = [*OWN, *(f"prev.{n}" for n in _NEAR), *(f"prev2.{n}" for n in _NEAR), *(f"next.{n}" for n in _NEAR), "prev.ends", "file.keyword", "file.symbols"]
AT = {n: i for i, n in enumerate(NAMES)}


def shape(word: str) -> set[str]:
    """Names of the features of one word."""
    core = word.strip(EDGE + ".!?")
    if core.isalpha() and not KEYWORD.search(core):
        f = {"plain", _LEN[bisect_right(_BUCKETS, len(core))]}
        if not core.islower() and not core[1:].islower():
            f.add("upper" if core.isupper() else "mixed")
        if word[-1] == ":":
            f.add("colon")
        return f
    f: set[str] = set()
    if core != word and word[0] in EDGE or word[-1] in "\"'`":
        f.add("quoted")
    if word in ("=", ":=", "=>"):
        return {"equals"}
    if word.endswith((":", "=")):
        f.add("colon")
    if m := re.match(r"[\"']?([A-Za-z_.-]*)[\"']?[:=]+[\"']?(.{6,})$", core):
        if KEYWORD.search(m[1]):
            f.add("assign")
            core = m[2].strip(EDGE)
    if KEYWORD.search(core) and "assign" not in f:
        f.add("keyword")
    if "@" in core or "://" in core:
        f.add("address")
    if core.count("/") > 1 and "." in core or core.startswith(("/", "./")):
        f.add("path")
    if "-----" in core:
        f.add("pem")
    if PREFIX.match(core):
        f.add("prefix")
    k = len(core)
    f.add(_LEN[bisect_right(_BUCKETS, k)])
    if core.isalpha():
        f.add("plain")
    if not k:
        f.add("symbol")
        return f
    d, up, lo = sum(c.isdigit() for c in core), sum("A" <= c <= "Z" for c in core), sum("a" <= c <= "z" for c in core)
    if d:
        f.add("digit")
    if d and not up and not lo:
        f.add("numeric")
    if up and lo:
        f.add("mixed")
    elif up:
        f.add("upper")
    elif lo:
        f.add("lower")
    if d and (up or lo):
        f.add("alnum")
    if k >= 16 and d and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        f.add("hexonly")
    if k >= 16 and d and up and lo and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core):
        f.add("b64")
    if d + up + lo < k:
        f.add("symbol" if core.isascii() else "wide")
    if k >= 8:
        h = -sum(c / k * math.log2(c / k) for c in (core.count(x) for x in set(core)))
        f.add("high" if h > 3.6 else "middle" if h > 3 else "flat")
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in core]
        if sum(a != b for a, b in zip(kind, kind[1:], strict=False)) * 4 >= k:
            f.add("turns")
    return f


class Table:
    """Word -> row of its scores: own (3), as prev, as prev2, as next; and file counts. Words of one shape share a row."""

    limit = 500_000

    def __init__(self, weights: np.ndarray):
        self.w, self.rows, self.at, self.shapes = weights, np.zeros((1, 14)), {}, {}

    def start(self) -> None:
        if len(self.at) > self.limit:
            self.at.clear()

    def row(self, word: bytes) -> int:
        s = word.decode("utf-8", "replace")
        f = shape(s)
        key = (frozenset(f), s[-1] in ".!?")
        if key not in self.shapes:
            r = np.zeros(14)
            r[:3] = self.w[:, [AT["bias"], *(AT[x] for x in f)]].sum(1)
            for k, side in enumerate(("prev", "prev2", "next")):
                r[3 + 3 * k : 6 + 3 * k] = self.w[:, [AT[f"{side}.{x}"] for x in _NEAR if x in f]].sum(1)
            if key[1]:
                r[3:6] += self.w[:, AT["prev.ends"]]
            r[12], r[13] = "keyword" in f or "assign" in f, "symbol" in f
            self.shapes[key] = len(self.rows)
            self.rows = np.concatenate([self.rows, r[None]])
        self.at[word] = self.shapes[key]
        return self.at[word]

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.at.get
        return np.fromiter((get(w) or self.row(w) for w in words), np.int64, len(words))


def emissions(rows: np.ndarray, t: Table) -> np.ndarray:
    """(words, 3) scores of one text."""
    r = t.rows[rows]
    e = r[:, :3].copy()
    e[1:] += r[:-1, 3:6]
    e[2:] += r[:-2, 6:9]
    e[:-1] += r[1:, 9:12]
    if len(r):
        if r[:, 12].any():
            e += t.w[:, AT["file.keyword"]]
        e += t.w[:, AT["file.symbols"]] * r[:, 13].mean()
    return e


def viterbi(texts: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of each text; texts of like length are decoded side by side."""
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
    order = [i for i in np.argsort([len(x) for x in texts], kind="stable") if len(texts[i])]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        least = len(texts[order[lo]])
        while hi < len(order) and hi - lo < 512 and len(texts[order[hi]]) <= 1.25 * least + 16:
            hi += 1
        own = order[lo:hi]
        size = len(texts[own[-1]])
        e = np.zeros((size, len(own), 3))
        e[:, :, 1:] = -1e6  # padding is outside, at no cost
        for k, i in enumerate(own):
            e[: len(texts[i]), k] = texts[i]
        back = np.empty((size, len(own), 3), np.int8)
        best = e[0].copy()
        best[:, I] -= 1e6
        for s in range(1, size):
            x = best[:, :, None] + trans[None]
            p = x.argmax(1)
            back[s] = p
            best = x.max(1) + e[s]
        tags = np.empty((size, len(own)), np.int8)
        tags[-1] = best.argmax(1)
        at = np.arange(len(own))
        for s in range(size - 1, 0, -1):
            tags[s - 1] = back[s, at, tags[s]]
        for k, i in enumerate(own):
            out[i] = tags[: len(texts[i]), k]
        lo = hi
    return out


# training

def examples(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Word sequences of WINDOW words with their tags."""
    r = random.Random(seed)
    syl = [a + v for a in "bcdfghlmnprstvw" for v in ("a", "e", "i", "o", "u", "en", "er", "on", "é", "ö")]
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    digits, hexa = "0123456789", "0123456789abcdef"
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def word():
        x = r.random()
        w = "".join(r.choice(syl) for _ in range(r.randint(1, 9 if x < 0.1 else 4)))
        w = w.capitalize() if r.random() < 0.12 else w
        return w + r.choice(["", "", "", "", "", ",", ".", ":", ".\"", "***", "###", "%%%", ";", "!"])

    def clean():
        x = r.random()
        if x < 0.8:
            return word()
        return r.choice([
            lambda: pick(digits, r.randint(1, 20)), lambda: f"{word().strip('.,:;!')}{r.randint(0, 99)}@mail{r.randint(0, 9)}.example.com",
            lambda: f"https://{word().strip('.,:')}.example.org/{word()}/{r.randint(1, 10**6)}?ref={word()}", lambda: "|", lambda: "=", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
            lambda: f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 7)}", lambda: f"20{pick(digits, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: r.choice(["token", "secret", "password", "key", "auth", "Secret", "tokens", "authority", "author", "private"]),
            lambda: f"{word()}={r.randint(0, 99)}", lambda: f"/usr/{word()}/{word()}.py", lambda: f"{word().strip('.,:;!').capitalize()}{word().strip('.,:;!').capitalize()}", lambda: f"{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}", lambda: f"({word()})", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        ])()

    def value():
        return r.choice([lambda: pick(hexa, r.choice([24, 32, 40, 64])), lambda: pick(b64, r.randint(16, 48)), lambda: pick(b64 + "+/", 40), lambda: "AKIA" + pick(b64[:26] + digits, 16), lambda: "ghp_" + pick(b64, 36), lambda: "sk-" + pick(b64, 40), lambda: "eyJ" + pick(b64, 30) + "." + pick(b64, 40), lambda: f"xoxb-{pick(digits, 11)}-{pick(b64, 24)}"])()

    def secret() -> tuple[list[str], list[int]]:
        key = r.choice(["token", "password", "api_key", "apikey", "secret", "passwd", "access_key", "AUTH_TOKEN", "client_secret", "DB_PASSWORD", "credential", "private_key"])
        v, q, end = value(), r.choice(["", '"', "'"]), r.choice(["", "", ",", ".", ";"])
        x = r.randint(0, 7)
        if x == 0:
            return [key, "=", q + v + q + end], [O, O, B]
        if x == 1:
            return [f"{key}:", q + v + q + end], [O, B]
        if x == 2:
            return [f"{key}={q}{v}{q}{end}"], [B]
        if x == 3:
            return [q + v + q + end], [B]
        if x == 4:
            return ["Authorization:", "Bearer", v], [O, O, B]
        if x == 5:
            p = pick(b64[:52], 4) + pick(digits, 3) + r.choice("!$#_-") + pick(b64, r.randint(2, 8))
            return [r.choice(["password", "passwd", "Password"]), r.choice(["=", ":"]), q + p + q], [O, O, B]
        if x == 6:
            k = r.randint(1, 4)
            return ["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *(pick(b64 + "+/", 64) for _ in range(k)), "-----END", "RSA", "PRIVATE", "KEY-----"][:WINDOW], ([B] + [I] * (k + 7))[:WINDOW]
        return [f'"{key}":', f'"{v}"' + r.choice(["", ","])], [O, B]

    out = []
    for _ in range(n):
        w, y = [clean() for _ in range(WINDOW)], [O] * WINDOW
        if r.random() < 0.5:
            s, t = secret()
            at = r.randint(0, WINDOW - len(s))
            w[at : at + len(s)], y[at : at + len(s)] = s, t
        out.append((w, y))
    return out


def _features(words: list[str]) -> list[list[int]]:
    f = [shape(w) for w in words]
    key, sym = any("keyword" in x or "assign" in x for x in f), sum("symbol" in x for x in f) / len(f)
    out = []
    for i in range(len(words)):
        x = [AT["bias"], *(AT[n] for n in f[i])]
        for side, j in (("prev", i - 1), ("prev2", i - 2), ("next", i + 1)):
            if 0 <= j < len(words):
                x += [AT[f"{side}.{n}"] for n in _NEAR if n in f[j]]
        if i and words[i - 1][-1] in ".!?":
            x.append(AT["prev.ends"])
        if key:
            x.append(AT["file.keyword"])
        out.append(x)
    return out, sym


@functools.lru_cache(4)
def train(n: int = SAMPLES, seed: int = SEED, rounds: int = 150, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(weights (3, features), transitions (3, 3)) of largest penalised likelihood."""
    data = examples(n, seed)
    x = np.zeros((n, WINDOW, len(NAMES)), np.float32)
    y = np.array([t for _, t in data])
    for i, (w, _) in enumerate(data):
        rows, sym = _features(w)
        for j, r in enumerate(rows):
            x[i, j, r] = 1
        x[i, :, AT["file.symbols"]] = sym
    w, tr = np.zeros((3, len(NAMES))), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(tr, 1e-6)
    one = np.eye(3)[y]
    xf = x.reshape(-1, len(NAMES))
    block = np.zeros(3)
    block[I] = -1e6
    for _ in range(rounds):
        e = (xf @ w.T.astype(np.float32)).reshape(n, WINDOW, 3).astype(float)
        e[:, 0] += block
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for s in range(1, WINDOW):
            a[:, s] = e[:, s] + lse(a[:, s - 1, :, None] + tr, 1)
        for s in range(WINDOW - 2, -1, -1):
            b[:, s] = lse(tr + (e[:, s + 1] + b[:, s + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + tr + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        real = np.einsum("nsi,nsj->ij", one[:, :-1], one[:, 1:])
        dw = ((one - p).reshape(-1, 3).T.astype(np.float32) @ xf) / n - penalty / 10 * w
        dt = (real - pair) / n - penalty / 10 * tr
        gw += dw**2
        gt += dt**2
        w += 0.5 * dw / np.sqrt(gw)
        tr += 0.5 * dt / np.sqrt(gt)
    return w, tr


def scan(texts: list[str], t: Table, trans: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """All spans of each text."""
    t.start()
    out = [base_spans(x) for x in texts]
    tags = viterbi([emissions(t.of(x.encode("utf-8", "replace").split()), t) for x in texts], trans)
    for text, spans, y in zip(texts, out, tags, strict=True):
        if not y.any():
            continue
        at = [m.span() for m in WORD.finditer(text)]
        i = 0
        added = []
        while i < len(y):
            if y[i] == O:
                i += 1
                continue
            j = i + 1
            while j < len(y) and y[j] == I:
                j += 1
            s, e = at[i][0], at[j - 1][1]
            if m := re.match(r"[\"']?[A-Za-z_.-]*[\"']?[:=]+", text[s : at[i][1]]):
                if KEYWORD.search(m[0]) and s + m.end() < e:
                    s += m.end()
            while s < e and text[s] in EDGE:
                s += 1
            while e > s and text[e - 1] in EDGE + ".!?":
                e -= 1
            if s < e and not any(a < e and s < b for _, a, b in spans):
                added.append(("crf", s, e))
            i = j
        spans += added
    return out


def _rows(w: np.ndarray, trans: np.ndarray, mask: str | None = None):
    def run(batches):
        t = Table(w)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 20):
                found = scan(texts[lo:hi], t, trans)
                count = lambda k: pa.array([sum(x[0] == k for x in f) for f in found], pa.int64())  # noqa: B023, E731
                base = [hashlib.sha256(joined([x for x in f if x[0] != "crf"]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), count("assign"), count("access"), count("hex"), pa.array(base), pa.array([joined(f) for f in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(_rows(*train()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, all columns, with every found span of text replaced by mark; n_chars follows where there is one."""
    w, trans = train()
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        t = Table(w)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in slices(np.fromiter((len(x or "") for x in texts), np.int64, len(texts)), 1 << 20):
                part, new = b.slice(lo, hi - lo), []
                for x, found in zip(texts[lo:hi], scan([x or "" for x in texts[lo:hi]], t, trans), strict=True):
                    out, done = [], 0
                    for _, s, e in sorted(found, key=lambda f: (f[1], f[2])):
                        if s >= done:
                            out += [x[done:s], mark]
                        done = max(done, e)
                    new.append("".join([*out, x[done:]]) if found else x)
                cols = part.columns
                cols[at] = pa.array(new, part.schema.field(at).type)
                if size >= 0:
                    cols[size] = pa.array([None if x is None else len(x) for x in new], part.schema.field(size).type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
