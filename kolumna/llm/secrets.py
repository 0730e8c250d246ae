"""Secrets in texts: three base patterns, and a linear-chain conditional random field for what they miss.

A line's tokens are tagged secret begin, inside or outside.  A token's
features are its shape, length, hex and digit share and changes of character
class, the words, separators and shapes beside it, and two of its file (how
many assignments and how many tokens with digits it has).  All are categories,
so a token's scores are sums of table rows, taken for whole blocks of texts at
once.  The best tags of a line come from Viterbi; lines in which no token
comes near enough to matter (a bound that proves the all-outside path best)
are not decoded.

The field is fitted on stretches of lines (``STRETCH`` tokens at most) from at
most ``SAMPLE`` documents of any length, labelled by the base patterns, and on
made-up lines with secrets in other surroundings.  Documents and stretches are
chosen by hashes, so reruns agree, and wherever they lie; what reaches the
driver is ``LINES`` stretches of either sort.  Base spans always stay, and
tagged spans that touch none of them are added.

Defined cases: a null text is empty; ids play no part but for the choice of
the sample; offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm import textblocks
from kolumna.llm.work import chance, forget, modest, saved

#: Documents whose lines may be used to fit, stretches of lines taken of each sort (with a secret or without), and tokens of a stretch.
SAMPLE, LINES, STRETCH = 2_000, 600, 64
#: Words of made-up lines.
VOCABULARY = 2_000
KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_STEMS = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets that the base patterns find, in order: of an assignment its value, else the match."""
    found = []
    if assign:
        found += [(m.start(2), "assign", m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if access:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


# Tokens: runs of these bytes; the rest separates.
_bytes = np.arange(256)
_LOWER, _UPPER, _DIGIT = (_bytes >= 97) & (_bytes <= 122), (_bytes >= 65) & (_bytes <= 90), (_bytes >= 48) & (_bytes <= 57)
_MARK = np.isin(_bytes, np.frombuffer(b"_-+/.", np.uint8))
_TOKEN = _LOWER | _UPPER | _DIGIT | _MARK | (_bytes >= 128)
_BITS = (_LOWER * 1 + _UPPER * 2 + _DIGIT * 4 + _MARK * 8 + (_bytes >= 128) * 16).astype(np.uint8)
_NOT_HEX = (~(_DIGIT | ((_bytes >= 97) & (_bytes <= 102)))).astype(np.uint8) * 32
_CLASS = _BITS | _NOT_HEX
_SEP = np.zeros(256, np.uint8)
for _c, _v in ((b"=", 1), (b":", 2), (b"\"'`", 4), (b"\n\r", 8)):
    _SEP[np.frombuffer(_c, np.uint8)] = _v
_LENGTHS = np.array([2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 40, 64])
_TURNS = np.array([1, 2, 3, 4, 6, 9])
#: Words before a secret, by sort.
_CUES = {1: "password passwd passphrase pwd pass", 2: "secret token apikey api_key key access_key client_secret private_key access_token", 3: "bearer authorization auth credential credentials basic"}


def _word_hashes(words: list[str]) -> np.ndarray:
    return textblocks.Words(*textblocks.raw(pa.array(words)), _TOKEN).hash


_cue_hash, _cue_sort = _word_hashes(" ".join(_CUES.values()).split()), np.concatenate([np.full(len(v.split()), k) for k, v in _CUES.items()])
_order = np.argsort(_cue_hash)
_cue_hash, _cue_sort = _cue_hash[_order], _cue_sort[_order]

#: Number of values of each feature.
SIZES = (32, len(_LENGTHS) + 1, 10, len(_TURNS) + 1, 4, 16, 16, 33, 33, 16, 16)


def _shift(x: np.ndarray, by: int, fill: int, line: np.ndarray) -> np.ndarray:
    """The value of the token ``by`` places before (after, if negative) in the same line, or ``fill``."""
    out = np.full(len(x), fill, x.dtype)
    if by > 0:
        out[by:] = np.where(line[by:] == line[:-by], x[:-by], fill)
    else:
        out[:by] = np.where(line[:by] == line[-by:], x[-by:], fill)
    return out


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[textblocks.Words, np.ndarray, np.ndarray]:
    """Tokens of a block of texts, the line of each (numbered over the block), and their features (tokens by features)."""
    words = textblocks.Words(buf, offsets, _TOKEN)
    m = len(words.start)
    if not m:
        return words, np.zeros(0, np.int64), np.zeros((0, len(SIZES)), np.int64)
    b, start, end, text = words.buf, words.start, words.end, words.text_of
    length = end - start
    gaps = np.zeros(len(b) + 1, np.uint8)
    gaps[: len(b)] = _SEP[b]
    edges = np.ravel(np.column_stack([start, end]))
    reduced = np.bitwise_or.reduceat(gaps, edges)  # token, gap, token, gap ...
    after = reduced[1::2].astype(np.int64)
    after[end == np.append(start[1:], len(b))] = 0
    first = np.ones(m, bool)
    first[1:] = (text[1:] != text[:-1]) | ((after[:-1] & 8) > 0)
    line = np.cumsum(first) - 1
    inside = _TOKEN[b]
    at = np.cumsum(length) - length
    klass = _CLASS[b[inside]]
    bits = np.bitwise_or.reduceat(klass, at).astype(np.int64)
    shape = bits & 31
    digits = np.add.reduceat(((klass & 4) > 0).astype(np.int64), at)
    turn = np.zeros(len(klass), np.int64)
    turn[1:] = (klass[1:] & 31) != (klass[:-1] & 31)
    turn[at] = 0
    turns = np.add.reduceat(turn, at)
    cue = np.searchsorted(_cue_hash, words.hash)
    cue[cue == len(_cue_hash)] = 0
    cue = np.where(_cue_hash[cue] == words.hash, _cue_sort[cue], 0)
    before = _shift(after, 1, 8, line)
    n = len(offsets) - 1
    per = np.maximum(np.bincount(text, minlength=n), 1)
    signs = np.minimum(np.bincount(text, after & 3 > 0, minlength=n), 3).astype(np.int64)
    share = np.minimum(np.bincount(text, digits > 0, minlength=n) * 40 // per, 3).astype(np.int64)
    table = np.column_stack([
        shape, np.searchsorted(_LENGTHS, length, "right"), ((bits & 32) == 0) * 5 + digits * 4 // length, np.searchsorted(_TURNS, turns, "right"),
        _shift(cue, 1, 0, line), before, after, _shift(shape, 1, 32, line), _shift(shape, -1, 32, line), _shift(cue, 2, 0, line) * 4 + np.minimum(before & 3, 3), (signs * 4 + share)[text],
    ])
    return words, line, table


class Field:
    """Weights of the conditional random field. Tags: 0 outside, 1 begin, 2 inside."""

    def __init__(self):
        self.tables = [np.zeros((n, 3)) for n in SIZES]
        self.moves = np.zeros((3, 3))
        self.moves[0, 2] = -np.inf  # nothing is inside that did not begin
        self.start = np.array([0.0, 0.0, -np.inf])

    def emissions(self, table: np.ndarray) -> np.ndarray:
        return sum((t[table[:, k]] for k, t in enumerate(self.tables)), np.zeros((len(table), 3)))

    def fit(self, lines: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Gradient ascent (Adam) on the likelihood of tagged lines: (features, tags) of each."""
        if not lines:
            return self
        width = max(len(y) for _, y in lines)
        x = np.zeros((len(lines), width, len(SIZES)), np.int64)
        y, mask = np.zeros((len(lines), width), np.int64), np.zeros((len(lines), width), bool)
        for k, (f, t) in enumerate(lines):
            x[k, : len(t)], y[k, : len(t)], mask[k, : len(t)] = f, t, True
        flat, tags, real = x.reshape(-1, len(SIZES)), y.reshape(-1), mask.reshape(-1)
        truth = np.zeros((len(tags), 3))
        truth[np.arange(len(tags))[real], tags[real]] = 1
        pairs = mask[:, 1:]
        seen = np.zeros((3, 3))
        np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        params = [*self.tables, self.moves]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n = len(lines)
        for step in range(1, rounds + 1):
            e = self.emissions(flat).reshape(n, width, 3)
            grow = np.exp(self.moves)
            alpha, beta, scale = np.zeros((n, width, 3)), np.ones((n, width, 3)), np.ones((n, width))
            ee = np.exp(e - e.max(axis=2, keepdims=True))
            a = np.exp(self.start) * ee[:, 0]
            for t in range(width):
                if t:
                    a = np.where(mask[:, t, None], (alpha[:, t - 1] @ grow) * ee[:, t], alpha[:, t - 1])
                scale[:, t] = a.sum(axis=1)
                alpha[:, t] = a = a / scale[:, t, None]
            for t in range(width - 2, -1, -1):
                nxt = (ee[:, t + 1] * beta[:, t + 1]) @ grow.T / scale[:, t + 1, None]
                beta[:, t] = np.where(mask[:, t + 1, None], nxt, 1.0)
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            both = alpha[:, :-1, :, None] * grow * (ee[:, 1:] * beta[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
            expected = both[pairs].sum(axis=0)
            gap = np.where(real[:, None], truth - post.reshape(-1, 3), 0.0)
            grads = [np.column_stack([np.bincount(flat[:, k], gap[:, c], minlength=size) for c in range(3)]) for k, size in enumerate(SIZES)]
            grads.append(np.where(np.isfinite(self.moves), seen - expected, 0.0))
            for k, (p, g) in enumerate(zip(params, grads)):
                g = g / n - decay * np.where(np.isfinite(p), p, 0.0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one line from its emissions."""
        back = np.zeros((len(e), 3), np.int64)
        score = self.start + e[0]
        for t in range(1, len(e)):
            ways = score[:, None] + self.moves
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + e[t]
        tags = np.empty(len(e), np.int64)
        tags[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def tag(self, line: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Tags of a block's tokens."""
        e = self.emissions(table)
        tags = np.zeros(len(e), np.int64)
        # A stretch of k tokens off the outside path changes k + 1 moves, none of which gains more than this.
        gain = max(0.0, float(np.max(np.where(np.isfinite(self.moves), self.moves, -np.inf)) - self.moves[0, 0]))
        close = np.maximum(e[:, 1], e[:, 2]) - e[:, 0] >= -2 * gain
        for k in np.unique(line[close]):
            a, b = np.searchsorted(line, k), np.searchsorted(line, k, "right")
            tags[a:b] = self.viterbi(e[a:b])
        return tags


_FRAMES = (
    'api_key: "{}"', "Authorization: Bearer {}", "client_secret={}", "export ACCESS_KEY={}", "passphrase = '{}'", "pwd: {}", "credentials {}", "private_key='{}'",
    "password is {}", "access_token: {}", "the secret {}", "auth={}", 'pass = "{}"', "key: {}",
)
_PLAIN = ("version: {}", "id={}", "see https://example.org/{} for", "call {}", "on {}", "build {}", "size = {}", "mail {}", "the token ring", "a key: point", "password reset page", "secret garden", "page {}", "order {}")


def made_lines(words: list[str], n: int, seed: int = 7, frames: tuple[str, ...] = _FRAMES, plain_frames: tuple[str, ...] = _PLAIN) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up lines with the spans of their secrets; every other line has none."""
    rng = np.random.default_rng(seed)
    letters = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"]
    plain = ["1.2.3", "42", "2024-05-01", "12:30", "4929381332664295", "10.12.0.7", "index.html", "a.b@mail.org", "README", "HTTP/2", "x86_64", "3.14159", "UTF-8", "5551234567", "v2.0-rc1", "ISO-8859-1"]
    out = []
    for k in range(n):
        before, after = (" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(2))
        if k % 2:
            kind = letters[rng.integers(len(letters))]
            secret = "".join(rng.choice(list(kind), rng.integers(16, 44)))
            frame = frames[rng.integers(len(frames))]
        else:
            secret, frame = plain[rng.integers(len(plain))], plain_frames[rng.integers(len(plain_frames))]
        head, hole, tail = frame.partition("{}")
        text = f"{before} {head}".lstrip()
        spans = [(len(text), len(text) + len(secret))] if k % 2 else []
        out.append((f"{text}{secret if hole else ''}{tail} {after}", spans))
    return out


def _tagged(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines of a text as (features, tags), for fitting; longer lines are several stretches."""
    raw = text.encode()
    words, line, table = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    tags = np.zeros(len(words.start), np.int64)
    for a, b in spans:
        x, y = len(text[:a].encode()), len(text[:b].encode())
        at = np.arange(np.searchsorted(words.end, x, "right"), np.searchsorted(words.start, y))
        tags[at[:1]], tags[at[1:]] = 1, 2
    bounds = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(line))
    for a, b in zip(bounds, bounds[1:]):
        for c in range(a, b, STRETCH):
            t = tags[c : min(c + STRETCH, b)].copy()
            if t[0] == 2:
                t[0] = 1
            yield table[c : min(c + STRETCH, b)], t


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to stretches of their lines: a hash, whether a secret begins in it, its features and tags."""
    for batch in batches:
        for text in textblocks.column(batch, "text"):
            text = text.as_py() or ""
            found = [(f, t) for f, t in _tagged(text, [(s, e) for s, _, e in base_spans(text)])]
            names = [hashlib.md5(f.tobytes() + t.tobytes()).digest()[:8] for f, t in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(x, "little", signed=True) for x in names], pa.int64()), pa.array([bool((t == 1).any()) for _, t in found], pa.bool_()),
                    pa.array([f.ravel().astype(np.int32) for f, _ in found], pa.list_(pa.int32())), pa.array([t.astype(np.int32) for _, t in found], pa.list_(pa.int32())),
                ],
                ["key", "hot", "x", "y"],
            )


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Field:
    """The field for ``docs``: fitted on the driver, on bounded samples."""
    whole = F.col(text).cast("string")
    # Half of the sample are documents with a cue, which are rare. What is scanned for secrets is every document.
    cue = F.rlike("text", F.lit("(?i)(passw|secret|token|api_?key)"))
    rows = docs.select(F.xxhash64(F.col(doc_id), whole).alias("key"), whole.alias("text")).where(F.octet_length("text") > 0).withColumn("cue", cue)
    of = rows.agg(F.count_if("cue"), F.count_if(~F.col("cue"))).first()
    chosen = rows.where(F.when(F.col("cue"), chance(F.col("key"), SAMPLE // 2, of[0])).otherwise(chance(F.col("key"), SAMPLE // 2, of[1])))
    pool = saved(modest(chosen).groupBy("key").agg(F.first("text").alias("text")).select("text"), "sample")
    # Equal stretches count once, so a line that half of the corpus repeats is one of them.
    stretches = saved(pool.mapInArrow(_stretches, "key bigint, hot boolean, x array<int>, y array<int>").groupBy("key").agg(F.first("hot").alias("hot"), F.first("x").alias("x"), F.first("y").alias("y")), "stretches")
    of = stretches.agg(F.count_if("hot"), F.count_if(~F.col("hot"))).first()
    lines = []
    for sort, n in ((F.col("hot"), of[0]), (~F.col("hot"), of[1])):
        taken = stretches.where(sort & chance(F.col("key"), LINES, n)).limit(LINES).collect()
        lines += [(np.array(r["x"], np.int64).reshape(-1, len(SIZES)), np.array(r["y"], np.int64)) for r in sorted(taken, key=lambda r: r["key"])]
    word = F.explode(F.split("text", r"[^\p{L}]+")).alias("word")
    words = pool.select(word).where(F.length("word").between(1, 30)).distinct().orderBy(F.xxhash64("word"), "word").limit(VOCABULARY).collect()
    made = made_lines([r["word"] for r in words] or "the of and to in a is that for it".split(), LINES)
    forget(pool)
    forget(stretches)
    return Field().fit(lines + [x for t, s in made for x in _tagged(t, s)])


def spans_of(field: Field, texts: pa.Array) -> list[list[tuple[int, str, int]]]:
    """(start, kind, end) of the secrets in each text."""
    buf, offsets = textblocks.raw(texts)
    out: list[list[tuple[int, str, int]]] = []
    for i, j in textblocks.blocks(offsets):
        words, line, table = features(buf, offsets[i : j + 1])
        tags = field.tag(line, table)
        b, first = words.buf, offsets[i : j + 1] - offsets[i]
        breaks = np.concatenate([[-1], np.flatnonzero(_NOT_HEX[b]), [len(b)]])
        long = np.flatnonzero(np.diff(breaks) > 32)
        hexes = np.zeros(j - i, bool)
        for a, c in zip(breaks[long] + 1, breaks[long + 1]):  # a run of hex bytes may lie over several texts
            hexes[np.searchsorted(first, a, "right") - 1 : np.searchsorted(first, c, "left")] = True
        begin = np.flatnonzero(tags == 1)
        owner = words.text_of[begin]
        for k in range(j - i):
            raw = b[first[k] : first[k + 1]].tobytes()
            low = raw.lower()
            assign, access = any(s in low for s in _STEMS), b"AKIA" in raw
            tagged = begin[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
            if not (assign or access or hexes[k] or len(tagged)):
                out.append([])
                continue
            spans = base_spans(raw.decode(), assign, access, hexes[k])
            if len(tagged):
                # Code points before each byte, and up to where the base spans that begin before one reach.
                points = np.concatenate([[0], np.cumsum((b[first[k] : first[k + 1]] & 0xC0) != 0x80)])
                begins, reach = [s[0] for s in spans], list(accumulate((s[2] for s in spans), max))
                for t in tagged.tolist():
                    last = t
                    while last + 1 < len(tags) and tags[last + 1] == 2 and line[last + 1] == line[t]:
                        last += 1
                    s, e = int(points[words.start[t] - first[k]]), int(points[words.end[last] - first[k]])
                    before = bisect_left(begins, e)
                    if not before or reach[before - 1] <= s:
                        spans.append((s, "crf", e))
                spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
            out.append(spans)
    return out


def base_matches(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The base spans of a text with the whole match in place of an assignment's value."""
    matches = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if any(s[1] == "assign" for s in spans) else []
    return sorted([*matches, *(s for s in spans if s[1] not in ("assign", "crf"))], key=lambda s: (s[0], KINDS.index(s[1])))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _report(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textblocks.column(batch, "text")
            found = spans_of(field.value, texts)
            base = [[s for s in x if s[1] != "crf"] for x in found]
            whole = [base_matches(t.as_py(), x) if any(s[1] == "assign" for s in x) else x for t, x in zip(texts, base)]
            every = [_joined(sorted([*w, *(s for s in x if s[1] == "crf")], key=lambda s: (s[0], KINDS.index(s[1])))) for w, x in zip(whole, found)]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
            texts_of = ([_digest(_joined(x)) for x in base], [_joined(x) for x in found], [_digest(_joined(x)) for x in whole], every)
            yield pa.RecordBatch.from_arrays(
                [textblocks.column(batch, "doc_id"), *counts, *(pa.array(c, pa.string()) for c in texts_of)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "base_match_sha256", "match_spans"],
            )

    return run


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end" joined by commas), base_match_sha256, match_spans.

    The span of an assignment is its value; ``base_match_sha256`` and ``match_spans`` are the digest and the spans with the whole match in its place."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = modest(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_report(field), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, base_match_sha256 string, match_spans string")


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the text replaced; of an assignment the value goes. Texts without secrets stay as they are."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, doc_id, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = []
            for t, spans in zip(texts, spans_of(field.value, texts)):
                t = t.as_py()
                if spans:
                    parts, done = [], 0
                    for s, e in sorted((s[0], s[2]) for s in spans):
                        if e > done:
                            if s >= done:
                                parts += [t[done:s], by]
                            done = e
                    t = "".join([*parts, t[done:]])
                new.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return modest(docs).mapInArrow(run, docs.schema)
