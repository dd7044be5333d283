"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Tokens that hold a digit, ``@`` or ``+`` are random variables; every other token is
fixed to "other", which cuts a text into short chains. Emissions come from hashed
features of the token's shape and neighbourhood, transitions link neighbours, and skip
edges link each token to the next one in the document with the same characters or the same
digits. Loopy message passing alternates exact passes over the chains with messages
along the skip edges, so that a token whose own evidence is weak follows its twins
elsewhere in the document.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import arrow_map, carry_schema, fitted, is_carried, per_task, texts_of
from tidewatch.llm.language import forward_backward

#: The base kinds, in the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
OTHER = len(KINDS)

# The base patterns, in forms that give the same matches in linear time: possessive, and
# numbers start where a run of digits starts.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")
_TRIGGER = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[^\s0-9@+]*+[0-9@+]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The name before an ``@`` reaches back as far as its characters go."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, z) for a, z in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the field ------------------------------------------------------------------

BITS = 14


@dataclass
class Tokens:
    """The variables of one text: spans, hashed features, chain breaks and skip edges."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    starts: list[int]  # first token of each chain
    edges: list[tuple[int, int]]


def _shape(s: str) -> str:
    """Characters by class, runs joined."""
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s)))[:24]


def _length(n: int) -> str:
    return str(n) if n < 20 else "20+" if n < 32 else "32+"


def tokens_of(text: str) -> Tokens:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    starts, feats, edges = [], [], []
    last_seen: dict[str, int] = {}
    for i, (a, z) in enumerate(spans):
        token = text[a:z]
        gap = text[spans[i - 1][1] : a] if i else "x"
        if not i or gap.strip() or not gap:
            starts.append(i)
        before = text[max(0, a - 40) : a].split()
        after = text[z : z + 40].split()
        digits = re.sub(r"\D", "", token)
        core = re.sub(r"[\W_]+", "", token).lower()
        names = (
            "bias",
            "shape=" + _shape(token),
            "core=" + _shape(token.strip("\"'.,;:!?()[]{}<>#$%&*|")),
            "digits=" + _length(len(digits)),
            "length=" + _length(z - a),
            "at=" + str("@" in token),
            "plus=" + str(token[0] == "+"),
            "dots=" + str(min(4, token.count("."))),
            "hex=" + str(bool(re.fullmatch(r"[0-9a-f]+", core)) and any(c.isalpha() for c in core)),
            "before=" + (before[-1].lower()[-12:] if before and before[-1].isascii() and not _TRIGGER.search(before[-1]) else "-"),
            "before shape=" + (_shape(before[-1]) if before else "-"),
            "after shape=" + (_shape(after[0]) if after else "-"),
            "two before=" + (_shape(before[-2]) if len(before) > 1 else "-"),
            "digits and dots=" + _length(len(digits)) + "/" + str(token.count(".")),
        )
        feats.append([xxhash.xxh64_intdigest(n) & ((1 << BITS) - 1) for n in names])
        for key in {"c" + core if len(core) >= 4 else "", "d" + digits if len(digits) >= 6 else ""}:
            if key:
                if key in last_seen:
                    edges.append((last_seen[key], i))
                last_seen[key] = i
    return Tokens(spans, np.array(feats, dtype=np.int64).reshape(len(spans), -1), starts, list(dict.fromkeys(edges)))


@dataclass
class Field:
    weights: np.ndarray  # (features, labels)
    trans: np.ndarray  # exp(scores); chains begin and end next to "other"
    skip: np.ndarray  # exp(scores) of a pair of linked tokens

    def potentials(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        s = self.weights[features].sum(axis=1)
        e = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -40))
        e[np.cumsum(lengths) - 1] *= self.trans[:, OTHER]
        return e

    def marginals(self, features: np.ndarray, lengths: np.ndarray, edges: np.ndarray, rounds: int = 6) -> np.ndarray:
        """Loopy message passing; without skip edges one pass is exact."""
        e = self.potentials(features, lengths)
        p = forward_backward(e, self.trans, self.trans[OTHER], lengths)
        if not len(edges):
            return p
        a, b = edges[:, 0], edges[:, 1]
        to_b, to_a = (np.ones((len(edges), p.shape[1])) for _ in range(2))
        for _ in range(rounds):
            from_a, from_b = p[a] / np.maximum(to_a, 1e-12), p[b] / np.maximum(to_b, 1e-12)
            new_b, new_a = from_a @ self.skip, from_b @ self.skip.T
            new_b /= new_b.sum(axis=1, keepdims=True)
            new_a /= new_a.sum(axis=1, keepdims=True)
            moved = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
            to_b, to_a = new_b, new_a
            logs = np.zeros_like(e)
            np.add.at(logs, a, np.log(np.maximum(to_a, 1e-12)))
            np.add.at(logs, b, np.log(np.maximum(to_b, 1e-12)))
            with_skips = e * np.exp(logs - logs.max(axis=1, keepdims=True))
            p = forward_backward(np.maximum(with_skips, 1e-200), self.trans, self.trans[OTHER], lengths)
            if moved < 1e-4:
                break
        return p


def _batch(texts: list[Tokens]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, chain lengths and edges of several texts, numbered through."""
    feats, lengths, edges, base = [], [], [], 0
    for t in texts:
        n = len(t.spans)
        feats.append(t.features)
        lengths += np.diff([*t.starts, n]).tolist()
        edges += [(base + a, base + b) for a, b in t.edges]
        base += n
    return np.concatenate(feats), np.array(lengths, dtype=np.int64), np.array(edges, dtype=np.int64).reshape(-1, 2)


def _gold(text: str, t: Tokens) -> list[int]:
    """Labels of the tokens by what the base patterns and the secret form cover."""
    known = [*base_spans(text), *(("secret", *m.span()) for m in _SECRET.finditer(text))]
    out = []
    for a, z in t.spans:
        out.append(next((KINDS.index(k) for k, s, e in known if s < z and a < e), OTHER))
    return out


def fit(texts: list[str], rounds: int = 40) -> Field:
    """Piecewise training: chains by likelihood, skip edges by how linked labels agree."""
    n = len(KINDS) + 1
    w, a = np.zeros((1 << BITS, n)), np.zeros((n, n))
    field = Field(w, np.exp(a), np.ones((n, n)))
    split = [(t, tokens_of(t)) for t in texts if t and _TRIGGER.search(t)]
    if not split:
        w[:, OTHER] = 1.0  # nothing learned: every token is "other"
        return field
    feats, lengths, edges = _batch([s for _, s in split])
    gold = np.array([y for t, s in split for y in _gold(t, s)])
    hot = np.eye(n)[gold]
    starts = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(gold)), starts)  # tokens with a neighbour before them
    true = np.zeros((n, n))
    np.add.at(true, (gold[inner - 1], gold[inner]), 1)
    np.add.at(true, (np.full(len(starts), OTHER), gold[starts]), 1)
    np.add.at(true, (gold[starts + lengths - 1], np.full(len(starts), OTHER)), 1)
    a[:] = np.log(true + 0.5) - np.log((true + 0.5).sum(axis=1, keepdims=True))
    field.trans = np.exp(a)
    total = np.full_like(w, 1e-6)
    for _ in range(rounds):
        field.weights = w
        p = forward_backward(field.potentials(feats, lengths), field.trans, field.trans[OTHER], lengths)
        diff = hot - p
        g = np.zeros_like(w)
        for k in range(n):
            for f in range(feats.shape[1]):
                g[:, k] += np.bincount(feats[:, f], weights=diff[:, k], minlength=len(g))
        g -= 0.02 * w
        total += g * g
        w += 0.3 * g / np.sqrt(total) * (g != 0)
    pairs = np.full((n, n), 0.5)
    if len(edges):
        np.add.at(pairs, (gold[edges[:, 0]], gold[edges[:, 1]]), 1)
    pairs += pairs.T
    field.skip = pairs / np.sqrt(np.outer(pairs.sum(axis=1), pairs.sum(axis=0)))
    return field


def added_spans(text: str, t: Tokens, p: np.ndarray, base: list[tuple[str, int, int]], sure: float) -> list[tuple[str, int, int]]:
    """Runs of neighbouring tokens with one sure kind that no base span touches."""
    best = p.argmax(axis=1)
    firsts = set(t.starts)
    out: list[tuple[str, int, int]] = []
    open_run = None
    for i, (a, z) in enumerate(t.spans):
        kind = KINDS[best[i]] if best[i] != OTHER and p[i, best[i]] >= sure else None
        if kind and any(s < z and a < e for _, s, e in base):
            kind = None
        if kind and open_run and open_run[0] == kind and i not in firsts:
            open_run[2] = z
        else:
            if open_run:
                out.append(tuple(open_run))
            open_run = [kind, a, z] if kind else None
    if open_run:
        out.append(tuple(open_run))
    trimmed = []
    for kind, a, z in out:
        while a < z and text[a] in "\"'.,;:!?([{<#$%&*|":
            a += 1
        while z > a and text[z - 1] in "\"'.,;:!?)]}>#$%&*|":
            z -= 1
        if a < z:
            trimmed.append((kind, a, z))
    return trimmed


def training_texts(docs: DataFrame, bound: int, longest: int) -> DataFrame:
    """About ``bound`` texts of at most ``longest`` characters, chosen by their id's hash."""
    n = docs.count()
    share = int(1_000_000 * min(1.0, bound / n)) if n else 0
    rows = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).filter(F.col("text").rlike("[0-9@+]") & (F.length("text") <= longest))
    return rows.select("text")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, train_docs: int = 4000, train_longest: int = 20_000, sure: float = 0.8, redact: bool = False) -> DataFrame:
    """doc_id, text, the counts of base spans, their digest, and all spans of every document;
    docs hold doc_id and text, or doc_id and ``row`` (see ``carried``), which is passed on. ``redact`` gives, in place of the text, ``clean``: the text
    with its spans replaced by their kinds, NULL where there is none.

    Offsets are in code points, ends exclusive. NULL and empty texts have no span (and
    the digest of the empty string); repeated rows are judged each for itself. The field
    is fitted on a bounded sample (``train_docs``, ``train_longest``) and run on all rows.
    """

    def arrays_of(rows):
        field = fit([text for text, in rows])
        return {"weights": field.weights, "trans": field.trans, "skip": field.skip}

    sample = training_texts(docs.select("row.*") if is_carried(docs) else docs, train_docs, train_longest)
    learned = fitted(sample, arrays_of)
    arrays = docs.sparkSession.sparkContext.broadcast((learned["weights"], learned["trans"], learned["skip"]))

    @per_task
    def factory():
        field = Field(*arrays.value)

        def rows(cols):
            texts = texts_of(cols)
            base = [base_spans(t) for t in texts]
            split = {i: s for i, t in enumerate(texts) if _TRIGGER.search(t) and (s := tokens_of(t)).spans}
            more: dict[int, list] = {}
            if split:
                p = field.marginals(*_batch(list(split.values())))
                at = 0
                for i, s in split.items():
                    more[i] = added_spans(texts[i], s, p[at : at + len(s.spans)], base[i], sure)
                    at += len(s.spans)
            out = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE_KINDS}
            out["spans"] = joined_spans = [joined([*b, *more.get(i, [])]) for i, b in enumerate(base)]
            out |= {c: cols[c] for c in ("doc_id", "row") if c in cols} | {"text": texts}
            out["clean"] = [redact_text(t, s) if s else None for t, s in zip(texts, joined_spans)] if redact else None
            out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            return out

        return rows

    columns = f"doc_id long, {'clean' if redact else 'text'} string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(docs.select("doc_id", "row" if is_carried(docs) else "text"), factory, carry_schema(docs, columns))


def redact_text(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, z in sorted(((k, int(a), int(z)) for k, a, z in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        else:
            out += [text[at:at]]
        at = max(at, z)
    return "".join([*out, text[at:]])
