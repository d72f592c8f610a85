"""Operator 4: personal data by weak supervision.

The base finds e-mail addresses, IP addresses, card and phone numbers by four fixed rules; its spans always
stay. Looser candidates (written-out e-mail addresses, phone numbers without a plus, numbers of other
lengths, whatever the base rules found and dropped, and long keys of letters and digits, the further kind secret)
are voted on by labelers: rules of form, gazetteers and words of the context, each of which may abstain.
Expectation-maximisation over the votes of the whole corpus estimates how reliable each labeler is for each kind,
from given shares of true spans among candidates and base spans. Its posterior trains a logistic span classifier on
votes and shape, which does not see whether a fixed rule matched. Candidates are added from the score at which, by the
posterior, PRECISE of all candidates from there on are true.

What is gathered of the corpus are counts of vote and shape patterns, of which there is a fixed number.
Null and empty texts have no spans; an empty table gives an empty result. Places are code points, the end exclusive.
Repeated rows are searched each. Of candidates that overlap the first, then the longest, then the first kind stays.
A text is searched in one task's memory, at some 10 bytes a character.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstat.llm.shared import filled, mapped

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PRECISE = 0.9  # share of true spans among added ones, by the posterior
CONTEXT = 40  # code points before a candidate

# Gazetteers and context words of the labelers.
DOMAINS = frozenset("com org net edu gov info biz io co de fr es uk eu us ch at it nl".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "62")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
WORDS = {
    "email": frozenset("mail email e-mail contact write address correo courriel adresse".split()),
    "ip": frozenset("ip address host server client login addr".split()),
    "card": frozenset("card visa mastercard credit debit carte karte tarjeta payment".split()),
    "phone": frozenset("phone tel call mobile fax telephone telefon teléfono téléphone handy".split()),
    "secret": frozenset("token key apikey secret password passwd pwd api auth bearer credential credentials clave passwort schlüssel clé".split()),
}
AGAINST = frozenset("version release isbn order invoice id section no nr page chapter commit checksum sha sha256 md5 digest revision etag".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
HEX_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Equal to the fixed rules but for the look behind, which keeps long runs of digits from being read again and again.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,64}){1,4}"),
    "phone": re.compile(r"(?<![+0-9])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])"),
}
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ANY = re.compile("[0-9@\\[(]")
_WORD = re.compile(r"[^\W\d_][\w-]*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @: the run of local letters before it, no further back than the match before."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _TAIL.match(text, at + 1) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return out


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """What the fixed rules find, by kind and start, and what they find and drop."""
    if not _ANY.search(text):
        return [], []
    kept, dropped = emails(text), []
    for m in _IP.finditer(text):
        (kept if all(len(p) < 4 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))) else dropped).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 8:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            kept.append(("card", *m.span()))
        elif 12 <= len(digits) <= 19:
            dropped.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        (kept if 8 <= sum(map(str.isdigit, m[0])) <= 15 else dropped).append(("phone", *m.span()))
    return kept, dropped


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the others to be judged; these touch no base span."""
    kept, more = base_spans(text)
    if "[" in text or "(" in text:
        more += [("email", *m.span()) for m in _LOOSE["email"].finditer(text)]
    if _ANY.search(text):
        more += [("phone", *m.span()) for m in _LOOSE["phone"].finditer(text)]
        more += [("secret", *m.span()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    taken = sorted((a, b) for _, a, b in kept)
    rest, end, at = [], -1, 0
    for kind, a, b in sorted(more, key=lambda s: (s[1], -s[2], ALL_KINDS.index(s[0]))):
        while at < len(taken) and taken[at][1] <= a:  # ends before this and so before all later candidates
            at += 1
        if a >= end and not any(x < b and y > a for x, y in taken[at : at + len(KINDS)]):
            rest.append((kind, a, b))
            end = b
    return kept, rest


def votes(text: str, span: Span) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler (form, gazetteer, context), then bits of shape."""
    kind, a, b = span
    body = text[a:b]
    digits = "".join(c for c in body if "0" <= c <= "9")
    before = {w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT) : a])}
    context = 1 if before & WORDS[kind] else -1 if before & AGAINST else 0
    if kind == "email":
        form, gazette = 1 if "@" in body or "." in body or "dot" in body.lower() else -1, 1 if body.rsplit(".", 1)[-1].strip(" ])").lower() in DOMAINS or body.split(" ")[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        form, gazette = 1 if all(len(p) < 4 for p in body.split(".")) else -1, 0 if body.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        form, gazette = 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        form, gazette = 1 if 9 <= len(digits) <= 13 else -1, 1 if body.startswith("+") and digits.startswith(CODES) else 0
    else:
        form = 1 if len(body) in HEX_LENGTHS and _HEX.fullmatch(body) else 1 if len(set(body)) >= 14 and 4 * len(digits) <= 3 * len(body) and 8 * len(digits) >= len(body) and body.lower() != body else -1
        gazette = 1 if body.startswith(PREFIXES) else 0
    return form, gazette, context, int(" " in body or "-" in body), int(len(digits) >= 10), int(text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())


LABELERS = 3
SHAPES = 3
#: Shares of true spans among candidates and among base spans. Given, for votes that all agree cannot tell them.
PRIOR = np.array([0.5, 0.95])


class SpanModel:
    """Reliability of each labeler by kind, the classifier trained on their posterior, and the score from which it adds spans."""

    def __init__(self) -> None:
        self.hit = {k: np.full(LABELERS, 0.8) for k in ALL_KINDS}  # share of right votes, of those that a labeler casts
        self.weights = {k: np.zeros(LABELERS + SHAPES + 1) for k in ALL_KINDS}
        self.least = dict.fromkeys(ALL_KINDS, np.inf)

    def posterior(self, kind: str, v: np.ndarray, strict: np.ndarray) -> np.ndarray:
        odds = v @ np.log(self.hit[kind] / (1 - self.hit[kind])) + np.log(PRIOR[strict] / (1 - PRIOR[strict]))  # to abstain says nothing
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def scores(self, kind: str, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[kind][:-1] + self.weights[kind][-1], -30, 30)))

    def fit(self, patterns: dict[tuple, int], rounds: int = 50) -> SpanModel:
        """``patterns``: (kind, whether of the base, votes and shape) to how often it occurs."""
        for kind in ALL_KINDS:
            rows = sorted((p[1:], n) for p, n in patterns.items() if p[0] == kind)
            if not rows:
                continue
            strict, x, n = np.array([int(r[0][0]) for r in rows]), np.array([r[0][1] for r in rows], float), np.array([r[1] for r in rows], float)
            v = x[:, :LABELERS]
            for _ in range(rounds):
                q = self.posterior(kind, v, strict)
                right = (n[:, None] * np.where(v > 0, q[:, None], np.where(v < 0, 1 - q[:, None], 0))).sum(0)
                self.hit[kind] = np.clip((right + 8) / ((n[:, None] * (v != 0)).sum(0) + 10), 0.55, 0.99)  # labelers are taken to be better than chance
            q, z, w = self.posterior(kind, v, strict), np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
            for _ in range(25):  # Newton steps of the penalised logistic fit
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                h = (z * (n * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
                w = w - np.linalg.solve(h, z.T @ (n * (p - q)) + 0.1 * w)
            self.weights[kind] = w
            open_ = strict == 0
            if open_.any():
                score, true, many = self.scores(kind, x[open_]), q[open_], n[open_]
                for t in np.unique(score):  # ascending: the least score from which on enough are true
                    own = score >= t
                    if true[own] @ many[own] >= PRECISE * many[own].sum() and t >= 0.5:
                        self.least[kind] = t - 1e-9
                        break
        return self

    def accepts(self, kind: str, v: tuple[int, ...]) -> bool:
        return bool(self.scores(kind, np.array([v], float))[0] >= self.least[kind])


def learned(docs: DataFrame) -> SpanModel:
    """From the vote patterns of all ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                kept, rest = candidates(text)
                for strict, spans in ((True, kept), (False, rest)):
                    seen.update((s[0], strict, votes(text, s)) for s in spans)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in seen]), pa.array([s for _, s, _ in seen]), pa.array([list(v) for _, _, v in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["kind", "strict", "v", "n"])

    rows = mapped(docs.select("text"), run, "kind string, strict boolean, v array<int>, n bigint").groupBy("kind", "strict", "v").agg(F.sum("n").alias("n")).collect()
    return SpanModel().fit({(r["kind"], r["strict"], tuple(r["v"])): r["n"] for r in rows})


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2]))])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (of all), n_spans (of all)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learned(docs))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SpanModel = model.value
        for b in batches:
            counts, digest, spans, many = [], [], [], []
            for text in b.column(1).to_pylist():
                kept, rest = candidates(text)
                base = _joined(kept)
                counts.append([sum(s[0] == k for s in kept) for k in KINDS])
                digest.append(hashlib.sha256(base.encode()).hexdigest())
                full = kept + [s for s in rest if m.accepts(s[0], votes(text, s))]
                spans.append(_joined(full))
                many.append(len(full))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(n[:, k]) for k in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(many, pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs, run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")
