"""Personal data by weak supervision.

Four base kinds have exact rules (see ``base_spans``). Beyond them, loose patterns propose
candidate spans: assigned values, key-like tokens, chains of digits, spelt-out addresses, names
after a title or beginning with a frequent given name; a span is as long as its pattern goes on. Labelers built on regular expressions, gazetteers and context vote on each candidate for,
against or not at all. Expectation-maximisation over the counts of all vote patterns estimates
how reliable each labeler is and so how likely each pattern is personal data. With these soft
labels a logistic classifier over a span's shape and context is trained, and its verdict, not the
votes, decides which candidates are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import hash_sample, materialise, text_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates, after the base kinds in a list of spans.
ADDED = ("secret", "number", "address", "name")
#: Bound on the candidates the classifier is trained on, and the number of its weights.
FIT_ROWS, WEIGHTS = 20_000, 4096

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, leftmost non-overlapping per kind, in linear time.

    email: a run of local characters, @, a dotted domain. Only the whole run before an @ can
    match, so it is found from the @. ip: only the start of a run of digits can begin a match.
    card: 16 to 19 digits that pass Luhn. phone: + and 8 to 15 digits. What fails is dropped.
    """
    found = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            s = m.start()
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                found.append((0, s, m.end()))
                done = m.end()
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) < 4 and int(x or "0") <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


_SECRET_CUE = r"password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth|credential"
_ASSIGNED = re.compile(rf"(?i)(?<![A-Za-z])(?:(?:{_SECRET_CUE}|login|user(?:name)?|pin|ssn|iban|passport|account)\s{{0,2}}[=:]\s{{0,2}}|(?:{_SECRET_CUE})\s{{1,2}}(?:is|was)\s{{1,2}})[\"']?([^\s\"']{{4,}})")
#: What a text must have, in lower case, for an assigned value to be looked for.
_CUES = ("pass", "pwd", "token", "secret", "key", "auth", "credential", "login", "user", "pin", "ssn", "iban", "account")
_CHAIN = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .()/-]{0,2}[0-9]){5,}(?![0-9A-Za-z])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+ ?(?:\[at\]|\(at\)|<at>| at ) ?[A-Za-z0-9-]+ ?(?:\[dot\]|\(dot\)|<dot>| dot ) ?[A-Za-z]{2,}")
_TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][^\W\d_]+(?: [A-Z][^\W\d_]+)*")
_CAPITALS = re.compile(r"(?<![^\W\d_])([A-Z][^\W\d_]+)(?: [A-Z][^\W\d_]+)+")
_KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/")
_KNOWN_KEY = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{20,}$|sk-[A-Za-z0-9-]{16,}$|[0-9a-f]{32,64}$|eyJ[A-Za-z0-9_-]{16,}")
_ID_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}$|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|0[0-9]{1,4}[ /-][0-9]{5,}$")
_PLAIN = re.compile(r"[0-9]{1,5}$|[0-9]+[.,][0-9]+$|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}$|[0-9]+(?: [0-9]{1,5}){3,}$")
_BEFORE_SECRET = re.compile(rf"(?i)(?:{_SECRET_CUE})\s{{0,2}}[=:]\s{{0,2}}[\"']?$")
#: Fixed words: contact fields, words that make a number harmless, frequent given names.
CONTACT = frozenset("phone tel telephone mobile cell call fax mail email address born birthday dob ssn passport iban account telefon tél téléphone correo teléfono".split())
HARMLESS = frozenset("version license licence chapter section figure fig page vol volume no number table step line item year release by-nc".split())
NAMES = frozenset(
    "james john robert michael mary linda david william richard thomas charles daniel matthew anthony mark paul steven andrew kenneth joshua kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory "
    "patricia jennifer elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela "
    "maria anna peter hans klaus jürgen wolfgang uwe stefan andreas christian martin karl emma sophie petra sabine monika ursula jean pierre marie jacques michel philippe nathalie isabelle françoise claude "
    "jose carlos juan ana luis miguel antonio manuel javier francisco carmen isabel lucía pablo sofia elena andrea".split()
)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidate spans, at most one per place, the longest."""
    found = []
    low = text.lower()
    if any(c in low for c in _CUES):
        found += [(0, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    at = 0
    if _DIGIT.search(text) is not None:
        while (m := _DIGIT.search(text, at)) is not None:
            s = e = m.start()
            while s > at and text[s - 1] in _KEY:
                s -= 1
            while e < len(text) and text[e] in _KEY:
                e += 1
            if e - s >= 12 and any(c.isalpha() for c in text[s:e]):
                found.append((0, s, e))
            at = max(e, m.end())
        found += [(1, *m.span()) for m in _CHAIN.finditer(text)]
    if "dot" in text:
        found += [(2, *m.span()) for m in _SPELT.finditer(text)]
    if "M" in text or "Dr" in text or "Prof" in text or "Herr" in text or "Frau" in text or "Señor" in text:
        found += [(3, *m.span()) for m in _TITLED.finditer(text)]
    found += [(3, *m.span()) for m in _CAPITALS.finditer(text) if m[1].lower() in NAMES]
    return apart(found, [])


def apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest first, without those that overlap one already taken or one of ``others``."""
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(others, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))
    out = []
    for k, s, e in sorted(spans, key=lambda x: (x[1] - x[2], x[1], x[0])):
        at = bisect_left(taken, (e,))  # those from here on begin at e or later
        if not at or taken[at - 1][1] <= s:
            out.append((k, s, e))
            taken.insert(at, (s, e))
    return sorted(out)


def votes(text: str, kind: int, s: int, e: int) -> list[int]:
    """1 for, -1 against, 0 abstains: regular expressions, then gazetteers, then context."""
    value, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 1]
    words = [w.strip(".,:;=\"'()").lower() for w in before.split()[-3:]]
    mixed = any(c.isalpha() for c in value) and any(c.isdigit() for c in value)
    return [
        1 if _KNOWN_KEY.match(value) else 0,
        1 if _ID_SHAPE.match(value) or kind == 2 else 0,
        -1 if _PLAIN.match(value) else 0,
        (1 if entropy(value) > 3 else 0) if mixed and e - s >= 12 else -1 if kind == 0 and value.isalpha() and len(value) < 8 else 0,
        1 if any(w in CONTACT for w in words) else 0,
        -1 if any(w in HARMLESS for w in words) else 0,
        (1 if any(w.lower() in NAMES for w in value.split()) else 0) if kind == 3 else 0,
        1 if _BEFORE_SECRET.search(before) else 0,
        1 if before[-1:] in "\"'" and before and after in "\"'" and after else 0,
        -1 if kind == 1 and before[-1:].isalnum() else 0,
    ]


def shape_features(text: str, kind: int, s: int, e: int) -> list[int]:
    """Hashed features of a span: character trigrams of its shape, its length, words before it."""
    value = text[s:e]
    shape = "^" + "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value) + "$"
    words = [w.strip(".,;\"'()").lower() for w in text[max(0, s - 40) : s].split()[-2:]]
    names = {f"t{shape[i : i + 3]}" for i in range(len(shape) - 2)} | {f"k{kind}", f"l{min(8, (e - s) // 4)}", f"k{kind}l{min(8, (e - s) // 4)}", f"h{int(entropy(text[s:e]))}"} | {f"w{w}" for w in words if w in CONTACT or w in HARMLESS or "=" in w or w in ("token", "password", "secret")}
    return sorted({xxhash.xxh32_intdigest(n) % WEIGHTS for n in names})


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """patterns: one row of votes (-1, 0, 1) per pattern; counts: candidates with it. Returns the
    share of personal data, the probability of each vote given personal data or not (2, labelers,
    3), and each pattern's probability of being personal data. Starts from the majority of votes."""
    p = np.clip(0.5 + 0.35 * np.sign(patterns.sum(1)), 0.05, 0.95)
    given = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for y, w in enumerate((counts * (1 - p), counts * p)):
            for v in (-1, 0, 1):
                # A labeler is believed to be more often right than wrong: one such vote up front.
                given[y, :, v + 1] = ((patterns == v) * w[:, None]).sum(0) + (1.0 if v == 0 or (v > 0) == bool(y) else 0.1)
            given[y] /= given[y].sum(1, keepdims=True)
        prior = np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99)
        logs = np.log(given)[:, np.arange(patterns.shape[1])[None, :], patterns + 1].sum(2)
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -50, 50)))
        done, p = np.abs(new - p).max() < 1e-6, new
        if done:
            break
    return float(prior), given, p


def train(features: list[list[int]], soft: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) by Adam on soft labels."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.array([c for f in features for c in f], np.int64)
    w, m, v = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(features)) + w[-1], -30, 30)))
        err = (p - soft) / len(features)
        g = np.append(np.bincount(cols, err[rows], WEIGHTS), err.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


_SPAN = "array<struct<kind:int,start:int,end:int>>"
_CANDIDATE = "array<struct<kind:int,start:int,end:int,votes:array<int>,features:array<int>>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, more = [], []
        for t in b.column("text"):
            text = t.as_py()
            spans = base_spans(text)
            base.append([dict(kind=k, start=s, end=e) for k, s, e in sorted(spans)])
            free = apart(candidates(text), spans)
            more.append([dict(kind=k, start=s, end=e, votes=votes(text, k, s, e), features=shape_features(text, k, s, e)) for k, s, e in free])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, _SPAN_TYPE), pa.array(more, _CANDIDATE_TYPE)], ["doc_id", "base", "candidates"])


def _listed(spans: list[dict], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[x['kind']]}:{x['start']}:{x['end']}" for x in spans)


def find(df: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the
    numbers of added spans: n_secret, n_number, n_address, n_name, and of all: n_spans.

    spans lists base spans by kind and start, then added ones (``ADDED``), which never overlap a
    base span. Null text counts as empty and has no spans; null ids and repeated rows are rows
    like any other; an empty table gives no rows. EM counts the vote patterns of all candidates;
    the classifier is trained on at most ``fit_rows`` of them, picked by hash.
    """
    text_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    found = materialise(rows.mapInArrow(_propose, f"doc_id {kind}, base {_SPAN}, candidates {_CANDIDATE}"), "spans")
    each = found.select("doc_id", F.explode("candidates").alias("c"))
    counted = each.groupBy("c.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    weights = np.append(np.zeros(WEIGHTS), -1.0)
    if counted:
        patterns, counts = np.array([r.votes for r in counted]), np.array([r.n for r in counted], float)
        soft = dict(zip(map(tuple, patterns.tolist()), reliabilities(patterns, counts)[2]))
        sample = hash_sample(each.select("doc_id", "c.*"), ["doc_id", "start", "end"], fit_rows).select("votes", "features").collect()
        weights = train([r.features for r in sample], np.array([soft[tuple(r.votes)] for r in sample]))
    held = df.sparkSession.sparkContext.broadcast(weights)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            out = []
            for base, more in zip(b.column("base").to_pylist(), b.column("candidates").to_pylist()):
                extra = [c for c in more if w[c["features"]].sum() + w[-1] > 0]
                said = _listed(base, KINDS)
                n, m = Counter(x["kind"] for x in base), Counter(x["kind"] for x in extra)
                every = ",".join(x for x in (said, _listed(extra, ADDED)) if x)
                out.append((*(n[k] for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), every, *(m[k] for k in range(4)), len(base) + len(extra)))
            types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.int64(),) * 5
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(f"n_{k}" for k in ADDED), "n_spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types))], names)

    counts, more = (", ".join(f"n_{k} long" for k in kinds) for kinds in (KINDS, ADDED))
    return found.mapInArrow(decide, f"doc_id {kind}, {counts}, base_sha256 string, spans string, {more}, n_spans long")
