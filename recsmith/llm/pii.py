"""Operator 4: personal data by fixed base patterns and a semi-Markov conditional random field."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: An entity has at most this many tokens; so the dynamic program is linear in the text.
MAX_TOKENS = 24
#: Made windows the field is trained on.
WINDOWS = 320

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run that fails from its first digit fails from every one
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, done := m.end()))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns, by start and then kind as listed."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 13 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# ---- windows, tokens and candidate segments -------------------------------------------------

_TRIGGER = re.compile(r"[0-9]|@|[(\[]at[)\]]|[ \]\)]dot[ \[\(]|[(\[]dot[)\]]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|\s|.", re.S)
_AT = frozenset({"@", "at"})
_NUMBER_SIGNS = frozenset(" +().-/")
_GAP = re.compile(r"\s")
REACH, MARGIN = 24, 32

_CONTEXT = {
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell", "whatsapp", "telefon", "téléphone", "teléfono", "handy", "dial", "sms"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "cc", "amex"),
    "email": ("mail", "email", "contact", "write", "correo", "courriel", "reach", "kontakt"),
    "ip": ("ip", "host", "server", "addr", "address", "gateway", "dns", "ping"),
    "other": ("version", "release", "isbn", "order", "invoice", "id", "no", "build", "page", "date", "total", "ref", "number", "serial", "license", "public"),
}


class Window(NamedTuple):
    """Tokens of a stretch of text (``cuts`` are their places) and candidate segments ``(i, j)`` with features."""

    start: int
    cuts: list[int]
    segments: list[tuple[int, int]]
    x: np.ndarray


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs that could hold an entity, widened to white space."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= REACH:
            out[-1][1] = m.end()
            out[-1][2] += m[0].isdigit()
            out[-1][3] |= not m[0].isdigit()
        else:
            out.append([m.start(), m.end(), int(m[0].isdigit()), not m[0].isdigit()])
    got = []
    for s, e, digits, marked in out:
        if marked or digits >= 7:
            s, e = max(0, s - MARGIN), min(len(text), e + MARGIN)
            done = got[-1][1] if got else 0
            while s > done and not text[s - 1].isspace():
                s -= 1
            if e <= done:  # the run before was widened over this place already
                e = done
            elif gap := _GAP.search(text, e):
                e = gap.start()
            else:
                e = len(text)
            if got and s <= got[-1][1]:
                got[-1] = (got[-1][0], e)
            else:
                got.append((s, e))
    return got


def _candidates(tokens: list[str]) -> list[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    n = len(tokens)
    for i, t in enumerate(tokens):
        if (t.isdigit() or t in "+(") and not (i and tokens[i - 1].isdigit()):
            digits = 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                u = tokens[j]
                if u.isascii() and u.isdigit():
                    digits += len(u)
                    if 7 <= digits <= 20:
                        found.add((i, j + 1))
                elif u.strip() and u not in _NUMBER_SIGNS:
                    break
        if t in _AT and (t == "@" or (i and i + 1 < n)):
            starts, ends = [], []
            lo = i - 1
            while lo >= 0 and (tokens[lo] in "([" or tokens[lo] == " "):
                lo -= 1
            for k in range(lo, max(-1, i - MAX_TOKENS // 2), -1):
                if tokens[k][0].isalnum():
                    starts.append(k)
                elif tokens[k] not in "._%+-":
                    break
            dotted = False
            for k in range(i + 1, min(n, i + MAX_TOKENS // 2)):
                u = tokens[k]
                if u in (".", "dot"):
                    dotted = True
                elif u[0].isalnum():
                    if dotted:
                        ends.append(k + 1)
                    if k + 2 < n and tokens[k + 1] == " " and tokens[k + 2] not in ("dot", "(", "["):
                        break
                elif u not in ("-", " ", "(", ")", "[", "]"):
                    break
            found.update((a, b) for a in starts for b in ends)
    return sorted(found)


def _features(text: str, s: int, e: int) -> list[float]:
    v = text[s:e]
    d = _digits(v)
    n = len(d)
    groups = [len(g) for g in re.findall("[0-9]+", v)]
    before, after = text[s - 1 : s], text[e : e + 1]
    near = re.findall(r"[^\W\d_]+", text[max(0, s - 40) : s].lower())[-3:]
    number = not any(c.isalpha() for c in v)
    follows = after in "-./" and text[e + 1 : e + 2].isdigit() if after else False
    leads = before in "-./+" and (before == "+" or text[s - 2 : s - 1].isdigit()) if before else False
    dotted = bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", v))
    mail = re.fullmatch(r"[\w.%+-]+( ?[(\[]?at[)\]]? ?|@)[\w-]+(( ?[(\[]?dot[)\]]? ?|\.)[\w-]+)+", v)
    return [
        1.0, float(number), n / 10, float(10 <= n <= 15), float(14 <= n <= 19), float(n == 16), float(n > 15), float(n < 9),
        float(number and 14 <= n <= 19 and luhn(d)), float(dotted and _octets(v)), float(v.count(".") > 3), float(v.startswith("+")), float(v.startswith("(") and ")" in v),
        float(v.count("(") != v.count(")")), float(groups == [4, 4, 4, 4]), float(groups[-3:] == [3, 3, 4]), float(len(groups) == 1), float(len(groups) > 6),
        float("  " in v or "--" in v or ".." in v), float("@" in v), float(mail is not None), float(bool(mail) and "@" not in v), float(bool(re.search(r"(\.|dot[)\]]? ?)[a-z]{2,6}\Z", v))),
        float(before.isalnum() or leads), float(after.isalnum() or follows), float(bool(re.match(r"\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4}", v))), float("/" in v),
        *(float(any(w in _CONTEXT[k] for w in near)) for k in (*KINDS, "other")),
        float(len(set(d)) < 3), float(any(g > 8 for g in groups) and len(groups) > 1),
    ]


def window(text: str, start: int, end: int) -> Window | None:
    part = text[start:end]
    cuts, tokens = [start], []
    for m in _TOKEN.finditer(part):
        tokens.append(m[0])
        cuts.append(start + m.end())
    found = _candidates(tokens)
    if not found:
        return None
    return Window(start, cuts, found, np.array([_features(text, cuts[i], cuts[j]) for i, j in found]))


# ---- the field --------------------------------------------------------------------------------


def _scores(w: Window, weights: np.ndarray) -> np.ndarray:
    """Score of each candidate segment as each kind; a token outside entities scores zero."""
    return w.x @ weights


def _lattice(w: Window, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition function and the probability of each segment as each kind."""
    n = len(w.cuts) - 1
    total = np.logaddexp.reduce(scores, axis=1)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(w.segments):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[w.segments[k][0]] + total[k] for k in ending[j])]) if j in ending else alpha[j - 1]
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(total[k] + beta[w.segments[k][1]] for k in starting[i])]) if i in starting else beta[i + 1]
    through = np.array([alpha[i] + total[k] + beta[j] for k, (i, j) in enumerate(w.segments)])
    return alpha[n], np.exp(through - alpha[n])[:, None] * np.exp(scores - total[:, None])


def decode(w: Window, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Best segmentation: boundaries and kinds chosen together by dynamic programming."""
    scores = _scores(w, weights)
    kind, value = scores.argmax(axis=1), scores.max(axis=1)
    n = len(w.cuts) - 1
    best, via = [0.0] * (n + 1), [-1] * (n + 1)
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(w.segments):
        ending.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            if (total := best[w.segments[k][0]] + value[k]) > best[j]:
                best[j], via[j] = total, k
    out, j = [], n
    while j > 0:
        if via[j] < 0:
            j -= 1
        else:
            i, end = w.segments[via[j]]
            out.append((KINDS[kind[via[j]]], w.cuts[i], w.cuts[end]))
            j = i
    return out[::-1]


def training_texts(n: int = WINDOWS, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made texts with their entities: usual and disguised spellings, and look-alikes without any."""
    rng = random.Random(seed)
    words = "the of is and for on that was with by our please see under line from les des und der que la en it to are".split()
    names = "anna jonas marie luis sales info office k.meier paul_w nadia7 team-a".split()
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    lead = lambda: rng.choice("23456789")

    def card(size: int, joint: str) -> str:
        body = rng.choice("3456") + num(size - 2)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return joint.join(body[i : i + 4] for i in range(0, size, 4)) if joint else body

    def entity(kind: str) -> str:
        host, tld, who = rng.choice(["mail", "example", "post.example", "mx2", "web"]), rng.choice(["com", "org", "net", "de", "fr"]), rng.choice(names)
        if kind == "email":
            return rng.choice([f"{who}@{host}.{tld}", f"{who} (at) {host} (dot) {tld}", f"{who}[at]{host}[dot]{tld}", f"{who}(at){host}.{tld}", f"{who} at {host} dot {tld}", f"{who} @ {host}.{tld}"])
        if kind == "ip":
            return ".".join(str(rng.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return card(rng.choice([14, 15, 16, 16, 16]), rng.choice(["", " ", "-", "."]))
        area, mid, last = lead() + num(2), lead() + num(2), num(4)
        return rng.choice([f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+49 {area} {num(7)}", f"00{rng.randint(30, 49)} {area} {mid} {last}", f"+33 {lead()} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)}/{num(7)}"])

    def other() -> str:
        return rng.choice([
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", lambda: "id " + num(rng.choice([7, 9, 11, 13])),
            lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"order {num(4)}-{num(6)}", lambda: "isbn 978-" + num(1) + "-" + num(5) + "-" + num(3) + "-" + num(1), lambda: num(rng.choice([16, 17, 20])),
            lambda: f"{num(4)} {num(4)} {num(5)}", lambda: f"@{rng.choice(names)}", lambda: "look at the dot on page 7", lambda: f"{num(2)}/{num(2)}/{num(4)} {num(2)}:{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(2)}",
            lambda: f"{num(3)} {num(3)} {num(3)} {num(3)}", lambda: "ref " + num(10), lambda: f"{num(5)}-{num(4)}", lambda: f"chapter {num(1)} {num(4)} to {num(4)}",
        ])()

    hint = {"phone": ["", "", "tel ", "call ", "phone: "], "card": ["", "", "card ", "visa "], "email": ["", "mail ", "contact "], "ip": ["", "host "]}
    out = []
    for i in range(n):
        text, spans = " ".join(rng.choices(words, k=4)) + " ", []
        for _ in range(rng.randint(1, 2)):
            if (i + len(spans)) % 5 < 3:
                kind = rng.choice(KINDS)
                text += rng.choice(hint[kind])
                value = entity(kind)
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = other()
            text += value + rng.choice([" ", ", ", ". ", " | "]) + " ".join(rng.choices(words, k=rng.randint(2, 6))) + " "
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def fit_field(n: int = WINDOWS, epochs: int = 25, seed: int = 11) -> np.ndarray:
    """Weights (features x kinds) by stochastic gradients of the log-likelihood (Adagrad, small ridge)."""
    data = []
    for text, spans in training_texts(n, seed):
        if (w := window(text, 0, len(text))) is not None:
            gold = np.zeros((len(w.segments), len(KINDS)))
            places = {(w.cuts[i], w.cuts[j]): k for k, (i, j) in enumerate(w.segments)}
            for kind, s, e in spans:
                if (s, e) in places:
                    gold[places[s, e], KINDS.index(kind)] = 1
            data.append((w, gold))
    weights = np.zeros((data[0][0].x.shape[1], len(KINDS)))
    weights[0] = -2.0
    seen = np.full_like(weights, 1e-6)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for w, gold in data:
            _, share = _lattice(w, _scores(w, weights))
            grad = w.x.T @ (gold - share) - 1e-3 * weights
            seen += grad**2
            weights += 0.4 * grad / np.sqrt(seen)
    return weights


def all_spans(text: str, weights: np.ndarray, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Base spans and, where they do not overlap one, the field's."""
    base = base_spans(text) if base is None else base
    # base spans as disjoint stretches in order: whether one meets a place is a binary search
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def meets_base(s: int, e: int) -> bool:
        at = bisect_left(starts, e)
        return bool(at) and ends[at - 1] > s

    added = []
    for s, e in stretches(text):
        if (w := window(text, s, e)) is not None:
            added += [x for x in decode(w, weights) if not meets_base(x[1], x[2])]
    return sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if added else base


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns ``doc_id``, the counts of base spans by kind (``n_email, n_ip, n_card,
    n_phone``), ``base_sha256`` of the base spans and ``spans``, all spans as
    ``kind:start:end`` (code points, end exclusive) by start, then kind, comma-joined.
    One pass, no shuffle.  Null and empty texts have no spans; null and repeated ids and
    rows each give a row; an empty table gives no rows; other columns are ignored.
    """

    def run(ids: list, texts: list[str]) -> dict:
        base = [base_spans(t) for t in texts]
        out: dict = {"doc_id": ids}
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(b[0] == kind for b in found) for found in base]
        out["base_sha256"] = [hashlib.sha256(_join(b).encode()).hexdigest() for b in base]
        out["spans"] = [_join(all_spans(t, weights, b)) for t, b in zip(texts, base, strict=True)]
        return out

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(df, run, schema, id_col, text_col)


def mask_personal_data(text: Column, weights: np.ndarray) -> Column:
    """The text with every span replaced by its kind in brackets (overlapping spans as one); null stays null."""
    def masked(t: str) -> str:
        out, done = [], 0
        for kind, s, e in all_spans(t, weights):
            if s >= done:
                out += [t[done:s], f"[{kind.upper()}]"]
            done = max(done, e)
        return "".join([*out, t[done:]])

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t) for t in texts], dtype=object)

    return run(text)
