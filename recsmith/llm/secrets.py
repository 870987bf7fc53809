"""Operator 1: secret scans with a random forest that removes false positives."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import map_texts
from .trees import Forest, fit_forest

#: Labelled findings the forest is fitted on.
FINDINGS = 4_000
#: Names that assignments of secrets use, names of harmless values, and everyday words.
SECRET_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "credential", "bearer")
HARMLESS_NAMES = ("commit", "sha", "sha1", "sha256", "md5", "digest", "checksum", "hash", "uuid", "guid", "version", "isbn", "order", "invoice", "card", "phone", "etag", "revision", "build", "id")
DICTIONARY = (
    "the and that with from this have not are was for you his her they will one all would there what about which when make can like time just him know take people into year your good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most "
    "der die und das ist nicht ein eine mit auf den von des dem sich als auch nach wird bei einer aus les des une est que dans qui par pour sur pas plus avec sont los las una por con para como pero más este entre data file image index page user name test main report final draft config server client module package version release"
).split()

_RUN = re.compile(r"[A-Za-z0-9_+/\-]{12,}={0,2}")
_ASSIGN = re.compile(r"[:=]")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_\-]{1,39})[\"']?[ \t]{0,3}\Z")
_HEAD, _TAIL = re.compile(r"[ \t]{0,3}[\"']?"), re.compile(r"[^\s\"'<>]*")
_SECRET_NAME = re.compile("|".join(map(re.escape, SECRET_NAMES)), re.I)
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
_KEY_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{30,}|glpat-[A-Za-z0-9_\-]{16,}")
_KEY_INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{_KEY_FORMAT.pattern})(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_COVER = re.compile("|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=len, reverse=True)))
_FILE = re.compile(r"\.[a-z]{2,5}\Z|://|www\.|^\.{0,2}/|/[^/]*/")
CONTEXT = 48

FEATURES = (
    "length", "distinct", "entropy", "digits", "upper", "lower", "signs", "transitions", "case_changes", "vowels", "longest_run", "coverage",
    "hex", "number", "dashes", "path", "assigned", "quoted", "secret_name", "harmless_name", "known_format", "after_word",
)


_RANK = {"private_key": 0, "key": 1, "assignment": 2, "string": 3}


def _assigned(text: str) -> list[tuple[int, int, str]]:
    """Values of assignments whose name is a secret's, in one pass over the text.

    Names are looked at first, and a run without white space, quotes or angle brackets
    is walked once, however many assignments stand in it.  A value ends with its run, or
    where the name of the run's next such assignment begins.
    """
    names = [m.end() for m in _SECRET_NAME.finditer(text)] if "=" in text or ":" in text else []
    found, start, end = [], 0, -1
    for m in _ASSIGN.finditer(text) if names else ():
        at = bisect_right(names, m.start())
        if not at or names[at - 1] < m.start() - CONTEXT:
            continue
        near = max(0, m.start() - CONTEXT)
        name = _NAME.search(text[near : m.start()])
        if name and any(s in name[1].lower() for s in SECRET_NAMES):
            value = _HEAD.match(text, m.end()).end()
            if not start <= value <= end:
                start, end = value, _TAIL.match(text, value).end()
            found.append((near + name.start(1), value, end))
    out = []
    for i, (_, value, stop) in enumerate(found):
        cut = i + 1 < len(found) and value <= found[i + 1][0] < stop
        stop = found[i + 1][0] if cut else stop
        if stop - value >= 8 and not text.startswith("//", value):
            while stop > value + 8 and text[stop - 1] in (".,;:!?)]}&" if cut else ".,;:!?)]}"):
                stop -= 1
            out.append((value, stop, "assignment"))
    return out


def _places(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every place worth scoring; places may overlap, each pair of ends comes once."""
    found = [(m.start(), m.end(), "private_key") for m in _PEM.finditer(text)] if "PRIVATE KEY-----" in text else []
    found += _assigned(text)
    for m in _RUN.finditer(text):
        v = m[0]
        if v.islower() and v.isalpha():
            continue
        if any(c in v for c in string.digits):
            found.append((m.start(), m.end(), "key" if _KEY_FORMAT.fullmatch(v) else "string"))
        found += [(m.start() + k.start(), m.start() + k.end(), "key") for k in _KEY_INSIDE.finditer(v)]
    best: dict[tuple[int, int], str] = {}
    for s, e, k in sorted(found, key=lambda x: _RANK[x[2]]):
        best.setdefault((s, e), k)
    return [(s, e, k) for (s, e), k in best.items()]


def _apart(found: list[tuple], taken: list[tuple] = ()) -> list[tuple]:
    """Those of ``found`` that overlap neither ``taken`` nor an earlier one, and ``taken``, in order of place."""
    out, fixed, at, end = [], sorted(taken), 0, 0
    for x in sorted(found, key=lambda x: (x[0], _RANK[x[2]], -x[1])):
        while at < len(fixed) and fixed[at][1] <= x[0]:
            at += 1
        if x[0] >= end and (at == len(fixed) or fixed[at][0] >= x[1]):
            out.append(x)
            end = x[1]
    return sorted([*out, *fixed])


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the places worth scoring, without overlaps, in order of place."""
    return _apart(_places(text))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(before: str, value: str, after: str) -> list[float]:
    """Features of one candidate from itself and the text around it."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    counts = Counter(value)
    runs = longest = 1
    changes = cases = 0
    for a, b in zip(kinds, kinds[1:]):
        changes += a != b
        cases += {a, b} == {1, 2}
        runs = runs + 1 if a == b else 1
        longest = max(longest, runs)
    letters = [c for c in value.lower() if c.isalpha()]
    covered = sum(len(m) for m in _COVER.findall(value.lower()))
    name = _NAME.search(before[:-1].rstrip(" \t\"'=:")[-CONTEXT:] + "") if before else None
    near = [w.lower() for w in re.findall(r"[A-Za-z0-9_\-]+", before)[-3:]]
    glued = before.rstrip(" \t\"'")
    whole = re.search(r"\S*\Z", before)[0] + value + re.match(r"\S*", after)[0]
    return [
        min(n, 400), len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), share[0], share[1], share[2], share[3], changes / n, cases / n,
        sum(c in "aeiouäöüáéíóúèêà" for c in letters) / max(1, len(letters)), longest / n, covered / n,
        float(all(c in string.hexdigits for c in value)), float(value.isdigit()), value.count("-") / n, float(bool(_FILE.search(whole)) and not _KEY_FORMAT.fullmatch(value)),
        float(glued.endswith(("=", ":"))), float(before.endswith(('"', "'"))), float(any(s in w for w in near for s in SECRET_NAMES) or bool(name and any(s in name[1].lower() for s in SECRET_NAMES))),
        float(any(w.strip("-_") in HARMLESS_NAMES for w in near)), float(bool(_KEY_FORMAT.match(value) or value.startswith("-----BEGIN"))), float(bool(_WORD.match(after.lstrip()))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Labelled findings ``(before, value, after, is_secret)``: keys, tokens and passwords against look-alikes."""
    rng = random.Random(seed)
    word = lambda: rng.choice(DICTIONARY)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    prose = lambda k: " ".join(word() for _ in range(k))
    syllables = lambda: "".join(word() for _ in range(rng.randint(3, 6)))

    def secret() -> tuple[str, str]:
        value = rng.choice([
            lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(b62, 36), lambda: "sk_live_" + pick(b62, 24),
            lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(b62, 24), lambda: "AIza" + pick(b62, 35), lambda: "glpat-" + pick(b62, 20),
        ])()
        if rng.random() < 0.4:
            return " ", value
        name = rng.choice(SECRET_NAMES)
        if rng.random() < 0.7:
            value = rng.choice([lambda: pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])), lambda: pick(b62, rng.randint(12, 48)), lambda: pick(b64, rng.randint(20, 64)) + "==", lambda: pick(b62 + "!#%-_", rng.randint(10, 24))])()
        link = rng.choice(["=", " = ", ": ", ' = "', '="', '": "', " "])
        return " " + rng.choice([name, name.upper(), f"my_{name}"]) + link, value

    def harmless() -> tuple[str, str]:
        return rng.choice([
            lambda: (" " + rng.choice(HARMLESS_NAMES) + rng.choice([" ", ": ", "="]), pick(hexa, rng.choice([12, 32, 40, 64]))),
            lambda: (rng.choice([" ", " uuid "]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
            lambda: (" ", pick(string.digits, rng.randint(12, 19))),
            lambda: (" ", syllables() + pick(string.digits, rng.randint(1, 4))),
            lambda: (" ", "-".join([word(), word(), word(), pick(string.digits, 4)])),
            lambda: (" ", "_".join([word(), word(), pick(string.digits, 2), word()])),
            lambda: (rng.choice([" /", " http://", " ./"]), "/".join([word(), word(), pick(string.digits, 4), syllables()])),
            lambda: (" ", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}"),
            lambda: (" ", "".join(word().title() for _ in range(4)) + pick(string.digits, 1)),
            lambda: (" " + rng.choice(SECRET_NAMES) + rng.choice(["=", ": ", " = "]), rng.choice([syllables(), "your-password-here", "changeme-please", "x" * 12, "<" + word() + "-placeholder>", "_".join([word(), word(), word()])])),
            lambda: (" " + word() + "=", base64.b64encode(prose(4).encode()).decode().rstrip("=") + "1"),
            lambda: (" ", syllables().upper() + pick(string.digits, 2)),
        ])()

    out = []
    for i in range(n):
        link, value = secret() if i % 2 else harmless()
        close = link[-1] if link[-1] in "\"'" else ""
        out.append((prose(5) + link, value, close + rng.choice([" ", ". ", "\n", ", "]) + prose(3), i % 2))
    return out


@functools.lru_cache(maxsize=2)
def fit_findings(n: int = FINDINGS, seed: int = 7) -> Forest:
    """Random forest over the features of ``n`` labelled findings."""
    rows = labelled_findings(n, seed)
    return fit_forest(np.array([describe(*r[:3]) for r in rows]), np.array([r[3] for r in rows]), trees=40, depth=9)


def scan(texts: list[str], model: Forest, threshold: float) -> list[list[tuple[int, int, str, float, bool]]]:
    """Scored candidates of each text: ``(start, end, kind, score, kept)``, code points, end exclusive.

    Overlaps are resolved after scoring: a kept candidate beats a rejected one, otherwise
    the earlier start, then the kind, then the longer one.
    """
    places, rows = [], []
    for t in texts:
        mine = _places(t)
        places.append(mine)
        rows += [describe(t[max(0, s - CONTEXT) : s], t[s:e], t[e : e + CONTEXT]) for s, e, _ in mine]
    scores = iter(model.raw(np.array(rows)).tolist() if rows else ())
    scored = [[(s, e, k, p := next(scores), p >= threshold) for s, e, k in mine] for mine in places]
    return [_apart([x for x in mine if not x[4]], _apart([x for x in mine if x[4]])) for mine in scored]


def secret_scan(df: DataFrame, model: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate of every whole text.

    Returns ``doc_id, start, stop, kind, score, kept, value_sha256`` (places in code
    points, ``stop`` exclusive; the value itself is not returned).  ``kept`` candidates
    are secrets, the others are what the forest removed.  Candidates are private key
    blocks, known key formats (also inside a path or after a name, where no letter or
    digit touches them), assigned values of 8 characters or more (up to white space, a
    quote or the next secret's name in the same run), and runs of 12 or more with a digit; shorter ones are not looked at.  One pass, no shuffle.  Null and
    empty texts have no candidates; null and repeated ids and rows are scanned like any;
    an empty table gives no rows; other columns are ignored.
    """

    def run(ids: list, texts: list[str]) -> dict:
        rows = [
            (doc, s, e, k, p, kept, hashlib.sha256(t[s:e].encode()).hexdigest())
            for doc, t, found in zip(ids, texts, scan(texts, model, threshold), strict=True)
            for s, e, k, p, kept in found
        ]
        names = ("doc_id", "start", "stop", "kind", "score", "kept", "value_sha256")
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    return map_texts(df, run, "doc_id bigint, start bigint, stop bigint, kind string, score double, kept boolean, value_sha256 string", id_col, text_col)


def mask_secrets(text: Column, model: Forest, threshold: float = 0.5, mask: str = "[SECRET]") -> Column:
    """The text with every kept secret replaced by ``mask``; null stays null."""
    @F.pandas_udf(StringType())
    def masked(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        out = []
        for given, t, found in zip(texts, whole, scan(whole, model, threshold), strict=True):
            parts, at = [], 0
            for s, e, _, _, kept in found:
                if kept:
                    parts += [t[at:s], mask]
                    at = e
            out.append(None if given is None else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return masked(text)
