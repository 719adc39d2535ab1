r"""Personal data: four patterns, and a semi-Markov conditional random field.

The field reads the stretches of a text that hold a digit, an at-sign or a spelled-out one. A stretch
is cut into tokens; every span of at most `LONGEST` tokens, and every whole spelled-out address of any
length, is a candidate for each type. Features are
those of a whole span (shape, number of digits, check sum, domain, borders, word before it), so
borders and types are chosen together by dynamic programming over (end of span, type). What the
patterns find stays; spans of the field that touch none of it are added.

Weights start from a prior and are fitted by gradient steps on the likelihood of at most
`TRAIN_STRETCHES` stretches of the corpus, labelled by the patterns and, for variants in which the
plus sign is left out or the at-sign spelled out, by construction. Every document is then scored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.llm.common import per_text

KINDS = ("email", "ip", "card", "phone")
LONGEST, TRAIN_STRETCHES, STEPS, RATE, PULL = 16, 200, 20, 0.5, 0.02
#: features in order, with the prior weight for email, ip, card, phone
FEATURES = (
    ("always", (-4.0, -4.0, -4.0, -4.0)),
    ("address", (9.0, -4.0, -4.0, -4.0)),
    ("spelled address", (8.0, -4.0, -4.0, -4.0)),
    ("four parts up to 255", (-4.0, 9.0, -4.0, -4.0)),
    ("13 to 19 digits", (-1.0, -1.0, 1.0, -4.0)),
    ("check sum holds", (-1.0, -1.0, 6.0, -2.0)),
    ("four by four", (-1.0, -1.0, 1.5, -2.0)),
    ("plus and 9 to 15 digits", (-4.0, -4.0, -4.0, 8.0)),
    ("three three four", (-4.0, -4.0, -4.0, 6.0)),
    ("fewer than 9 digits", (0.0, 0.0, -6.0, -6.0)),
    ("letters", (0.0, -6.0, -6.0, -6.0)),
    ("open border", (-3.0, -6.0, -6.0, -6.0)),
    ("edge is no part", (-6.0, -6.0, -6.0, -6.0)),
    ("word before", (2.0, 2.0, 2.0, 2.0)),
)
PRIOR = np.array([w for _, w in FEATURES])
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_STRETCH = re.compile(r"\S*[0-9@]\S*(?: \S*[0-9@]\S*)*|\S+ ?[(\[]at[)\]] ?\S+(?: ?[(\[]dot[)\]] ?\S+)*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")
_THREES = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")
_FOURS = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_CUE = re.compile(r"(?:mail|address|ip|host|card|visa|phone|tel|call|mobile)\W{0,3}$", re.IGNORECASE)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind place, start, end): the patterns' matches, leftmost and without overlap for each kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in _LOCAL:
            first -= 1
        m = _AFTER_AT.match(text, at + 1) if first < at else None
        if m:
            found.append((0, first, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    small = lambda p: len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def span_features(s: str, before: str, after: str) -> list[int]:
    """Places in FEATURES that hold for a span between two stretches of text."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, on = len(digits), [0]
    plain = re.fullmatch(r"[0-9](?:[ -]?[0-9])*", s) is not None
    parts = s.split(".")
    holds = (
        (1, "@" in s and _ADDRESS.fullmatch(s)), (2, "at" in s and _SPELLED.fullmatch(s)),
        (3, len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        (4, plain and 13 <= n <= 19), (5, plain and 13 <= n <= 19 and luhn(digits)), (6, n == 16 and _FOURS.fullmatch(s)),
        (7, s[0] == "+" and 9 <= n <= 15 and _PHONE.fullmatch(s)), (8, n == 10 and _THREES.fullmatch(s)), (9, n < 9),
        (10, any(c.isalpha() for c in s)), (11, before[-1:].isalnum() or after[:1].isalnum()),
        (12, not (s[-1].isalnum() and (s[0].isalnum() or s[0] in "+("))), (13, _CUE.search(before)),
    )
    return on + [k for k, yes in holds if yes]


def spelled_ends(stretch: str, borders: list[int]) -> dict[int, int]:
    """For each token that starts a spelled-out address, the token place where the longest one ends."""
    if "(at" not in stretch and "[at" not in stretch:
        return {}
    place = {b: k for k, b in enumerate(borders)}
    found = ((i, _SPELLED.match(stretch, b)) for i, b in enumerate(borders[:-1]))
    return {i: place[m.start() + len(m[0].rstrip("-"))] for i, m in found if m}


def candidates(stretch: str, before: str = "", after: str = "") -> tuple[list[int], list[tuple[int, int]], list[list[int]]]:
    """Token borders of a stretch, its candidate spans (token places), and their features."""
    borders = [m.start() for m in _TOKEN.finditer(stretch)] + [len(stretch)]
    spans, rows, n = [], [], len(borders) - 1
    whole = spelled_ends(stretch, borders)
    for i in range(n):
        ends = [*range(i + 1, min(n, i + LONGEST) + 1)]
        if whole.get(i, 0) > i + LONGEST:
            ends.append(whole[i])
        for j in ends:
            a, b = borders[i], borders[j]
            s = stretch[a:b]
            if s[0].isalnum() or s[0] in "+(":
                if s[-1].isalnum():
                    held = span_features(s, before + stretch[:a][-20:], stretch[b : b + 1] or after)
                    spans.append((i, j))
                    rows.append([k for k in held if k != 2 or whole.get(i) == j])  # a piece of an address is none
    return borders, spans, rows


def scores_of(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[r].sum(axis=0) for r in rows]).reshape(len(rows), len(KINDS))


def best_spans(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The highest-scoring set of spans (kind, i, j) without overlap; a token outside scores 0."""
    by_end: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(spans):
        by_end.setdefault(j, []).append(k)
    kind, top = (scores.argmax(axis=1), scores.max(axis=1)) if len(spans) else ((), ())
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            if best[spans[k][0]] + top[k] > best[j]:
                best[j], back[j] = best[spans[k][0]] + top[k], k
    out, j = [], n
    while j > 0:
        k = back[j]
        if k < 0:
            j -= 1
        else:
            out.append((int(kind[k]), *spans[k]))
            j = spans[k][0]
    return out[::-1]


def expected(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each (span, kind) under the field, by the forward and backward sums."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    total = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + total[k] for k, (i, e) in enumerate(spans) if e == j)])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[e] + total[k] for k, (b, e) in enumerate(spans) if b == i)])
    outer = np.array([ahead[i] + behind[j] for i, j in spans]) - ahead[n]
    return np.exp(scores + outer[:, None]) if len(spans) else scores


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray:
    """Weights near the prior that make the labelled spans (kind, start, end) of the stretches likely."""
    made = []
    for stretch, labels in examples:
        borders, spans, rows = candidates(stretch)
        place = {b: k for k, b in enumerate(borders)}
        index = {s: k for k, s in enumerate(spans)}
        gold = [(index.get((place.get(a), place.get(b))), kind) for kind, a, b in labels]
        if len(borders) < 80 and all(k is not None for k, _ in gold):
            x = np.zeros((len(rows), len(FEATURES)))
            for k, r in enumerate(rows):
                x[k, r] = 1
            y = np.zeros((len(rows), len(KINDS)))
            for k, kind in gold:
                y[k, kind] = 1
            made.append((len(borders) - 1, spans, x, y))
    weights = PRIOR.copy()
    for step in range(STEPS if made else 0):
        slope = sum(x.T @ (y - expected(n, spans, x @ weights)) for n, spans, x, y in made) / len(made)
        weights += RATE * (slope - PULL * (weights - PRIOR))
    return weights


def _variants(stretch: str, kind: int, a: int, b: int) -> tuple[str, list[tuple[int, int, int]]] | None:
    found = stretch[a:b]
    if kind == 0:
        return (s := re.sub(r"\.", " (dot) ", found[: found.rindex("@")].replace(".", "") + " (at) " + found[found.rindex("@") + 1 :])), [(0, 0, len(s))]
    if kind == 3 and (m := _THREES.search(found)):
        return m[0], [(3, 0, len(m[0]))]
    return None


def train(docs: DataFrame, text_col: str, limit: int = TRAIN_STRETCHES) -> np.ndarray:
    def make():
        def of(text: bytes):
            text, out = text.decode("utf-8", "replace"), []
            base = base_spans(text) if re.search("[0-9@]", text) else []
            for m in _STRETCH.finditer(text) if base else ():
                own = sorted((a - m.start(), b - m.start(), kind) for kind, a, b in base if m.start() <= a and b <= m.end())
                clash = any(x[1] > y[0] for x, y in zip(own, own[1:]))
                if own and not clash and len(m[0]) <= 120:
                    out.append((m[0], [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in own]))
            return out

        return of

    some = docs.select(F.lit(0).alias("one"), F.col(text_col)).where(F.col(text_col).rlike("[0-9@]"))
    found = per_text(some, "one", text_col, [("stretch", T.StringType()), ("labels", SPAN)], make, many=True)
    examples = []
    for r in found.orderBy(F.xxhash64("stretch"), "stretch").limit(limit).select("stretch", "labels").collect():
        labels = [(KINDS.index(x["kind"]), x["start"], x["end"]) for x in r["labels"]]
        examples.append((r["stretch"], labels))
        examples += [v for x in labels if (v := _variants(r["stretch"], *x))]
    return fit(examples)


def tagger(weights: np.ndarray):
    def tag(text: str) -> tuple[list, list]:
        """(base, added): spans (kind place, start, end)."""
        base = base_spans(text) if re.search("[0-9@]", text) else []
        added = []
        for m in _STRETCH.finditer(text) if base or re.search(r"[0-9]|[(\[]at[)\]]", text) else ():
            for low in range(m.start(), m.end(), 2000):  # a very long stretch is read in overlapping parts
                part = text[low : min(m.end(), low + 2200)]
                if sum(c.isdigit() for c in part) < 4 and "at" not in part and "@" not in part:
                    continue
                before, after = text[max(0, low - 20) : low], text[low + len(part) : low + len(part) + 1]
                borders, spans, rows = candidates(part, before, after)
                for kind, i, j in best_spans(len(borders) - 1, spans, scores_of(rows, weights)):
                    a, b = low + borders[i], low + borders[j]
                    if not any(a < y and x < b for _, x, y in base) and not any(a < y and x < b for _, x, y in added):
                        added.append((kind, a, b))
        return sorted(base), added

    return tag


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) in code points, by kind, then start.

    A row for each row of `docs`. Null and empty texts have no span. Without any labelled stretch
    (an empty table, say) the prior weights are used.
    """
    weights = train(docs, text_col) if weights is None else weights

    def make():
        tag = tagger(weights)
        name = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

        def of(text: bytes):
            base, added = tag(text.decode("utf-8", "replace"))
            return name(base), name(sorted(base + added))

        return of

    return per_text(docs, id_col, text_col, [("base", SPAN), ("spans", SPAN)], make)


def op7_pii(spark, sf_dir):
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(texts("base"), 256).alias("base_sha256"), texts("spans").alias("spans"))
