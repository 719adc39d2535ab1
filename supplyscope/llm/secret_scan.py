"""Secret scans: three patterns, and sliding-window entropy per character class.

A candidate is a run of at least `WINDOW` characters of a secret alphabet. Inside it every run of a
class (hex digits; base-64) is read with a window of `WINDOW` characters whose Shannon entropy is
kept by counts: one character enters, one leaves, and the sum of c * log2 c changes in two cells.
Windows at or above the class's limit that hold a digit and a letter are joined to spans. A span
that matches the allow-list, or lies inside a span of a pattern, is not reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.llm.common import per_text

WINDOW = 20
#: name, characters, bits for each character from which a window is suspicious
CLASSES = (("hex", "0-9a-fA-F", 2.8), ("base64", "A-Za-z0-9+/_=-", 3.8))
ALLOWED = (r"(?i)example|placeholder|dummy|changeme|redacted", r"(?i)0123456789|abcdefghij|x{6}|lorem", r"^[A-Za-z]+$", r"^[0-9]+$")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scanner(window: int = WINDOW, classes=CLASSES, allowed=ALLOWED):
    """A function of a text that returns (base, added): lists of (start, kind place, end)."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    key = re.compile("passw|secret|token|key", re.IGNORECASE | re.ASCII)
    access, hexes = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
    candidate = re.compile("[A-Za-z0-9+/_=-]{%d,}" % window)
    runs = [(re.compile("[%s]{%d,}" % (chars, window)), limit) for _, chars, limit in classes]
    allow = [re.compile(p) for p in allowed]
    weigh = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    full = log2(window)

    def suspicious(run: str, limit: float) -> list[tuple[int, int]]:
        counts: dict[str, int] = {}
        total, digits, letters, found = 0.0, 0, 0, []
        for k, ch in enumerate(run):
            n = counts.get(ch, 0)
            total += weigh[n + 1] - weigh[n]
            counts[ch] = n + 1
            digits += ch.isdigit()
            letters += ch.isalpha()
            if k >= window:
                old = run[k - window]
                n = counts[old]
                total += weigh[n - 1] - weigh[n]
                counts[old] = n - 1
                digits -= old.isdigit()
                letters -= old.isalpha()
            if k + 1 >= window and digits and letters and full - total / window >= limit:
                first = k + 1 - window
                if found and first <= found[-1][1]:
                    found[-1] = (found[-1][0], k + 1)
                else:
                    found.append((first, k + 1))
        return found

    def scan(text: str) -> tuple[list, list]:
        base = []
        if key.search(text):
            base += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in access.finditer(text)]
        added = []
        for m in candidate.finditer(text):
            at, run = m.start(), m[0]
            # a run of hex digits of 24 lies inside a candidate
            base += [(at + h.start(), 2, at + h.end()) for h in hexes.finditer(run)]
            if any(c.isdigit() for c in run):
                for pattern, limit in runs:
                    for r in pattern.finditer(run):
                        added += [(at + r.start() + a, 3, at + r.start() + b) for a, b in suspicious(r[0], limit)]
        base.sort()
        joined: list[tuple[int, int, int]] = []
        for a, kind, b in sorted(added):
            if joined and a <= joined[-1][2]:
                joined[-1] = (joined[-1][0], kind, max(b, joined[-1][2]))
            else:
                joined.append((a, kind, b))
        free = [s for s in joined if not any(a <= s[0] and s[2] <= b for a, _, b in base) and not any(p.search(text[s[0] : s[2]]) for p in allow)]
        return base, free

    return scan


def joined_text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) in code points, by start, then kind.

    A row for each row of `docs`. Null and empty texts have no span.
    """

    def make():
        scan = scanner(**limits)

        def of(text: bytes):
            base, added = scan(text.decode("utf-8", "replace"))
            name = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
            return name(base), name(sorted(base + added))

        return of

    return per_text(docs, id_col, text_col, [("base", SPAN), ("spans", SPAN)], make)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **limits) -> DataFrame:
    """`docs` with every span replaced by `mark`; other columns as they are, null texts stay null."""
    import pandas as pd

    def clean(batches):
        scan = scanner(**limits)
        for texts in batches:
            out = []
            for text in texts:
                if text:
                    base, added = scan(text)
                    parts, end = [], 0
                    for a, _, b in sorted(base + added):
                        if b > end:
                            parts += [text[end : max(a, end)], mark] if a >= end else []
                            end = b
                    text = "".join(parts) + text[end:]
                out.append(text)
            yield pd.Series(out, dtype=object)

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))


def op4_secrets(spark, sf_dir):
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(texts("base"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], digest, texts("spans").alias("spans"))
