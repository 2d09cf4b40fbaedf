"""Personal data (operator 9): patterns, and a semi-Markov conditional random field for what they miss.

The patterns find each kind alone, leftmost and without retries, so neighbours that run together (two card numbers, a
phone number before an address) fail as one. The model looks at the regions that may hold such things, see `semicrf`;
its spans are added where they touch no span of a pattern and an exact check agrees. No shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import field
from gridspark.llm.semicrf import ATS, HINTS, KINDS, Field, Region, ip_parts, last_word, local_start, luhn, plausible, trained

Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that is not followed by three more is followed by none of them from any place inside it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}[0-9]")
MARKS = re.compile(r" at |\[at\] ?|\(at\) ?", re.I)
TAIL = re.compile(r"[A-Za-z0-9-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?| dot |\.)[A-Za-z0-9-]++){1,5}+", re.I)
DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = local_start(text, at, done)
        d = DOMAIN.match(text, at) if start < at else None
        if d:
            yield "email", start, d.end()
            done = d.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if ip_parts(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Where the model looks: runs of digits and separators with 7 digits or more, and written-out addresses."""
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if len(DIGIT.findall(m[0])) >= 7:
                yield m.span()
    low = text.lower()
    if " at " in low or "[at]" in low or "(at)" in low:
        done = 0
        for m in MARKS.finditer(text):
            at = m.start() - (m.start() > done and text[m.start() - 1] == " ")
            start = local_start(text, at, done)
            tail = TAIL.match(text, m.end()) if start < at else None
            if tail:
                yield start, tail.end()
                done = tail.end()


def all_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """The spans of base and those that the model adds.

    A number is only added where all digits of its region belong to some span, or the word before it names its kind: a
    piece of a row of numbers is no entity."""
    out, taken, at = list(base), sorted((s, e) for _, s, e in base), 0
    longest = max((e - s for s, e in taken), default=0)
    for s, e in sorted(regions(text)):
        while at < len(taken) and taken[at][0] < s - longest:
            at += 1
        inside = []
        for x in islice(taken, at, None):
            if x[0] >= e:
                break
            if x[1] > s:
                inside.append((x[0] - s, x[1] - s))
        if any(x[0] <= 0 and x[1] >= e - s for x in inside):
            continue
        region = Region(text[s:e], last_word(text, s))
        spans = apart(region.spans(), inside)
        hinted = lambda kind, a, region=region: HINTS.get(region.hint(a)) == kind
        address = bool(ATS.search(region.text))
        if not spans or not address and not any(hinted(k, a) for a, _ in spans for k in KINDS) and not covered(region.text, spans + inside):
            continue
        got = []
        for kind, a, b in model.best(region, spans):
            glued = text[s + a - 1 : s + a].isalnum() and s + a > 0 or text[s + b : s + b + 1].isalnum() or text[s + b : s + b + 1] in ("@", "_")
            if not glued and plausible(kind, region.text[a:b], hinted(kind, a)):
                got.append((kind, a, b))
        if not address and not covered(region.text, [(a, b) for _, a, b in got] + inside):
            got = [x for x in got if hinted(x[0], x[1])]
        out += [(kind, a + s, b + s) for kind, a, b in got]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def apart(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that touch none of the others, both in order of their starts."""
    out, ends = [], [e for _, e in others]
    reach = list(accumulate(ends, max))
    starts = [s for s, _ in others]
    for s, e in spans:
        k = bisect_left(starts, e)  # those that begin before e
        if not k or reach[k - 1] <= s:
            out.append((s, e))
    return out


def covered(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether all digits stand in spans."""
    at = 0
    for s, e in sorted(spans):
        if s > at and DIGIT.search(text, at, s):
            return False
        at = max(at, e)
    return not DIGIT.search(text, at)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base and spans (both array of (kind, start, end), code points, end exclusive).

    A null or empty text has no spans; null ids stay, repeated rows are searched each, an empty table gives no rows,
    other columns are not read. Of spans with one start the order is that of the kinds: email, ip, card, phone."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        row = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for b in batches:
            base, more = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base.append(base_spans(text))
                more.append(all_spans(text, base[-1], model))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(row, base), kind), pa.array(map(row, more), kind)], ["id", "base", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("base", spans), T.StructField("spans", spans)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(found, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, of the first's kind."""

    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                done, at = [], 0
                for k, s, e in all_spans(text, base_spans(text), model):
                    if s >= at:
                        done += [text[at:s], f"<{k}>"]
                    at = max(at, e)
                out.append("".join([*done, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    schema = T.StructType([field(docs, id_col, "id"), T.StructField("text", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cleaned, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
