"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns find emails, addresses, cards and phones; these spans stay as they are and are the seeds. Lexical patterns
are the one or two words that stand before an entity, and the word before together with the word behind. Identifier-shaped strings that the fixed patterns do not accept
(numbers with separators, words with an at sign or its spelled form) are instances yet unknown. Patterns and instances
form a bipartite graph which Spark scores in rounds: a pattern's confidence for a kind is the smoothed share of seeds and believed
instances among all that it holds, where an unknown one weighs `doubt`. An instance is believed once a confident pattern other than
the one that is scored holds it; so found instances bring in patterns of their own, and a common word is not made sure by what stands
behind it alone. A pattern counts once it has `support` seeds and believed instances; rounds end when no pattern is added.
Confident patterns give their kind to the unknown instances behind them whose
shape allows it; the same string behind another context is judged by that one.

Null and empty texts have no spans. Offsets are code points, ends exclusive. A repeated row gives a repeated result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import column, positional, stored

#: Names a row of the stored table.
ROW = "__row"
KINDS = ("email", "ip", "card", "phone")
# Emails are found from their at signs, so that long words are not scanned again from each of their letters.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that fails from a number's first digit fails from its others.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What might be an identifier: a number with separators, or a word with an at sign or its spelled form.
UNKNOWN_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){5,}")
UNKNOWN_AT = re.compile(r"@|\(at\)|\[at\]")
UNKNOWN_TAIL = re.compile(r"[A-Za-z0-9.-]*[A-Za-z0-9]")
BEFORE = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = re.compile(r"^\W+|[^\w]+$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, by start, then kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if not _HAS_DIGIT.search(text):
        return found
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_HAS_DIGIT = re.compile("[0-9]")


def _words(part: str) -> list[str]:
    return [w for w in (_TRIM.sub("", x).lower() for x in BEFORE.findall(part)) if w]


def _beside(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to two words before and one behind, in lower case without outer punctuation; what stands on the same line.

    Windows grow until they hold the words whole, however far away these are."""
    line, size = text.rfind("\n", 0, start) + 1, 64
    while True:
        at = max(line, start - size)
        before = _words(text[at:start])
        if at == line or len(before) > 2:  # the first of three may be cut
            break
        size *= 4
    stop, size = text.find("\n", end), 64
    stop = len(text) if stop < 0 else stop
    while True:
        at = min(stop, end + size)
        behind = _words(text[end:at])
        if at == stop or len(behind) > 1:
            break
        size *= 4
    return before[-2:], behind[:1]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The word before, the two words before, and the word before with the one behind."""
    before, behind = _beside(text, start, end)
    return [" ".join(before[-n:]) for n in range(1, len(before) + 1)] + [f"{before[-1]} _ {w}" for w in behind if before]


def unknowns(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, the kinds that the shape allows, contexts) of identifier-shaped strings that overlap no fixed span."""
    out = []
    found = [(*m.span(), False) for m in UNKNOWN_NUMBER.finditer(text)] if _HAS_DIGIT.search(text) else []
    free = 0
    for m in UNKNOWN_AT.finditer(text):
        head = text[free : m.start()]  # what stands before a sign is no part of the next one's word
        free = m.end()
        tail = UNKNOWN_TAIL.match(text, m.end())
        if tail and (own := len(head) - len(head.rstrip(LOCAL))):
            found.append((m.start() - own, tail.end(), True))
    starts = [s for s, _, _ in taken]
    reach = list(accumulate((e for _, _, e in taken), max))  # how far the spans up to each reach
    last = -1
    for s, e, word in sorted(found):
        near = bisect_left(starts, e)
        if s < last or (near and reach[near - 1] > s):
            continue
        digits = len(_digits(text[s:e]))
        if word:
            allowed = "email"
        else:
            allowed = ",".join(k for k, ok in (("ip", text[s:e].count(".") == 3), ("card", 12 <= digits <= 19), ("phone", 7 <= digits <= 15)) if ok)
        if allowed:
            out.append((s, e, allowed, contexts(text, s, e)))
            last = e
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_EDGE = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("allowed", pa.string())])
_SCAN = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, edges array<struct<pattern:string,instance:string,kind:int,start:long,end:long,allowed:string>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row (numbered, or by a column that numbers it) its fixed spans, and an edge for each context of each seed (its kind) and each unknown (kind -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc, row, text in zip(column(b, id_col).to_pylist(), column(b, "row").to_pylist(), (x.as_py() for x in column(b, text_col)), strict=True):
                text = text or ""
                spans = fixed_spans(text)
                edges = []
                for s, k, e in spans:
                    edges += [(p, text[s:e], k, s, e, "") for p in contexts(text, s, e)]
                for s, e, allowed, pats in unknowns(text, spans):
                    edges += [(p, text[s:e], -1, s, e, allowed) for p in pats]
                n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                for c, v in zip(cols, (doc, row, *n, hashlib.sha256(_joined(spans).encode()).hexdigest(), [dict(start=s, kind=k, end=e) for s, k, e in spans], [dict(zip(("pattern", "instance", "kind", "start", "end", "allowed"), x, strict=True)) for x in edges]), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(_SPAN), pa.list_(_EDGE)]
            names = ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "edges"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), text_col).mapInArrow(run, _SCAN)


def confident_patterns(edges: DataFrame, support: int = 5, confidence: float = 0.8, doubt: float = 0.1) -> DataFrame:
    """pattern, kind, confidence of the patterns that may name unknown instances. edges: pattern, instance, kind (-1 unknown), allowed.

    An instance is believed for a pattern once another confident pattern holds it, so that no pattern vouches for itself. With S seeds
    of the kind, B believed ones, K known instances of any kind and U unknown ones, a pattern's confidence is
    (S + B) / (K + B + doubt * (U - B) + 1). Confident patterns stay so, and the rounds end when none is added.
    """
    known = edges.where("kind >= 0").select("pattern", F.sha2("instance", 256).alias("instance"), "kind", F.lit("").alias("allowed"))
    lost = edges.where("kind < 0").select("pattern", F.sha2("instance", 256).alias("instance"), "kind", "allowed")
    # each distinct link counts once
    links = stored(known.unionByName(lost).groupBy("pattern", "instance", "kind").agg(F.max("allowed").alias("allowed")), "pattern-links")
    sizes = stored(links.groupBy("pattern").agg(F.count_if(F.col("kind") >= 0).alias("known"), F.count_if(F.col("kind") < 0).alias("unknown")), "pattern-sizes")
    seeds = stored(links.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")), "pattern-seeds")
    number = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    open_links = stored(links.where("kind < 0").select("pattern", "instance", F.explode(F.split("allowed", ",")).alias("name")).select("pattern", "instance", number[F.col("name")].alias("kind")), "pattern-open")

    def scored(believed: DataFrame) -> DataFrame:
        n, more = (F.coalesce(c, F.lit(0)) for c in ("seeds", "believed"))
        both = seeds.join(believed, ["pattern", "kind"], "full").where(n + more >= support).join(sizes, "pattern")
        of = F.col("known") + more + doubt * (F.col("unknown") - more) + 1
        return stored(both.select("pattern", "kind", ((n + more) / of).alias("confidence")).where(F.col("confidence") >= confidence), "pattern-scores")

    good = scored(seeds.select("pattern", "kind", F.lit(0).cast("long").alias("believed")))
    have = good.count()
    while have:
        held = open_links.join(good.select("pattern", "kind", F.lit(1).alias("own")), ["pattern", "kind"], "left")
        by = held.groupBy("instance", "kind").agg(F.sum("own").alias("holders")).where("holders > 0")
        others = F.col("holders") - F.coalesce("own", F.lit(0))
        good = scored(held.join(by, ["instance", "kind"]).where(others > 0).groupBy("pattern", "kind").agg(F.count("*").alias("believed")))
        if (now := good.count()) == have:
            break
        have = now
    return good


def _added(scan: DataFrame, support: int, confidence: float) -> DataFrame:
    """row, more: spans that confident patterns add, where no two overlap. scan: of scanned(), stored."""
    edges = scan.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    good = confident_patterns(edges, support, confidence)
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    open_edges = edges.where("kind < 0").select("row", "pattern", "start", "end", "allowed")
    hits = open_edges.join(good, "pattern").where(F.array_contains(F.split("allowed", ","), named))
    best = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def found(docs: DataFrame, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Per row: doc_id, row, counts and hash of the fixed spans, and all spans as array<struct<start,kind,end>>."""
    scan = stored(scanned(docs), "private-scan")
    more = _added(scan, support, confidence)
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return scan.drop("edges").join(more, "row", "left").select("doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def redacted_documents(docs: DataFrame, support: int = 5, confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with each span in its text replaced by its kind. Rows are told apart by a number, whether ids
    are null or repeat."""
    plain, (id_at, text_at) = positional(docs, id_col, text_col)
    keyed = stored(plain.withColumn(ROW, F.monotonically_increasing_id()), "private-rows")
    scan = stored(scanned(keyed, id_at, text_at, ROW), "private-scan")
    more = _added(scan, support, confidence).select(F.col("row").alias(ROW), "more")
    joined = keyed.join(more.hint("shuffle_hash"), ROW, "left")
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, extra in zip((x.as_py() for x in b.column(at)), column(b, "more").to_pylist(), strict=True):
                if text:
                    spans = fixed_spans(text) + [(x["start"], x["kind"], x["end"]) for x in extra or ()]
                    text = redacted(text, spans) if spans else text
                out.append(text)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*plain.columns, "more").mapInArrow(run, docs.schema)


def spans_text(spans: Column | str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans count as the one that begins first."""
    text, out, at = text or "", [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
