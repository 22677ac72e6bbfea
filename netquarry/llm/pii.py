"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

The base patterns of four kinds of identifier give the seed instances. The words and signs that
stand before an instance are its lexical patterns. Spark scores the graph of patterns and
instances in turns: a pattern's confidence in a kind is the mean belief in the distinct instances
that it precedes, an instance's belief is one minus the chance that all its confident patterns
err; the seeds' beliefs are fixed. In each turn the patterns that are confident and have enough
distinct instances vouch for further instances, which vouch for further patterns. At the end,
every identifier-shaped string behind a confident pattern that no base span touches is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, shielded, table, written

KINDS = ("email", "ip", "card", "phone")
#: Turns of the scoring; confidence and distinct instances from which a pattern counts.
TURNS, CONFIDENT, SUPPORT = 3, 0.8, 8
#: Code points before an instance that its patterns are taken from.
REACH = 40

# The base patterns. The look-behinds and the search for "@" change no match: a run of digits that
# fails from its start fails from within, and a local part is whatever allowed run ends at the "@".
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A string with a digit, from its first digit on; its beginning is sought backwards.
DIGITS = re.compile(r"[0-9][^\s\"'<>=,;:]*(?: [0-9(][^\s\"'<>=,;:]*)*")
#: What may be written as an e-mail address: letters around "@" or "at" in or without brackets, then any labels with dots or "dot".
#: A bare "at" takes a "dot" behind it, so that it isn't the preposition.
_LABEL, _DOT = r"[^\W_][\w-]*", r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
MAIL = re.compile(
    rf"(?<![\w.%+-])[^\W_][\w.%+-]*+(?:(?:@|\s?[(\[{{]\s?(?:at|@)\s?[)\]}}]\s?){_LABEL}(?:{_DOT}{_LABEL})*|\sat\s{_LABEL}(?:{_DOT}{_LABEL})+)", re.I
)
AT = re.compile(r"[\s(\[{]at[\s)\]}]", re.I)
BREAKS = frozenset("\"'<>=,;: \t\n\r\x0b\x0c")
#: One or two words before an instance, with the signs that follow each.
CONTEXT = re.compile(r"(?:([^\W\d_]+)([^\w\n]{1,4}))?([^\W\d_]+)([^\w\n]{1,4})\Z")
SHORTEST = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at)  # no match holds this "@", so none reaches back over it
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-shaped spans (SHORTEST code points and three digits at least, or an e-mail address as people write it)
    that touch no base span, nor one another: of an address and a number that do, the address."""
    taken = sorted((s, e) for s, e, _ in base)
    mails, k = [], 0
    for m in MAIL.finditer(text) if "@" in text or AT.search(text) else ():
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not (k < len(taken) and taken[k][0] < m.end()):
            mails.append(m.span())
    return sorted(mails + _numbers(text, sorted(taken + mails)))


def _numbers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, free, k = [], 0, 0
    for m in DIGITS.finditer(text):
        start, end = m.start(), m.end()
        while start > free and text[start - 1] not in BREAKS:
            start -= 1
        while end > start and text[end - 1] in ".!?)]}":
            end -= 1
        free = m.end()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= SHORTEST and not (k < len(taken) and taken[k][0] < end) and len(digits_of(text[start:end])) >= 3:
            out.append((start, end))
    return out


def contexts(text: str, start: int) -> list[str]:
    """The patterns before start: the last word with its signs, and the last two."""
    if not (m := CONTEXT.search(text, max(0, start - REACH), start)):
        return []
    last = m[3].lower() + re.sub(r"\s+", " ", m[4])
    return [last] if m[1] is None else [last, m[1].lower() + re.sub(r"\s+", " ", m[2]) + last]


_EXTRA = (
    "pii_row string, pii_base array<struct<start:long,end:long,kind:string>>, "
    "pii_seen array<struct<start:long,end:long,kind:string,instance:string,patterns:array<string>>>"
)


def _scan(column: int, names: list[str]):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    seen = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        task, n = uuid.uuid4().hex, 0  # the result is written once, so a row's name may be random
        for batch in bounded(batches, column):
            rows, base, found = [], [], []
            for text in batch.column(column).to_pylist():
                text = text or ""
                spans = base_spans(text)
                rows.append(f"{task}-{n}")
                n += 1
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                both = spans + [(s, e, None) for s, e in candidates(text, spans)]
                found.append([{"start": s, "end": e, "kind": k, "instance": text[s:e].lower(), "patterns": contexts(text, s)} for s, e, k in both])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.string()), pa.array(base, kinds), pa.array(found, seen)], [*names, "pii_row", "pii_base", "pii_seen"]
            )

    return scan


def confident_patterns(edges: DataFrame, turns: int = TURNS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """edges (pattern, instance, kind or null) -> (pattern, kind, confidence) of the patterns that count at the end.

    An instance is a seed of each kind that any of its rows has. Repeated rows count once. A pattern has one kind: of
    its highest confidence, the first in the order of KINDS among equals.
    """
    graph = edges.groupBy("pattern", "instance").agg(F.count_if(F.col("kind").isNull()).alias("open"))
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = written(graph.join(sizes, "pattern").select("pattern", "instance", "n"), "graph")
    seeds = written(edges.where("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0)), "seeds")
    belief, best = seeds, None
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    for turn in range(turns):
        sums = graph.join(belief, "instance").groupBy("pattern", "kind", "n").agg(F.sum("belief").alias("s"))
        sums = sums.select("pattern", "kind", F.least(F.lit(1.0), F.round(F.col("s") / F.col("n"), 9)).alias("confidence"))
        first = F.max(F.struct("confidence", (-order).alias("o"), "kind")).alias("b")
        best = sums.where(F.col("confidence") >= confident).groupBy("pattern").agg(first)
        best = written(best.select("pattern", "b.kind", "b.confidence"), "patterns")
        if turn + 1 < turns:
            doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence"))))
            new = graph.join(best, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
            belief = written(seeds.union(new).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "beliefs")
    return best


def find(docs: DataFrame, turns: int = TURNS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """docs (text, any more) -> the same with pii_base and pii_spans, arrays of (start, end, kind).

    Offsets are in code points, the end exclusive; pii_spans has the base spans and those found by context, by start,
    then kind. A null or empty text has no spans. Every row is returned, repeated ones too, each with its own spans.
    """
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(_EXTRA).fields])
    return _found(docs.mapInArrow(_scan(docs.columns.index("text"), docs.columns), schema), docs.columns, turns, confident, support)


def _found(scanned: DataFrame, columns: list[str], turns: int = TURNS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    rows = written(scanned, "scanned")
    seen = rows.select("pii_row", F.explode("pii_seen").alias("x")).select("pii_row", "x.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    patterns = confident_patterns(edges, turns, confident, support)
    open_ = seen.where("kind IS NULL").select("pii_row", "start", "end", F.explode("patterns").alias("pattern"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = open_.join(patterns, "pattern").groupBy("pii_row", "start", "end")
    told = told.agg(F.max(F.struct("confidence", (-order).alias("o"), "kind")).alias("b"))
    more = told.groupBy("pii_row").agg(F.collect_list(F.struct("start", "end", F.col("b.kind").alias("kind"))).alias("pii_more"))
    more = written(more, "found")  # its size is known then: Spark broadcasts it if it is small
    place = f"array_position(array({', '.join(map(repr, KINDS))}), x.kind)"
    keyed = f"transform(concat(pii_base, coalesce(pii_more, array())), x -> struct(x.start, {place} AS o, x.end, x.kind))"
    by = F.expr(f"transform(array_sort({keyed}), x -> struct(x.start, x.end, x.kind))")
    return rows.join(more, "pii_row", "left").select(*columns, "pii_base", by.alias("pii_spans"))


def _text_of(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_ids(docs: DataFrame, **settings) -> DataFrame:
    """As find(), of docs (doc_id, text), but without the text."""
    docs = docs.select("doc_id", "text")
    scan = _scan(1, docs.columns)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            yield batch.drop_columns(["text"])

    return _found(docs.mapInArrow(short, "doc_id long, " + _EXTRA), ["doc_id"], **settings)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_ids(docs)
    counts = [F.expr(f"bigint(size(filter(pii_base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text_of("pii_base"), 256).alias("base_sha256"), _text_of("pii_spans").alias("spans"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each span becomes its kind in capitals and square brackets; spans that touch become one, of the
    first one's kind. n_chars follows the text."""
    inner, restored = shielded(docs, "text", "n_chars")
    found = find(inner)
    merged = F.expr(
        "aggregate(pii_spans, cast(array() AS array<struct<start:long,end:long,kind:string>>), (acc, x) -> "
        "IF(size(acc) > 0 AND x.start < acc[size(acc) - 1].end, concat(slice(acc, 1, size(acc) - 1), array(named_struct("
        "'start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end), 'kind', acc[size(acc) - 1].kind))), "
        "concat(acc, array(named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))))"
    )
    cut = F.expr(
        "concat(array_join(transform(pii_spans, (x, i) -> concat(substring(text, int(if(i = 0, 0, pii_spans[i - 1].end)) + 1, "
        "int(x.start - if(i = 0, 0, pii_spans[i - 1].end))), '[', upper(x.kind), ']')), ''), "
        "substring(text, int(pii_spans[size(pii_spans) - 1].end) + 1))"
    )
    out = found.withColumn("pii_spans", merged).withColumn("text", F.when(F.size("pii_spans") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out)


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
