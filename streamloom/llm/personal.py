"""Personal data by bootstrapped contextual extraction.

Base expressions find seed entities of four kinds. One pass over the texts writes, for each row, its base spans and all
other identifier-like tokens, each with its lexical patterns: the two words before it, the word on either side, and its
own shape. Base expressions are greedy and do not retry, so they miss a phone number followed by a card number or an
address; runs of numbers that pass a kind's check are therefore tokens too. From there on Spark works on that table: a
graph joins patterns and instances (the tokens' values), and scores travel over it for a few rounds. A pattern's score for a kind is the share of its occurrences whose instance is of that
kind, weighed by the instances' scores and damped for rare patterns; an instance's score is one if it is a seed, else
the noisy-or over its confident patterns. Occurrences in a pattern of high confidence whose value passes are added as
spans of the pattern's kind, of nested ones of a kind the outermost. Base spans always stay.

Defined cases: a null text is the empty text and has no span; a text of any length is searched whole, every expression
in linear time; words of the context have any length (those of more than 64 characters stand as their digest); rows of a repeated or null id are rows of their own; an empty table gives an empty result; only doc_id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
PATTERN_SCORE, INSTANCE_SCORE = 0.8, 0.8
#: Occurrences that a pattern counts besides its own, of no kind.
DAMPING = 1.0
LEAST_INSTANCES = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and takes whole runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>,.;:!?|*#$%&="
_DIGIT, _LETTERS = re.compile("[0-9]"), re.compile(r"[^\W\d_]+")
_FULL_WORD = re.compile(rf"(?<![^\x20\x09-\x0D])[{re.escape(_EDGE)}]*+[^\x20\x09-\x0D]++")
_NUMBERS = re.compile(r"(?<![0-9A-Za-z+(])[+(]*+[0-9][0-9().+-]*+(?:\x20[+(]*+[0-9][0-9().+-]*+)++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities in order of start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            # a part of thousands of zeros is a small number too, but more digits than int() takes
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _short(text: str) -> str:
    return text if len(text) <= 64 else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _word(text: str) -> str:
    return _short(_DIGIT.sub("0", text.strip(_EDGE).lower()))


def _shape(value: str) -> str:
    """Digits as 0, runs of letters as a, and whether the digits are a card's."""
    card = _CARD.fullmatch(value)
    digits = re.sub("[ -]", "", value) if card else ""
    shape = _LETTERS.sub("a", _DIGIT.sub("0", value))
    return f"= {_short(shape)}{' luhn' if 14 <= len(digits) <= 19 and luhn(digits) else ''}"


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The patterns of each span, given in order of their starts: the two words before it; the words on either side; its shape.

    A word holds more than marks. What is glued to a span, up to its neighbours among the spans, counts as a word.
    """
    if not spans:
        return []
    starts, ends = array("q"), array("q")
    for m in _FULL_WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    out, reach = [], 0
    for k, (start, end) in enumerate(spans):
        at = bisect_right(ends, start)  # words that end before the span
        before = [_word(text[starts[i] : ends[i]]) for i in range(max(0, at - 2), at)]
        if at < len(starts) and starts[at] < start and (glued := _word(text[max(starts[at], reach) : start])):
            before = [*before[-1:], glued]
        following = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        last = bisect_right(starts, end - 1) - 1  # the word that the span ends in
        after = _word(text[end : min(ends[last], max(following, end))]) if last >= 0 and ends[last] > end else ""
        nearest = bisect_left(starts, end)
        if not after and nearest < len(starts):
            after = _word(text[starts[nearest] : ends[nearest]])
        patterns = [_shape(text[start:end])]
        if len(before) == 2:
            patterns.append(f"< {before[0]} {before[1]}")
        if before and after:
            patterns.append(f"<> {before[-1]} _ {after}")
        out.append(patterns)
        reach = max(reach, end)
    return out


def numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of two or more blank-separated numbers within text[start:end] whose digits are those of a phone number or a card."""
    for run in _NUMBERS.finditer(text, start, end):
        words = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer("[^ ]+", run.group())]
        digits = [sum(c in "0123456789" for c in text[s:e]) for s, e in words]
        for i in range(len(words)):
            n = digits[i]
            for j in range(i + 1, len(words)):
                n += digits[j]
                if n > 19:  # more than any kind's
                    break
                value = text[words[i][0] : words[j][1]].rstrip("().+-")
                if (10 <= n <= 15 and _PHONE.fullmatch(value)) or (n >= 14 and _CARD.fullmatch(value) and luhn(re.sub("[ -]", "", value))):
                    yield words[i][0], words[i][0] + len(value)


def others(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of identifier-like tokens outside the spans: white-space-free runs of four characters or more with a
    digit or @, less the marks at their edges, and runs of numbers that pass a kind's check."""
    out, at, k = [], 0, 0
    covered = sorted((s, e) for s, _, e in spans)
    reach = 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(text, m.start()).end()
        at = end
        value = text[start:end]
        start, value = start + len(value) - len(value.lstrip(_EDGE)), value.strip(_EDGE)
        while k < len(covered) and covered[k][0] < end:
            reach, k = max(reach, covered[k][1]), k + 1
        if len(value) >= 4 and reach <= start:
            out.append((start, start + len(value), value))
    free = 0
    for s, e in [*covered, (len(text), len(text))] if len(out) > 1 or covered else []:
        out += [(i, j, text[i:j]) for i, j in numbers(text, free, s)]
        free = max(free, e)
    return sorted(out)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
SCHEMA = (
    "doc_id long, base array<struct<start:long,kind:int,end:long>>, base_sha256 string, "
    "seen array<struct<start:long,end:long,kind:int,value:string,patterns:array<string>>>"
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over the texts: each row's base spans and everything identifier-like in its context, with a row number that is written down."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            base, digest, seen = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                digest.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                found = sorted([(s, e, k, text[s:e]) for s, k, e in spans] + [(s, e, None, v) for s, e, v in others(text, spans)], key=lambda x: x[:2])
                around = contexts(text, [x[:2] for x in found])
                seen.append([{"start": s, "end": e, "kind": k, "value": v.lower(), "patterns": p} for (s, e, k, v), p in zip(found, around)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(SPAN)), pa.array(digest), pa.array(seen, pa.list_(SEEN))], ["doc_id", "base", "base_sha256", "seen"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "personal-survey")


def confident(occurrences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores over the graph of (value, kind or null, patterns): (pattern, kind, p) and (value, kind, score) above the thresholds."""
    edges = materialise(
        occurrences.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("seed")), "personal-graph"
    )
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("all"), F.count("*").alias("instances")).where(F.col("instances") >= LEAST_INSTANCES)
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, patterns = seeds, None
    for _ in range(rounds):
        weighed = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("own"))
        patterns = weighed.join(totals, "pattern").withColumn("p", F.col("own") / (F.col("all") + DAMPING)).where(F.col("p") >= PATTERN_SCORE).select("pattern", "kind", "p")
        patterns = materialise(patterns, "personal-patterns")
        new = edges.where("seed is null").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("p"))))).alias("score"))
        new = new.where(F.col("score") >= INSTANCE_SCORE).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        scores = materialise(seeds.unionByName(new), "personal-scores")
    return patterns, scores


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, base_sha256, added, all spans) of every row; spans are structs (start, kind, end)."""
    rows = survey(docs)
    flat = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    patterns, scores = confident(flat, rounds)
    added = (
        flat.where("kind is null").drop("kind")
        .select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern")
        .join(scores.select("value", F.col("kind").alias("of")), "value")
        .where("kind = of").select("row", "start", "kind", "end").distinct()
        .withColumn("reach", F.max("end").over(Window.partitionBy("row", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)))
        .where("reach is null or end > reach")
        .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    )
    none = F.lit(None).cast("array<struct<start:long,kind:int,end:long>>")
    out = rows.select("row", "doc_id", "base", "base_sha256").join(added, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array_except("base", "base"), none)))
    return out.withColumn("spans", every).drop("row")


def digest(found: DataFrame, counted: str = "spans") -> DataFrame:
    """The joined form of all spans, how many of them the method added, and counts by kind: of all spans, or of the base ones (counted "base")."""
    names = F.array(*[F.lit(k) for k in KINDS])
    counts = [F.expr(f"size(filter({counted}, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, "base_sha256", text.alias("spans"), added)
