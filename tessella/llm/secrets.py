"""Secrets in texts: three fixed patterns, then windowed entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Runs that may be an encoded secret.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What stands between the signs of a name.
_NAME = r"(?:[A-Z]?[a-z]{0,20}|[A-Z]{1,20})"
#: Parts of a candidate, between slashes, that are never secrets: numbers, words joined by dashes and the like (no place after a sign or at the begin
#: that isn't followed by a word), UUIDs, placeholders. No pattern repeats a group, so the time follows the length and no stack grows.
ALLOWED = (
    r"[0-9_+-]*",
    rf"(?!(?:.*[_+-])?(?!{_NAME}(?:[_+-]|$))).*[_+-].*",
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i).*(?:example|placeholder|your_|xxxx|0000000).*",
)
WINDOW = 20
#: Least entropy, in bits, of a window: of hexadecimal digits, of letters of one case, of letters of both, of letters with digits or signs. Even
#: choices of so many symbols give 3.4, 3.8, 4.1 and 4.1 on average over 20 places; prose in letters gives about 3.4.
BITS = {"hex": 3.0, "letters": 3.75, "cases": 3.85, "mixed": 3.8}



def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array, what each place and all before it come to: each round joins every place with the one 1, 2, 4, ... before it."""

    def join(done: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.when(back < F.size(done), F.zip_with(done, F.slice(F.concat(F.array_repeat(zero, back), done), F.lit(1), F.size(done)), combine)).otherwise(done)

    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), values, join)


def match_spans(text: Column, pattern: str, rank: int, kind: str, keep: Callable[[Column], Column] = lambda m: F.length(m) > 0) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, kind, hit), in code points, end exclusive.

    What lies between the matches and the matches themselves give the offsets as running sums."""

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = scan(F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit)), F.lit(0), lambda x, y: x + y)
        every = F.zip_with(ends, hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), hit.alias("hit")))
        return F.filter(every, lambda m: keep(m["hit"]))

    return F.when(text.rlike(pattern), _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"))


def outside(spans: Column, others: Column) -> Column:
    """Those of `spans`, which don't overlap each other, that no span of `others` overlaps.

    By start, a span is overlapped if one of the others before it ends behind its start, or the next one begins before its end."""
    marked = F.array_sort(F.concat(F.transform(others, lambda b: F.struct(b["start"], F.lit(0).alias("own"), b["end"], F.lit("").alias("hit"))), F.transform(spans, lambda c: F.struct(c["start"], F.lit(1).alias("own"), c["end"], c["hit"]))))

    def free(every: Column) -> Column:
        reach = scan(F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(0))), F.lit(0), lambda x, y: F.greatest(x, y))
        # The next one of the others, if it stands before the next of the spans.
        begins = F.concat(F.slice(F.transform(every, lambda x: F.when(x["own"] == 0, x["start"])), F.lit(2), F.size(every)), F.array(F.lit(None).cast("int")))
        seen = F.zip_with(F.arrays_zip(every.alias("span"), reach.alias("reach")), begins, lambda x, begin: F.struct(x["span"].alias("span"), x["reach"].alias("reach"), begin.alias("begin")))
        return F.transform(F.filter(seen, lambda x: (x["span"]["own"] == 1) & (x["reach"] <= x["span"]["start"]) & (F.coalesce(x["begin"], x["span"]["end"]) >= x["span"]["end"])), lambda x: x["span"])

    return F.when(F.size(others) == 0, F.transform(spans, lambda c: F.struct(c["start"], F.lit(1).alias("own"), c["end"], c["hit"]))).otherwise(_with(marked, free))


#: Counts of symbols are kept in longs of 12 counts with 5 bits each; count * log2(count) in whole units of 2 ** -40, so sums are exact.
_COUNTS, _COUNT_BITS, _UNITS = 12, 5, 1 << 40


def window_entropy(codes: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any `window` (up to 31) neighbouring symbols of an array of codes from 0 to 64; 0 if there are fewer.

    One pass: the counts, and the sum of count * log2(count), change only for the symbol that enters and the one that leaves."""
    weight = [round(c * math.log2(c) * _UNITS) if c else 0 for c in range(window + 2)]
    gain = F.array(*[F.lit(weight[c + 1] - weight[c]).cast("long") for c in range(window + 1)])
    loss = F.array(*[F.lit(weight[c] - weight[max(c - 1, 0)]).cast("long") for c in range(window + 1)])
    shift = lambda code: F.pmod(code, F.lit(_COUNTS)) * _COUNT_BITS
    place = lambda code: F.struct(code.alias("code"), F.floor(code / _COUNTS).cast("int").alias("slot"), shift(code).alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift(code)).alias("one"))
    none = lambda code: F.struct(F.lit(code).alias("code"), F.lit(-1).alias("slot"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("one"))

    def pairs(placed: Column) -> Column:
        left = F.slice(F.concat(F.array_repeat(none(-2), window - 1), F.array(none(-1)), placed), F.lit(1), F.size(placed))
        return F.zip_with(placed, left, lambda e, l: F.struct(e.alias("e"), l.alias("l")))  # noqa: E741

    def step(acc: Column, x: Column) -> Column:
        e, l = x["e"], x["l"]  # noqa: E741
        count = lambda y: F.call_function("shiftright", F.get(acc["counts"], y["slot"]), y["shift"]).bitwiseAND(F.lit(31).cast("long")).cast("int")
        lost = F.when(l["code"] >= 0, F.get(loss, count(l))).otherwise(F.lit(0).cast("long"))
        total = acc["total"] + F.when(e["code"] == l["code"], F.lit(0).cast("long")).otherwise(F.get(gain, count(e)) - lost)
        zero = F.lit(0).cast("long")
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == e["slot"], e["one"]).otherwise(zero) - F.when(k == l["slot"], l["one"]).otherwise(zero))
        return _with(total, lambda t: F.struct(counts.alias("counts"), t.alias("total"), F.when(l["code"] >= -1, F.least(acc["best"], t)).otherwise(acc["best"]).alias("best")))

    most = F.lit(math.floor(window * math.log2(window) * _UNITS)).cast("long")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), 65 // _COUNTS + 1).alias("counts"), F.lit(0).cast("long").alias("total"), most.alias("best"))
    return F.aggregate(_with(F.transform(codes, place), pairs), start, step, lambda acc: F.lit(math.log2(window)) - acc["best"] / F.lit(float(_UNITS * window)))


SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="


def _is_random(candidate: Column, bits: dict[str, float]) -> Column:
    codes = F.transform(F.split(candidate, ""), lambda c: F.least(F.call_function("locate", c, F.lit(SYMBOLS)) - 1, F.lit(64)))
    kind = F.when(candidate.rlike(r"^[0-9a-fA-F]+$"), bits["hex"]).when(candidate.rlike("^(?:[a-z]+|[A-Z]+)$"), bits["letters"]).when(candidate.rlike("^[A-Za-z]+$"), bits["cases"]).otherwise(bits["mixed"])
    return window_entropy(codes) >= kind


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, bits: dict[str, float] = BITS) -> DataFrame:
    """Spans of secrets per row of `docs`: id, spans array<struct<start,rank,end,kind>> by start, then kind.

    Kinds, in order: assign (a named value of 8 characters or more), access (key ids of 16 or more), hex (32 or more), entropy:
    other runs of 20 or more encoding characters, unless a span of another kind covers part of it. A run counts if it, or a part of it between slashes
    that has 20 characters or more, has a window of high entropy for its class (`BITS`) and isn't in the allow-list; a run with slashes counts
    as a whole only if none of its parts is in the allow-list.

    Cases: null and empty texts have no spans; rows of one id each get their own result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value_of = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    deny = "^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$"
    base = docs.select(
        F.col(id_col),
        match_spans(text, ASSIGN, 0, "assign", value_of).alias("assign"),
        match_spans(text, ACCESS, 1, "access", lambda m: F.length(m) >= 16).alias("access"),
        match_spans(text, HEX, 2, "hex").alias("hex"),
        match_spans(text, CANDIDATE, 3, "entropy").alias("candidate"),
    ).select(id_col, "candidate", F.concat("assign", "access", "hex").alias("base"))

    def secret(part: Column) -> Column:
        return (F.length(part) >= WINDOW) & ~part.rlike(deny) & _is_random(part, bits)

    def told(run: Column) -> Column:
        whole = lambda parts: F.exists(parts, secret) | ((F.size(parts) > 1) & ~F.exists(parts, lambda p: p.rlike(deny)) & _is_random(run, bits))
        return F.when(run.contains("/"), _with(F.filter(F.split(run, "/", -1), lambda p: p != ""), whole)).otherwise(secret(run))

    span = lambda m, rank, kind: F.struct(m["start"], rank.alias("rank"), m["end"], kind.alias("kind"))
    random = F.transform(F.filter(outside(F.col("candidate"), F.col("base")), lambda c: told(c["hit"])), lambda c: span(c, F.lit(3), F.lit("entropy")))
    return base.select(id_col, F.array_sort(F.concat(F.transform("base", lambda b: span(b, b["rank"], b["kind"])), random)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
