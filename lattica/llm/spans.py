"""Spans of regular-expression matches as column expressions: code-point offsets, context, overlap, replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context kept on each side of a match.
BEFORE, AFTER = 24, 8
#: Elements of a block of ``running``, and characters of a block of ``replaced``.
BLOCK, BLOCK_CHARS = 128, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of ``emit(state, x)`` for each x, with the state that ``step`` has made of the elements before.

    An array that grows is copied at each step, so elements are taken in blocks: first the state before each block, then each
    block on its own. n elements cost n * BLOCK copies.
    """

    def inside(all_xs: Column, i: Column) -> Column:
        return F.sequence(i * BLOCK, F.least(i * BLOCK + BLOCK, F.size(all_xs)) - 1)

    def block(all_xs: Column, state: Column, i: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

        def add(acc: Column, j: Column) -> Column:
            x = F.get(all_xs, j)
            return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x).cast(kind))).alias("out"))

        return F.aggregate(inside(all_xs, i), begin, add, lambda acc: acc["out"])

    def every(all_xs: Column) -> Column:
        blocks = F.floor((F.size(all_xs) - 1) / BLOCK).cast("int") + 1
        after = lambda state, i: F.aggregate(inside(all_xs, i), state, lambda acc, j: step(acc, F.get(all_xs, j)))
        states = F.aggregate(F.sequence(F.lit(0), blocks - 1), F.array(zero), lambda acc, i: F.concat(acc, F.array(after(F.get(acc, i), i))))
        return F.flatten(F.transform(F.slice(states, F.lit(1), blocks), lambda state, i: block(all_xs, state, i)))

    return let(xs, lambda all_xs: F.when(F.size(all_xs) > 0, every(all_xs)).otherwise(F.array().cast(f"array<{kind}>")))


def match_spans(text: Column, pattern: str, kind: str, rank: int, context: bool = False) -> Column:
    """array<struct<kind, rank, start, end, value[, before, after]>> of a pattern's leftmost non-overlapping matches.

    The text between matches and the matches themselves alternate, so running sums of their lengths are offsets. The
    pattern must not match the empty string.
    """
    fields = "kind string, rank int, start int, end int, value string" + ", before string, after string" * context
    made = "struct<" + ",".join(f"{a}:{b}" for a, b in (f.split() for f in fields.split(", "))) + ">"
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def emit(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        own = [F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")]
        if context:
            own += [F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(AFTER)).alias("after")]
        return F.struct(*own)

    def walked(p: Column) -> Column:
        return F.transform(p["found"], lambda m, i: F.struct(m.alias("value"), F.get(p["gaps"], i).alias("gap"), *[F.get(p["gaps"], i + 1).alias("next")] * context))

    return running(let(parts, walked), F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]), emit, made)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column, start_first: bool) -> Column:
    """kind:start:end of each span, comma-joined, by (kind's rank, start) or (start, kind's rank), then end."""
    keyed = F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in (("start", "rank") if start_first else ("rank", "start"))], s["end"].alias("end"), s["kind"].alias("kind")))
    return F.concat_ws(",", F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def inside_any(span: Column, others: Column) -> Column:
    """Whether a span shares a character with one of ``others``."""
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def touched(spans: Column, others: Column) -> Column:
    """array<struct<s, hit>>: ``spans`` in order of start, and whether each shares a character with one of ``others``.

    Both are sorted together and passed twice: forwards with the furthest end so far, backwards with the least start.
    """
    none = F.lit(None)

    def sorted_all(x: Column) -> Column:
        own = F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), i.alias("i")))
        them = F.transform(x["others"], lambda o: F.struct(o["start"].alias("start"), F.lit(0).alias("own"), o["end"].alias("end"), none.cast("int").alias("i")))
        return F.sort_array(F.concat(own, them))

    def passed(x: Column) -> Column:
        event = "struct<start:int,own:int,end:int,i:int,hit:boolean>"
        is_own = lambda e: e["own"] == 1
        fields = lambda e: [e[c].alias(c) for c in ("start", "own", "end", "i")]
        forth = running(sorted_all(x), F.lit(0), lambda far, e: F.when(is_own(e), far).otherwise(F.greatest(far, e["end"])), lambda far, e: F.struct(*fields(e), (far > e["start"]).alias("hit")), event)
        back = running(F.reverse(forth), F.lit(2147483647), lambda near, e: F.when(is_own(e), near).otherwise(e["start"]), lambda near, e: F.struct(*fields(e), (e["hit"] | (near < e["end"])).alias("hit")), event)
        return F.transform(F.reverse(F.filter(back, is_own)), lambda e: F.struct(F.get(x["spans"], e["i"]).alias("s"), e["hit"].alias("hit")))

    alone = lambda x: F.transform(x["spans"], lambda s: F.struct(s.alias("s"), F.lit(False).alias("hit")))
    both = F.struct(spans.alias("spans"), others.alias("others"))
    return let(both, lambda x: F.when((F.size(x["spans"]) > 0) & (F.size(x["others"]) > 0), passed(x)).otherwise(alone(x)))


def outside(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that share no character with any of ``others``."""
    return F.transform(F.filter(touched(spans, others), lambda x: ~x["hit"]), lambda x: x["s"])


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by the kind, in brackets, of the span that starts it."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(x: Column) -> Column:
        def cut(start: Column, end: Column | None = None) -> Column:
            """The text from ``start`` on, read from the blocks that hold it."""
            first = F.floor(start / BLOCK_CHARS).cast("int")
            blocks = F.size(x["blocks"]) if end is None else F.floor(end / BLOCK_CHARS).cast("int") - first + 1
            held = F.array_join(F.slice(x["blocks"], first + 1, F.greatest(blocks, F.lit(0))), "")
            return F.substring(held, start - first * BLOCK_CHARS + 1, F.lit(2147483647) if end is None else end - start)

        emit = lambda at, s: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        made = running(x["ordered"], F.lit(0), lambda at, s: F.greatest(at, s["end"]), emit, "string")
        return F.concat(F.array_join(made, ""), cut(F.coalesce(F.array_max(F.transform(x["ordered"], lambda s: s["end"])), F.lit(0))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK_CHARS).cast("int")), lambda i: F.substring(text, i * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))
    return let(F.struct(ordered.alias("ordered"), blocks.alias("blocks")), pieces)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def bounded_sample(docs: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows, all if there are fewer, chosen by a hash of all columns: the same rows at every run."""
    return docs.where(sampled(docs, bound))


def sampled(docs: DataFrame, bound: int) -> Column:
    """Whether ``bounded_sample`` chooses a row of ``docs``."""
    n = docs.count()
    if n <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(*docs.columns), F.lit(1_000_000)) < int(1_000_000 * bound / n)
