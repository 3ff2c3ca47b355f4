"""Three-valued evaluation of condition texts, as one expression over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.storage import materialize

#: Values of Kleene's logic, so that "and" is the least, "or" the greatest, "not" the distance from two.
FALSE, UNKNOWN, TRUE = 0, 1, 2
# The tokens of a condition. What is neither an operator, a parenthesis nor a ``defined`` test is unknown.
TOKEN = r"(defined\s*\(\s*[A-Za-z_]\w*\s*\)|defined\s+[A-Za-z_]\w*|&&|\|\||!=|!|\(|\)|[^\s()&|!]+|[&|])"
NAME = r"^defined\s*\(?\s*([A-Za-z_]\w*)\s*\)?$"
_FRAME = "struct<some:int,every:int,now:int,negated:boolean>"


def truth(text: Column, defined: Column) -> Column:
    """0 (false), 1 (unknown) or 2 (true) of a condition; ``defined`` is the array of names that are.

    Operators are ``!``, ``&&`` (which binds closer) and ``||``, with parentheses to any depth. A decisive operand decides beside
    an unknown one. Anything else is an unknown operand: comparisons, calls, a missing operand, two operands without an operator,
    an empty or null text, and the whole text where parentheses do not match.

    The tokens are folded over a stack of frames, one for each open parenthesis: what the finished alternatives give, what the
    operands of the current one give, and the operand that is being read.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))

    def frame(some: Column, every: Column, now: Column, negated: Column) -> Column:
        return F.struct(some.cast("int").alias("some"), every.cast("int").alias("every"), now.cast("int").alias("now"), negated.alias("negated")).cast(_FRAME)

    none, off = F.lit(None), F.lit(False)
    empty = frame(F.lit(FALSE), F.lit(TRUE), none, off)

    def with_top(stack: Column, top: Column) -> Column:
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(top))

    def taken(f: Column, value: Column) -> Column:
        """The frame after an operand; a second one without an operator makes it unknown."""
        own = F.when(f["negated"], TRUE - value).otherwise(value)
        return frame(f["some"], f["every"], F.when(f["now"].isNull(), own).otherwise(UNKNOWN), off)

    def and_value(f: Column) -> Column:
        return F.least(f["every"], F.coalesce(f["now"], F.lit(UNKNOWN)))

    def or_value(f: Column) -> Column:
        return F.greatest(f["some"], and_value(f))

    def step(stack: Column, t: Column) -> Column:
        top = F.element_at(stack, -1)
        under = F.slice(stack, F.lit(1), F.size(stack) - 1)
        name = F.regexp_extract(t, NAME, 1)
        atom = F.when(name == "", UNKNOWN).when(F.array_contains(defined, name), TRUE).otherwise(FALSE)
        return (
            F.when(F.size(stack) == 0, stack)  # a parenthesis too many has been closed
            .when(t == "(", F.concat(stack, F.array(empty)))
            .when((t == ")") & (F.size(stack) == 1), F.slice(stack, F.lit(1), F.lit(0)))
            .when(t == ")", with_top(under, taken(F.element_at(under, -1), or_value(top))))
            .when(t == "!", with_top(stack, frame(top["some"], top["every"], top["now"], ~top["negated"])))
            .when(t == "&&", with_top(stack, frame(top["some"], and_value(top), none, off)))
            .when(t == "||", with_top(stack, frame(or_value(top), F.lit(TRUE), none, off)))
            .otherwise(with_top(stack, taken(top, atom)))
        )

    folded = F.aggregate(tokens, F.array(empty), step, lambda stack: F.when(F.size(stack) == 1, or_value(stack[0])).otherwise(UNKNOWN))
    return F.coalesce(folded, F.lit(UNKNOWN))


def evaluated(conditions: DataFrame, defined: list[str]) -> DataFrame:
    """``conditions``, one row for each distinct text, with ``value``: a text is read once, however many rows it guards.

    Written before the values are, so that no later filter or join makes them anew for each row.
    """
    own = materialize(conditions, "conditions")
    return materialize(own.withColumn("value", truth(F.col("condition"), F.array(*map(F.lit, defined)))), "condition-values")


def verdict(value: Column) -> Column:
    """A truth value as a boolean, null where unknown."""
    return F.when(value == TRUE, True).when(value == FALSE, False)


def chain_verdict(value: Column, negated: Column) -> Column:
    """An aggregate over the guards around a place: ``live`` if all hold, ``dead`` if one does not, else ``undecided``.

    ``negated`` guards are those whose other branch the place is in. It is the least of the values, so it combines before the
    shuffle and a dead guard decides whatever the others are.
    """
    own = F.when(negated, TRUE - value).otherwise(value)
    return F.when(F.min(own) == TRUE, "live").when(F.min(own) == FALSE, "dead").otherwise("undecided")
