"""Row-local sequential computations over arrays, as Spark SQL expressions.

They keep a scan over one text (brace depth, line numbers, greedy packing) inside the row
that owns the text, so no shuffle is needed to put its pieces back in order. ``aggregate``
copies its accumulator on every step; accumulators here therefore hold scalars only, or an
array that grows once per emitted block, never once per item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def bind(df: DataFrame, target: str, inputs: list[str], body: str) -> DataFrame:
    """Add column ``target`` = ``body``, which reads its inputs as ``s.<input>``.

    The lambda evaluates every input once per row. A plain column used inside a lambda may
    be inlined by the optimizer and would then run once per array element.
    """
    return df.withColumn(target, F.expr(let("s", f"struct({', '.join(inputs)})", body)))


def settle(df: DataFrame, keep: list[str], *computed: Column) -> DataFrame:
    """Columns ``keep`` and ``computed``, the latter out of reach of filters further up.

    A filter on a computed column is pushed below the projections that build it by copying
    their expressions into the filter, step into step. It cannot pass the output of a
    generator, so the last step is one: it yields exactly one row per row.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` any number of times in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def positions(first: str, length: str) -> str:
    """``first``, ``first + 1``, ... as an array of ``length`` integers."""
    return f"if({length} > 0, sequence({first}, {first} + {length} - 1), cast(array() as array<int>))"


def window_of(items: str, first: str, length: str) -> str:
    """``length`` items from zero-based position ``first``.

    Costs only the length of the window; ``slice`` walks the whole array on each call.
    """
    return f"transform({positions(first, length)}, w -> {items}[w])"


def with_running(
    df: DataFrame,
    source: str,
    target: str,
    combine: Callable[[str, str], str],
    zero: str,
    levels: int = 2,
    fanout: int = 8,
) -> DataFrame:
    """Add the inclusive running aggregate of an array column.

    ``combine`` gives SQL for two operands. Values are combined in blocks of ``fanout``,
    blocks of blocks and so on, and each result combines one stretch per level. The cost is
    linear in the length but for the top level, where it is the square of
    ``length / fanout ** levels``.
    """

    def stretch(arr: str, first: str, last: str, start: str) -> str:
        return f"aggregate(sequence({first}, {last}), {start}, (a, q) -> {combine('a', f'{arr}[q]')})"

    sums = [source] + [f"{target}_sum{k}" for k in range(1, levels + 1)]
    done = [target] + [f"{target}_run{k}" for k in range(1, levels + 1)]
    for k in range(levels):
        arr = f"s.{sums[k]}"
        last = f"least(g * {fanout} + {fanout - 1}, size({arr}) - 1)"
        count = f"int(ceil(size({arr}) / {fanout}))"
        block = stretch(arr, f"g * {fanout}", last, zero)
        df = bind(df, sums[k + 1], [sums[k]], f"transform({positions('0', count)}, g -> {block})")
    top = f"s.{sums[levels]}"
    df = bind(df, done[levels], [sums[levels]], f"transform({top}, (v, i) -> {stretch(top, '0', 'i', zero)})")
    for k in reversed(range(levels)):
        arr, before = f"s.{sums[k]}", f"s.{done[k + 1]}"
        start = f"if(i >= {fanout}, {before}[i div {fanout} - 1], {zero})"
        total = stretch(arr, f"i - i % {fanout}", "i", start)
        df = bind(df, done[k], [sums[k], done[k + 1]], f"transform({arr}, (v, i) -> {total})")
    return df.drop(*sums[1:], *done[1:])


def with_running_sum(df: DataFrame, source: str, target: str, levels: int = 2) -> DataFrame:
    return with_running(df, source, target, lambda a, b: f"{a} + {b}", "0L", levels)


def last_at_most(totals: str, bound: str) -> str:
    """Largest position whose value is at most ``bound`` in a rising array, or -1."""
    steps = f"sequence(1, int(ceil(log2(size({totals}) + 1D))) + 1)"
    middle = "(p.lo + p.hi) div 2"
    fits = f"{totals}[int({middle})] <= {bound}"
    return (
        f"aggregate({steps}, named_struct('lo', -1, 'hi', size({totals})), (p, n) -> "
        f"case when p.hi - p.lo <= 1 then p "
        f"when {fits} then named_struct('lo', int({middle}), 'hi', p.hi) "
        f"else named_struct('lo', p.lo, 'hi', int({middle})) end, p -> p.lo)"
    )
