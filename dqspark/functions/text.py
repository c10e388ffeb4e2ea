"""Label expressions: normal form and similarity, as native column expressions.

The longer ones are written as SQL text over named columns: built call by call from Python they
would cost the driver more than they cost the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One limb of the bit-parallel recurrence holds this many characters, so that the sum of two
# limbs and a carry still fits a signed 64-bit integer (ANSI mode raises on overflow).
LIMB = 62
FULL = (1 << LIMB) - 1


def clean_label(c: Column) -> Column:
    """Lower-cased, surrounding white space of any kind removed; NULL stays NULL."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))


def chars(c: str) -> str:
    """The characters of a label, one array element per code point."""
    return f"filter(split({c}, ''), ch -> ch != '')"


def bit_alphabet(c: str) -> str:
    """The distinct characters of a label as one string."""
    return f"array_join(array_distinct({chars(c)}), '')"


def bit_masks(c: str) -> str:
    """For each character of ``bit_alphabet``, the positions it holds, as limbs of bits.

    A flat array: the limbs of the first character, then those of the second, and so on.
    """
    last = f"greatest(cast(ceil(length({c}) / {LIMB}) AS int), 1) - 1"
    bits = (
        f"transform(slice({chars(c)}, i * {LIMB} + 1, {LIMB}), "
        "(x, j) -> if(x = letter, shiftleft(1L, j), 0L))"
    )
    limb = f"aggregate({bits}, 0L, (acc, b) -> acc | b)"
    return (
        f"flatten(transform(array_distinct({chars(c)}), "
        f"letter -> transform(sequence(0, {last}), i -> {limb})))"
    )


def lcs_length(alphabet: str, masks: str, length: str, other: str) -> str:
    """Length of the longest common subsequence of two non-empty labels.

    The first label comes as ``bit_alphabet``, ``bit_masks`` and its length; the second as text.
    This is the bit-parallel recurrence of Hyyro (2004): one addition per character of the second
    label and limb of the first, for labels of any length.
    """
    limbs = f"cast(ceil({length} / {LIMB}) AS int)"
    base = f"(instr({alphabet}, ch) - 1) * {limbs}"

    def after(old: str, mask: str, carry: str) -> tuple[str, str]:
        """A limb's sum with the carry coming in, and its new value."""
        total = f"{old} + ({old} & {mask}) + {carry}"
        return total, f"(({total}) & {FULL}L) | ({old} - ({old} & {mask}))"

    _, single = after("v[0]", f"{masks}[{base}]", "0L")
    total, limb = after("v[i]", f"{masks}[{base} + i]", "st.carry")
    several = (
        f"aggregate(sequence(0, {limbs} - 1), "
        "named_struct('carry', 0L, 'out', cast(array() AS array<bigint>)), "
        f"(st, i) -> named_struct('carry', shiftright({total}, {LIMB}), "
        f"'out', concat(st.out, array({limb})))).out"
    )
    step = f"CASE WHEN instr({alphabet}, ch) = 0 THEN v WHEN {limbs} = 1 THEN array({single}) ELSE {several} END"
    walked = f"aggregate({chars(other)}, array_repeat({FULL}L, {limbs}), (v, ch) -> {step})"
    return f"aggregate({walked}, 0, (acc, limb) -> acc + {LIMB} - cast(bit_count(limb) AS int))"


def label_similarity(a: str, b: str) -> Column:
    """Normalised indel similarity of two label columns, by name: ``2 * LCS / (|a| + |b|)``.

    Equal labels have similarity 1, an empty and another one 0.
    """
    a, b = ("`" + name.replace("`", "``") + "`" for name in (a, b))
    common = lcs_length(bit_alphabet(a), bit_masks(a), f"length({a})", b)
    return F.expr(
        f"CASE WHEN {a} = {b} THEN 1.0D WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0D "
        f"ELSE 2.0D * {common} / (length({a}) + length({b})) END"
    )
