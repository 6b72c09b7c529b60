"""Native column expressions on text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of letters, digits and non-ASCII characters, once A-Z are lower.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text, told by its lengths, takes the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def letter_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def gram_key(words: Column, at: Column, n: int) -> Column:
    """A hash of the n words from ``at`` (from 0): of its first, middle and last one, so it costs the same for any n; equal grams have equal keys."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in sorted({0, n // 2, n - 1})])


class Sieve:
    """A Bloom filter of a bounded set of longs as a literal of a plan: tells, without a join, which values can't be in the set."""

    def __init__(self, values: DataFrame, count: int):
        """``values`` has one column of longs (hashes), about ``count`` of them; there are 512 bits for each, up to 2**22 in all."""
        self.bits = 1 << min(max((512 * count - 1).bit_length(), 12), 22)
        slots = values.select(F.explode(F.array(*self._slots(F.col(values.columns[0])))).alias("slot"))
        place = F.col("slot").bitwiseAND(F.lit(63)).cast("int")
        table = slots.select(F.shiftright("slot", 6).alias("at"), F.call_function("shiftleft", F.expr("1L"), place).alias("bit"))
        rows = table.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()  # at most bits / 64 rows
        longs = [0] * (self.bits // 64)
        for r in rows:
            longs[r["at"]] = r["bits"]
        self.table = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")  # folded to a constant

    def _slots(self, value: Column) -> list[Column]:
        return [x.bitwiseAND(F.lit(self.bits - 1)) for x in (value, F.shiftrightunsigned(value, 32))]

    def passes(self, value: Column) -> Column:
        one = lambda x: F.getbit(F.get(self.table, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
        first, second = self._slots(value)
        return one(first) & one(second)


def places_of(words: Column, n: int, wanted) -> Column:
    """The places (from 0) of the n-word windows for which ``wanted(place)`` holds, in order."""
    last = F.size(words) - n
    every = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.when(last >= 0, F.filter(every, wanted)).otherwise(F.array().cast("array<int>"))


def row_key(text: Column) -> Column:
    """With the identifier, this tells rows that share an identifier apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(17))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as make it differ from all column names ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
