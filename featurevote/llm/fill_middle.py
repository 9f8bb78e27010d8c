"""Fill-in-the-middle texts: a document cut into prefix, middle and suffix, put in another order.

A text is a row of units. One `fullmatch` of `(unit)*` by the regex library keeps every repetition of
the group, so `match.ends(1)` is the number of units and both cut offsets at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# A run of ASCII letters, or any other single code point.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
NO_LETTER = regex.compile(r"[^A-Za-z]")
# The library keeps all repetitions of one match in memory and gives up after some millions. Longer
# texts are matched in parts of about so many code points, each up to the end of a unit.
PART_CHARS = 1 << 18
SENTINELS = ("<P>", "<S>", "<M>")
CUTS = StructType([StructField(name, LongType()) for name in ("n", "first", "second")])


class Units:
    """The units of one text: their number, and where each of them ends."""

    def __init__(self, text: str, part_chars: int = PART_CHARS):
        self.text = text
        self.parts = []  # (units up to the end of the part, its start, its end)
        self.n, start = 0, 0
        while start < len(text):
            stop = len(text)
            if stop - start > part_chars and (cut := NO_LETTER.search(text, start + part_chars)):
                stop = cut.start()
            self.ends = UNITS.fullmatch(text, start, stop).ends(1)
            self.n += len(self.ends)
            self.parts.append((self.n, start, stop))
            start = stop

    def end(self, k: int) -> int:
        """Code points up to the end of the k-th unit, 0 for none."""
        if k == 0:
            return 0
        place = bisect_left(self.parts, k, key=lambda part: part[0])
        last, start, stop = self.parts[place]
        ends = self.ends if place == len(self.parts) - 1 else UNITS.fullmatch(self.text, start, stop).ends(1)
        return ends[k - last - 1]


@F.arrow_udf(CUTS)
def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text, and its two cut offsets: the ends of `one` and `two` units modulo n + 1."""
    n, first, second = [], [], []
    for row in range(len(texts)):
        units = Units(texts[row].as_py())
        low, high = sorted((one[row].as_py() % (units.n + 1), two[row].as_py() % (units.n + 1)))
        n.append(units.n)
        first.append(units.end(low))
        second.append(units.end(high))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, first, second)], ["n", "first", "second"])


def draws(key: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers that follow from the seed and the key's text alone."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    plain_from: int = 90,
    spm_below: int = 20,
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document, without a shuffle.

    Cuts and form follow from seed and id, so equal ids are cut by equal draws, and a missing id by
    those of the empty string. Of 100 draws, those from `plain_from` leave the text as it is, as does an
    empty or missing text (no units, empty output) or one that holds a sentinel. Of the others, those
    below `spm_below` give suffix, prefix, middle (`spm`) and the rest prefix, suffix, middle (`psm`).
    The lengths are code points, missing for plain texts. Repeated rows and ties give equal rows, an
    empty table none; other columns, whatever their names, are left behind. Only texts and draws go to
    Python, and only three numbers a text come back; a task holds one text's matches at a time.
    """
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    prefix_mark, suffix_mark, middle_mark = (F.lit(s) for s in sentinels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.withColumn("cuts", _cuts("t", "h1", "h2"))
    marked = F.contains("t", prefix_mark) | F.contains("t", suffix_mark) | F.contains("t", middle_mark)
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("id", "t", "cuts.*", form.alias("form"))
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix = F.substring("t", F.lit(1), first)
    middle = F.substring("t", first + 1, second - first)
    suffix = F.substring("t", second + 1, F.length("t"))
    output = (
        F.when(F.col("form") == "plain", F.col("t"))
        .when(F.col("form") == "psm", F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
        .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that gave this output. A text that was cut holds no sentinel, so its parts are what
    stands between them."""
    marks = "|".join(rf"\Q{s}\E" for s in sentinels)
    part = [F.get(F.split(output, marks), F.lit(i)) for i in range(4)]
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )
