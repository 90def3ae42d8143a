"""Fill-in-middle: a text cut at two of its tokens, with its middle moved to the end, in DataFrame functions.

A token is a run of other characters with the blanks before it, or blanks at the end of the text. `regexp_count` gives their number
n. The two cuts a <= b are drawn from a hash of the id; a pattern built for the row counts units possessively, `(unit{a}+)(unit{b-a}+)`,
and takes prefix, middle and suffix out of the text in a single match. Possessive counts never go back, so a match is one pass, and
they run without recursion, however many units there are.

Texts that hold a mark stay plain, so a mark in an output is always one that was put there; the original is rebuilt by cutting the
output at its marks.

Defined cases: NULL text counts as empty, and stays plain; a NULL id is hashed as nothing behind the seed; very long texts are cut
whole; equal rows give equal rows; an empty table gives an empty result. Only `keep`, id and text are read; columns of other names
pass through `keep`, and a kept column that has the name of a new one is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"\x20\x09-\x0D"
UNIT = rf"(?:[{BLANK}]*+[^{BLANK}]++|[{BLANK}]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = ("n", "form", "prefix", "middle", "suffix", "output")


def draws(doc_id: Column, seed: int, number: int) -> list[Column]:
    """Unsigned 32-bit numbers from the first digits of the sha256 of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(number)]


def parts(text: Column, first: Column, second: Column) -> Column:
    """[prefix, middle, suffix] of a text without marks: the first `first` units, those up to `second`, and the rest."""
    count = [F.concat(F.lit("{"), number.cast("string"), F.lit("}+")) for number in (first, second - first)]
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}"), count[0], F.lit(rf")({UNIT}"), count[1], F.lit(r")(.*+)\z"))
    return F.split(F.regexp_replace(text, pattern, F.lit(f"$1{PREFIX}$2{PREFIX}$3")), PREFIX, -1)


def transform(docs: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = 42, moved: int = 50, suffix_first: int = 80) -> DataFrame:
    """Columns `keep` and NEW: tokens, form (plain, psm, spm), the three parts (NULL if plain) and the output.

    `moved` of 100 texts are not plain; of these, `suffix_first` of 100 have the suffix before the prefix.
    """
    clash = sorted({*keep} & {*NEW})
    if clash:
        raise ValueError(f"kept columns have names of new ones: {', '.join(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    h = draws(F.col("doc_id"), seed, 4)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (h[2] % 100 >= moved)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(*keep, text.alias("__text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), form.alias("form"),
                       *[draw.alias(f"__h{k}") for k, draw in enumerate(h[:2])])
    cuts = [F.col(f"__h{k}") % (F.col("n") + 1) for k in range(2)]
    cut = F.when(F.col("form") != "plain", parts(F.col("__text"), F.least(*cuts), F.greatest(*cuts)))
    rows = rows.withColumn("__parts", cut)
    prefix, middle, suffix = (F.get(F.col("__parts"), F.lit(k)) for k in range(3))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("__text"))
    )
    return rows.select(*keep, "n", "form", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    cut = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(cut, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """Lengths of the cut, and digests of the output and of the text rebuilt from it."""

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return transformed.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
