"""Column functions over letter strings (proteins, nucleotides, or any text reduced to letters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters in the order of their codes. Aliases share the code of the letter they stand for.
PROTEIN_LETTERS = "ARNDCQEGHILKMFPSTWYVBZXJOU"
PROTEIN_ORDER = "ABCDEFGHIJKLMNOPQRSTCGUUUU"
BASE_LETTERS = "ACGT"
COMPLEMENTS = "TGCA"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_AS_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def letters_of(text: Column) -> Column:
    """The ASCII letters of a text, upper-case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def as_bases(letters: Column) -> Column:
    """Letters mapped to A, C, G, T by their place in the alphabet."""
    return F.translate(letters, ALPHABET, LETTERS_AS_BASES)


def cleaned(raw: Column) -> Column:
    """A raw sequence, trimmed at the end, without one final ``*``, upper-case; null if anything but letters and blanks is left."""
    body = F.regexp_replace(F.regexp_replace(raw, r"\s+$", ""), r"\*$", "")
    tight = F.regexp_replace(body, r"\s", "")
    return F.when(tight.rlike("^[A-Za-z]*$"), F.upper(tight))


def identifier(header: Column, des_len: int = 20) -> Column:
    """The first word of a header after its marker and at most one blank, cut at ``des_len`` characters including the marker."""
    return F.substring(F.regexp_extract(header, r"^[>@] ?(\S*)", 1), 1, des_len - 1)


def reverse_complement(bases: Column, other: str = "keep") -> Column:
    """The other strand. ``other`` is what becomes of letters beside ACGT(U): kept, or taken as T and so becoming A ("A")."""
    if other == "A":
        bases = F.regexp_replace(bases, "[^ACGTacgt]", "T")
        return F.translate(F.reverse(bases), "ACGTacgt", "TGCAtgca")
    return F.translate(F.reverse(bases), "ACGTU", "TGCAA")


def protein_order(letters: Column) -> Column:
    """Letters renamed so that plain string order is code order, aliases merged."""
    return F.translate(letters, PROTEIN_LETTERS, PROTEIN_ORDER)


def two_decimals(share: Column) -> Column:
    """100 * a single-precision share, printed with two decimals, ties to even."""
    percent = (share.cast("float") * F.lit(100.0).cast("float")).cast("float").cast("double")
    return F.bround(percent.cast("decimal(20,12)"), 2).cast("string")


def records(docs: DataFrame, longer_than: int = 10, kind: str = "protein") -> DataFrame:
    """``seq_idx, seq, len`` from a table of texts: all letters, or bases, of each text that has more than ``longer_than`` of them."""
    seq = letters_of(F.col("text"))
    if kind == "base":
        seq = as_bases(seq)
    rows = docs.select(F.col("doc_id").cast("long").alias("seq_idx"), seq.alias("seq"))
    return rows.withColumn("len", F.length("seq")).where(F.col("len") > longer_than)
