"""Sequence, quality and alignment-flag expressions, all on built-in functions.

Ids like P3 refer to the operator inventory. Sequences and qualities are ASCII text; a null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The complement of each IUPAC letter, case preserved; U pairs with A, anything else becomes N.
COMPLEMENT_FROM = "ATGCURYSWKMBVDHNatgcuryswkmbvdhn"
COMPLEMENT_TO = "TACGAYRSWMKVBHDNtacgayrswmkvbhdn"

# SAM flag bits.
FLAG_BITS = {
    "is_paired": 0x1,
    "is_proper_pair": 0x2,
    "is_unmapped": 0x4,
    "is_mate_unmapped": 0x8,
    "is_first_in_pair": 0x40,
    "is_second_in_pair": 0x80,
    "is_secondary": 0x100,
    "is_duplicate": 0x400,
    "is_supplementary": 0x800,
}

PHRED_OFFSET = 33
BLANK = " \t\n\f\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seq_length(seq: Column | str) -> Column:
    """Length in bytes."""
    return F.octet_length(_col(seq)).cast("bigint")


def is_empty(seq: Column | str) -> Column:
    """P2."""
    return F.octet_length(_col(seq)) == 0


def letter_count(seq: Column | str, letters: str) -> Column:
    """How often any of ``letters`` occurs."""
    c = rest = _col(seq)
    for letter in letters:
        rest = F.replace(rest, F.lit(letter), F.lit(""))
    return (F.octet_length(c) - F.octet_length(rest)).cast("bigint")


def base_counts(seq: Column | str) -> dict[str, Column]:
    """Counts of A, T, G, C and N in either case."""
    return {f"count_{b.lower()}": letter_count(seq, b + b.lower()) for b in "ATGCN"}


def n_count(seq: Column | str) -> Column:
    """P4."""
    return letter_count(seq, "Nn")


def gc_pct(seq: Column | str) -> Column:
    """P5: G and C in percent of all letters, N and others included; 0 for an empty sequence."""
    n = seq_length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise(letter_count(seq, "GCgc") / n * 100.0)


def revcomp(seq: Column | str) -> Column:
    """Reverse complement by IUPAC, case preserved, unknown letters N."""
    known = F.regexp_replace(_col(seq), f"[^{COMPLEMENT_FROM}]", "N")
    return F.reverse(F.translate(known, COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement, in upper case."""
    up = F.upper(_col(kmer))
    return F.least(up, revcomp(up))


def fold(seq: Column | str, width: int = 80) -> Column:
    """Line breaks after every ``width`` letters, none at the end."""
    if width <= 0:
        raise ValueError("width must be above 0")
    return F.rtrim(F.regexp_replace(_col(seq), f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def trim_blank(text: Column | str) -> Column:
    """P10: without space, tab, line feed, form feed and carriage return at either end."""
    return F.btrim(_col(text), F.lit(BLANK))


def phreds(quality: Column | str) -> Column:
    """Phred values of Phred+33 text, not below 0."""
    return F.transform(F.split(_col(quality), ""), lambda c: F.greatest(F.ascii(c) - PHRED_OFFSET, F.lit(0)))


def mean_phred(quality: Column | str) -> Column:
    """Mean Phred value; 0 for an empty quality."""
    c = _col(quality)
    total = F.aggregate(phreds(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(total / F.length(c))


def q_bases(quality: Column | str, q: int) -> Column:
    """Letters of Phred+33 text with a value of at least ``q``."""
    if not 0 < q < 93:
        raise ValueError("q must lie between 1 and 92")
    return F.regexp_count(_col(quality), F.lit(f"[^\\x00-\\x{PHRED_OFFSET + q - 1:02x}]")).cast("bigint")


def raw_phreds(quality: Column | str) -> Column:
    """Phred values of raw quality bytes, as alignments hold them."""
    digits = F.hex(_col(quality))
    places = F.sequence(F.lit(0), F.octet_length(_col(quality)) - 1)
    values = F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(_col(quality)) > 0, values).otherwise(F.array().cast("array<int>"))


def raw_mean_phred(quality: Column | str) -> Column:
    """P11 for raw quality bytes; 0 for none."""
    n = F.octet_length(_col(quality))
    total = F.aggregate(raw_phreds(quality), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / F.when(n > 0, n))


def raw_q_bases(quality: Column | str, q: int) -> Column:
    """P12 for raw quality bytes."""
    return F.size(F.filter(raw_phreds(quality), lambda x: x >= q)).cast("bigint")


def with_commas(n: Column | str) -> Column:
    """Thousands separated by commas."""
    return F.format_number(_col(n), 0)


def flag(name: str, column: Column | str = "flag") -> Column:
    """One SAM flag predicate, by a name of FLAG_BITS, or ``is_mapped``, ``is_mate_mapped``, ``is_primary``."""
    c = _col(column)
    if name == "is_mapped":
        return c.bitwiseAND(0x4) == 0
    if name == "is_mate_mapped":
        return c.bitwiseAND(0x8) == 0
    if name == "is_primary":
        return c.bitwiseAND(0x900) == 0
    return c.bitwiseAND(FLAG_BITS[name]) != 0


def bin_start(pos: Column | str, size: int) -> Column:
    """Start of the bin of ``size`` that a position >= 0 lies in."""
    if size <= 0:
        raise ValueError("bin size must be above 0")
    return (_col(pos) - _col(pos) % size).cast("bigint")


def region_name(name: Column | str, start: Column, length: Column, whole: Column) -> Column:
    """``name`` for the whole sequence, ``name:s-s`` for a region of no length, else ``name:start+1-end``."""
    part = F.concat(_col(name), F.lit(":"), (start + 1).cast("string"), F.lit("-"), (start + length).cast("string"))
    none = F.concat(_col(name), F.lit(":"), start.cast("string"), F.lit("-"), start.cast("string"))
    return F.when(length == 0, none).when(whole, _col(name)).otherwise(part)


def base_offset(i: Column, offset: Column | str = "offset", line_bases: Column | str = "line_bases", line_width: Column | str = "line_width") -> Column:
    """Place in the file of base ``i``; null where an index row has no bases a line."""
    per = F.when(_col(line_bases) > 0, _col(line_bases))
    return (_col(offset) + F.call_function("div", i, per) * _col(line_width) + i % per).cast("bigint")


def kmer_array(seq: Column | str, k: int) -> Column:
    """Upper-cased windows of k letters that hold only A, C, G and T (F3), in order."""
    if not 1 <= k <= 1024:
        raise ValueError("k must lie between 1 and 1024")
    # runs of valid letters as bytes, where a place is found without counting characters
    runs = F.filter(F.split(F.upper(_col(seq)), "[^ACGT]+"), lambda r: F.length(r) >= k)

    def windows(run: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(run) - (k - 1)), lambda i: F.substring(run, i, F.lit(k)).cast("string"))

    return F.flatten(F.transform(F.transform(runs, lambda r: r.cast("binary")), windows))


def unpack_kmer(data: Column | str, k: Column | str) -> Column:
    """Letters of a packed k-mer: 2 bits a base (A C G T = 0 to 3), right-aligned in at most 32 big-endian bytes."""
    digits = F.lpad(F.hex(_col(data)), 64, "0")
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 16 * i, 16), 16, 4), 32, "0") for i in range(4)]
    return F.right(F.translate(F.concat(*parts), "0123", "ACGT"), _col(k))


def pack_kmer(kmer: Column | str, words: int = 4) -> Column:
    """A k-mer of A, C, G and T (either case) as right-aligned 64-bit words; null for other letters or too many of them."""
    c = F.upper(_col(kmer))
    digits = F.lpad(F.translate(c, "ACGT", "0123"), 32 * words, "0")
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 32 * i, 32), 4, 16), 16, "0") for i in range(words)]
    return F.when(c.rlike(f"^[ACGT]{{1,{32 * words}}}$"), F.unhex(F.concat(*parts)))
