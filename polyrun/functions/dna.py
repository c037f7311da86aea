"""Column expressions on DNA strings: all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code; codons in the order TCAG of each place.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(seq: str | Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(_col(seq)), "U", "T")


def pack_safe(kmer: str | Column) -> Column:
    """Anything that is no base counts as A in a flank."""
    return F.regexp_replace(_col(kmer), "[^ACGT]", "A")


def revcomp(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTU", "TGCAA"))


def kmer_code(kmer: str | Column) -> Column:
    """Two bits a base, the first base lowest; up to 31 bases fit a long. Its order is that of the reversed k-mer."""
    digits = F.translate(F.reverse(_col(kmer)), "ACGT", "0123")
    return F.aggregate(F.split(digits, ""), F.lit(0).cast("long"), lambda acc, d: F.when(d == "", acc).otherwise(acc * 4 + d.cast("int")))


def kmer_string(code, k: int) -> Column:
    """The k-mer of a code of kmer_code(); four bases at a time are looked up."""
    fours = F.array(*[F.lit("".join("ACGT"[i >> 2 * j & 3] for j in range(4))) for i in range(256)])
    parts = [F.element_at(fours, (F.shiftrightunsigned(_col(code), 2 * i).bitwiseAND(F.lit(255)) + 1).cast("int")) for i in range(0, k, 4)]
    return F.substring(F.concat(*parts), 1, k)


def code_distance(a, b) -> Column:
    """Number of bases in which two codes of kmer_code() differ."""
    x = _col(a).bitwiseXOR(_col(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def code_shift_distance(a, b, k: int) -> Column:
    """As one flank of shift_distance(), of codes: least of shift + differences over shifts of either k-mer by 0 to 3 bases."""
    a, b = _col(a), _col(b)
    cost = lambda x, y, s: F.lit(s) + code_distance(F.shiftright(x, 2 * s), y.bitwiseAND(F.lit(4 ** (k - s) - 1)))
    return F.least(code_distance(a, b), *[cost(x, y, s) for x, y in ((a, b), (b, a)) for s in (1, 2, 3) if s < k])


def tract_string(left, base, right, length, neg=None) -> Column:
    """Flank, tract, flank; reverse complement where neg."""
    s = F.concat(_col(left), F.repeat(_col(base), _col(length).cast("int")), _col(right))
    return s if neg is None else F.when(_col(neg), revcomp(s)).otherwise(s)


def context_name(left, base, right, neg=None) -> Column:
    """LEFT.B.RIGHT as the reference strand shows it."""
    s = F.concat_ws(".", _col(left), _col(base), _col(right))
    return s if neg is None else F.when(_col(neg), F.concat_ws(".", revcomp(right), revcomp(base), revcomp(left))).otherwise(s)


def _differences(a: Column, b: Column) -> Column:
    """Number of places in which two strings of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, d: n + d)


def kmer_distance(a, b, cap: int | Column | None = None) -> Column:
    d = _differences(_col(a), _col(b))
    return d if cap is None else F.least(d, cap if isinstance(cap, Column) else F.lit(cap))


def pair_distance(l1, r1, l2, r2) -> Column:
    return kmer_distance(l1, l2) + kmer_distance(r1, r2)


def _shifted(a: Column, b: Column, k: int, compat: bool) -> Column:
    """Least of shift + differences over shifts of either k-mer by 0 to 3 bases. compat: bases moved in compare as A."""
    fill = "A" if compat else ""

    def cost(x, y, s):
        tail = F.substring(x, s + 1, k - s)
        whole = F.concat(tail, F.lit(fill * s)) if compat else tail
        return F.lit(s) + _differences(whole, y if compat else F.substring(y, 1, k - s))

    return F.least(_differences(a, b), *[cost(x, y, s) for x, y in ((a, b), (b, a)) for s in (1, 2, 3) if s < k])


def shift_distance(l1, r1, l2, r2, k: int, compat: bool = False) -> Column:
    """Distance of two contexts that tolerates a shift of up to three bases in each flank."""
    return _shifted(_col(l1), _col(l2), k, compat) + _shifted(_col(r1), _col(r2), k, compat)


def common_prefix(a, b, codes: tuple | None = None) -> Column:
    """Length of the common prefix. codes: of strings of up to 31 bases that have many pairs kmer_code() of a and of b, made once per string and not once per pair."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    if codes is not None:
        x = _col(codes[0]).bitwiseXOR(_col(codes[1]))
        lowest = x.bitwiseAND(F.negative(x))  # twice as many bits are below it as bases are equal
        return F.when(x == 0, n).otherwise(F.least(n, F.shiftright(F.bit_count(lowest - 1), 1))).cast("int")
    first = F.array_position(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y), False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def common_suffix(a, b, codes: tuple | None = None, reverse_codes: tuple | None = None) -> Column:
    """Length of the common suffix that does not reach into the common prefix. codes, reverse_codes: as in common_prefix(), of the strings and of the reversed strings."""
    a, b = _col(a), _col(b)
    room = F.least(F.length(a), F.length(b)) - common_prefix(a, b, codes)
    behind = common_prefix(F.reverse(a), F.reverse(b)) if reverse_codes is None else common_prefix(a, b, reverse_codes)
    return F.least(behind, room).cast("int")


def tract_label(tract_id) -> Column:
    return F.format_string("tid_%06d", _col(tract_id))


def translate_protein(seq, reverse: bool = False) -> Column:
    """Amino acids of the codons from the first base on; X for codons with other letters."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])

    def amino(s: Column) -> Column:
        n = F.floor(F.length(s) / 3).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(table, F.substring(s, i * 3 + 1, F.lit(3))), F.lit("X")))
        return F.when(n > 0, F.array_join(each, "")).otherwise("")

    # the cleaned sequence is an argument of the lambda, or it would be made anew for every codon
    return F.element_at(F.transform(F.array(clean(revcomp(clean(seq)) if reverse else seq)), amino), 1)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d))


def circular_hash(values: list[Column]) -> Column:
    """16-bit rotate-and-xor hash of small integers."""
    return reduce(lambda h, v: (F.shiftleft(h, 1).bitwiseOR(F.shiftright(h, 15))).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(v.cast("int").bitwiseAND(F.lit(0xFFFF))), values, F.lit(0))
