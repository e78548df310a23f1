"""DNA strings as column expressions: everything runs in generated code, nothing row by row in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The alphabet in index order, and its complement.
BASES, COMPLEMENT_FROM, COMPLEMENT_TO = "ACGT", "ATCGatcg", "TAGCtagc"


def hash_number(*parts) -> Column:
    """A number in [0, 2**32) from the md5 of the parts joined by |; the same text in any engine."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def reverse_complement(seq: Column) -> Column:
    """ACGT in either case are complemented, all else stays; then reversed."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def strand_sequence(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def fit_length(seq: Column, length: int) -> Column:
    """Trim the centre out, or pad both sides with '.', to `length`."""
    size = F.length(seq)
    trimmed = F.substring(seq, F.floor((size - length) / 2).cast("int") + 1, F.lit(length))
    left = F.floor((length - size) / 2).cast("int")
    padded = F.rpad(F.concat(F.repeat(F.lit("."), F.greatest(left, F.lit(0))), seq), length, ".")
    return F.when(size >= length, trimmed).otherwise(padded)


def index_codes(seq: Column) -> Column:
    """array<int>: A C G T -> 0 1 2 3, all else 4."""
    return F.transform(F.split(F.upper(seq), ""), lambda c: F.when(F.instr(F.lit(BASES), c) == 0, 4).otherwise(F.instr(F.lit(BASES), c) - 1).cast("int"))


def sampled_codes(seq: Column, key: Column, seed: int = 0) -> Column:
    """Like index_codes with every other letter replaced by a base drawn from (key, position, seed)."""
    return F.transform(index_codes(seq), lambda c, i: F.when(c < 4, c).otherwise(F.pmod(hash_number(key, i, seed), F.lit(4)).cast("int")))


def one_hot(seq: Column, n_value: float = 0.0) -> Column:
    """array<array<double>> of four indicators; unknown letters hold n_value, '.' (padding) zero."""
    row = lambda c: F.array(*(F.when(c == b, 1.0).when(c.isin(*BASES, "."), 0.0).otherwise(n_value) for b in BASES))
    return F.transform(F.split(F.upper(seq), ""), row)


def one_hot_table(df: DataFrame, length: int | None = None, n_value: float = 0.0, keep: tuple[str, ...] = (), sample: int | None = None) -> DataFrame:
    """(seq_id, *keep, pos, base, value): four rows a position; whole sequences without `length`. With `sample`, a seed, unknown letters
    are drawn bases, by seq_id and position."""
    seq = fit_length(F.col("seq"), length) if length else F.col("seq")
    # Letters become rows first: what is then told of each is generated code, which functions over arrays are not.
    rows = df.where(F.length("seq") > 0).select("seq_id", *keep, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "letter_"))
    letter = F.col("letter_")
    if sample is None:
        value = lambda b: F.when(letter == b, 1.0).when(letter.isin(*BASES, "."), 0.0).otherwise(float(n_value))
    else:
        code = F.when(letter == ".", F.lit(4).cast("long")).when(letter.isin(*BASES), F.instr(F.lit(BASES), letter).cast("long") - 1).otherwise(F.pmod(hash_number(F.col("seq_id"), F.col("pos"), sample), F.lit(4)))
        rows, value = rows.withColumn("letter_", code), lambda b: F.when(letter == BASES.index(b), 1.0).otherwise(0.0)
    return rows.select("seq_id", *keep, "pos", F.posexplode(F.array(*map(value, BASES))).alias("base", "value"))


def one_hot_sampled(seq: Column, key: Column, seed: int = 0) -> Column:
    """array<array<double>> of four indicators, every other letter as a base drawn from (key, position, seed); '.' (padding) is all zero."""
    codes = F.transform(F.split(F.upper(seq), ""), lambda c, i: F.when(c == ".", 4).when(F.instr(F.lit(BASES), c) > 0, F.instr(F.lit(BASES), c) - 1).otherwise(F.pmod(hash_number(key, i, seed), F.lit(4))))
    return F.transform(codes, lambda c: F.array(*(F.when(c == b, 1.0).otherwise(0.0) for b in range(4))))


def decode_one_hot(rows: Column) -> Column:
    """Letters of indicator rows; a row without a one is N."""
    letter = lambda r: F.coalesce(F.get(F.array(*map(F.lit, BASES)), F.nullif(F.array_position(r, 1.0), F.lit(0)).cast("int") - 1), F.lit("N"))
    return F.array_join(F.transform(rows, letter), "")


def base_at(rows: Column, pos: int) -> Column:
    """The letter at one position (0-based); NULL beyond the end."""
    return F.nullif(F.substring(decode_one_hot(rows), pos + 1, 1), F.lit(""))


def one_hot_reverse_complement(long: DataFrame, length: Column) -> DataFrame:
    """(seq_id, pos, base, value) of the other strand; rows whose base is above 3 (extra tracks) keep it."""
    return long.withColumn("pos", (length - 1 - F.col("pos")).cast("int")).withColumn("base", F.when(F.col("base") < 4, 3 - F.col("base")).otherwise(F.col("base")))


def shift_sequence(seq: Column, by: Column, pad: str = "N") -> Column:
    """Shift right by a positive, left by a negative number of bases, filling with `pad`; the length stays."""
    size = F.length(seq)
    k = F.least(F.abs(by), size)
    fill = F.repeat(F.lit(pad), k)
    return F.when(by >= 0, F.concat(fill, F.substring(seq, F.lit(1), (size - k).cast("int")))).otherwise(F.concat(F.substring(seq, (k + 1).cast("int"), size), fill))


def shift_packed(rows: Column, by: Column, fill: float = 0.25) -> Column:
    """Encoded rows shifted right by a positive, left by a negative number of positions; what is laid bare holds `fill` in each base."""
    size = F.size(rows)
    k = F.least(F.abs(by), size).cast("int")
    bare = F.array_repeat(F.array_repeat(F.lit(float(fill)), F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(4))), k)
    return F.when(by >= 0, F.concat(bare, F.slice(rows, F.lit(1), size - k))).otherwise(F.concat(F.slice(rows, k + 1, size), bare))


def shift_table(long: DataFrame, by: str, length: str, fill: float = 0.25, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """shift_packed on the long form (keys, pos, base, value), where columns `by` and `length` hold each sequence's shift and length.

    Each row moves by itself; what would leave its sequence at one end stands for the position laid bare at the other, whose rows hold `fill`: so
    nothing is grouped or joined. Shifts beyond the length lay every position bare.
    """
    to, n = F.col("pos") + F.col(by), F.col(length)
    bare = (to < 0) | (to >= n) | (F.abs(F.col(by)) >= n)
    value = F.when(bare, F.lit(float(fill))).otherwise(F.col("value"))
    return long.select(*keys, F.pmod(to, n).cast("int").alias("pos"), "base", value.alias("value"))


def delete_bases(seq: Column, pos: Column, count: Column, pad: str = "N") -> Column:
    """Remove `count` bases from pos (0-based) and pad the right end to the old length."""
    size = F.length(seq)
    return F.rpad(F.concat(F.substring(seq, F.lit(1), pos.cast("int")), F.substring(seq, (pos + count + 1).cast("int"), size)), size, pad)


def insert_bases(seq: Column, pos: Column, insert: Column) -> Column:
    """Insert before pos (0-based) and cut to the old length."""
    return F.left(F.overlay(seq, insert, (pos + 1).cast("int"), F.lit(0)), F.length(seq))


def set_base(seq: Column, pos: Column, base: Column) -> Column:
    """Replace the base at pos (0-based); NULL for a letter outside ACGT or a place outside the sequence."""
    return F.when(base.isin(*BASES) & (pos >= 0) & (pos < F.length(seq)), F.overlay(seq, base, (pos + 1).cast("int"), F.lit(1)))


def set_bases_counted(df: DataFrame, pos: Column, base: Column, out: str = "seq") -> tuple[DataFrame, Observation]:
    """df with `out`, its seq with `base` at pos as set_base has it, and an observation of the same pass: `rows`, `invalid_letters` (bases other
    than A, C, G, T, or none) and `outside` (places outside their sequence). `get` waits for the first action."""
    seen = Observation()
    letter, place = F.coalesce(base.isin(*BASES), F.lit(False)), F.coalesce((pos >= 0) & (pos < F.length("seq")), F.lit(False))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~letter).alias("invalid_letters"), F.count_if(~place).alias("outside"))
    return counted.withColumn(out, set_base(F.col("seq"), pos, base)), seen


#: Letters of a piece that a long sequence is cut into.
PIECE = 256


def windows_at(df: DataFrame, reach: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(seq_id, pos, ref, near, at): for each position of [start, end), all without `end`, the letters up to `reach` on both sides of it and its place among them, from 1.

    A sequence is cut into pieces, with what lies around them, and those into windows: nothing carries a copy of the whole.
    """
    stop = F.length("seq") if end is None else F.least(F.length("seq"), F.lit(end))
    numbers = F.sequence(F.lit(start // PIECE), F.floor((stop - 1) / PIECE).cast("int"))
    cut = F.transform(numbers, lambda k: F.struct(k.alias("piece"), F.substring(F.upper("seq"), F.greatest(k * PIECE - reach, F.lit(0)) + 1, F.lit(PIECE + reach) + F.least(k * PIECE, F.lit(reach))).alias("part"), (stop - k * PIECE).alias("n")))
    pieces = df.where((F.length("seq") > start) & (stop > start)).select("seq_id", F.inline(cut)).withColumn("left", F.least(F.col("piece") * PIECE, F.lit(reach)))
    inside = lambda i: F.least(F.col("left") + i, F.lit(reach))
    near = lambda i: F.substring("part", F.col("left") + i - inside(i) + 1, inside(i) + reach + 1)
    places = F.sequence(F.greatest(F.lit(start) - F.col("piece") * PIECE, F.lit(0)), F.least(F.col("n"), F.lit(PIECE)) - 1)
    windows = F.transform(places, lambda i: F.struct((F.col("piece") * PIECE + i).alias("pos"), F.substring("part", F.col("left") + i + 1, F.lit(1)).alias("ref"), near(i).alias("near"), (inside(i) + 1).alias("at")))
    return pieces.select("seq_id", F.inline(windows))


def window_variants(df: DataFrame, reach: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(seq_id, pos, ref, base, wild, mutant): every single-base change at the positions of [start, end), as the letters up to `reach` on both sides of it.

    For scorers that see no further than `reach`: the difference of the two windows' scores is that of the sequences, and a variant
    holds 2 * reach + 1 letters instead of a copy of its sequence. Letters other than A, C, G, T are not changed.
    """
    each = windows_at(df, reach, start, end).where(F.col("ref").isin(*BASES)).withColumn("base", F.explode(F.array(*map(F.lit, BASES)))).where("base <> ref")
    return each.select("seq_id", "pos", "ref", "base", F.col("near").alias("wild"), F.overlay("near", "base", F.col("at"), F.lit(1)).alias("mutant"))


def window_shuffles(df: DataFrame, window: int, samples: int, mode: str = "mono", seed: int = 0, reach: int = 0, start: int = 0, end: int | None = None) -> DataFrame:
    """(seq_id, pos, sample, wild, mutant): shuffle_variants at the positions of [start, end), as the randomised window and up to `reach` letters on both sides of it.

    The same draws as shuffle_variants has of an upper-case sequence, without its copy of the sequence for each position and sample; for scorers
    that see no further than `reach`.
    """
    half = window // 2
    at = windows_at(df, half + reach, start, end).select("seq_id", "pos", "near", "at", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    lo = F.greatest(F.col("at") - half, F.lit(1))  # the window's first letter, among those near
    at = at.withColumn("lo", lo).withColumn("p", F.substring("near", lo, F.col("at") + half - lo + 1))
    mutant = F.concat(F.substring("near", F.lit(1), F.col("lo") - 1), randomised(mode, seed), F.substring("near", F.col("lo") + F.length("p"), F.length("near")))
    return at.select("seq_id", "pos", "sample", F.col("near").alias("wild"), mutant.alias("mutant"))


def stochastic_augment(df: DataFrame, epoch: int, seed: int, shift_max: int = 3, symmetric: bool = True) -> DataFrame:
    """Adds is_rc, shift and aug_seq, drawn from (seq_id, epoch, seed): every epoch differs, every run agrees."""
    low, width = (-shift_max, 2 * shift_max + 1) if symmetric else (0, shift_max + 1)
    out = df.withColumn("is_rc", hash_number(F.col("seq_id"), epoch, seed, "rc") % 2 == 1).withColumn("shift", (hash_number(F.col("seq_id"), epoch, seed, "shift") % width + low).cast("int"))
    moved = shift_sequence(F.col("seq"), F.col("shift"))
    return out.withColumn("aug_seq", F.when(F.col("is_rc"), reverse_complement(moved)).otherwise(moved))


def saturation_variants(df: DataFrame, start: int, end: int) -> DataFrame:
    """(seq_id, pos, ref, base, mut_seq): the other bases at each position of [start, end) that holds one of ACGT. No rows come from a null sequence."""
    at = df.where((F.length("seq") > start) & (F.lit(end) > start)).select("seq_id", "seq", F.explode(F.expr(f"sequence({start}, least(length(seq), {end}) - 1)")).alias("pos"))
    at = at.withColumn("ref", F.substring("seq", F.col("pos") + 1, F.lit(1))).where(F.col("ref").isin(*BASES))
    out = at.withColumn("base", F.explode(F.array(*map(F.lit, BASES)))).where("base <> ref")
    return out.select("seq_id", "pos", "ref", "base", set_base(F.col("seq"), F.col("pos"), F.col("base")).alias("mut_seq"))


def randomised(mode: str, seed: int) -> Column:
    """The letters `p` randomised by a hash of (seq_id, pos, sample, block, seed), as shuffle_variants describes it."""
    keyed = lambda x, i: F.struct(hash_number(F.col("seq_id"), F.col("pos"), F.col("sample"), i, seed).alias("h"), i.alias("i"), x.alias("x"))
    if mode == "random":
        return F.array_join(F.transform(F.split("p", ""), lambda x, i: F.substring(F.lit(BASES), (hash_number(F.col("seq_id"), F.col("pos"), F.col("sample"), i, seed) % 4).cast("int") + 1, F.lit(1))), "")
    blocks = F.split("p", "")
    if mode == "dinuc":
        head = F.when(F.col("sample") % 2 == 1, F.substring("p", 1, 1)).otherwise(F.lit(""))
        blocks = F.filter(F.concat(F.array(head), F.split(F.regexp_replace(F.expr("substring(p, if(sample % 2 = 1, 2, 1))"), "(..)", "$1 "), " ")), lambda x: x != "")
    return F.array_join(F.transform(F.array_sort(F.transform(blocks, keyed)), lambda e: e["x"]), "")


def shuffle_variants(df: DataFrame, start: int, end: int, window: int, samples: int, mode: str = "mono", seed: int = 0) -> DataFrame:
    """(seq_id, pos, sample, mut_seq): the window around each position randomised `samples` times.

    mode: 'random' draws bases, 'mono' shuffles letters, 'dinuc' shuffles pairs of letters, whose pairing
    starts one letter later in odd samples. Orders come from a hash of (seq_id, pos, sample, block). No rows come from a null sequence.
    """
    at = df.where((F.length("seq") > start) & (F.lit(end) > start)).select("seq_id", "seq", F.explode(F.expr(f"sequence({start}, least(length(seq), {end}) - 1)")).alias("pos"))
    at = at.withColumn("sample", F.explode(F.expr(f"sequence(0, {samples} - 1)")))
    at = at.withColumn("lo", F.greatest(F.col("pos") - window // 2, F.lit(0))).withColumn("hi", F.least(F.col("pos") + window // 2, F.length("seq") - 1))
    at = at.withColumn("p", F.substring("seq", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1))
    return at.select("seq_id", "pos", "sample", F.concat(F.substring("seq", F.lit(1), F.col("lo")), randomised(mode, seed), F.substring("seq", F.col("hi") + 2, F.length("seq"))).alias("mut_seq"))


def base_experiment(name: Column) -> Column:
    return F.regexp_replace(name, "_seed_[^_]*$", "")


def base_gene(gene: Column) -> Column:
    return F.substring_index(gene, ".", 1)


def is_reverse(gene: Column) -> Column:
    return F.endswith(gene, F.lit(".Rp"))


def prediction_key(key: Column) -> tuple[Column, Column]:
    """(target, seed) of target_<k>_seed_<m>; NULL where it is none."""
    got = lambda k: F.nullif(F.regexp_extract(key, r"^target_(\d+)_seed_(\d+)$", k), F.lit("")).cast("int")
    return got(1), got(2)
