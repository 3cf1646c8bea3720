"""Column functions over residue sequences and vectors. All are null for null input unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The residues in alphabetical order of their letters.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "[XBZJ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body refers to it, also from within lambdas."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def letters(sequence: Column) -> Column:
    """Characters as an array; an empty one for an empty sequence."""
    return F.filter(F.split(sequence, ""), lambda c: c != "")


def original_id(description: Column) -> Column:
    return F.regexp_extract(F.coalesce(description, F.lit("")), r"^(\S+)", 1)


def description_rest(description: Column) -> Column:
    return F.regexp_replace(F.coalesce(description, F.lit("")), r"^\S+\s*", "")


def sequence_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}_%012d", number)


def ambiguous(sequence: Column) -> Column:
    return F.regexp_count(sequence, F.lit(AMBIGUOUS))


def composition(sequence: Column, alphabet: str = RESIDUES) -> Column:
    """Share of each letter of the alphabet among those that are in it; an error where none is."""
    counts = F.array(*(F.length(sequence) - F.length(F.translate(sequence, c, "")) for c in alphabet))
    shares = lambda c, n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(F.raise_error(F.lit("a sequence without canonical residues")))
    return let(counts, lambda c: let(total(c), lambda n: shares(c, n)))


def tokenise(sequence: Column, vocabulary: dict[str, int], bos: int, eos: int, unknown: int, most: int | None = None) -> Column:
    """Ids of the characters between begin and end marks; at most `most` ids, marks included."""
    table = F.create_map(*(F.lit(x) for item in vocabulary.items() for x in item))
    ids = F.transform(letters(sequence), lambda c: F.coalesce(F.element_at(table, c), F.lit(unknown)))
    ids = ids if most is None else F.slice(ids, 1, most - 2)
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def pad(ids: Column, multiple: int, value: int) -> Column:
    missing = F.pmod(-F.size(ids), F.lit(multiple))
    return F.concat(ids, F.array_repeat(F.lit(value), missing))


def crop(items: Column, start: Column, length: int) -> Column:
    """Items from a place counted from 0."""
    return F.slice(items, start + 1, F.lit(length))


def window_start(length: Column, position: Column, size: int) -> Column:
    """Start of the window of a size that is centred on a position (from 0) and stays within the sequence."""
    return F.when(length <= size, 0).otherwise(F.greatest(F.lit(0), F.least(position - size // 2, length - size))).cast("int")


def strip_ignored(labels: Column, ignored: int = -100) -> Column:
    return F.filter(labels, lambda x: x != ignored)


def mutations(code: Column) -> Column:
    """Array of (wild, position, mutant) of a code such as A12C:D30E; an error where a part has another form."""
    pattern = r"^([A-Z])([1-9]\d*)([A-Z])$"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    checked = lambda x: F.when(x.rlike(pattern), x).otherwise(F.raise_error(F.concat(F.lit("not a mutation: "), x)).cast("string"))
    return F.transform(F.transform(F.split(code, ":"), checked), lambda x: F.struct(part(x, 1).alias("wild"), part(x, 2).cast("int").alias("position"), part(x, 3).alias("mutant")))


def binary_label(label: Column, flip: bool = False) -> Column:
    """1 for pathogenic, 0 for benign, numbers as they are, an error for anything else."""
    low = F.lower(label.cast("string"))
    number = low.try_cast("double")
    out = F.when(low == "pathogenic", 1.0).when(low == "benign", 0.0).when(number.isNotNull() | label.isNull(), number).otherwise(F.raise_error(F.concat(F.lit("no such label: "), low)).cast("double"))
    return 1 - out if flip else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-8) -> Column:
    """L2-normalised, the norm being at least floor."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(floor)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def log_softmax(logits: Column) -> Column:
    scale = lambda top: top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))
    return let(let(F.array_max(logits), scale), lambda whole: F.transform(logits, lambda x: x - whole))


def divergence(profile: Column, logits: Column, temperature: float | Column = 1.0) -> Column:
    """KL divergence of softmax(logits / temperature) from a profile; 0 log 0 counts as 0."""
    return let(F.transform(logits, lambda x: x / temperature), lambda scaled: total(F.zip_with(profile, log_softmax(scaled), lambda p, q: F.when(p > 0, p * (F.log(p) - q)).otherwise(0.0))))


def mask_bit(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", mask, place).bitwiseAND(F.lit(1)) == 1
