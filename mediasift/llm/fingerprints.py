"""One-permutation MinHash in built-in functions: one hash a shingle, bins, densification, packed bits.

The hash of a word shingle picks one of `BINS` bins by its top bits and competes for the least value in
it. An array of all hashes and one sentinel a bin is sorted once; the first value of each bin is its
minimum, or the sentinel if the bin is empty. An empty bin borrows by optimal densification: it probes
bins in a random order of its own until one has a value. Of each value the lowest four bits are packed;
likeness counts equal bins and takes off the share that agrees by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.base import let
from mediasift.llm.common import whole_text
from mediasift.operators.ranges import long_array, range_bounds, range_place

WORDS = 5
BINS = 256
BIN_BITS = 8
LOW_BITS = 4
#: Probes of an empty bin that are tabled; the probing goes on in a full random order after them.
PROBES = 16
#: Documents of a stretch of ids, which are put in order together.
STRETCH = 1_000

_REST = (1 << (64 - BIN_BITS)) - 1  # bits of a hash below its bin
_EACH = 64 // LOW_BITS  # bins in one packed long
_LOWEST = 0x1111111111111111


def _mixed(x: int) -> int:
    """A fixed 64-bit mixing of small numbers, for tables made by rule."""
    x = (x + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 27) * 0x94D049BB133111EB >> 31 & (1 << 33) - 1


def _words(text: Column) -> Column:
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t\n\\x0B\f\r]+"))


def _hashes(words: Column, shingle: int) -> Column:
    """One hash for each shingle; of fewer words, one of them all.

    Runs of words grow by pairing neighbours: hashes of runs of `k` words with those `k` words on, and
    single words at the end. Pairing hands both sides to the function; looking elements up costs more.
    """

    def paired(one: Column, other: Column) -> Column:
        return F.zip_with(one, other, lambda x, y: F.xxhash64(x, y))

    def grown(w: Column) -> Column:
        n = F.size(w)
        runs, length = w, 1
        while length < shingle:
            more = length if 2 * length <= shingle else 1
            left = n - (length + more) + 1
            other = runs if more == length else w
            runs = paired(F.slice(runs, F.lit(1), left), F.slice(other, F.lit(length + 1), left))
            length += more
        return runs

    few = F.array(F.xxhash64(F.array_join(words, " ")))
    return let(words, lambda w: F.when(F.size(w) < shingle, few).otherwise(grown(w)))


def shingle_hashes(text: Column, shingle: int = WORDS) -> Column:
    """Hashes of the word shingles of a text, repeats included; none for a text without words."""
    words = _words(text)
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_hashes(w, shingle)))


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_REST)) == F.lit(_REST)


def with_fingerprint(frame: DataFrame, text: str, out: str, shingle: int = WORDS) -> DataFrame:
    """`frame` with the packed fingerprint (array of longs) of a text column as `out`.

    A text without words, empty or null, has an empty array. Each step is a column of its own, so that
    no step is worked out more than once for a row.
    """
    words, ordered, least, low, filled = (f"__{out}_{k}" for k in ("words", "sorted", "least", "low", "filled"))
    sentinels = F.array(*[F.lit(((b - BINS // 2) << (64 - BIN_BITS)) | _REST) for b in range(BINS)])
    probes = F.array(*[F.array(*[F.lit(_mixed(b * PROBES + t) % BINS) for t in range(PROBES)]) for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)

    steps = frame.withColumn(words, _words(F.coalesce(F.col(text), F.lit(""))))
    steps = steps.withColumn(ordered, F.sort_array(F.concat(_hashes(F.col(words), shingle), sentinels)))
    other_bin = F.lit((1 << 63) - 1)  # the first value has no bin before it, so one that differs
    shifted = F.concat(F.array(other_bin), F.col(ordered))
    firsts = let(shifted, lambda s: F.filter(ordered, lambda x, i: bin_of(x.bitwiseXOR(F.get(s, i))) != 0))
    steps = steps.withColumn(least, firsts)
    steps = steps.withColumn(filled, let(F.col(least), lambda mins: F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: ~_empty(F.get(mins, i)))))

    def borrowed(mins: Column, i: Column) -> Column:
        tabled = F.get(F.filter(F.get(probes, i), lambda j: ~_empty(F.get(mins, j))), F.lit(0))
        later = F.array_min(F.transform(F.col(filled), lambda j: F.struct(F.xxhash64(i, j).alias("turn"), j.alias("bin"))))["bin"]
        # hashed with the bin's number, so that two borrowers of one value do not agree by the same chance
        return F.xxhash64(F.get(mins, F.coalesce(tabled, later)), i)

    some = F.lit((1 << LOW_BITS) - 1)
    low_of = lambda mins: F.transform(mins, lambda x, i: F.when(_empty(x), borrowed(mins, i)).otherwise(x).bitwiseAND(some))
    steps = steps.withColumn(low, let(F.col(least), low_of))
    packed = F.array(
        *[
            F.aggregate(F.slice(F.col(low), g * _EACH + 1, _EACH), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x))
            for g in range(BINS // _EACH)
        ]
    )
    none = F.size(words) == 0
    steps = steps.withColumn(out, F.when(none, F.array().cast("array<bigint>")).otherwise(packed))
    return steps.drop(words, ordered, least, low, filled)


def as_text(packed: Column) -> Column:
    """Hexadecimal digits of a fingerprint, one for each bin; none for a text without words."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, rid of the agreement of low bits by chance.

    Two texts without words are alike (1); one with and one without are not (0).
    """

    def unlike(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseAND(F.lit(_LOWEST)))

    differ = F.aggregate(F.zip_with(one, other, unlike), F.lit(0), lambda a, x: a + x)
    chance = 1.0 / (1 << LOW_BITS)
    share = (F.lit(1.0) - differ / F.lit(float(BINS)) - chance) / (1.0 - chance)
    both_empty, one_empty = F.size(one) + F.size(other) == 0, (F.size(one) == 0) | (F.size(other) == 0)
    return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def with_next(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Each row with `next_<c>` of the row that follows by descending `order`; the last has the first.

    `docs` has `order` (long, no nulls; ties fall by the carried columns). Stretches of the order are put
    in order apart, each with a copy of the row that heads the next one.
    """
    bounds = range_bounds(docs, order, STRETCH)
    if not bounds:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried}).limit(0)
    place = range_place(F.col(order), bounds)
    placed = docs.withColumn("__place", place)
    n = len(bounds)
    heads = F.get(long_array(bounds), F.col("__place")) == F.col(order)
    copies = F.when(
        heads,
        F.array(F.struct(F.col("__place").alias("at"), F.lit(0).alias("copy")), F.struct(F.pmod(F.col("__place") - 1, F.lit(n)).alias("at"), F.lit(1).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col("__place").alias("at"), F.lit(0).alias("copy"))))
    dealt = placed.withColumn("__deal", F.explode(copies)).withColumns({"__at": F.col("__deal.at"), "__copy": F.col("__deal.copy")})
    ordered = Window.partitionBy("__at").orderBy("__copy", F.col(order).desc(), *[F.col(c) for c in reversed(carried)])
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(ordered) for c in carried})
    return out.where("__copy = 0").drop("__place", "__deal", "__at", "__copy")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_chars, its edited text, and the fingerprints of its text, the edited
    text and the next document's.

    The edited text ends in the next document's beginning. Null texts count as empty; a null doc_id comes
    after all others; repeated rows follow one another; a sole document is its own next; an empty table
    gives no rows.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col("doc_id"), order.alias("order"), whole_text().alias("text"))
    following = with_next(with_fingerprint(texts, "text", "packed"), "order", ["text", "packed"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    pairs = following.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "packed", "next_packed")
    return with_fingerprint(pairs, "edited", "edited_packed")
