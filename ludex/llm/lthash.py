"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane modulo powers of two.  The sum doesn't depend on the
paragraphs' order, and adding or taking away a paragraph adds or takes away its vector.

Lanes, each modulo 2^60:
- ``EXACT`` lanes sum 60 bits each of the whole paragraph's SHA-256, 240 in all: equality;
- one lane counts the paragraph's pieces, runs of about two words that end at certain letters;
- ``PACKED`` lanes hold two 30-bit fields each, sums of hash bits of the pieces, exact for
  texts of fewer than 2^29 pieces.  Each bit is a fair coin, so the squared +-1 sums of a difference of two fingerprints average to the
  squared size of the multiset difference of their pieces.  That gives a likeness of two
  texts from their fingerprints alone.

Only DataFrame expressions are used: pieces are exploded and summed by plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parts, stored

EXACT = 4
PACKED = 64
FIELDS = 2 * PACKED
LANES = EXACT + 1 + PACKED
MOD = (1 << 60) - 1
_PAIR = 1 | 1 << 30  # two hash bits, each with 29 zero bits above: sums of 2^29 pieces don't meet
_SHIFTS = 30


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(MOD))


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, _add)


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of a's paragraphs without b's."""
    return F.zip_with(a, b, lambda x, y: (x - y + F.lit(MOD + 1)).bitwiseAND(F.lit(MOD)))


def as_text(fp: Column) -> Column:
    """Lower-case hex, 15 digits a lane."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 15, "0")), ""))


#: Paragraphs end at a line break; inside them a piece ends at white space after one of these
#: characters, so where pieces end depends on the words beside and not on their place.
PIECE_END = r"\s*\n\s*|(?<=[aeiouyns.,;:!?])[\x20\x09-\x0D]+"


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` without ``text`` but with its fingerprint, an array of ``LANES`` longs below
    2^60, as ``name``.  Null texts are empty: one empty paragraph, no piece.

    The other columns should be few and short: they go through the shuffle with the sums.
    """
    others = [c for c in rows.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    zero = F.lit(0).cast("long")

    def added(i):
        # a lane takes 15 hex digits of its own of the paragraph's digest
        return lambda acc, d: _add(acc, F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("long"))

    exact = {f"_x{i}": F.aggregate("_ds", zero, added(i)) for i in range(EXACT)}
    # the lanes of whole paragraphs are made before the explode, once a row
    pieces = (rows.select(*others, F.monotonically_increasing_id().alias("_row"),
                          F.transform(F.split(whole, "\n"), lambda p: F.sha2(p.cast("binary"), 256)).alias("_ds"), F.split(whole, PIECE_END).alias("_ps"))
              .select(*others, "_row", *[c.alias(n) for n, c in exact.items()], "_ps")
              .select(*others, "_row", *exact, F.explode_outer("_ps").alias("_p"))
              .select(*others, "_row", *exact, F.when(F.col("_p") != "", F.xxhash64("_p")).otherwise(zero).alias("_h0")))
    # an empty piece hashes to zeros, which add nothing
    turns = -(-PACKED // _SHIFTS)
    pieces = pieces.select("*", *[F.when(F.col("_h0") != 0, F.xxhash64("_h0", F.lit(t))).otherwise(zero).alias(f"_h{t}")
                                  for t in range(1, turns)])
    sums = [F.sum(F.shiftrightunsigned(F.col(f"_h{i // _SHIFTS}"), i % _SHIFTS).bitwiseAND(F.lit(_PAIR))).alias(f"_s{i}")
            for i in range(PACKED)]
    summed = pieces.groupBy("_row", *others, *exact).agg(F.sum((F.col("_h0") != 0).cast("long")).alias("_n"), *sums)

    # a sum of pairs is a lane as it stands
    packed = [F.col(f"_s{i}").bitwiseAND(F.lit(MOD)) for i in range(PACKED)]
    return summed.select(*others, F.array(*exact, F.col("_n"), *packed).alias(name))


def _signed_fields(lane: Column) -> Column:
    """The two signed 30-bit fields of a lane below 2^60, lowest first; a borrow goes on."""
    def low(x):
        v = x.bitwiseAND(F.lit((1 << 30) - 1))
        return F.when(v >= 1 << 29, v - (1 << 30)).otherwise(v)

    first = low(lane)
    return F.array(first, low(F.shiftright(lane - first, 30)))


def _pieces(fp: Column) -> Column:
    n = F.element_at(fp, EXACT + 1)
    return F.when(n >= F.lit(1 << 59), n - F.lit(1 << 60)).otherwise(n).cast("double")


def _norm(fp: Column) -> Column:
    """Estimated squared length of the vector of piece counts."""
    n = _pieces(fp)
    fields = F.flatten(F.transform(F.slice(fp, EXACT + 2, PACKED), _signed_fields))
    return F.aggregate(fields, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(2.0) * x - n, F.lit(2.0))) / FIELDS


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``, 0 to 1: cosine of the two texts' piece counts as the fingerprints tell
    it; 1 for equal fingerprints, 0 where only one of the texts has pieces."""
    done = rows.withColumn("_apart", minus(F.col(a), F.col(b)))
    done = done.withColumn("_na", _norm(F.col(a))).withColumn("_nb", _norm(F.col(b))).withColumn("_nd", _norm(F.col("_apart")))
    cosine = (F.col("_na") + F.col("_nb") - F.col("_nd")) / (F.lit(2.0) * F.sqrt(F.col("_na") * F.col("_nb")))
    value = (F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col("_na") == 0) | (F.col("_nb") == 0), F.lit(0.0))
             .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))))
    return done.withColumn(name, value).drop("_apart", "_na", "_nb", "_nd")


def _range_of(key: Column, cuts: list) -> Column:
    """How many cuts are at or below the key (a binary search); nulls are in range 0."""
    if not cuts:
        return F.lit(0)
    given = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.when(at + step <= len(cuts), F.element_at(given, F.least(at + step, F.lit(len(cuts)))) <= key).otherwise(F.lit(False)),
        at + step).otherwise(at))
    return F.coalesce(place, F.lit(0))


def key_cuts(rows: DataFrame, key: str, ranges: int) -> list:
    """At most ranges - 1 quantiles of a numeric key."""
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10000).alias("q")).first()
    return sorted(set(found["q"] or []))


def with_next(rows: DataFrame, key: str, columns: list[str], cuts: list) -> DataFrame:
    """``rows`` (key and columns) with ``next_<column>`` of the next row by (key, first column);
    the last row's next is the first (null keys first).  Adds ``_range`` and ``_at``, the
    row's number in its range: together they name a row.

    Each range of keys also gets a copy of the next range's first row, so one shuffle and a
    window inside each range do.
    """
    order = [F.col(key).asc_nulls_first(), columns[0]]
    dealt = rows.select(key, *columns, _range_of(F.col(key), cuts).alias("_range"))
    heads = dealt.groupBy("_range").agg(F.min(F.struct(key, *columns)).alias("h"))
    around = Window.orderBy("_range")
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag("_range").over(around), F.last("_range").over(every))
    copies = heads.withColumn("_to", to).select("h.*", F.col("_to").alias("_range"), F.lit(1).alias("_copy"))
    both = dealt.withColumn("_copy", F.lit(0)).unionByName(copies)
    inside = Window.partitionBy("_range").orderBy("_copy", *order)
    ahead = [F.lead(c).over(inside).alias(f"next_{c}") for c in columns]
    return both.select("*", F.row_number().over(inside).alias("_at"), *ahead).where("_copy = 0").drop("_copy")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    for every row; the edited text has its last quarter of code points replaced by as many of
    the next document's first.

    Null texts are empty (0 characters, nothing to replace).  Rows of one key are neighbours
    (by a hash of the text); a table of one row is its own next.  Equal texts have equal
    fingerprints, and so have texts whose paragraphs differ only in their order.  Other columns
    aren't read.  An empty table gives an empty result.  Keys are numeric.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("mark"), whole.alias("text"))
    cuts = key_cuts(given, "key", 4 * parts(docs.sparkSession))
    # the texts move once, to their neighbours; fingerprints of whole texts are made where they lie
    own = with_next(stored(with_fingerprint(given, "text", "f"), "paragraph-sums"), "key", ["mark", "f"], cuts)
    own = with_likeness(own.select("_range", "_at", "f", "next_f"), "f", "next_f", "near_next").drop("next_f")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = (with_next(given, "key", ["mark", "text"], cuts)
            .select("_range", "_at", "key", n.cast("long").alias("n_chars"), edited.alias("edited"))
            .select("*", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha")))
    both = with_likeness(with_fingerprint(rows, "edited", "e").join(own, ["_range", "_at"]), "f", "e", "near_edited")
    return both.select(F.col("key").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                       as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
                       "near_edited", "near_next")
