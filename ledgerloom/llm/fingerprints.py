"""Document fingerprints by winnowing, in DataFrame functions only.

1. Tokens: maximal runs without blanks; a Han, Kana or Hangul letter is a token of its own (such
   text has no blanks).  A token's value is the lower 31 bits of its CRC-32.
2. Rolling hashes: a gram of GRAM tokens has the value of a polynomial modulo 2^31 - 1.  Within
   runs of RUN grams the hash rolls: the new token comes in, the oldest goes out.  A gram's hash
   does not depend on where its run began.
3. Windows: of every WINDOW consecutive grams the smallest hash is taken, the rightmost where
   several are equal.  A print is a hash with its place (index of the gram's first token).

Match guarantee: two texts that share GRAM + WINDOW - 1 consecutive tokens have a print of the
same hash from there, and it lies at the same place in the shared passage.

``neighbour_fingerprints`` compares each document with an edited form of itself and with its
neighbour.  Order and neighbours come from ids and digests alone (a distributed rank); texts go
through one exchange by (doc_id, digest), which both sides of the join with the neighbours read.

Defined cases: a null text is the empty text; a text with fewer tokens than a gram is one gram, a
text with fewer grams than a window is one window; a text without tokens has no prints and the
fingerprint ``''``.  Two texts without prints are alike 1.0, a text with and one without 0.0.
Rows with a null doc_id come after all others; rows of one doc_id are ordered by digest; repeated
rows are one document of the order, and each of them gets its result.  A single document is its own
neighbour.  An empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_global_rank
from ..session import cut_lineage

GRAM = 4
WINDOW = 8
RUN = 32
BASE = 1_000_003
PRIME = 2 ** 31 - 1
_PLACE = 2 ** 31            # prints are hash * 2^31 + (2^31 - 1 - place): the smaller, the further right
#: letters of scripts that write without blanks, each a token of its own
_SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
_BLANKS = " \t\n\x0b\f\r"
_NULL_ID = -2 ** 63         # sorts after all others in descending order


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _upto(first: Column | int, last: Column) -> Column:
    """first..last as an array; empty when last < first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # only texts that have such letters pay for setting them apart
    apart = F.when(text.rlike(f"[{_SINGLE}]"), F.regexp_replace(text, f"([{_SINGLE}])", " $1 ")).otherwise(text)
    return _let(F.btrim(apart, F.lit(_BLANKS)), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{_BLANKS}]+")))


def token_values(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.crc32(t.cast("binary")).bitwiseAND(F.lit(PRIME)))


def _fold(values: Column) -> Column:
    """Polynomial hash of a whole short array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, t: F.pmod(h * BASE + t, F.lit(PRIME)))


def gram_hashes(values: Column, gram: int = GRAM, run: int = RUN) -> Column:
    """Rolling hash of every gram; of a shorter text the hash of all tokens."""
    out_of = pow(BASE, gram, PRIME)

    def roll(v: Column, first: Column) -> Column:
        """Hashes of the grams that begin at first, first + 1, ... (at most ``run``), 1-based."""
        def step(done: Column, i: Column) -> Column:
            rolled = F.element_at(done, -1) * BASE + F.element_at(v, i + (gram - 1)) - F.element_at(v, i - 1) * out_of
            return F.concat(done, F.array(F.pmod(rolled, F.lit(PRIME))))

        last = F.least(first + (run - 1), F.size(v) - (gram - 1))
        return F.aggregate(_upto(first + 1, last), F.array(_fold(F.slice(v, first, F.lit(gram)))), step)

    def grams(v: Column) -> Column:
        n = F.size(v)
        runs = F.sequence(F.lit(1), n - (gram - 1), F.lit(run))
        return (F.when(n >= gram, F.flatten(F.transform(runs, lambda a: roll(v, a))))
                .when(n > 0, F.array(_fold(v))).otherwise(F.array().cast("array<bigint>")))

    return _let(values, grams)


def window_minima(hashes: Column, window: int = WINDOW) -> Column:
    """Prints (packed hash and place) in order of place."""
    def minima(v: Column) -> Column:
        n = F.size(v)
        smallest = lambda i: F.least(*[F.get(v, i + j) for j in range(window)]) if window > 1 else F.get(v, i)
        each = F.transform(F.sequence(F.lit(0), n - window), smallest)
        return F.when(n >= window, F.array_distinct(each)).when(n > 0, F.array(F.array_min(v))).otherwise(v)

    packed = F.transform(hashes, lambda h, i: h * _PLACE + (_PLACE - 1 - i))
    return _let(packed, minima)


def prints(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    return window_minima(gram_hashes(token_values(text), gram), window)


def print_hashes(packed: Column) -> Column:
    """Distinct hashes of the prints."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, 31).cast("int")))


def fingerprint(packed: Column) -> Column:
    """``hash@place`` of all prints, in order of place, joined by blanks."""
    one = lambda p: F.concat(F.shiftright(p, 31).cast("string"), F.lit("@"),
                             (_PLACE - 1 - p.bitwiseAND(F.lit(_PLACE - 1))).cast("string"))
    return F.array_join(F.transform(packed, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _ring(keyed: DataFrame) -> DataFrame:
    """doc_id, digest of each document with those of the document before it (descending doc_id;
    the first is preceded by the last) and the length of what its head replaces there."""
    ranked = cut_lineage(with_global_rank(keyed.select("doc_id", "digest", "n_chars").distinct(),
                                          [F.col("doc_id").desc(), F.col("digest")], "rank"))
    documents = max(1, ranked.count())
    after = ranked.select(
        F.col("doc_id").alias("before_id"), F.col("digest").alias("before_digest"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("need"), F.pmod(F.col("rank") + 1, F.lit(documents)).alias("rank"))
    return ranked.join(after, "rank").select("doc_id", "digest", "before_id", "before_digest", "need")


def neighbour_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document in descending doc_id order; after the last comes the first."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text.alias("text"),
                        F.xxhash64(text).alias("digest"))
    ring = _ring(keyed.withColumn("n_chars", F.char_length("text")))
    # computed before the exchange, which both uses of ``dealt`` read (the same columns of it)
    dealt = keyed.withColumn("own", prints(F.col("text"), gram, window))
    heads = dealt.join(ring, ["doc_id", "digest"]).select(
        F.col("before_id").alias("doc_id"), F.col("before_digest").alias("digest"),
        F.left("text", F.col("need")).alias("head"), print_hashes(F.col("own")).alias("next_hashes"))
    pair = dealt.join(heads.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"])
    n_chars = F.char_length("text")
    pair = pair.withColumn("edited", F.concat(F.left("text", (n_chars - F.floor(n_chars / 3)).cast("int")), "head"))
    pair = pair.withColumns({"changed": prints(F.col("edited"), gram, window), "own_hashes": print_hashes(F.col("own"))})
    return pair.select(
        F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), n_chars.cast("long").alias("n_chars"),
        "edited", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), print_hashes(F.col("changed"))).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"))
