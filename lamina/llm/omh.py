"""Document fingerprints by Order MinHash.

The k-mers of a text are runs of `k` words, or of `letters` characters where its
words are over LONG characters on average (texts without blanks), numbered by
occurrence, so that the second of two equal ones is another k-mer. Each is hashed once; the hash's
value puts it into one of `bins` bins, and each bin selects its `width` least
k-mers, keeps them in text order and hashes the row: one component of the
signature. A component agrees when the same k-mers were selected in the same
order, so the likeness falls with edit distance, not only with the share of
common k-mers. Everything is array expressions over a text's words.

Edge cases: a null text is empty; a text under k words is one k-mer; an empty
text has only empty components, and two of these are alike; the next document
of a table's only row is the row itself; equal ids stand in the order of their
texts' hashes; null ids come last; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._session import partitions

K = 2
BINS = 32
WIDTH = 2
LETTERS = 8
LONG = 40
PLACE_BITS = 28
CODE_BITS = 30
LAST = (1 << 63) - 1
BLANKS = r"[\x20\x09-\x0D]+"


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))


def occurrence(packed: Column, x: Column, j: Column) -> Column:
    """How many entries before j have the same upper bits in a sorted array; found by halving steps, as equal ones are neighbours."""
    mine = F.shiftrightunsigned(x, PLACE_BITS)
    alike = lambda at: (at >= 0) & (F.shiftrightunsigned(F.get(packed, at), PLACE_BITS) == mine)
    steps = F.array(*[F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)])
    search = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.coalesce(alike(j - found - step), F.lit(False)), found + step).otherwise(found))
    return F.when(F.coalesce(alike(j - 1), F.lit(False)), search).otherwise(F.lit(0))


def signature(text: Column, k: int = K, bins: int = BINS, width: int = WIDTH, letters: int = LETTERS) -> Column:
    """Array of `bins` components, null where a bin is empty."""
    core = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(F.length(core) > 0, F.split(core, BLANKS)).otherwise(F.array().cast("array<string>"))
    place = (1 << PLACE_BITS) - 1
    code = (1 << CODE_BITS) - 1

    def grams(w: Column, k: int = k) -> Column:
        one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        packed = lambda i: F.shiftleft(F.shiftrightunsigned(one(i), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit(place)))
        last = F.greatest(F.size(w) - k, F.lit(0))
        return F.when(F.size(w) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), packed))).otherwise(F.array().cast("array<long>"))

    def numbered(s: Column) -> Column:
        # bin, code and place in one number: sorted, each bin's least codes come first
        def one(x: Column, j: Column) -> Column:
            h = F.xxhash64(F.shiftrightunsigned(x, PLACE_BITS), occurrence(s, x, j))
            bin_ = F.pmod(F.shiftrightunsigned(h, 40), F.lit(bins).cast("long"))
            head = F.shiftleft(bin_, CODE_BITS + PLACE_BITS)
            return head.bitwiseOR(F.shiftleft(h.bitwiseAND(F.lit(code)), PLACE_BITS)).bitwiseOR(x.bitwiseAND(F.lit(place)))

        return F.sort_array(F.transform(s, one))

    def least(s: Column) -> Column:
        bin_of = lambda x: F.shiftrightunsigned(x, CODE_BITS + PLACE_BITS)
        chosen = F.filter(s, lambda x, j: F.coalesce(bin_of(F.get(s, j - width)) != bin_of(x), F.lit(True)))
        turned = lambda x: F.shiftleft(bin_of(x), CODE_BITS + PLACE_BITS).bitwiseOR(F.shiftleft(bits(x, 0, PLACE_BITS), CODE_BITS)).bitwiseOR(bits(x, PLACE_BITS, CODE_BITS))
        return F.sort_array(F.transform(chosen, turned))  # bin, place, code: text order within a bin

    def components(t: Column) -> Column:
        bin_of = lambda x: F.shiftrightunsigned(x, CODE_BITS + PLACE_BITS)
        codes = lambda b: F.transform(F.filter(t, lambda x: bin_of(x) == b), lambda x: bits(x, 0, CODE_BITS))
        one = lambda b: bound(codes(b), lambda c: F.when(F.size(c) > 0, F.xxhash64(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)

    sparse = lambda w: F.length(core) > F.size(w) * LONG
    chosen = bound(words, lambda w: F.when(sparse(w), bound(F.split(core, ""), lambda x: grams(x, letters))).otherwise(grams(w)))
    return bound(bound(bound(chosen, numbered), least), components)


def written(sig: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits a component, a dash where it is empty."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that either text fills; 1 for two empty texts."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x == y).alias("same"), (x.isNotNull() | y.isNotNull()).alias("some")))

    def share(p: Column) -> Column:
        some = F.size(F.filter(p, lambda x: x["some"]))
        same = F.size(F.filter(p, lambda x: F.coalesce(x["same"], F.lit(False))))
        return F.when(some == 0, F.lit(1.0)).otherwise(same / some)

    return bound(pairs, share)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, signature and fingerprint of each text."""
    sig = signature(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(id_column, sig.alias("signature")).withColumn("fingerprint", written(F.col("signature")))


def with_next(rows: DataFrame, key: str, tie: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: that of the row next by (key, tie), the first row's for the last.

    Rows are dealt into key ranges of about equal size; the first key of each
    range is dealt to the range before as well, so ranges need not meet. The
    driver holds one key for each range.
    """
    n = partitions(rows.sparkSession)
    ends = rows.stat.approxQuantile("r_", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    ends = sorted({min(int(x), LAST) for x in ends})
    if ends:
        steps = [1 << b for b in range(len(ends).bit_length() - 1, -1, -1)]
        table = F.lit(ends)
        hop = lambda at, s: F.when((at + s <= len(ends)) & (F.coalesce(F.get(table, at + s - 1), F.lit(LAST)) <= F.col("r_")), at + s).otherwise(at)
        bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), hop)
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    first = dict(rows.groupBy("bucket").agg(F.min(key)).collect())  # one key for each range
    order = sorted(first)
    before = [0] * (len(ends) + 1)
    for i, b in enumerate(order):
        before[b] = order[i - 1]
    at = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    heads = F.col(key).isin(*first.values()) if first else F.lit(False)
    wrap = (F.col("bucket") == (order[0] if order else 0)).cast("int")
    ghost = F.struct(F.get(F.lit(before), F.col("bucket")).alias("b"), wrap.alias("wrap"), F.lit(True).alias("ghost"))
    placed = rows.withColumn("at", F.explode(F.when(heads, F.array(at, ghost)).otherwise(F.array(at))))
    w = Window.partitionBy(F.col("at.b")).orderBy(F.col("at.wrap"), F.col(key), F.col(tie))
    out = placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return out.where(~F.col("at.ghost")).drop("at", "bucket")


def compared(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edit by half the next one, and likenesses."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))
    rows = docs.select(key.alias("k"), F.xxhash64(body).alias("h"), key.cast("double").alias("r_"), body.alias("text"))
    rows = rows.withColumn("sig", signature(F.col("text")))
    rows = with_next(rows, "k", "h", ["text", "sig"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = rows.select("k", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig").withColumn("edited_sig", signature(F.col("edited")))
    return out.select(
        F.when(F.col("k") != LAST, F.col("k")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
