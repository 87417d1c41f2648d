"""Document fingerprints by weighted SimHash, and their search by permuted block tables; DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import drop, put
from marketloom.operators.prefix import number_rows

WORD = r"[^\x20\x09-\x0D]+"
BITS, RADIUS, BLOCKS = 64, 3, 5
LANE = 1 << 32


def term_hashes(text: Column) -> Column:
    """Hashes of the terms of a text: each lower-cased word with the word behind it, and the last word alone.

    A term that stands k times is hashed k times and so votes with weight k.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    # The outer function names the array, so that it is made once for a text and not again for each word.
    return F.element_at(F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))), 1)


def simhash(terms: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """(keys, fp, marks): the signed bits that the terms of each key vote for, and how many null terms the key has.

    A bit is 1 if over half of the votes set it; no terms give fingerprint 0. Two counters share a long: bits i and i + 32 of a hash are
    added in its halves, which hold four thousand million votes each.
    """
    sums = [F.sum(F.shiftrightunsigned(F.col(term), i).bitwiseAND(F.lit(LANE + 1))).alias(f"_s{i}") for i in range(BITS // 2)]
    counted = terms.groupBy(*keys).agg(F.count(term).alias("_n"), F.count_if(F.col(term).isNull()).alias("marks"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(BITS):
        votes = F.shiftrightunsigned(F.col(f"_s{i - 32}"), 32) if i >= 32 else F.col(f"_s{i}").bitwiseAND(F.lit(LANE - 1))
        bit = (1 << i) if i < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(votes * 2 > F.col("_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"), "marks")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) at ``radius`` or fewer differing bits.

    Of ``blocks`` blocks at least blocks - radius are equal. There is a table for each choice of so many blocks, keyed by their bits as if
    permuted to the front; pairs meet in some table and are kept from the first in which they do.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than differing bits")
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum(1 << k for k in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k"))
                                                for t, m in enumerate(tables)])).alias("e")).select("fp", "e.t", "e.k")
    a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t)) for t, m in enumerate(tables)])
    met = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= radius) & (F.col("t") == first))
    return met.select("a", "b")


def with_next(docs: DataFrame) -> DataFrame:
    """Distinct doc_id with next_id, the next larger one (after the largest the smallest), and half, half of the longest text in characters.

    A null id counts as larger than all others.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 2)).alias("half"))
    numbered, _ = put(number_rows(ids, [F.col("doc_id").asc_nulls_last()], "n"), "fingerprint-order")
    total = numbered.agg(F.max("n").alias("total"))
    after = numbered.join(F.broadcast(total)).select(F.col("doc_id").alias("before_id"), F.col("half").alias("need"), (F.col("n") % F.col("total") + 1).alias("n"))
    # before_id is the document whose edit takes the beginning of doc_id.
    return numbered.select("doc_id", "n").join(after, "n").select("doc_id", "before_id", "need")


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its edited text, and the order of the documents.

    The last half of the characters of a text (rounded down) is replaced by as many from the beginning of the next document, or all of it
    where it is shorter. Where the next number is repeated, the smallest beginning is taken.
    """
    order, _ = put(with_next(docs), "fingerprint-next")
    placed = docs.join(order, docs["doc_id"].eqNullSafe(order["doc_id"])).select(docs["doc_id"], docs["text"], "before_id", "need")
    heads = placed.groupBy("before_id").agg(F.min(F.left("text", F.col("need").cast("int"))).alias("head"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = docs.join(heads, docs["doc_id"].eqNullSafe(heads["before_id"]), "left").select(
        docs["doc_id"], docs["text"], F.concat(F.left(docs["text"], n - half), F.left(F.coalesce("head", F.lit("")), half)).alias("edited"))
    return out, order


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and near_docs of every row.

    near_docs is the number of other rows whose fingerprint differs in at most three bits. Null texts count as empty; texts without words
    have fingerprint 0. Repeated rows are rows of their own; where the next number is repeated, near_next is that of the nearest row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts, order = edited(rows)
    key = ["doc_id", "n_chars", "own", "edited_sha256"]
    narrow = texts.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("own"), F.sha2("edited", 256).alias("edited_sha256"),
                          "text", "edited")
    # One null term marks each row, so rows without terms stay and equal rows are counted.
    mark = F.array(F.lit(None).cast("long"))
    both = narrow.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    terms = both.select(*key, F.col("v.which").alias("which"), F.explode(F.concat(mark, term_hashes(F.col("v.t")))).alias("term"))
    voted = simhash(terms, [*key, "which"])
    told = voted.groupBy(*key).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"),
                                   F.max("marks").alias("copies"))
    told, _ = put(told, "fingerprints")
    # The shuffled texts are not read again.
    drop(docs.sparkSession)
    following = told.select(F.col("doc_id").alias("next_id"), F.col("fp").alias("next_fp")).distinct()
    link = order.select("before_id", F.col("doc_id").alias("next_id"))
    following = link.join(following, link["next_id"].eqNullSafe(following["next_id"])).groupBy("before_id").agg(F.collect_set("next_fp").alias("next_fps"))
    classes = told.groupBy("fp").agg(F.sum("copies").alias("copies"))
    pairs = near_pairs(classes.select("fp"))
    ends = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    around = ends.join(classes.select(F.col("fp").alias("other"), "copies"), "other").groupBy("fp").agg(F.sum("copies").alias("around"))
    counts = classes.join(around, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("near_docs"))
    out = told.join(following, told["doc_id"].eqNullSafe(following["before_id"]), "left").join(counts, "fp")
    nearest = F.array_max(F.transform("next_fps", lambda x: likeness(F.col("fp"), x)))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), nearest.alias("near_next"), "near_docs")
