"""Document fingerprints: SpotSigs.

At every occurrence of a common word (an anchor) the next ``CHAIN`` content
words form a signature; the set of a document's signatures is its fingerprint.
Sets are compared by Jaccard likeness.  Searching for near pairs divides the
sets by length, since likeness t needs lengths within a factor t, and looks only
at sets that share one of the few signatures a likeness of t cannot avoid.

Everything is DataFrame functions; each text is scanned once per fingerprint.

Defined results: null text is empty; a text with no complete chain has the
signature of all its words (of the bare text if it has no word), so equal texts
always have equal fingerprints; the next document of the last one is the first;
rows with equal ids follow each other in the order of their texts; null ids come
last; repeated rows give repeated rows; an empty table gives an empty table.
Extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the", "of", "and", "in", "that", "is", "with", "by", "for", "to", "it", "was",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "est", "pas", "dans",
    "der", "die", "das", "und", "zu", "den", "von", "ist", "mit", "nicht", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "una", "su", "para",
)
CHAIN = 2
#: Hexadecimal digits of a signature.
DIGITS = 8
THRESHOLD = 0.8
_NOT_WORD = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, output: str) -> DataFrame:
    """Adds ``output``: the sorted distinct signatures of column ``text``."""
    kept = df.columns
    words, anchors, content = f"_{output}_w", f"_{output}_a", f"_{output}_c"
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*kept, F.array_remove(F.split(lower, _NOT_WORD), "").alias(words))
    places = F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i))
    rows = rows.select(*kept, words, F.filter(places, lambda i: i.isNotNull()).alias(anchors),
                       F.filter(words, lambda w: ~w.isin(*ANCHORS)).alias(content))
    # the j-th anchor stands at place p behind j anchors, so behind p - j content words
    complete = F.filter(anchors, lambda p, j: p - j + CHAIN <= F.size(content))

    def signature(p: Column, j: Column) -> Column:
        chain = [F.get(F.col(content), p - j + k) for k in range(CHAIN)]
        return F.substring(F.md5(F.concat_ws(" ", F.get(F.col(words), p), *chain).cast("binary")), 1, DIGITS)

    whole = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    fallback = F.array(F.substring(F.md5(F.concat(F.lit("="), whole).cast("binary")), 1, DIGITS))
    found = F.array_sort(F.array_distinct(F.transform(complete, signature)))
    rows = rows.select(*kept, words, found.alias(output))
    return rows.select(*kept, F.when(F.size(output) > 0, F.col(output)).otherwise(fallback).alias(output))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures, "")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without counting where their lengths alone rule out ``threshold``."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    likeness = F.when(a == b, F.lit(1.0)).otherwise(shared / (shorter + longer - shared))
    return F.when(shorter < threshold * longer, F.lit(0.0)).otherwise(likeness)


def length_class(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets at ``threshold`` likeness lie in the same or in neighbouring classes."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def near_pairs(fingerprinted: DataFrame, signatures: str = "signatures", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) between distinct signature sets; documents with equal sets share one fingerprint.

    A set of n signatures must share one of its n - ceil(t n) + 1 rarest with any
    set of likeness t.  These go to the set's length class, and for probing to
    their own and the next shorter class; candidates meet by (class, signature).
    """
    sets = fingerprinted.select(F.col(signatures).alias("s")).distinct().withColumn("f", fingerprint(F.col("s")))
    counts = sets.select(F.explode("s").alias("x")).groupBy("x").count()
    ranked = (sets.select("f", F.explode("s").alias("x")).join(counts, "x")
              .groupBy("f").agg(F.array_sort(F.collect_list(F.struct("count", "x"))).alias("r")))
    n = F.size("r")
    needed = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")
    entries = ranked.select("f", n.alias("n"), F.explode(F.slice("r", F.lit(1), needed)["x"]).alias("x"))
    entries = entries.withColumn("c", length_class(F.col("n"), threshold))
    probes = entries.select(F.col("f").alias("a"), F.col("n").alias("na"), "x",
                            F.explode(F.array("c", F.col("c") - 1)).alias("c"))
    index = entries.select(F.col("f").alias("b"), F.col("n").alias("nb"), "x", "c")
    before = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    fits = F.col("nb") >= F.lit(threshold) * F.col("na")
    found = probes.join(index, ["c", "x"]).filter(before & fits).select("a", "b").distinct()
    left = sets.select(F.col("f").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("f").alias("b"), F.col("s").alias("sb"))
    scored = found.join(left, "a").join(right, "b")
    scored = scored.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), threshold).alias("likeness"))
    return scored.filter(F.col("likeness") >= threshold)


def _bucketed(docs: DataFrame, id_column: str, buckets: int) -> DataFrame:
    """Adds ``bucket``: ranges of ids of nearly equal counts, rising with the id; -1 for null ids."""
    points = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(docs.approxQuantile(id_column, points, 1 / (4 * buckets)))) if buckets > 1 else []
    number = docs.withColumn("_number", F.col(id_column).cast("double"))
    ranges = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    found = ranges.transform(number)
    bucket = F.when(F.col(id_column).isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int"))
    return found.withColumn("bucket", bucket).drop("_number", "_bucket")


def compare_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, by falling id.

    The last half of the edited text's characters are replaced by the first ones
    of the next document.  Ids are cut into ranges; each row goes to its range,
    and the first of a range also to the range before it, as a guest that only
    serves as the next document there.  So texts are shuffled once and no task
    sees more than a range.
    """
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = _bucketed(docs, "doc_id", buckets)
    # one row per range
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    places = Window.orderBy("bucket")
    lowest = F.min("bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("visits", F.coalesce(F.lead("bucket").over(places), lowest))
    rows = docs.join(F.broadcast(heads), "bucket")
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    visit = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.struct(F.col("visits").alias("b"), F.lit(1).alias("guest")))
    rows = rows.select("doc_id", "text", F.explode(F.filter(F.array(own, visit), lambda v: v.isNotNull())).alias("at"))
    rows = rows.select("doc_id", "text", "at.b", "at.guest")
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "b", "guest", "place", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = with_signatures(rows, "text", "signatures").drop("text")
    rows = with_signatures(rows, "edited", "edited_signatures")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    following = F.lead("signatures").over(Window.partitionBy("b").orderBy("place"))
    return rows.withColumn("next_signatures", following).filter(F.col("guest") == 0).drop("b", "guest", "place")


def sql(table: str = "documents") -> str:
    """The same comparison as SQL over ``table``, for checking."""
    anchors = "[" + ", ".join(f"'{a}'" for a in ANCHORS) + "]"

    def sigs(source: str, text: str) -> str:
        chain = ", ".join(f"c[p - j + {k + 1}]" for k in range(CHAIN))
        return f"""
    SELECT key, {text} AS body, w, CASE WHEN len(s) > 0 THEN s ELSE
        [substr(md5('=' || CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE {text} END), 1, {DIGITS})] END AS s
    FROM (SELECT *, list_sort(list_distinct(list_transform(list_filter(list_transform(a, lambda p, j: {{'p': p, 'j': j}}),
              lambda q: q.p - q.j + {CHAIN} <= len(c)),
              lambda q: substr(md5(concat_ws(' ', w[q.p], {chain.replace('p - j', 'q.p - q.j')})), 1, {DIGITS})))) AS s
      FROM (SELECT *, list_filter(w, lambda x: NOT list_contains({anchors}, x)) AS c,
              list_filter(range(1, len(w) + 1), lambda i: list_contains({anchors}, w[i])) AS a
        FROM (SELECT *, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
          FROM {source})))"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS key FROM {table}),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY key), first_value(text) OVER (ORDER BY key)) AS next,
        CASE WHEN key = max(key) OVER () THEN 1 ELSE key + 1 END AS next_key, length(text) // 2 AS half FROM d),
e AS (SELECT *, substr(text, 1, (length(text) - half)::BIGINT) || substr(next, 1, half::BIGINT) AS edited FROM n),
own AS ({sigs('d', 'text')}),
ed AS ({sigs('e', 'edited')})
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(own.s, '') AS fingerprint,
  array_to_string(ed.s, '') AS edited_fingerprint,
  len(list_intersect(own.s, ed.s)) / (len(own.s) + len(ed.s) - len(list_intersect(own.s, ed.s)))::DOUBLE AS near_edited,
  len(list_intersect(own.s, nx.s)) / (len(own.s) + len(nx.s) - len(list_intersect(own.s, nx.s)))::DOUBLE AS near_next
FROM e JOIN own USING (key) JOIN ed USING (key) JOIN own nx ON nx.key = e.next_key"""
