"""Answers compared with reviewed ones, runs with runs, and items with what was filed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import wording as W
from paperloom.operators import simhash

#: Words of a type that carry no meaning; quotation marks that count as plain ones (fixed values).
UNMEANT = ["the", "and", "for", "with"]
QUOTES = ("|‘’‚‛“”„‟", " ''''\"\"\"\"")
#: Records without an answer to score (fixed values).
UNSCORABLE = ["stale", "unrecorded", "pending"]


def type_matches(gold: Column, actual: Column) -> Column:
    """Does a type carry every meaningful word of the reviewed one?"""
    words = F.filter(F.split(F.lower(gold), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(UNMEANT))
    return F.forall(words, lambda w: F.lower(actual).contains(w))


def plain_name(c: Column) -> Column:
    """A name in small letters without punctuation, single blanks between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def party_matches(gold: Column, actual: Column) -> Column:
    """Does one of two names hold the other, punctuation aside?"""
    a, b = plain_name(gold), plain_name(actual)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def judged_parties(df: DataFrame, key: str, gold: str, produced: str) -> DataFrame:
    """key, matched, expected, spurious of two arrays of names; nulls are empty arrays."""
    g, p = F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(produced, F.array().cast("array<string>"))
    matched = F.size(F.filter(g, lambda x: F.exists(p, lambda y: party_matches(x, y))))
    spurious = F.size(F.filter(p, lambda y: ~F.exists(g, lambda x: party_matches(x, y))))
    return df.select(key, matched.alias("matched"), F.size(g).alias("expected"), spurious.alias("spurious"))


def comparable(c: Column) -> Column:
    """A text as its reading is compared: bars as blanks, quotation marks plain, single blanks."""
    return F.trim(F.regexp_replace(F.translate(c, *QUOTES), r"[\s\x0B\p{Z}]+", " "))


def moved(values: DataFrame, metrics: DataFrame) -> DataFrame:
    """values (metric, was, now_is) with ``better``: true or false beyond the tolerance of a metric, null within it; only metrics of the table (metric, tolerance, lower_is_better) are held."""
    gain = F.when(F.col("lower_is_better"), F.col("was") - F.col("now_is")).otherwise(F.col("now_is") - F.col("was"))
    verdict = F.when(gain < -F.col("tolerance") - 1e-9, False).when(gain > F.col("tolerance") + 1e-9, True)
    return values.join(F.broadcast(metrics), "metric").select(*values.columns, verdict.alias("better"))  # metrics are a short list


def short_of_reduction(pages: Column, digest_tokens: Column, context_tokens: Column) -> Column:
    """Does a document of ten pages or more keep over six tenths of a digest of a hundred tokens or more?"""
    return (pages >= 10) & (digest_tokens >= 100) & (context_tokens * 10 > digest_tokens * 6)


def loses(context: Column, digest: Column) -> Column:
    """Does the context carry less than the digest? Not if either is unknown."""
    return F.coalesce(context < digest, F.lit(False))


def violates(digest: Column, *contexts: Column) -> Column:
    """Does a digest carry all and the context miss some?"""
    missed = F.lit(False)
    for c in contexts:
        missed = missed | F.coalesce(c < 1.0, F.lit(False))
    return F.coalesce(digest == 1.0, F.lit(False)) & missed


def ranked_configs(configs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """keys, place: configurations by several figures, the most important first; a configuration list is short."""
    return configs.select(*keys, F.row_number().over(Window.orderBy(*order)).alias("place"))


def citation_scores(cited: DataFrame, known: DataFrame, key: str, on: list[str]) -> DataFrame:
    """key, cited, unknown, rate: how many citations of an answer lead to something known; no rate without citations."""
    found = cited.select(key, *on).distinct().join(known.select(*on).distinct().withColumn("there", F.lit(True)), on, "left")
    return found.groupBy(key).agg(F.count("*").alias("cited"), F.count(F.when(F.col("there").isNull(), 1)).alias("unknown")).withColumn("rate", (F.col("cited") - F.col("unknown")) / F.col("cited"))


def same_document(distance: Column, filed_name: Column, date: Column, most: int = 6) -> Column:
    """Are two near texts one document? Their dates settle it where both have one, else only a distance of one bit."""
    filed = W.leading_date(filed_name)
    return (distance <= most) & F.when(filed.isNotNull() & date.isNotNull(), filed == date).otherwise(distance <= 1)


def newest_of_kinds(df: DataFrame, key: str, order: str, kinds: dict[str, Column]) -> DataFrame:
    """key and the newest ``order`` of each kind, in one pass; null where there is none."""
    return df.groupBy(key).agg(*[F.max(F.when(c, F.col(order))).alias(n) for n, c in kinds.items()])


def first_spellings(names: Column, key) -> Column:
    """Names without those whose key an earlier name has; blank names are dropped, the order is kept."""
    kept = F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$", "")), lambda x: x != "")
    keys = F.transform(kept, key)
    return F.filter(kept, lambda x, k: F.array_position(keys, key(x)) == k + 1)


def staged_copies(files: DataFrame, key: str, content: str, name: str) -> DataFrame:
    """key, original, staged: files whose content an earlier one (by key) has, with the name that says so."""
    first = files.groupBy(content).agg(F.min(key).alias("original"))
    return files.join(first, content).where(F.col(key) != F.col("original")).select(key, "original", F.concat(F.lit("COPY - "), name).alias("staged"))


def selected(df: DataFrame, key: str, only: list[str]) -> DataFrame:
    """The rows of the keys named; a key that no row has is an error."""
    found = df.where(F.col(key).isin(only))
    missing = set(only) - {r[0] for r in found.select(key).distinct().collect()}  # at most as many as were named
    if missing:
        raise ValueError(f"no such {key}: {', '.join(sorted(map(str, missing)))}")
    return found


def paths_overlap(a: Column, b: Column) -> Column:
    """Does one path lie in the other, whatever their case?"""
    x, y = (F.concat(F.regexp_replace(F.lower(F.translate(p, "\\", "/")), "/+$", ""), F.lit("/")) for p in (a, b))
    return x.startswith(y) | y.startswith(x)


def searched(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that hold a text in one of their columns, whatever its case; an empty text finds all."""
    hit = F.lit(query.strip() == "")
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.strip().lower()), F.lit(False))
    return df.where(hit)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows but those of the keys that are gone; rows without a key stay."""
    return df.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def orphans(claims: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Claims whose item isn't there."""
    return claims.join(items.select(key).distinct(), key, "left_anti")


def filed_by_hash(files: DataFrame, filed: DataFrame, key: str, content: str) -> DataFrame:
    """key and ``marker``: what was filed with the same content; hashes that aren't 32 to 128 small hexadecimal digits find nothing."""
    valid = F.when(F.col(content).rlike("^[0-9a-f]{32,128}$"), F.col(content))
    markers = filed.groupBy(content).agg(F.min("marker").alias("marker"))
    return files.select(key, valid.alias(content)).join(markers, content, "left").select(key, "marker")


def nearest_filed(prints: DataFrame, filed: DataFrame, id_col: str, within: int = 6) -> DataFrame:
    """id, marker, distance: the nearest filed fingerprint within a distance; the least marker wins where several are as near."""
    own = prints.where("fingerprint IS NOT NULL").select(id_col, "fingerprint")
    markers = filed.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("marker").alias("marker"))
    both = own.select(F.lit(None).cast("string").alias("k"), "fingerprint").unionByName(markers.select(F.lit(None).cast("string").alias("k"), "fingerprint"))
    pairs = simhash.near_classes(both, "k", within)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("fingerprint_a").alias("a"), F.col("fingerprint_b").alias("b")), F.struct(F.col("fingerprint_b").alias("a"), F.col("fingerprint_a").alias("b")))).alias("e"), "distance").select("e.*", "distance")
    near = ends.unionByName(markers.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"), F.lit(0).alias("distance")))
    found = near.join(markers.withColumnRenamed("fingerprint", "b"), "b").groupBy("a").agg(F.min(F.struct("distance", "marker")).alias("best"))
    return own.join(found.withColumnRenamed("a", "fingerprint"), "fingerprint").select(id_col, "best.marker", "best.distance")


def flattened(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row for each figure that a row has."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("p")).where("p.value IS NOT NULL").select(*keys, "p.metric", "p.value")


def present(seen: DataFrame, key: str, at: str, seconds: int = 600) -> DataFrame:
    """key, last, active: when each was last seen, and whether that is no longer than some seconds before the newest of all."""
    last = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias("last"))
    newest = F.broadcast(last.agg(F.max("last").alias("newest")))  # one row
    age = F.unix_timestamp(F.col("newest").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.crossJoin(newest).select(key, "last", (age <= seconds).alias("active"))
