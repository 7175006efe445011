"""Cleaning of genotype matrices, all maps at once.

Markers: map, input_ord, chromosome, coordinate, snp_name, genotypes (one character an individual; A and B are
informative, all else is missing). Strings shorter than the map's longest are missing beyond their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import allele_balance, n_a, n_b, sample_id, whole
from ..params import CleaningParams
from ..sources.shared import stored

KEYS = ["map", "chromosome", "coordinate", "snp_name"]


def required(raw: DataFrame, p: CleaningParams = CleaningParams()) -> DataFrame:
    """Rows with all fields (chromosome not 0, coordinate may be 0) and a genotype string that is long enough."""
    rows = raw.withColumns({"chromosome": whole(F.col("chromosome")).cast("int"), "coordinate": whole(F.col("coordinate"))})
    named = (F.coalesce(F.col("map"), F.lit("")) != "") & (F.coalesce(F.col("snp_name"), F.lit("")) != "")
    rows = rows.filter(named & F.col("genotypes").isNotNull() & (F.coalesce(F.col("chromosome"), F.lit(0)) != 0) & F.col("coordinate").isNotNull())
    return rows.filter(F.length("genotypes") > p.min_raw_length)


def with_counts(markers: DataFrame, genotypes: str = "genotypes") -> DataFrame:
    """n_a, n_b and n_informative of each marker."""
    rows = markers.withColumns({"n_a": n_a(F.col(genotypes)), "n_b": n_b(F.col(genotypes))})
    return rows.withColumn("n_informative", F.col("n_a") + F.col("n_b"))


def deduplicate(markers: DataFrame) -> DataFrame:
    """Per (map, chromosome, coordinate) the marker with most informative genotypes, then fewest others, then the
    greatest name, then the first in input order."""
    rows = with_counts(markers)
    best = F.struct(F.col("n_informative").alias("i"), (F.col("n_informative") - F.length("genotypes")).alias("o"), F.col("snp_name"), (-F.col("input_ord")).alias("r"), F.col("genotypes"))
    top = rows.groupBy("map", "chromosome", "coordinate").agg(F.max(best).alias("b"))
    return top.select("map", "chromosome", "coordinate", "b.snp_name", "b.genotypes", (-F.col("b.r")).alias("input_ord"))


def sample_missingness(deduplicated: DataFrame) -> DataFrame:
    """map, sample_idx, total, missing, missingness. Characters are counted map-side before the shuffle."""
    chars = deduplicated.select("map", F.posexplode(F.split("genotypes", "")).alias("sample_idx", "g"))
    seen = chars.groupBy("map", "sample_idx").agg(F.count_if(F.col("g").isin("A", "B")).alias("informative"))
    total = deduplicated.groupBy("map").agg(F.count("*").alias("total"))
    rows = seen.join(total, "map").withColumn("missing", F.col("total") - F.col("informative"))
    return rows.select("map", "sample_idx", "total", "missing", (F.col("missing") / F.col("total")).alias("missingness"))


def kept_samples(missingness: DataFrame, p: CleaningParams = CleaningParams()) -> DataFrame:
    """map, kept: the sorted sample indices that stay. One row per map; maps that lose all have none."""
    ok = F.when(F.col("missingness") <= p.max_sample_missing, F.col("sample_idx"))
    return missingness.groupBy("map").agg(F.array_sort(F.collect_list(ok)).alias("kept"), F.count("*").alias("n_samples"))


def renumbered(kept: DataFrame) -> DataFrame:
    """map, sample_idx, dense_idx, sample_id: samples numbered anew in the order of those kept."""
    rows = kept.select("map", F.posexplode("kept").alias("dense_idx", "sample_idx"))
    return rows.select("map", "sample_idx", "dense_idx", sample_id(F.col("map"), F.col("dense_idx")).alias("sample_id"))


def subset(genotypes: Column, kept: Column) -> Column:
    """The kept samples' characters; ``-`` beyond the string's end."""
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.nullif(F.substring(genotypes, i + 1, F.lit(1)), F.lit("")), F.lit("-"))), "")


def marker_metrics(deduplicated: DataFrame, kept: DataFrame) -> DataFrame:
    """Each marker with ``own`` (kept samples' genotypes), missingness (1 without samples) and balance."""
    rows = deduplicated.join(kept.select("map", "kept"), "map").withColumn("own", subset(F.col("genotypes"), F.col("kept")))
    rows = with_counts(rows, "own")
    n = F.length("own")
    return rows.withColumns({"missingness": F.when(n == 0, 1.0).otherwise((n - F.col("n_informative")) / n), "balance": allele_balance(F.col("n_a"), F.col("n_b"))}).drop("kept")


def _flip_rate(left: Column, own: Column, right: Column) -> Column:
    """Among samples whose neighbours agree, the share that differs from them."""
    chars = lambda s: F.split(s, "")
    known = lambda x: (x == "A") | (x == "B")
    agreed = F.zip_with(chars(left), chars(right), lambda a, b: F.when((a == b) & known(a), a))
    odd = F.zip_with(agreed, chars(own), lambda a, m: F.when(a.isNotNull() & known(m), F.when(a == m, 0).otherwise(1)))
    supported = F.size(F.filter(odd, lambda x: x.isNotNull()))
    return F.when(supported > 0, F.size(F.filter(odd, lambda x: x == 1)) / supported).otherwise(0.0)


def isolated_flips(markers: DataFrame) -> DataFrame:
    """``flip_rate`` of each marker against its neighbours in the map's order, over all samples.

    Neighbours may lie on the next chromosome; a small table of each chromosome's ends has them, so the sort is
    per (map, chromosome).
    """
    by = ["coordinate", "snp_name"]
    place = F.struct(*by, "genotypes")
    ends = markers.groupBy("map", "chromosome").agg(F.min(place)["genotypes"].alias("head"), F.max(place)["genotypes"].alias("tail"))
    along = Window.partitionBy("map").orderBy("chromosome")
    ends = ends.select("map", "chromosome", F.lag("tail").over(along).alias("before"), F.lead("head").over(along).alias("behind"))
    w = Window.partitionBy("map", "chromosome").orderBy(*by)
    rows = markers.join(ends, ["map", "chromosome"])
    left, right = F.coalesce(F.lag("genotypes").over(w), "before"), F.coalesce(F.lead("genotypes").over(w), "behind")
    rows = rows.withColumns({"_l": left, "_r": right}).drop("before", "behind")
    return rows.withColumn("flip_rate", F.when(F.col("_l").isNull() | F.col("_r").isNull(), 0.0).otherwise(_flip_rate(F.col("_l"), F.col("genotypes"), F.col("_r")))).drop("_l", "_r")


def staged(markers: DataFrame, p: CleaningParams = CleaningParams()) -> tuple[DataFrame, DataFrame]:
    """(deduplicated markers with ``stage`` missing, balance, flip or final; kept samples per map).

    The flip rate is over the markers that the filters before it leave. What is read several times is stored.
    """
    dedup = stored(deduplicate(markers), "deduplicated")
    kept = stored(kept_samples(sample_missingness(dedup), p), "kept")
    rows = marker_metrics(dedup, kept)
    balanced = F.coalesce(F.col("balance").between(p.min_balance, p.max_balance), F.lit(False))
    rows = rows.withColumn("stage", F.when(F.col("missingness") > p.max_marker_missing, "missing").when(~balanced, "balance"))
    rows = stored(rows, "metrics")
    left = isolated_flips(rows.filter("stage is null"))
    left = left.withColumn("stage", F.when(F.col("flip_rate") > p.max_isolated_flip, "flip").otherwise("final"))
    gone = rows.filter("stage is not null").withColumn("flip_rate", F.lit(None).cast("double"))
    return gone.unionByName(left), kept


def final(rows: DataFrame) -> DataFrame:
    """Of the staged markers those that stay: map, chromosome, coordinate, snp_name and the kept samples' genotypes."""
    return rows.filter("stage = 'final'").select(*KEYS, F.col("own").alias("genotypes"))


def clean(markers: DataFrame, p: CleaningParams = CleaningParams()) -> DataFrame:
    """Final markers."""
    return final(staged(markers, p)[0])


def qc_summary(markers: DataFrame, rows: DataFrame, kept: DataFrame, events: DataFrame) -> DataFrame:
    """One row per map, of the markers, what ``staged`` gives of them, and the events called; input = deduplicated +
    duplicates, deduplicated = missing + balance + flip + final."""
    of = lambda s: F.count_if(F.col("stage") == s).cast("int")
    stages = rows.groupBy("map").agg(F.count("*").cast("int").alias("deduplicated_markers"), of("missing").alias("removed_markers_missingness"), of("balance").alias("removed_markers_allele_balance"), of("flip").alias("removed_markers_isolated_flip"), of("final").alias("final_markers"))
    total = markers.groupBy("map").agg(F.count("*").cast("int").alias("input_markers"))
    found = events.groupBy("map").agg(F.count("*").cast("int").alias("hmm_events"))
    out = total.join(stages, "map").join(kept, "map").join(found, "map", "left")
    return out.select("map", "input_markers", "deduplicated_markers", (F.col("input_markers") - F.col("deduplicated_markers")).alias("removed_duplicate_markers"), F.col("n_samples").cast("int").alias("input_samples"), F.size("kept").alias("kept_samples"), (F.col("n_samples") - F.size("kept")).cast("int").alias("removed_samples_missingness"), "removed_markers_missingness", "removed_markers_allele_balance", "removed_markers_isolated_flip", "final_markers", F.coalesce("hmm_events", F.lit(0)).alias("hmm_events"))
