"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import genmap, genotypes, hmm, intervals, liftover, marey, profile, sampling, switches
from ..params import ProfileParams, SimulationParams
from ..sources.shared import stored
from . import adapters as A

PROFILE = ProfileParams(bin_size=100, flanking_bp=1000, body_bins=25)
UNIFORM = replace(PROFILE, uniform=True)
EVENT_GAP = 86_400_000
SIMULATION = SimulationParams()
N_REGIONS = SIMULATION.regions

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _found[f.__name__] = f
    return f


# ---- genotypes -------------------------------------------------------------------------------------------------


@query
def marker_required_filter(spark, d):
    return genotypes.required(A.messy_markers(spark, d)).select("map", "input_ord", "chromosome", "coordinate", "snp_name", "genotypes")


@query
def informative_counts(spark, d):
    return genotypes.with_counts(A.markers(spark, d)).select("map", "snp_name", "n_a", "n_b", "n_informative")


@query
def dedup_markers(spark, d):
    return genotypes.deduplicate(A.markers(spark, d)).select("map", "chromosome", "coordinate", "snp_name", "genotypes")


@query
def sample_missingness(spark, d):
    return genotypes.sample_missingness(genotypes.deduplicate(A.markers(spark, d)))


def _kept(spark, d):
    dedup = genotypes.deduplicate(A.markers(spark, d))
    return dedup, genotypes.kept_samples(genotypes.sample_missingness(dedup))


@query
def sample_renumber(spark, d):
    return genotypes.renumbered(_kept(spark, d)[1])


@query
def subset_markers(spark, d):
    dedup, kept = _kept(spark, d)
    return genotypes.marker_metrics(dedup, kept).select("map", "chromosome", "coordinate", "snp_name", F.col("own").alias("genotypes"))


@query
def marker_missingness(spark, d):
    dedup, kept = _kept(spark, d)
    return genotypes.marker_metrics(dedup, kept).select("map", "snp_name", "missingness")


@query
def allele_balance(spark, d):
    dedup, kept = _kept(spark, d)
    return genotypes.marker_metrics(dedup, kept).select("map", "snp_name", "balance")


@query
def isolated_flip(spark, d):
    return genotypes.isolated_flips(genotypes.deduplicate(A.markers(spark, d))).select("map", "snp_name", "flip_rate")


@query
def clean_markers(spark, d):
    return genotypes.clean(A.markers(spark, d))


def _events(spark, d):
    return hmm.call_events(genotypes.clean(A.markers(spark, d)))


@query
def qc_summary(spark, d):
    markers = A.markers(spark, d)
    rows, kept = (stored(t, "cleaning") for t in genotypes.staged(markers))
    return genotypes.qc_summary(markers, rows, kept, hmm.call_events(genotypes.final(rows)))


# ---- model and calls -------------------------------------------------------------------------------------------


@query
def transition_prob(spark, d):
    from pyspark.sql import Window

    rows = genotypes.deduplicate(A.markers(spark, d)).select("map", "chromosome", "snp_name", "coordinate")
    w = Window.partitionBy("map", "chromosome").orderBy("coordinate")
    rows = rows.withColumn("distance", F.col("coordinate") - F.lag("coordinate").over(w)).filter("distance is not null")
    return rows.select("map", "snp_name", "distance", S.switch_probability(F.col("distance")).alias("probability"))


@query
def emission_log_prob(spark, d):
    rows = A.markers(spark, d).select(F.explode(F.split("genotypes", "")).alias("observed")).groupBy("observed").agg(F.count("*").alias("n"))
    return rows.select("observed", "n", F.round(S.emission(0, F.col("observed")), 12).alias("in_a"), F.round(S.emission(1, F.col("observed")), 12).alias("in_b"))


def _paths(spark, d):
    return hmm.viterbi(genotypes.clean(A.markers(spark, d)))


@query
def viterbi_path(spark, d):
    return hmm.path_strings(_paths(spark, d))


@query
def state_change_events(spark, d):
    return hmm.state_changes(_paths(spark, d))


@query
def hmm_co_events(spark, d):
    return _events(spark, d)


@query
def collapse_close_pairs(spark, d):
    return hmm.collapse_close_pairs(A.event_points(spark, d), ["sample", "chrom"], "bp", EVENT_GAP)


@query
def switch_calls_raw(spark, d):
    return switches.raw_calls(A.markers(spark, d))


@query
def switch_runs(spark, d):
    return switches.runs(A.markers(spark, d))


@query
def switch_calls_filtered(spark, d):
    return switches.filtered_calls(A.markers(spark, d))


@query
def marey_curve(spark, d):
    return marey.marey_curve(_events(spark, d))


@query
def marey_samples(spark, d):
    return marey.samples_per_chromosome(_events(spark, d))


# ---- intervals -------------------------------------------------------------------------------------------------

_WIDTH = 6 * 3600 * 1_000_000  # microseconds to a stretch of the event intervals


@query
def merge_intervals(spark, d):
    return intervals.merge_intervals(A.intervals(spark, d), width=_WIDTH)


@query
def subtract_intervals(spark, d):
    iv = A.intervals(spark, d)
    return intervals.subtract_intervals(iv.filter("event_id % 3 <> 0"), iv.filter("event_id % 3 = 0"), _WIDTH)


@query
def exclusive_partitions(spark, d):
    iv = A.intervals(spark, d).withColumn("class", F.expr("case user_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end"))
    return intervals.exclusive_partitions(iv, ["a", "b", "c"], _WIDTH)


@query
def gene_classes(spark, d):
    return sampling.gene_classes(A.region_genes(spark, d), A.region_lengths(spark, d))


def _partitions(spark, d):
    return sampling.gene_partitions(A.region_genes(spark, d), A.region_lengths(spark, d))


@query
def gene_partitions(spark, d):
    return _partitions(spark, d)


@query
def interval_clip(spark, d):
    return intervals.clip(A.signal(spark, d), 1_000_000, 3_000_000)


@query
def endpoint_explode(spark, d):
    return intervals.endpoints(A.signal(spark, d).filter("end > start"))


def _scattered(spark, d):
    """End points of which some are lost, doubled or on another chromosome."""
    iv = A.map_intervals(spark, d).withColumnRenamed("marker", "id")
    rows = intervals.endpoints(iv).withColumn("h", F.substring(F.md5("id"), 1, 1))
    first = F.col("start") % 2 == 0
    rows = rows.filter(~((F.col("h") == "0") & first))
    rows = rows.withColumn("chrom", F.when((F.col("h") == "1") & first, "other").otherwise(F.col("chrom")))
    twice = F.when((F.col("h") == "2") & first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(twice)).select("chrom", "start", "end", "sample", "id")


@query
def rebuild_intervals(spark, d):
    return intervals.rebuild_intervals(_scattered(spark, d))


@query
def liftover_points(spark, d):
    pts = intervals.endpoints(A.signal(spark, d).filter("end > start").withColumnRenamed("chr", "chrom")).drop("value")
    return liftover.lift_points(pts, A.chain_blocks(spark))


# ---- profiles --------------------------------------------------------------------------------------------------


def _bounded(spark, d):
    return profile.flank_bounds(A.stranded_genes(spark, d), PROFILE.flanking_bp)


@query
def gene_flank_bounds(spark, d):
    return _bounded(spark, d).select("input_ord", "chr", "prev_end", "next_start", "low", "high")


@query
def tumbling_bins(spark, d):
    rows = profile.tumbling_bins(A.stranded_genes(spark, d), 1000)
    return rows.select("input_ord", "bin", "left_start", "right_start")


@query
def metaplot_slots(spark, d):
    return profile.slots(_bounded(spark, d), PROFILE)


@query
def midpoint_range_join(spark, d):
    return profile.gene_sums(_bounded(spark, d), A.signal(spark, d), PROFILE)


@query
def uniform_overlap_join(spark, d):
    return profile.gene_sums(_bounded(spark, d), A.signal(spark, d), UNIFORM).withColumn("value", F.round("value", 6) + 0.0)


def _profile(spark, d, uniform):
    rows = profile.profile(A.stranded_genes(spark, d), A.signal(spark, d), UNIFORM if uniform else PROFILE)
    return rows.select("slot", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"), "n")


@query
def metaplot_profile(spark, d):
    return _profile(spark, d, False)


@query
def metaplot_profile_uniform(spark, d):
    return _profile(spark, d, True)


@query
def metaplot_ticks(spark, d):
    """The profile at the slots that the axis labels."""
    labels = spark.createDataFrame(profile.ticks(PROFILE), "slot int, label string")
    return _profile(spark, d, False).join(F.broadcast(labels), "slot").select("slot", "label", "mean", "n")


# ---- names and lengths -----------------------------------------------------------------------------------------


@query
def normalize_chrom(spark, d):
    return A.chrom_names(spark, d).select("id", S.chrom_name(F.col("name")).alias("chrom"))


@query
def normalize_chrom_sim(spark, d):
    return A.chrom_names(spark, d).select("id", S.chrom_name_strict(F.col("name")).alias("chrom"))


@query
def renamed_chroms(spark, d):
    rows = A.chrom_names(spark, d).select(F.trim("name").alias("name")).distinct()
    return rows.withColumn("chrom", S.chrom_name(F.col("name"))).filter("name <> chrom")


@query
def kb_labels(spark, d):
    k = F.col("p_partkey").cast("double")
    x = F.explode(F.array(F.col("p_size") / 4, k * k * k / 7, k / 3, k / 70_000, k * 1000)).alias("x")
    return A.table(spark, d, "part").select(x).distinct().select("x", S.kb_label(F.col("x")).alias("label"))


@query
def chrom_lengths(spark, d):
    return A.lengths(spark, d)


@query
def interval_ids(spark, d):
    from ..sources.readers import event_intervals

    return event_intervals(_events(spark, d))


# ---- genetic map -----------------------------------------------------------------------------------------------


def _blocks(spark, d):
    m = A.map_markers(spark, d)
    return m.filter("bp % 7000 < 3000").select("chrom", "marker", F.expr("bp div 20000").alias("block"))


@query
def cm_corrections(spark, d):
    return genmap.correct_blocks(A.map_markers(spark, d), _blocks(spark, d))


def _knots(spark, d):
    return genmap.anchored(A.map_markers(spark, d).select("chrom", "bp", "cm"), A.map_lengths(spark, d))


@query
def map_anchors(spark, d):
    return _knots(spark, d)


@query
def pchip_eval(spark, d):
    pts = A.map_intervals(spark, d).select("chrom", F.col("start").alias("bp")).distinct()
    return genmap.interpolate(pts, _knots(spark, d)).withColumn("cm", F.round("cm", 9) + 0.0)


@query
def annotated_intervals(spark, d):
    rows = genmap.annotate(A.map_intervals(spark, d), _knots(spark, d))
    return rows.select("chrom", "start", "end", "sample", "marker", *[(F.round(c, 6) + 0.0).alias(c) for c in ("start_cM", "end_cM", "cM_per_Mb")])


@query
def weighted_mean_rate(spark, d):
    rows = genmap.weighted_mean_rate(genmap.annotate(A.map_intervals(spark, d), _knots(spark, d)))
    return rows.select(F.round("cM_per_Mb", 6).alias("cM_per_Mb"))


# ---- sampling --------------------------------------------------------------------------------------------------


def _lengths_drawn(spark, d):
    return sampling.length_distribution(A.signal(spark, d))


@query
def length_distribution(spark, d):
    return _lengths_drawn(spark, d)


def _drawn(spark, d):
    return sampling.drawn_lengths(_lengths_drawn(spark, d), N_REGIONS)


@query
def sim_lengths(spark, d):
    return _drawn(spark, d)


@query
def sim_uniform(spark, d):
    return sampling.uniform_regions(_drawn(spark, d), A.region_lengths(spark, d))


@query
def point_sample_lookup(spark, d):
    """A point of each class for each index."""
    return sampling.points(_drawn(spark, d).select("idx"), _partitions(spark, d))


@query
def sim_enriched(spark, d):
    return sampling.enriched_regions(_drawn(spark, d), _partitions(spark, d), A.region_lengths(spark, d))


@query
def sim_regions(spark, d):
    """The workflow's four sets."""
    return sampling.simulate(A.region_genes(spark, d), A.region_lengths(spark, d), A.signal(spark, d), SIMULATION)


from . import source_queries  # noqa: E402, F401  (they register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)
