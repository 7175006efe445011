"""The workflows' inputs made from the driver's tables, by whole-number arithmetic and md5 alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 32
CHROMOSOME_BP = 100_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a few bytes that become long ones, dealt out first: a file of millions of them may be read by one task."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), key)


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype strings of 32 individuals per part, with missing, fixed and flipped characters."""
    k = F.col("p_partkey")
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    p = p.select("p_partkey", F.col("p_brand").alias("map"), F.md5(k.cast("string").cast("binary")).alias("h"), F.expr("(p_partkey div 60) * 240000 + 100000").alias("coordinate"))

    def char(j):
        x = F.substring(F.col("h"), j + 1, F.lit(1))
        state = (F.floor(F.col("coordinate") / (F.lit(3_000_000) + F.lit(250_000) * j)) + j) % 2
        own, other = F.when(state == 0, "A").otherwise("B"), F.when(state == 0, "B").otherwise("A")
        rule = F.when(x == "0", "-").when(j.isin(5, 21) & (x < "8"), "-").when((k % 17 == 0) & (x < "6"), "-").when(k % 19 == 0, "A")
        return rule.when((k % 23 == 0) & (x < "7"), other).when(x == "1", other).otherwise(own)

    genotypes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), char), "")
    return p.select("map", F.col("p_partkey").alias("input_ord"), (k % 3 + 1).cast("int").alias("chromosome"), "coordinate", F.concat(F.lit("S"), k.cast("string")).alias("snp_name"), genotypes.alias("genotypes"))


def messy_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers as text with missing, zero and short fields."""
    k = F.col("input_ord")
    m = markers(spark, sf_dir)
    blank = lambda n, c, to=None: F.when(k % n != 0, c).otherwise(F.lit(to))
    return m.select(
        blank(29, F.col("map")).alias("map"), "input_ord",
        F.when(k % 43 == 0, "0").otherwise(blank(41, F.concat(F.col("chromosome").cast("string"), F.lit(".0")))).alias("chromosome"),
        F.when(k % 53 == 0, "0").otherwise(blank(47, F.col("coordinate").cast("string"))).alias("coordinate"),
        blank(31, F.col("snp_name"), "").alias("snp_name"),
        F.when(k % 13 == 0, F.substring("genotypes", 1, 6)).otherwise(blank(37, F.col("genotypes"))).alias("genotypes"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.expr("(o_orderkey div 10) * 6000 + o_custkey % 3000")
    strand = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(".")
    return o.select(F.concat(F.lit("chr"), F.expr("string(o_custkey % 10 + 1)")).alias("chr"), start.alias("start"), (start + 300 + F.expr("(o_orderkey * 37) % 9000")).alias("end"), strand.alias("strand"), F.col("o_orderkey").alias("input_ord"))


def region_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes farther apart, every third one longer than both flanks, so that each class of region has parts of its own."""
    o = genes(spark, sf_dir).drop("start", "end")
    k = F.col("input_ord")
    start = k * 2500 + 20_000
    return o.select(F.col("chr").alias("chrom"), start.alias("start"), (start + 300 + (k * 37) % 9000 + F.when(k % 3 == 0, 14_000).otherwise(0)).alias("end"), "strand", "input_ord")


def region_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_genes(spark, sf_dir).groupBy("chrom").agg((F.max("end") + 10_000).alias("length"))


def stranded_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).filter(F.col("strand").isin("+", "-"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    start = F.expr("(l_orderkey div 10) * 6000 + (l_partkey * 7) % 6000")
    return rows.select(F.concat(F.lit("chr"), F.expr("string(l_suppkey % 10 + 1)")).alias("chr"), start.alias("start"), (start + F.expr("(l_linenumber - 1) * 400")).cast("bigint").alias("end"), F.col("l_quantity").cast("double").alias("value"), F.expr("l_orderkey * 8 + l_linenumber").alias("id"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("sample"), F.col("event_type").alias("chrom"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("bp"), "event_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 600_000_000 + F.floor(F.col("value") * F.lit(1e6))).alias("end"), "event_id", "user_id")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chromosomes, as long as their genes reach and 10,000 more."""
    return genes(spark, sf_dir).groupBy(F.col("chr").alias("chrom")).agg((F.max("end") + 10_000).alias("length"))


def map_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, bp, marker, cm: a running sum per brand."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 1000 + 500).alias("bp"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("marker"), (F.sum(F.col("p_size") % 5).over(w) + 7).cast("double").alias("cm"))


def map_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("chrom")).agg((F.max("p_partkey") * 1000 + 1500).alias("length"))


def map_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals on the map's chromosomes, within their knots."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("chrom"))
    start = F.expr("l_partkey * 1000 + (l_orderkey * 13) % 500")
    return rows.join(p, "l_partkey").select("chrom", start.alias("start"), (start + F.expr("1 + (l_orderkey * 7 + l_linenumber) % 400")).alias("end"), F.expr("string(l_orderkey)").alias("sample"), F.expr("concat('L', l_orderkey * 8 + l_linenumber)").alias("marker")).distinct()


def chain_blocks(spark: SparkSession) -> DataFrame:
    """Per chromosome two plain blocks with a gap, an inverted one, and one that maps twice."""
    rows = []
    for c in range(1, 11):
        rows += [(f"chr{c}", 0, 2_000_000, f"chr{c}", 5_000, "+"), (f"chr{c}", 2_300_000, 6_000_000, f"chr{c}", 2_400_000, "+"), (f"chr{c}", 6_000_000, 9_000_000, f"chr{c % 10 + 1}", 50_000_000, "-"), (f"chr{c}", 8_000_000, 8_500_000, f"chr{c}", 90_000_000, "+")]
    return spark.createDataFrame(rows, "chrom string, w_start long, w_end long, t_chrom string, t_start long, t_strand string")


def chrom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in several spellings, null among them."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    n = F.expr("string(s_suppkey % 12 + 1)")
    name = F.when(k % 7 == 0, F.concat(F.lit("Chr"), n)).when(k % 7 == 1, F.concat(F.lit("CHR"), n)).when(k % 7 == 2, n).when(k % 7 == 3, F.concat(F.lit(" chr"), n, F.lit(" "))).when(k % 7 == 4, F.concat(F.lit("scaf_"), n)).when(k % 7 == 5, F.concat(F.lit("chr"), n))
    return s.select(k.alias("id"), name.alias("name"))


# ---- the same in DuckDB, as named common table expressions ------------------------------------------------------

SQL: dict[str, str] = {
    "markers": """
      SELECT p_brand AS map, p_partkey AS input_ord, (p_partkey % 3 + 1)::INTEGER AS chromosome, (p_partkey // 60) * 240000 + 100000 AS coordinate, 'S' || p_partkey AS snp_name,
        array_to_string(list_transform(range(32), lambda j:
          CASE WHEN substr(md5(p_partkey::VARCHAR), j + 1, 1) = '0' THEN '-'
            WHEN j IN (5, 21) AND substr(md5(p_partkey::VARCHAR), j + 1, 1) < '8' THEN '-'
            WHEN p_partkey % 17 = 0 AND substr(md5(p_partkey::VARCHAR), j + 1, 1) < '6' THEN '-'
            WHEN p_partkey % 19 = 0 THEN 'A'
            WHEN (p_partkey % 23 = 0 AND substr(md5(p_partkey::VARCHAR), j + 1, 1) < '7') OR substr(md5(p_partkey::VARCHAR), j + 1, 1) = '1'
              THEN CASE WHEN (((p_partkey // 60) * 240000 + 100000) // (3000000 + 250000 * j) + j) % 2 = 0 THEN 'B' ELSE 'A' END
            WHEN (((p_partkey // 60) * 240000 + 100000) // (3000000 + 250000 * j) + j) % 2 = 0 THEN 'A' ELSE 'B' END), '') AS genotypes
      FROM part""",
    "messy": """
      SELECT CASE WHEN input_ord % 29 <> 0 THEN map END AS map, input_ord,
        CASE WHEN input_ord % 43 = 0 THEN '0' WHEN input_ord % 41 <> 0 THEN chromosome || '.0' END AS chromosome,
        CASE WHEN input_ord % 53 = 0 THEN '0' WHEN input_ord % 47 <> 0 THEN coordinate::VARCHAR END AS coordinate,
        CASE WHEN input_ord % 31 <> 0 THEN snp_name ELSE '' END AS snp_name,
        CASE WHEN input_ord % 13 = 0 THEN substr(genotypes, 1, 6) WHEN input_ord % 37 <> 0 THEN genotypes END AS genotypes FROM markers""",
    "genes": """
      SELECT 'chr' || (o_custkey % 10 + 1) AS chr, (o_orderkey // 10) * 6000 + o_custkey % 3000 AS start, (o_orderkey // 10) * 6000 + o_custkey % 3000 + 300 + (o_orderkey * 37) % 9000 AS "end",
        CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand, o_orderkey AS input_ord FROM orders""",
    "region_genes": """
      SELECT chr AS chrom, input_ord * 2500 + 20000 AS start, input_ord * 2500 + 20000 + 300 + (input_ord * 37) % 9000 + CASE WHEN input_ord % 3 = 0 THEN 14000 ELSE 0 END AS "end", strand, input_ord FROM genes""",
    "region_lengths": """SELECT chrom, max("end") + 10000 AS length FROM region_genes GROUP BY chrom""",
    "stranded": "SELECT * FROM genes WHERE strand IN ('+', '-')",
    "signal": """
      SELECT 'chr' || (l_suppkey % 10 + 1) AS chr, (l_orderkey // 10) * 6000 + (l_partkey * 7) % 6000 AS start, (l_orderkey // 10) * 6000 + (l_partkey * 7) % 6000 + (l_linenumber - 1) * 400 AS "end",
        l_quantity::DOUBLE AS value, l_orderkey * 8 + l_linenumber AS id FROM lineitem""",
    "points": "SELECT user_id AS sample, event_type AS chrom, epoch_us(ts) // 1000 AS bp, event_id FROM events",
    "intervals": """
      SELECT event_type AS chrom, epoch_us(ts) AS start, epoch_us(ts) + 600000000 + floor(value * 1e6)::BIGINT AS "end", event_id, user_id FROM events""",
    "lengths": """SELECT chr AS chrom, max("end") + 10000 AS length FROM genes GROUP BY chr""",
    "map_markers": """
      SELECT p_brand AS chrom, p_partkey * 1000 + 500 AS bp, 'M' || p_partkey AS marker, (sum(p_size % 5) OVER (PARTITION BY p_brand ORDER BY p_partkey) + 7)::DOUBLE AS cm FROM part""",
    "map_lengths": "SELECT p_brand AS chrom, max(p_partkey) * 1000 + 1500 AS length FROM part GROUP BY p_brand",
    "map_intervals": """
      SELECT DISTINCT p_brand AS chrom, l_partkey * 1000 + (l_orderkey * 13) % 500 AS start, l_partkey * 1000 + (l_orderkey * 13) % 500 + 1 + (l_orderkey * 7 + l_linenumber) % 400 AS "end",
        l_orderkey::VARCHAR AS sample, 'L' || (l_orderkey * 8 + l_linenumber) AS marker FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "blocks": " UNION ALL ".join(
        f"SELECT 'chr' || c AS chrom, {a} AS w_start, {b} AS w_end, 'chr' || {t} AS t_chrom, {s} AS t_start, '{d}' AS t_strand FROM range(1, 11) r(c)"
        for a, b, t, s, d in ((0, 2_000_000, "c", 5_000, "+"), (2_300_000, 6_000_000, "c", 2_400_000, "+"), (6_000_000, 9_000_000, "(c % 10 + 1)", 50_000_000, "-"), (8_000_000, 8_500_000, "c", 90_000_000, "+"))
    ),
    "names": """
      SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'Chr' || (s_suppkey % 12 + 1) WHEN 1 THEN 'CHR' || (s_suppkey % 12 + 1) WHEN 2 THEN (s_suppkey % 12 + 1)::VARCHAR
        WHEN 3 THEN ' chr' || (s_suppkey % 12 + 1) || ' ' WHEN 4 THEN 'scaf_' || (s_suppkey % 12 + 1) WHEN 5 THEN 'chr' || (s_suppkey % 12 + 1) END AS name FROM supplier""",
}
