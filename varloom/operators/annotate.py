"""Genotype columns of variants from the paths of their neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import genotype_call

# The filter bits.
GT_MISMATCH, LOW_GQ, LOW_COV, LOW_SQ, LOW_ALT, PARTIAL = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
PATHS = "array<struct<score:float,sizesim:float,seqsim:float,path:array<int>,full_target:boolean,coverage:bigint,ps:bigint,hp:int>>"


def _call(ploidy: Column, cov: Column, node: Column, paths: Column) -> Column:
    """struct(gt, state, alt, full)"""
    n = F.size(paths)
    one, two = F.get(paths, F.lit(0)), F.get(paths, F.lit(1))
    has = lambda path: F.coalesce(F.array_contains(path["path"], node), F.lit(False))
    out = lambda gt, state, alt, full: F.struct(
        F.lit(gt).alias("gt") if isinstance(gt, str) else gt.alias("gt"), F.lit(state).alias("state"), alt.cast("double").alias("alt"), full.alias("full")
    )
    zero, yes = F.lit(0.0), F.lit(True)
    none1 = F.when(cov != 0, out("0", "Ref", zero, yes)).otherwise(out(".", "Non", zero, yes))
    none2 = F.when(cov != 0, out("0|0", "Ref", zero, yes)).otherwise(out("./.", "Non", zero, yes))
    haploid = F.when((n > 0) & has(one), out("1", "Hom", F.coalesce(one["coverage"], F.lit(0)), yes)).otherwise(none1)
    hom = genotype_call(cov - one["coverage"], one["coverage"])["state"] == "Hom"
    side = F.when(one["hp"].isNull() | (one["hp"] == 1), "0|1").otherwise("1|0")
    single = (
        F.when(~has(one), out("0|0", "Ref", zero, yes))
        .when(hom, out("1|1", "Hom", one["coverage"], one["full_target"]))
        .otherwise(out(side, "Het", one["coverage"], one["full_target"]))
    )
    double = (
        F.when(has(one) & has(two), out("1|1", "Hom", one["coverage"] + two["coverage"], one["full_target"] | two["full_target"]))
        .when(has(one), out("1|0", "Het", one["coverage"], one["full_target"]))
        .when(has(two), out("0|1", "Het", two["coverage"], two["full_target"]))
        .otherwise(none2)
    )
    return F.when(ploidy == "Haploid", haploid).when(n == 0, none2).when(n == 1, single).otherwise(double)


def finish(called: DataFrame) -> DataFrame:
    """called (gt, state, alt, full, dp, ploidy, paths) with ft, sq, gq, ad, ks, gt_state, ps."""
    skip = F.col("ploidy") == "Zero"
    ref, alt = F.col("dp") - F.col("alt"), F.col("alt")
    out = called.withColumn("__q", genotype_call(ref, alt))
    gq, sq = F.col("__q.gq"), F.col("__q.sq")
    bit = lambda test, value: F.when(test, value).otherwise(0)
    called_alt = F.col("state") != "Ref"
    bits = (
        bit(F.col("__q.state") != F.col("state"), GT_MISMATCH) + bit(gq < 5, LOW_GQ) + bit(F.col("dp") < 5, LOW_COV)
        + bit(called_alt & (sq < 5), LOW_SQ) + bit(called_alt & (alt < 5), LOW_ALT) + bit(~F.col("full"), PARTIAL)
    )
    nothing = F.array(F.lit(None).cast("int"))
    return out.withColumns({
        "gt": F.when(skip, "./.").otherwise(F.col("gt")), "ft": F.when(skip, 0).otherwise(bits).cast("int"),
        "sq": F.when(skip, 0).otherwise(F.round(sq)).cast("int"), "gq": F.when(skip, 0).otherwise(F.round(gq)).cast("int"),
        "ps": F.when(~skip, F.get("paths", F.lit(0))["ps"]).cast("int"), "dp": F.col("dp").cast("int"),
        "ad": F.when(skip, nothing).otherwise(F.array(ref.cast("int"), alt.cast("int"))),
        "ks": F.when(skip, nothing).otherwise(F.transform("paths", lambda x: (x["score"] * F.lit(100).cast("float")).cast("float").cast("int"))),
        "gt_state": F.when(skip, "Non").otherwise(F.col("state")),
    }).drop("__q", "state", "alt_cov", "full")


def annotate(variants: DataFrame, found: DataFrame) -> DataFrame:
    """variants (chrom, ne, node, ...) with genotypes, from found (chrom, ne, ploidy, coverage, paths)."""
    rows = variants.join(found, ["chrom", "ne"], "left")
    rows = rows.withColumns({"paths": F.coalesce("paths", F.array().cast(PATHS)), "dp": F.coalesce("coverage", F.lit(0)), "ploidy": F.coalesce("ploidy", F.lit("Unset"))})
    rows = rows.withColumn("__c", _call(F.col("ploidy"), F.col("dp"), F.col("node"), F.col("paths")))
    # the variant's own alt allele keeps its name; the call's alt coverage is separate
    named = rows.withColumnRenamed("alt", "__allele").withColumns({"gt": F.col("__c.gt"), "state": F.col("__c.state"), "alt": F.col("__c.alt"), "full": F.col("__c.full")})
    done = finish(named.drop("__c", "coverage"))
    return done.drop("alt", "paths", "ploidy").withColumnRenamed("__allele", "alt")


def unannotated(variants: DataFrame) -> DataFrame:
    """Rejected rows, written without a genotype."""
    none = F.array(F.lit(None).cast("int"))
    return variants.withColumns({
        "ne": F.lit(0).cast("long"), "node": F.lit(None).cast("int"), "gt": F.lit("./."), "ft": F.lit(0), "sq": F.lit(0), "gq": F.lit(0),
        "ps": F.lit(None).cast("int"), "dp": F.lit(0), "ad": none, "ks": none, "gt_state": F.lit("Non"),
    })


def tally(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("gt_state").agg(F.count("*").alias("n"))
