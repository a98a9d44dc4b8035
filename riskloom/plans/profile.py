"""Repository profiles and the rule sets they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import paths
from riskloom.operators.dedup import combine_rulesets
from riskloom.operators.manifests import detect_frameworks
from riskloom.sources.files import key_contents
from riskloom.operators.metrics import language_share, language_share_by_files
from riskloom.operators.ranking import rank_frameworks, rank_languages

# Confidence of a profile by where its languages come from.
SOURCE_CONFIDENCE = {"github-api": 0.9, "file-analysis": 0.7, "mixed": 0.85}
OVERRIDE_SOURCE, OVERRIDE_CONFIDENCE = "user-override", 0.5


def _empty() -> Column:
    return F.array().cast("array<string>")


def language_profile(share: DataFrame, threshold: float = 10.0) -> DataFrame:
    """One row per repository: primary and secondary language and the languages that choose rule sets."""
    ranked = rank_languages(share, threshold)
    pick = lambda n, c: F.max(F.when(F.col("role") == n, F.col(c)))
    chosen = F.sort_array(F.collect_list(F.when(F.col("role") != "minor", F.struct("rank", "language"))))
    return ranked.groupBy("repo").agg(
        pick("primary", "language").alias("primary_language"), pick("primary", "pct").alias("primary_pct"),
        pick("secondary", "language").alias("secondary_language"), pick("secondary", "pct").alias("secondary_pct"),
        chosen.getField("language").alias("languages"))


def framework_profile(hits: DataFrame) -> DataFrame:
    """One row per repository: primary framework, up to three others, and the side categories."""
    ranked = rank_frameworks(hits)
    others = F.sort_array(F.collect_list(F.when(F.col("role") == "secondary", F.struct("rank", "framework"))))
    frameworks = ranked.groupBy("repo").agg(
        F.max(F.when(F.col("role") == "primary", F.col("framework"))).alias("primary_framework"),
        others.getField("framework").alias("secondary_frameworks"))
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col("category") == c, F.col("framework"))))
    side = hits.groupBy("repo").agg(names("build").alias("build_tools"), names("database").alias("databases"),
                                    names("security").alias("security"))
    return side.join(frameworks, "repo", "left")


def security_rulesets(primary: Column, secondary: Column, language: Column) -> Column:
    """General rule sets, then web, then API, then those of the language; each once."""
    known = F.concat(F.array(F.coalesce(primary, F.lit(""))), secondary)
    overlap = lambda names: F.arrays_overlap(known, F.array(*map(F.lit, names)))
    when = lambda test, sets: F.when(test, F.array(*map(F.lit, sets))).otherwise(_empty())
    by_language = F.coalesce(dims.lookup(F.coalesce(language, F.lit("")), dims.LANGUAGE_SECURITY_RULESETS), _empty())
    return combine_rulesets(
        F.array(*map(F.lit, dims.BASE_SECURITY_RULESETS)), when(overlap(dims.WEB_FRAMEWORKS), dims.WEB_SECURITY_RULESETS),
        when(overlap(dims.API_FRAMEWORKS), dims.API_SECURITY_RULESETS), by_language)


def _sets_of(names: Column, table: dict) -> Column:
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.coalesce(dims.lookup(n, table), _empty()))))


def with_rulesets(profile: DataFrame) -> DataFrame:
    """Adds the rule sets and the profile key that follow from languages and frameworks."""
    primary, others = F.col("primary_framework"), F.col("secondary_frameworks")
    frameworks = F.concat(F.when(primary != "None", F.array(primary)).otherwise(_empty()), others)
    sized = (profile.withColumn("base_rulesets", _sets_of(F.col("languages"), dims.LANGUAGE_RULESETS))
             .withColumn("framework_rulesets", _sets_of(frameworks, dims.FRAMEWORK_RULESETS))
             .withColumn("security_rulesets", security_rulesets(primary, others, F.col("primary_language"))))
    return (sized.withColumn("rulesets", combine_rulesets(
                F.col("base_rulesets"), F.col("framework_rulesets"), F.col("security_rulesets")))
            .withColumn("profile_key", paths.profile_key(F.coalesce("primary_language", F.lit("")), primary)))


def _joined(languages: DataFrame, frameworks: DataFrame, source: str, confidence: float) -> DataFrame:
    both = languages.join(frameworks, "repo", "full")
    return both.select(
        "repo", "primary_language", "primary_pct", "secondary_language", "secondary_pct",
        F.coalesce("languages", _empty()).alias("languages"),
        F.coalesce("primary_framework", F.lit("None")).alias("primary_framework"),
        F.coalesce("secondary_frameworks", _empty()).alias("secondary_frameworks"),
        F.coalesce("build_tools", _empty()).alias("build_tools"), F.coalesce("databases", _empty()).alias("databases"),
        F.coalesce("security", _empty()).alias("security"),
        F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def build_profile(files: DataFrame, stats: DataFrame | None = None, threshold: float = 10.0,
                  source: str | None = None, max_size: int | None = None) -> DataFrame:
    """Profile of every repository. Languages come from size statistics if given, else from the file list.

    Of manifests, of any size, the content is used; of all others just the path. `max_size` leaves out larger manifests.
    """
    source = source or ("mixed" if stats is not None else "file-analysis")
    share = language_share(stats) if stats is not None else language_share_by_files(files)
    hits = detect_frameworks(files if max_size is None else key_contents(files, max_size))
    return with_rulesets(_joined(language_profile(share, threshold), framework_profile(hits), source,
                                 SOURCE_CONFIDENCE[source]))


def apply_overrides(profile: DataFrame, overrides: DataFrame) -> DataFrame:
    """Forced language (as 100 %), forced framework (clears the others) and extra rule sets (appended as they are).

    `overrides` has one row per repository: repo, force_language, force_framework, extra_rulesets.
    """
    joined = profile.join(overrides, "repo", "left")
    lang, fw = F.col("force_language"), F.col("force_framework")
    forced = joined.select(
        "repo", F.coalesce(lang, "primary_language").alias("primary_language"),
        F.when(lang.isNotNull(), 100.0).otherwise(F.col("primary_pct")).alias("primary_pct"),
        F.when(lang.isNull(), F.col("secondary_language")).alias("secondary_language"),
        F.when(lang.isNull(), F.col("secondary_pct")).alias("secondary_pct"),
        F.when(lang.isNotNull(), F.array(lang)).otherwise(F.col("languages")).alias("languages"),
        F.coalesce(fw, "primary_framework").alias("primary_framework"),
        F.when(fw.isNotNull(), _empty()).otherwise(F.col("secondary_frameworks")).alias("secondary_frameworks"),
        "build_tools", "databases", "security",
        F.when(fw.isNotNull(), OVERRIDE_SOURCE).otherwise(F.col("source")).alias("source"),
        F.when(fw.isNotNull(), OVERRIDE_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence"),
        "extra_rulesets")
    extra = F.transform(F.split("extra_rulesets", ","), lambda r: F.trim(r))
    return (with_rulesets(forced)
            .withColumn("rulesets", F.concat("rulesets", F.coalesce(extra, _empty()))).drop("extra_rulesets"))


def active_rules(profile: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, ruleset, rule): the rules each repository runs."""
    return (profile.select("repo", F.explode(F.array_distinct("rulesets")).alias("ruleset"))
            .join(rules.select("ruleset", "rule_id", "agent", "impact"), "ruleset"))


def preset_rulesets(name: Column) -> Column:
    """Rule sets of a preset; any other name gives `auto`."""
    return dims.lookup(name, dims.PRESET_RULESETS, "auto")
