"""Whole scans over all repositories at once: the standard one and the one split by analyser."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import paths
from riskloom.operators import dedup, filters, fixes, matching, metrics, ranking, related
from riskloom.operators.joins import agent_names, assign_analysis, route_files
from riskloom.plans import review
from riskloom.plans.profile import active_rules, build_profile
from riskloom.rule_catalog import ALL_RULES, CODE_POINTS, CODE_RULES, SECRET_DETECTORS, rules_frame
from riskloom.session import cut_lineage
from riskloom.sources import reports, runs, tables

_ORDER = ["repo", "path", "start_line", "end_line", "check_id"]
Store = Callable[[DataFrame], DataFrame]


class Tables(Mapping):
    """Result tables by name. Each is planned when it is first asked for, so a scan only does what is used.

    Names with an underscore are parts that several tables share; `store` keeps them, so they are computed once and a model
    is called once per prompt.
    """

    _pairs = ("_report",)   # parts that are two tables at once; they aren't staged, but the tables taken from them are

    def __init__(self, makers: dict[str, Callable[[Tables], DataFrame]]):
        self._makers, self._made, self._run = makers, {}, None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            make = lambda: self._makers[name](self)
            if self._run is None or name in self._pairs:
                self._made[name] = make()
            else:
                self._made[name] = runs.stage(*self._run, name, make)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return (n for n in self._makers if not n.startswith("_"))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def write(self, out: str, **options) -> None:
        """Write every result table to its folder."""
        tables.write_tables(dict(self.items()), out, **options)

    def commit(self, spark: SparkSession, out: str, run_id: str) -> None:
        """Stage every table of the run, shared parts too, then show them together (see `sources.runs`).

        A scan that is started again under the same id makes only what isn't staged; so do the tables that depend on it.
        """
        self._run, self._made = (spark, out, run_id), {}
        for name in self:
            self[name]
        runs.commit(spark, out, run_id, list(self))


def _relevant(agents) -> Column:
    """Whether the analyser in `agent` looks at the file in `path` by its name."""
    base, ext = F.lower(paths.base_name(F.col("path"))), paths.extension(F.col("path"))
    tests = [F.when(F.col("agent") == a, filters.is_relevant_name(base, ext, a)) for a in agents]
    return F.coalesce(*tests, F.lit(False))


def fan_out(files: DataFrame, agents=None, rules=CODE_RULES) -> DataFrame:
    """Every analyser over its files, in one job.

    Rules run on all files, and the matches are routed: a match counts if its analyser looks at the file, or finds no file
    of its own in the repository. So contents never move; only paths and matches do.
    """
    agents = list(agents or agent_names())
    base, ext = F.lower(paths.base_name(F.col("path"))), paths.extension(F.col("path"))
    busy = files.groupBy("repo").agg(F.array_compact(F.array(*[
        F.when(F.max(filters.is_relevant_name(base, ext, a)), F.lit(a)) for a in agents])).alias("_busy"))
    found = matching.match_rules(files, rules).where(F.col("agent").isin(agents)).withColumn("_own", _relevant(agents))
    joined = found.join(busy, "repo")
    return joined.where(F.col("_own") | ~F.array_contains("_busy", F.col("agent"))).drop("_own", "_busy")


def profiled(matches: DataFrame, profiles: DataFrame, rules=ALL_RULES) -> DataFrame:
    """The matches of the rules that each repository's profile selects."""
    wanted = active_rules(profiles, rules_frame(matches.sparkSession, rules)).select("repo", F.col("rule_id").alias("check_id"))
    return matches.join(wanted, ["repo", "check_id"], "left_semi").select(*matches.columns)


def run_standard(files: DataFrame, rules=ALL_RULES, detectors=SECRET_DETECTORS, complete=None, fixer=None, threshold: float = 0.7,
                 min_severity: str = "INFO", min_confidence: float = 0.8, max_bytes: int = 1_000_000,
                 stats: DataFrame | None = None, by_profile: bool = True, agents: DataFrame | None = None,
                 run_id: str = "run", store: Store = cut_lineage, replies: str | None = None) -> Tables:
    """Profile, rule and secret findings, review and fixes (if models are given) and the report and run tables.

    The profile of a repository chooses its rules; `by_profile=False` runs the whole catalog everywhere. `complete` and
    `fixer` make the functions that answer review and fix prompts (see `infer`); `replies` names a folder that keeps their
    replies for later runs.
    """
    listed = filters.filter_analysable(files)
    wanted = filters.limit_targets(listed, max_bytes)

    def findings(t: Tables) -> DataFrame:
        found = matching.match_rules(wanted, rules)
        if by_profile:
            found = profiled(found, t["profiles"], rules)
        found = dedup.dedup_scanner(found.withColumn("message", F.col("check_id")), _ORDER + ["impact"])
        return store(filters.filter_scanner_severity(found, min_severity))

    def kept(t: Tables) -> DataFrame:
        if complete is None:
            return t["_found"]
        return review.validate_stage(t["_found"], wanted, review.repo_context(files), complete, threshold, store=store, replies=replies)

    def proposed(t: Tables) -> DataFrame:
        prompts = store(review.fix_prompts(t["findings"], wanted))
        answers = store(review.ask(prompts, fixer, replies, "fix"))
        parsed = review.parse_fixes(answers.join(prompts.drop("prompt"), "prompt_id"))
        return store(filters.gate_fixes(parsed, min_confidence))

    def accepted(t: Tables) -> DataFrame:
        return filters.valid_fixes(t["fixes"].where("gate = 'accepted'"))

    def errors(t: Tables) -> DataFrame:
        skipped = filters.skipped_files(listed, max_bytes)
        return skipped.select("repo", "path", F.lit("skipped").alias("kind"), F.col("reason"))

    def merged(t: Tables) -> DataFrame:
        none = t["findings"].limit(0)
        return dedup.merge_sources(t["findings"], t["secrets"], none if agents is None else agents)

    def run(t: Tables) -> DataFrame:
        of = lambda df: df.select(F.lit(run_id).alias("run_id"), "repo")
        changes = of(t["fix_status"].where("status = 'applied'")) if fixer is not None else of(t["findings"].limit(0))
        return metrics.run_summary(of(t["findings"]), of(t["secrets"]), changes, of(t["errors"]))

    makers = {
        "profiles": lambda t: build_profile(files, stats), "_found": findings, "findings": kept,
        "secrets": lambda t: store(dedup.dedup_secrets(matching.detect_secrets(wanted, detectors))),
        "_report": lambda t: metrics.report_metrics(t["findings"]),
        "titles": lambda t: t["_report"][0], "severities": lambda t: t["_report"][1],
        "secret_types": lambda t: metrics.secret_counts(t["secrets"]), "metrics": lambda t: metrics.code_metrics(t["findings"]),
        "top_files": lambda t: ranking.top_files(t["findings"]), "all_findings": merged, "errors": errors, "run": run,
    }
    if fixer is not None:
        makers |= {
            "fixes": proposed, "fix_status": lambda t: fixes.select_fixes(wanted, accepted(t)),
            "fixed_files": lambda t: fixes.apply_fixes(wanted, accepted(t)),
            "changes": lambda t: fixes.change_summary(
                t["fix_status"].where("status = 'applied'"), ["path", "start_line", "end_line", "check_id", "fixed_code"]),
        }
    return Tables(makers)


_AGENT_COLUMNS = ("repo", "path", "start_line", "end_line", "check_id", "impact", "confidence", "message", "code", "recommended_action",
                  "reasoning")


def run_orchestrated(files: DataFrame, agents=None, rules=CODE_RULES, points=CODE_POINTS, taint_lines: int = 20,
                     complete=None, analyses: DataFrame | None = None, prices: tuple[float, float] = (3.0, 15.0),
                     store: Store = cut_lineage, kept_replies: str | None = None) -> Tables:
    """Routing, one analyser pass, the model-driven analysers (if `complete` is given), data flow, synthesis and metrics.

    `kept_replies` names a folder that keeps the model's replies for later runs.
    """
    names = list(agents or agent_names())
    sources = filters.source_files(files.where(F.col("type") == "file"))
    spark = files.sparkSession
    scheduled = [(a, n) for n, a in dims.DECOMPOSED_ANALYSES if a in names]

    def replies(t: Tables) -> DataFrame:
        prompts = store(review.agent_prompts(t["routes"], review.repo_context(files)))
        return store(review.ask(prompts, complete, kept_replies, "analyse").join(prompts.select("prompt_id", "repo", "agent", "part"), "prompt_id"))

    def found(t: Tables) -> DataFrame:
        by_rule = fan_out(sources, names, rules).select(
            "repo", "path", "start_line", "end_line", "check_id", "impact", F.lit(1.0).alias("confidence"),
            F.col("check_id").alias("message"), "code", F.lit("").alias("recommended_action"), F.lit("").alias("reasoning"))
        parts = [by_rule]
        if complete is not None:
            parts.append(review.to_findings(reports.parse_agent_replies(t["_replies"], ("repo", "agent"))).select(*_AGENT_COLUMNS))
        every = reduce(DataFrame.unionByName, parts)
        return store(dedup.dedup_agent(every, [c for c in _AGENT_COLUMNS if c not in ("repo", "path", "start_line", "check_id")]))

    def errors(t: Tables) -> DataFrame:
        ids = spark.createDataFrame(scheduled, "agent_id string, analysis_id string")
        rows = [assign_analysis(ids, analyses)[1]] if analyses is not None else []
        if complete is not None:
            failed = t["_replies"].where("error is not null").select(F.col("agent").alias("agent_id"), "error")
            unread = reports.reply_errors(t["_replies"], ("agent",)).select(F.col("agent").alias("agent_id"), F.col("reason").alias("error"))
            rows += [failed, unread]
        return reduce(DataFrame.unionByName, rows, spark.createDataFrame([], "agent_id string, error string"))

    order = [-ranking.agent_rank(F.col("impact")), "path", "start_line", "check_id"]
    makers = {
        "context": lambda t: metrics.codebase_context(files), "routes": lambda t: route_files(sources, names),
        "code_points": lambda t: store(matching.code_points(sources, points)),
        "data_flows": lambda t: matching.taint_pairs(t["code_points"], taint_lines), "findings": found,
        "vulnerabilities": lambda t: review.enhance(ranking.number_findings(t["findings"], order)),
        "related": lambda t: related.related_findings(t["findings"]),
        "patterns": lambda t: metrics.systemic_patterns(t["findings"]), "metrics": lambda t: metrics.code_metrics(t["findings"]),
        "top_files": lambda t: ranking.top_files(t["findings"]), "errors": errors,
        "secret_totals": lambda t: metrics.secret_totals(t["findings"], t["vulnerabilities"]),
    }
    if complete is not None:
        makers |= {"_replies": replies, "cost": lambda t: metrics.cost(t["_replies"], *prices)}
    return Tables(makers)


def scan(files: DataFrame, mode: str = "standard", **params) -> Tables:
    return (run_orchestrated if mode == "orchestrated" else run_standard)(files, **params)
