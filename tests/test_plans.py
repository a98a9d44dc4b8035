"""Building a query runs nothing over data, and contents stay out of joins that don't need them."""

import pytest

from riskloom.checks import all_queries, views
from riskloom.plans import review, scans
from riskloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
# Queries whose feature is a write, a stream, a scan that stores what its tables share, a rule catalog read from a
# table, or a fixpoint.
RUNS = ("_stream", "stored_findings", "standard_", "orchestrated_", "validated_stage", "custom_rule_matches", "files_on_disk", "variable_flows",
        "kept_replies", "committed_tables")


@pytest.fixture()
def known_schemas(spark, monkeypatch):
    """Tables read with their schema given, so that reading footers starts no job."""
    schemas = {}

    def table(session, sf, name):
        if name not in schemas:
            schemas[name] = session.read.parquet(f"{sf}/{name}.parquet").schema
        return session.read.schema(schemas[name]).parquet(f"{sf}/{name}.parquet")

    for name in ("documents", "lineitem", "orders", "events", "conversations", "pages", "customer", "labels", "part", "supplier", "nation", "region"):
        table(spark, SF, name)
    monkeypatch.setattr(views, "table", table)


def jobs_of(spark, build):
    sc = spark.sparkContext
    group = f"build-{id(build)}"
    sc.setJobGroup(group, "build")
    try:
        build()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_query_starts_no_job(spark, known_schemas):
    started = {}
    for name, query in all_queries().items():
        if not any(word in name for word in RUNS):
            if n := jobs_of(spark, lambda: query(spark, SF)):
                started[name] = n
    assert started == {}


def exchanged(df):
    """The columns of every exchange in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().sparkPlan().toString()
    return plan, physical


def test_contents_of_other_files_are_left_out_before_a_join(spark):
    """Contents reach the join with findings only behind a semi-join on the findings' paths."""
    for name in ("marked_context", "fix_context", "validation_prompts", "fixed_files"):
        plan, _ = exchanged(all_queries()[name](spark, SF))
        assert "LeftSemi" in plan, name


def test_profiles_use_paths_and_manifests_only(spark):
    """The content is read behind a filter on the manifests' names."""
    plan, _ = exchanged(all_queries()["profiles"](spark, SF))
    scans_of_content = [line for line in plan.splitlines() if "Filter" in line and "package.json" in line]
    assert scans_of_content


def test_a_model_is_called_once_per_prompt(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def make():
        import json
        import uuid

        def complete(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("x" * len(prompts))
            return [json.dumps({"is_legitimate": True, "confidence": 0.9}) for _ in prompts]
        return complete

    code = views.code_files(spark, SF)
    tables = scans.run_standard(code, complete=make, by_profile=False)
    for name in ("findings", "titles", "severities", "metrics", "top_files"):
        tables[name].collect()
    prompts = review.validation_prompts(cut_lineage(tables["_found"]), code, review.repo_context(code)).count()
    assert prompts and sum(f.stat().st_size for f in calls.iterdir()) == prompts
