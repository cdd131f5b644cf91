"""Properties of the set-wise rules on the driver tables."""

from pyspark.sql import functions as F

from core_helpers import SF_CHECK, SF_SMALL
from jobledger.operators import jobs, skills, usage
from jobledger.plans.catalog import ARRIVAL, _as_of, _required_held
from jobledger.plans.fixtures import Views


def test_quota_identity(spark):
    d = usage.usage_daily(Views(spark, SF_SMALL).audit_log)
    bad = d.where(F.col("remaining") + F.least(F.col("used"), F.lit(20)) != 20).count()
    assert bad == 0 and d.count() > 0


def test_dedup_keys_unique(spark):
    f = jobs.first_tracked(Views(spark, SF_SMALL).applied_jobs)
    assert f.count() == f.select("user_id", "url").distinct().count()


def test_merge_partitions_input(spark):
    v = Views(spark, SF_SMALL)
    table, inserted, rejected, tracked = jobs.merge_jobs(v.applied_jobs, v.job_submissions, _as_of(), order=ARRIVAL)
    n_in = v.job_submissions.count()
    assert inserted.count() + rejected.count() + tracked.count() == n_in
    assert table.count() == v.applied_jobs.count() + inserted.count()
    assert inserted.select("user_id", "url").distinct().count() == inserted.count()


def test_valid_rejected_cover_input(spark):
    s = Views(spark, SF_SMALL).job_submissions
    valid, rejected = jobs.split_valid(s)
    assert valid.count() + rejected.count() == s.count()


def test_present_missing_disjoint(spark):
    req, held = _required_held(spark, SF_SMALL)
    present, missing = skills.present_missing(req, held)
    assert present.join(missing, ["doc_id", "term"]).count() == 0
    assert present.count() + missing.count() == req.count()


def test_validate_skill_array(spark):
    df = spark.createDataFrame([(["nodejs", "Node.js", "c++", "C", "Rust ", "***", "###", "", None],)], "a array<string>")
    got = df.select(skills.validate_skill_array(F.col("a")).alias("r")).first().r
    assert got == ["nodejs", "c++", "Rust", "***"]


def test_skills_canonical_golden(spark):
    raw = spark.createDataFrame([(1, i, s) for i, s in enumerate(["nodejs", "Node.js", "c++", "C", "Rust ", "***", "###"])],
                                "owner_id long, pos int, skill string")
    dct = skills.build_dict(Views(spark, SF_SMALL).skill_dict)
    got = [r.skill for r in skills.canonical(raw, dct).orderBy("pos").collect()]
    assert got == ["Node.js", "C++", "Rust", "***"]


def test_keyword_prompts_of_long_lists(spark):
    from jobledger.operators import textgen
    posts = spark.createDataFrame([(1, "job text"), (2, "job text"), (3, "")], "doc_id long, text string")
    sk = spark.createDataFrame([(1, i, f"skill{i}") for i in range(5000)] + [(2, 0, "SQL")],
                               "owner_id long, pos int, skill string")
    got = {r.doc_id: r for r in textgen.keyword_prompts(posts, sk).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "ok", 3: "rejected"}
    assert '"skill4999"]' in got[1].prompt


def test_status_changes_apply_in_order(spark):
    from jobledger.operators import jobs
    table = spark.createDataFrame([(1, 7, "Applied"), (2, 7, "Applied")], "id long, user_id long, status string")
    changes = spark.createDataFrame([(1, 7, 1, "Rejected"), (1, 7, 2, "Interview"), (2, 8, 1, "Offer"), (2, 7, 3, "")],
                                    "id long, user_id long, seq int, status string")
    assert {r.id: r.status for r in jobs.set_status(table, changes).collect()} == {1: "Interview", 2: "Applied"}


def test_empty_display_fields_are_stored_as_null(spark):
    from jobledger.operators import skills as S
    schema = "user_id long, skills array<string>, skills_display_mode string, skills_line_time string, updated_at timestamp_ntz, save_id long"
    import datetime as dt
    new = spark.createDataFrame([(1, ["a"], "", "", dt.datetime(2024, 1, 1), 1)], schema)
    r = S.upsert_skills(new.where("false"), new).first()
    assert (r.skills_display_mode, r.skills_line_time) == (None, None)


def test_building_queries_runs_no_job(spark):
    """Building any query of this library's own catalogue launches no job, but for those that write as they go."""
    from jobledger.plans.catalog import QUERIES
    tracker = spark.sparkContext.statusTracker()
    writing = {"jobs_replay", "jobs_versions", "usage_daily_upkeep", "skill_dictionary_file", "skill_dictionary_json",
               "upload_gate"}
    for name, (fn, _sql) in QUERIES.items():
        if name in writing:
            continue
        fn(spark, SF_SMALL)  # parquet schemas are read here once
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        fn(spark, SF_SMALL)
        jobs_run = [j for j in tracker.getJobIdsForGroup(f"build-{name}")]
        infos = [tracker.getJobInfo(j) for j in jobs_run]
        assert all(i is None or len(i.stageIds) <= 1 for i in infos), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_key_dedup_and_topk(spark):
    """One key holding most rows: aggregate-based dedup and limited top-k stay exact."""
    from pyspark.sql import functions as F
    from jobledger.operators.common import first_per, top_k_per_group
    rows = [(1, i, f"r{i}") for i in range(5000)] + [(k, 0, f"c{k}") for k in range(2, 200)]
    df = spark.createDataFrame(rows, "k long, o long, v string").repartition(8)
    f = {r.k: r.v for r in first_per(df, ["k"], ["o"]).collect()}
    assert f[1] == "r0" and len(f) == 199
    last = {r.k: r.v for r in first_per(df, ["k"], ["o"], last=True).collect()}
    assert last[1] == "r4999"
    top = top_k_per_group(df, ["k"], [F.col("o").desc()], 3).where("k = 1").orderBy("o").collect()
    assert [r.o for r in top] == [4997, 4998, 4999]


def test_upsert_validates_skill_lists(spark):
    import datetime as dt
    from jobledger.operators import skills as S
    t0 = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([(1, ["Old"], "twoColumnar", "[]", t0)],
                                  "user_id long, skills array<string>, skills_display_mode string, "
                                  "skills_line_time string, updated_at timestamp_ntz")
    inc = spark.createDataFrame([(1, [" nodejs ", "Node.js", "c++", "C", ""], None, None, t0, 7),
                                 (2, ["Rust "], "lineTime", None, t0, 8)],
                                "user_id long, skills array<string>, skills_display_mode string, "
                                "skills_line_time string, updated_at timestamp_ntz, save_id long")
    plain = {r.user_id: r.skills for r in S.upsert_skills(table, inc).collect()}
    assert plain == {1: ["nodejs", "c++"], 2: ["Rust"]}
    dct = S.build_dict(Views(spark, SF_SMALL).skill_dict)
    canon = {r.user_id: r.skills for r in S.upsert_skills(table, inc, dictionary=dct).collect()}
    assert canon == {1: ["Node.js", "C++"], 2: ["Rust"]}


def test_save_without_list_changes_nothing(spark):
    import datetime as dt
    from jobledger.operators import skills as S
    t0 = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([(1, ["Old"], "twoColumnar", "[]", t0)],
                                  "user_id long, skills array<string>, skills_display_mode string, "
                                  "skills_line_time string, updated_at timestamp_ntz")
    inc = spark.createDataFrame([(1, None, "lineTime", None, t0, 7), (2, [], None, None, t0, 8)],
                                "user_id long, skills array<string>, skills_display_mode string, "
                                "skills_line_time string, updated_at timestamp_ntz, save_id long")
    got = {r.user_id: (r.skills, r.skills_display_mode) for r in S.upsert_skills(table, inc).collect()}
    assert got == {1: (["Old"], "twoColumnar"), 2: ([], None)}
    reasons = {r.save_id: r.reject_reason for r in S.save_outcomes(inc).collect()}
    assert reasons == {7: S.REJECT_NO_SKILLS, 8: None}


def test_canonical_with_empty_dictionary(spark):
    """The dictionary files may be absent: validation is then trim + first-per-normal-form only."""
    raw = spark.createDataFrame([(1, i, s) for i, s in enumerate(["nodejs", " Node.js ", "c++", "C", "***", "###"])],
                                "owner_id long, pos int, skill string")
    empty = spark.createDataFrame([], "pos int, name string")
    got = [r.skill for r in skills.canonical(raw, skills.build_dict(empty)).orderBy("pos").collect()]
    assert got == ["nodejs", "c++", "***"]
