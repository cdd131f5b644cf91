"""Adapter views: the service's table shapes laid over the driver's parquet tables.

Each view is a lazy DataFrame built with the DataFrame API from the raw tables,
so column pruning and filters still reach the parquet scan. The same views are
written as SQL text in ``plans/oracle_views.py`` for the DuckDB cross-check. Modulo
expressions here shape values (nulls, categories, wrong owners). Two views hold only
part of their source rows, as outer joins need absent records: ``user_skills`` (every third
customer) and ``resume_settings`` (three of four).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .oracle_views import MODEL_REPLY, REPLY_KIND, SETTINGS_JSON


def _s(c):
    return c.cast("string")


def audit_log_from(events: DataFrame) -> DataFrame:
    """Request-log view over an events DataFrame (batch or streaming)."""
    e = events
    et, eid = F.col("event_type"), F.col("event_id")
    base = e.select(
        eid.alias("id"),
        F.when(eid % 11 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(et == "click", "/api/applied-jobs").when(et == "view", "/api/chat")
         .when(et == "purchase", "/api/keywords").when(et == "signup", "/auth/validate")
         .otherwise("/api/hr-lookup").alias("path"),
        F.when(et != "error", 200).when(eid % 4 == 0, 500).when(eid % 4 == 1, 401)
         .when(eid % 4 == 2, 503).otherwise(400).alias("status_code"),
        F.when((et == "error") & (eid % 3 == 0), "AI_SERVICE_ERROR")
         .when((et == "error") & (eid % 3 == 1), "VALIDATION_ERROR").alias("error_code"),
        F.floor(F.col("value") * 10).cast("int").alias("response_ms"),
        F.col("props").alias("request_body"),
        F.col("ts").alias("created_at"),
        F.when(eid % 17 == 0, F.col("ts")).alias("deleted_at"),
        et.alias("event_type"),
    )
    # extra columns of our own: a response body, an Origin header
    return base.select(
        "*",
        F.when(F.col("error_code").isNotNull(),
               F.concat(F.lit('{"success":false,"errorCode":"'), F.col("error_code"),
                        F.lit('","message":"'), F.col("event_type"), F.lit(" failed for "),
                        _s(F.col("id")), F.lit('"}')))
         .when(F.col("status_code") >= 400,
               F.concat(F.lit('{"success":false,"error":"'), F.col("event_type"), F.lit('"}')))
         .otherwise(F.concat(F.lit('{"success":true,"data":'), F.col("request_body"), F.lit("}")))
         .alias("response_body"),
        F.when(F.col("id") % 6 == 0, F.lit(None).cast("string"))
         .when(F.col("id") % 6 == 1, F.concat(F.lit("chrome-extension://ext"), _s(F.col("user_id"))))
         .when(F.col("id") % 6 == 2, F.lit("moz-extension://abc"))
         .when(F.col("id") % 6 == 3, F.concat(F.lit("http://localhost:"), _s(3000 + F.col("id") % 5)))
         .when(F.col("id") % 6 == 4, F.lit("http://localhost"))
         .otherwise(F.lit("https://app.example.com")).alias("origin"),
    ).drop("event_type")


class Views:
    """All adapter views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # --- request log ------------------------------------------------------
    @cached_property
    def audit_log(self) -> DataFrame:
        return audit_log_from(self.raw("events"))

    # --- accounts -------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.concat(F.lit("user"), _s(k), F.lit("@example.com")).alias("email"),
            F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 9 == 1, F.lit("Cher"))
             .otherwise(F.concat(F.lit("  Ann  "), F.col("c_mktsegment"), F.lit(" No"), _s(k))).alias("full_name"),
            (k % 13 == 0).alias("is_deleted"),
            (F.col("c_acctbal") > 0).alias("verified"),
        )

    @cached_property
    def api_keys(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"),
            F.concat(F.lit("key_"), _s(k)).alias("key"),
            F.when(k % 19 == 0, F.lit(-1).cast("bigint")).otherwise(k).alias("user_id"),
            (k % 7 != 0).alias("is_active"),
            (k % 23 == 0).alias("is_deleted"),
        )

    @cached_property
    def key_requests(self) -> DataFrame:
        """Every logged request presents a key header (ours): none, blank, unknown or padded."""
        a = self.audit_log
        return a.select(
            F.col("id").alias("request_id"),
            F.when(F.col("user_id").isNull(), F.lit(None).cast("string"))
             .when(F.col("status_code") == 401, F.concat(F.lit("bad_"), _s(F.col("user_id"))))
             .when(F.col("id") % 5 == 0, F.lit(""))
             .otherwise(F.concat(F.lit(" key_"), _s(F.col("user_id")), F.lit("\t"))).alias("presented_key"),
            F.col("created_at"),
        )

    # --- further relations -------------------------------------------------------
    @cached_property
    def mentors(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"), F.concat(F.lit("mentor"), _s(k % 90), F.lit("@example.com")).alias("email"))

    @cached_property
    def user_accounts(self) -> DataFrame:
        """``users`` with their other columns: identity, mentor (some unknown), sign-up time."""
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"),
            F.when(k % 37 == 1, "fb_shared").when(k % 31 != 0, F.concat(F.lit("fb_"), _s(k))).alias("firebase_uid"),
            F.concat(F.lit("user"), _s(F.when(k % 41 == 1, k - 1).otherwise(k)), F.lit("@example.com")).alias("email"),
            F.when(k % 5 != 0, k % 120).alias("mentor_id"), (k % 13 == 0).alias("is_deleted"),
            (F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(days=(k % 30).cast("int"))).alias("created_at"))

    @cached_property
    def progress(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(F.concat(F.lit("p"), _s(k)).alias("id"),
                                           F.when(k % 17 == 1, k + 1).otherwise(k).alias("user_id"))

    @cached_property
    def user_status(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(F.concat(F.lit("s"), _s(k)).alias("id"),
                                           F.when(k % 29 == 1, -k).otherwise(k).alias("user_id"))

    @cached_property
    def session_notes(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(k.alias("id"), F.when(k % 7 != 0, F.col("o_custkey")).alias("user_id"),
                                         (k % 6).cast("int").alias("call_number"))

    @cached_property
    def freetrial_users(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"), F.concat(F.lit("trial"), _s(k % 80), F.lit("@example.com")).alias("email"))

    def relations(self) -> dict[str, DataFrame]:
        """The tables of the relation graph by name, each with an ``id``."""
        return {"mentors": self.mentors, "users": self.user_accounts, "api_keys": self.api_keys,
                "applied_jobs": self.applied_jobs, "progress": self.progress, "user_status": self.user_status,
                "user_skills": self.user_skills.withColumn("id", F.col("user_id")),
                "resume_settings": self.resume_settings.withColumn("id", F.col("user_id")),
                "session_notes": self.session_notes, "freetrial_users": self.freetrial_users}

    # --- jobs -----------------------------------------------------------------
    @cached_property
    def applied_jobs(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        title = (F.when(k % 8 == 0, "Keywords & Skills Analyzer").when(k % 8 == 1, "Data Engineer")
                 .when(k % 8 == 2, "Update to our terms").when(k % 8 == 3, "12-34.").when(k % 8 == 4, "QA")
                 .when(k % 8 == 5, "Update Resource Planner").when(k % 8 == 6, " Staff Nurse "))
        return o.select(
            k.alias("id"), F.col("o_custkey").alias("user_id"), title.alias("title"),
            F.concat(F.lit("https://jobs.example.com/"), _s(k % 50)).alias("url"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("applied_date"),
        )

    @cached_property
    def job_submissions(self) -> DataFrame:
        """Incoming tracking requests (ours), one per lineitem; many repeat a (user, url)."""
        li = self.raw("lineitem")
        ln = F.col("l_linenumber")
        return li.select(
            (F.col("l_orderkey") * 10 + ln).alias("sub_id"),
            F.col("l_suppkey").alias("user_id"),
            F.when(ln == 1, "Data Engineer").when(ln == 2, "Senior update terms lead")
             .when(ln == 3, F.lit(None).cast("string")).when(ln == 4, "QA")
             .when(ln == 5, F.concat(F.lit("Analyst "), F.col("l_returnflag")))
             .otherwise(" Staff Nurse ").alias("title"),
            F.when(ln == 7, F.lit("")).otherwise(
                F.concat(F.lit("https://jobs.example.com/"), _s(F.col("l_partkey") % 50))).alias("url"),
            F.when(F.col("l_returnflag") == "R", F.lit("")).when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Co "), F.col("l_linestatus"))).alias("company"),
            F.when(F.col("l_quantity") > 25, "Oslo").otherwise("").alias("location"),
            F.when(ln == 2, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("l_shipdate")).alias("applied_date"),
            F.when(F.col("l_discount") > 0.05, "Applied via site").otherwise("").alias("applied_text"),
        )

    @cached_property
    def job_changes(self) -> DataFrame:
        """Delete / status-change requests (ours), three in order per job; one priority names the wrong owner."""
        pr = F.col("o_orderpriority")
        o = self.raw("orders").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        second = F.when(F.col("o_orderstatus") == "F", "Offer").when(F.col("o_orderstatus") == "O", "").otherwise("Rejected")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.when(pr == "2-HIGH", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"), "seq",
            F.when(F.col("seq") == 1, "Interview").when(F.col("seq") == 2, second)
             .when(pr == "1-URGENT", "Applied").alias("status"),
        )

    # --- skills -----------------------------------------------------------------
    @cached_property
    def skills_raw(self) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("skill")) for i, s in
                          enumerate(["Node.js", " nodejs ", "C", "c++", "Python", "Rust ", "***", "###"])])
        c = self.raw("customer").select(F.col("c_custkey").alias("owner_id"), F.inline(pairs))
        left_out = (F.col("owner_id") + F.col("pos")) % 3 == 0  # an absent entry is a null one
        return c.withColumn("skill", F.when(~left_out, F.col("skill")))

    @cached_property
    def skill_dict(self) -> DataFrame:
        # a five-line dictionary; built from a literal, so its size is fixed
        return self.spark.createDataFrame(
            [(0, "NodeJS"), (1, "Python"), (2, "C"), (3, "C++"), (4, "Node.js")], "pos int, name string")

    @cached_property
    def user_skills(self) -> DataFrame:
        """Stored skill records (ours): every third customer."""
        k = F.col("c_custkey")
        return self.raw("customer").where(k % 3 == 0).select(
            k.alias("user_id"),
            F.array(F.lit("Python"), F.col("c_mktsegment")).alias("skills"),
            F.lit("twoColumnar").alias("skills_display_mode"),
            F.lit("[]").alias("skills_line_time"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
        )

    @cached_property
    def skill_saves(self) -> DataFrame:
        """Incoming skill saves (ours): every event is one; only purchases carry a list, the others are refused."""
        e = self.raw("events")
        listed = F.array(F.lit("SQL"), F.concat(F.lit("Skill"), _s(F.col("event_id") % 7)))
        return e.select(
            F.col("user_id"),
            F.when(F.col("event_type") == "purchase", listed).alias("skills"),
            F.when(F.col("value") > 100, "lineTime").alias("skills_display_mode"),
            F.lit(None).cast("string").alias("skills_line_time"),
            F.col("ts").alias("updated_at"),
            F.col("event_id").alias("save_id"),
        )

    # --- contacts -----------------------------------------------------------------
    @cached_property
    def search_hits(self) -> DataFrame:
        p = self.raw("pages")
        pid = F.col("page_id")
        return p.select(
            pid.alias("hit_id"),
            F.regexp_extract(F.col("url"), r"https?://([^/]+)", 1).alias("company"),
            F.when(pid % 3 == 0, "linkedin").when(pid % 3 == 1, "website").otherwise("hr_linkedin").alias("kind"),
            pid.alias("rank"),
            F.when(pid % 7 == 0, F.lit(""))
             .when(pid % 3 == 2, F.concat(F.lit("https://www.linkedin.com/in/jane-mcDoe-"), _s(pid), F.lit("/")))
             .otherwise(F.col("url")).alias("link"),
        )

    @cached_property
    def lookup_requests(self) -> DataFrame:
        """One company lookup per page (ours): company = host, location = language segment."""
        p = self.raw("pages")
        return p.select(
            F.col("page_id"),
            F.regexp_extract(F.col("url"), r"https?://([^/]+)", 1).alias("company"),
            F.regexp_extract(F.col("url"), r"^https?://[^/]+/([a-z]{2})/", 1).alias("location"),
            F.split(F.col("url"), r"[./?#=&]", -1).alias("companies_raw"),
        )

    # --- text generation ------------------------------------------------------------
    @cached_property
    def llm_calls(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.select(
            eid.alias("id"), F.upper(F.col("event_type")).alias("service"),
            F.when(eid % 10 == 0, F.lit(None).cast("int")).otherwise(F.floor(F.col("value") * 100).cast("int"))
             .alias("in_tokens"),
            (eid % 700).cast("int").alias("out_tokens"), (eid % 900).cast("int").alias("ms"),
            F.when(eid % 8 != 0, (eid % 1600).cast("int")).alias("total_tokens"),
            F.when(eid % 4 == 0, F.concat(F.lit("ok ```json\n"), F.col("props"), F.lit("\n``` end")))
             .when(eid % 4 == 1, F.col("props"))
             .when(eid % 4 == 2, F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done")))
             .otherwise(F.lit("no object here")).alias("response_text"),
        )

    @cached_property
    def error_log(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        name = (F.when(eid % 6 == 0, "PrismaClientKnownRequestError").when(eid % 6 == 1, "PrismaClientInitializationError")
                .when(eid % 6 == 2, "SyntaxError").when(eid % 6 == 3, "ValidatorError").when(eid % 6 == 4, "Error"))
        code = (F.when(eid % 7 == 0, "P2002").when(eid % 7 == 1, "P2025").when(eid % 7 == 2, "P2003")
                .when(eid % 7 == 3, "P1001").when(eid % 7 == 4, "LIMIT_FILE_SIZE").when(eid % 7 == 5, "ETIMEDOUT"))
        msg = (F.when(eid % 5 == 0, "Invalid API key").when(eid % 5 == 1, "Unexpected token in JSON")
               .when(eid % 5 == 2, "[503 Service Unavailable] The model is overloaded.").otherwise("boom"))
        return e.select(eid.alias("id"), name.alias("name"), code.alias("code"), msg.alias("message"))

    # --- profiles ---------------------------------------------------------------------
    @cached_property
    def resume_settings(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").where(k % 4 != 0).select(
            k.alias("user_id"),
            F.concat(F.lit('{"firstName":"Saved","email":"s'), _s(k), F.lit('@example.org","phone":"1"}'))
             .alias("personal_info"),
            F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("summary"),
            F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("lineTime")).alias("display_mode"), k.alias("k"),
        ).withColumns({name: F.expr(sql) for name, sql in SETTINGS_JSON.items()}).drop("k")

    @cached_property
    def model_replies(self) -> DataFrame:
        """Replies of the four kinds (ours), one per customer; three of four break their contract."""
        c = self.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
        return c.select(F.col("k").alias("id"), F.expr(REPLY_KIND).alias("kind"), F.expr(MODEL_REPLY).alias("payload"))
