"""The adapter views of ``plans/fixtures.py`` as SQL text for the DuckDB oracle.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs. DuckDB's
``concat`` skips NULLs, so ``||`` is used wherever an argument may be NULL
(Spark's ``concat`` returns NULL then).
"""

from __future__ import annotations

JS_SPACE_SQL = (r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]")

VIEWS: dict[str, str] = {}

VIEWS["audit_base"] = """
  SELECT event_id AS id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE event_type WHEN 'click' THEN '/api/applied-jobs' WHEN 'view' THEN '/api/chat'
              WHEN 'purchase' THEN '/api/keywords' WHEN 'signup' THEN '/auth/validate'
              ELSE '/api/hr-lookup' END AS path,
         CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 500
              WHEN event_id % 4 = 1 THEN 401 WHEN event_id % 4 = 2 THEN 503 ELSE 400 END AS status_code,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'AI_SERVICE_ERROR'
              WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'VALIDATION_ERROR' END AS error_code,
         CAST(floor(value * 10) AS INT) AS response_ms,
         props AS request_body, ts AS created_at,
         CASE WHEN event_id % 17 = 0 THEN ts END AS deleted_at,
         event_type
  FROM events"""

VIEWS["audit_log"] = """
  SELECT id, user_id, path, status_code, error_code, response_ms, request_body, created_at, deleted_at,
         CASE WHEN error_code IS NOT NULL
                THEN '{"success":false,"errorCode":"' || error_code || '","message":"' || event_type
                     || ' failed for ' || CAST(id AS VARCHAR) || '"}'
              WHEN status_code >= 400 THEN '{"success":false,"error":"' || event_type || '"}'
              ELSE '{"success":true,"data":' || request_body || '}' END AS response_body,
         CASE WHEN id % 6 = 0 THEN NULL
              WHEN id % 6 = 1 THEN 'chrome-extension://ext' || CAST(user_id AS VARCHAR)
              WHEN id % 6 = 2 THEN 'moz-extension://abc'
              WHEN id % 6 = 3 THEN 'http://localhost:' || CAST(3000 + id % 5 AS VARCHAR)
              WHEN id % 6 = 4 THEN 'http://localhost'
              ELSE 'https://app.example.com' END AS origin
  FROM audit_base"""

VIEWS["users"] = """
  SELECT c_custkey AS id, concat('user', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
         CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN 'Cher'
              ELSE concat('  Ann  ', c_mktsegment, ' No', CAST(c_custkey AS VARCHAR)) END AS full_name,
         c_custkey % 13 = 0 AS is_deleted, c_acctbal > 0 AS verified
  FROM customer"""

VIEWS["api_keys"] = """
  SELECT c_custkey AS id, concat('key_', CAST(c_custkey AS VARCHAR)) AS key,
         CASE WHEN c_custkey % 19 = 0 THEN -1 ELSE c_custkey END AS user_id,
         c_custkey % 7 <> 0 AS is_active, c_custkey % 23 = 0 AS is_deleted
  FROM customer"""

VIEWS["key_requests"] = """
  SELECT id AS request_id,
         CASE WHEN user_id IS NULL THEN NULL
              WHEN status_code = 401 THEN 'bad_' || CAST(user_id AS VARCHAR)
              WHEN id % 5 = 0 THEN ''
              ELSE ' key_' || CAST(user_id AS VARCHAR) || chr(9) END AS presented_key,
         created_at
  FROM audit_log"""

VIEWS["mentors"] = """
  SELECT s_suppkey AS id, concat('mentor', CAST(s_suppkey % 90 AS VARCHAR), '@example.com') AS email FROM supplier"""

VIEWS["user_accounts"] = """
  SELECT c_custkey AS id, CASE WHEN c_custkey % 37 = 1 THEN 'fb_shared'
              WHEN c_custkey % 31 <> 0 THEN concat('fb_', CAST(c_custkey AS VARCHAR)) END AS firebase_uid,
         concat('user', CAST(CASE WHEN c_custkey % 41 = 1 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR), '@example.com') AS email,
         CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 120 END AS mentor_id, c_custkey % 13 = 0 AS is_deleted,
         TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(c_custkey % 30 AS INT)) AS created_at
  FROM customer"""

VIEWS["progress"] = """
  SELECT concat('p', CAST(c_custkey AS VARCHAR)) AS id,
         CASE WHEN c_custkey % 17 = 1 THEN c_custkey + 1 ELSE c_custkey END AS user_id FROM customer"""

VIEWS["user_status"] = """
  SELECT concat('s', CAST(c_custkey AS VARCHAR)) AS id,
         CASE WHEN c_custkey % 29 = 1 THEN -c_custkey ELSE c_custkey END AS user_id FROM customer"""

VIEWS["session_notes"] = """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS user_id,
         CAST(o_orderkey % 6 AS INT) AS call_number FROM orders"""

VIEWS["freetrial_users"] = """
  SELECT s_suppkey AS id, concat('trial', CAST(s_suppkey % 80 AS VARCHAR), '@example.com') AS email FROM supplier"""

VIEWS["applied_jobs"] = """
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE o_orderkey % 8 WHEN 0 THEN 'Keywords & Skills Analyzer' WHEN 1 THEN 'Data Engineer'
              WHEN 2 THEN 'Update to our terms' WHEN 3 THEN '12-34.' WHEN 4 THEN 'QA'
              WHEN 5 THEN 'Update Resource Planner' WHEN 6 THEN ' Staff Nurse ' END AS title,
         concat('https://jobs.example.com/', CAST(o_orderkey % 50 AS VARCHAR)) AS url,
         o_orderstatus AS status, o_orderdate AS applied_date
  FROM orders"""

VIEWS["job_submissions"] = """
  SELECT l_orderkey * 10 + l_linenumber AS sub_id, l_suppkey AS user_id,
         CASE l_linenumber WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Senior update terms lead'
              WHEN 3 THEN NULL WHEN 4 THEN 'QA' WHEN 5 THEN 'Analyst ' || l_returnflag
              ELSE ' Staff Nurse ' END AS title,
         CASE WHEN l_linenumber = 7 THEN ''
              ELSE 'https://jobs.example.com/' || CAST(l_partkey % 50 AS VARCHAR) END AS url,
         CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN NULL ELSE 'Co ' || l_linestatus END AS company,
         CASE WHEN l_quantity > 25 THEN 'Oslo' ELSE '' END AS location,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS applied_date,
         CASE WHEN l_discount > 0.05 THEN 'Applied via site' ELSE '' END AS applied_text
  FROM lineitem"""

VIEWS["job_changes"] = """
  SELECT o_orderkey AS id,
         CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey + 1 ELSE o_custkey END AS user_id, seq,
         CASE seq WHEN 1 THEN 'Interview'
              WHEN 2 THEN CASE o_orderstatus WHEN 'F' THEN 'Offer' WHEN 'O' THEN '' ELSE 'Rejected' END
              ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'Applied' END END AS status
  FROM orders, (VALUES (1), (2), (3)) AS n(seq)"""

VIEWS["skills_raw"] = """
  SELECT c_custkey AS owner_id, v.pos, CASE WHEN (c_custkey + v.pos) % 3 <> 0 THEN v.skill END AS skill
  FROM customer, (VALUES (0, 'Node.js'), (1, ' nodejs '), (2, 'C'), (3, 'c++'),
       (4, 'Python'), (5, 'Rust '), (6, '***'), (7, '###')) AS v(pos, skill)"""

VIEWS["skill_dict"] = """
  SELECT v.pos, v.name FROM (VALUES (0, 'NodeJS'), (1, 'Python'), (2, 'C'), (3, 'C++'), (4, 'Node.js')) AS v(pos, name)"""

VIEWS["user_skills"] = """
  SELECT c_custkey AS user_id, 'Python|' || c_mktsegment AS skills, 'twoColumnar' AS skills_display_mode,
         '[]' AS skills_line_time, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM customer WHERE c_custkey % 3 = 0"""

VIEWS["skill_saves"] = """
  SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'SQL|Skill' || CAST(event_id % 7 AS VARCHAR) END AS skills,
         CASE WHEN value > 100 THEN 'lineTime' END AS skills_display_mode,
         CAST(NULL AS VARCHAR) AS skills_line_time, ts AS updated_at, event_id AS save_id
  FROM events"""

VIEWS["search_hits"] = """
  SELECT page_id AS hit_id, regexp_extract(url, 'https?://([^/]+)', 1) AS company,
         CASE page_id % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'website' ELSE 'hr_linkedin' END AS kind,
         page_id AS rank,
         CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 3 = 2
              THEN concat('https://www.linkedin.com/in/jane-mcDoe-', CAST(page_id AS VARCHAR), '/') ELSE url END AS link
  FROM pages"""

VIEWS["lookup_requests"] = """
  SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS company,
         regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS location,
         string_split_regex(url, '[./?#=&]') AS companies_raw
  FROM pages"""

VIEWS["llm_calls"] = """
  SELECT event_id AS id, upper(event_type) AS service,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value * 100) AS INT) END AS in_tokens,
         CAST(event_id % 700 AS INT) AS out_tokens, CAST(event_id % 900 AS INT) AS ms,
         CASE WHEN event_id % 8 <> 0 THEN CAST(event_id % 1600 AS INT) END AS total_tokens,
         CASE event_id % 4 WHEN 0 THEN concat('ok ```json', chr(10), props, chr(10), '``` end') WHEN 1 THEN props
              WHEN 2 THEN concat('Answer: ', props, ' done') ELSE 'no object here' END AS response_text
  FROM events"""

VIEWS["error_log"] = """
  SELECT event_id AS id,
         CASE event_id % 6 WHEN 0 THEN 'PrismaClientKnownRequestError' WHEN 1 THEN 'PrismaClientInitializationError'
              WHEN 2 THEN 'SyntaxError' WHEN 3 THEN 'ValidatorError' WHEN 4 THEN 'Error' END AS name,
         CASE event_id % 7 WHEN 0 THEN 'P2002' WHEN 1 THEN 'P2025' WHEN 2 THEN 'P2003' WHEN 3 THEN 'P1001'
              WHEN 4 THEN 'LIMIT_FILE_SIZE' WHEN 5 THEN 'ETIMEDOUT' END AS code,
         CASE event_id % 5 WHEN 0 THEN 'Invalid API key' WHEN 1 THEN 'Unexpected token in JSON'
              WHEN 2 THEN '[503 Service Unavailable] The model is overloaded.' ELSE 'boom' END AS message
  FROM events"""

# JSON columns of the stored settings, in SQL that both engines read alike; k is the customer's key
SETTINGS_JSON = {
    "education": """CASE WHEN k % 6 = 1 THEN NULL WHEN k % 6 = 2 THEN 'null' ELSE '[{"school":"S' || CAST(k AS VARCHAR(20)) || '"}]' END""",
    "experience": """CASE WHEN k % 5 = 1 THEN 'false' ELSE '[{"company":"C"}]' END""",
    "skills": """CASE WHEN k % 7 = 1 THEN '""' ELSE '["SQL","Go"]' END""",
    "projects": """CASE WHEN k % 3 = 1 THEN '0' ELSE '[]' END""",
    "custom_sections": """CASE WHEN k % 2 = 1 THEN NULL ELSE '["false"]' END""",
    "skills_line_time": """CASE WHEN k % 5 = 2 THEN NULL ELSE '[{"heading":"h","skills":[]}]' END""",
    "section_order": """CASE WHEN k % 9 = 1 THEN NULL ELSE '["skills","projects"]' END""",
    "section_names": """CASE WHEN k % 9 = 2 THEN NULL ELSE '{"skills":"Can do"}' END""",
    "deleted_sections": """CASE WHEN k % 4 = 1 THEN '{"a":1}' WHEN k % 4 = 2 THEN '["projects"]' ELSE '"x"' END""",
}

#: Replies of the four kinds, kept and broken ones, in SQL that both engines read alike; k and seg are columns.
MODEL_REPLY = """CASE k % 4
  WHEN 0 THEN CASE CAST(floor(k / 4) AS BIGINT) % 4
    WHEN 0 THEN '{"present_skills":["' || seg || '"],"missing_skills":["a","b"]}'
    WHEN 1 THEN '{"present_skills":"' || seg || '"}'
    WHEN 2 THEN '{"present_skills":["' || seg || '",1],"missing_skills":[]}' ELSE '["x"]' END
  WHEN 1 THEN CASE CAST(floor(k / 4) AS BIGINT) % 4
    WHEN 0 THEN '{"enhanced_experience":[{"company":"' || seg || '","position":"P","description":["d"]}]}'
    WHEN 1 THEN '{"enhanced_experience":[{"company":1,"description":"d"},{"company":"C","position":"P","description":[true,"x"]}]}'
    WHEN 2 THEN '{"enhanced_experience":{}}' ELSE '{}' END
  WHEN 2 THEN CASE CAST(floor(k / 4) AS BIGINT) % 4
    WHEN 0 THEN '{"formatted_resume":{"name":"' || seg || '","position":"P","experience":[],"skills":["a"],"more":1}}'
    WHEN 1 THEN '{"formatted_resume":{"name":"N","position":2,"experience":[{"company":"C"}],"skills":["a",{}]}}'
    WHEN 2 THEN '{"formatted_resume":"text"}' ELSE '{"formatted_resume":{}}' END
  ELSE CASE CAST(floor(k / 4) AS BIGINT) % 4
    WHEN 0 THEN '{"cover_letter":{"to":"' || seg || '","from":"f","subject":"s","greeting":"g","body":"b","closing":"c","regards":"r","name":"n"}}'
    WHEN 1 THEN '{"cover_letter":{"to":"t","from":[],"subject":"s","greeting":"g","body":"b","closing":"c","regards":"r"}}'
    WHEN 2 THEN '{"cover_letter":[]}' ELSE 'no json' END END"""
REPLY_KIND = "CASE k % 4 WHEN 0 THEN 'keywords' WHEN 1 THEN 'experience' WHEN 2 THEN 'resume' ELSE 'coverletter' END"

VIEWS["model_replies"] = f"""
  SELECT k AS id, {REPLY_KIND} AS kind, {MODEL_REPLY} AS payload FROM (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer)"""

VIEWS["resume_settings"] = f"""
  SELECT k AS user_id, personal_info, summary, display_mode, {", ".join(f"{sql} AS {name}" for name, sql in SETTINGS_JSON.items())}
  FROM (SELECT c_custkey AS k, c_custkey,
         concat('{{"firstName":"Saved","email":"s', CAST(c_custkey AS VARCHAR), '@example.org","phone":"1"}}') AS personal_info,
         CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS summary,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'lineTime' END AS display_mode
  FROM customer WHERE c_custkey % 4 <> 0)"""

# view -> views it reads
_DEPS = {"audit_log": ("audit_base",), "key_requests": ("audit_log",)}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the view CTEs it reads (merging with its own WITH, if any)."""
    body = sql.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _closure(names))
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
