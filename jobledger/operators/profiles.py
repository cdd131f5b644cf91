"""Profile and resume assembly: user ⟕ saved settings, name split, precedence merge, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_name

# --- fixed values -----------------------------------------------------------
DEFAULT_DISPLAY_MODE = "twoColumnar"
MSG_NO_SETTINGS = "No saved resume settings found. Using default template with profile data."
MSG_LOADED = "Resume loaded successfully"
PROFILE_KEYS = ("firstName", "lastName", "email")
# stored JSON fields and what stands for an absent or falsy one
SECTION_DEFAULTS = {"education": "[]", "experience": "[]", "skills": "[]", "projects": "[]", "custom_sections": "[]",
                    "skills_line_time": "[]", "section_order": "[]", "section_names": "{}"}
# ---------------------------------------------------------------------------


def profile(users: DataFrame) -> DataFrame:
    return users.select("id", "full_name", "email")


def merge_personal_info(saved_json: Column, first: Column, last: Column, email: Column) -> Column:
    """Saved fields kept; firstName/lastName/email = profile value, else saved, else ''."""
    saved = F.coalesce(F.from_json(saved_json, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def pick(profile_value, key):
        return F.coalesce(F.nullif(profile_value, F.lit("")), F.nullif(F.try_element_at(saved, F.lit(key)), F.lit("")),
                          F.lit(""))
    others = F.map_filter(saved, lambda k, v: ~k.isin(*PROFILE_KEYS))
    return F.map_concat(others, F.create_map(F.lit("firstName"), pick(first, "firstName"),
                                             F.lit("lastName"), pick(last, "lastName"),
                                             F.lit("email"), pick(email, "email")))


def json_or(value: Column, default: str) -> Column:
    """A stored JSON text, or ``default`` where it is absent, no JSON, null, false, 0 or the empty string."""
    def kept(v):
        kind = F.schema_of_variant(v)
        falsy = (F.when(kind == "VOID", True).when(kind == "STRING", F.try_variant_get(v, "$", "string") == "")
                 .when(kind == "BOOLEAN", ~F.try_variant_get(v, "$", "boolean"))
                 .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), False)
                 .otherwise(F.try_variant_get(v, "$", "double") == 0))
        return F.when(v.isNull() | falsy, F.lit(default)).otherwise(value)
    return F.get(F.transform(F.array(F.try_parse_json(value)), kept), 0)


def array_or_empty(value: Column) -> Column:
    """A stored JSON text if it is an array, else ``[]``."""
    is_array = F.schema_of_variant(F.try_parse_json(value)).startswith("ARRAY")
    return F.when(F.coalesce(is_array, F.lit(False)), value).otherwise(F.lit("[]"))


def resume_assemble(users: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per user: profile data, merged personal info and section defaults."""
    u = users.select(F.col("id").alias("user_id"), "email", split_name(F.col("full_name")).alias("nm"))
    s = settings.select("user_id", "personal_info", "summary", "display_mode", *SECTION_DEFAULTS, "deleted_sections",
                        F.lit(True).alias("_has"))
    j = u.join(s, "user_id", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    email = F.coalesce(F.col("email"), F.lit(""))
    info = merge_personal_info(F.col("personal_info"), F.col("nm.first_name"), F.col("nm.last_name"), email)
    return j.select(
        "user_id", has.alias("has_resume"),
        F.col("nm.first_name").alias("first_name"), F.col("nm.last_name").alias("last_name"),
        email.alias("profile_email"),
        F.when(has, info).alias("personal_info"),
        F.when(has, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit(""))).alias("professional_summary"),
        F.when(has, F.coalesce(F.nullif(F.col("display_mode"), F.lit("")), F.lit(DEFAULT_DISPLAY_MODE)))
         .alias("skills_display_mode"),
        *[F.when(has, json_or(F.col(c), d)).alias(c) for c, d in SECTION_DEFAULTS.items()],
        F.when(has, array_or_empty(F.col("deleted_sections"))).alias("deleted_sections"),
        F.when(has, F.lit(MSG_LOADED)).otherwise(F.lit(MSG_NO_SETTINGS)).alias("message"),
    )
