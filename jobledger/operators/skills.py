"""Skills: dictionary build, canonical names, order-keeping dedup, present/missing terms, upserts.

Skill lists are kept long (one row per owner, position, skill) so that lookups
are joins and dedup is an aggregate with a map-side partial step; nothing
collects an owner's whole history into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, JS_SPACE_BODY, falsy_to_null, js_trim, normalize_skill
from .common import first_per

# --- fixed values -----------------------------------------------------------
REJECT_NO_SKILLS = "Skills array is required"
# ---------------------------------------------------------------------------


def build_dict(lines: DataFrame, name_col: str = "name", pos_col: str = "pos", is_lines: bool = True) -> DataFrame:
    """(norm, name); the last entry wins on equal normal form.

    ``is_lines``: names are trimmed, blank and ``#`` lines dropped. Otherwise (entries of a
    category document) names stay as they are.
    """
    t = lines.select(F.col(pos_col).alias("pos"), F.col(name_col).alias("name")).where(F.col("name").isNotNull())
    if is_lines:
        t = t.withColumn("name", js_trim(F.col("name"))).where((F.col("name") != "") & ~F.col("name").startswith("#"))
    t = t.withColumn("norm", normalize_skill(F.col("name")))
    return t.groupBy("norm").agg(F.max_by("name", "pos").alias("name"))


def canonical(skills: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(owner_id, pos, skill): dictionary name if the normal form is known, else the trimmed
    input; one row per (owner, normal form), the first position wins.

    The dictionary only names a normal form, so it is joined last: the limit per (owner, normal form)
    runs map-side first (over spread rows), and nothing after the join asks for its clustering, so a frequent
    form's partition may be split.
    """
    s = skills.where(F.col("skill").isNotNull() & (F.col("skill") != ""))
    s = s.withColumn("norm", normalize_skill(F.col("skill")))
    firsts = first_per(_spread(s.select("owner_id", "norm", "pos", "skill")), ["owner_id", "norm"], ["pos"])
    d = dictionary.select("norm", F.col("name").alias("dict_name"))
    return firsts.join(d, "norm", "left").select(
        "owner_id", "pos", F.coalesce(F.col("dict_name"), js_trim(F.col("skill"))).alias("skill"))


def validate_skill_array(arr: Column) -> Column:
    """No-dictionary form on an array column: drop empties, trim, keep the first item per
    normal form, in input order. Sort-based (n log n): sort by (normal form, position),
    keep each run's head, restore input order."""
    a = F.filter(arr, lambda x: x.isNotNull() & (x != ""))
    tagged = F.transform(a, lambda x, i: F.struct(normalize_skill(x).alias("n"), i.alias("i"), js_trim(x).alias("v")))

    def heads(srt):
        firsts = F.filter(srt, lambda e, j: (j == 0) | (F.get(srt, j - 1)["n"] != e["n"]))
        back = F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
        return F.transform(back, lambda e: e["v"])
    return F.get(F.transform(F.array(F.array_sort(tagged)), heads), 0)


def _spread(skills: DataFrame) -> DataFrame:
    """Rows dealt out by owner, skill and position, ahead of a map-side step that holds its task's groups: a table of one
    row group is scanned, and its lists are expanded, in one task. A frequent (owner, skill) stays in many tasks.
    """
    return skills.repartition("owner_id", "skill", "pos")


def flat_skills(skills: DataFrame) -> DataFrame:
    """All unique (trimmed) skills per owner with their first position."""
    s = skills.where(F.col("skill").isNotNull()).withColumn("skill", js_trim(F.col("skill")))
    s = _spread(s.where(F.col("skill") != ""))
    return s.groupBy("owner_id", "skill").agg(F.min("pos").alias("pos"))


def terms(texts: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Distinct (id, term): whitespace tokens in normal form, optionally kept to a vocabulary.

    Normalising a token only deletes characters inside it, so the whole text is
    lower-cased and stripped of everything but [a-z0-9] and blanks in one pass,
    then split on blanks; empty pieces (tokens with nothing left) are dropped. A text's terms
    are made distinct within its row, so the vocabulary is joined to one row per text and term, and
    the only exchange on (id, term) is the one that later joins on them reuse.
    """
    src = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = F.regexp_replace(F.lower(F.col("text")), f"[^a-z0-9{JS_SPACE_BODY}]+", "")
    t = src.select("doc_id", F.explode(F.array_distinct(F.split(kept, f"{JS_SPACE}+", -1))).alias("term"))
    t = t.where(F.col("term") != "")
    if vocabulary is not None:
        t = t.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return t.select("doc_id", "term").distinct()


def present_missing(required: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """present = required ∩ held, missing = required − held, on (doc_id, term)."""
    h = held.select("doc_id", "term")
    return (required.join(h, ["doc_id", "term"], "left_semi"),
            required.join(h, ["doc_id", "term"], "left_anti"))


def canonical_arrays(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary validation of an array column, one list per ``key`` (unique per row).

    Explode with positions, canonicalise with the dictionary,
    regroup in order. A list is one request body, so the regroup is bounded.
    """
    long = df.select(F.col(key).alias("owner_id"), F.posexplode(col).alias("pos", "skill"))
    canon = canonical(long, dictionary)
    back = canon.groupBy("owner_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "skill"))), lambda s: s["skill"]).alias("_canon"))
    out = df.join(back, df[key] == back.owner_id, "left").drop("owner_id")
    return out.withColumn(col, F.when(F.col(col).isNull(), F.lit(None))
                          .otherwise(F.coalesce(F.col("_canon"), F.array().cast("array<string>")))).drop("_canon")


def upsert_skills(table: DataFrame, incoming: DataFrame, full: bool = True,
                  order: tuple[str, ...] = ("updated_at", "save_id"),
                  dictionary: DataFrame | None = None) -> DataFrame:
    """Validate incoming lists, take the latest record per user, then full-outer merge on user_id.

    Validation is the service's: trim, drop empties, first item per normal form,
    dictionary names when a dictionary is given (``save_id`` keys the lists).
    full: a matched row takes every new field (absent display fields become null);
    partial: only ``skills`` (and updated_at) are replaced, other fields kept.
    """
    # a save without a list is refused (400) and changes nothing; an empty list is a valid save
    incoming = incoming.where(F.col("skills").isNotNull())
    if dictionary is not None:
        incoming = canonical_arrays(incoming, "save_id", "skills", dictionary)
    else:
        incoming = incoming.withColumn("skills", validate_skill_array(F.col("skills")))
    cols = ["skills", "skills_display_mode", "skills_line_time", "updated_at"]
    if full:  # empty display fields are stored as null
        for c in ("skills_display_mode", "skills_line_time"):
            incoming = incoming.withColumn(c, falsy_to_null(F.col(c)))
    latest = first_per(incoming.select("user_id", *cols, *[c for c in order if c not in cols]),
                       ["user_id"], list(order), last=True)
    n = latest.select("user_id", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_new"))
    t = table.select("user_id", *[F.col(c).alias(f"t_{c}") for c in cols])
    j = t.join(n, "user_id", "full_outer")
    has_new = F.coalesce(F.col("_new"), F.lit(False))
    out = [F.col("user_id")]
    for c in cols:
        if full or c in ("skills", "updated_at"):
            out.append(F.when(has_new, F.col(f"n_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
        else:
            out.append(F.col(f"t_{c}").alias(c))
    return j.select(*out)


def save_outcomes(incoming: DataFrame) -> DataFrame:
    """Per save request: null reason when accepted, else the service's message."""
    return incoming.withColumn("reject_reason", F.when(F.col("skills").isNull(), F.lit(REJECT_NO_SKILLS)))


def skills_for(users: DataFrame, user_skills: DataFrame) -> DataFrame:
    """Every user's skills record, or the empty default when none is stored."""
    u = users.select(F.col("id").alias("user_id"))
    j = u.join(user_skills, "user_id", "left")
    return j.select("user_id", F.coalesce(F.col("skills"), F.array().cast("array<string>")).alias("skills"),
                    "skills_display_mode", "skills_line_time")
