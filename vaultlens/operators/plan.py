"""Constraint violations of generated note plans, and the notes they render to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.functions import text as T

#: The fields a planned note must have, and the types it may have.
REQUIRED = ["id", "title", "note_type", "tags", "source_doc", "date", "body"]
NOTE_TYPES = ["atomic", "moc", "source"]


def violations(plans: DataFrame) -> DataFrame:
    """plan_id, plan_note_id and rule of each violation.

    Rules: missing_fields, bad_type, tag_count (not 2 to 5), dup_id (each
    repeat of an id within its plan) and, once per plan with a null
    plan_note_id, moc_count (not exactly one map of content). A note without
    an id has one of its own from its position.
    """
    missing = F.col("id").isNull() | F.col("title").isNull() | F.col("note_type").isNull() | F.col("tags").isNull() | F.col("source_doc").isNull() | F.col("note_date").isNull() | F.col("body").isNull()
    bad_type = ~F.coalesce(F.col("note_type").isin(NOTE_TYPES), F.lit(False))
    few = ~F.coalesce(F.size("tags"), F.lit(0)).between(2, 5)
    own = F.coalesce("id", F.format_string("<note[%d]>", F.col("ord")))
    nth = F.row_number().over(Window.partitionBy("plan_id", "own").orderBy("ord", "plan_note_id"))
    rules = F.filter(F.array(F.when(missing, "missing_fields"), F.when(bad_type, "bad_type"), F.when(few, "tag_count"), F.when(F.col("nth") > 1, "dup_id")), lambda x: x.isNotNull())
    each = plans.withColumn("own", own).withColumn("nth", nth).select("plan_id", "plan_note_id", F.explode(rules).alias("rule"))
    mocs = plans.groupBy("plan_id").agg(F.count_if(F.coalesce(F.col("note_type") == "moc", F.lit(False))).alias("n")).where("n <> 1")
    return each.unionByName(mocs.select("plan_id", F.lit(None).cast("bigint").alias("plan_note_id"), F.lit("moc_count").alias("rule")))


def missing_keys(raw: Column, required: list[str] = REQUIRED) -> Column:
    """Required keys that a JSON object lacks; a key with a null value is there."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))


def unknown_tags(plans: DataFrame, allowed: DataFrame) -> DataFrame:
    """plan_note_id and tag for each use of a tag outside the taxonomy (allowed: tag)."""
    used = plans.select("plan_note_id", F.explode("tags").alias("tag")).where("tag is not null")
    return used.join(allowed.select("tag").where("tag is not null").distinct(), "tag", "left_anti").select("plan_note_id", "tag")


def orphan_links(plans: DataFrame, vault_titles: DataFrame | None = None) -> DataFrame:
    """plan_note_id and target of links, raw as written, to neither the plan nor, if given, the vault."""
    links = plans.select("plan_id", "plan_note_id", F.explode(T.links_raw("body")).alias("target"))
    own = plans.select("plan_id", F.coalesce("title", F.lit("")).alias("target")).distinct()
    lost = links.join(own, ["plan_id", "target"], "left_anti")
    if vault_titles is not None:
        lost = lost.join(vault_titles.select(F.col("title").alias("target")).distinct(), "target", "left_anti")
    return lost.select("plan_note_id", "target")


def with_defaults(plans: DataFrame) -> DataFrame:
    """Plans whose notes all have a list of proposed tags, empty where they came without."""
    none = F.array().cast(plans.schema["proposed_new_tags"].dataType)
    return plans.withColumn("proposed_new_tags", F.coalesce("proposed_new_tags", none))


def proposed_tag_log(plans: DataFrame) -> DataFrame:
    """plan_id, place, tag and reason: the proposals of a plan in the order in which they first occur, each entry once."""
    each = plans.select("plan_id", "ord", "plan_note_id", F.posexplode("proposed_new_tags").alias("nth", "x")).where("x is not null")
    first = each.groupBy("plan_id", "x.tag", "x.reason").agg(F.min(F.struct("ord", "plan_note_id", "nth")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy("at"))).select("plan_id", "place", "tag", "reason")


def proposed_tags(plans: DataFrame) -> DataFrame:
    """plan_id, tag and reason of the proposals of a plan, each entry once."""
    return plans.select("plan_id", F.inline("proposed_new_tags")).select("plan_id", "tag", "reason").distinct()


def render(plans: DataFrame) -> DataFrame:
    """plan_note_id, file_name and content: the Markdown of each planned note.

    The frontmatter has block-style tags and a quoted source; the body follows
    after a blank line, without a heading, as the file's name is the title.
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("  - "), F.coalesce(t, F.lit("None")))), "\n")
    source = F.replace(e("source_doc"), F.lit('"'), F.lit('\\"'))
    content = F.concat(F.lit("---\ntags:\n"), tags, F.lit("\ndate: "), e("note_date"), F.lit('\nsource_doc: "'), source, F.lit('"\nnote_type: '), e("note_type"), F.lit("\n---\n\n"), e("body"), F.lit("\n"))
    return plans.select("plan_note_id", F.concat(safe_name(e("title")), F.lit(".md")).alias("file_name"), content.alias("content"))


#: Fixed value: characters that no file name may have.
FORBIDDEN = '\\/:"*<>?|'


def safe_name(title: Column) -> Column:
    """A title as a file name: forbidden characters become dashes, at most 200 bytes of whole characters.

    The longest prefix within 200 bytes is found by its characters' sizes, so
    no character is ever cut and nothing leaves the JVM.
    """
    t = T.strip(F.translate(F.replace(title, F.lit("\x00"), F.lit("")), FORBIDDEN, "-" * len(FORBIDDEN)))
    chars = F.split(F.left(t, F.lit(200)), "")
    kept = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda a, c: F.when(a["go"] & (a["n"] + F.octet_length(c) <= 200), F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["s"], c).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["s"].alias("s"), F.lit(False).alias("go"))),
        lambda a: a["s"],
    )
    return F.when(F.octet_length(t) <= 200, t).otherwise(T.strip(kept))


def last_per_name(rendered: DataFrame) -> DataFrame:
    """Of files of one name the last, as later ones overwrite earlier ones."""
    return rendered.groupBy("file_name").agg(F.max_by("content", "plan_note_id").alias("content"), F.max("plan_note_id").alias("plan_note_id"))
