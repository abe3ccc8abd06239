"""Named queries of the core and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import replies
from vaultlens.functions import text as T
from vaultlens.operators import apply, audit, graph, orphans, plan, prompts, registry, rewrite
from vaultlens.operators import similarity as sim
from vaultlens.plans import sql as S
from vaultlens.plans.runtime import counting_rows, materialize, numbered, read_table
from vaultlens.sources import docx, tables
from vaultlens.streaming import incremental

RUN_DATE = "2025-12-01"


# ---- inputs of the queries


def _sections(spark, d: str) -> DataFrame:
    return counting_rows(read_table(spark, d, "doc_sections"), "section_id", "parsed_at")


def _groups(spark, d: str) -> DataFrame:
    return counting_rows(read_table(spark, d, "candidate_groups"), "group_id", "verified_at")


def _pairs(spark, d: str) -> DataFrame:
    p = _groups(spark, d).select(F.inline("pairs")).where("a is not null and b is not null and a <> b")
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))


def _reviewed(spark, d: str) -> DataFrame:
    return _groups(spark, d).where("is_duplicate = false").select(F.filter(F.array_distinct("notes"), lambda x: x.isNotNull()).alias("notes"))


def _registered(spark, d: str) -> DataFrame:
    return registry.titles_of_sources(tables.notes(spark, d)).select("source_doc", "title").distinct()


def _staged(spark, d: str) -> DataFrame:
    return tables.plan_notes(spark, d).select(F.col("plan_note_id").alias("id"), "plan_id", "ord", "title", "note_type", "source_doc", F.col("note_date").alias("date"))


def _planned(spark, d: str) -> DataFrame:
    return registry.write_plan(_staged(spark, d), _registered(spark, d))


def _results(spark, d: str) -> DataFrame:
    """Planned notes as results of an enrichment of the vault's notes of equal number, every third under its old title."""
    notes = tables.vault_notes(spark, d).select("note_id", F.col("title").alias("original_title"))
    p = tables.plan_notes(spark, d).join(notes, F.col("plan_note_id") == F.col("note_id"))
    old = F.col("note_id") % 3 == 0
    return p.withColumn("original_title", F.when(old, F.col("title")).when(F.col("note_id") % 3 == 1, F.col("original_title")))


def _pair_notes(spark, d: str) -> DataFrame:
    n = tables.vault_notes(spark, d).select("note_id", "title", "tags", "source_doc", "body")
    side = lambda x: n.select(*[F.col(c).alias(f"{'source' if c == 'source_doc' else c}_{x}") if c != "note_id" else F.col(c).alias(x) for c in n.columns])
    return _pairs(spark, d).join(side("a"), "a").join(side("b"), "b")


# ---- queries


def paragraphs(spark, d: str) -> DataFrame:
    n = tables.vault_notes(spark, d)
    return n.select("note_id", F.posexplode(T.paragraphs("body")).alias("para_no", "paragraph"))


def word_counts(spark, d: str) -> DataFrame:
    n = counting_rows(read_table(spark, d, "vault_notes"), "note_id", "updated_at")
    return n.select("note_id", T.word_count("body").alias("words"), (~F.col("word_count").eqNullSafe(T.word_count("body"))).alias("stored_differs"))


def h1_titles(spark, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", T.h1_title(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))).alias("h1"))


def wikilinks(spark, d: str) -> DataFrame:
    p = tables.plan_notes(spark, d).where("body is not null")
    return p.select("plan_note_id", F.array_sort(T.links_normalised("body")).alias("targets"), F.array_sort(T.links_raw("body")).alias("written"))


def title_tokens(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d)
    return n.select("note_id", F.array_sort(T.title_tokens("title")).alias("tokens"), F.array_sort(T.title_tokens("title", 4, sim.STOP_TOKENS)).alias("topic_tokens"))


def first_words(spark, d: str) -> DataFrame:
    return tables.vault_notes(spark, d).select("note_id", T.first_words("body", 40).alias("start"))


def empty_note_archive(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d).where(T.is_blank("body") & audit.is_empty())
    return n.select("note_id", rewrite.archive_path(F.col("path"), RUN_DATE).alias("dest"))


def plan_links_to_vault(spark, d: str) -> DataFrame:
    return plan.orphan_links(tables.plan_notes(spark, d), read_table(spark, d, "title_index").where("archived_at is null"))


def registry_upsert(spark, d: str) -> DataFrame:
    old = registry.titles_of_sources(tables.notes(spark, d)).groupBy("source_doc", "title").agg(F.min("date").alias("date"))
    old = old.withColumn("date", F.lit(""))
    new = _staged(spark, d).where("source_doc is not null and title is not null").select("source_doc", "title", F.coalesce("date", F.lit("")).alias("date"))
    return registry.upsert(old, new)


def registry_after_merge(spark, d: str) -> DataFrame:
    won = _groups(spark, d).where("is_duplicate").select(F.explode(F.array_distinct("notes")).alias("note_id"), F.array_min("notes").alias("first"), "canonical_title")
    n = tables.vault_notes(spark, d).select("note_id", "source_doc", "title")
    m = won.join(n, "note_id").select("source_doc", "title", F.when(F.col("note_id") == F.col("first"), F.col("canonical_title")).alias("canonical_title"))
    return registry.after_merge(n.where("source_doc <> ''"), m)


def supplement(spark, d: str) -> DataFrame:
    notes = tables.notes(spark, d).select("note_id", "title", "note_type", "source_doc")
    return registry.supplement(notes, tables.plan_notes(spark, d))


def related_sections(spark, d: str) -> DataFrame:
    n = tables.vault_notes(spark, d).select("note_id", "body", "title")
    links = sim.reciprocal_links(_pair_notes(spark, d).where("score >= 0.8")).where("target <> ''").groupBy("note_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return n.join(links, "note_id").select("note_id", rewrite.append_all(F.col("body"), F.col("targets")).alias("content"))


def enrichment(spark, d: str) -> DataFrame:
    return enriched(tables.notes(spark, d))


def enriched(notes: DataFrame) -> DataFrame:
    """note_id and content of the thin notes with a block that names the three notes nearest to each."""
    n = materialize(notes, "notes")
    thin = n.where(audit.is_thin())
    near = sim.nearest(n, thin).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).getField("title").alias("near"))
    j = thin.join(near, F.col("note_id") == F.col("target"), "left")
    block = rewrite.enrichment_paragraphs(F.col("title"), F.coalesce("near", F.array().cast("array<string>")), {"registry": ["A registry keeps what was done.", "Compare [[{0}]] and [[{1}]]."]})
    return j.select("note_id", rewrite.append_enrichment(F.col("body"), block).alias("content"))


def relinked(spark, d: str) -> DataFrame:
    p = tables.plan_notes(spark, d).select(F.col("plan_note_id").alias("note_id"), F.coalesce("body", F.lit("")).alias("body"))
    n = tables.vault_notes(spark, d).select("note_id", "title")
    won = _groups(spark, d).where("is_duplicate and canonical_title is not null").select(F.explode(F.array_distinct("notes")).alias("note_id"), F.col("canonical_title").alias("new"))
    m = won.join(n, "note_id").select(F.col("title").alias("old"), "new")
    return rewrite.relink(p, m).where("changed").select("note_id", "body")


def overlap_pairs(spark, d: str) -> DataFrame:
    """Pairs scored by tags and title tokens alone, for which there is SQL."""
    return sim.similar_pairs(tables.vault_notes(spark, d), (0.0, 0.6, 0.4), 0.7)


def dedup_pairs(spark, d: str) -> DataFrame:
    return sim.similar_pairs(tables.vault_notes(spark, d), sim.DEDUP, 0.55)


def dedup_groups(spark, d: str) -> DataFrame:
    pairs = materialize(sim.without_reviewed(dedup_pairs(spark, d), _reviewed(spark, d)), "pairs")
    return graph.candidate_groups(pairs)


def audit_similar(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d).where("note_type <> 'moc'")
    return sim.without_linked(sim.similar_pairs(n, sim.AUDIT, 0.72), n)


def unlinked_top(spark, d: str) -> DataFrame:
    return sim.top_pairs(sim.without_reviewed(audit_similar(spark, d), _reviewed(spark, d)))


def review_groups(spark, d: str) -> DataFrame:
    return graph.candidate_groups(materialize(sim.without_reviewed(_pairs(spark, d), _reviewed(spark, d)), "pairs"))


def classified(spark, d: str) -> DataFrame:
    return sim.classify(_pair_notes(spark, d))


def canonical_bodies(spark, d: str) -> DataFrame:
    p = _pair_notes(spark, d).where("score >= 0.9").withColumn("canonical_title", rewrite.canonical_title(F.col("title_a"), F.col("title_b")))
    return rewrite.canonical_bodies(p.withColumn("pair_id", F.xxhash64("a", "b")))


def nearby_top3(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d)
    return sim.nearby(n, sim.first_targets(n, audit.is_thin(), 10))


def related_top3(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d)
    return sim.related(n, sim.first_targets(n, audit.is_fix_target(), 20))


def truncated_replies(spark, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", replies.looks_truncated("text").alias("truncated"))


def reply_payloads(spark, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", replies.reply_json(replies.fenced("text")).alias("payload")).where("payload is not null")


def group_prompts(spark, d: str) -> DataFrame:
    g = _groups(spark, d).where("is_duplicate is null").select("group_id", F.filter("notes", lambda x: x.isNotNull()).alias("notes"))
    return prompts.group_prompts(g, tables.vault_notes(spark, d))


def import_prompts(spark, d: str) -> DataFrame:
    return prompts.import_prompts(_sections(spark, d), "Split the document into notes. Answer in JSON.", ["study/memory"])


def merge_plan(spark, d: str) -> DataFrame:
    return apply.merge_plan(_groups(spark, d).where("is_duplicate"), tables.vault_notes(spark, d), RUN_DATE)


def frontmatter_gaps(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d).where("frontmatter is not null")
    gaps = F.array_sort(plan.missing_keys(F.col("frontmatter"), ["tags", "date", "source_doc", "note_type"]))
    return n.select("note_id", gaps.alias("missing")).where(F.size("missing") > 0)


def note_prompts(spark, d: str) -> DataFrame:
    n = tables.notes(spark, d).where(audit.is_thin())
    return prompts.note_prompts(n, "Enrich the note. Answer in JSON.", ["study/memory"])


def pair_prompts(spark, d: str) -> DataFrame:
    return prompts.pair_prompts(_pair_notes(spark, d).where("score between 0.8 and 0.9"))


def write_order(spark, d: str) -> DataFrame:
    names = plan.render(tables.plan_notes(spark, d)).select(F.col("plan_note_id").alias("id"), "file_name")
    return registry.write_order(_staged(spark, d).join(names, "id"))


def plan_defaults(spark, d: str) -> DataFrame:
    return plan.with_defaults(tables.plan_notes(spark, d)).select("plan_note_id", F.size("proposed_new_tags").alias("proposals"))


def import_plan(spark, d: str) -> DataFrame:
    return apply.import_plan(_planned(spark, d), plan.render(tables.plan_notes(spark, d)))


def enrich_plan(spark, d: str) -> DataFrame:
    return apply.enrich_plan(_results(spark, d), tables.vault_notes(spark, d), RUN_DATE)


def split_plan(spark, d: str) -> DataFrame:
    long = tables.vault_notes(spark, d).where("words > 300").select("path")
    return apply.split_plan(_planned(spark, d), plan.render(tables.plan_notes(spark, d)), long, RUN_DATE)


def _titled_pairs(spark, d: str) -> DataFrame:
    return _pair_notes(spark, d).select("a", "b", "score", "title_a", "title_b")


def ranked_pairs(spark, d: str) -> DataFrame:
    """Pairs with their place in the report: by rounded score, then titles."""
    p = _titled_pairs(spark, d).withColumn("score", sim.rounded("score")).withColumn("low", -F.col("score"))
    return numbered(p, "low", "title_a", "title_b", "a", "b", name="place").select("a", "b", "score", "place")


def top_pairs(spark, d: str) -> DataFrame:
    return sim.top_pairs(_titled_pairs(spark, d))


def numbered_pairs(spark, d: str) -> DataFrame:
    return sim.numbered_pairs(_pairs(spark, d)).select("pair_id", "a", "b")


def group_verdicts(spark, d: str) -> DataFrame:
    """Answers to batches of five open groups: each names its even groups and one that was not asked."""
    g = _groups(spark, d).where("is_duplicate is null")
    asked = prompts.group_prompts(g.select("group_id", F.filter("notes", lambda x: x.isNotNull()).alias("notes")), tables.vault_notes(spark, d))
    answer = lambda i: F.struct(i.alias("group_id"), (i % 4 == 0).alias("is_duplicate"), (i % 10 / 10).alias("confidence"))
    named = F.transform(F.filter("groups", lambda i: i % 2 == 0), answer)
    stray = F.array(answer(F.lit(-2).cast("bigint")))
    return prompts.match_groups(asked.select("batch", "groups", F.to_json(F.struct(F.concat(named, stray).alias("groups"))).alias("payload"))).select("batch", "group_id", "is_duplicate", "confidence")


def pair_verdicts(spark, d: str) -> DataFrame:
    """Answers to numbered pairs: odd ones are to be linked, one number is unknown."""
    p = sim.numbered_pairs(_pairs(spark, d))
    one = F.to_json(F.struct(F.array(F.struct("pair_id", F.lit("link").alias("action"))).alias("pairs")))
    replied = p.where("pair_id % 2 = 1").select(one.alias("payload")).union(spark.createDataFrame([('{"pairs": [{"pair_id": -1}]}',)], "payload string"))
    return prompts.match_pairs(replied, p.select("pair_id", "a", "b")).select("pair_id", "a", "b", "action", "confidence")


def fenced_replies(spark, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", replies.fenced("text").alias("payload"))


def complete_replies(spark, d: str) -> DataFrame:
    """Replies whose payload is JSON as it stands."""
    f = fenced_replies(spark, d)
    return f.withColumn("json", replies.reply_json("payload")).where("json = payload").select("doc_id")


def vault_titles_taken(spark, d: str) -> DataFrame:
    """Notes of the vault, maps of content apart, whose title a note record has."""
    v = tables.vault_notes(spark, d).select(F.col("note_id").alias("plan_note_id"), "title", "note_type")
    return audit.title_collisions(v, tables.notes(spark, d).select("title", F.lit(None).cast("timestamp").alias("archived_at")))


def canonical_titles(spark, d: str) -> DataFrame:
    return _pair_notes(spark, d).select("a", "b", rewrite.canonical_title(F.col("title_a"), F.col("title_b")).alias("title"))


def links_to_add(spark, d: str) -> DataFrame:
    return sim.reciprocal_links(_pair_notes(spark, d))


def queries() -> dict:
    notes, plans = tables.notes, tables.plan_notes
    titles = lambda s, d: read_table(s, d, "title_index")
    return {
        "p6_found": orphans.p6_found,
        "p6_report": orphans.p6_report,
        "audit_findings": lambda s, d: audit.audit(notes(s, d)),
        "audit_summary": lambda s, d: audit.audit_summary(notes(s, d)),
        "fix_targets": lambda s, d: notes(s, d).where(audit.is_fix_target()).select("note_id", "words"),
        "empty_note_archive": empty_note_archive,
        "detect_mode": lambda s, d: audit.detect_mode(notes(s, d)),
        "link_degrees": lambda s, d: audit.link_degrees(notes(s, d)),
        "unresolved_links": lambda s, d: audit.unresolved_links(notes(s, d)),
        "titles_by_folder": lambda s, d: audit.titles_by_folder(titles(s, d)),
        "title_collisions": vault_titles_taken,
        "paragraphs": paragraphs,
        "word_counts": word_counts,
        "h1_titles": h1_titles,
        "wikilinks": wikilinks,
        "title_tokens": title_tokens,
        "first_words": first_words,
        "plan_violations": lambda s, d: plan.violations(plans(s, d)),
        "plan_unknown_tags": lambda s, d: plan.unknown_tags(plans(s, d), read_table(s, d, "moc_catalog")),
        "plan_orphan_links": lambda s, d: plan.orphan_links(plans(s, d)),
        "plan_links_to_vault": plan_links_to_vault,
        "proposed_tags": lambda s, d: plan.proposed_tags(plans(s, d)),
        "render_notes": lambda s, d: plan.render(plans(s, d)),
        "staged_files": lambda s, d: plan.last_per_name(plan.render(plans(s, d))).select("file_name", "plan_note_id"),
        "registry_rebuild": lambda s, d: registry.rebuild(notes(s, d)),
        "registry_drift": lambda s, d: registry.drift(read_table(s, d, "source_registry"), registry.rebuild(notes(s, d))),
        "registry_upsert": registry_upsert,
        "registry_after_merge": registry_after_merge,
        "write_plan": lambda s, d: registry.write_plan(_staged(s, d), _registered(s, d)),
        "supplement": supplement,
        "related_sections": related_sections,
        "enrichment": enrichment,
        "relinked": relinked,
        "overlap_pairs": overlap_pairs,
        "dedup_pairs": dedup_pairs,
        "dedup_groups": dedup_groups,
        "audit_similar": audit_similar,
        "unlinked_top": unlinked_top,
        "pair_components": lambda s, d: graph.components(_pairs(s, d)),
        "review_groups": review_groups,
        "group_strength": lambda s, d: graph.group_strength(review_groups(s, d)),
        "classified_pairs": classified,
        "canonical_bodies": canonical_bodies,
        "nearby_top3": nearby_top3,
        "related_top3": related_top3,
        "truncated_replies": truncated_replies,
        "reply_payloads": reply_payloads,
        "group_prompts": group_prompts,
        "import_prompts": import_prompts,
        "merge_plan": merge_plan,
        "frontmatter_gaps": frontmatter_gaps,
        "note_prompts": note_prompts,
        "pair_prompts": pair_prompts,
        "write_order": write_order,
        "write_tallies": lambda s, d: registry.tallies(_planned(s, d)),
        "plan_defaults": plan_defaults,
        "proposed_tag_log": lambda s, d: plan.proposed_tag_log(plans(s, d)),
        "import_plan": import_plan,
        "enrich_plan": enrich_plan,
        "split_plan": split_plan,
        "ranked_pairs": ranked_pairs,
        "top_pairs": top_pairs,
        "numbered_pairs": numbered_pairs,
        "group_verdicts": group_verdicts,
        "pair_verdicts": pair_verdicts,
        "action_counts": lambda s, d: sim.action_counts(classified(s, d)),
        "note_by_title": lambda s, d: sim.note_by_title(tables.vault_notes(s, d)),
        "fenced_replies": fenced_replies,
        "complete_replies": complete_replies,
        "canonical_titles": canonical_titles,
        "links_to_add": links_to_add,
        "section_levels": lambda s, d: docx.relevel(_sections(s, d)),
        "event_windows": lambda s, d: incremental.event_windows(read_table(s, d, "events")),
        "event_windows_stream": lambda s, d: incremental.stream_event_windows(s, f"{d}/events.parquet"),
    }


# ---- the same in SQL

_CLEAN = f"list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: {S.strip('x')}), lambda x: x is not null and x <> ''))"
_TARGET = S.strip("regexp_extract(x, '^[^|#]*', 0)")
_TARGETS = f"list_distinct(list_filter(list_transform(coalesce(links, []), lambda x: {_TARGET}), lambda x: x is not null and x <> ''))"
_NOTES = f"""n as (
  select note_id, coalesce(path, '') path, coalesce(title, '') title, coalesce(note_type, '') note_type, coalesce(source_doc, '') source_doc,
    frontmatter, coalesce(body, '') body, {_CLEAN} tags, {_TARGETS} links, {S.word_count('body')} words
  from {S.counting('note_records', 'note_id', 'scanned_at')})"""
_VAULT = f"""v as (
  select note_id, coalesce(path, '') path, coalesce(title, '') title, coalesce(note_type, '') note_type, coalesce(source_doc, '') source_doc,
    coalesce(body, '') body, {_CLEAN} tags, {S.word_count('body')} words
  from {S.counting('vault_notes', 'note_id', 'updated_at')}
  where coalesce(note_type, '') <> 'moc' and not ends_with(coalesce(title, ''), ' — MOC'))"""
_PLANS = f"p as {S.counting('plan_notes', 'plan_note_id', 'proposed_at')}"
_GROUPS = f"g as {S.counting('candidate_groups', 'group_id', 'verified_at')}"
_PAIRS = f"""{_GROUPS}, pr as (
  select least(x.a, x.b) a, greatest(x.a, x.b) b, max(coalesce(x.score, 0)) score from (select unnest(pairs) x from g)
  where x.a <> x.b group by 1, 2)"""
_SIDES = f"""{_PAIRS}, {_VAULT}, pn as (
  select pr.*, x.title title_a, y.title title_b, x.tags tags_a, y.tags tags_b, x.source_doc source_a, y.source_doc source_b
  from pr join v x on x.note_id = pr.a join v y on y.note_id = pr.b)"""
_ANTI = """rv as (select list_distinct(list_filter(notes, lambda x: x is not null)) ns from g where is_duplicate = false),
up as (select * from pr where not exists (select 1 from rv where len(ns) = 2 and list_min(ns) = a and list_max(ns) = b))"""
_COMPONENTS = """sym as (select a, b from {0} union select b, a from {0}),
reach as (select a node, a r from sym union select sym.b, reach.r from reach join sym on sym.a = reach.node),
roots as (select node, min(r) root from reach group by node)"""
_NO_FM = f"({S.is_blank('frontmatter')} or trim(frontmatter) in ('{{}}', 'null', '[]'))"
_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_NOT_BREAK = r"[^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_PARAS = f"list_filter(list_transform(regexp_split_to_array(body, '\\n{S.WS}*\\n'), lambda x: {S.strip('x')}), lambda x: x <> '')"
_LINKS = "regexp_extract_all({}, '\\[\\[([^\\]]+)\\]\\]', 1)"
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+', 0))"
_STOP = ", ".join(f"'{x}'" for x in sim.STOP_TOKENS)

_ORPHANS = f"""
with n as {S.counting('note_records', 'note_id', 'scanned_at')},
p as {S.counting('plan_notes', 'plan_note_id', 'proposed_at')},
refs as (
  select distinct 'note_records' src_table, note_id src_id, cast(null as bigint) plan_id, {S.target_key('x')} target, scanned_at ts
  from (select note_id, scanned_at, unnest(links) x from n)
  union all
  select distinct 'plan_notes', plan_note_id, plan_id, {S.target_key('x')}, proposed_at
  from (select plan_note_id, plan_id, proposed_at, unnest({_LINKS.format('body')}) x from p)),
titles as (select {S.title_key('title')} k, created_at, archived_at from title_index),
mocs as (select {S.title_key('title')} k from moc_catalog),
own as (select plan_id, {S.title_key('title')} k from p),
lost as (
  select src_table, src_id, target, ts from refs
  where target <> ''
  and not exists (select 1 from titles t where t.k = target and t.created_at <= ts and (t.archived_at is null or t.archived_at > ts))
  and not exists (select 1 from mocs m where m.k = target)
  and not exists (select 1 from own o where o.k = target and o.plan_id = refs.plan_id))
"""


def _render_sql() -> str:
    return f"""select plan_note_id, {_safe('coalesce(title, $$$$)')} || '.md' file_name,
  '---' || chr(10) || 'tags:' || chr(10) || array_to_string(list_transform(coalesce(tags, []), lambda t: '  - ' || coalesce(t, 'None')), chr(10))
  || chr(10) || 'date: ' || coalesce(note_date, '') || chr(10) || 'source_doc: "' || replace(coalesce(source_doc, ''), '"', chr(92) || '"') || '"'
  || chr(10) || 'note_type: ' || coalesce(note_type, '') || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') || chr(10) content from p"""


def _safe(x: str) -> str:
    t = S.strip(f"regexp_replace(replace({x}, chr(0), ''), '[\\\\/:\"*<>?|]', '-', 'g')")
    fits = f"list_max(list_filter(range(0, 201), lambda k: strlen(left({t}, k)) <= 200))"
    return f"case when strlen({t}) <= 200 then {t} else {S.strip(f'left({t}, {fits})')} end"


_FIRST = "case when len({ws}) > {n} then array_to_string({ws}[1:{n}], ' ') || ' [...]' else {body} end"


def _first_words(body: str, n: int) -> str:
    return _FIRST.format(ws=f"regexp_extract_all({body}, '{S.NOT_WS}+', 0)", n=n, body=body)


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{S.WS}+$', '')"


_NL = "chr(10)"
_WRITE = f"""{_NOTES}, {_PLANS}, r as (select distinct source_doc, title from n where not {S.is_blank('source_doc')}),
    s as (select plan_note_id id, coalesce(title, '') title, coalesce(note_type, '') note_type, coalesce(source_doc, '') source_doc from p),
    j as (select s.*, s.note_type <> 'moc' and s.source_doc <> '' and exists (select 1 from r where r.source_doc = s.source_doc and r.title = s.title) k from s),
    wp as (select id, title, case when k then 'skip' else 'create' end action, case when k then null when note_type = 'moc' then 'MOCs' when note_type = 'source' then 'Sources' else 'Notes' end folder,
      not k and source_doc <> '' registered, case when k then 'skipped' when note_type = 'moc' then 'moc' else 'note' end counted_as from j)"""
#: Archive names of (path, stem) in a relation, numbered where they meet.
_ARCHIVED = "select 'archive' op, path, '.archive/' || base || case when nth > 1 then '_' || (nth - 1) else '' end || '.md' dest, null::varchar as content from (select path, '{1}' || stem base, row_number() over (partition by stem order by path) nth from (select distinct path, regexp_extract(path, '([^/]+)\\.md$', 1) stem from {0}))"
_WHOLE_LINK = "'\\[\\[([^\\[\\]]+)\\]\\]'"


def _content_sql(p: str) -> str:
    """The file of a planned note, as in render_notes."""
    return f"""'---' || {_NL} || 'tags:' || {_NL} || array_to_string(list_transform(coalesce({p}tags, []), lambda t: '  - ' || coalesce(t, 'None')), {_NL})
  || {_NL} || 'date: ' || coalesce({p}note_date, '') || {_NL} || 'source_doc: "' || replace(coalesce({p}source_doc, ''), '"', chr(92) || '"') || '"'
  || {_NL} || 'note_type: ' || coalesce({p}note_type, '') || {_NL} || '---' || {_NL} || {_NL} || coalesce({p}body, '') || {_NL}"""


def _related_sql(start: str, targets: str) -> str:
    """append_related for each target in turn."""
    link = "'[[' || t || ']]'"
    body = _rstrip("c")
    one = f"case when contains(c, {link}) then c when contains({body} || {_NL}, '{rewrite.RELATED}') then {body} || {_NL} || '- ' || {link} || {_NL} else {body} || {_NL} || {_NL} || '{rewrite.RELATED}' || {_NL} || '- ' || {link} || {_NL} end"
    return f"list_reduce({targets}, lambda c, t: {one}, {start})"


_FENCED = f"""with x as (select doc_id, {S.strip('text')} s from documents where text is not null)
            select doc_id, case when regexp_matches(s, '(?s)```json\\s*(.*?)\\s*```') then {S.strip("regexp_extract(s, '(?s)```json[ \\t\\n\\v\\f\\r]*(.*?)[ \\t\\n\\v\\f\\r]*```', 1)")}
            when not contains(s, '```json') and regexp_matches(s, '(?s)```\\s*(.*?)\\s*```') then {S.strip("regexp_extract(s, '(?s)```[ \\t\\n\\v\\f\\r]*(.*?)[ \\t\\n\\v\\f\\r]*```', 1)")} else s end payload from x""".replace("\\\\", "\\")

_WINDOWS = "select date_trunc('hour', ts) start, event_type, count(*) events, sum(value::decimal(18, 4))::double total from events group by all"


def oracle_sql() -> dict[str, str]:
    w = "with "
    return {
        "p6_found": _ORPHANS + "select src_table, src_id, target, strftime(ts, '%Y-%m') ref_month from lost",
        "p6_report": _ORPHANS + "select src_table, strftime(ts, '%Y-%m') ref_month, count(*) orphans, count(distinct target) targets from lost group by all",
        "audit_findings": w + _NOTES + f""" select * from (select note_id, title, words, case when words = 0 and {_NO_FM} then 'empty'
            when note_type = 'atomic' and words between 1 and 79 then 'thin' when note_type = 'atomic' and words >= 80 and len(links) = 0 then 'no_links' end finding from n) where finding is not null""",
        "audit_summary": w + _NOTES + f""" select count(*) notes, count_if(note_type = 'atomic')::bigint atomic, count_if(words = 0 and {_NO_FM})::bigint empty,
            count_if(note_type = 'atomic' and words between 1 and 79)::bigint thin, count_if(note_type = 'atomic' and words >= 80 and len(links) = 0)::bigint no_links from n""",
        "fix_targets": w + _NOTES + " select note_id, words from n where note_type = 'atomic' and (words < 80 or len(links) = 0)",
        "empty_note_archive": w + _NOTES + f" select note_id, '.archive/empty-notes/{RUN_DATE}/' || path dest from n where {S.is_blank('body')} and words = 0 and {_NO_FM}",
        "detect_mode": w + _NOTES + f""", k as (select *, case when json_valid(frontmatter) and json_type(frontmatter) = 'OBJECT' then json_keys(frontmatter) else [] end ks, len({_PARAS}) parts from n)
            select note_id, case when list_contains(ks, 'source_doc') and list_contains(ks, 'note_type') then 'skip' when words < 20 then 'too_short'
            when words > 600 or parts >= 3 and words > 300 then 'atomize' else 'enrich' end mode from k""",
        "link_degrees": w + _NOTES + " select title, count(*) incoming from (select unnest(links) title from n) group by 1",
        "unresolved_links": w + _NOTES + ", e as (select note_id src_id, unnest(links) dst_title from n) select src_id, dst_title from e where dst_title not in (select title from n)",
        "titles_by_folder": "select folder, title, count(distinct title_id) copies from title_index where archived_at is null and title is not null group by all",
        "title_collisions": w + _NOTES + ", " + _VAULT + " select note_id plan_note_id, title from v where title in (select title from n)",
        "paragraphs": w + _VAULT + f", x as (select note_id, {_PARAS} ps from v), y as (select note_id, unnest(ps) paragraph, unnest(range(0, len(ps))) para_no from x) select note_id, para_no::integer para_no, paragraph from y",
        "word_counts": f"select note_id, {S.word_count('body')} words, word_count is distinct from {S.word_count('body')} stored_differs from {S.counting('vault_notes', 'note_id', 'updated_at')}",
        "h1_titles": f"select doc_id, case when regexp_matches(coalesce(text, ''), '(?:^|{_BREAKS})# ') then {S.strip(f'''regexp_extract(text, '(?:^|{_BREAKS})# ({_NOT_BREAK}*)', 1)''')} else coalesce(title, '') end h1 from documents",
        "wikilinks": w + _PLANS + f""" select plan_note_id, list_sort(list_distinct(list_filter(list_transform({_LINKS.format('body')}, lambda x: {S.strip("regexp_extract(x, '^[^|#]*', 0)")}), lambda x: x <> ''))) targets,
            list_sort(list_transform({_LINKS.format('body')}, lambda x: {S.strip('x')})) written from p where body is not null""",
        "title_tokens": w + _NOTES + f" select note_id, list_sort({_TOKENS.format('title')}) tokens, list_sort(list_filter({_TOKENS.format('title')}, lambda x: length(x) >= 4 and x not in ({_STOP}))) topic_tokens from n",
        "first_words": w + _VAULT + f", x as (select note_id, body, regexp_extract_all(body, '{S.NOT_WS}+', 0) ws from v) select note_id, case when len(ws) > 40 then array_to_string(ws[1:40], ' ') || ' [...]' else body end start from x",
        "plan_violations": w + _PLANS + """, o as (select *, row_number() over (partition by plan_id, coalesce(id, '<note[' || ord || ']>') order by ord, plan_note_id) nth from p)
            select plan_id, plan_note_id, 'missing_fields' as rule from o where id is null or title is null or note_type is null or tags is null or source_doc is null or note_date is null or body is null
            union all select plan_id, plan_note_id, 'bad_type' from o where coalesce(note_type not in ('atomic', 'moc', 'source'), true)
            union all select plan_id, plan_note_id, 'tag_count' from o where coalesce(len(tags), 0) not between 2 and 5
            union all select plan_id, plan_note_id, 'dup_id' from o where nth > 1
            union all select plan_id, null, 'moc_count' from o group by plan_id having count_if(note_type = 'moc') <> 1""",
        "plan_unknown_tags": w + _PLANS + " select plan_note_id, tag from (select plan_note_id, unnest(tags) tag from p) where tag is not null and tag not in (select tag from moc_catalog where tag is not null)",
        "plan_orphan_links": w + _PLANS + f", l as (select plan_id, plan_note_id, {S.strip('x')} target from (select plan_id, plan_note_id, unnest({_LINKS.format('body')}) x from p)) select plan_note_id, target from l where not exists (select 1 from p where p.plan_id = l.plan_id and coalesce(p.title, '') = l.target)",
        "plan_links_to_vault": w + _PLANS + f", l as (select plan_id, plan_note_id, {S.strip('x')} target from (select plan_id, plan_note_id, unnest({_LINKS.format('body')}) x from p)) select plan_note_id, target from l where not exists (select 1 from p where p.plan_id = l.plan_id and coalesce(p.title, '') = l.target) and not exists (select 1 from title_index t where t.archived_at is null and t.title = l.target)",
        "proposed_tags": w + _PLANS + " select distinct plan_id, x.tag tag, x.reason reason from (select plan_id, unnest(proposed_new_tags) x from p)",
        "render_notes": w + _PLANS + " " + _render_sql(),
        "staged_files": w + _PLANS + f" select file_name, max(plan_note_id) plan_note_id from ({_render_sql()}) group by 1",
        "registry_rebuild": w + _NOTES + f", s as (select *, coalesce(case when json_valid(frontmatter) then json_extract_string(frontmatter, '$.date') end, '') d from n where not {S.is_blank('source_doc')}) select source_doc, coalesce(min({{'p': path, 'd': d}}) filter (where d <> '')['d'], '') date, count(distinct title) note_count from s group by 1".replace("min({'p': path, 'd': d}) filter (where d <> '')['d']", "(min({'p': path, 'd': d}) filter (where d <> ''))['d']"),
        "registry_drift": w + _NOTES + f", s as (select source_doc, count(distinct title) c from n where not {S.is_blank('source_doc')} group by 1) select r.source_doc, coalesce(r.note_count, -1)::bigint noted, coalesce(c, 0)::bigint found from source_registry r left join s on s.source_doc = r.source_doc where coalesce(r.note_count, -1) <> coalesce(c, 0)",
        "registry_upsert": w + _NOTES + ", " + _PLANS + f", o as (select source_doc, title from n where not {S.is_blank('source_doc')} union select source_doc, title from p where source_doc is not null and title is not null), dt as (select source_doc, min(note_date) d from p where title is not null and coalesce(note_date, '') <> '' group by 1) select o.source_doc, o.title, coalesce(d, '') date from o left join dt on dt.source_doc = o.source_doc",
        "registry_after_merge": w + _VAULT + ", " + _GROUPS + """, m as (select distinct group_id, canonical_title, list_min(notes) f, unnest(notes) i from g where is_duplicate),
            mm as (select v.source_doc, v.title, case when m.i = m.f then canonical_title end c from m join v on v.note_id = m.i)
            select source_doc, title from v where source_doc <> '' and not exists (select 1 from mm where mm.source_doc = v.source_doc and mm.title = v.title)
            union select source_doc, c from mm where c is not null and source_doc <> ''""",
        "write_plan": w + _WRITE + " select * from wp",
        "write_tallies": w + _WRITE + " select count_if(counted_as = 'note')::bigint notes, count_if(counted_as = 'moc')::bigint mocs, count_if(counted_as = 'skipped')::bigint skipped from wp",
        "write_order": w + _PLANS + f", x as (select plan_id, plan_note_id id, coalesce(note_type, '') = 'moc' or ends_with(file_name, ' — MOC.md') m, file_name from (select plan_id, note_type, plan_note_id, {_safe('coalesce(title, $$$$)')} || '.md' file_name from p)) select plan_id, id, row_number() over (partition by plan_id order by m, file_name, id)::integer place from x",
        "plan_defaults": w + _PLANS + " select plan_note_id, coalesce(len(proposed_new_tags), 0)::integer proposals from p",
        "proposed_tag_log": w + _PLANS + """, x as (select plan_id, ord, plan_note_id, unnest(proposed_new_tags) x, unnest(range(0, len(proposed_new_tags))) nth from p),
            y as (select plan_id, x.tag tag, x.reason reason, min({'o': ord, 'p': plan_note_id, 'n': nth}) f from x where x is not null group by all) select plan_id, row_number() over (partition by plan_id order by f)::integer place, tag, reason from y""",
        "import_plan": w + _WRITE + f", f as (select folder || '/' || file_name path, content, id from wp join ({_render_sql()}) r on r.plan_note_id = wp.id where action <> 'skip') select 'write' op, path, null::varchar dest, max_by(content, id) as content from f group by path",
        "split_plan": w + _WRITE + ", " + _VAULT + f", f as (select folder || '/' || file_name path, content, id from wp join ({_render_sql()}) r on r.plan_note_id = wp.id where action <> 'skip'), long as (select path from v where words > 300) " + _ARCHIVED.format("long", f"{RUN_DATE}_") + " union all select 'write', path, null, max_by(content, id) from f group by path",
        "enrich_plan": w + _VAULT + ", " + _PLANS + f""", e as (select v.note_id, v.path, p.title, p.tags, p.source_doc, p.note_date, p.note_type, p.body, case when v.note_id % 3 = 0 then p.title when v.note_id % 3 = 1 then v.title end was from p join v on v.note_id = p.plan_note_id),
            f as (select *, title = coalesce(was, title) same, {_content_sql('')} as content, {_safe('coalesce(title, $$$$)')} || '.md' file_name from e),
            o as (select path from f where not same), x as (select case when same then path else 'Notes/' || file_name end path, note_id, content from f) {_ARCHIVED.format('o', f'{RUN_DATE}_')}
            union all select 'write', path, null, max_by(content, note_id) from x group by path""",
        "merge_plan": w + _GROUPS + ", " + _VAULT + f""", q as (select * from g where is_duplicate and canonical_title is not null and canonical_body is not null),
            m as (select distinct group_id, unnest(notes) note_id from q), mv as (select m.group_id, v.note_id, v.path, v.source_doc from m join v on v.note_id = m.note_id),
            o as (select path from mv), fs as (select group_id, min_by(source_doc, note_id) s from mv group by 1),
            c as (select q.group_id, q.canonical_title title, q.canonical_tags tags, '{RUN_DATE}' note_date, s source_doc, 'atomic' note_type, canonical_body body from q join fs on fs.group_id = q.group_id),
            f as (select {_safe('title')} || '.md' file_name, {_content_sql('')} as content, group_id from c) {_ARCHIVED.format('o', f'{RUN_DATE}_dedup_')}
            union all select 'write', 'Notes/' || file_name, null, min_by(content, group_id) from f group by file_name""",
        "relinked": w + _GROUPS + ", " + _VAULT + ", " + _PLANS + f""", m as (select v.title as old, min(canonical_title) as new from (select canonical_title, unnest(notes) i from g where is_duplicate and canonical_title is not null) x join v on v.note_id = x.i where v.title <> canonical_title group by v.title),
            l as (select plan_note_id, coalesce(body, '') body, regexp_extract_all(coalesce(body, ''), {_WHOLE_LINK}, 0) ls, regexp_split_to_array(coalesce(body, ''), {_WHOLE_LINK}) bs from p),
            u as (select plan_note_id, unnest(ls) x, unnest(range(1, len(ls) + 1)) k from l), t as (select plan_note_id, k, coalesce('[[' || m.new || ']]', x) x, m.new is not null hit from u left join m on m.old = x[3:-3]),
            a as (select plan_note_id, list(x order by k) xs from t group by 1 having bool_or(hit))
            select plan_note_id note_id, list_reduce(list_transform(range(1, len(bs) + 1), lambda k: bs[k] || coalesce(xs[k], '')), lambda y, z: y || z) body from l join a using (plan_note_id)""",
        "related_sections": w + _SIDES + f""", e as (select a note_id, title_b t from pn where score >= 0.8 union select b, title_a from pn where score >= 0.8), k as (select note_id, list_sort(list(t)) ts from e where t <> '' group by 1)
            select v.note_id, {_related_sql('v.body', 'ts')} as content from v join k on k.note_id = v.note_id""",
        "links_to_add": w + _SIDES + " select a note_id, title_b target from pn union select b, title_a from pn",
        "canonical_titles": w + _SIDES + f", x as (select *, {S.title_key('title_a')} ka, {S.title_key('title_b')} kb from pn) select a, b, case when length(title_a) < length(title_b) then title_a when length(title_b) < length(title_a) then title_b when contains(ka, kb) and not contains(kb, ka) then title_b else title_a end title from x",
        "ranked_pairs": w + _SIDES + ", x as (select *, printf('%.3f', score)::double r from pn) select a, b, r score, row_number() over (order by r desc, title_a, title_b, a, b) - 1 place from x",
        "top_pairs": w + _SIDES + " select a, b, score, title_a, title_b from pn order by score desc, title_a, title_b, a, b limit 20",
        "numbered_pairs": w + _PAIRS + " select row_number() over (order by a, b) pair_id, a, b from pr",
        "pair_verdicts": w + _PAIRS + ", x as (select row_number() over (order by a, b) pair_id, a, b from pr) select pair_id, a, b, 'link' action, 0.0::double confidence from x where pair_id % 2 = 1",
        "group_verdicts": w + _GROUPS + ", " + _VAULT + """, o as (select group_id, notes from g where is_duplicate is null), k as (select distinct group_id from (select group_id, unnest(notes) i from o) where i in (select note_id from v)),
            x as (select group_id, (row_number() over (order by group_id) - 1) // 5 batch from k) select batch::bigint batch, group_id, group_id % 4 = 0 is_duplicate, (group_id % 10 / 10)::double confidence from x where group_id % 2 = 0""",
        "group_prompts": w + _GROUPS + ", " + _VAULT + f""", o as (select group_id, list_distinct(list_filter(notes, lambda x: x is not null)) ns from g where is_duplicate is null), k as (select group_id, unnest(ns) i from o),
            t as (select group_id, string_agg('### ' || title || {_NL} || 'Tags: ' || array_to_string(list_sort(tags), ', ') || {_NL} || 'Source: ' || source_doc || {_NL} || 'Words: ' || words || {_NL} || {_NL} || {_first_words('body', 300)}, {_NL} || {_NL} order by note_id) x from k join v on v.note_id = k.i group by 1),
            b as (select group_id, x, (row_number() over (order by group_id) - 1) // 5 batch from t) select batch::bigint batch, list(group_id order by group_id) groups, string_agg('## Group ' || group_id || {_NL} || {_NL} || x, {_NL} || {_NL} || '---' || {_NL} || {_NL} order by group_id) prompt from b group by 1""",
        "import_prompts": f"""with s as {S.counting('doc_sections', 'section_id', 'parsed_at')}
            select source_file, section_idx, 'Split the document into notes. Answer in JSON.' || {_NL} || {_NL} || 'Allowed tags: study/memory' || {_NL} || {_NL} || 'Document:' || {_NL} || '{{' || array_to_string(list_filter([
              '"source_file":' || to_json(source_file)::varchar, '"heading":' || to_json(heading)::varchar, '"level":' || level, '"paragraphs":' || to_json(paragraphs)::varchar], lambda x: x is not null and not ends_with(x, ':null')), ',') || '}}' prompt from s""",
        "enrichment": w + _NOTES + f""", th as (select * from n where note_type = 'atomic' and words between 1 and 79), k as (select note_id, unnest(list_filter({_TOKENS.format('title')}, lambda x: length(x) >= 4)) t from n),
            sc as (select a.note_id target, b.note_id note, 1 s from k a join k b on a.t = b.t and a.note_id <> b.note_id where a.note_id in (select note_id from th)
              union all select a.note_id, b.note_id, 3 from th a join n b on a.source_doc = b.source_doc and a.source_doc <> '' and a.note_id <> b.note_id),
            tp as (select target, title, row_number() over (partition by target order by sum(s) desc, title, note) r from sc join n on n.note_id = sc.note group by target, note, title qualify r <= 3),
            nr as (select target, list(title order by r) ts from tp group by 1), j as (select note_id, title, body, coalesce(ts, []) ts from th left join nr on target = note_id),
            b as (select note_id, body, {_rstrip('body')} b, '{rewrite.ENRICHED}' || {_NL} || {_NL} || {S.strip(f"case when contains(lower(title), 'registry') then 'A registry keeps what was done.' || case when len(ts) >= 2 then {_NL} || {_NL} || 'Compare [[' || ts[1] || ']] and [[' || ts[2] || ']].' else '' end when len(ts) > 0 then 'See also: [[' || array_to_string(ts, ']], [[') || ']].' else 'This note has no neighbours yet.' end")} || {_NL} block from j)
            select note_id, case when contains(body, '{rewrite.ENRICHED}') then body when contains(b, {_NL} || '{rewrite.RELATED}') then {_rstrip(f"left(b, instr(b, {_NL} || '{rewrite.RELATED}') - 1)")} || {_NL} || {_NL} || block || substr(b, instr(b, {_NL} || '{rewrite.RELATED}')) || {_NL} else b || {_NL} || {_NL} || block end as content from b""",
        "pair_prompts": w + _SIDES.replace("x.source_doc source_a", "x.body body_a, y.body body_b, x.source_doc source_a") + f" select a, b, 'Score: ' || score || {_NL} || {_NL} || '### A: ' || title_a || {_NL} || {_NL} || {_first_words('body_a', 220)} || {_NL} || {_NL} || '### B: ' || title_b || {_NL} || {_NL} || {_first_words('body_b', 220)} prompt from pn where score between 0.8 and 0.9",
        "action_counts": w + _SIDES + " select count(*) candidates, count_if(source_a = source_b and source_a <> '' and score >= 0.9)::bigint as merge, count_if(not (source_a = source_b and source_a <> '' and score >= 0.9) and score >= 0.8)::bigint as link, count_if(score < 0.8)::bigint as ignore from pn",
        "note_by_title": w + _VAULT + " select title, max_by(note_id, {'p': path, 'i': note_id}) note_id from v group by 1",
        "fenced_replies": _FENCED,
        "complete_replies": f"select doc_id from ({_FENCED}) where json_valid(payload)",
        "supplement": w + _NOTES + ", " + _PLANS + """, l as (select title, note_type, source_doc from p where title is not null qualify row_number() over (partition by title order by plan_id desc, ord desc, plan_note_id desc) = 1)
            select n.note_id, n.title, case when n.note_type = '' then coalesce(l.note_type, '') else n.note_type end note_type, case when n.source_doc = '' then coalesce(l.source_doc, '') else n.source_doc end source_doc from n left join l on l.title = n.title""",
        "overlap_pairs": w + _VAULT + f""", t as (select note_id, tags, {_TOKENS.format('title')} tk from v),
            c as (select a.note_id a, b.note_id b, len(list_intersect(a.tags, b.tags)) i, len(list_distinct(a.tags || b.tags)) u, len(list_intersect(a.tk, b.tk)) j, len(list_distinct(a.tk || b.tk)) w from t a join t b on a.note_id < b.note_id),
            s as (select a, b, 0.6::double * (case when u = 0 then 0.0 else i / u end)::double + 0.4::double * (case when w = 0 then 0.0 else j / w end)::double score from c) select a, b, score from s where score >= 0.7::double""",
        "pair_components": "with recursive " + _PAIRS + ", " + _COMPONENTS.format("pr") + " select node, root from roots",
        "review_groups": "with recursive " + _PAIRS + ", " + _ANTI + ", " + _COMPONENTS.format("up") + ", sz as (select root, count(*) c from roots group by 1) select case when c <= 4 then root::varchar else root || ':' || a || ':' || b end group_key, a, b, score from up join roots on node = a join sz using (root)",
        "group_strength": "with recursive " + _PAIRS + ", " + _ANTI + ", " + _COMPONENTS.format("up") + ", sz as (select root, count(*) c from roots group by 1), k as (select case when c <= 4 then root::varchar else root || ':' || a || ':' || b end group_key, score from up join roots on node = a join sz using (root)) select group_key, count(*) pairs, max(score) best from k group by 1",
        "classified_pairs": w + _SIDES + ", c as (select *, case when source_a = source_b and source_a <> '' and score >= 0.9 then 'merge' when score >= 0.8 then 'link' else 'ignore' end action from pn) select a, b, action, case when action = 'merge' then least(0.99::double, score + 0.03::double) end confidence, case when action = 'merge' then list_sort(list_distinct(tags_a || tags_b))[1:5] end tags from c",
        "nearby_top3": w + _NOTES + f""", t as (select note_id target, source_doc s, list_filter({_TOKENS.format('title')}, lambda x: length(x) >= 4) tk from n where note_type = 'atomic' and words between 1 and 79 order by words, title, note_id limit 10),
            m as (select note_id note, title, source_doc s, list_filter({_TOKENS.format('title')}, lambda x: length(x) >= 4) tk from n),
            c as (select target, title, note, (case when t.s = m.s and t.s <> '' then 3 else 0 end + len(list_intersect(t.tk, m.tk)))::bigint score from t join m on target <> note)
            select target, title, score, row_number() over (partition by target order by score desc, title, note)::integer place from c where score > 0 qualify place <= 3""",
        "frontmatter_gaps": w + _NOTES + """, k as (select note_id, case when json_valid(frontmatter) and json_type(frontmatter) = 'OBJECT' then json_keys(frontmatter) else [] end ks from n where frontmatter is not null)
            select * from (select note_id, list_sort(list_filter(['tags', 'date', 'source_doc', 'note_type'], lambda x: not list_contains(ks, x))) missing from k) where len(missing) > 0""",
        "note_prompts": w + _NOTES + " select note_id, 'Enrich the note. Answer in JSON.' || chr(10) || chr(10) || 'Allowed tags: study/memory' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || chr(10) || body prompt from n where note_type = 'atomic' and words between 1 and 79",
        "truncated_replies": f"with x as (select doc_id, regexp_replace(text, '{S.WS}+$', '') s from documents) select doc_id, coalesce(s = '' or (ends_with(s, '\"') and (length(s) - length(replace(s, '\"', ''))) % 2 <> 0) or length(s) - length(regexp_replace(s, '[{{\\[]', '', 'g')) > length(s) - length(regexp_replace(s, '[}}\\]]', '', 'g')) + 1 or right(s, 1) in (',', ':', '\\'), true) truncated from x",
        "section_levels": f"with s as {S.counting('doc_sections', 'section_id', 'parsed_at')}, o as (select source_file, coalesce(min(level) filter (where heading is not null and level > 0), 1) - 1 off from s group by 1) select section_id, s.source_file, heading, case when heading is null then 0 else level - off end::integer as level from s join o on o.source_file = s.source_file",
        "event_windows": _WINDOWS,
        "event_windows_stream": _WINDOWS,
    }
