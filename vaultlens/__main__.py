"""Command line of the library: python -m vaultlens COMMAND VAULT [options]; each command has --help.

Commands that change files plan first: without --apply they write the plan's
operations, with it the plan is carried out. Results are JSON.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = {
    "audit": "findings, unlinked similar notes and their counts",
    "scan": "titles by folder",
    "links": "links to no note",
    "registry": "sources and their titles, rebuilt from the vault; --apply writes --output",
    "doctor": "whether the registry (--registry) and the vault agree",
    "dedup": "groups of similar notes for review",
    "fix-similar": "merge or link similar notes",
    "fix-atomic": "link short and unlinked notes to related ones",
    "enrich-thin": "name the nearest notes in short ones",
    "archive-empty": "archive empty notes",
    "parse": "sections of the .docx files below a path",
    "generate": "render a JSON plan (--plan) into a folder",
    "write": "import a JSON plan (--plan) into the vault",
    "relink": "turn links by a JSON map of old to new titles (--map)",
}
#: Rows of each section that a report shows, and notes or pairs that a fix takes up, where no limit is given.
LIMITS = {"audit": 25, "fix-similar": 20, "fix-atomic": 20, "enrich-thin": 10}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vaultlens")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        c = commands.add_parser(name, help=text)
        c.add_argument("vault", help="folder of the vault" if name != "parse" else "folder of the documents")
        c.add_argument("--limit", type=int, default=LIMITS.get(name), help="rows of each section; all where there is no default")
        c.add_argument("--min-words", type=int, default=80)
        c.add_argument("--threshold", type=float)
        c.add_argument("--max-links", type=int, default=3)
        c.add_argument("--folder", default="", help="read this folder of the vault only")
        c.add_argument("--exclude", action="append", default=[], help="name of a file to leave out; may be repeated")
        c.add_argument("--reviewed", help="review log whose pairs are left out")
        c.add_argument("--registry", help="JSON registry of processed sources")
        c.add_argument("--plan", help="JSON plan of notes")
        c.add_argument("--map", help="JSON map of old to new titles")
        c.add_argument("--on-conflict", choices=["skip", "overwrite"], default="skip")
        c.add_argument("--output", help="write the result to this file")
        c.add_argument("--run-date", default=datetime.date.today().isoformat())
        how = c.add_mutually_exclusive_group()
        how.add_argument("--apply", action="store_true", help="carry the plan out")
        how.add_argument("--dry-run", action="store_true", help="only plan, which is the default")
    return p.parse_args(argv)


class Run:
    """One command over one vault."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        from vaultlens.sources import vault

        self.spark, self.a = spark, a
        self.files = None if a.command == "parse" else vault.read_vault(spark, a.vault, folder=a.folder, exclude=a.exclude, skip_dirs="" if a.command in ("registry", "doctor") else ",".join(vault.SKIP_DIRS))

    def notes(self, *, lenient: bool = False) -> DataFrame:
        """The vault's notes, their paths relative to it."""
        from vaultlens.plans.runtime import materialize
        from vaultlens.sources import vault

        n = (vault.lenient_notes if lenient else vault.strict_notes)(self.files).drop("path").withColumnRenamed("rel_path", "path")
        empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
        n = n.withColumns({c: empty(c) for c in ("note_type", "source_doc")}).withColumn("note_id", F.xxhash64("path"))
        return materialize(n.join(self.files.select(F.col("rel_path").alias("path"), F.col("text").alias("content")), "path"), "cli-notes")

    def rows(self, df: DataFrame, *order: str) -> list[dict]:
        df = df.orderBy(*order) if order else df
        return [r.asDict(recursive=True) for r in (df.limit(self.a.limit) if self.a.limit else df).collect()]

    def carry_out(self, plan: DataFrame, root: str | None = None) -> dict:
        from vaultlens.operators import apply
        from vaultlens.plans.runtime import materialize

        plan = materialize(plan, "plan")
        done = dict(apply.apply_plan(plan, root or self.a.vault, dry_run=not self.a.apply))
        listed = [r.asDict() for r in plan.select("op", "path", "dest").orderBy("op", "path").collect()]
        return {"applied": self.a.apply, "counts": done, "operations": listed}

    def reviewed_pairs(self, pairs: DataFrame, notes: DataFrame) -> DataFrame:
        """pairs without those whose two titles the review log names."""
        from vaultlens.operators import similarity
        from vaultlens.sources import files

        if not self.a.reviewed:
            return pairs
        log = files.load_reviewed(self.spark, self.a.reviewed).withColumn("entry", F.monotonically_increasing_id())
        by_title = notes.select("title", "note_id").distinct()
        known = log.where(F.size(F.array_distinct("titles")) == 2)
        sides = [known.select("entry", F.element_at("titles", k).alias("title")).join(by_title, "title").select("entry", F.col("note_id").alias(f"n{k}")) for k in (1, 2)]
        return similarity.without_reviewed(pairs, sides[0].join(sides[1], "entry").select(F.array("n1", "n2").alias("notes")))

    # ---- reports

    def audit(self) -> dict:
        from vaultlens.operators import audit, similarity
        from vaultlens.plans.runtime import materialize

        n = self.notes()
        live = n.where("note_type <> 'moc'")
        pairs = materialize(similarity.without_linked(similarity.similar_pairs(live, similarity.AUDIT, self.a.threshold or 0.72), live), "cli-similar")
        found = materialize(audit.audit(n, self.a.min_words), "cli-findings")
        out = {"summary": audit.with_similar(audit.audit_summary(n, self.a.min_words), pairs).first().asDict()}
        for kind in ("empty", "thin", "no_links"):
            out[kind] = self.rows(found.where(F.col("finding") == kind).join(n.select("note_id", "path"), "note_id").select("path", "title", "words"), "words", "title", "path")
        out["similar"] = self.rows(similarity.report_order(pairs).select("title_a", "title_b", "score"))
        return out

    def scan(self) -> dict:
        return {"titles": self.rows(self.files.select("folder", "stem"), "folder", "stem")}

    def links(self) -> dict:
        from vaultlens.operators import audit

        return {"unresolved": self.rows(audit.unresolved_links(self.notes()), "src_id", "dst_title")}

    def registry(self) -> dict:
        from vaultlens.operators import registry
        from vaultlens.sources import files

        n = self.notes()
        if self.a.apply:
            if not self.a.registry:
                raise SystemExit("--apply needs --registry")
            titles = registry.titles_of_sources(n).select("source_doc", "title").distinct()
            files.write_registry(self.a.registry, titles.join(registry.rebuild(n).select("source_doc", "date"), "source_doc"))
        return {"sources": self.rows(registry.rebuild(n), "source_doc")}

    def doctor(self) -> dict:
        from vaultlens.operators import registry
        from vaultlens.sources import files

        noted = files.load_registry(self.spark, self.a.registry or "").groupBy("source_doc").agg(F.countDistinct("title").alias("note_count"))
        return {"drift": self.rows(registry.drift(noted, registry.rebuild(self.notes())), "source_doc")}

    def dedup(self) -> dict:
        from vaultlens.operators import graph, similarity
        from vaultlens.plans.runtime import materialize

        n = self.notes(lenient=True)
        pairs = self.reviewed_pairs(similarity.similar_pairs(n, similarity.DEDUP, self.a.threshold or 0.55), n)
        names = n.select("note_id", "path")
        g = graph.candidate_groups(materialize(pairs, "cli-pairs")).join(names.toDF("a", "path_a"), "a").join(names.toDF("b", "path_b"), "b")
        return {"groups": self.rows(g.select("group_key", "path_a", "path_b", similarity.rounded("score").alias("score")), "group_key", "path_a", "path_b")}

    def parse(self) -> dict:
        from vaultlens.sources import docx

        return {"paragraphs": self.rows(docx.read_docx(self.spark, self.a.vault), "source_file", "section_idx", "para_idx")}

    # ---- changes

    def fix_similar(self) -> dict:
        from vaultlens.operators import apply, registry, rewrite, similarity
        from vaultlens.plans.runtime import materialize

        n = self.notes(lenient=True).withColumn("title", F.col("stem"))
        pairs = similarity.without_linked(similarity.similar_pairs(n, similarity.AUDIT, self.a.threshold or 0.72), n)
        top = materialize(similarity.top_pairs(self.reviewed_pairs(pairs, n), self.a.limit), "cli-top")
        side = lambda x: n.select(F.col("note_id").alias(x), F.col("source_doc").alias(f"source_{x}"), F.col("tags").alias(f"tags_{x}"), F.col("body").alias(f"body_{x}"))
        both = materialize(top.join(side("a"), "a").join(side("b"), "b"), "cli-both")
        acts = materialize(similarity.classify(both), "cli-actions")
        merged = both.drop("score").join(acts.where("action = 'merge'"), ["a", "b"]).withColumn("canonical_title", rewrite.canonical_title(F.col("title_a"), F.col("title_b"))).withColumn("pair_id", F.xxhash64("a", "b"))
        bodies = rewrite.canonical_bodies(merged)
        groups = materialize(merged.join(bodies, "pair_id").select(F.col("pair_id").alias("group_id"), F.array("a", "b").alias("notes"), "canonical_title", F.col("tags").alias("canonical_tags"), F.col("body").alias("canonical_body")), "cli-groups")
        gone = groups.select(F.explode("notes").alias("note_id")).distinct()
        links = similarity.reciprocal_links(both.join(acts.where("action = 'link'").select("a", "b"), ["a", "b"])).groupBy("note_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
        titles = apply.title_map(groups, n)
        kept = rewrite.relink(n.select("note_id", "path", "content").join(gone, "note_id", "left_anti"), titles, body="content").join(links, "note_id", "left")
        none = F.array().cast("array<string>")
        written = kept.where(F.col("changed") | F.col("targets").isNotNull()).select("path", rewrite.append_all(F.col("content"), F.coalesce("targets", none)).alias("content"))
        plan = apply.merge_plan(groups, n, self.a.run_date).unionByName(apply.rewrite_plan(written))
        out = {"actions": similarity.action_counts(acts).first().asDict(), **self.carry_out(plan)}
        if self.a.apply and self.a.registry:
            self._registry_after(registry, groups, n)
        return out

    def _registry_after(self, registry, groups: DataFrame, notes: DataFrame) -> None:
        from vaultlens.plans.runtime import materialize
        from vaultlens.sources import files

        old = materialize(files.load_registry(self.spark, self.a.registry), "cli-registry")
        m = groups.select(F.explode("notes").alias("note_id"), F.array_min("notes").alias("first"), "canonical_title").join(notes.select("note_id", "source_doc", "title"), "note_id")
        rows = registry.after_merge(old, m.select("source_doc", "title", F.when(F.col("note_id") == F.col("first"), F.col("canonical_title")).alias("canonical_title")))
        dates = old.groupBy("source_doc").agg(F.max("date").alias("date"))
        files.write_registry(self.a.registry, rows.join(dates, "source_doc", "left"))

    def fix_atomic(self) -> dict:
        from vaultlens.operators import apply, audit, rewrite, similarity

        n = self.notes()
        targets = similarity.first_targets(n, audit.is_fix_target(self.a.min_words), self.a.limit)
        found = similarity.related(n, targets, threshold=self.a.threshold or 0.34, k=self.a.max_links).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).getField("title").alias("titles"))
        j = n.join(found, F.col("note_id") == F.col("target")).select("path", rewrite.append_all(F.col("content"), F.col("titles")).alias("content"))
        return self.carry_out(apply.rewrite_plan(j))

    def enrich_thin(self) -> dict:
        from vaultlens.operators import apply, audit, rewrite, similarity

        n = self.notes()
        targets = similarity.first_targets(n, audit.is_thin(self.a.min_words), self.a.limit)
        near = similarity.nearby(n, targets).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).getField("title").alias("near"))
        block = rewrite.enrichment_paragraphs(F.col("title"), F.coalesce("near", F.array().cast("array<string>")))
        j = targets.join(near, F.col("note_id") == F.col("target"), "left")
        return self.carry_out(apply.rewrite_plan(j.select("path", rewrite.append_enrichment(F.col("content"), block).alias("content"))))

    def archive_empty(self) -> dict:
        from vaultlens.operators import apply, audit

        return self.carry_out(apply.empty_plan(self.notes().where(F.col("is_blank") & audit.is_empty()), self.a.run_date))

    def _planned(self) -> DataFrame:
        from vaultlens.plans.runtime import materialize
        from vaultlens.sources import files

        p = files.read_plans(self.spark, self.a.plan).withColumnRenamed("date", "note_date").withColumn("plan_note_id", F.col("ord").cast("bigint"))
        return materialize(p, "cli-plan")

    def generate(self) -> dict:
        from vaultlens.operators import apply, plan

        return self.carry_out(apply.staged_plan(plan.render(self._planned())))

    def write(self) -> dict:
        from vaultlens.operators import apply, plan, registry
        from vaultlens.plans.runtime import materialize
        from vaultlens.sources import files

        p = self._planned()
        known = materialize(files.load_registry(self.spark, self.a.registry or ""), "cli-registry")
        staged = p.select(F.col("plan_note_id").alias("id"), "title", "note_type", "source_doc")
        planned = materialize(registry.write_plan(staged, known, on_conflict=self.a.on_conflict), "cli-write")
        out = {"counts": registry.tallies(planned).first().asDict(), "violations": self.rows(plan.violations(p.withColumn("plan_id", F.lit(1).cast("bigint"))), "plan_note_id", "rule")}
        out["plan"] = self.carry_out(apply.import_plan(planned, plan.render(p)))
        if self.a.apply and self.a.registry:
            new = planned.where("registered").join(p.select(F.col("plan_note_id").alias("id"), "source_doc", F.coalesce("note_date", F.lit("")).alias("date")), "id").select("source_doc", "title", "date")
            files.write_registry(self.a.registry, registry.upsert(known, new))
        return out

    def relink(self) -> dict:
        from vaultlens.operators import apply, rewrite

        with open(self.a.map, encoding="utf-8") as f:
            rows = list(json.load(f).items())
        m = self.spark.createDataFrame(rows, "old string, new string")
        turned = rewrite.relink(self.notes().select("note_id", "path", "content"), m, body="content")
        return self.carry_out(apply.rewrite_plan(turned.where("changed").select("path", "content")))


def main(argv: list[str] | None = None) -> None:
    a = _arguments(argv)
    if a.command in ("generate", "write") and not a.plan or a.command == "relink" and not a.map:
        raise SystemExit(f"{a.command} needs --{'map' if a.command == 'relink' else 'plan'}")
    if a.command in ("generate", "write"):
        os.makedirs(a.vault, exist_ok=True)

    from vaultlens.plans.session import local_session

    out = getattr(Run(local_session(), a), a.command.replace("-", "_"))()
    text = json.dumps(out, ensure_ascii=False, indent=2, default=str)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


if __name__ == "__main__":
    main()
