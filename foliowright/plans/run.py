"""A whole batch as one plan: states, cleaning, pages, names, log and audit of every input of every run.

Nothing is read twice and nothing runs on the driver: a run is rows with its number, its inputs are rows of
it, and each input's fate (skipped, failed, done) is a column, so one bad input touches no other.  ``write``
puts out texts, layout, audit lines, debug texts, log and summary as tables; a dry run has no outputs to write.

Defined results: inputs of no run metadata are cleaned by the universal plan; null texts are low in confidence
and skipped; a rule that fails on a text makes that input failed, with the error as its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliowright.functions import naming as N
from foliowright.operators import audit, layout
from foliowright.plans import batch
from foliowright.plans.clean import clean


class Run:
    """The relations of a batch.

    ``inputs`` has run_id, seq, path, file_exists, text and raises; ``selections`` run_id and selected; ``registry`` is of
    ``batch.registry``; ``terms`` are protected terms by profile.
    """

    def __init__(self, inputs: DataFrame, selections: DataFrame, registry: DataFrame, terms: dict[str, tuple[str, ...]], output_dir: str = "out", mirror_root: str | None = None, dry_run: bool = False):
        self.output_dir, self.dry_run = output_dir, dry_run
        runs = batch.dispatch(selections.groupBy("run_id").agg(F.max("selected").alias("selected")), "selected", registry)
        self.runs = runs.withColumn("n_terms", F.coalesce(*[F.when(F.col("profile") == p, F.lit(len(t))) for p, t in terms.items()], F.lit(0)) if terms else F.lit(0))
        own = self.runs.select("run_id", "selected", "profile", "pipeline", "mode", F.col("display_name").alias("shown"))
        states = batch.statuses(inputs.select("run_id", "seq", "path", "file_exists", "text", "raises")).join(own, "run_id", "left")
        # only what succeeded so far is cleaned: other rows carry no text into the rules
        ready = states.withColumn("raw", F.when(F.col("status") == "succeeded", F.col("text")))
        done = clean(ready, "raw", terms, profiled=True, profile_col="profile")
        ok = (F.col("status") == "succeeded") & F.col("rule_error").isNull()
        done = done.withColumn("reason", F.coalesce("raises", "rule_error")).withColumn("status", F.when(F.col("rule_error").isNotNull() & (F.col("status") == "succeeded"), "failed").otherwise(F.col("status")))
        done = done.withColumn("clean_text", F.when(ok, F.col("clean_text"))).withColumn("edits", F.when(ok, F.col("edits")).otherwise(audit.empty()))
        done = done.withColumn("n_edits", F.when(ok, audit.edit_count(F.col("edits")))).withColumn("lone_pages", F.when(ok, layout.heading_only(F.col("clean_text"))))
        folder = N.mirrored(F.col("path"), mirror_root, F.lit(output_dir)) if mirror_root else F.lit(output_dir)
        names = N.unique_paths(done.where(ok).select("run_id", "seq", "path", F.concat_ws("/", "run_id", folder).alias("folder"), N.basename(F.col("path")).alias("name")), "folder", "name", ["run_id", "seq", "path"])
        named = names.select("run_id", "seq", "path", F.regexp_replace("output_path", r"^[^/]*/", "").alias("output_path"))
        self.files = done.join(named, ["run_id", "seq", "path"], "left") if not dry_run else done.withColumn("output_path", F.lit(None).cast("string"))

    def results(self) -> DataFrame:
        """(run_id, seq, path, status, reason, pipeline, output_path, n_edits, clean_text) of every input; no edits where nothing was cleaned."""
        return self.files.select("run_id", "seq", "path", "status", "reason", F.coalesce("pipeline", F.lit("universal")).alias("pipeline"), "output_path", F.coalesce("n_edits", F.lit(0).cast("long")).alias("n_edits"), "clean_text")

    def summary(self) -> DataFrame:
        """(run_id, total, succeeded, failed, skipped, output_dir, novel, profile_applied), one row per run."""
        own = self.runs.select("run_id", F.col("display_name").alias("novel"), F.col("has_profile").alias("profile_applied"))
        return batch.summaries(self.files).join(own, "run_id", "left").select("run_id", "total", "succeeded", "failed", "skipped", F.lit(self.output_dir).alias("output_dir"), F.coalesce("novel", F.lit(N.UNIVERSAL)).alias("novel"), F.coalesce("profile_applied", F.lit(False)).alias("profile_applied"))

    def entries(self) -> DataFrame:
        """(run_id, seq, path, n, original, replacement, rule, category, context), page flags last; only of written outputs."""
        pages = F.concat_ws(", ", F.transform("lone_pages", lambda x: x.cast("string")))
        flag = audit.entry(F.concat(F.lit("heading-only page(s): "), pages), F.lit("[FLAGGED: heading-only page(s) preserved - review]"), F.lit("pdf.heading_only_page_flag"), "integrity_flag", N.basename(F.col("output_path")))
        all_ = F.concat("edits", audit.only((F.size("lone_pages") > 0) & F.col("output_path").isNotNull(), flag))
        return self.files.where("clean_text is not null").select("run_id", "seq", "path", F.posexplode(all_).alias("n", "e")).select("run_id", "seq", "path", "n", "e.*")

    def log(self) -> DataFrame:
        """(run_id, part, seq, n, level, message) in reading order: the run's head, each input, the run's end."""
        line = lambda n, level, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(n).alias("n"), F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"), text.alias("message")))
        kept = lambda *x: F.filter(F.array(*x), lambda y: y.isNotNull())
        text = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
        s = self.summary().join(self.runs.select("run_id", "selected", "profile", "n_terms"), "run_id", "left")
        own = F.nullif("selected", F.lit(""))
        label, number = F.coalesce(own, F.lit("(none — universal-only)")), lambda c: F.col(c).cast("string")
        asked = F.lower(F.trim(F.coalesce("selected", F.lit("")))) == "universal"
        layer = F.when(F.col("profile_applied"), text("Applied novel-specific editing layer for ", F.col("novel"), " (built-in profile).")).when(asked, "Universal editing selected — applying the standard universal-only editing (no novel-specific layer).").otherwise(text("No novel-specific profile for '", label, "' — universal-only editing."))
        head = kept(
            line(0, "accent", text("Starting batch: ", number("total"), " file(s).")), line(1, "muted", text("Output folder: ", F.col("output_dir"))), line(2, "accent", text("Selected novel: ", label)),
            line(3, "muted", F.lit("Loaded universal editor rules (UNIVERSAL.md).")), line(4, "muted", layer), line(5, "muted", text("Loaded ", F.coalesce(number("n_terms"), F.lit("0")), " protected term(s) for ", F.col("novel"), ".")),
        )
        end = kept(line(0, F.when(F.col("failed") == 0, "success").otherwise("warn"), text("Batch complete: ", number("succeeded"), " done, ", number("failed"), " failed, ", number("skipped"), " skipped of ", number("total"), ".")))
        rows = lambda d, part, seq, a: d.select("run_id", F.lit(part).alias("part"), seq.cast("long").alias("seq"), F.explode(a).alias("m")).select("run_id", "part", "seq", "m.n", "m.level", "m.message")
        # ranks within a run, whose inputs one folder held
        f = self.files.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "path"))).join(self.summary().select("run_id", "total"), "run_id")
        at = text("[", number("i"), "/", number("total"), "] ", N.basename(F.col("path")))
        edits = text(number("n_edits"), F.when(F.col("n_edits") == 1, " edit").otherwise(" edits"))
        done = F.when(F.lit(self.dry_run), text(" — done (dry run, ", edits, ")")).otherwise(text(" — done (", edits, ")"))
        state = F.when(F.startswith("status", F.lit("skipped")), text(at, " — ", F.col("status"))).when(F.col("status") == "failed", text(at, " — FAILED (", F.col("reason"), ")")).otherwise(text(at, done))
        level = F.when(F.startswith("status", F.lit("skipped")), "warn").when(F.col("status") == "failed", "error").otherwise("info" if self.dry_run else "success")
        fine = F.col("status") == "succeeded"
        warnings = kept(
            line(0, "warn", text("  ⚠ ", F.col("error_reason"), " — chapter text missing; file needs re-scrape"), fine & F.col("error_reason").isNotNull()),
            line(2, level, state),
            line(3, "warn", text("        ⚠ heading-only page(s) ", F.concat_ws(", ", F.transform("lone_pages", lambda x: x.cast("string"))), " in ", N.basename(F.col("output_path")), " — preserved (review: title-only chapter or upstream data loss)"), fine & (F.size("lone_pages") > 0) & F.col("output_path").isNotNull()),
        )
        odd = F.transform(F.when(fine, F.col("heading_violations")).otherwise(F.array().cast("array<string>")), lambda h: F.struct(F.lit(1).alias("n"), F.lit("warn").alias("level"), F.concat(F.lit("  ⚠ Non-normalized chapter line: "), h, F.lit("...")).alias("message")))
        # the failed and the skipped by name, below the end
        listed = f.where("status <> 'succeeded'").withColumn("bad", F.col("status") == "failed")
        name = text("  - ", N.basename(F.col("path")), " (", F.when(F.col("bad"), F.col("reason")).otherwise(F.regexp_extract("status", r"\((.*)\)$", 1)), ")")
        items = listed.select("run_id", F.when(F.col("bad"), 3).otherwise(5).alias("part"), F.col("i").cast("long").alias("seq"), F.lit(0).alias("n"), F.when(F.col("bad"), "error").otherwise("warn").alias("level"), name.alias("message"))
        heads = listed.groupBy("run_id", "bad").agg(F.lit(0).cast("long").alias("seq")).select("run_id", F.when(F.col("bad"), 3).otherwise(5).alias("part"), "seq", F.lit(-1).alias("n"), F.when(F.col("bad"), "error").otherwise("warn").alias("level"), F.when(F.col("bad"), "Failed:").otherwise("Skipped:").alias("message"))
        return rows(s, 0, F.lit(0), head).unionByName(rows(f, 1, F.col("i"), F.concat(warnings, odd))).unionByName(rows(s, 2, F.lit(0), end)).unionByName(heads).unionByName(items)

    def write(self, out: str, log: bool = True, debug: bool = True) -> None:
        """Tables below ``out``: texts and layout of outputs, audit lines, debug texts, log, summary.  A dry run writes its log and summary only."""
        put = lambda d, name: d.write.mode("overwrite").parquet(f"{out}/{name}")
        put(self.results().drop("clean_text"), "files")
        put(self.summary(), "summary")
        put(self.log(), "log")
        if self.dry_run:
            return
        written = self.files.where("output_path is not null")
        put(written.select("run_id", "seq", "output_path", "clean_text"), "texts")
        put(layout.layout(written, "output_path", "clean_text"), "layout")
        if log:
            meta = F.struct(F.lit("run_metadata").alias("record"), F.coalesce("selected", F.lit("")).alias("selected"), F.coalesce("pipeline", F.lit("universal")).alias("pipeline"), F.coalesce("mode", F.lit("universal-only")).alias("mode"))
            sidecar = F.concat(F.regexp_replace("output_path", r"(?<=.)\.[^./]*$", ""), F.lit("_replacements.jsonl"))
            head = written.select(sidecar.alias("file"), F.lit(0).cast("long").alias("line_no"), F.to_json(meta).alias("line"))
            body = self.entries().join(written.select("run_id", "seq", "path", "output_path"), ["run_id", "seq", "path"])
            lines = body.select(sidecar.alias("file"), (F.col("n") + 1).cast("long").alias("line_no"), F.to_json(F.struct("original", "replacement", "rule", "category", "context")).alias("line"))
            put(head.unionByName(lines), "audit")
        if debug:
            put(written.select(N.debug_path(F.col("output_path")).alias("file"), F.col("clean_text").alias("text")), "debug")
