"""The job ledger: stage keys, progress, and what has yet to run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import latest, topological_order

IMAGE_FORMATS = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif")
#: Fixed stage orders by kind of file: stage to the stages that it needs.
PIPELINES: dict[str, dict[str, tuple[str, ...]]] = {
    "pdf": {
        "identify": (), "pdf_structure": ("identify",), "link_internal": ("pdf_structure",), "embed_text": ("pdf_structure",),
        "pdf_assets": ("pdf_structure",), "figure_ocr": ("pdf_assets",), "link_semantic": ("embed_text",), "synth_entities": ("embed_text",),
        "synth_integrate": ("synth_entities",), "synth_topics": ("synth_integrate",), "synth_source": ("synth_topics",),
    },
    "docx": {
        "identify": (), "docx_structure": ("identify",), "embed_text": ("docx_structure",), "link_semantic": ("embed_text",),
        "synth_entities": ("embed_text",), "synth_integrate": ("synth_entities",), "synth_topics": ("synth_integrate",), "synth_source": ("synth_topics",),
    },
    "image": {
        "identify": (), "image_extract": ("identify",), "exif_geo": ("image_extract",), "ocr": ("image_extract",), "embed_image": ("exif_geo",),
        "cluster_image": ("embed_image",), "vlm_describe": ("image_extract",), "embed_caption": ("vlm_describe",), "link_semantic": ("vlm_describe",),
    },
    "other": {"identify": ()},
}


def kind_of(file_format: str) -> str:
    return "image" if file_format in IMAGE_FORMATS else file_format if file_format in PIPELINES else "other"


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable
    model_version: str = "v1"
    params: dict = field(default_factory=dict)
    deps: tuple[str, ...] = ()

    def input_hash(self, content_hash: str) -> str:
        """The stage's key for one source; every knob that changes its result is part of it."""
        said = json.dumps({"content_hash": content_hash, "model_version": self.model_version, "params": self.params, "stage": self.name}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(said.encode()).hexdigest()

    def input_hash_of(self, content_hash: Column) -> Column:
        """The same for a column of content hashes (hexadecimal digits)."""
        mark = "\0"
        said = json.dumps({"content_hash": mark, "model_version": self.model_version, "params": self.params, "stage": self.name}, sort_keys=True, separators=(",", ":"))
        before, after = said.split(json.dumps(mark)[1:-1], 1)
        return F.sha2(F.concat(F.lit(before), content_hash, F.lit(after)), 256)


def ordered(stages: list[Stage]) -> list[Stage]:
    by_name = {s.name: s for s in stages}
    return [by_name[n] for n in topological_order({s.name: s.deps for s in stages})]


def pipeline_table(spark: SparkSession) -> DataFrame:
    """format_kind, stage, ord of all pipelines."""
    rows = [(kind, stage, i) for kind, deps in PIPELINES.items() for i, stage in enumerate(topological_order(deps))]
    return spark.createDataFrame(rows, "format_kind string, stage string, ord int")


def with_kind(files: DataFrame, fmt: str = "format") -> DataFrame:
    f = F.col(fmt)
    return files.withColumn("format_kind", F.when(f.isin(*IMAGE_FORMATS), "image").when(f.isin("pdf", "docx"), f).otherwise("other"))


def progress(files: DataFrame, jobs: DataFrame, pipeline: DataFrame, owner: str = "content_hash") -> DataFrame:
    """owner, stage, ord, status of every stage that a file needs: the last ledger row's, or pending."""
    due = with_kind(files).select(owner, "format_kind").join(F.broadcast(pipeline), "format_kind")
    last = jobs.groupBy(owner, "stage").agg(F.max_by("status", "id").alias("status"))
    return due.join(last, [owner, "stage"], "left").select(owner, "stage", "ord", F.coalesce("status", F.lit("pending")).alias("status"))


def file_states(steps: DataFrame, owner: str = "content_hash") -> DataFrame:
    """owner, state: error before running before all done before pending."""
    s = F.col("status")
    state = F.when(F.bool_or(s == "error"), "error").when(F.bool_or(s == "running"), "running").when(F.bool_and(s == "done"), "done").otherwise("pending")
    return steps.groupBy(owner).agg(state.alias("state"), F.count_if(s == "done").alias("done"), F.count("*").alias("stages"))


def resync_plan(files: DataFrame, jobs: DataFrame, pipeline: DataFrame, owner: str = "content_hash") -> DataFrame:
    """owner, stage, ord of what has no done row."""
    due = with_kind(files).select(owner, "format_kind").join(F.broadcast(pipeline), "format_kind")
    done = jobs.where("status = 'done'").select(owner, "stage").distinct()
    return due.join(done, [owner, "stage"], "left_anti").select(owner, "stage", "ord")


def newest_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, "input_hash", "id")


def run_stages(content_hash: str, stages: list[Stage], done: set[str], record: Callable[[str, str, str, str | None], None]) -> list[tuple[str, str, str | None]]:
    """Run one source's stages in order: those done for their key are skipped, the first error stops the rest.

    record(stage, input_hash, status, error) is told of running, done and error; a breadcrumb comes before the run.
    """
    out = []
    for stage in ordered(stages):
        key = stage.input_hash(content_hash)
        if key in done:
            out.append((stage.name, "skipped", None))
            continue
        record(stage.name, key, "running", None)
        try:
            stage.run(content_hash)
        except Exception as e:  # noqa: BLE001  any failure of a stage is recorded, and ends this source
            record(stage.name, key, "error", repr(e)[:4000])
            out.append((stage.name, "error", repr(e)))
            break
        record(stage.name, key, "done", None)
        done.add(key)
        out.append((stage.name, "done", None))
    return out
