"""A training run from commit facts and a configuration to stored features, models, reports and the ledger.

Everything a run writes lies under <folder>/<project>/<stamp>: `features` (Parquet, all generators and labels), `models`,
`scalers` and `errors` (a folder for each job), `reports` (CSV, a folder for each named report). The ledger is
<folder>/results, a row for each project, stamp, model, split and configuration. A run that is started again with the
same stamp replaces what it wrote, so a driver or executors may be lost at any point. Rows never pass through the
driver: every table is written by the executors and read back by the next step.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ml import models as M
from .ml.boosting import Blocks, Boosted
from .operators import errors as E
from .operators import labels as L
from .operators import registry
from .operators import splits as P
from .operators.features import at_least
from .session import checkpointed
from .sources import history as H
from .sources import sinks

#: Splits by name: of a project's rows and of the cut between files, of which each takes what it needs.
SPLITS = {"by_file": lambda rows, cut: P.split_by_file(rows, cut=cut()), "by_history": lambda rows, cut: rows.where(F.col(BY_HISTORY).isNotNull()).withColumn("split", F.col(BY_HISTORY))}
#: Named reports of the error slices.
SLICE_REPORTS = {"true_bin": "error_stats_by_actual_bin", "extension": "error_stats_by_extension", "top_dir": "error_stats_by_directory", "completion_reason": "error_stats_by_reason", "committer_grouped": "error_stats_by_committer"}
MEDIAN = "median"
#: The stored column with the split by history, whose windows are those of the features.
BY_HISTORY = "_by_history"
#: Configurations of a job that run side by side.
PARALLEL = 4
#: The configuration with all columns.
ALL = "ALL"


@dataclass(frozen=True)
class Job:
    """One model on one split. trials > 0 tunes it first."""

    model: str
    split: str = "by_file"
    params: dict = field(default_factory=dict)
    trials: int = 0

    def __post_init__(self):
        if self.model not in (MEDIAN, *M.MODELS, *M.BOOSTED):
            raise ValueError(f"no model is called {self.model}: there are {', '.join(sorted((MEDIAN, *M.MODELS, *M.BOOSTED)))}")
        if self.split not in SPLITS:
            raise ValueError(f"no split is called {self.split}: there are {', '.join(SPLITS)}")
        if self.model == MEDIAN and (self.trials or self.params):
            raise ValueError("the median has nothing to tune or set")


@dataclass(frozen=True)
class Project:
    """groups: feature groups for ablation, each of column names or, with a last underscore, prefixes of them."""

    name: str
    jobs: tuple[Job, ...]
    directory: str | None = None
    generators: tuple[str, ...] | None = None
    ablation: bool = False
    groups: dict[str, list[str]] | None = None
    labelling: L.LabelConfig = L.LabelConfig()


def projects_of(config: dict) -> list[Project]:
    """Projects of a configuration as YAML or JSON give it: `labelling` for all, and of each project its name, directory,
    models (model, split, params, trials), generators, ablation and groups. What isn't known raises."""
    labelling = L.LabelConfig(**config.get("labelling", {}))
    found = []
    for p in config.get("projects", []):
        rest = {k: v for k, v in p.items() if k not in ("models", "generators")}
        names = p.get("generators")
        found.append(Project(jobs=tuple(Job(**m) for m in p.get("models", [])), generators=tuple(names) if names is not None else None, labelling=labelling, **rest))
    return found


def featured(facts: DataFrame, generators: list[str] | None = None, label=None) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """Facts of files with enough commits with the columns of the wanted generators and of label, its 0/1 columns, and the
    model's columns by generator."""
    df, found = registry.apply_each(checkpointed(at_least(facts)), generators, label)
    groups = {name: [c for c in M.feature_columns(df.select(*[f"`{c}`" for c in new]), flags) if c not in facts.columns] for name, (new, flags) in found.items()}
    return df, [c for _, flags in found.values() for c in flags], groups


@dataclass
class Prepared:
    """The stored frame of a project, and what its columns are. Rows carry their split by history."""

    project: Project
    rows: DataFrame
    flags: list[str]
    groups: dict[str, list[str]]
    at: str

    @property
    def columns(self) -> list[str]:
        return [c for cs in self.groups.values() for c in cs]

    @property
    def plain(self) -> list[str]:
        """Columns that are scaled."""
        return [c for c in self.columns if c not in self.flags]


def prepare(spark: SparkSession, facts: DataFrame, project: Project, folder: str, stamp: str, as_of: str) -> Prepared:
    """Writes the project's features and its completion reports."""
    at = f"{folder}/{quote(project.name, safe='')}/{stamp}"
    facts = H.in_directory(facts, project.directory) if project.directory else facts
    df, flags, groups = featured(facts, list(project.generators) if project.generators is not None else None, L.targeted(as_of, project.labelling))
    df = P.placed_by_history(df).withColumnRenamed("split", BY_HISTORY)  # here the rows lie by path already
    sinks.write_features(df, f"{at}/features", project.name)
    rows = sinks.read_features(spark, f"{at}/features", project.name)
    sinks.write_csv(L.completion_summary(rows), f"{at}/reports/completion_summary")
    return Prepared(project, rows, flags, groups, at)


def split_and_scaled(spark: SparkSession, p: Prepared, split: str) -> DataFrame:
    """Writes the scaler fitted on the training rows and the counts of the split; the split rows, scaled, with the values
    that they had before in the structure `raw`, for the reports. Rows are split and scaled as they are read: both are a
    few operations a row, and nothing moves."""
    plain = p.plain
    rows = SPLITS[split](p.rows, lambda: checkpointed(P.file_cut(p.rows))).drop(BY_HISTORY)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in plain})
    sinks.write_csv(P.dataset_stats(rows), f"{p.at}/reports/dataset_statistics_{split}")
    if plain:
        at = f"{p.at}/scalers/{split}"
        P.fit_scaler(rows.where(F.col("split") == "train"), plain, exact=False).write.mode("overwrite").parquet(at)
        rows = P.scaled(rows.withColumn("raw", F.struct(*plain)), spark.read.parquet(at).first(), plain)
    return rows


def configurations(p: Prepared) -> dict[str, list[str]]:
    """The model's columns by configuration: all, and for an ablation all but those of each group."""
    if not p.project.ablation:
        return {ALL: p.columns}
    groups = {g: M.chosen(p.columns, names) for g, names in p.project.groups.items()} if p.project.groups else p.groups
    return {ALL: p.columns} | {f"all_except_{g}": [c for c in p.columns if c not in set(cs)] for g, cs in groups.items()}


def scored(rows: DataFrame, job: Job, columns: list[str], model_at: str, blocks: Blocks | None = None) -> tuple[DataFrame, PipelineModel | Boosted | None]:
    """Fits and stores the job's model; the test rows with their predictions. blocks: the training rows binned, if they are."""
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    if job.model == MEDIAN:
        return E.median_baseline(rows), None
    if job.trials:
        model, _ = M.tuned(train, columns, job.model, trials=job.trials, grouped=job.split == "by_file")
    else:
        model = M.fit(train, columns, job.model, blocks, **job.params)
    sinks.save_model(rows.sparkSession, model, model_at)
    return M.predict(model, test, columns).drop("features", "label"), model


def run_job(spark: SparkSession, p: Prepared, rows: DataFrame, job: Job, configuration: str, columns: list[str], folder: str, stamp: str, blocks: Blocks | None = None) -> None:
    """One model: its file, its errors, every report on them, and its row of the ledger."""
    name = f"{job.model}-{job.split}-{quote(configuration, safe='')}"
    found, model = scored(rows, job, columns, f"{p.at}/models/{name}", blocks)
    if p.plain:
        found = found.drop(*p.plain).select("*", "raw.*").drop("raw")
    found = E.error_frame(found)
    found.write.mode("overwrite").options(**sinks.plain_doubles(found)).parquet(f"{p.at}/errors/{name}")
    errors, reports = spark.read.parquet(f"{p.at}/errors/{name}"), f"{p.at}/reports/{name}"
    slices = checkpointed(E.all_slices(errors, tuple(SLICE_REPORTS)))  # one pass over the errors; a row a value
    for column, report in SLICE_REPORTS.items():
        if column in errors.columns:
            sinks.write_csv(E.one_slice(slices, column), f"{reports}/{report}")
    if "age_bin" in errors.columns:
        sinks.write_csv(E.by_age(errors), f"{reports}/mae_by_age")
    keys = ["ord", "path", "actual", "pred", "residual", "abs_error"]
    for which, worst in (("worst_predictions", True), ("best_predictions", False)):
        sinks.write_csv(E.extremes(errors, worst=worst).select(*keys), f"{reports}/{which}")
    if model is not None:
        sinks.write_csv(spark.createDataFrame(M.importances(model, columns), "feature string, importance double"), f"{reports}/feature_importance")
    sinks.record_result(E.metrics(errors), f"{folder}/results", p.project.name, job.model, job.split, configuration, stamp)


def run(spark: SparkSession, facts: DataFrame, project: Project, folder: str, stamp: str, as_of: str) -> DataFrame:
    """All jobs of a project, in all its configurations; the run's rows of the ledger."""
    p = prepare(spark, facts, project, folder, stamp, as_of)
    by_split: dict[str, DataFrame] = {}
    for job in project.jobs:
        if job.split not in by_split:
            by_split[job.split] = split_and_scaled(spark, p, job.split)
        rows = by_split[job.split]
        wanted = {c: columns for c, columns in configurations(p).items() if job.model != MEDIAN or c == ALL}  # the median asks no columns
        blocks = None
        if job.model in M.BOOSTED and not job.trials:  # all configurations take their columns from the same binned rows
            blocks = M.blocks(rows.where(F.col("split") == "train"), p.columns, job.model, **job.params)
        with ThreadPoolExecutor(PARALLEL) as pool:
            list(pool.map(lambda c: run_job(spark, p, rows, job, c, wanted[c], folder, stamp, blocks), wanted))  # noqa: B023
    ledger = sinks.read_results(spark, f"{folder}/results")
    return ledger.where((F.col("project") == project.name) & (F.col("timestamp") == stamp))


def serve(spark: SparkSession, p: Prepared, job: Job, latest_only: bool = True) -> DataFrame:
    """Predicted completion of the files without a label, by the stored model and scaler of a run."""
    model = sinks.load_model(spark, f"{p.at}/models/{job.model}-{job.split}-{ALL}", job.model in M.BOOSTED)
    rows = p.rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in p.plain})
    if p.plain:
        rows = P.scale(rows, spark.read.parquet(f"{p.at}/scalers/{job.split}"), p.plain)
    return M.predict_unlabelled(model, rows, p.columns, latest_only)
