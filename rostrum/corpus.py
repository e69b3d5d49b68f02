"""The user-facing entry point: a lazy speech table with its provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from rostrum.functions.predicates import FOCUS_TOPICS, FilterSpec
from rostrum.operators import batches, cleaning, sampling, select, splits
from rostrum.operators import statistics as stats, validation
from rostrum.operators.batches import DEFAULT_BATCH
from rostrum.operators.features import with_topic_features
from rostrum.operators.numbering import look_up
from rostrum.schema import (
    HIGH_WEIGHT,
    MIN_TEXT_LENGTH,
    nan_to_null,
    to_spark_names,
    topic_columns,
)
from rostrum.session import tune
from rostrum.sources import readers, writers


@dataclass(frozen=True)
class Corpus:
    """A speech table and the steps that led to it. Every step returns a new one.

    Row-wise steps (reading, filtering, cleaning, features) run when a result is asked
    for. Samples, splits, look-ups and exact quantiles first run small jobs of their own
    to find counts and borders. Steps work on the current table: filtering a sample
    filters the sample.
    """

    df: DataFrame
    source: str | None = None
    split: str | None = None
    seed: int = sampling.DEFAULT_SEED
    history: tuple[Mapping[str, Any], ...] = ()

    @staticmethod
    def load(
        spark: SparkSession,
        source: str,
        split: str | None = None,
        format: str | None = None,
        filters: Mapping[str, Callable[[Column], Column]] | None = None,
        columns: Sequence[str] | None = None,
        sample_size: int | None = None,
        seed: int = sampling.DEFAULT_SEED,
    ) -> Corpus:
        """Read, filter, project, sample and add topic features, in this order."""
        if split is None:
            df = readers.read_corpus(spark, source, format)
        else:
            df = readers.read_split(spark, source, split)
        return Corpus.of(df, source, split, filters, columns, sample_size, seed)

    @staticmethod
    def of(
        df: DataFrame,
        source: str | None = None,
        split: str | None = None,
        filters: Mapping[str, Callable[[Column], Column]] | None = None,
        columns: Sequence[str] | None = None,
        sample_size: int | None = None,
        seed: int = sampling.DEFAULT_SEED,
    ) -> Corpus:
        """As :meth:`load`, from a DataFrame; dotted names and NaN are taken in alike."""
        tune(df.sparkSession)
        df = nan_to_null(to_spark_names(df))
        if filters:
            df = select.where_columns(df, filters)
        key = df
        df = select.project(df, columns)
        if sample_size:
            if "doc_id" not in df.columns and "doc_id" in key.columns:
                sampled = sampling.sample_rows(key, sample_size, seed)
                df = select.project(sampled, columns)
            else:
                df = sampling.sample_rows(df, sample_size, seed, _sample_key(df))
        step = {"operation": "load_dataset", "source": source, "split": split}
        return Corpus(with_topic_features(df), source, split, seed, (step,))

    def _then(self, df: DataFrame, operation: str, **details: Any) -> Corpus:
        return replace(
            self, df=df, history=(*self.history, {"operation": operation, **details})
        )

    # ---- look-up -------------------------------------------------------------

    @property
    def topics(self) -> list[str]:
        return topic_columns(self.df)

    def count(self) -> int:
        return self.df.count()

    def require_non_empty(self) -> Corpus:
        readers.require_non_empty(self.df)
        return self

    def rows(self, positions: int | slice | Sequence[int], order_by: Sequence[str] = ("doc_id",)):
        """Rows by position in key order; only the keys are numbered and stored.

        For many look-ups number the table once and use ``rows_at``.
        """
        return look_up(self.df, positions, order_by)

    def sample(self, n: int = 5, seed: int | None = None) -> DataFrame:
        chosen = self.seed if seed is None else seed
        return sampling.sample_rows(self.df, n, chosen, _sample_key(self.df))

    # ---- subsets ---------------------------------------------------------------

    def where(self, filters: Mapping[str, Callable[[Column], Column]]) -> Corpus:
        return self._then(
            select.where_columns(self.df, filters), "filter", columns=list(filters)
        )

    def where_python(self, filters: Mapping[str, Callable[[Any], bool]]) -> Corpus:
        df = select.where_columns(self.df, filters, python=True)
        return self._then(df, "filter", columns=list(filters))

    def where_spec(self, spec: FilterSpec) -> Corpus:
        return self._then(select.where_spec(self.df, spec), "filter", spec=dict(spec))

    def where_topic(self, topic: str, min_weight: float = HIGH_WEIGHT) -> Corpus:
        df = select.where_topic(self.df, topic, min_weight)
        return self._then(df, "filter_by_topic", topic=topic, min_weight=min_weight)

    def topic_subsets(
        self, topics: Sequence[str] = FOCUS_TOPICS, min_weight: float = HIGH_WEIGHT
    ) -> dict[str, Corpus]:
        subsets = select.topic_subsets(self.df, topics, min_weight)
        return {
            name: self._then(df, "filter_by_topic", topic=name, min_weight=min_weight)
            for name, df in subsets.items()
        }

    def split_by(self, column: str) -> dict[Any, Corpus]:
        return {
            value: self._then(df, "split_by_column", column=column, value=value)
            for value, df in select.split_by(self.df, column).items()
        }

    def splits(self) -> DataFrame:
        return splits.prepare_splits(self.df, seed=self.seed)

    def write_splits(self, path: str) -> dict[str, int]:
        """Train, validation and test in the folders that ``load`` and ``read_splits`` expect."""
        return writers.write_splits(self.splits(), path)

    def batches(self, batch_size: int = DEFAULT_BATCH, shuffle: bool = True) -> DataFrame:
        return batches.with_batches(self.df, batch_size, shuffle, self.seed)

    def iterate_batches(
        self, batch_size: int = DEFAULT_BATCH, shuffle: bool = True, tensors: bool = False
    ) -> Iterator[dict[str, list]]:
        columnar = batches.columnar_batches(self.batches(batch_size, shuffle), tensors=tensors)
        return batches.iterate_batches(columnar)

    # ---- processing ------------------------------------------------------------

    def clean(self, counted: bool = False, **options: Any) -> Corpus:
        """Clean the table. With ``counted`` one job puts the row counts before and
        after into the history; ``clean_observed`` counts while the data flows."""
        details = dict(options)
        if counted:
            # Only standardised text is tested for its length, see ``clean``.
            tested = options.get("standardize", True)
            least = options.get("min_length", MIN_TEXT_LENGTH) if tested else 0
            sizes = ("original_size", "final_size", "removed")
            report = cleaning.cleaning_report(self.df, least).collect()
            details.update({r.metric: r.value for r in report if r.metric in sizes})
        return self._then(cleaning.clean(self.df, **options), "clean_data", **details)

    def cleaning_report(self) -> DataFrame:
        return cleaning.cleaning_report(self.df)

    def refresh_features(self) -> Corpus:
        return self._then(with_topic_features(self.df), "refresh_features")

    def info(self) -> DataFrame:
        return stats.table_info(self.df, self.source, self.split)

    def topic_summary(self) -> dict[str, DataFrame]:
        if not self.topics:
            return {}
        return {
            "topic_statistics": stats.topic_summary(self.df, quantiles=False),
            "dominant_topic_distribution": stats.dominant_distribution(self.df, 10),
            "topic_diversity": stats.topic_diversity(self.df),
            "active_topics": stats.active_topics(self.df),
        }

    def statistics(
        self, topic_analysis: bool = True, text_analysis: bool = True
    ) -> dict[str, DataFrame]:
        """Statistics by family. Exact quantiles find their ranks by jobs of their own.

        Persist the table before asking for many.
        """
        df, has = self.df, set(self.df.columns)
        families = {
            "corpus_metrics": stats.corpus_metrics(df),
            "basic_counts": stats.basic_counts(df),
            "distributions": stats.distributions(df),
            "missing_data": stats.missing_data(df),
        }
        if "doc_id" in has:
            families["duplicate_ids"] = stats.duplicate_ids(df)
        if topic_analysis and self.topics:
            families["topic_summary"] = stats.topic_summary(df)
            families["top_correlations"] = stats.topic_correlations(df)
            if "dominant_topic" in has:
                families["dominant_topics"] = stats.dominant_distribution(df)
                families["topic_diversity"] = stats.topic_diversity(df)
                families["active_topics"] = stats.active_topics(df)
                families["active_topic_distribution"] = stats.active_topic_distribution(df)
        if text_analysis and "text" in has:
            families["text_statistics"] = stats.text_statistics(df)
            families["length_categories"] = stats.length_categories(df)
        if "date" in has:
            families["date_range"] = stats.date_range(df)
            families["documents_per_year"] = stats.documents_per_year(df)
            families["years_covered"] = stats.years_covered(df)
            if "congno" in has:
                families["congress_years"] = stats.congress_years(df)
        return families

    def analyze(self, **options: Any) -> tuple[Corpus, dict[str, DataFrame]]:
        """:meth:`statistics`, noted in the history."""
        families = self.statistics(**options)
        step = self._then(
            self.df, "compute_statistics", statistics_categories=list(families)
        )
        return step, families

    def validate(self) -> DataFrame:
        return validation.validation_report(self.df)

    def validation_score(self) -> DataFrame:
        return validation.validation_score(self.validate())

    # ---- output ------------------------------------------------------------------

    def write_formats(self, path: str, **options: Any) -> tuple[Corpus, dict]:
        results = writers.write_all_formats(self.df, path, **options)
        step = self._then(
            self.df, "optimize_formats", output_dir=path, formats_created=list(results)
        )
        return step, results

    def write_filtered(
        self, path: str, custom: Mapping[str, FilterSpec] | None = None
    ) -> tuple[Corpus, dict, dict]:
        written, failed = writers.write_filtered(self.df, path, custom)
        step = self._then(
            self.df, "create_filtered_versions", output_dir=path, filters_created=list(written)
        )
        return step, written, failed

    def write_report(self, path: str, statistics: Mapping[str, DataFrame] | None = None) -> None:
        writers.write_report(
            self.df.sparkSession, path, self.history, statistics or {}, self.info()
        )

    def processing_summary(self) -> dict[str, Any]:
        performed = [step["operation"] for step in self.history]
        return {
            "operations_performed": performed,
            "final_dataset_size": self.count(),
            "statistics_available": "compute_statistics" in performed,
            "topic_columns_found": len(self.topics),
        }


def _sample_key(df: DataFrame) -> str:
    return "doc_id" if "doc_id" in df.columns else df.columns[0]
