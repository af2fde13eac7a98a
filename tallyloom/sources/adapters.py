"""Manifests of datasets whose files say, each in its own way, whose recording they are and how it is labelled."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """How one dataset names things.

    subject: a pattern of the path whose first group is the subject. folders: label
    by the folder that holds the file, the nearest first. labels: label by what the
    dataset's own column says. split: a pattern whose first group is the split's
    name in the path. A path that the patterns do not fit has nulls.
    """

    subject: str
    folders: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    split: str | None = None
    language: str | None = None


def _mapped(x: Column, names: Mapping[str, str]) -> Column:
    if not names:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x)


def manifest_of(files: DataFrame, adapter: Adapter, dataset_id: str, path: str = "path", label: str | None = None) -> DataFrame:
    """dataset_id, path, subject_id, label, split and language of every file, in the order of no other column.

    The dataset's own label column, where named and known to the adapter, goes before
    the folders. Columns only: no shuffle.
    """
    p = F.col(path)
    group = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    # The folders of a path, the nearest first.
    folders = F.reverse(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    by_folder = F.get(F.filter(F.transform(folders, lambda x: _mapped(x, adapter.folders)), lambda x: x.isNotNull()), F.lit(0)) if adapter.folders else F.lit(None).cast("string")
    own = _mapped(F.col(label), adapter.labels) if label else F.lit(None).cast("string")
    return files.select(
        F.lit(dataset_id).alias("dataset_id"), p.alias("path"), group(adapter.subject).alias("subject_id"), F.coalesce(own, by_folder).alias("label"),
        (group(adapter.split) if adapter.split else F.lit(None).cast("string")).alias("split"), F.lit(adapter.language).cast("string").alias("language"),
    )


def build_manifest(files: DataFrame, adapters: Mapping[str, Adapter], dataset: str = "dataset_id", path: str = "path", label: str | None = None) -> DataFrame:
    """The manifests of all datasets of ``adapters`` as one table; files of a dataset without an adapter raise when read."""
    out = None
    for name, adapter in adapters.items():
        part = manifest_of(files.where(F.col(dataset) == name), adapter, name, path, label)
        out = part if out is None else out.unionByName(part)
    known = F.col(dataset).isin(list(adapters))
    stray = files.where(~known | F.col(dataset).isNull()).select(F.raise_error(F.concat(F.lit("no adapter for "), F.coalesce(F.col(dataset), F.lit("null")))).cast("string").alias("dataset_id"))
    return out.unionByName(stray, allowMissingColumns=True)
