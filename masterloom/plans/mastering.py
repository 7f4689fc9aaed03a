"""The whole build: two raw sources in, master and families out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions import fixed_values as fv
from ..functions.rules import OwnerRules, StatusRules
from ..operators.dedupe import TEXTS, folded_texts, with_key
from ..operators.families import build_families, family_input, with_family
from ..operators.merge import merge_sources, with_texts
from ..operators.normalize import normalize_bulk, normalize_curated
from ..session import written


@dataclass
class Mastered:
    """``curated`` and ``bulk``: normalised rows, written, without raw cells and texts;
    ``records``: one row per record, family set, written, without texts; ``texts``: the
    texts of each matching key; ``master``: the records with their texts;
    ``families``: one row per family."""

    curated: DataFrame
    bulk: DataFrame
    records: DataFrame
    texts: DataFrame
    families: DataFrame

    @property
    def master(self) -> DataFrame:
        return with_texts(self.records, self.texts)


def normalized_sources(curated_rows: DataFrame, bulk_rows: DataFrame,
                       status_rules: StatusRules = fv.STATUS_RULES, owner_rules: OwnerRules = fv.OWNER_RULES,
                       exact_unicode: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised curated and bulk rows without raw cells and texts, and the texts per key."""
    curated = normalize_curated(curated_rows, status_rules, exact_unicode).drop("raw")
    normal = normalize_bulk(bulk_rows, status_rules, owner_rules, exact_unicode)
    texts = folded_texts(with_key(normal.select("row_index", "normalized_number", *TEXTS), "b"))
    return curated, normal.drop("raw", *TEXTS), texts


def build_records(curated: DataFrame, bulk: DataFrame, texts: DataFrame, run_at: Column, house_owner: str = fv.HOUSE_OWNER,
                  similar_percent: int | None = None) -> Mastered:
    """Build from *written* normalised rows.

    Rows are folded, merged and grouped into families without their texts. Those are read
    when the master is: once, through one shuffle by key whose map side keeps a row per
    key, and joined to the records, which are shuffled by the same key.
    """
    merged = written(merge_sources(curated, bulk, run_at, house_owner), "merged")
    built = build_families(family_input(merged), similar_percent=similar_percent)
    records = written(with_family(merged, built.assignments), "records")
    return Mastered(curated, bulk, records, texts, built.families)


def build_master(curated_rows: DataFrame, bulk_rows: DataFrame, run_at: Column,
                 status_rules: StatusRules = fv.STATUS_RULES, owner_rules: OwnerRules = fv.OWNER_RULES,
                 house_owner: str = fv.HOUSE_OWNER, exact_unicode: bool = True,
                 similar_percent: int | None = None) -> Mastered:
    """Run the build on raw rows."""
    curated, bulk, texts = normalized_sources(curated_rows, bulk_rows, status_rules, owner_rules, exact_unicode)
    return build_records(written(curated, "curated"), written(bulk, "bulk"), texts, run_at, house_owner, similar_percent)
