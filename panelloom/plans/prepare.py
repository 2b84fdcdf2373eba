"""Master panel to a stored feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.constants import (CHARACTERISTICS, FIRST_TARGET_MONTH, ID_COLUMNS, LAST_TARGET_MONTH,
                                 VALUES_PER_TASK)
from panelloom.operators.features import (KEY, add_industry_dummies, add_interactions, attach_target,
                                          fill_macros_expanding, fill_macros_global, industry_codes,
                                          interaction_names, ranked_features, target_sample)
from panelloom.operators.timeseries import require_unique
from panelloom.sources.schema import require_columns, resolve_macro_columns
from panelloom.sources.storage import materialize


def target_panel(panel: DataFrame, columns: list[str], mode: str = "next_month",
                 first: int = FIRST_TARGET_MONTH, last: int = LAST_TARGET_MONTH,
                 macros: dict[str, str] | None = None, extra: list[str] = ()) -> DataFrame:
    """Rows with a target in the sample, cut down to ids, characteristics and macro columns.

    Comes before fill and ranks, which are taken over rows that have a target.
    """
    require_columns(panel.columns, columns, "characteristic columns")
    needed = ["permno", "month", "month_id", "ret_excess", "mktcap", "mktcap_lag",
              *columns, *(macros or {}).values(), *extra]
    narrow = panel.select(*dict.fromkeys(needed)).withColumn("month_id", F.col("month_id").cast("bigint"))
    return target_sample(attach_target(narrow, mode), first, last)


def prepare_panel(panel: DataFrame, columns: list[str] = CHARACTERISTICS, mode: str = "next_month",
                  macros: list[str] | None = None, macro_fill: str = "expanding", precision: str = "double",
                  first: int = FIRST_TARGET_MONTH, last: int = LAST_TARGET_MONTH, extra: list[str] = (),
                  values_per_task: int = VALUES_PER_TASK, macro_names: Mapping[str, str | list[str]] | None = None,
                  industry: str | None = None) -> tuple[DataFrame, list[str]]:
    """Target, sample filter, fill, ranks and optional macro interactions and industry dummies, stored by target year.

    Returns the stored table (ids, `extra`, features) and the names of its feature columns. Everything
    downstream (fits, forecasts, drift) reads only the years and columns it needs. `macro_names` says under which
    panel columns a macro series may be found; `industry` names a column of two-digit codes. An entity with two rows
    in one month is an error.
    """
    resolved = resolve_macro_columns(panel.columns, macros, macro_names) if macros else None
    extra = list(dict.fromkeys([*extra, *([industry] if industry else [])]))
    sample = materialize(target_panel(panel, columns, mode, first, last, resolved, extra), "target")
    require_unique(sample, KEY)
    # macro columns and codes may also be characteristics: they travel under names of their own
    carried = list(dict.fromkeys([*ID_COLUMNS, *extra]))
    aside = {c: f"_macro_{c}" for c in (resolved or {}).values()}
    overlap = {c: f"_carried_{c}" for c in carried if c in columns}
    narrow = sample.select(*[F.col(c).alias(overlap.get(c, c)) for c in carried],
                           *[F.col(c).alias(name) for c, name in aside.items()], *columns)
    ranked = ranked_features(narrow, columns, precision=precision, values_per_task=values_per_task)
    ranked = ranked.withColumnsRenamed({name: c for c, name in (aside | overlap).items()})
    features = [f"{c}_rank" for c in columns]
    if resolved:
        if macro_fill == "global":
            ranked = fill_macros_global(ranked, resolved, precision, values_per_task)
        elif macro_fill == "expanding":
            ranked = fill_macros_expanding(ranked, resolved, precision=precision)
        else:
            raise ValueError("macro_fill must be 'expanding' or 'global'")
        ranked = add_interactions(ranked, columns, macros, precision)
        features = interaction_names(columns, macros)
    if industry:
        codes = industry_codes(sample, industry)
        ranked = add_industry_dummies(ranked, codes, industry)
        features = features + [f"sic_{k}" for k in codes]
    return materialize(ranked, "features", ["target_year"]), features
