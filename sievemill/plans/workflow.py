"""Cleaning as a declared list of steps: the tiers, and free workflows over the same registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import clean as K
from sievemill.operators import privacy as V
from sievemill.operators import profile as P
from sievemill.operators.dedup import fuzzy_dedup, resolve_entities
from sievemill.operators.forest import isolation_forest
from sievemill.operators.relational import map_columns
from sievemill.session import cut_counted
from sievemill.sources.tables import write_table


@dataclass(frozen=True)
class CleaningConfig:
    """What to clean.  ``key`` is a unique column that also gives the row order; steps that depend on
    order or identity need it."""

    tier: str = "basic"
    template: str | None = None
    key: str | None = None
    remove_duplicates: bool = True
    duplicate_columns: tuple[str, ...] | None = None
    validate_types: bool = True
    handle_missing: bool = True
    missing_strategy: str = "remove"
    standardize_formats: bool = True
    trim_whitespace: bool = True
    ai_anomaly_detection: bool = False
    statistical_outliers: bool = False
    outlier_sensitivity: float = 3.0
    fuzzy_matching: bool = False
    fuzzy_threshold: float = 0.90
    fuzzy_columns: tuple[str, ...] | None = None
    smart_column_mapping: bool = False
    data_enrichment: bool = False
    address_correction: bool = False
    industry_rules: Mapping[str, str] = field(default_factory=dict)
    predictive_quality: bool = False
    fill_gaps: bool = False
    entity_keys: tuple[str, ...] = ()
    constraints: Mapping[str, Column] = field(default_factory=dict)
    gdpr_compliant: bool = False
    hipaa_compliant: bool = False
    pci_compliant: bool = False


#: rows and nulls of a table
Facts = Mapping[str, int]
#: records a step affected: a number; an aggregate over the table it returns; or a function of the facts before and after it.
#: The last two cost no job of their own: they are observed while that table is written.
Affected = int | Column | Callable[[Facts, Facts], int]
Step = Callable[[DataFrame, CleaningConfig], tuple[DataFrame, Affected]]
STEPS: dict[str, Step] = {}


def register_step(name: str, fn: Step) -> None:
    """Add a step: ``fn(df, config)`` returns the new table and the records affected, see ``Affected``."""
    STEPS[name] = fn


def _step(name: str):
    def keep(fn: Step) -> Step:
        register_step(name, fn)
        return fn

    return keep


def _holes(cols: Sequence[str]) -> Column:
    """How many values are null, as an aggregate."""
    return reduce(Column.__add__, [F.count_if(F.col(f"`{c}`").isNull()) for c in cols], F.lit(0))


def _written(df: DataFrame, affected: Column | None = None) -> tuple[DataFrame, Facts]:
    """``df`` written down; its rows and nulls, and what the step affected, seen in the same job."""
    extra = {} if affected is None else {"affected": affected}
    return cut_counted(df, rows=F.count(F.lit(1)), nulls=_holes(df.columns), **extra)


def _of_facts(affected: Affected) -> bool:
    return not isinstance(affected, Column) and callable(affected)


def _settle(df: DataFrame, affected: Affected, before: Facts | None) -> tuple[DataFrame, int, Facts | None]:
    """(table, records affected, its facts if it was written)."""
    if isinstance(affected, Column):
        df, facts = _written(df, affected)
        return df, facts["affected"], facts
    if _of_facts(affected):
        df, facts = _written(df)
        return df, affected(before, facts), facts
    return df, affected, None


@_step("remove_duplicates")
def _duplicates(df: DataFrame, cfg: CleaningConfig) -> tuple[DataFrame, int]:
    """Rows equal in all columns, or in ``duplicate_columns`` where they are given."""
    cols = [c for c in df.columns if cfg.duplicate_columns is None or c in cfg.duplicate_columns]
    return K.drop_duplicates(df, cols, [cfg.key] if cfg.key else ()), lambda before, after: before["rows"] - after["rows"]


@_step("type_validation")
def _types(df, cfg):
    return K.convert_types(df), len(df.columns)


@_step("handle_missing")
def _missing(df, cfg):
    order = [cfg.key] if cfg.key else []
    out = K.fill_missing(df, cfg.missing_strategy, order=order, key=cfg.key)
    return out, lambda before, after: before["nulls"] - after["nulls"]


@_step("standardize_formats")
def _formats(df, cfg):
    return K.standardize(df), len(df.columns)


@_step("trim_whitespace")
def _trim(df, cfg):
    return K.trim_text(df), len(C.string_columns(df))


@_step("anomaly_detection")
def _anomalies(df, cfg):
    nums = [c for c in C.numeric_columns(df) if c != cfg.key]
    if not nums:
        return df, 0
    out = isolation_forest(df, nums, cfg.key).drop("_score")
    return out, F.count_if(F.col("_anomaly_score") == -1)


@_step("outlier_handling")
def _outliers(df, cfg):
    nums = [c for c in C.numeric_columns(df) if c != cfg.key and not c.startswith("_")]
    out, counts = K.cap_outliers(df, nums, cfg.outlier_sensitivity)
    return out, sum(counts.values())


@_step("fuzzy_deduplication")
def _fuzzy(df, cfg):
    out = fuzzy_dedup(df, cfg.key, cfg.fuzzy_columns, cfg.fuzzy_threshold)
    return out, lambda before, after: before["rows"] - after["rows"]


@_step("column_mapping")
def _mapping(df, cfg):
    return map_columns(df), len(df.columns)


@_step("data_enrichment")
def _enrich(df, cfg):
    nums = [c for c in C.numeric_columns(df) if c != cfg.key]
    out = K.enrich_quartiles(K.enrich_dates(df), nums)
    return out, len(out.columns) - len(df.columns)


@_step("address_correction")
def _addresses(df, cfg):
    cols = [c for c in C.string_columns(df) if "address" in c.lower()]
    if not cols:
        return df, 0
    return K.expand_abbreviations(df), F.count(F.lit(1)) * len(cols) - _holes(cols)


@_step("industry_rules")
def _industry(df, cfg):
    present = {c: r for c, r in cfg.industry_rules.items() if c in df.columns}
    failed = P.validate_formats(df, present).agg(F.sum("failed")).first()[0] if present else 0
    return df, failed or 0


@_step("quality_assessment")
def _quality(df, cfg):
    return P.row_quality(df), F.count(F.lit(1))


@_step("synthetic_generation")
def _gaps(df, cfg):
    nums = [c for c in C.numeric_columns(df) if c != cfg.key and not c.startswith("_")]
    holes = df.agg(_holes(nums).alias("n")).first()["n"] if nums else 0
    return (K.fill_missing(df, "interpolate", nums, order=[cfg.key]) if holes else df), holes


@_step("entity_resolution")
def _entities(df, cfg):
    if not cfg.entity_keys:
        return df, 0
    out = resolve_entities(df, cfg.key, list(cfg.entity_keys), name="_entity")
    return out, F.count_if(F.col("_entity") != F.col(cfg.key))


@_step("semantic_validation")
def _semantic(df, cfg):
    if not cfg.constraints:
        return df, 0
    return df, K.validate_constraints(df, cfg.constraints).agg(F.sum("violations")).first()[0] or 0


@_step("gdpr")
def _gdpr(df, cfg):
    cols = [c for c in V.pii_columns(df.columns) if c != cfg.key]
    return V.pseudonymize(df, cols), len(cols)


@_step("hipaa")
def _hipaa(df, cfg):
    cols = V.phi_columns(df.columns)
    return V.pseudonymize(df, cols), len(cols)


@_step("pci")
def _pci(df, cfg):
    return V.mask_cards(df), len(C.string_columns(df))


def steps_of(cfg: CleaningConfig) -> list[str]:
    """Names of the steps a configuration runs, in order: each tier adds to the one below it."""
    if cfg.tier not in ("basic", "advanced", "ai-powered"):
        raise ValueError(f"unknown tier {cfg.tier}")
    wanted = [
        ("remove_duplicates", cfg.remove_duplicates), ("type_validation", cfg.validate_types), ("handle_missing", cfg.handle_missing),
        ("standardize_formats", cfg.standardize_formats), ("trim_whitespace", cfg.trim_whitespace),
    ]
    if cfg.tier in ("advanced", "ai-powered"):
        wanted += [
            ("anomaly_detection", cfg.ai_anomaly_detection), ("outlier_handling", cfg.statistical_outliers),
            ("fuzzy_deduplication", cfg.fuzzy_matching), ("column_mapping", cfg.smart_column_mapping), ("data_enrichment", cfg.data_enrichment),
        ]
    if cfg.tier == "ai-powered":
        wanted += [
            ("address_correction", cfg.address_correction), ("industry_rules", bool(cfg.industry_rules)), ("quality_assessment", cfg.predictive_quality),
            ("synthetic_generation", cfg.fill_gaps), ("entity_resolution", bool(cfg.entity_keys)), ("semantic_validation", bool(cfg.constraints)),
        ]
    wanted += [("gdpr", cfg.gdpr_compliant), ("hipaa", cfg.hipaa_compliant), ("pci", cfg.pci_compliant)]
    return [name for name, on in wanted if on]


def clean(df: DataFrame, cfg: CleaningConfig, quality: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run a configuration: (clean table, report rows (position, operation, records_affected)).

    The input is written once to the shared folder, and again after steps that changed rows, so statistics of later steps
    never repeat earlier ones.  Rows, nulls and what a step affected are observed by the jobs that write.
    """
    spark = df.sparkSession
    order = cfg.key
    current, facts = _written(C.nan_to_null(df))
    log: list[tuple[int, str, float]] = []
    if quality:
        log.append((0, "quality_before", float(P.quality_score(current).first()["quality_score"])))
    for name in steps_of(cfg):
        if name == "handle_missing" and not facts["nulls"]:
            log.append((len(log), name, 0.0))
            continue
        current, affected, seen = _settle(*STEPS[name](current, cfg), facts)
        if seen is None and name in ("standardize_formats", "data_enrichment", "synthetic_generation"):
            current, seen = _written(current)
        facts = seen or facts  # steps that are not written keep rows and nulls
        if name == "column_mapping" and order is not None:
            # later steps follow the key under its new name
            renamed = map_columns(df.select(order)).columns[0]
            cfg = replace(cfg, key=renamed)
        log.append((len(log), name, float(affected)))
    if quality:
        log.append((len(log), "quality_after", float(P.quality_score(current).first()["quality_score"])))
    return current, spark.createDataFrame(log, "position int, operation string, records_affected double")


@dataclass
class Workflow:
    """User workflow: an ordered list of (step, arguments).

    dedupe, validate, transform, clean and export; or any name of the step registry.
    """

    steps: Sequence[tuple[str, Mapping]]

    def run(self, df: DataFrame, cfg: CleaningConfig | None = None) -> tuple[DataFrame, list[tuple[str, int | None]]]:
        cfg = cfg or CleaningConfig()
        log: list[tuple[str, int | None]] = []
        for name, args in self.steps:
            if name == "dedupe":
                df, affected = K.drop_duplicates(df, **args), None
            elif name == "validate":
                affected = K.validate_constraints(df, args["constraints"]).agg(F.sum("violations")).first()[0]
            elif name == "transform":
                df, affected = K.transform_columns(df, **args), None
            elif name == "clean":
                df, report = clean(df, CleaningConfig(**args), quality=False)
                affected = int(report.agg(F.sum("records_affected")).first()[0] or 0)
            elif name == "export":
                write_table(df, **args)
                affected = None
            else:
                out, affected = STEPS[name](df, cfg)
                before = df.agg(F.count(F.lit(1)).alias("rows"), _holes(df.columns).alias("nulls")).first().asDict() if _of_facts(affected) else None
                df, affected, _ = _settle(out, affected, before)
            log.append((name, affected))
        return df, log
