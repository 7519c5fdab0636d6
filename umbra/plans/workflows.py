"""Combined workflows: anonymize-with-DP (F1) and the multi-artefact pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.noise import NoiseKey
from umbra.operators.cleaning import clean
from umbra.operators.ledger import check_budget, commit, ledger_frame, read_ledger, refuse_reuse
from umbra.operators.mondrian import k_anonymize, l_diversify
from umbra.operators.noisy import LedgerEntry, noisy_columns, protect_dataset
from umbra.operators.selection import randomize_sa
from umbra.schema import CENSUS_SCHEMA, CLEAN_REQUIRED_COLUMNS, require_columns, to_identifiers
from umbra.sources.artefacts import artefact_name, completion_event, manifest, read_artefact, write_artefact, write_event
from umbra.sources.census import read_census_csv


def anonymize_with_dp(df: DataFrame, numeric_qi: list[str], sa: str, epsilon: float, key, noise: NoiseKey,
                      sensitivities: dict[str, float] | None = None, apply_dp: bool = True, sa_mode: str = "krr") -> tuple[DataFrame, list[LedgerEntry]]:
    """noise on numeric QIs with 3/4 of the budget (equal split) and randomized SA with 1/4.

    The split is explicit so the total spent is ``epsilon`` (recorded in the ledger).
    """
    if not apply_dp:
        return df, []
    noisy, ledger = noisy_columns(df, numeric_qi, 0.75 * epsilon, key, noise, sensitivities)
    out = randomize_sa(noisy, sa, 0.25 * epsilon, key, noise, mode=sa_mode)
    return out, ledger + [LedgerEntry(f"randomized_response:{sa_mode}", sa, 0.25 * epsilon)]


@dataclass
class PipelineResult:
    version: str
    manifest: DataFrame
    event: DataFrame
    ledger: DataFrame


def row_key(df: DataFrame) -> DataFrame:
    """Stable row key of a parquet artefact: file name + row index (unique, recomputation-safe)."""
    return df.withColumn("row_key", F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index")))


def run_pipeline(spark: SparkSession, raw: str | DataFrame, out_root: str, version: str, noise: NoiseKey, source_name: str = "adult.data",
                 k: int = 10, l: int = 2, epsilon: float = 0.3, budget: float | None = None, replay: bool = False) -> PipelineResult:
    """clean once, then k-anonymous, l-diverse and DP artefacts from the clean table; manifest + event.

    The clean table is written once and read again by the three protected branches. The DP release draws
    its noise for ``<stem>/<version>`` and is entered in the ledger stored under ``out_root``: with a
    ``budget`` the ledger is checked first, and again in the act of entering the release. A release id is
    refused a second time unless this is the ``replay`` of a run that may have failed half-way, which writes the same files over again.
    """
    release = f"{artefact_name(source_name, 'stem')}/{version}"
    ledger_path = f"{out_root}/_ledger"
    earlier = read_ledger(spark, ledger_path)
    known = not earlier.where(F.col("release_id") == release).isEmpty()
    if known and not replay:
        refuse_reuse(earlier, release)
    if budget is not None:
        check_budget(earlier.where(F.col("release_id") != release), budget, requested=epsilon)
    raw_df = read_census_csv(spark, raw) if isinstance(raw, str) else raw
    paths = []
    clean_path = f"{out_root}/{artefact_name(source_name, 'clean')}"
    # the row keys of the noise are places in the clean table: a replay must not write it over again
    written = f"{clean_path}/version_id={version}" if known else write_artefact(clean(raw_df), clean_path, version)
    paths.append(("clean", written))
    base = read_artefact(spark, clean_path, version).drop("version_id")
    require_columns(base, CLEAN_REQUIRED_COLUMNS, "cleaned table")
    ids = to_identifiers(base)

    kres = k_anonymize(ids, CENSUS_SCHEMA, k=k)
    kpath = f"{out_root}/{artefact_name(source_name, 'anon_k', k=k)}"
    paths.append(("anon_k", write_artefact(kres.rows(ids), kpath, version)))
    kres.release()

    lres = l_diversify(ids, CENSUS_SCHEMA, l=l)
    lpath = f"{out_root}/{artefact_name(source_name, 'anon_l', l=l)}"
    paths.append(("anon_l", write_artefact(lres.rows(ids), lpath, version)))
    lres.release()

    keyed = row_key(read_artefact(spark, clean_path, version).drop("version_id"))
    dp, entries = protect_dataset(keyed, epsilon, "row_key", noise.release(release))
    ledger = ledger_frame(spark, entries, release)
    commit(ledger, ledger_path, budget, reuse=replay)       # spent from here on, even if the write below fails
    dpath = f"{out_root}/{artefact_name(source_name, 'dp', epsilon=epsilon)}"
    paths.append(("dp", write_artefact(dp.drop("row_key"), dpath, version)))

    man = manifest(spark, version, paths)
    event = completion_event(man)
    write_event(event, out_root, artefact_name(source_name, "stem"), version)
    return PipelineResult(version, man, event, ledger)
