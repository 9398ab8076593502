"""Bulk ingestion: the enabled derived tables of a ledger range, each written once from the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config as settings
from .operators import derive
from .operators.maintain import PROFILES
from .sources import rawfile


def ingest(ledgers: DataFrame, txs: DataFrame, config: settings.Config, skip_missing: bool = True) -> dict[str, int]:
    """Write the stores of ``config`` and return the ledgers found and skipped.

    A store is a folder of Parquet files, replaced as a whole, so an ingestion that is done again
    after a failure leaves the same result. Without ``skip_missing`` a missing ledger fails it
    before anything is written.
    """
    wrong = settings.problems(config)
    if wrong:
        raise ValueError("; ".join(wrong))
    asked = F.col("ledger_seq").between(config.start_ledger, config.end_ledger)
    ledgers, txs = ledgers.where(asked), txs.where(asked)
    found = ledgers.count()
    skipped = config.end_ledger - config.start_ledger + 1 - found
    if skipped and not skip_missing:
        raise ValueError(f"{skipped} ledgers of the range are missing")
    enabled = {k for k, s in config.stores.items() if s.enabled}
    for name, df in derive.derived(ledgers, txs, enabled).items():
        store = config.stores[name]
        key = "ledger_seq" if name == "ledger_seq_to_lcm" else "tx_hash"
        dealt = df.repartitionByRange(key).sortWithinPartitions(key)
        writer = dealt.write.mode("overwrite").options(**PROFILES[store.profile])
        if key == "tx_hash":
            writer = writer.option("parquet.bloom.filter.enabled#tx_hash", "true")
        writer.parquet(store.output_path)
        if store.raw_file:
            rawfile.write_files(txs, store.raw_file)
    return {"found": found, "skipped": skipped}
