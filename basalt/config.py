"""Ingestion settings: a TOML file over defaults for each store, with command-line values on top."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

STORES = ("ledger_seq_to_lcm", "tx_hash_to_tx_data", "tx_hash_to_ledger_seq")


@dataclass(frozen=True)
class Store:
    enabled: bool = False
    output_path: str = ""
    profile: str = "backfill"
    raw_file: str = ""  # of tx_hash_to_ledger_seq only


@dataclass(frozen=True)
class Config:
    start_ledger: int = 0
    end_ledger: int = 0
    batch_size: int = 2000
    workers: int = 0
    input_store: str = ""  # instead of the remote source
    stores: dict[str, Store] = field(default_factory=lambda: {k: Store() for k in STORES})


def load(path: str | Path) -> Config:
    """Settings of a TOML file; what it leaves out has its default. Unknown names are errors."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    unknown = raw.keys() - {"global", *STORES}
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    try:
        stores = {k: Store(**raw.get(k, {})) for k in STORES}
        return Config(**raw.get("global", {}), stores=stores)
    except TypeError as e:
        raise ValueError(str(e)) from e


def merged(config: Config, enable: set[str] = frozenset(), **given) -> Config:
    """Values given on the command line count before those of the file; stores enabled by either are enabled."""
    stores = {k: replace(s, enabled=s.enabled or k in enable) for k, s in config.stores.items()}
    return replace(config, stores=stores, **{k: v for k, v in given.items() if v is not None})


def problems(config: Config) -> list[str]:
    """What keeps these settings from being used; empty if nothing does."""
    out = []
    if config.batch_size <= 0:
        out.append("batch_size must be positive")
    if config.start_ledger < 2:
        out.append("start_ledger must be at least 2")
    if config.end_ledger < config.start_ledger:
        out.append("end_ledger must not be before start_ledger")
    if config.workers < 0:
        out.append("workers must not be negative")
    if not any(s.enabled for s in config.stores.values()):
        out.append("enable at least one store")
    for k, s in config.stores.items():
        if s.enabled and not s.output_path:
            out.append(f"{k}: output_path is missing")
        if s.profile not in ("backfill", "streaming"):
            out.append(f"{k}: unknown profile {s.profile}")
        if s.raw_file and (k != "tx_hash_to_ledger_seq" or not s.enabled):
            out.append(f"{k}: raw_file needs tx_hash_to_ledger_seq to be enabled")
    if config.input_store and config.stores["ledger_seq_to_lcm"].enabled and config.input_store == config.stores["ledger_seq_to_lcm"].output_path:
        out.append("input_store and the ledger store must differ")
    return out


def summary(config: Config) -> str:
    lines = [f"ledgers {config.start_ledger:,} to {config.end_ledger:,} in batches of {config.batch_size:,}", f"source: {config.input_store or 'remote'}"]
    lines += [f"{k}: {s.output_path} ({s.profile}{', raw file ' + s.raw_file if s.raw_file else ''})" for k, s in config.stores.items() if s.enabled]
    return "\n".join(lines)
