import pytest
from pyspark.sql import functions as F

from basalt import config, ingest
from basalt.sources import ledgers as S

TOML = """
[global]
start_ledger = 2
end_ledger = 801
batch_size = 100
[tx_hash_to_tx_data]
output_path = "/x"
[tx_hash_to_ledger_seq]
enabled = true
output_path = "/y"
"""


def test_file_and_command_line(tmp_path):
    (tmp_path / "c.toml").write_text(TOML)
    c = config.merged(config.load(tmp_path / "c.toml"), {"tx_hash_to_tx_data"}, end_ledger=500, batch_size=None)
    assert (c.end_ledger, c.batch_size) == (500, 100) and not config.problems(c)
    assert [k for k, s in c.stores.items() if s.enabled] == ["tx_hash_to_tx_data", "tx_hash_to_ledger_seq"]
    assert "ledgers 2 to 500 in batches of 100" in config.summary(c)
    for bad in ("[other]\nx = 1", "[global]\nspeed = 1"):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(tmp_path / "c.toml")


@pytest.mark.parametrize(("change", "word"), [({"batch_size": 0}, "batch_size"), ({"start_ledger": 1}, "start_ledger"), ({"end_ledger": 1}, "end_ledger"), ({"stores": {k: config.Store() for k in config.STORES}}, "at least one"), ({"stores": {**{k: config.Store() for k in config.STORES}, "ledger_seq_to_lcm": config.Store(True)}}, "output_path")])
def test_problems(change, word):
    good = {"start_ledger": 2, "end_ledger": 9, "stores": {**{k: config.Store() for k in config.STORES}, "ledger_seq_to_lcm": config.Store(True, "/z")}}
    assert not config.problems(config.Config(**good))
    assert word in " ".join(config.problems(config.Config(**(good | change))))


def test_ingestion(spark, sf_dir, tmp_path):
    stores = {k: config.Store(True, f"{tmp_path}/{k}", "streaming") for k in config.STORES}
    stores["tx_hash_to_ledger_seq"] = config.Store(True, f"{tmp_path}/seq", raw_file=f"{tmp_path}/raw")
    c = config.Config(start_ledger=2, end_ledger=301, stores=stores)
    ledgers, txs = S.ledgers(spark, sf_dir).where("ledger_seq <> 77"), S.transactions(spark, sf_dir)
    for _ in range(2):
        assert ingest.ingest(ledgers, txs, c) == {"found": 299, "skipped": 1}
    own = txs.where(F.col("ledger_seq").between(2, 301) & (F.col("ledger_seq") != 77))
    assert spark.read.parquet(f"{tmp_path}/tx_hash_to_tx_data").count() == own.count()
    assert spark.read.parquet(f"{tmp_path}/seq").select("tx_hash", "ledger_seq").exceptAll(txs.select("tx_hash", "ledger_seq")).isEmpty()
    with pytest.raises(ValueError, match="missing"):
        ingest.ingest(ledgers, txs, c, skip_missing=False)
