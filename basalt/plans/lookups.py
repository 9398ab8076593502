"""Lookups by hash, store routing, outcome classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunks import chunk_of
from ..functions.codecs import is_hash
from ..operators import derive as D
from ..operators import lookup as J
from ..session import new_path
from ..sources import ledgers as S
from ..sources import lists
from .base import QUERIES, SQL, query

L, T = S.SQL_LEDGERS, S.SQL_TXS
K = """keys as (select tx_hash as query from txs where starts_with(tx_hash, '0a') union all select upper(tx_hash) from txs where starts_with(tx_hash, '0b0') union all select '0x' || tx_hash from txs where starts_with(tx_hash, '0b1')
union all select sha256('absent|' || range) from range(2000) union all select unnest(['zz', '', '0x', 'abc', repeat('g', 64), repeat('a', 63)]))"""
#: Every transaction is asked for; the last digit of its hash, and so a hash of its row, says in which form.
K_ALL = """keys as (select case tx_hash[64] when '0' then upper(tx_hash) when '1' then '0x' || tx_hash when '2' then tx_hash[1:63] || 'g' else tx_hash end as query from txs
union all select sha256('absent|' || range) from range(2000) union all select unnest(['zz', '', '0x', 'abc', repeat('g', 64), repeat('a', 63)]))"""
NORMAL = "case when regexp_full_match(regexp_replace(trim(query), '^0x', ''), '[0-9a-fA-F]{64}') then lower(regexp_replace(trim(query), '^0x', '')) end"


def keys(spark, sf_dir):
    """Present hashes as stored, in upper case and with a prefix; absent ones; and texts that are no hash."""
    txs = S.transactions(spark, sf_dir).select("tx_hash")
    parts = [txs.where("startswith(tx_hash, '0a')"), txs.where("startswith(tx_hash, '0b0')").select(F.upper("tx_hash")), txs.where("startswith(tx_hash, '0b1')").select(F.concat(F.lit("0x"), "tx_hash"))]
    out = parts[0].withColumnRenamed("tx_hash", "query")
    for p in (*parts[1:], *others(spark)):
        out = out.union(p)
    return out


def others(spark):
    """Absent hashes, and texts that are no hash."""
    absent = spark.range(2000).select(F.sha2(F.concat(F.lit("absent|"), F.col("id").cast("string")), 256).alias("query"))
    bad = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("zz", "", "0x", "abc", "g" * 64, "a" * 63)])).alias("query"))
    return absent, bad


def every_key(spark, sf_dir):
    """The hash of every transaction, as stored, in upper case, with a prefix or spoilt by its last digit; and the others of ``keys``."""
    h = F.col("tx_hash")
    digit = F.substring(h, 64, 1)
    form = F.when(digit == "0", F.upper(h)).when(digit == "1", F.concat(F.lit("0x"), h)).when(digit == "2", F.concat(F.substring(h, 1, 63), F.lit("g"))).otherwise(h)
    out = S.transactions(spark, sf_dir).select(form.alias("query"))
    for p in others(spark):
        out = out.union(p)
    return out


def some_ledgers(spark, sf_dir):
    return S.ledgers(spark, sf_dir).where("ledger_seq % 97 <> 0")


def stores(spark, sf_dir):
    """A store for each 5,000 ledgers, and one that overlaps the first."""
    own = some_ledgers(spark, sf_dir).groupBy(chunk_of(F.col("ledger_seq"), 5000).alias("store_id")).agg(F.min("ledger_seq").alias("first"), F.max("ledger_seq").alias("last"))
    return own.union(spark.range(1).select(F.lit(99).cast("long"), F.lit(100).cast("long"), F.lit(300).cast("long")))


def walked(spark, sf_dir, asked_for=keys):
    txs, asked = S.transactions(spark, sf_dir), asked_for(spark, sf_dir)
    hashes = asked.where(is_hash(F.col("query"))).select(F.lower("query").alias("tx_hash")).distinct()
    members, slots = J.approximate_index(txs, chunk_of(F.col("ledger_seq"), 5000))
    found = J.probe(hashes, members, slots)
    return asked, J.visited(hashes, found, stores(spark, sf_dir), some_ledgers(spark, sf_dir), txs)


def classes(spark, sf_dir, asked_for=keys, paths=False):
    """The queries, and the class of each: a walk for each key of a short list, or by slot if every transaction is asked for."""
    if asked_for is not every_key:
        asked, walk = walked(spark, sf_dir, asked_for)
        return asked, J.classified(asked, walk)
    asked, txs = every_key(spark, sf_dir), S.transactions(spark, sf_dir)
    return asked, J.classified_by_slot(asked, txs, chunk_of(F.col("ledger_seq"), 5000), stores(spark, sf_dir), some_ledgers(spark, sf_dir), paths=paths)


SOME = "known as (select * from ledgers where ledger_seq % 97 <> 0), stores as (select (ledger_seq - 2) // 5000 as store_id, min(ledger_seq) as first, max(ledger_seq) as last from known group by 1 union all select 99, 100, 300)"
INDEX = "members as (select (ledger_seq - 2) // 5000 as index_idx, tx_hash, max(ledger_seq) as ledger_seq from txs group by 1, 2), slots as (select (ledger_seq - 2) // 5000 as index_idx, tx_hash[1:4] as slot, min(ledger_seq) as ledger_seq from txs group by 1, 2)"
WALK = f"""with {L}, {T}, {K}, {SOME}, {INDEX},
hashes as (select distinct lower(query) as tx_hash from keys where regexp_full_match(query, '[0-9a-fA-F]{{64}}')),
cand as (select h.tx_hash, s.index_idx, coalesce(m.ledger_seq, s.ledger_seq) as ledger_seq from hashes h join slots s on s.slot = h.tx_hash[1:4] left join members m on m.tx_hash = h.tx_hash and m.index_idx = s.index_idx),
routed as (select c.*, (select count(*) from stores s where c.ledger_seq between s.first and s.last) as n_stores from cand c),
full_ as (select r.*, k.closed_at, case when n_stores > 1 then 'LEDGER_IN_MULTIPLE_DBS' when n_stores = 0 or k.ledger_seq is null then 'LEDGER_NOT_FOUND' end as error,
exists (select 1 from txs t where t.tx_hash = r.tx_hash and t.ledger_seq = r.ledger_seq) as has from routed r left join known k using (ledger_seq)),
marked as (select *, error is null and has as found from full_),
walk as (select * from (select *, min(case when found or error is not null then index_idx end) over (partition by tx_hash) as stop from marked) where stop is null or index_idx <= stop),
per as (select tx_hash, count(*) as n_visited, max(error) as error, max(case when found then ledger_seq end) as success_seq from walk group by 1),
classes as (select query, h.tx_hash, coalesce(n_visited, 0) as n_visited, success_seq,
case when error is not null then error when success_seq is not null and n_visited = 1 then 'SUCCESS' when success_seq is not null then 'FALSE_POSITIVE_PARTIAL' when n_visited is null then 'RECSPLIT_NOT_FOUND' when n_visited = 1 then 'FALSE_POSITIVE_NORMAL' else 'FALSE_POSITIVE_COMPOUND' end as outcome
from (select query, lower(query) as tx_hash from keys where regexp_full_match(query, '[0-9a-fA-F]{{64}}')) h left join per using (tx_hash))"""


@query(f"with {L}, {T}, {K} select trim(query) as raw, case when regexp_full_match(trim(query), '[0-9a-fA-F]{{64}}') then lower(trim(query)) end as tx_hash from keys where trim(query) <> ''")
def hash_list_validate(spark, sf_dir, asked_for=keys):
    return lists.hash_list(asked_for(spark, sf_dir).select(F.col("query").alias("value")))


@query("select range + 1 as line_no, (range * 7) % 20000 + 2 as ledger_seq from range(500) where range % 10 <> 3 and range % 10 <> 4")
def ledger_list_parse(spark, sf_dir):
    """500 lines, of which some are comments and some are empty."""
    n = F.col("id")
    text = F.when(n % 10 == 3, F.lit("# comment")).when(n % 10 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), ((n * 7) % 20000 + 2).cast("string")))
    return lists.ledger_list(spark.range(500).select((n + 1).alias("line_no"), text.alias("value")))


@query(f"with {L}, {T}, {K}, asked as (select query, {NORMAL} as tx_hash from keys), data as (select tx_hash, ledger_seq, closed_at, tx_index from txs join ledgers using (ledger_seq)) select query, a.tx_hash, ledger_seq, closed_at, tx_index, case when a.tx_hash is null then 'INVALID_INPUT' when ledger_seq is null then 'NOT_FOUND' else 'FOUND' end as outcome from asked a left join data d on d.tx_hash = a.tx_hash")
def one_step_lookup(spark, sf_dir, asked_for=keys):
    data = D.tx_data(S.ledgers(spark, sf_dir), S.transactions(spark, sf_dir)).drop("envelope", "result")
    return J.one_step(asked_for(spark, sf_dir), data)


TWO = f"""with {L}, {T}, {K}, {SOME}, asked as (select query, {NORMAL} as tx_hash from keys), seqs as (select tx_hash, max(ledger_seq) as ledger_seq from txs group by 1),
sizes as (select ledger_seq, count(*) as n from txs group by 1),
steps as (select a.query, a.tx_hash, s.ledger_seq, k.closed_at, k.ledger_seq as known_seq, t.tx_index, z.n from asked a left join seqs s on s.tx_hash = a.tx_hash left join known k on k.ledger_seq = s.ledger_seq left join txs t on t.ledger_seq = s.ledger_seq and t.tx_hash = a.tx_hash left join sizes z on z.ledger_seq = s.ledger_seq),
two as (select query, tx_hash, ledger_seq, tx_index, closed_at, case when known_seq is not null then coalesce(tx_index, n, 0) else 0 end as tx_scanned,
case when tx_hash is null then 'INVALID_INPUT' when ledger_seq is null then 'NOT_IN_INDEX' when known_seq is null then 'LEDGER_NOT_FOUND' when tx_index is null then 'NOT_IN_LEDGER' else 'FOUND' end as outcome from steps)"""


def two(spark, sf_dir, asked_for=keys):
    txs = S.transactions(spark, sf_dir)
    return J.two_step(asked_for(spark, sf_dir), D.hash_to_seq(txs), some_ledgers(spark, sf_dir), txs)


@query(f"{TWO} select * from two")
def two_step_lookup(spark, sf_dir, asked_for=keys):
    return two(spark, sf_dir, asked_for)


@query(f"{TWO} select outcome, count(*) as n, sum(tx_scanned)::bigint as tx_scanned from two group by 1")
def two_step_outcomes(spark, sf_dir, asked_for=keys):
    return two(spark, sf_dir, asked_for).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("tx_scanned").alias("tx_scanned"))


@query(f"""with {L}, {T}, {K}, {SOME}, slots as (select tx_hash[1:4] as slot, min(ledger_seq) as ledger_seq from txs group by 1), members as (select tx_hash, max(ledger_seq) as ledger_seq from txs group by 1), asked as (select query, {NORMAL} as tx_hash from keys),
steps as (select a.*, coalesce(m.ledger_seq, s.ledger_seq) as seq, s.slot as slot from asked a left join slots s on s.slot = a.tx_hash[1:4] left join members m on m.tx_hash = a.tx_hash)
select query, tx_hash, case when slot is not null then seq end as ledger_seq, case when tx_hash is null then 'INVALID_INPUT' when slot is null then 'NOT_FOUND_IN_FILTER' when not exists (select 1 from known k where k.ledger_seq = seq) then 'LEDGER_NOT_FOUND' when exists (select 1 from txs t where t.tx_hash = steps.tx_hash and t.ledger_seq = seq) then 'FOUND' else 'FALSE_POSITIVE' end as outcome from steps""")
def mphf_lookup_outcomes(spark, sf_dir, asked_for=keys):
    """One approximate index over everything, then the ledger."""
    from ..functions.codecs import normal_hash

    txs = S.transactions(spark, sf_dir)
    members, slots = J.approximate_index(txs, F.lit(0).cast("long"))
    asked = asked_for(spark, sf_dir).select("query", normal_hash(F.col("query")).alias("tx_hash"))
    answers = J.probe(asked.where("tx_hash is not null").select("tx_hash").distinct(), members, slots).drop("index_idx")
    full = asked.join(answers, "tx_hash", "left").join(some_ledgers(spark, sf_dir).select("ledger_seq", F.lit(True).alias("ledger")), "ledger_seq", "left").join(txs.select("tx_hash", "ledger_seq", F.lit(True).alias("tx")).distinct(), ["tx_hash", "ledger_seq"], "left")
    outcome = F.when(F.col("tx_hash").isNull(), "INVALID_INPUT").when(F.col("ledger_seq").isNull(), "NOT_FOUND_IN_FILTER").when(F.col("ledger").isNull(), "LEDGER_NOT_FOUND").when(F.col("tx").isNotNull(), "FOUND").otherwise("FALSE_POSITIVE")
    return full.select("query", "tx_hash", "ledger_seq", outcome.alias("outcome"))


@query(f"{WALK} select query, tx_hash, outcome, n_visited, success_seq from classes")
def multi_index_outcomes(spark, sf_dir, asked_for=keys):
    return classes(spark, sf_dir, asked_for)[1].select("query", "tx_hash", "outcome", "n_visited", "success_seq")


@query(f"{WALK} select (select count(*) from classes) as processed, (select count(*) from classes where outcome in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL')) as success, (select count(*) from classes where outcome not in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL')) as failed, (select count(*) from keys where not regexp_full_match(query, '[0-9a-fA-F]{{64}}')) as invalid")
def outcome_totals(spark, sf_dir, asked_for=keys):
    return J.outcome_totals(*classes(spark, sf_dir, asked_for))


@query(f"""{WALK}, tuples as (select tx_hash, coalesce(string_agg('(' || ledger_seq || ',' || coalesce(strftime(closed_at, '%Y-%m-%dT%H:%M:%SZ'), 'x') || ')', ',' order by index_idx), '') as t from (select w.* from walk w join per p using (tx_hash) where p.success_seq is null or w.ledger_seq <> p.success_seq) group by 1)
select tx_hash, case when outcome = 'FALSE_POSITIVE_PARTIAL' then concat_ws('|', outcome, tx_hash, success_seq, coalesce(t, '')) when outcome = 'RECSPLIT_NOT_FOUND' then concat_ws('|', outcome, tx_hash) else concat_ws('|', outcome, tx_hash, coalesce(t, '')) end as line from classes left join tuples using (tx_hash) where outcome not in ('SUCCESS', 'LEDGER_NOT_FOUND', 'LEDGER_IN_MULTIPLE_DBS')""")
def error_log_lines(spark, sf_dir, asked_for=keys):
    return J.error_lines(classes(spark, sf_dir, asked_for, paths=True)[1].where("outcome not in ('LEDGER_NOT_FOUND', 'LEDGER_IN_MULTIPLE_DBS')"))


@query(f"""{WALK}, f as (select '"failures":{{' || string_agg('"' || outcome || '":' || n, ',' order by outcome) || '}}' as f from (select outcome, count(*) as n from classes where outcome not in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL') group by 1))
select '{{"processed":' || (select count(*) from classes) || ',"success":' || (select count(*) from classes where outcome in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL')) || ',"failed":' || (select count(*) from classes where outcome not in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL')) || ',"invalid":' || (select count(*) from keys where not regexp_full_match(query, '[0-9a-fA-F]{{64}}')) || ',' || f || '}}' as summary from f""")
def failure_json(spark, sf_dir, asked_for=keys):
    return J.summary_json(*classes(spark, sf_dir, asked_for))


TIME = "n_visited * 10 + 200"
#: The whole table's walk, the ledger each walk ended with, and in TIME a stand-in for the time of a query.
ENDED = f"""{WALK.replace(K, K_ALL)}, ended as (select tx_hash, arg_max(ledger_seq, index_idx) as seq from walk group by 1), timed as (select c.*, e.seq, {TIME} as ns from classes c left join ended e using (tx_hash))"""


@query(f"""{ENDED}, pairs as (select w.tx_hash, p.success_seq is not null and w.ledger_seq = p.success_seq as good, string_agg('(' || w.ledger_seq || ',' || strftime(w.closed_at, '%Y-%m-%d %H:%M:%S') || ' +0000 UTC)', ',' order by index_idx) as t from walk w join per p using (tx_hash) group by 1, 2),
claimed as (select seq, string_agg(cast(store_id as varchar), ',' order by store_id) as names from (select distinct seq from timed where outcome = 'LEDGER_IN_MULTIPLE_DBS') join stores on seq between first and last group by 1),
sizes as (select ledger_seq as seq, count(*) as n from txs group by 1)
select t.tx_hash, concat_ws('|', outcome, t.tx_hash, case outcome when 'LEDGER_NOT_FOUND' then cast(seq as varchar) when 'LEDGER_IN_MULTIPLE_DBS' then seq || '|' || names when 'FALSE_POSITIVE_NORMAL' then b.t || '|' || coalesce(n, 0) when 'FALSE_POSITIVE_COMPOUND' then b.t when 'FALSE_POSITIVE_PARTIAL' then g.t || '|' || b.t end, ns || 'ns') as line
from timed t left join pairs g on g.tx_hash = t.tx_hash and g.good left join pairs b on b.tx_hash = t.tx_hash and not b.good left join claimed using (seq) left join sizes using (seq) where outcome <> 'SUCCESS'""")
def lookup_log(spark, sf_dir):
    """The log of a lookup of every transaction, all classes, written as text and read back.

    Lines of a slot follow each other and list the same ledgers, of which compression leaves little.
    """
    path = new_path(spark, "log")
    J.write_lines(J.told(classes(spark, sf_dir, every_key, paths=True)[1], F.expr(TIME)), path, compression="gzip")
    return spark.read.text(path).select(F.split("value", "[|]")[1].alias("tx_hash"), F.col("value").alias("line"))


OF_TIME = "coalesce(sum(ns) filter (where w) // greatest(count(*) filter (where w), 1), 0) || 'ns\"'"
MEANS = ", ".join(f"""'"{c}":"' || {OF_TIME}""" for c in J.PHASES)
MEANS = f"""concat_ws(',', {MEANS}, '"avg_tx_scanned":' || coalesce(cast(sum(n_visited) filter (where w) as bigint) // greatest(count(*) filter (where w), 1), 0))"""


@query(f"""{ENDED}, good as (select {MEANS.replace("where w", "where outcome = 'SUCCESS'")} as a, {MEANS.replace("where w", "where outcome = 'FALSE_POSITIVE_PARTIAL'")} as p, count(*) as n, count(*) filter (where outcome in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL')) as ok from timed),
f as (select string_agg('"' || outcome || '":{{"count":' || n || ',"avg_time":"' || ns || 'ns"}}', ',' order by outcome) as f from (select outcome, count(*) as n, sum(ns) // count(*) as ns from timed where outcome not in ('SUCCESS', 'FALSE_POSITIVE_PARTIAL') group by 1))
select '{{"total_transactions":' || n || ',"total_success":' || ok || ',"total_failed":' || (n - ok) || ',"invalid_inputs":' || (select count(*) from keys where not regexp_full_match(query, '[0-9a-fA-F]{{64}}')) || ',"wall_clock_time_ns":1000000000,"wall_clock_time":"1.000s","throughput_per_second":' || n || '.0,"success_avg":{{' || a || '}},"false_positive_partial_avg":{{' || p || '}},"failures":{{' || f || '}}}}' as summary from good, f""")
def lookup_summary(spark, sf_dir):
    """The summary of the same lookup; each phase takes the stand-in's time, and visits stand for scanned transactions."""
    asked, found = classes(spark, sf_dir, every_key)
    timed = found.select("outcome", *[F.expr(TIME).alias(c) for c in J.PHASES], F.col("n_visited").alias("tx_scanned"))
    path = new_path(spark, "summary")
    J.write_lines(J.lookup_summary(timed, asked, 1_000_000_000), path, "summary")
    return spark.read.text(path).select(F.col("value").alias("summary"))


@query(f"with {T}, answers as (select tx_hash, max(ledger_seq) as a from txs where ledger_seq % 13 <> 0 group by 1) select count(*) as checked, count(*) filter (where a = ledger_seq) as verified, count(*) filter (where a is null or a <> ledger_seq) as failed from txs left join answers using (tx_hash)")
def index_verify(spark, sf_dir):
    txs = S.transactions(spark, sf_dir)
    return J.verified(txs.select("tx_hash", "ledger_seq"), D.hash_to_seq(txs.where("ledger_seq % 13 <> 0")))


@query(f"with {L}, {SOME} select l.ledger_seq, count(s.store_id) as n_stores, min(s.store_id) as first_store from ledgers l left join stores s on l.ledger_seq between s.first and s.last group by 1")
def store_routing(spark, sf_dir):
    seqs = S.ledgers(spark, sf_dir).select("ledger_seq")
    claimed = J.claims(seqs, stores(spark, sf_dir)).groupBy("ledger_seq").agg(F.count("store_id").alias("n_stores"), F.min("store_id").alias("first_store"))
    return seqs.join(claimed, "ledger_seq", "left").withColumn("n_stores", F.coalesce("n_stores", F.lit(0)))


@query(f"with {L}, {SOME} select a.store_id as store_a, b.store_id as store_b, greatest(a.first, b.first) as first, least(a.last, b.last) as last from stores a join stores b on a.store_id < b.store_id and a.first <= b.last and b.first <= a.last")
def multi_store_conflicts(spark, sf_dir):
    a, b = stores(spark, sf_dir).alias("a"), stores(spark, sf_dir).alias("b")
    both = a.join(b, F.expr("a.store_id < b.store_id and a.first <= b.last and b.first <= a.last"))
    return both.select(F.col("a.store_id").alias("store_a"), F.col("b.store_id").alias("store_b"), F.greatest("a.first", "b.first").alias("first"), F.least("a.last", "b.last").alias("last"))


@query(f"with {L}, {T}, {K}, slots as (select distinct tx_hash[1:4] as slot from txs) select distinct lower(query) as tx_hash from keys where regexp_full_match(query, '[0-9a-fA-F]{{64}}') and lower(query)[1:4] in (select slot from slots)")
def filter_semi_join(spark, sf_dir, asked_for=keys):
    _, slots = J.approximate_index(S.transactions(spark, sf_dir), F.lit(0))
    hashes = asked_for(spark, sf_dir).where(is_hash(F.col("query"))).select(F.lower("query").alias("tx_hash")).distinct()
    return J.maybe_present(hashes, slots)


def over_all(name):
    """The query ``name`` over the hashes of the whole table, as ``name``_all."""
    own = QUERIES[name]

    def run(spark, sf_dir):
        return own(spark, sf_dir, every_key)

    run.__name__ = f"{name}_all"
    return query(SQL[name].replace(K, K_ALL))(run)


for _name in ("hash_list_validate", "one_step_lookup", "two_step_lookup", "two_step_outcomes", "mphf_lookup_outcomes", "multi_index_outcomes", "outcome_totals", "error_log_lines", "failure_json", "filter_semi_join"):
    over_all(_name)
