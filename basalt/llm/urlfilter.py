"""URL filters: rules for hosts and paths, and link-graph propagation for all other pages.

Pages that a rule decides are the seeds. Trust is personalised PageRank from hosts with allowed
pages along links; distrust is the same from hosts with blocked pages against the links' direction
(who links to bad hosts is suspect). Both run as one table keyed by (kind, host). A page without
a rule is blocked if its host has gathered more than ``ratio`` times as much distrust as trust.

Ranks x = (1 - damping) * seeds + damping * links(x) grow from round to round; rounds end when a round
adds less than ``tolerance`` of the sum, so what is left out is below tolerance * damping / (1 - damping)
of it. Each kind's ranks are then scaled to the sum 1. That is the PageRank in which hosts without
links hand their rank back to the seeds. Shares of seeds, not their number, count.

Everything is DataFrame expressions. The edge table has a row for each pair of hosts that link, and ranks
one for each host; both are aggregated on the map side before they are shuffled.

Defined results: a null url, or one without "://", has an empty host and path and takes no part in
the graph; it is allowed (no distrust). A host that neither rules nor links reach is allowed, and so
is one with as much trust as distrust (a tie, within a billionth, as sums of doubles depend on their
order). Of rules of equal length that fit, the last in order of host and path counts. Repeated rows are
judged each and count as often in seeds and links. Tables may be empty. Links are the ``href`` values of
whole ``html`` texts, however long, with a scheme or from "//" on; others stay on their own host, which
has no effect on other hosts and is left out, as are those of null html. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Params:
    rules: tuple = RULES
    tolerance: float = 1e-4
    damping: float = 0.85
    ratio: float = 1.0


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """The longest fitting rule, as its host and path; null if none fits."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, h + p).otherwise(out)
    return out


def judged(pages: DataFrame, p: Params) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null without a rule)."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path"), p.rules))
    verdict = F.lit(None).cast("string")
    for h, q, v in p.rules:
        verdict = F.when(F.col("rule") == h + q, v).otherwise(verdict)
    return df.withColumn("by_rule", verdict)


def edges(pages: DataFrame) -> DataFrame:
    """kind, host, other, share: for trust each link's direction, for distrust its reverse; shares of a host add up to 1."""
    urls = F.regexp_extract_all("html", F.lit("""(?i)href\\s*=\\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\\s<>]+)"""), 1)
    linked = pages.where("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(urls).alias("to"))
    pairs = linked.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), F.col("to"))).otherwise(F.col("to"))).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    pairs = staged(pairs, "pairs")
    both = pairs.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("other"), "n").unionByName(pairs.select(F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("other"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    return both.join(out, ["kind", "host"]).select("kind", "host", "other", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """kind, host, rank: personalised PageRank from ``seeds(kind, host, rank)``, whose ranks add up to 1 for each kind."""
    total = lambda df: {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.sum("rank").alias("n")).collect()}  # noqa: E731  two rows
    rank, start = seeds, seeds.select("kind", "host", (F.col("rank") * (1 - p.damping)).alias("rank"))
    if not links.isEmpty():
        rank, sums = start, total(start)
        while sums:
            moved = links.join(rank, ["kind", "host"]).select("kind", F.col("other").alias("host"), (F.col("rank") * F.col("share") * p.damping).alias("rank"))
            rank = staged(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
            before, sums = sums, total(rank)
            if all(sums[k] - before[k] <= p.tolerance * sums[k] for k in sums):
                break
    sums = rank.groupBy("kind").agg(F.sum("rank").alias("all"))
    return rank.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))  # two rows at most are broadcast


def filter_urls(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of ``pages(page_id, url, html)``."""
    rows = judged(pages, p)
    counts = staged(rows.where("by_rule is not null and host <> ''").groupBy(F.col("by_rule").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n")), "seeds")
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("rank"))  # two rows at most are broadcast
    rank = propagate(staged(seeds, "seeds"), staged(edges(pages), "edges"), p)
    score = rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(c) for k, c in (("allow", "trust"), ("block", "distrust"))])
    out = rows.join(score, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_graph = F.when(F.col("distrust") > F.col("trust") * (p.ratio * (1 + 1e-9)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")


def sql(p: Params = Params(), rounds: int = 50, ranks: bool = False) -> str:
    """The same for DuckDB, over a view ``pages``, by ``rounds`` rounds with the rank of hosts without links handed back; for graphs of few hosts."""
    upper = f"'{UPPER}', '{LOWER}'"

    def host(url):
        rest = f"substring({url}, nullif(instr({url}, '://'), 0) + 3)"
        return f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), {upper}), '')"

    path = "coalesce(regexp_extract(substring(url, nullif(instr(url, '://'), 0) + 3), '^[^/?#]*([^?#]*)', 1), '')"
    order = sorted(p.rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    cases = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{q}') then '{h}{q}'" for h, q, _ in order)
    verdicts = " ".join(f"when rule = '{h}{q}' then '{v}'" for h, q, v in p.rules)
    steps = "".join(
        f""", m{k + 1} as materialized (select kind, e.other as host, sum(r.rank * e.share) rank from edges e join r{k} r using (kind, host) group by 1, 2),
r{k + 1} as materialized (select kind, host, sum(rank) rank from (select kind, host, {p.damping} * rank rank from m{k + 1} union all select kind, host, r0.rank * (1 - {p.damping} * coalesce((select sum(rank) from m{k + 1} m where m.kind = r0.kind), 0)) from r0) group by 1, 2)"""
        for k in range(rounds)
    )
    return f"""with urls as (select page_id, {host("url")} host, {path} path from pages),
ruled as (select *, case {cases} end as rule from urls),
rows_ as (select *, case {verdicts} end as by_rule from ruled),
counts as (select by_rule kind, host, count(*) n from rows_ where by_rule is not null and host <> '' group by 1, 2),
r0 as materialized (select kind, host, n / sum(n) over (partition by kind) rank from counts),
linked as (select {host("url")} src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s<>]+)', 1)) t from pages where html is not null),
pairs as (select src, {host("case when starts_with(t, '//') then ':' || t else t end")} dst, count(*) n from linked where src <> '' group by 1, 2),
both_ as (select 'allow' kind, src host, dst other, n from pairs where src <> dst and dst <> '' union all select 'block', dst, src, n from pairs where src <> dst and dst <> ''),
edges as materialized (select kind, host, other, n / sum(n) over (partition by kind, host) as share from both_){steps},
score as (select host, sum(case when kind = 'allow' then rank else 0 end) trust, sum(case when kind = 'block' then rank else 0 end) distrust from r{rounds} group by host)
select page_id, host, path, rule, coalesce(by_rule, case when coalesce(distrust, 0) > coalesce(trust, 0) * {p.ratio * (1 + 1e-9)!r}::double then 'block' else 'allow' end) verdict
{", coalesce(trust, 0)::double trust, coalesce(distrust, 0)::double distrust" if ranks else ""} from rows_ left join score using (host)"""
