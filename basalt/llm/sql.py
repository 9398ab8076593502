"""DuckDB SQL for the queries whose rows SQL can express, by plain definitions: all windows, all pairs, closures."""

from __future__ import annotations

from . import licenses, urlfilter

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """with p as (select page_id, nullif(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), '') as uri, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, payload_bytes >= 100 and page_id <> min(page_id) over (partition by payload_digest) as again, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to, uri from f"""


def closed(nodes: str, links: str) -> str:
    """CTEs that end with comp(node, component): the smallest node that each of ``nodes`` reaches over ``links(a, b)``."""
    return f"""both_ as (select a, b from {links} union select b, a from {links}),
reach as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
comp as (select n.node, least(n.node, coalesce(min(r.b), n.node)) as component from (select distinct node from {nodes}) n left join reach r on r.a = n.node group by n.node)"""


EMBEDDINGS = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.95),
nodes as (select vec_id as node from v),
{closed("nodes", "links")},
n as (select a, count(*) as n from both_ group by 1)
select vec_id, coalesce(n, 0) as n_links, component as component_id, vec_id = component as kept from v join comp on node = vec_id left join n on n.a = vec_id"""

MINHASH = f"""with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
pairs as (select doc_id, n, pos, word || ' ' || lead(word) over (partition by doc_id order by pos) as two, word from words),
sh as (select distinct doc_id, case when n = 1 then word else two end as s from pairs where n = 1 or two is not null),
size as (select doc_id, count(*) as n from sh group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as shared from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from common join size p on p.doc_id = a join size q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
nodes as (select doc_id as node from documents),
{closed("nodes", "links")}
select d.doc_id, coalesce(size.n, 0) as n_shingles, component as component_id, d.doc_id = component as kept from documents d join comp on node = d.doc_id left join size on size.doc_id = d.doc_id"""

DECONTAMINATE = f"""with words as (select 'd' as kind, doc_id as id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents union all select 'b', item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
one as (select kind, id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as pos from words),
next as (select kind, id, n, pos, list(word) over (partition by kind, id order by pos rows between current row and 12 following) as l from one),
items as (select distinct id, least(13, n) as size, array_to_string(l[1:least(13, n)], ' ') as win from next where kind = 'b' and len(l) >= least(13, n)),
places as (select id, pos, size, array_to_string(l[1:size], ' ') as win from next, (select distinct size from items) where kind = 'd' and len(l) >= size),
found as (select p.id as doc_id, i.id as item_id, pos, p.size from places p join items i using (size, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from found) group by 1),
own as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from words left join hit on hit.doc_id = id left join own on own.doc_id = id where kind = 'd'"""

SQL = {
    "op1_licenses": licenses.sql(),
    "op2_warc": WARC,
    "op3_embeddings": EMBEDDINGS,
    "op5_minhash": MINHASH,
    "op6_urlfilter": urlfilter.sql(),
    "op9_decontaminate": DECONTAMINATE,
}
