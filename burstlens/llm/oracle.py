"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

EXACT = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""


def _clusters(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    """Rounds written out; distances come from whole squares, not from bisectors."""
    parts = [f"""
v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, x from v qualify c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
p{i} as (
  select r, c, (select sum((a - b) * (a - b)) from (select unnest(v.x) as a, unnest(c{i}.x) as b)) as far from v, c{i}),
a{i} as materialized (select r, arg_min(c, (far, c)) as c, min(far) as far from p{i} group by r)""")
        if i < rounds:
            parts.append(f"""
m{i} as (
  select c, d, sum(e) as s, count(*) as n from (
    select a{i}.c, unnest(v.x) as e, generate_subscripts(v.x, 1) as d from a{i} join v using (r)) group by c, d),
f{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by d) as x from m{i} group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(f{i}.x, c{i}.x) as x from c{i} left join f{i} using (c))""")
    return "with" + ",".join(parts) + f"""
select v.vec_id, a{rounds}.c::integer as cluster, far::bigint as distance,
       (sum(far) over (partition by a{rounds}.c))::bigint as cluster_inertia, (sum(far) over ())::bigint as inertia,
       sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} on c{rounds}.c = a{rounds}.c
"""


def _merkle(levels: int = 15) -> str:
    """The tree a level at a time over all nodes; ``levels`` bounds a group to 3 ** levels rows."""
    def enc(e):
        return f"coalesce(strlen(({e})::varchar) || ':' || ({e}), '-')"

    # the check sum bit by bit: a step either takes in a byte or shifts once
    crc = """xor(list_reduce(list_concat([4294967295::ubigint], flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda ch: [(256 + ascii(ch))::ubigint, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, e: case when e >= 256 then xor(a, e - 256) else xor(a >> 1, (a & 1) * 3988292384::ubigint) end), 4294967295::ubigint)"""

    def tree(name, start, leaves):
        """name0 .. nameN: nodes (g, pos, h, n); nameL0 .. nameLN: leaves with their node, proof and fold so far."""
        parts = [f"{name}0 as materialized ({start})", f"{name}l0 as materialized ({leaves})"]
        for k in range(levels):
            parts.append(f"""
{name}r{k} as materialized (
  select g, pos // 3 as pos, any_value(n) as n, string_agg(h, '' order by pos) as run from {name}{k} group by g, pos // 3),
{name}{k + 1} as materialized (
  select g, pos, case when n = 1 then run else sha256(run) end as h, count(*) over (partition by g) as n from {name}r{k}),
{name}l{k + 1} as materialized (
  select l.* replace (l.pos // 3 as pos,
      case when r.n = 1 then proof else proof || run[1:64 * (l.pos % 3)] || run[64 * (l.pos % 3) + 65:] end as proof,
      case when r.n = 1 then fold else sha256(run[1:64 * (l.pos % 3)] || fold || run[64 * (l.pos % 3) + 65:]) end as fold)
  from {name}l{k} l join {name}r{k} r on r.g = l.g and r.pos = l.pos // 3)""")
        return parts

    head = [f"""
b as materialized (
  select doc_id, coalesce('1' || source, '0') as g,
         sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) as leaf,
         sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} ||
                {enc(f"case when ({crc}) % 2 = 0 then replace(text, chr(10), '') else text end")}) as again
  from documents),
o as materialized (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from b)"""]
    per = tree("s", "select g, pos, leaf as h, n from o", "select doc_id, leaf, g, pos, '' as proof, again as fold from o")
    top = tree("t", f"""select '' as g, row_number() over (order by encode(g)) - 1 as pos, h, count(*) over () as n from s{levels}""",
               f"""select l.doc_id, l.leaf, '' as g, l.proof, l.fold, x.pos, x.h as subroot from s{levels} t
    join (select g, row_number() over (order by encode(g)) - 1 as pos, h from s{levels}) x using (g) join sl{levels} l using (g)""")
    return "with " + ",\n".join(head + per + top) + f"""
select doc_id, leaf, subroot, t{levels}.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = t{levels}.h as verified
from tl{levels}, t{levels}
"""


ORACLE = {
    "op6_topk": TOP_K,
    "op11_exact_dedup": EXACT,
    "op12_centroid_clusters": _clusters(),
    "op13_merkle_manifest": _merkle(),
}
