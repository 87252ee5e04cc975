"""DuckDB SQL with the rows of the queries that SQL can express."""

#: Trees by recursion: nodes level by level, then proofs and folded digests from each leaf up.
MERKLE = """
with recursive
fields as (
  select doc_id, source, lang, n_chars, text,
    list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as crc
  from documents),
texts as (
  select *, case when xor(crc, 4294967295) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as found_text
  from fields),
heads as (
  select *, concat(
    case when doc_id is null then '-' else concat(strlen(doc_id::varchar), ':', doc_id) end,
    case when source is null then '-' else concat(strlen(source), ':', source) end,
    case when lang is null then '-' else concat(strlen(lang), ':', lang) end,
    case when n_chars is null then '-' else concat(strlen(n_chars::varchar), ':', n_chars) end) as head
  from texts),
leaves as (
  select doc_id, source,
    sha256(concat(head, case when text is null then '-' else concat(strlen(text), ':', text) end)) as leaf,
    sha256(concat(head, case when found_text is null then '-' else concat(strlen(found_text), ':', found_text) end)) as found
  from heads),
sources as (select source, row_number() over (order by source nulls first) - 1 as src from (select distinct source from documents)),
placed as (
  select src, doc_id, leaf, found, row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by src) as c
  from leaves join sources on leaves.source is not distinct from sources.source),
nodes as (
  select 0 as lvl, src, i, c, leaf as h from placed
  union all
  select lvl + 1, src, i // 16, (c + 15) // 16, sha256(string_agg(h, '' order by i)) from nodes where c > 1 group by lvl, src, i // 16, c),
runs as (select lvl, src, i // 16 as g, list(h order by i) as hs from nodes where c > 1 group by all),
subroots as (select src, h from nodes where c = 1),
tops as (
  select 0 as lvl, src as i, (select count(*) from sources) as c, h from subroots
  union all
  select lvl + 1, i // 16, (c + 15) // 16, sha256(string_agg(h, '' order by i)) from tops where c > 1 group by lvl, i // 16, c),
top_runs as (select lvl, i // 16 as g, list(h order by i) as hs from tops where c > 1 group by all),
folds as (
  select 0 as lvl, src, i as place, i, found as node, '' as proof from placed
  union all
  select f.lvl + 1, f.src, f.place, f.i // 16,
    sha256(concat(array_to_string(hs[1 : f.i % 16], ''), node, array_to_string(hs[f.i % 16 + 2 :], ''))),
    concat(proof, array_to_string(hs[1 : f.i % 16], ''), array_to_string(hs[f.i % 16 + 2 :], ''))
  from folds f join runs r on f.lvl = r.lvl and f.src = r.src and f.i // 16 = r.g),
below as (select src, place, node, proof from folds qualify row_number() over (partition by src, place order by lvl desc) = 1),
top_folds as (
  select 0 as lvl, src, place, src as i, node, proof from below
  union all
  select f.lvl + 1, f.src, f.place, f.i // 16,
    sha256(concat(array_to_string(hs[1 : f.i % 16], ''), node, array_to_string(hs[f.i % 16 + 2 :], ''))),
    concat(proof, array_to_string(hs[1 : f.i % 16], ''), array_to_string(hs[f.i % 16 + 2 :], ''))
  from top_folds f join top_runs r on f.lvl = r.lvl and f.i // 16 = r.g),
whole as (select src, place, node, proof from top_folds qualify row_number() over (partition by src, place order by lvl desc) = 1)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = r.h as verified
from placed p join whole w on p.src = w.src and p.i = w.place join subroots s on s.src = p.src cross join (select h from tops where c = 1) r
"""
