"""The queries of this subpackage: op1 to op13 over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.llm.chat import format_chats
from pointloom.llm.common import shared_path, table
from pointloom.llm.embedding_dedup import embedding_groups
from pointloom.llm.exact_dedup import exact_groups
from pointloom.llm.filter_audit import audit
from pointloom.llm.hard_negatives import hard_negatives
from pointloom.llm.language import languages
from pointloom.llm.mixing import mix_digest
from pointloom.llm.near_dedup import near_groups
from pointloom.llm.packing import pack
from pointloom.llm.pii import find_pii
from pointloom.llm.substring_dedup import drop_repeats
from pointloom.llm.token_store import digest, read_tokens, write_tokens
from pointloom.llm.toxicity import score


def token_store(spark, d):
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, d, "documents"), path)
    return digest(read_tokens(spark, path))


def mined(spark, d):
    vectors = table(spark, d, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_mixing": lambda spark, d: mix_digest(table(spark, d, "documents")),
    "op2_best_fit_packing": lambda spark, d: pack(table(spark, d, "documents")),
    "op3_substring_dedup": lambda spark, d: drop_repeats(table(spark, d, "documents")),
    "op4_chat_formatting": lambda spark, d: format_chats(table(spark, d, "conversations")),
    "op5_pii": lambda spark, d: find_pii(table(spark, d, "documents")),
    "op6_toxicity": lambda spark, d: score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_minhash_near_dedup": lambda spark, d: near_groups(table(spark, d, "documents")).drop("text_hash"),
    "op8_embedding_near_dedup": lambda spark, d: embedding_groups(table(spark, d, "embeddings")),
    "op9_token_store": token_store,
    "op10_exact_dedup": lambda spark, d: exact_groups(table(spark, d, "documents")),
    "op11_hard_negatives": mined,
    "op12_filter_audit": lambda spark, d: audit(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_language_id": lambda spark, d: languages(table(spark, d, "documents")),
}

ORACLE_SQL = {
    "op1_mixing": r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5('mix:' || coalesce(doc_id::varchar, '')) h from documents),
per as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 src_no from sizes group by source),
weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][(src_no % 3 + 1)::int] w, source_size::double * 2.0::double cap from per),
levels as (
  select *, cap / w r, (sum(source_size::double) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, src_no rows between unbounded preceding and 1 preceding), 0)) /
            (sum(w) over () - coalesce(sum(w) over (order by cap / w, src_no rows between unbounded preceding and 1 preceding), 0)) lev from weighed),
targets as (
  select source, src_no, source_size,
         case when first_ok is null then cap else least(cap, first_ok * w) end target
  from (select *, (select arg_min(lev, struct_pack(r := r, n := src_no)) from levels where lev <= r) first_ok from levels)),
done as (
  select s.*, src_no, source_size, target, sum(size) over (partition by src_no order by h, doc_id nulls first, size) cum
  from sizes s join targets t on s.source is not distinct from t.source),
copies as (
  select *, 0 pass, cum::double / target fin from done where target > 0
  union all select *, 1 pass, (cum + source_size)::double / target fin from done where target > 0),
ordered as (
  select *, sum(size) over (order by fin, src_no, pass, h, doc_id nulls first, size) reached from copies),
taken as (
  select src_no, h, doc_id, size, count(distinct pass) n from ordered
  where reached <= (select sum(size) * 1.5::double from sizes) group by all)
select d.doc_id, d.source, d.size, d.source_size, d.target, (d.size * coalesce(t.n, 0))::bigint taken
from done d left join taken t on d.src_no = t.src_no and d.h = t.h and d.doc_id is not distinct from t.doc_id and d.size = t.size
""",
    "op4_chat_formatting": r"""
with places as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) place from conversations),
named as (
  select *, string_agg(coalesce('v' || len(role) || ':' || role, 'n') || coalesce('v' || len(text) || ':' || text, 'n'), '')
            over (partition by conv_id order by place) named, count(*) over (partition by conv_id) n_turns from places),
whole as (select n_turns, named, min(conv_id) conv_id from named where place = n_turns group by all),
kept as (
  select * from whole w where not exists (select 1 from named p where p.place < p.n_turns and p.place = w.n_turns and p.named = w.named))
select p.conv_id, (p.place - 1) // 1024 part, k.n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by place) text
from places p join kept k on p.conv_id is not distinct from k.conv_id group by all
""",
    "op10_exact_dedup": r"""
select doc_id, max(doc_id) over (partition by coalesce(text, '')) keep_id, count(*) over (partition by coalesce(text, '')) group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) kept, sha256(coalesce(text, '')) text_sha256
from documents
""",
    "op3_substring_dedup": r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws from documents),
spots as (select doc_id, ws, unnest(range(1, len(ws) + 1)) p from w),
named as (select doc_id, p, ws[p] word, case when p + 49 <= len(ws) then md5(array_to_string(ws[p:p + 49], ' ')) end win from spots),
first as (select win, min(doc_id) low from named where win is not null group by win),
marked as (
  select n.doc_id, n.p, n.word,
         max(case when f.low < n.doc_id then n.p end) over (partition by n.doc_id order by n.p rows between 49 preceding and current row) is not null gone
  from named n left join first f using (win)),
sums as (
  select doc_id, count(*) filter (where gone) n_removed, coalesce(string_agg(word, ' ' order by p) filter (where not gone), '') kept from marked group by doc_id)
select w.doc_id, len(w.ws)::bigint n_words, coalesce(s.n_removed, 0)::bigint n_removed, sha256(coalesce(s.kept, '')) kept_sha256
from w left join sums s using (doc_id)
""",
    "op7_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) ws from documents),
sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) s from w),
e as (select doc_id, unnest(s) g from sets),
pairs as (select a.doc_id a, b.doc_id b, count(*) n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.b) component_id, min(r.b) = s.doc_id kept
from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.s
""",
    "op8_embedding_near_dedup": r"""
with recursive v as (select vec_id, embedding::double[] e from embeddings),
good as (select * from v where e is not null and len(e) > 0 and list_count(e) = len(e) and list_bool_and(list_transform(e, lambda x: isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a)
select v.vec_id, (select count(*) from links where a = v.vec_id) n_links, min(r.b) component_id, min(r.b) = v.vec_id kept
from v join reach r on r.a = v.vec_id group by v.vec_id
""",
    "op11_hard_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) q
  from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding) and coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)),
scored as (
  select a.vec_id anchor_id, a.label = c.label same, c.vec_id id, coalesce(list_inner_product(a.q, c.q), 0)::bigint score
  from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
positives as (
  select anchor_id, id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int "rank", id negative_id, positive_score, score negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
""",
    "op12_filter_audit": r"""
with recursive base as (
  select doc_id, coalesce(source::varchar, '') part, coalesce(text, '') t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) ws from documents),
flagged as (
  select doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] f from base),
marks as (select doc_id, coalesce(bool_or(quality = 1), false) g, coalesce(bool_or(toxic = 1), false) x from labels where doc_id is not null group by doc_id),
cells as (
  select part, f, count(*) n, count(*) filter (where coalesce(g, false)) good, count(*) filter (where coalesce(x, false)) toxic
  from flagged left join marks using (doc_id) group by part, f),
orders(filter_order) as (
  select '' union all select filter_order || l from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) l) where not contains(filter_order, l)),
steps as (
  select filter_order, step, ascii(filter_order[step]) - 64 k, list_transform(string_split(filter_order[1:step - 1], ''), lambda c: ascii(c) - 64) prior
  from orders, (select unnest(range(1, 6)) step) where len(filter_order) = 5),
long as (
  select c.*, s.*, f[k] here, step > 1 and list_bool_or(list_transform(prior, lambda i: f[i])) gone,
         len(list_filter(f, lambda v: v)) = 1 and f[k] lone from cells c, steps s),
sums as (
  select part, filter_order, step, k, coalesce(sum(n) filter (where not here and not gone), 0)::bigint kept,
         coalesce(sum(n) filter (where here and not gone), 0)::bigint removed, coalesce(sum(n) filter (where here and gone), 0)::bigint redundant,
         coalesce(sum(n) filter (where lone), 0)::bigint unique_fails, coalesce(sum(good) filter (where here and not gone), 0)::bigint good_lost,
         coalesce(sum(toxic) filter (where here and not gone), 0)::bigint toxic_lost from long group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, k))::bigint shapley
from sums
""",
}
