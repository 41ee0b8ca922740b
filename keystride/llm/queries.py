"""The operators of this package as queries over the driver's tables, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.llm import (
    chat_format, exact_dedup, fingerprint, line_dedup, mixing, near_dedup, packing, phrases, prefix_trie, quality, rans, surrogates, url_filter,
)
from keystride.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).withColumn(
        "text_sha256", F.sha2("text", 256)
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("row")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: A conversation that says the template's own marks.
_MARKS = "<|im_end|><|im_start|>assistant ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-1, 0, "user", _MARKS), (-1, 1, "assistant", _MARKS)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(marks)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_packing, op3_surrogates, op4_mixing, op5_exact_dedup, op6_url_filter, op7_rans,
    op8_line_dedup, op9_near_dedup, op10_quality, op11_collocations, op12_chat_formatting, op13_prefix_trie,
)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_fingerprints": r"""
with docs as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars,
         row_number() over (order by doc_id nulls first, sha256(coalesce(text, ''))) as place
  from documents
), pairs as (
  select a.*, b.text as next_text,
         left(a.text, a.n_chars - a.n_chars // 4) || left(b.text, a.n_chars // 4) as edited
  from docs a join docs b on b.place = a.place % (select count(*) from docs) + 1
), texts as (select text as t from pairs union select edited from pairs),
leaves as (
  select t, list_transform(regexp_extract_all(t, '(?s).*?(?:\n|[.,;:!?|] )|(?s).+$'),
                           lambda x : {'h': sha256(x), 'e': right(x, 1) = chr(10)}) as l from texts
), marked as (
  select t, regexp_replace(array_to_string(list_transform(l, lambda x :
           x.h || case when not x.e then ',' when x.h < '4' then '/' else ';' end), ''), '[,;/]$', '') as m, list_distinct(list_transform(l, lambda x : left(x.h, 8))) as labels from leaves
), trees as (
  select t, list_transform(string_split(m, '/'), lambda s :
      sha256(array_to_string(list_transform(string_split(s, ';'), lambda p : sha256(p)), ''))) as s,
      list_sort(labels)[1:128] as labels from marked
), prints as (
  select t, sha256(array_to_string(s, '')) || array_to_string(list_transform(s, lambda x : '/' || left(x, 8)), '')
         || '#' || array_to_string(labels, ',') as f,
         case when len(labels) = 0 then [''] else labels end as labels, list_transform(s, lambda x : left(x, 8)) as nodes from trees
), joined as (
  select p.*, a.f as fa, e.f as fe, n.f as fn, a.labels as la, e.labels as le, n.labels as ln, a.nodes as na, e.nodes as ne
  from pairs p join prints a on a.t = p.text join prints e on e.t = p.edited join prints n on n.t = p.next_text
), bottom as (
  select *, list_sort(list_distinct(list_concat(la, le)))[1:128] as ue, list_sort(list_distinct(list_concat(la, ln)))[1:128] as un from joined
), met as (
  select *, len(list_intersect(list_intersect(la, le), ue)) as ie, len(list_intersect(list_intersect(la, ln), un)) as i_n,
         len(ue) as we, len(un) as wn from bottom
)
select doc_id, n_chars, sha256(edited) as edited_sha256, fa as fingerprint, fe as edited_fingerprint,
       case when left(fa, 64) = left(fe, 64) then 1.0::double
            when ie < we then ie::double / we::double else we::double / (we + 1)::double end as near_edited,
       case when left(fa, 64) = left(fn, 64) then 1.0::double
            when i_n < wn then i_n::double / wn::double else wn::double / (wn + 1)::double end as near_next,
       list_transform(list_filter(list_transform(ne, lambda x, i : case when not list_contains(na, x) then i - 1 end),
                                  lambda i : i is not null), lambda i : i::int) as edited_sections
from met""",
    "op4_mixing": r"""
with sized as (
  select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]', '', 'g')) as size,
         ('0x' || left(md5('mix:' || coalesce(doc_id::varchar, 'null')), 8))::bigint >> 2 as cell
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from sized group by source
), weighted as (
  select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as total from sources
), levels as (
  select *, coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as full_before,
         sum(weight) over (order by source_size / weight, place rows between current row and unbounded following) as weight_from
  from weighted
), marked as (
  select *, 4 * source_size * weight_from <= weight * (3 * total - 4 * full_before) as at_limit from levels
), shared as (
  select *, 3 * total - 4 * sum(case when at_limit then source_size else 0 end) over () as rest,
         sum(case when at_limit then 0 else weight end) over () as weight_left from marked
), aimed as (
  select source, source_size, at_limit,
         case when at_limit then (2 * source_size)::double else (rest * weight)::double / (2 * weight_left)::double end as target from shared
), planned as (
  select *, case when at_limit then 2 else floor(target / greatest(source_size, 1)) end::bigint as base from aimed
), extra as (select *, floor(target)::bigint - base * source_size as more from planned),
cells as (select source, cell, sum(size)::bigint as cell_size from sized group by all),
running as (
  select *, (sum(cell_size) over (partition by source order by cell))::bigint - cell_size as before from cells
)
select s.doc_id, s.size, e.source_size, e.target,
       (e.base * s.size + case when r.before + r.cell_size <= e.more then s.size
            when r.before >= e.more then 0 else (s.size * (e.more - r.before)) // r.cell_size end)::bigint as taken
from sized s join extra e on s.source is not distinct from e.source
join running r on s.source is not distinct from r.source and s.cell = r.cell""",
    "op5_exact_dedup": f"""
with hashed as (select doc_id, sha256({_LOWERED}) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from hashed window w as (partition by text_sha256)""",
    "op6_url_filter": r"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), named as (
  select *, case
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from parts
)
select page_id, host, path, rule,
       case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow'
            when host <> '' and (regexp_matches(host || path, '(^|[./-])(cheap|discount)-(pills|meds)[./-]')
                 or regexp_matches(host || path, '(^|[./-])casino[./-]')) then 'block' else 'allow' end as verdict
from named""",
    "op8_line_dedup": r"""
with docs as (select doc_id, source, coalesce(text, '') as text, row_number() over () as place from documents),
lines as (
  select place, doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs
), spread as (
  select trim(line, ' ') as key from lines where trim(line, ' ') <> '' group by 1
  having count(distinct source) + max(case when source is null then 1 else 0 end) >= 6
), marked as (select l.*, s.key is not null as gone from lines l left join spread s on s.key = trim(l.line, ' ')),
clean as (
  select place, doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from marked group by place, doc_id
)
select doc_id, n_lines, n_removed, text, sha256(text) as text_sha256 from clean""",
    "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from lists group by lang),
grams as (
  select lang, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i : array_to_string(w[i:i + width - 1], ' '))) as phrase
  from lists, (select unnest([1, 2, 3]) as width)
), counts as (select lang, width, phrase, count(*) as f from grams group by all having count(*) >= 10),
split as (select *, string_split(phrase, ' ') as w from counts where width > 1),
cuts as (
  select lang, width, phrase, w, f as a, k, array_to_string(w[:k], ' ') as first_part, array_to_string(w[k + 1:], ' ') as rest
  from (select *, unnest(range(1, width)) as k from split)
), scores as (
  select c.*, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = c.first_part join counts y on y.lang = c.lang and y.phrase = c.rest
), lowest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
around as (
  select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, f from split where width = 3
), kept as (
  select l.* from lowest l where not exists (select 1 from around o where o.lang = l.lang and o.phrase = l.phrase and 100 * o.f >= 50 * l.a)
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000""",
    "op12_chat_formatting": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, unhex(md5(text))) as place,
         replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') as role_out, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as text_out
  from rows
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role_out) + length(text_out) + 24)::bigint as formatted_chars
from placed group by conv_id""",
    "op13_prefix_trie": r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), unhex(md5(coalesce(text, '')))) as place
  from conversations where conv_id is not null
), sizes as (
  select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c : ord(c)::bigint)),
           lambda c, b : list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i : case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h
  from turns group by conv_id
), mixed as (
  select s.conv_id, 0 as part, t.place, t.role, t.text from sizes s join turns t on t.conv_id = s.base and t.place <= s.h
  union all select s.conv_id, 1, t.place, t.role, t.text from sizes s join turns t on t.conv_id = s.conv_id and t.place > s.h
), steps as (
  select conv_id, row_number() over w as depth, length(text) as chars,
         string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by part, place rows between unbounded preceding and current row) as prefix
  from mixed window w as (partition by conv_id order by part, place)
), paths as (
  select conv_id, 0 as depth, 0 as chars, '' as prefix from sizes union all select * from steps
), ends as (select conv_id, max(depth) as depth from paths group by conv_id),
nodes as (
  select p.depth, p.prefix, max(p.chars) as chars, min(p.conv_id) as conv_id, count(*) as n_convs,
         coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (p.depth = e.depth), '') as ids
  from paths p join ends e on e.conv_id = p.conv_id group by p.depth, p.prefix
), kids as (
  select left(prefix, length(prefix) - 32) as prefix, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
), known as (
  select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.prefix = n.prefix and k.depth = n.depth
), sums as (
  select p.prefix, p.depth, sum(case when k.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((k.n_convs - 1) * k.chars)::bigint as saved_tokens
  from known k join paths p on p.conv_id = k.conv_id and p.depth <= k.depth group by p.prefix, p.depth
)
select k.conv_id, k.depth::bigint as depth, up.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ids) as ends_sha256
from known k join sums s on s.prefix = k.prefix and s.depth = k.depth
left join nodes up on up.depth = k.depth - 1 and up.prefix = left(k.prefix, length(k.prefix) - 32)""",
}
