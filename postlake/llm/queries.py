"""The thin queries opN_<name> over the synthetic tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.bpe import encode_documents, token_digests
from postlake.llm.embed_dedup import near_duplicate_vectors
from postlake.llm.exact_dedup import exact_duplicates
from postlake.llm.langid import fit_profiles, identify
from postlake.llm.media import media_features, store_media
from postlake.llm.minhash import near_duplicates
from postlake.llm.mixing import fit_rates
from postlake.llm.prefix_trie import ordered_turns, prefix_trie, with_shared_beginnings
from postlake.llm.quality import quality_scores
from postlake.llm.secret_scan import scan_documents, span_digests
from postlake.llm.spelling import LOWER, UPPER, spelling_groups, word_counts
from postlake.llm.token_counts import count_tokens
from postlake.llm.warc import read_archives, uri_of, write_archives
from postlake.runtime import Scratch, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = uri_of(scratch, "archives")
    index = write_archives(table(spark, sf_dir, "pages"), folder, scratch)
    found = read_archives(index, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Domains of the labelled table, and the weights that they are mixed to.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}
#: The same where junk has been removed before.
CLEANED_TARGETS = {"clean": 0.98, "toxic": 0.02}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and domain of the labelled documents: toxic before junk before clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit_rates(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)
    return found.select("doc_id", "tokens", "domain", F.to_json("posteriors").alias("posteriors"), "rate", "copies")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(scan_documents(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(table(spark, sf_dir, "documents"), digests=True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    profiles = fit_profiles(docs.where(~held_out))
    found = identify(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), spoil=199))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = ordered_turns(table(spark, sf_dir, "conversations"), scratch)
    return prefix_trie(*with_shared_beginnings(turns, scratch), scratch)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_ASSIGN = rf"""(?:{_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "|".join(f"[0-9](?:[ -]?[0-9]){{{n}}}" for n in range(18, 11, -1))
#: With the character that follows, which is cut off again.
_CARD = rf"{_either_case('card')}(?:{_either_case(' number')}|{_either_case(' no')})?[.:]?\x20*(?:{_DIGITS})(?:[^0-9]|$)"


def _crc(of: str) -> str:
    """CRC-32 of a list of bytes, in SQL."""
    step = "xor(c >> 8, list_reduce(range(8)::bigint[], lambda t, i: case when t & 1 = 1 then xor(3988292384::bigint, t >> 1) else t >> 1 end, xor(c & 255, b)))"
    return f"xor(list_reduce(({of})::bigint[], lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


def _hex(value: str) -> str:
    return f"printf('%08x', ({value})::bigint)"


#: The boxes of the media files in SQL, from the format's definition: sizes first, then hexadecimal digits.
_MATRIX = "00010000" + "0" * 24 + "00010000" + "0" * 24 + "40000000"
_ENTRY = "0000005672617720" + "0" * 12 + "0001" + "0" * 32 + "0010000c004800000048000000000000" + "0001" + "0" * 64 + "0008ffff"
_LIST = "array_to_string(list_transform(range(0, {n}), lambda i: printf('%08x', ({value})::bigint)), '')"
_MEDIA = f"""
d as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
n as (select *, octet_length(encode(x)) as nb, greatest(1, (octet_length(encode(x)) + 191) // 192) as f from d),
c as (select *, x || repeat(' ', f * 192 - nb) as payload, (f + 63) // 64 as chunks, (f + 15) // 16 as keys from n),
e as (select *, f - (chunks - 1) * 64 as rest, case when chunks = 1 or f = 64 * chunks then 1 else 2 end as runs from c),
z as (select *, 202 + 4 * keys + 12 * runs + 4 * chunks as stbl, f * 1000 as ticks from e),
o as (select *, 28 + 359 + stbl + 8 as first from z),
m as (select *,
  '0000001c6674797069736f6d0000020069736f6d69736f326d703431' || {_hex("359 + stbl")} || '6d6f6f76'
  || '0000006c6d7668640000000000000000' || '00000000' || '000061a8' || {_hex("ticks")} || '00010000' || '0100' || '{"0" * 20}' || '{_MATRIX}' || '{"0" * 48}' || '00000002'
  || {_hex("243 + stbl")} || '7472616b' || '0000005c746b686400000003' || '{"0" * 16}' || '00000001' || '00000000' || {_hex("ticks")} || '{"0" * 32}' || '{_MATRIX}' || '00100000000c0000'
  || {_hex("143 + stbl")} || '6d646961' || '000000206d64686400000000' || '{"0" * 16}' || '000061a8' || {_hex("ticks")} || '55c40000'
  || '0000002768646c72' || '{"0" * 16}' || '76696465' || '{"0" * 24}' || '6672616d657300'
  || {_hex("64 + stbl")} || '6d696e66' || '00000014766d686400000001' || '{"0" * 16}' || '0000002464696e66' || '0000001c647265660000000000000001' || '0000000c75726c2000000001'
  || {_hex("stbl")} || '7374626c' || '00000066737473640000000000000001' || '{_ENTRY}' || '00000018737474730000000000000001' || {_hex("f")} || '000003e8'
  || {_hex("16 + 4 * keys")} || '7374737300000000' || {_hex("keys")} || {_LIST.format(n="keys", value="1 + 16 * i")}
  || {_hex("16 + 12 * runs")} || '7374736300000000' || {_hex("runs")} || case when chunks > 1 then '000000010000004000000001' else '' end
  || case when chunks = 1 or rest <> 64 then {_hex("chunks")} || {_hex("rest")} || '00000001' else '' end
  || '000000147374737a00000000000000c0' || {_hex("f")} || {_hex("16 + 4 * chunks")} || '7374636f00000000' || {_hex("chunks")} || {_LIST.format(n="chunks", value="first + 12288 * i")}
  || {_hex("8 + 192 * f")} || '6d646174' as head from o)"""

QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_media, op3_embedding_dedup, op4_quality, op5_token_counts, op6_warc, op7_mixing, op8_secrets, op9_bpe, op10_language_id, op11_spelling, op12_prefix_trie, op13_exact_dedup)}
ORACLE_SQL = {
    "op1_minhash_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
links as (
  select x, y from pairs join sizes sx on sx.doc_id = x join sizes sy on sy.doc_id = y
  where 100 * k >= 85 * (sx.n + sy.n - k)),
reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reach r join links l on l.x = r.y),
roots as (select x as doc_id, min(y) as component_id from reach group by x)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join roots using (doc_id)
""",
    "op2_media": f"""
with {_MEDIA},
b as (select *, hex(encode(payload[-16:])) as tail, list_transform(range(0, keys), lambda i: first + 3072 * i) as places from m)
select doc_id, cast(nb as bigint) as n_bytes, cast(192 * f as bigint) as payload_bytes, sha256(payload) as payload_sha256,
  {_crc("list_transform(range(octet_length(encode(payload)) - 15, octet_length(encode(payload)) + 1), lambda i: ('0x' || hex(encode(payload))[2 * i - 1 : 2 * i])::bigint)")} as tail_crc32,
  cast(length(head) // 2 + 192 * f as bigint) as media_bytes, sha256(unhex(head) || encode(payload)) as media_sha256,
  'raw |' || printf('%.3f', f / 25.0::double) || '|' || f || '|' || keys || '|' || printf('%08x', {_crc("flatten(list_transform(places, lambda p: list_concat(list_transform(range(8), lambda i: (p >> (8 * i)::int) & 255), [192, 0, 0, 0, 0, 0, 0, 0])))")}) as feature,
  array_to_string(list_transform(places, lambda p: p || '+192'), ',') as keyframes
from b
""",
    "op8_secrets": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
k as (select * from (values (0, 'assign', '{_ASSIGN.replace("([A-Z", "(?:[A-Z")}'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]{{16,}}'), (3, 'code_token', '(?:gh[pousr]|npm)_[A-Za-z0-9]+'), (4, 'card', '{_CARD}')) as v(k, name, p)),
m as (select r, k, name, regexp_extract_all(text, p) as ms, string_split_regex(text, p) as ps from t, k),
u as (select r, k, name, unnest(ms) as m, unnest(ps[1 : len(ms)]) as before, generate_subscripts(ms, 1) as i from m where len(ms) > 0),
a as (select r, k, name, case when k = 4 then regexp_extract(m, '(?s)^.*[0-9]') else m end as m, cast(sum(length(before) + length(m)) over (partition by r, k order by i) as bigint) - length(m) as a, split_part(m, '_', -1) as tail, reverse(regexp_replace(m, '[^0-9]', '', 'g')) as digits from u),
s as (select *, a + length(m) as b from a where case k when 0 then length(regexp_extract(m, '{_ASSIGN}', 1)) >= 12 when 1 then length(m) >= 18 when 2 then true
  when 3 then length(tail) = 36 and substr(tail, 31) = (select array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda d: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', cast(1 + ({_crc("list_transform(range(1, 31), lambda i: ascii(substr(tail, i::int, 1)))")} // d) % 62 as int), 1)), ''))
  else length(digits) between 13 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then substr(digits, i::int, 1)::int else (2 * substr(digits, i::int, 1)::int) // 10 + (2 * substr(digits, i::int, 1)::int) % 10 end)) % 10 = 0 end),
g as (select r, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
  string_agg(name || ':' || a || ':' || b, ',' order by a, k) filter (where k < 3) as base, string_agg(name || ':' || a || ':' || b, ',' order by a, k) as spans from s group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g using (r)
""",
    "op3_embedding_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (
  select vec_id as x, vec_id as y from embeddings
  union
  select r.x, l.y from reach r join links l on l.x = r.y),
roots as (select x as vec_id, min(y) as component_id from reach group by x),
degree as (select x as vec_id, count(*) as n from links group by x)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join degree using (vec_id) left join roots using (vec_id)
""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p group by h),
s as (select page_id, h, sha1(h) as x, first from p join f using (h))
select page_id, cast(strlen(h) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    ((16 * (strpos('0123456789abcdef', substr(x, 1 + (5 * i) // 4, 1)) - 1) + strpos('0123456789abcdef', substr(x, 2 + (5 * i) // 4, 1)) - 1)
      >> (3 - (5 * i) % 4)) & 31 as integer), 1)), '') as payload_digest,
  case when first < page_id then 'revisit' else 'response' end as record_type, case when first < page_id then first end as refers_to
from s
""",
    "op11_spelling": rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')), '{UPPER}', '{LOWER}') as w from documents),
u as (select w, d || ':' || w as x, count(*) as k from runs group by d, w),
h as (select w, k, {_crc("list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || hex(encode(x))[2 * i - 1 : 2 * i])::bigint)")} as h from u),
s as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, k from h),
v as (select word, cast(sum(k) as bigint) as n from s group by word having sum(k) >= 5 and length(word) >= 6),
c as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
r as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as k from c),
l as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as k from c),
p as (
  select a.word, a.n, b.word as other, b.n as other_n from r a join r b using (k) where a.word <> b.word
  union select l.word, l.n, v.word, v.n from l join v on v.word = l.k
  union select v.word, v.n, l.word, l.n from l join v on v.word = l.k),
b as (select word, any_value(n) as n, count(*) as n_near, arg_min(other, (-other_n, other)) as best, max(other_n) as best_n from p group by word),
f as (select word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * v.n then best end as form, case when best_n >= 5 * v.n then best_n end as form_n from v left join b using (word)),
g as (select word, form, word as root, form as next from f union all select g.word, g.form, f.word, f.form from g join f on f.word = g.next)
select f.word, f.form, g.root, f.n, f.n_near, f.form_n from f join g on g.word = f.word and g.next is null
""",
    "op12_prefix_trie": f"""
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, x) - 1 as pos, x, n
  from (select conv_id, turn, length(coalesce(text, '')) as n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x from conversations where conv_id is not null)),
m as (select c, count(*) as m, {_crc("list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i::int, 1)))")} % 6 as h, c - c % 100 as base from t group by c),
k as (select m.c, m.h, m.m, m.base, least(m.h, coalesce(b.m, 0)) as k from m left join m b on b.c = m.base),
r as (
  select k.c, pos + 1 as d, x, n from k join t on t.c = k.base and pos < h
  union all
  select k.c, pos - h + k + 1, x, n from k join t on t.c = k.c and pos >= h),
p as (select c, d, n, string_agg(x, '') over (partition by c order by d) as p from r union all select c, 0, 0, '' from k),
l as (select c, max(d) as l from p group by c),
nodes as (
  select d, p, any_value(n) as n, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (where d = l), '') as ends
  from p join l using (c) group by d, p),
below as (
  select a.d, a.p, count(*) filter (where b.d = a.d + 1) as n_children, count(*) filter (where not exists (select 1 from nodes x where x.d = b.d + 1 and starts_with(x.p, b.p))) as n_leaves, sum((b.n_convs - 1) * b.n) as saved
  from nodes a join nodes b on starts_with(b.p, a.p) group by a.d, a.p)
select a.conv_id, cast(a.d as bigint) as depth, u.conv_id as parent_conv_id, a.n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(a.ends) as ends_sha256
from nodes a join below using (d, p) left join nodes u on u.d = a.d - 1 and u.p = a.p[1 : 64 * u.d]
""",
    "op13_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""",
}
