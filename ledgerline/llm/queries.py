"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import read, ship
from ledgerline.staging import shared_dir

from . import chat, fingerprints, mixing, packing, pii, pitman_yor, quality, sharding, simhash, timestamps, token_counts, variants, warc

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, token_counts.load_pieces(vocabulary("piece_bpe_32k.model"))).select("doc_id", "n_tokens")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.convert_pages(spark, read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(chat.examples(turns))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of these tables lasts in the shared folder: a later run takes it up, and edits it where the shards are no longer near equal."""
    at = f"{shared_dir(spark)}/ledgerline/slot-maps/{hashlib.sha1(sf_dir.encode()).hexdigest()}"
    placed, _ = sharding.assign(read(spark, sf_dir, "documents"), map_path=at)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.take(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(read(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read(spark, sf_dir, "documents"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


# What SQL can say of results that it cannot make: the contract columns it can compute, and each law as a truth.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def fingerprint_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edited text; and whether equal texts have equal fingerprints."""
    prints = op6_fingerprints(spark, sf_dir)
    texts = read(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    per_text = prints.join(texts, "doc_id").groupBy("t").agg(F.count_distinct("fingerprint").alias("n")).groupBy().agg(F.max("n").alias("most"))
    return prints.select("doc_id", "n_chars", "edited_sha256").join(F.broadcast(per_text)).select("doc_id", "n_chars", "edited_sha256", (F.col("most") == 1).alias("equal_texts_agree"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and bytes in all, and whether places are gapless and shards near equal."""
    per = op8_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("top"), F.count_distinct("slot").alias("places"), F.max("size").alias("largest"))
    gapless = F.every((F.col("top") + 1 == F.col("n")) & (F.col("places") == F.col("n")))
    near = F.max("bytes") - F.min("bytes") <= F.greatest(0.02 * F.avg("bytes"), F.max("largest"))
    return per.agg(F.sum("n").alias("n_docs"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_shards"), gapless.alias("gapless"), near.alias("near_equal"))


def mixing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target, and whether what is taken comes within its largest document of it."""
    taken = mixing.take(read(spark, sf_dir, "documents"))
    per = taken.groupBy("source").agg(F.count("*").alias("n"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    near = (F.abs(F.col("taken") - F.col("target")) <= F.col("largest")) & (F.col("over") <= 0)
    return per.select("source", "n", "source_size", (F.col("target") + 1.3e-6).cast("decimal(38,3)").cast("double").alias("target"), near.alias("near"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(read(spark, sf_dir, "documents")))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the language model that counting gives."""
    scores = op13_lm_scores(spark, sf_dir)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found = (op1_token_counts, op2_pii, op3_warc, op4_chat_formatting, op5_packing, op6_fingerprints, op7_simhash, op8_sharding, op9_mixing, op10_quality_rules, op11_timestamps, op12_spelling_variants, op13_lm_scores, pii_base, fingerprint_law, sharding_law, mixing_law, quality_ablations, lm_base)
    return {q.__name__: _shipped(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


#: The ledger in SQL: word runs by regular expression, windows as lists.
_QUALITY = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select *, case when len(ws) < 3 then [] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end as gs
  from w),
m as (
  select doc_id, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, gs
  from g),
x as (select doc_id, unnest(gs) as gram, generate_subscripts(gs, 1) as i from m),
d as (select doc_id, gram from x group by doc_id, gram having count(*) > 1),
p as (select distinct x.doc_id, x.i + o.o as pos from x join d using (doc_id, gram), (select unnest([0, 1, 2]) as o) o),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
b as (
  select m.*, coalesce(r.n_repeat_words, 0) as n_repeat_words from m left join r using (doc_id)),
f as (
  select *,
    (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 15 * n_words then 32 else 0 end)
    + (case when n_words > 100000 then 64 else 0 end) as bits
  from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, (bits & 63) = 0 as kept, cast(bits as bigint) as bits
from f
"""

#: Examples hold whole prefixes, so a conversation's characters count once for each later example.
_CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(text, '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>|<s>|</s>)', '\\\1', 'g') as body from t),
r as (
  select *, case role when 'system' then '<<SYS>> ' || body || ' <</SYS>>' when 'user' then '[INST] ' || body || ' [/INST]'
    when 'assistant' then '<s> ' || body || ' </s>' else '<<ROLE>> ' || hex(role) || ' ' || body || ' <</ROLE>>' end || chr(10) as rendered
  from e),
p as (
  select *, sum(length(rendered)) over w as upto, row_number() over w as n, count(*) over (partition by conv_id) as total
  from r window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, max(total) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
       (sum(upto) filter (where role = 'assistant' or n = total))::bigint as formatted_chars,
       count(*) filter (where role = 'assistant' or n = total) as n_examples
from p group by conv_id
"""

#: SHA-1 in base 32: five hexadecimal digits are four characters.
_WARC = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
d as (
  select page_id, octet_length(encode(h)) as payload_bytes, s,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((cast('0x' || substr(s, 5 * (i // 4) + 1, 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1, 1)), '') as payload_digest
  from p),
f as (select s, min(page_id) as first_id from d group by s)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, '2020-01-01T00:00:00Z' as warc_date
from d join f using (s)
"""

_ABLATIONS = _QUALITY[: _QUALITY.rindex("select doc_id, n_words, word_chars")] + """
select rule, count(*) filter (where (bits & bit) <> 0) as n_fail, count(*) filter (where (bits & 63) = bit) as n_fail_alone, count(*) filter (where (bits & 63 & ~bit) = 0) as n_kept_without
from f, (values ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)) r(rule, bit) group by rule
"""

#: Matches and what stands between them give places; a card's checksum doubles every second digit from the right.
_PII = r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
k as (select * from (values (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) k(n, kind, pattern)),
f as (
  select doc_id, n, kind, regexp_extract_all(t, pattern) as ms, list_transform(string_split_regex(t, pattern), lambda x: len(x)) as gaps from t, k),
m as (
  select doc_id, n, kind, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))) as start from f where len(ms) > 0),
d as (select *, regexp_replace(m, '[^0-9]', '', 'g') as d from m),
v as (
  select * from d where case kind when 'email' then true when 'ip' then list_max(list_transform(string_split(m, '.'), lambda x: cast(x as hugeint))) <= 255
    when 'card' then len(d) between 16 and 19 and list_sum(list_transform(range(1, len(d) + 1), lambda i: case when (len(d) - i) % 2 = 1 then (case when cast(d[i] as integer) > 4 then 2 * cast(d[i] as integer) - 9 else 2 * cast(d[i] as integer) end) else cast(d[i] as integer) end)) % 10 = 0
    else len(d) between 8 and 15 end),
g as (
  select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
         string_agg(kind || ':' || cast(start as bigint) || ':' || cast(start + len(m) as bigint), ',' order by n, start) as listed from v group by 1)
select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(listed, '')) as base_sha256 from t left join g using (doc_id)
"""

_EDITS = """
with t as (select doc_id, coalesce(text, '') as t from documents),
n as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as nt from t)
select doc_id, length(t) as n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2)) as edited_sha256, true as equal_texts_agree from n
"""

_SHARDS = "select count(*) as n_docs, cast(sum(coalesce(octet_length(encode(text)), 0) + 8) as bigint) as bytes, least(24, count(*)) as n_shards, true as gapless, true as near_equal from documents"

#: Sources in the order in which they reach twice their size; the level at which the rest stands.
_MIX = r"""
with s as (select source, count(*) as n, cast(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) as bigint) as size from documents group by 1),
w as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2.0 * size as cap from s),
l as (select *, (1.5 * sum(size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level, row_number() over (order by cap / weight, source nulls last) as k from w),
r as (select min(k) as k from l where level * weight < cap)
select source, n, size as source_size, cast(cast(case when level * weight >= cap or (select k from r) is null then cap else (select level from l, r where l.k = r.k) * weight end + 1.3e-6 as decimal(38,3)) as double) as target, true as near from l
"""

#: The offset a day before and a day after tell whether, and how, a wall time stands at a change.
_STAMPS = r"""
with s as (select stamp_id, source, zone, trim(raw, E' \t\n\x0b\f\r') as t from stamps),
m as (
  select *, '(?:[T\x20]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?' as clock from s),
f as (
  select stamp_id, source, zone, t, case
    when regexp_full_match(t, '20[0-9]{2}-[0-9]{2}-[0-9]{2}' || clock) then [t[1:4], t[6:7], t[9:10], t[11:]]
    when regexp_full_match(t, '20[0-9]{6}' || clock) then [t[1:4], t[5:6], t[7:8], t[9:]]
    when regexp_full_match(t, '[0-9]{2}\.[0-9]{2}\.20[0-9]{2}' || clock) then [t[7:10], t[4:5], t[1:2], t[11:]]
    when regexp_full_match(t, '[0-9]{2}\x20(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\x2020[0-9]{2}' || clock)
      then [t[8:11], cast(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], t[4:6]) as varchar), t[1:2], t[12:]]
    when regexp_full_match(t, '[0-9]{2}/[0-9]{2}/20[0-9]{2}' || clock) then [t[7:10], t[4:5], t[1:2], t[11:]] end as d,
    regexp_full_match(t, '[0-9]{2}/.*') as slash,
    case when regexp_full_match(t, '[0-9]{10}') then cast(t as bigint) * 1000000 when regexp_full_match(t, '[0-9]{13}') then cast(t as bigint) * 1000 end as epoch_us
  from m),
c as (
  select *, cast(nullif(d[4][2:3], '') as int) as h, cast(nullif(d[4][5:6], '') as int) as mi,
    case when d[4][7:7] = ':' then cast(d[4][8:9] as int) else 0 end as sec, regexp_extract(d[4], '([AP]M)', 1) as half, regexp_extract(d[4][5:], '(Z|[+-].*)$', 1) as off
  from f),
k as (
  select *, case when d is null then null when d[4] = '' then 0 when mi > 59 or sec > 59 then null
      when half = '' then case when h <= 23 then h * 3600 + mi * 60 + sec end
      when h between 1 and 12 then (h % 12 + case half when 'PM' then 12 else 0 end) * 3600 + mi * 60 + sec end as clock,
    case when off = 'Z' then 0 when off = '' then null when cast(off[2:3] as int) <= 14 and cast(right(off, 2) as int) <= 59
      then (cast(off[2:3] as int) * 60 + cast(right(off, 2) as int)) * 60 * case when off[1:1] = '-' then -1 else 1 end end as shift
  from c),
p as (
  select *, case when (off = '' or shift is not null) and (shift is not null or zone in (select name from pg_timezone_names()))
      then try_cast(d[1] || '-' || lpad(d[2], 2, '0') || '-' || d[3] as timestamp) + to_seconds(clock) end as dm,
    case when slash and (off = '' or shift is not null) and (shift is not null or zone in (select name from pg_timezone_names()))
      then try_cast(d[1] || '-' || d[3] || '-' || d[2] as timestamp) + to_seconds(clock) end as md
  from k),
v as (
  select source, count(*) filter (where slash and dm is not null and md is null) as dms, count(*) filter (where slash and dm is null and md is not null) as mds from p group by 1),
r as (
  select p.*, dms, mds, coalesce(dm <> md, false) as undecided,
    case when coalesce(dm <> md, false) then case when dms > mds then dm else md end else coalesce(dm, md) end as wall
  from p join v on p.source is not distinct from v.source),
o as (
  select *, case when wall is not null and shift is null then zone end as z, epoch(wall) as w from r),
e as (
  select *, epoch(timezone(z, make_timestamptz(cast((w - 86400) * 1000000 as bigint)))) - (w - 86400) as before,
    epoch(timezone(z, make_timestamptz(cast((w + 86400) * 1000000 as bigint)))) - (w + 86400) as after
  from o),
g as (
  select *, before <> after and (epoch(timezone(z, make_timestamptz(cast((w - before) * 1000000 as bigint)))) - (w - before) = before) as by_before,
    before <> after and (epoch(timezone(z, make_timestamptz(cast((w - after) * 1000000 as bigint)))) - (w - after) = after) as by_after
  from e)
select stamp_id, coalesce(epoch_us, cast((w - coalesce(shift, case when by_after and not by_before then after else before end)) * 1000000 as bigint)) as utc_us,
  case when epoch_us is not null then 'epoch' when wall is null then 'bad' when undecided then case when dms <> mds then 'votes' else 'default' end else 'plain' end as rule,
  undecided or coalesce(before <> after and by_before = by_after, false) as ambiguous
from g
"""

#: crc32 by its table, which a recursion makes; near words by the words with one place left out.
_VARIANTS = r"""
with recursive bits as (select cast(range as bigint) as i, cast(range as bigint) as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
low as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs where length(run) >= 7 group by 1, 2),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_transform(range(0, octet_length(b) * 2, 2), lambda j: cast('0x' || substr(hex(b), j + 1, 2) as bigint)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295)) as h
  from (select *, encode(coalesce(cast(doc_id as varchar), '') || ':' || run) as b from low), crc),
cut as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n from cut where length(word) >= 7 group by 1 having sum(n) >= 2),
holes as (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from w)),
near as (
  select a.word, b.word as other, b.n as m from holes a join holes b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select h.word, w.word, w.n from holes h join w on h.rest = w.word
  union select w.word, h.word, h.n from holes h join w on h.rest = w.word),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by 1),
f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n
  from w left join best using (word)),
walk as (select word, form as at from f where form is not null union all select walk.word, f.form from walk join f on walk.at = f.word where f.form is not null),
root as (select walk.word, walk.at as root from walk join f on walk.at = f.word where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join root using (word)
"""

_LM = r"""
with recursive bits as (select cast(range as bigint) as i, cast(range as bigint) as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
d as (
  select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) as ws,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda ch: cast(ascii(ch) as bigint)),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295)) % 5 = 1 as held_out
  from documents, crc),
x as (select doc_id, held_out, unnest(ws) as w from d),
k as (select w, count(*) as c from x where not held_out group by 1),
n as (select coalesce(sum(c), 0) as total, count(*) as v from k)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(total as bigint) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (total + 0.5 * (v + 1)))), 5) as base_score
from x left join k using (w), n group by doc_id, held_out, total, v
"""

ORACLES: dict[str, str] = {
    "op3_warc": _WARC, "op4_chat_formatting": _CHAT, "op10_quality_rules": _QUALITY, "op11_timestamps": _STAMPS, "op12_spelling_variants": _VARIANTS,
    "pii_base": _PII, "fingerprint_law": _EDITS, "sharding_law": _SHARDS, "mixing_law": _MIX, "quality_ablations": _ABLATIONS, "lm_base": _LM,
}
