"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import chatformat, convtrie, decontam, fim, langid, licensescan, linededup, packing, qualityclf, qualityrules, sharding, simhash, toxicity
from noticelake.llm.common import LOWER, UPPER, table


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op2_decontamination"] = f"""
with b as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
 bw as (select distinct item, len(s) n, array_to_string(s, ' ') phrase from (
   select item, w[i:i + least(13, len(w)) - 1] s from (select item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) i from b where len(w) > 0))),
 d as (select row_number() over () uid, doc_id, {_WORDS} w from documents),
 p as (select uid, n, i, array_to_string(w[i:i + n - 1], ' ') phrase from (
   select uid, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, (select distinct n from bw) where len(w) >= n)),
 m as (select uid, i, p.n, item from p join bw on p.phrase = bw.phrase and p.n = bw.n),
 h as (select uid, count(distinct k) n_hit from (select uid, unnest(generate_series(i, i + n - 1)) k from m) group by uid),
 t as (select uid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct uid, item from m) group by uid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
 sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (uid) left join t using (uid)
"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id as string)) % 5 = 0"
    found, _ = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=f"not ({held_out})")
    return found.select("doc_id", F.expr(held_out).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


#: Fixed by the contract: a conversation whose texts are control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    path = tokenizer("byte_bpe_50k.tiktoken")
    return chatformat.digests(chatformat.format_chats(rows, path), path)


_ESCAPES = r"len(regexp_extract_all({}, '[<\[]\\*/?(?:s>|INST\])'))"
ORACLE_SQL["op5_chat_format"] = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
 cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
 sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
 cast(3 + sum(17 + length(r) + length(t) + {_ESCAPES.format('r')} + {_ESCAPES.format('t')}) as bigint) formatted_chars
from c group by conv_id
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)
    return found.withColumnRenamed("id", "doc_id")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL["op7_line_dedup"] = f"""
with l as (select doc_id, line, n, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') k
  from (select doc_id, unnest(s) line, generate_subscripts(s, 1) n from (select doc_id, string_split(coalesce(text, ''), chr(10)) s from documents))),
 c as (select k, max(doc_id) last from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) n_lines, count(*) filter (last is not null and doc_id <> last) n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by n) filter (last is null or doc_id = last), '')) kept_sha256
from l left join c using (k) group by doc_id
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = qualityrules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id as string)) % 4 = 2"
    found, _ = qualityclf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=f"not ({held_out})")
    return found.select("doc_id", F.expr(held_out).alias("held_out"), "score", F.expr("cast(score >= 0.7 as int)").alias("predicted"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_SPLIT = r"list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_TEXTS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licensescan.templates()))
ORACLE_SQL["op10_license_scan"] = f"""
with t as (select template, license, w, len(w) - 1 size, greatest(1, ceil(0.8 / 1.2 * (len(w) - 1) - 1e-9)) least, floor(1.5 * (len(w) - 1) + 1e-9) most, least(len(w) - 1, greatest(2, ceil((len(w) - 1) / 16))) agreed from (select template, license, {_SPLIT.format("x")} w from (values {_TEXTS}) v(template, license, x))),
 d as (select row_number() over () uid, doc_id, w from (select doc_id, {_SPLIT.format("coalesce(text, '')")} w from documents)),
 tb as (select template, g, min(i) place, count(*) times from (select template, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) g, unnest(generate_series(0, len(w) - 2)) i from t) group by all),
 db as (select uid, len(w) - 1 n, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) g, unnest(generate_series(0, len(w) - 2)) i from d where len(w) > 1),
 h as (select uid, n, i, g from db where g in (select g from tb)),
 v as (select uid, n, template, i - place o, count(*) votes from h join tb using (g) group by all),
 p as (select uid, n, template, license, size, least, most, o from v join t using (template) where votes >= agreed),
 s as (select distinct uid, p.template, license, size, greatest(0, p.o) a, least(n, q.o + size) z, least, most from p join (select uid, template, o from p) q using (uid, template)),
 m as (select uid, template, license, size, a, z, g, count(*) found from s join h using (uid) where z - a between least and most and i >= a and i < z group by all),
 r as (select uid, template, license, a, z, 2 * sum(least(found, times)) / (z - a + size) dice from m join tb using (template, g) group by uid, template, license, size, a, z having 2 * sum(least(found, times)) / (z - a + size) >= 0.8)
select doc_id, cast(a as int) as start, cast(z - a as int) as length, cast(template as int) template, license, dice
from r join d using (uid) where not exists (select 1 from r b where b.uid = r.uid and b.template = r.template and b.a < r.z and r.a < b.z and (b.dice > r.dice or (b.dice = r.dice and (b.a < r.a or (b.a = r.a and b.z < r.z)))))
"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.rearranged(table(spark, sf_dir, "documents"))
    again = fim.restored("output", "form")
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


_DRAW = "cast('0x' || substr(h, {}, 8) as bigint)"
ORACLE_SQL["op11_fill_in_middle"] = f"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
 u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u from d),
 c as (select *, len(u) n, {_DRAW.format(1)} % (len(u) + 1) c1, {_DRAW.format(9)} % (len(u) + 1) c2, {_DRAW.format(17)} % 100 h3, {_DRAW.format(25)} % 100 h4 from u),
 f as (select doc_id, t, n, array_to_string(u[1:least(c1, c2)], '') p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') m, array_to_string(u[greatest(c1, c2) + 1:], '') s,
   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 100 then 'plain' when h4 < 50 then 'spm' else 'psm' end form from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from f
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(doc_id as string)) % 4 = 2"
    found, _ = langid.identify(table(spark, sf_dir, "documents"), may_learn=f"not ({held_out})")
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.expr(held_out).alias("held_out"), "lang_pred", "score", "accepted", "bits")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(table(spark, sf_dir, "conversations"))


_CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast({} as varchar), ''), lambda s: cast(ascii(s) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], cast(range(8) as bigint[])), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
ORACLE_SQL["op13_prefix_trie"] = f"""
with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i from conversations where conv_id is not null),
 k as (select c, c - c % 20 base, {_CRC32.format("c")} % 4 h from (select distinct c from t)),
 l as (select k.c, count(t.c) lb from k left join t on t.c = k.base and t.i <= k.h group by k.c),
 s as (select k.c, t.i d, r, x from k join t on t.c = k.base and t.i <= k.h union all select k.c, t.i - k.h + lb, r, x from k join l using (c) join t on t.c = k.c and t.i > k.h),
 q as (select k.c, coalesce(list(md5(r) || md5(x) order by d) filter (d is not null), []) p from k left join s using (c) group by k.c),
 m as (select c, len(p) n, d, array_to_string(p[1:d], '') key from (select *, unnest(generate_series(0, len(p))) d from q)),
 g as (select d, key, min(c) conv_id, count(*) n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '') ends from m group by d, key),
 w as (select g.*, case when g.d = 0 then 0 else len(regexp_extract_all(s.x, '[^\x20\x09-\x0D]+')) end words from g left join s on s.c = conv_id and s.d = g.d),
 ch as (select left(key, 64 * (d - 1)) key, d - 1 d, count(*) n_children from g where d > 0 group by all),
 v as (select w.*, coalesce(n_children, 0) n_children, (n_convs - 1) * words saved from w left join ch using (d, key)),
 up as (select left(key, 64 * a) key, a d, count(*) filter (n_children = 0) n_leaves, sum(saved) saved_tokens from (select *, unnest(generate_series(0, d)) a from v) group by all)
select v.conv_id, cast(v.d as bigint) as depth, g.conv_id parent_conv_id, v.n_convs, v.n_children, n_leaves, cast(saved_tokens as bigint) saved_tokens, sha256(v.ends) ends_sha256
from v join up using (d, key) left join g on g.d = v.d - 1 and g.key = left(v.key, 64 * (v.d - 1))
"""
