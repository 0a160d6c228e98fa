"""The registered queries of this folder, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, html_text, language, neighbours, simhash
from .alignment import align
from .bpe import encode
from .common import crc_bucket, table
from .decontaminate import decontaminate
from .jaccard import jaccard_join
from .license_texts import known
from .licenses import normalised, scan
from .lines import dedup_lines
from .substrings import repeated_passages
from .toxicity import fit, score


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.trained(spark), also=["url"])


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    pivots = neighbours.choose_pivots(rows)
    index = neighbours.build(rows, pivots)
    return neighbours.search(index, pivots, index.where("id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"), "unclassified")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.summary(conversations.repair(rows, lost=F.col("lost"))).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")), digests=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_jaccard_join, op3_line_dedup, op4_toxicity, op5_decontamination, op6_substring_dedup, op7_bpe, op8_html_text, op9_nearest_neighbours, op10_license_scan, op11_conversation_repair, op12_cross_tokenizer, op13_simhash)
    return {f.__name__: f for f in found}


_OP3 = r"""
with d as (select doc_id, text from documents where text is not null),
s as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
m as (select doc_id, text, pos, regexp_replace(regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g') as masked from s),
w as (select *, case when masked = '' then [] else regexp_split_to_array(masked, '[ \t\x0B\f\r]+') end as words from m),
l as (select *, len(words) as n, len(words) > 0 and 2 * len(list_filter(words, lambda w: w <> '<*>')) >= len(words) as fixed, concat(len(words), ' ', array_to_string(words[:3], ' ')) as leaf from w),
f as (select leaf from l where fixed group by leaf having count(*) >= 10),
x as (select leaf, masked, n, count(*) as c from l join f using (leaf) where fixed group by all),
t as (select leaf, masked, n, c, unnest(regexp_split_to_array(masked, '[ \t\x0B\f\r]+')) as word, unnest(range(n)) as j from x),
q as (select leaf, j, word, sum(c) as c from t group by all),
k as (select leaf, j, arg_min(word, {'c': -c, 'word': word}) as word, max(c) as c, sum(c) as total from q group by all having 2 * max(c) > sum(c)),
a as (select leaf, masked from t join k using (leaf, j, word) group by leaf, masked, n having count(*) * 4 >= n * 3),
y as (select t.* from t left join a on a.leaf = t.leaf and a.masked = t.masked where a.leaf is null),
z as (select leaf, j, word from y group by all having sum(c) >= 10),
g as (select leaf, masked, string_agg(concat(j, '=', word), ' ' order by j) as same from y join z using (leaf, j, word) group by leaf, masked, n having count(*) * 4 >= n * 3),
u as (select x.masked, case when a.leaf is not null then concat('leaf ', x.leaf) when g.leaf is not null then concat('group ', x.leaf, ': ', g.same) else concat('line ', x.masked) end as template
  from x left join a on a.leaf = x.leaf and a.masked = x.masked left join g on g.leaf = x.leaf and g.masked = x.masked),
p as (select distinct doc_id, text, pos, masked, n, fixed from l),
o as (select template from p join u using (masked) where fixed group by template having count(distinct {'d': doc_id, 't': text}) >= 10),
h as (select masked, template from u semi join o using (template)),
r as (select doc_id, text, sum(n) as words, sum(n) filter (template is null) as rest_words, string_agg(p.masked, chr(10) order by pos) filter (template is null) as rest,
  list(distinct template) filter (template is not null) as templates from p left join h using (masked) where n > 0 group by doc_id, text having sum(n) filter (template is null) * 7 > sum(n)),
e as (select template from (select distinct rest, unnest(templates) as template from r) group by template having count(*) >= 10),
v as (select distinct masked from h semi join e using (template)),
b as (select doc_id, text, count(*) filter (n > 0) as n_lines, count(*) filter (n > 0 and v.masked is not null) as n_dropped,
  coalesce(string_agg(line, chr(10) order by pos) filter (not (n > 0 and v.masked is not null)), '') as kept
  from p join (select distinct doc_id, text, pos, line from s) s using (doc_id, text, pos) left join v using (masked) group by doc_id, text)
select documents.doc_id, case when n_dropped > 0 then kept else documents.text end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped
from documents left join b on b.doc_id = documents.doc_id and b.text = documents.text
"""

_OP5 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
k as (select item_id, w, least(10, len(w)) as m from i where len(w) > 0),
p as (select distinct m, array_to_string(w[s : s + m - 1], ' ') as t, item_id from (select *, unnest(generate_series(1, len(w) - m + 1)) as s from k)),
g as (select r, s, m, array_to_string(w[s : s + m - 1], ' ') as t from (select r, w, m, unnest(generate_series(1, len(w) - m + 1)) as s from d, (select distinct m from k) where len(w) >= m)),
h as (select g.r, g.s, g.m, p.item_id from g join p using (m, t)),
n as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(s, s + m - 1)) as at from h) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join t using (r)
"""


_OP10 = r"""
with s as (select * from (values $sentences) as t(sentence, name)),
r as (select * from (values $rules) as t(rule, license, run)),
d as (select distinct doc_id, text from documents where text is not null),
c as (select doc_id, text, string_split(regexp_replace(text, '([.!?;:])[ \t\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)) as parts from d),
l as (select doc_id, text, unnest(parts) as part, generate_subscripts(parts, 1) as pos from c),
n as (select doc_id, text, pos, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as sentence from l),
f as (select doc_id, text, pos, name from n join s using (sentence)),
m as (select f.doc_id, f.text, r.rule, r.license, f.pos as first, f.pos + len(run) - 1 as last, len(run) as size from f join r on r.run[1] = f.name
  join f g on g.doc_id is not distinct from f.doc_id and g.text = f.text and g.pos between f.pos and f.pos + len(run) - 1 and g.name = r.run[g.pos - f.pos + 1]
  group by all having count(*) = len(run)),
k as (select m.* from m where not exists (select 1 from m u where u.doc_id is not distinct from m.doc_id and u.text = m.text and u.rule < m.rule and u.first <= m.last and m.first <= u.last)),
a as (select doc_id, text, count(*) as n_sentences, string_agg(name, ',' order by pos) as sentence_ids,
  count(*) filter (not exists (select 1 from k where k.doc_id is not distinct from f.doc_id and k.text = f.text and f.pos between k.first and k.last)) as unclassified from f group by doc_id, text),
b as (select doc_id, text, string_agg(distinct license, ',' order by license) as licenses from k group by doc_id, text)
select documents.doc_id, coalesce(n_sentences, 0) as n_sentences, coalesce(sentence_ids, '') as sentence_ids, coalesce(licenses, '') as licenses, coalesce(unclassified, 0) as unclassified
from documents left join a on a.doc_id is not distinct from documents.doc_id and a.text = documents.text
  left join b on b.doc_id is not distinct from documents.doc_id and b.text = documents.text
"""


def _op10() -> str:
    sentences, rules = known()
    rows = ", ".join(f"('{normalised(t)}', '{name}')" for name, t in sentences.items())
    runs = ", ".join(f"({i}, '{license}', {run})" for i, (license, run) in enumerate(rules))
    return _OP10.replace("$sentences", rows).replace("$rules", runs)


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3, "op5_decontamination": _OP5, "op10_license_scan": _op10()}
