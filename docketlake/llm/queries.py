"""The operators applied to whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketlake.llm import (
    decontamination, exact_dedup, language_id, lm_scoring, mixing, near_dedup, quality, sharding, spelling,
    substring_dedup, token_counts, url_filter, vector_codes,
)
from docketlake.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.judged(decontamination.scan_documents(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents")).drop("tag")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, folder, "labels"))).drop("tag")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(table(spark, folder, "documents")).withColumns({
        "weight": F.round("weight", 9), "rate": F.round("rate", 6)})


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, folder, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(books.digest()).alias("codebooks_sha256"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predict_languages(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_substring_dedup, op3_exact_dedup, op4_minhash_near_dedup, op5_token_counts,
    op6_lm_scoring, op7_quality_classifier, op8_sharding, op9_source_mixing, op10_url_filter, op11_vector_codes,
    op12_spelling_variants, op13_language_id,
)}

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
with item as (
    select cast(item_id as varchar) id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    from benchmark where text is not null),
windows as (
    select distinct id, least(len(w), 13) size, unnest(list_transform(
        range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) gram
    from item where len(w) > 0),
doc as (
    select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
starts as (
    select doc_id, size, unnest(range(1, len(w) - size + 2)) pos, w
    from doc, (select distinct size from windows) where len(w) >= size),
found as (
    select doc_id, pos, s.size, id
    from (select doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') gram from starts) s
    join windows using (size, gram)),
hit as (select doc_id, count(distinct word) n_hit from (
    select doc_id, unnest(range(pos, pos + size)) word from (select distinct doc_id, pos, size from found)) group by 1),
items as (
    select doc_id, count(distinct id) n_items, string_agg(distinct id, ',' order by id) ids from found group by 1)
select doc_id, cast(coalesce(len(w), 0) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
    sha256(coalesce(ids, '')) items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""

OP2_SQL = rf"""
with doc as (select doc_id, {WORDS.format("text")} w from documents),
word as (select doc_id, pos, w[pos] word, if(pos + 34 <= len(w), array_to_string(w[pos:pos + 34], ' '), null) gram
    from (select doc_id, w, unnest(range(1, len(w) + 1)) pos from doc)),
marked as (select *, gram is not null and count(*) over (partition by gram) > 1 again from word),
covered as (select *, max(again) over (
    partition by doc_id order by pos rows between 34 preceding and current row) gone from marked),
kept as (select doc_id, count(*) filter (gone) n_removed, string_agg(word, ' ' order by pos) filter (not gone) kept
    from covered group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from doc left join kept using (doc_id)
"""

OP3_SQL = r"""
with doc as (
    select doc_id, length(coalesce(text, '')) points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') content from documents)
select doc_id, first_value(doc_id) over same keep_id, count(*) over (partition by content) group_size,
    doc_id = first_value(doc_id) over same kept, sha256(content) text_sha256
from doc window same as (partition by content order by points desc, doc_id)
"""

OP4_SQL = rf"""
with recursive doc as (select doc_id, {WORDS.format(LOWERED)} w from documents),
shingle as (
    select distinct doc_id, unnest(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) s
    from doc where len(w) > 0),
sized as (select doc_id, count(*) n from shingle group by 1),
link as (
    select a.doc_id a, b.doc_id b from shingle a join shingle b using (s)
    join sized x on x.doc_id = a.doc_id join sized y on y.doc_id = b.doc_id
    where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
    having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(doc_id, other) as (
    select doc_id, doc_id from documents union select doc_id, b from reach join link on other = a)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept
from (select doc_id, min(other) component_id from reach group by 1) left join sized using (doc_id)
"""


# Sweeps written out in SQL: more than raking needs to reach its tolerance on these tables.
SQL_SWEEPS = 40


def mixing_sql() -> str:
    """Raking written out, sweep by sweep."""
    rows = f"""select doc_id, source, lang, cast(len({WORDS.format("text")}) as bigint) n_tokens,
        case when contains(text, ' | ') then 'listing' when contains(text, '!! ') then 'shouting'
            when contains(text, '$$$') or contains(text, '***') then 'symbols'
            when contains(text, 'licensed under') or contains(text, 'All rights reserved') then 'licensed'
            else 'prose' end topic from documents"""
    target = "\n".join(
        f", target_{m} as (select {m}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) over () share from cell group by 1)"
        for m in mixing.MARGINALS)
    weights, sweeps = "cell_0", []
    for n in range(SQL_SWEEPS):
        for m in mixing.MARGINALS:
            name = f"swept_{n}_{m}"
            sweeps.append(f"""{name} as materialized (
    select w.source, w.lang, w.topic, tokens, weight * share / sum(weight) over (partition by w.{m}) weight
    from {weights} w join target_{m} t on w.{m} is not distinct from t.{m})""")
            weights = name
    return f"""
with row_ as ({rows}), cell as (select source, lang, topic, sum(n_tokens) tokens from row_ group by all)
{target}, cell_0 as (select source, lang, topic, tokens, cast(tokens as double) weight from cell where tokens > 0),
{", ".join(sweeps)}, raked as (select * from {weights}),
-- cells in falling order of weight over tokens: the first ones are taken whole, as few as the wanted tokens allow
fill as (select *, weight / tokens ratio, {mixing.SHARE} * sum(tokens) over () wanted,
    coalesce(sum(tokens) over (order by weight / tokens desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) whole,
    sum(weight) over (order by weight / tokens desc, source, lang, topic rows between current row and unbounded following) rest,
    row_number() over (order by weight / tokens desc, source, lang, topic) place from raked),
level as (select arg_min((wanted - whole) / rest, place) filter ((wanted - whole) / rest * ratio <= 1) factor from fill),
rated as (select source, lang, topic, weight, least(1, ratio * factor) rate from fill, level)
select doc_id, row_.source, row_.lang, row_.topic, n_tokens, round(coalesce(weight, 0), 9) weight, round(coalesce(rate, 1), 6) rate,
    cast(('0x' || substr(md5(doc_id || '/0'), 1, 12)) as bigint) / 281474976710656.0 < coalesce(rate, 1) drawn
from row_ left join rated on row_.source is not distinct from rated.source
    and row_.lang is not distinct from rated.lang and row_.topic = rated.topic
"""


OP10_SQL = r"""
with part as (select page_id, url, if(contains(url, '://'), regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') raw,
    if(contains(url, '://'), regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages),
site as (select page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(path, '') path from part),
ruled as (select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end rule,
    case when rule is not null then null
    when regexp_full_match(host, '(.*\.)?spam-farm(\..*)?', 's') then 'host:spam farm'
    when regexp_full_match(host, '(.*\.)?cheap-pills(\..*)?', 's') then 'host:cheap pills'
    when regexp_full_match(host, '(.*[.-])?casino([.-].*)?', 's') then 'host:casino'
    when regexp_full_match(host, '(.*\.)?adult-[^.]*(\..*)?', 's') then 'host:adult' end pattern from site)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow'
    when rule is not null or pattern is not null then 'block' else 'allow' end verdict, pattern
from ruled
"""

def codes_sql() -> str:
    """Rounds of assignment and means written out, over one row for each component."""
    rounds = []
    for r in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""place{r} as materialized (
    select vec_id, part, arg_min(entry, (d, entry)) entry, min(d) d from (
        select vec_id, part, entry, sum((c.v - b.v) * (c.v - b.v)) d from component c join book{r} b using (part, pos) group by all)
    group by all)""")
        if r < vector_codes.ROUNDS:
            rounds.append(f"""book{r + 1} as materialized (
    select part, entry, pos, coalesce(m.v, b.v) v from book{r} b left join (
        select part, entry, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) v
        from component join place{r} using (vec_id, part) group by all) m using (part, entry, pos))""")
    last, parts = vector_codes.ROUNDS, vector_codes.PARTS
    return f"""
with kept as (select vec_id, label, embedding from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
component as materialized (
    select vec_id, (i - 1) // width part, (i - 1) % width pos, cast(floor({vector_codes.SCALE} * cast(embedding[i] as double)) as bigint) v
    from (select vec_id, embedding, len(embedding) // {parts} width, unnest(range(1, len(embedding) + 1)) i from kept)),
book0 as materialized (select part, entry, pos, v from component join (
    select vec_id, row_number() over (order by vec_id) - 1 entry from kept order by vec_id limit {vector_codes.ENTRIES}) using (vec_id)),
{", ".join(rounds)},
coded as (select vec_id, string_agg(lpad(printf('%x', entry), 2, '0'), '' order by part) code, cast(sum(d) as bigint) error
    from place{last} group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
    (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) from book{last}) codebooks_sha256
from coded join kept using (vec_id)
"""


def spelling_sql() -> str:
    """CRC-32 as a fold over bytes; near words meet in what is left of them without one letter."""
    step = "select n, n x from (select unnest(range(256)) n)"
    for _ in range(8):
        step = f"select n, if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1) x from ({step})"
    return f"""
with recursive crc_table as (select list(x order by n) t from ({step})),
run as (select doc_id, run, count(*) n from (
    select doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\u00C0-\u00FF]+')) run from documents where text is not null)
    group by all),
octets as (select *, list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c:
    if(ord(c) < 128, [ord(c)], [192 | (ord(c) >> 6), 128 | (ord(c) & 63)])) b from run),
hashed as (select run, n, xor(4294967295, list_reduce(list_transform(flatten(b), lambda x: cast(x as bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint))) h from octets, crc_table),
word as materialized (select word, cast(sum(n) as bigint) n from (
    select if(h % 97 = 0, substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2), run) word, n from hashed)
    where length(word) >= 5 group by 1 having sum(n) >= 3),
rest as materialized (
    select word, i, substr(word, 1, i - 1) || substr(word, i + 1) left_over
    from (select word, unnest(range(1, length(word) + 1)) i from word)),
near as materialized (
    select a.word, b.word other from rest a join rest b using (i, left_over) where a.word <> b.word
    union select word, left_over from rest where left_over in (select word from word)
    union select left_over, word from rest where left_over in (select word from word)),
best as (select near.word, count(*) n_near, max(n) best_n, arg_min(other, (-n, other)) other
    from near join word on word.word = other group by 1),
judged as materialized (select word, n, coalesce(n_near, 0) n_near, if(best_n >= 2 * n, other, null) form,
    if(best_n >= 2 * n, best_n, null) form_n from word left join best using (word)),
follow(word, root) as (
    select word, word from judged
    union all select follow.word, form from follow join judged on judged.word = root where form is not null)
select word, form, (select arg_max(root, n) from follow join word w on w.word = root where follow.word = judged.word) root,
    n, n_near, form_n from judged
"""


CHECKS = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op9_source_mixing": mixing_sql(),
    "op10_url_filter": OP10_SQL,
    "op11_vector_codes": codes_sql(),
    "op12_spelling_variants": spelling_sql(),
}
