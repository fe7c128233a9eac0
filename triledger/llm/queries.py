"""The operators as queries over a folder of tables, and DuckDB statements for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triledger.llm import bpe, chat, collocations, decontaminate, licences, merkle, mixing, ngram_join, token_edits, toxicity
from triledger.llm.exact_dedup import exact_groups
from triledger.llm.quality import judged
from triledger.llm.tables import plain_reads
from triledger.llm.url_filter import host_and_path, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    plain_reads(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


ORACLE["op1_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


@query
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode(table(spark, folder, "documents"))
    return bpe.decode(ids).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


# Rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list holds the hosts whose md5 begins with 0, about a sixteenth of all; it stands for a published list."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, _ = host_and_path("url")
    listed = pages.select(host.alias("key")).distinct().filter("key <> '' and md5(cast(key as binary)) like '0%'")
    return judge(pages, RULES, listed)


ORACLE["op9_url_filter"] = """
with rest as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
named as (
    select *, case
        when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from parts)
select page_id, host, path, rule, case
    when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when host <> '' and starts_with(md5(host), '0') then 'block' else 'allow' end as verdict
from named
"""


# Topics of the query, by marks in the text.
TOPICS = [("licences", ["icense", "icence"]), ("contacts", ["@"]), ("symbols", ["##", "**", "%%", "||"])]
POWER = 0.9


def topic():
    return mixing.marked_topic("text", TOPICS, "prose")


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), topic(), power=POWER)


def _rounds(n: int) -> tuple[str, str]:
    """The raking of the cells in SQL, margin by margin."""
    steps, last = [], "cells"
    for i in range(n):
        for margin in mixing.MARGINS:
            steps.append(f"""m{i}{margin} as materialized (
                select c.source, c.lang, c.topic, c.tokens, c.w * t.share / sum(c.w) over (partition by c.{margin}) as w
                from {last} c join target_{margin} t on c.{margin} is not distinct from t.{margin})""")
            last = f"m{i}{margin}"
    return ", ".join(steps), last


_STEPS, _LAST = _rounds(30)
ORACLE["op2_mixing"] = f"""
with rows as (
    select doc_id, source, lang, case
        when contains(text, 'icense') or contains(text, 'icence') then 'licences' when contains(text, '@') then 'contacts'
        when contains(text, '##') or contains(text, '**') or contains(text, '%%') or contains(text, '||') then 'symbols'
        else 'prose' end as topic,
        cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as n_tokens
    from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as w from rows group by all),
{', '.join(f'''target_{m} as (select {m}, pow(sum(tokens), {POWER}) / sum(pow(sum(tokens), {POWER})) over () as share
    from cells group by {m})''' for m in mixing.MARGINS)},
{_STEPS},
rates as (select source, lang, topic, (w / tokens) / max(w / tokens) over () as p from {_LAST})
select doc_id, r.source, r.lang, r.topic, n_tokens, round(p, 5) as probability,
       cast(('0x' || substr(md5('mix' || doc_id), 1, 13)) as bigint) / 4503599627370496.0 < p as sampled
from rows r join rates c on r.source is not distinct from c.source and r.lang is not distinct from c.lang and r.topic = c.topic
"""


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(table(spark, folder, "documents"))


@query
def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The notices of every document, with the best coverage and the names in order."""
    found = licences.scanned(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["name"]))), ",").alias("names"),
        F.to_json("notices").alias("notices"))


def _edits():
    """Three edits of each document, by hashes of its id: up to eleven characters out, up to eleven of its own in."""
    size = F.char_length("_text")

    def number(salt, j, n):
        return F.pmod(F.xxhash64(F.lit(salt), j, "doc_id"), n).cast("int")

    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.struct(
        number(1, j, size + 1).cast("long").alias("at"), number(2, j, F.lit(12)).cast("long").alias("removed"),
        F.substring("_text", number(3, j, size + 1) + 1, number(4, j, F.lit(12))).alias("added")))


@query
def op6_token_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    trees = token_edits.grow(table(spark, folder, "documents"))
    after = token_edits.edited(trees, _edits())
    return after.select(
        "doc_id", F.col("n_before").alias("n_tokens"), F.col("n_after").alias("n_tokens_after"),
        F.char_length("_text").cast("long").alias("n_chars_after"), F.col("n_encoded").alias("n_chars_encoded"))


ORACLE["op4_ngram_join"] = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
    select c.a, c.b from common c join sizes x on c.a = x.doc_id join sizes y on c.b = y.doc_id
    where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached as (
    select doc_id, doc_id as r from documents
    union select reached.doc_id, links.b from reached join links on reached.r = links.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r) as component_id
from documents d join reached using (doc_id) left join sizes s using (doc_id) group by d.doc_id, s.n
"""


ORACLE["op7_chat_format"] = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
    select *, length(replace(replace(replace(replace(replace(role || text, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'),
        '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + length('<s>[INST][/INST]</s>') as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
    sum(chars)::bigint as formatted_chars
from escaped group by conv_id
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf():
    """The leaf of a document whose text was lower-cased by someone; null for documents that nobody touched."""
    text = F.translate("text", UPPER, LOWER)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                  merkle.digest(*[text if f == "text" else F.col(f) for f in merkle.FIELDS]))


def verified_manifest(found: DataFrame) -> DataFrame:
    """The manifest with the digest of each witness, and what the leaf at hand folds to."""
    at_hand = F.coalesce(F.lower(F.hex("carried")), "leaf")
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.witness_digest(F.col("witness")).alias("proof_sha256"),
                        merkle.folded(at_hand, F.col("witness")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified_manifest(merkle.manifest(table(spark, folder, "documents"), carried=tampered_leaf()))


def _framed(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_framed(text if f == 'text' else f) for f in merkle.FIELDS)})"


_BIT = "lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
ORACLE["op11_merkle_manifest"] = f"""
with recursive base as (
    select doc_id, coalesce('=' || source, '') as grp, {_leaf('text')} as leaf,
           case when doc_id is not null and xor(4294967295, list_reduce(
                    list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
                    lambda crc, b: list_reduce(range(8), {_BIT}, xor(crc, b)), 4294967295)) % 5 = 0
                then {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as forged
    from documents),
leaves as (
    select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos,
           count(*) over (partition by grp) as n from base),
inner_nodes as (
    select grp, 0 as level, pos, leaf as node, n from leaves
    union all
    select grp, level + 1, pos // 16, sha256(string_agg(node, '' order by pos)), any_value((n + 15) // 16)
    from inner_nodes where n > 1 group by grp, level, pos // 16),
subroots as (select grp, node as subroot, row_number() over (order by grp) - 1 as pos, count(*) over () as n from inner_nodes where n = 1),
outer_nodes as (
    select 0 as level, pos, subroot as node, n from subroots
    union all
    select level + 1, pos // 16, sha256(string_agg(node, '' order by pos)), any_value((n + 15) // 16)
    from outer_nodes where n > 1 group by level, pos // 16),
inner_steps as (
    select a.grp, a.level, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
           coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
    from inner_nodes a join inner_nodes b on a.grp = b.grp and a.level = b.level and a.pos // 16 = b.pos // 16
    where a.n > 1 group by a.grp, a.level, a.pos),
outer_steps as (
    select a.level, a.pos, coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos < a.pos), '') as l,
           coalesce(string_agg(b.node, '' order by b.pos) filter (b.pos > a.pos), '') as r
    from outer_nodes a join outer_nodes b on a.level = b.level and a.pos // 16 = b.pos // 16
    where a.n > 1 group by a.level, a.pos),
steps as (
    select x.grp, x.pos, 0 as part, s.level, s.l, s.r
    from leaves x join inner_steps s on s.grp = x.grp and s.pos = x.pos // cast(pow(16, s.level) as bigint)
    union all
    select x.grp, x.pos, 1, s.level, s.l, s.r
    from leaves x join subroots g on x.grp = g.grp join outer_steps s on s.pos = g.pos // cast(pow(16, s.level) as bigint)),
proofs as (select grp, pos, string_agg(l || r, '' order by part, level) as proof, list(l || ',' || r order by part, level) as steps
    from steps group by grp, pos),
done as (
    select x.doc_id, x.leaf, g.subroot, (select node from outer_nodes where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
        list_reduce(coalesce(steps, []), lambda node, s: sha256(split_part(s, ',', 1) || node || split_part(s, ',', 2)), coalesce(forged, leaf))
            as folded_root
    from leaves x join subroots g on x.grp = g.grp left join proofs p on x.grp = p.grp and x.pos = p.pos)
select *, folded_root = root as verified from done
"""


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


_SPELLED = rf"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op13_decontamination"] = f"""
with items as (select item_id, {_SPELLED} as w from benchmark),
windows as (
    select distinct coalesce(cast(item_id as varchar), '') as item, least(len(w), {decontaminate.WINDOW}) as n,
           array_to_string(w[i:i + {decontaminate.WINDOW - 1}], ' ') as pattern
    from (select item_id, w, unnest(generate_series(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1))) as i from items where len(w) > 0)),
docs as (select doc_id, row_number() over () as row, {_SPELLED} as w from documents),
places as (select row, n, i, array_to_string(w[i:i + n - 1], ' ') as pattern
    from (select row, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, (select distinct n from windows) where len(w) >= n)),
found as (select row, p.n, i, item from places p join windows v on p.n = v.n and p.pattern = v.pattern),
hits as (select row, count(distinct place) as n_hit from (select row, unnest(generate_series(i, i + n - 1)) as place from found) group by row),
named as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row, item from found) group by row)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (row) left join named using (row)
"""


@query
def op12_phrase_collocation(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.top(collocations.scored(table(spark, folder, "documents")))


ORACLE["op12_phrase_collocation"] = rf"""
with pieces as (
    select row_number() over () as id, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
    from (select coalesce(lang, 'und') as lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
words as (select id, lang, unnest(w) as w1, unnest(generate_series(1, len(w))) as pos from pieces),
totals as (select lang, count(*) as n from words group by lang),
following as (
    select lang, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4 from words
    window p as (partition by id order by pos)),
grams as (
    select lang, w1 as phrase from following
    union all select lang, w1 || ' ' || w2 from following where w2 is not null
    union all select lang, w1 || ' ' || w2 || ' ' || w3 from following where w3 is not null
    union all select lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from following where w4 is not null),
counts as materialized (select lang, phrase, count(*) as f from grams group by all),
candidates as (select lang, phrase, string_split(phrase, ' ') as w, f as a from counts where f >= 30 and contains(phrase, ' ')),
split as materialized (
    select lang, w, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
    from (select *, unnest(generate_series(1, len(w) - 1)) as k from candidates)),
parts as materialized (select * from counts where f >= 30),
cuts as (
    select c.lang, c.w, a, k, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score
    from split c join parts l on l.lang = c.lang and l.phrase = c.first join parts r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from cuts qualify row_number() over (partition by lang, w order by score, k) = 1),
inside as (
    select lang, w[i:i + k - 1] as w, max(a) as longer
    from (select lang, w, a, k, unnest(generate_series(1, len(w) - k + 1)) as i from candidates, range(2, 4) s(k) where len(w) > k) group by all),
kept as (
    select b.lang, array_to_string(b.w, ' ') as phrase, a, l, r, n, score
    from best b join totals using (lang) left join inside i on i.lang = b.lang and i.w = b.w where coalesce(100 * longer < 80 * a, true)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
