"""Queries on documents: text, keys, gates, voices, routing, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clips, gates, lookups, routing, voices
from ..sources import keyed, manifests, plans, scan
from ..sources.shared import shared_dir
from ..sources.tables import new_place, written
from .registry import query, table

LATIN_SQL = T.LATIN_WORD.replace("'", "''")
ANCHOR, PRIMARY = routing.ANCHOR, routing.PRIMARY

#: White space that a strip takes off, and the cleaning rule, in SQL.
STRIP_SQL = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(nfc_normalize({}), '[^\P{{C}}\n]', '', 'g'), '[ ]+', ' ', 'g'), ' ' || chr(10))"
#: Documents in the place of clips: French and Spanish stand for the target language, German for Hindi; see the README.
CANDIDATES_SQL = f"""
stripped as (select * replace ({STRIP_SQL.format("text")} as text) from documents),
normalized as (select *, {CLEAN_SQL.format("text")} as text_normalized from stripped where text <> ''),
candidates as (
  select doc_id, text, text_normalized,
    case lang when 'en' then 'en' when 'de' then 'hi' else 'mr' end as language_id,
    case when lang in ('en', 'de') then source when doc_id % 2 = 0 then '{ANCHOR}' else '{PRIMARY}' end as source_hf_path,
    case when doc_id % 4 < 2 then 'Anagha' else 'Chinmay' end as speaker,
    case doc_id % 5 when 0 then ' wiki ' when 1 then 'PROPER NOUN' when 2 then 'UMANG' when 3 then null else 'INDIC' end as rasa_style,
    len(regexp_extract_all(text_normalized, '{T.DIGIT}')) as num_digits,
    len(regexp_extract_all(text_normalized, '{LATIN_SQL}')) % 3 as num_english_words,
    n_chars / 12.0 as duration_s,
    substr(sha256(source || '::' || doc_id), 1, 16) as clip_key
  from normalized where text_normalized <> ''),
routed as (
  select *, case
    when language_id = 'mr' and (num_digits > 0 or coalesce(upper(trim(rasa_style)) in ('NAMES', 'PROPER NOUN', 'PROPER_NOUN'), false)) then 'marathi_adversarial'
    when language_id = 'mr' and num_english_words > 0 and num_digits = 0 then 'marathi_code_switch'
    when source_hf_path = '{ANCHOR}' and language_id = 'mr' and coalesce(upper(trim(rasa_style)) in ('WIKI', 'INDIC'), false) then 'marathi_stem_seen_voice'
    when source_hf_path = '{ANCHOR}' and language_id = 'mr' then 'retention_rasa_marathi'
    when source_hf_path = '{PRIMARY}' then 'marathi_general_unseen_domain'
    when language_id = 'hi' then 'retention_hindi'
    when language_id = 'en' then 'retention_english' end as bucket
  from candidates),
sizes(bucket, k) as (values ('marathi_adversarial', 40), ('marathi_code_switch', 30), ('marathi_stem_seen_voice', 40),
  ('retention_rasa_marathi', 30), ('marathi_general_unseen_domain', 40), ('retention_hindi', 40), ('retention_english', 30)),
ranked as (
  select *, row_number() over (partition by bucket order by sha256('1234:' || clip_key), clip_key) - 1 as pos
  from routed where bucket is not null),
chosen as (select ranked.*, format('{{}}_{{:03d}}', bucket, pos) as id from ranked join sizes using (bucket) where pos < k)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("seconds", F.col("n_chars") / 12.0)
    target = ~F.col("lang").isin("en", "de")
    styles = {0: " wiki ", 1: "PROPER NOUN", 2: "UMANG", 4: "INDIC"}
    style: Column = F.lit(None).cast("string")
    for k, v in styles.items():
        style = F.when(F.col("doc_id") % 5 == k, F.lit(v)).otherwise(style)
    source = F.when(~target, F.col("source")).when(F.col("doc_id") % 2 == 0, F.lit(ANCHOR)).otherwise(F.lit(PRIMARY))
    language = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "hi").otherwise("mr")
    key = T.clip_key(F.col("source"), F.lit(None).cast("string"), F.col("doc_id"))
    speaker = F.when(F.col("doc_id") % 4 < 2, F.lit("Anagha")).otherwise(F.lit("Chinmay"))
    rows = clips.candidates(docs, source, language, key, speaker, duration="seconds")
    columns = ("doc_id", "text", "text_normalized", "language_id", "source_hf_path", "speaker", "num_digits", "duration_s", "clip_key")
    # taken modulo 3, as nearly every text here has Latin words
    return rows.select(*columns, style.alias("rasa_style"), (F.col("num_english_words") % 3).alias("num_english_words")).withColumn("bucket", routing.routed())


def chosen(spark: SparkSession, folder: str) -> DataFrame:
    return routing.chosen(candidates(spark, folder))


def routed_once(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """What a query that reads the candidates twice needs of them, cleaned and routed in one pass; texts aren't kept."""
    return written(candidates(spark, folder).select("doc_id", "clip_key", "bucket", "speaker", "source_hf_path", "num_digits", *more), "routed")


@query(f"with {CANDIDATES_SQL}, names as (select bucket from sizes union all select 'marathi_longform') select names.bucket, count(chosen.bucket) as n from names left join chosen using (bucket) group by 1")
def route_documents_summary(spark, folder):
    return routing.summary(chosen(spark, folder))


@query(f"with {CANDIDATES_SQL} select id, bucket, clip_key, doc_id, pos from chosen")
def route_topk_items(spark, folder):
    return chosen(spark, folder).select("id", "bucket", "clip_key", "doc_id", "pos")


@query(f"with {CANDIDATES_SQL} select bucket, count(*) as candidates from routed group by 1")
def route_all_candidates(spark, folder):
    return candidates(spark, folder).groupBy("bucket").agg(F.count("*").alias("candidates"))


@query(f"with {CANDIDATES_SQL} select distinct clip_key from chosen")
def held_out_keys(spark, folder):
    return routing.held_out_keys(chosen(spark, folder))


@query(f"with {CANDIDATES_SQL} select source_hf_path, count(*) as n, sum(num_digits) as digits from routed anti join chosen using (clip_key) group by 1")
def heldout_anti_join(spark, folder):
    rows = routed_once(spark, folder)
    left = lookups.without_held_out(rows, routing.chosen(rows))
    return left.groupBy("source_hf_path").agg(F.count("*").alias("n"), F.sum("num_digits").alias("digits"))


@query(f"with {CANDIDATES_SQL} select doc_id, clip_key, sha256(text) as text_sha256 from routed semi join chosen using (clip_key)")
def needed_semi_join(spark, folder):
    rows = routed_once(spark, folder, F.sha2("text", 256).alias("text_sha256"))
    return lookups.needed_only(rows, routing.chosen(rows), ["clip_key"]).select("doc_id", "clip_key", "text_sha256")


@query(f"with {CANDIDATES_SQL} select c.id, d.doc_id is not null as found, d.n_chars from (select id, case when pos % 3 = 0 then null else clip_key end as clip_key from chosen) c left join (select substr(sha256(source || '::' || doc_id), 1, 16) as clip_key, doc_id, n_chars from documents) d on c.clip_key = d.clip_key")
def reference_lookup(spark, folder):
    """Lookup in a table that is written for it: the needed keys reach the scan, which skips row groups."""
    items = chosen(spark, folder).select("id", F.when(F.col("pos") % 3 != 0, F.col("clip_key")).alias("clip_key"))
    docs = table(spark, folder, "documents")
    path = new_place(spark, "reference")
    keyed.write_keyed(docs.select(T.clip_key(F.col("source"), F.lit(None).cast("string"), F.col("doc_id")).alias("clip_key"), "n_chars"), "clip_key", path, row_group_bytes=64 << 10, page_bytes=8 << 10)
    items = written(items, "wanted")
    clips = keyed.lookup(spark, path, items, "clip_key", ["n_chars"])
    return lookups.with_reference(items, clips, ["clip_key"], "n_chars").select("id", F.col("n_chars").isNotNull().alias("found"), "n_chars")


@query(f"with {CANDIDATES_SQL} select count(*) as shared_keys from (select clip_key from chosen group by 1 having count(distinct bucket) > 1)")
def disjointness_check(spark, folder):
    return routing.overlaps(chosen(spark, folder)).agg(F.count("*").alias("shared_keys"))


RELOCK = "retention_rasa_marathi"


@query(f"""
with {CANDIDATES_SQL},
first as (select *, row_number() over (partition by bucket order by sha256('1234:' || clip_key), clip_key) - 1 as pos from routed where bucket is not null and not (speaker = 'Anagha' and bucket = '{RELOCK}')),
locked as (select clip_key, bucket, format('{{}}_{{:03d}}', bucket, pos) as id from first join sizes using (bucket) where pos < k),
pool as (select clip_key, bucket, row_number() over (order by sha256('17:' || clip_key), clip_key) - 1 as pos from routed where speaker = 'Anagha' and bucket = '{RELOCK}'),
added as (select clip_key, bucket, format('{RELOCK}_{{:03d}}', pos + (select count(*) from locked where bucket = '{RELOCK}')) as id from pool where pos < 30)
select bucket, id, clip_key from (select * from locked union all select * from added anti join locked using (clip_key))""")
def relock_amend(spark, folder):
    """A table locked without one speaker's items gets at most 30 of them, numbered on; amending again changes nothing."""
    rows = routed_once(spark, folder)
    mine = (F.col("speaker") == "Anagha") & (F.col("bucket") == RELOCK)
    locked = routing.chosen(rows.filter(~F.coalesce(mine, F.lit(False)))).select("clip_key", "bucket", "id")
    start = locked.filter(F.col("bucket") == RELOCK).count()
    added = routing.chosen(rows.filter(mine), {RELOCK: 30}, seed=17).filter(F.col("pos") < 30)
    added = added.select("clip_key", "bucket", F.format_string(f"{RELOCK}_%03d", F.col("pos") + start).alias("id"))
    return lookups.amended(lookups.amended(locked, added), added).select("bucket", "id", "clip_key")


@query(f"with {CANDIDATES_SQL} select clip_key from (select substr(sha256(source || '::' || doc_id), 1, 16) as clip_key from documents union select clip_key from chosen union select substr(sha256('conversations::' || conv_id || '-' || turn), 1, 16) from conversations)")
def key_union(spark, folder):
    docs = table(spark, folder, "documents").select(T.clip_key(F.col("source"), F.lit(""), F.col("doc_id")).alias("clip_key"))
    turns = table(spark, folder, "conversations").select(T.clip_key(F.lit("conversations"), F.format_string("%d-%d", "conv_id", "turn"), F.lit(0)).alias("clip_key"))
    return lookups.key_union(docs, chosen(spark, folder), turns)


@query("""
select reason, count(*) as n, sum(n_chars) as chars from (
  select n_chars, case
    when doc_id % 11 = 0 or doc_id % 13 = 0 then 'license_unknown'
    when not (n_chars / 12.0 >= 30.0 and n_chars / 12.0 <= 600.0) then 'duration_out_of_[30.0,600.0]'
    when trim(text) = '' then 'empty_normalized_text' end as reason
  from documents) group by 1""")  # fmt: skip
def gate_first_reject(spark, folder):
    license = F.when(F.col("doc_id") % 11 == 0, F.lit("Unknown")).when(F.col("doc_id") % 13 != 0, F.lit("CC-BY-4.0"))
    reason = gates.hard_reject(license, F.col("n_chars") / 12.0, F.col("text"), gates.Gates(30.0, 600.0))
    return table(spark, folder, "documents").select(reason.alias("reason"), "n_chars").groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
select doc_id, concat_ws(',', case when n_chars / 100.0 < 15.0 then 'snr<15.0' end, case when (1 - quality) * 0.02 > 0.01 then 'clip>0.01' end, case when toxic = 1 then 'narrowband' end) as soft_flags
from documents left join labels using (doc_id)""")  # fmt: skip
def gate_soft_flags(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    flags = gates.soft_flags(F.col("n_chars") / 100.0, (1 - F.col("quality")) * 0.02, F.col("toxic") != 1)
    return rows.select("doc_id", F.array_join(flags, ",").alias("soft_flags"))


@query("""
select lang, count(*) filter (where n_chars / 12.0 between 30 and 600) as kept, count(*) filter (where not n_chars / 12.0 between 30 and 600) as dropped
from documents group by 1""")  # fmt: skip
def kept_dropped_by_source(spark, folder):
    reject = gates.hard_reject(F.lit("CC0"), F.col("n_chars") / 12.0, F.col("text"), gates.Gates(30.0, 600.0))
    rows = table(spark, folder, "documents").select("lang", gates.gated(reject, F.array().cast("array<string>")).alias("gate"))
    return rows.groupBy("lang").agg(F.count_if("gate.kept").alias("kept"), F.count_if(~F.col("gate.kept")).alias("dropped"))


@query("""
select problem, count(*) as n from (select case
    when n_chars / 12.0 - 5 <= 0 then 'duration'
    when not (doc_id % 9) * 0.15 between 0 and 1 then 'clipping_ratio'
    when lang = 'en' and doc_id % 4 = 0 then 'script_language'
    when doc_id % 7 = 5 then 'span'
    when doc_id % 10 = 3 then 'unknown_speaker'
    when doc_id % 10 = 4 then 'gender_mismatch' end as problem
  from documents) group by 1""")  # fmt: skip
def clip_validation(spark, folder):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")), F.struct((F.col("doc_id") % 2 - 1).cast("int").alias("start"), F.lit(-1).alias("end")))
    spans = F.when(F.col("doc_id") % 7 == 5, spans).otherwise(F.slice(spans, 1, 1))
    script = F.when(F.col("doc_id") % 4 == 0, F.lit("Deva")).otherwise(F.lit("Latn"))
    speaker = F.when(F.col("doc_id") % 10 == 3, F.lit("Nobody")).otherwise(F.lit("Anagha"))
    gender = F.when(F.col("doc_id") % 10 == 4, F.lit("M"))
    problem = gates.clip_problem(F.lit(24000), F.col("n_chars") / 12.0 - 5, (F.col("doc_id") % 9) * 0.15, F.col("lang"), script, spans, F.col("text"), speaker, gender)
    return table(spark, folder, "documents").select(problem.alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("select doc_id, substr(sha256(source || '::' || doc_id), 1, 16) as clip_key, substr(sha256(text), 1, 16) as transcript_hash from documents")
def clip_key_sha16(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.clip_key(F.col("source"), F.lit(""), F.col("doc_id")).alias("clip_key"), T.sha16(F.col("text")).alias("transcript_hash"))


@query(f"select doc_id, len(regexp_extract_all(text, '{LATIN_SQL}')) as num_english_words from documents")
def latin_word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.latin_word_count(F.col("text")).alias("num_english_words"))


@query(f"""
with parts as (
  select doc_id, unnest(regexp_extract_all(text, '{LATIN_SQL}')) as word, unnest(regexp_split_to_array(text, '{LATIN_SQL}')) as gap, generate_subscripts(regexp_split_to_array(text, '{LATIN_SQL}'), 1) as nth from documents),
ends as (select doc_id, nth, word, sum(length(gap) + coalesce(length(word), 0)) over (partition by doc_id order by nth) as stop from parts)
select doc_id, count(*) as spans, sum(stop - length(word)) as starts, sum(stop) as ends, max(length(word)) as longest from ends where word is not null group by 1""")
def latin_spans_by_document(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.inline(T.latin_spans(F.col("text"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.max(F.length("text")).alias("longest"))


@query(f"select doc_id, len(regexp_extract_all(text, '{T.DIGIT}')) as num_digits from documents")
def digit_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.digit_count(F.col("text")).alias("num_digits"))


@query(f"select case when regexp_matches(text, '{T.DEVANAGARI}') then 'Deva' else 'Latn' end as script, lang, count(*) as n from (select text, lang from documents union all select 'मी १० वाजता', 'mr') group by 1, 2")
def script_tag(spark, folder):
    docs = table(spark, folder, "documents").select("text", "lang").union(spark.sql("select 'मी १० वाजता', 'mr'"))
    return docs.select(T.script_tag(F.col("text")).alias("script"), "lang").groupBy("script", "lang").agg(F.count("*").alias("n"))


@query(r"""
with raw as (select doc_id, text from documents union all select -1, '  a' || chr(9) || 'b   cafe' || chr(769) || '  ' union all select -2, 'x' || chr(8205) || 'y  9')
select doc_id, sha256(clean) as normalized_sha256, length(clean) as normalized_chars
from (select doc_id, """ + CLEAN_SQL.format("text") + " as clean from raw)")
def normalized_text(spark, folder):
    odd = spark.sql("select -1L, concat('  a', char(9), 'b   cafe', decode(unhex('CC81'), 'utf-8'), '  ') union all select -2L, concat('x', decode(unhex('E2808D'), 'utf-8'), 'y  9')")
    rows = table(spark, folder, "documents").select("doc_id", "text").union(odd).select("doc_id", T.cleaned("text").alias("clean"))
    return rows.select("doc_id", F.sha2("clean", 256).alias("normalized_sha256"), F.length("clean").alias("normalized_chars"))


@query(f"""
with {CANDIDATES_SQL}
select doc_id, case source_hf_path when '{ANCHOR}' then case when doc_id % 4 = 0 then 'Anagha' else 'Chinmay' end when '{PRIMARY}' then case when doc_id % 4 = 1 then 'Anagha' else 'Chinmay' end end as voice
from candidates""")
def speaker_lookup(spark, folder):
    rows = candidates(spark, folder)
    anchor = F.when(F.col("doc_id") % 4 == 0, F.lit(" female ")).otherwise(F.lit("MALE"))
    gender = F.when(F.col("source_hf_path") == ANCHOR, anchor).otherwise(F.when(F.col("doc_id") % 4 == 1, F.lit("0")).otherwise(F.lit("1")))
    return rows.select("doc_id", voices.assigned(F.col("source_hf_path"), gender, strict=False).alias("voice"))


@query("""
with roster(name, language) as (values ('Kavya', 'hi'), ('Amit', 'hi'), ('Anagha', 'mr'), ('Chinmay', 'mr'))
select name, d.lang, count(*) as n from documents d join roster on roster.language = case lang when 'de' then 'hi' when 'en' then 'en' else 'mr' end group by 1, 2
union all select null, lang, count(*) from documents where lang = 'en' group by 2""")  # fmt: skip
def roster_language_join(spark, folder):
    """Each language's documents by the voices of that language; one without a voice stays, with none."""
    docs = table(spark, folder, "documents").select("lang", F.when(F.col("lang") == "de", "hi").when(F.col("lang") == "en", "en").otherwise("mr").alias("language"))
    return docs.join(voices.roster(spark), "language", "left").groupBy("name", "lang").agg(F.count("*").alias("n"))


@query("select sha256(text) as text_sha256, count(*) as copies, min(doc_id) as first_doc from documents group by text having count(*) > 1")
def exact_text_duplicates(spark, folder):
    groups = table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return groups.filter("copies > 1")


@query(r"select page_id, coalesce(nullif(substr(lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 32), ''), 'utt') as slug from pages")
def slugify_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("select page_id, list_last(string_split(url, '/')) as base, 'data/' || list_last(string_split(url, '/')) as path from pages")
def shard_basename(spark, folder):
    base = T.basename(F.col("url"))
    return table(spark, folder, "pages").select("page_id", base.alias("base"), scan.shard_path(F.lit("pages"), base, {"pages": "data"}).alias("path"))


@query("select lang, sum(rows) as n, sum(chars) as chars from (select lang, 1 as rows, n_chars as chars from documents union all select 'conversation', 1, null from conversations) group by 1")
def union_of_sources(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "n_chars")
    turns = table(spark, folder, "conversations").select(F.lit("conversation").alias("lang"))
    return lookups.union_sources([docs, turns]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select row_number() over (order by event_id) - 1 as _idx, event_id, event_type from events")
def ordinal_scan(spark, folder):
    return scan.scan(spark, f"{folder}/events.parquet", ["event_id", "event_type"])


@query(f"with {CANDIDATES_SQL} select bucket as manifest, id, clip_key, sha256(text) as text_sha256 from chosen")
def manifest_roundtrip(spark, folder):
    items = chosen(spark, folder).select("bucket", "id", "clip_key", F.sha2("text", 256).alias("text_sha256"))
    header = spark.createDataFrame([(n, retained) for n, (_, _, retained) in routing.catalogue().items()], "bucket string, is_retention boolean")
    path = new_place(spark, "manifests")
    manifests.write(items, header, path)
    return manifests.read(spark, path).select("manifest", "id", "clip_key", "text_sha256")


@query(f"""with {CANDIDATES_SQL}, counts as (select bucket, count(*) as n from chosen group by 1)
select b.bucket, coalesce(n, 0)::bigint as n, (select count(distinct clip_key) from chosen) as keys, 7::bigint as seed, coalesce(n, 0)::bigint as in_file from sizes b left join counts using (bucket)""")
def manifest_lock(spark, folder):
    """Bucket files, key file and summary of a lock, written twice as one commit, and what they say."""
    items = written(chosen(spark, folder).select("bucket", "id", "clip_key", "text"), "items")
    header = spark.createDataFrame([(n, retained) for n, (_, _, retained) in routing.catalogue().items()], "bucket string, is_retention boolean")
    path = new_place(spark, "lock")
    manifests.write(items.limit(1), header, path)
    manifests.write(items, header, path, seed=7, overwrite=True)
    told = manifests.read_summary(spark, path).select("seed", "held_out_clip_keys", F.explode("buckets").alias("bucket", "n"))
    in_file = manifests.read(spark, path).groupBy(F.col("manifest").alias("bucket")).agg(F.count("*").alias("in_file"))
    keys = manifests.read_keys(spark, f"{path}/{manifests.KEYS}").agg(F.count("*").alias("keys"))
    rows = told.join(in_file, "bucket", "left").join(keys, F.col("keys") == F.col("held_out_clip_keys"))  # the file has as many keys as the summary says
    return rows.select("bucket", "n", "keys", "seed", F.coalesce("in_file", F.lit(0)).alias("in_file"))


@query(f"""
with recursive {CANDIDATES_SQL},
texts as (select case when source_hf_path = '{ANCHOR}' then 'Anagha' else 'Chinmay' end as speaker, text, row_number() over (partition by source_hf_path order by clip_key) as nth from chosen where language_id = 'mr'),
packed as (
  select speaker, nth, length(text) as chars, 1 as pack from texts where nth = 1
  union all
  select t.speaker, t.nth, case when p.chars >= 540 then length(t.text) else p.chars + length(t.text) end, p.pack + (p.chars >= 540)::int
  from packed p join texts t on t.speaker = p.speaker and t.nth = p.nth + 1),
prompts as (select speaker, pack, max(chars) as chars, count(*) as texts, string_agg(t.text, ' ' order by nth) as text from packed join texts t using (speaker, nth) group by 1, 2)
select format('marathi_longform_{{:03d}}', row_number() over (order by speaker, pack) - 1) as id, speaker, sha256(text) as text_sha256, round(chars / 12.0, 1) as target_seconds
from prompts where chars >= 324 qualify row_number() over (order by speaker, pack) <= 12""")
def greedy_pack_longform(spark, folder):
    rows = chosen(spark, folder).filter("language_id = 'mr'")
    speaker = F.when(F.col("source_hf_path") == ANCHOR, F.lit("Anagha")).otherwise(F.lit("Chinmay"))
    prompts = routing.longform(rows.select(speaker.alias("speaker"), F.col("clip_key").alias("ord"), F.col("text").alias("text_normalized")))
    return prompts.select("id", "speaker", F.sha2("text", 256).alias("text_sha256"), "target_seconds")


@query(f"""
with raw as (select doc_id, text from documents union all select -1, 'मला Machine Learning १० आवडते. 7' union all select -2, 'x' || chr(8205) || 'y  9'),
clean as (select doc_id, {CLEAN_SQL.format("text")} as t from raw),
words as (select doc_id, unnest(regexp_extract_all(t, '{LATIN_SQL}')) as w from clean), longest as (select doc_id, count(*) as n, max(length(w)) as longest from words group by 1)
select c.doc_id, sha256(t) as text_sha256, case when regexp_matches(t, '{T.DEVANAGARI}') then 'Deva' else 'Latn' end as script, len(regexp_extract_all(t, '{T.DIGIT}')) as num_digits, coalesce(n, 0) as num_english_words,
  coalesce(n, 0) as spans, coalesce(longest, 0) as longest_span, '{T.NORMALIZER_VERSION}' as normalizer_version, regexp_matches(t, '[0-9]') as has_todo
from clean c left join longest l on c.doc_id = l.doc_id""")
def normalization_record(spark, folder):
    odd = spark.sql("select -1L, 'मला Machine Learning १० आवडते. 7' union all select -2L, concat('x', decode(unhex('E2808D'), 'utf-8'), 'y  9')")
    rows = table(spark, folder, "documents").select("doc_id", "text").union(odd)
    rows = rows.select("doc_id", T.normalization_record(T.cleaned("text")).alias("r")).select("doc_id", "r.*")
    longest = F.coalesce(F.array_max(F.transform("code_switch_spans", lambda s: s["end"] - s["start"])), F.lit(0))
    return rows.select(
        "doc_id", F.sha2("text_normalized", 256).alias("text_sha256"), "script", "num_digits", "num_english_words", F.size("code_switch_spans").alias("spans"), longest.alias("longest_span"),
        "normalizer_version", (F.size("todos") > 0).alias("has_todo"),
    )


@query(f"with {CANDIDATES_SQL} select doc_id, sha256(text) as text_sha256, sha256(text_normalized) as normalized_sha256, speaker, duration_s, clip_key from (select * from candidates) where text_normalized <> ''")
def candidate_build(spark, folder):
    rows = candidates(spark, folder)
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.sha2("text_normalized", 256).alias("normalized_sha256"), "speaker", "duration_s", "clip_key")


@query(f"with {CANDIDATES_SQL} select clip_key, bucket, count(*) over () as n from (select distinct clip_key, bucket from chosen)")
def held_out_roundtrip(spark, folder):
    """The sorted array of held-out keys, written and read, holds the items' keys and no others."""
    items = chosen(spark, folder).select("clip_key", "bucket")
    path = f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    manifests.write_keys(items, path)
    keys = manifests.read_keys(spark, path)
    total = keys.count()
    return keys.join(items.distinct(), "clip_key", "full").select("clip_key", "bucket", F.lit(total).cast("long").alias("n"))


PLAN_SQL = """
select * from (values
  ('eval', 0, null, 'ai4bharat/Rasa', 'mr', 'test-00000-of-00007.parquet', 'audio.path,text,gender,style,duration', null, 700),
  ('eval', 1, null, 'ai4bharat/Rasa', 'mr', 'test-00001-of-00007.parquet', 'audio.path,text,gender,style,duration', null, 700),
  ('eval', 2, null, 'SPRINGLab/IndicTTS_Marathi', 'mr', 'train-00000-of-00004.parquet', 'audio.path,text,gender', null, 700),
  ('eval', 3, null, 'SPRINGLab/IndicTTS_Marathi', 'mr', 'train-00003-of-00004.parquet', 'audio.path,text,gender', null, 700),
  ('eval', 4, null, 'SPRINGLab/IndicTTS-Hindi', 'hi', 'train-00000-of-00010.parquet', 'audio.path,text', 'Amit', 700),
  ('eval', 5, null, 'SPRINGLab/IndicTTS-English', 'en', 'train-00000-of-00028.parquet', 'audio.path,text', 'Amit', 700),
  ('smoke', 0, null, 'SPRINGLab/IndicTTS_Marathi', 'mr', 'train-00000-of-00004.parquet', 'audio,text,gender', null, 12),
  ('smoke', 1, null, 'ai4bharat/Rasa', 'mr', 'test-00000-of-00007.parquet', 'audio,text,gender', null, 8),
  ('full', 0, 'springlab_marathi', 'SPRINGLab/IndicTTS_Marathi', 'mr', 'train-00000-of-00004.parquet', 'audio,text,gender', null, null),
  ('full', 1, 'springlab_marathi', 'SPRINGLab/IndicTTS_Marathi', 'mr', 'train-00003-of-00004.parquet', 'audio,text,gender', null, null),
  ('full', 2, 'rasa_marathi', 'ai4bharat/Rasa', 'mr', 'test-00002-of-00007.parquet', 'audio,text,gender', null, null),
  ('full', 3, 'rasa_marathi', 'ai4bharat/Rasa', 'mr', 'test-00003-of-00007.parquet', 'audio,text,gender', null, null),
  ('full', 4, 'rasa_marathi', 'ai4bharat/Rasa', 'mr', 'test-00004-of-00007.parquet', 'audio,text,gender', null, null),
  ('full', 5, 'rasa_marathi', 'ai4bharat/Rasa', 'mr', 'test-00005-of-00007.parquet', 'audio,text,gender', null, null),
  ('full', 6, 'hindi_replay', 'SPRINGLab/IndicTTS-Hindi', 'hi', 'train-00004-of-00010.parquet', 'audio,text,gender', null, null),
  ('full', 7, 'hindi_replay', 'SPRINGLab/IndicTTS-Hindi', 'hi', 'train-00005-of-00010.parquet', 'audio,text,gender', null, null),
  ('full', 8, 'english_replay', 'SPRINGLab/IndicTTS-English', 'en', 'train-00000-of-00028.parquet', 'audio,text', null, null)
) t(plan, nth, pool, source, language, shard, columns, speaker, quota)"""


@query(PLAN_SQL)
def read_plans(spark, folder):
    """The evaluation's, the smoke run's and the full run's reads."""
    tables = {"eval": plans.EVAL, "smoke": plans.SMOKE, "full": plans.FULL}
    out = None
    for name, plan in tables.items():
        one = scan.plan_table(spark, plan).withColumn("plan", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("plan", "nth", "pool", "source", "language", T.basename(F.col("path")).alias("shard"), F.array_join("columns", ",").alias("columns"), "speaker", "quota")


@query("""
select 'first' as pool, 'en' as language_id, 'documents.parquet' as shard, null as forced_speaker, count(*) as n, count(text) as texts, count(distinct _idx) as places from (select *, row_number() over () as _idx from documents)
union all select 'second', 'mr', 'pages.parquet', 'Anagha', least(count(*), 40), 0, least(count(*), 40) from pages
union all select 'second', 'mr', 'benchmark.parquet', null, 1, 1, 1""")  # fmt: skip
def read_plan_scans(spark, folder):
    """A plan of three shards of different columns, one with a limit and one with the limit 0, which gives a row."""
    reads = [
        scan.Read("documents", "en", f"{folder}/documents.parquet", ("doc_id", "text"), "first"),
        scan.Read("pages", "mr", f"{folder}/pages.parquet", ("page_id", "url"), "second", "Anagha", 40),
        scan.Read("benchmark", "mr", f"{folder}/benchmark.parquet", ("item_id", "text"), "second", None, 0),
    ]
    rows = scan.read_plan(spark, reads)
    return rows.groupBy("pool", "language_id", "shard", "forced_speaker").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.count_distinct("_idx").alias("places"))


@query("""
with asked(name) as (values ('src0'), ('src1'), ('nowhere'), ('elsewhere'))
select name from asked where name not in (select source from documents)""")  # fmt: skip
def unknown_sources(spark, folder):
    asked = spark.createDataFrame([("src0",), ("src1",), ("nowhere",), ("elsewhere",)], "name string")
    return lookups.unknown_names(asked, table(spark, folder, "documents").select(F.col("source").alias("name")), "name")


@query(f"with {CANDIDATES_SQL} select bucket, id, pos from chosen where bucket in ('retention_hindi', 'retention_english') and pos < 12")
def retention_first_items(spark, folder):
    """The items that an evaluation during training looks at: the first twelve of each retention bucket."""
    items = chosen(spark, folder).filter(F.col("bucket").isin("retention_hindi", "retention_english"))
    return clips.first_items(items, "bucket", "id", 12).select("bucket", "id", "pos")
