"""Queries on tokens, mixtures, metrics and signals."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, signal
from ..functions import text as T
from ..functions import tokens as K
from ..operators import batches, clips, gates, metrics, mixture, monitor, panel, parameters, permutation, profiles, quota, voices, windows
from ..sources import manifests
from ..sources.shared import shared_dir
from ..sources.tables import new_place, written
from ..streaming import ingest, monitoring
from .registry import query, table

CONTRACT = K.Contract()
BASE = CONTRACT.snac_base

# -- token streams: a customer's orders as codes --------------------------------------------------

CODES_SQL = """
codes as (select o_custkey as key, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, o_orderkey, (o_orderkey // 64 % 4)::int as c0, lag(o_orderkey // 64 % 4) over (partition by o_custkey order by o_orderkey) as before from orders),
frames as (select *, row_number() over (partition by key order by i) - 1 as f from codes where before is null or before <> c0),
stream as (
  select key, f * 7 + p as pos, 128266 + p * 4096 + case p when 0 then c0 when 1 then (o_orderkey * 3) % 4096 when 4 then (o_orderkey * 5) % 4096 when 2 then (o_orderkey * 7) % 4096 when 3 then (o_orderkey * 11) % 4096 when 5 then (o_orderkey * 13) % 4096 else (o_orderkey * 17) % 4096 end as id
  from frames, (select unnest(range(7)) as p))"""


def streams(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    part = lambda *factors: F.flatten(F.transform("o", lambda x: F.array(*((x * f % 4096).cast("int") for f in factors))))
    return rows.select("key", F.transform("o", lambda x: (F.floor(x / 64) % 4).cast("int")).alias("c0"), part(3, 5).alias("c1"), part(7, 11, 13, 17).alias("c2"))


def token_streams(spark: SparkSession, folder: str) -> DataFrame:
    return streams(spark, folder).select("key", K.interleaved(F.col("c0"), F.col("c1"), F.col("c2"), BASE).alias("ids"))


@query(f"with {CODES_SQL} select key, pos, id from stream")
def interleave_codes(spark, folder):
    return token_streams(spark, folder).select("key", F.posexplode("ids").alias("pos", "id"))


@query(f"with {CODES_SQL} select key, (pos % 7)::int as position, ((id - 128266) % 4096)::int as code, count(*) as n from stream group by 1, 2, 3")
def deinterleave_codes(spark, folder):
    parsed = token_streams(spark, folder).select("key", K.deinterleaved(F.concat("ids", F.array(F.lit(BASE), F.lit(BASE + 1))), BASE).alias("c"))
    back = parsed.select("key", K.interleaved(F.col("c.c0"), F.col("c.c1"), F.col("c.c2"), BASE, deduplicate=False).alias("ids"))
    found = back.select("key", F.explode("ids").alias("id")).select("key", K.from_token(F.col("id"), BASE).alias("t"))
    return found.groupBy("key", F.col("t.position").alias("position"), F.col("t.code").alias("code")).agg(F.count("*").alias("n"))


@query(f"with {CODES_SQL}, sizes as (select key, count(*) as n from stream group by 1) select key, (n // 7)::int as frames, round(n / 82.0, 9) as seconds, n as prefix from sizes")
def frame_counts(spark, folder):
    rows = token_streams(spark, folder).withColumn("prefix", K.audio_prefix(F.concat("ids", F.array(F.lit(CONTRACT.end_of_speech), F.lit(BASE))), BASE))
    return rows.select("key", K.frame_count(F.col("ids")).alias("frames"), F.round(K.seconds(F.col("ids")), 9).alias("seconds"), F.size("prefix").alias("prefix"))


@query(f"""
with {CODES_SQL}, seq as (select key, pos + 5 as pos, id as label from stream union all select key, max(pos) + 6, 128258 from stream group by 1 union all select distinct key, p, -100 from stream, (select unnest(range(5)) as p))
select key, count(*) as n, sum(case when label <> -100 then 1 else 0 end) as trained, sum(label) as label_sum, sum(label * pos) as label_checksum from seq group by 1""")
def label_mask(spark, folder):
    prompt = F.array(*(F.lit(x) for x in (CONTRACT.start_of_human, CONTRACT.begin_of_text, CONTRACT.eot_id, CONTRACT.start_of_ai, CONTRACT.start_of_speech)))
    rows = token_streams(spark, folder).select("key", K.training_sequence(prompt, F.col("ids"), CONTRACT)["labels"].alias("labels")).select("key", F.posexplode("labels").alias("pos", "label"))
    label = F.col("label").cast("long")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(label != -100).alias("trained"), F.sum(label).alias("label_sum"), F.sum(label * F.col("pos")).alias("label_checksum"))


@query(f"""
with {CODES_SQL}, sizes as (select key, count(*)::int as n from stream group by 1),
batched as (select key, n, max(n) over (partition by key // 4) as most from sizes)
select key, most as padded, n as attended, most - n as ignored from batched""")
def pad_to_batch_max(spark, folder):
    rows = token_streams(spark, folder).withColumn("most", F.max(F.size("ids")).over(Window.partitionBy(F.floor(F.col("key") / 4))))
    ids, labels = K.padded(F.col("ids"), F.col("most"), 128263), K.padded(F.col("ids"), F.col("most"), K.IGNORED)
    mask = K.padded(F.transform("ids", lambda x: F.lit(1)), F.col("most"), 0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return rows.select("key", F.size(ids).alias("padded"), total(mask).alias("attended"), F.size(F.filter(labels, lambda x: x == K.IGNORED)).alias("ignored"))


@query(f"""
with {CODES_SQL}, seq as (select key, pos, id from stream union all select key, max(pos) + 1, 128258 from stream group by 1 union all select key, max(pos) + 2, -100 from stream group by 1),
weighted as (select key, id % 10 + 1 as ce, case when id = -100 then 0.0 when id = 128258 then 1.0 else [1.0, 0.7, 0.4, 0.4, 0.7, 0.4, 0.4][(id - 128266) // 4096 + 1] end as w from seq)
select key, round(sum(w), 6) as weight_sum, round(sum(ce * w) / greatest(sum(w), 1e-8), 6) as weighted_ce from weighted group by 1""")
def position_weights(spark, folder):
    rows = token_streams(spark, folder).select("key", F.concat("ids", F.array(F.lit(CONTRACT.end_of_speech), F.lit(K.IGNORED))).alias("labels"))
    rows = rows.withColumn("w", K.token_weights(F.col("labels"), CONTRACT)).withColumn("ce", F.transform("labels", lambda x: (x % 10 + 1).cast("double")))
    return rows.select("key", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("weight_sum"), F.round(K.weighted_mean(F.col("ce"), F.col("w")), 6).alias("weighted_ce"))


@query("""
select t.key, count(*) as n, sum(id) as ids, max(id) filter (where pos = 0) as first_id from (
  select page_id as key, generate_subscripts(ids, 1) - 1 as pos, unnest(ids) as id from (
    select page_id, [128259, 128000, 156938, 5, 156939, 10] || case when page_id % 2 = 0 then [156940, 6, 156941, 10] else [] end || [(page_id % 100)::int, 128009, 128260, 128261, 128257] as ids from pages)) t group by 1""")  # fmt: skip
def prompt_assembly(spark, folder):
    style = F.when(F.col("page_id") % 2 == 0, F.array(F.lit(6))).otherwise(F.array().cast("array<int>"))
    ids = K.prompt(F.array((F.col("page_id") % 100).cast("int")), F.array(F.lit(5)), style, F.array(F.lit(10)), CONTRACT)
    rows = table(spark, folder, "pages").select(F.col("page_id").alias("key"), F.posexplode(ids).alias("pos", "id"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max(F.when(F.col("pos") == 0, F.col("id"))).alias("first_id"))


@query("""
select 'sound' as vocabulary, null as token, null::int as id, null::int as n where false
union all select 'broken', '<|snac_100|>', 128266 + 101, 100
union all select 'broken', '<|snac_4096|>', null, 4096
union all select 'broken', 'word', 128266 + 5000, null""")  # fmt: skip
def token_contract_check(spark, folder):
    """A sound vocabulary has no violation; a broken one has an id that is shifted, a seam that is absent, and a word inside the band."""
    names = spark.createDataFrame([(t, i) for t, i in zip(K.NAMES.values(), CONTRACT.as_dict().values(), strict=True) if t != "<|snac_0|>"], "token string, id int")
    audio = spark.range(K.BAND).select(F.format_string("<|snac_%d|>", "id").alias("token"), (F.col("id") + BASE).cast("int").alias("id"))
    sound = names.union(audio)
    moved = F.when(F.col("token") == "<|snac_100|>", BASE + 101).otherwise(F.col("id")).cast("int")
    broken = sound.filter("token <> '<|snac_4096|>'").select("token", moved.alias("id")).union(spark.createDataFrame([("word", BASE + 5000)], "token string, id int"))
    found = [K.contract_violations(v, K.resolve(v)).withColumn("vocabulary", F.lit(n)) for n, v in (("sound", sound), ("broken", broken))]
    return found[0].unionByName(found[1]).select("vocabulary", "token", "id", "n")


@query("select o_orderkey, (o_orderkey % 7)::int as position, (o_orderkey % 4096)::int as code, 128266 + (o_orderkey % 7)::int * 4096 + (o_orderkey % 4096)::int as id, 128266 + (o_orderkey % 7)::int * 4096 as base from orders")
def code_tokens(spark, folder):
    """Position and code to id and back, and the base of each position."""
    position, code = (F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % K.CODEBOOK).cast("int")
    rows = table(spark, folder, "orders").select("o_orderkey", position.alias("p"), K.to_token(position, code, BASE).alias("id"))
    back = K.from_token(F.col("id"), BASE)
    return rows.select("o_orderkey", back["position"].alias("position"), back["code"].alias("code"), "id", F.get(F.lit(list(CONTRACT.position_bases)), F.col("p")).alias("base"))


@query(f"with {CODES_SQL} select key, true as same, count(*)::int as tokens, (count(*) // 7)::int as frames, false as other_same from stream group by 1")
def same_sequences(spark, folder):
    """Streams that are made twice are the same; with their last frame dropped they aren't."""
    once, again = token_streams(spark, folder), token_streams(spark, folder).repartition(5).withColumnRenamed("ids", "twice")
    rows = once.join(again, "key").select("key", K.same_sequence(F.col("ids"), F.col("twice"), BASE).alias("s"), K.same_sequence(F.col("ids"), F.slice("twice", 1, F.size("twice") - 7), BASE).alias("o"))
    return rows.select("key", "s.same", "s.tokens", "s.frames", F.col("o.same").alias("other_same"))


QUOTAS = {"even": 40, "odd": 7}


@query(f"""
with {CODES_SQL}, sizes as (select key, case when key % 2 = 0 then 'even' else 'odd' end as source, count(*) + 7 as n from stream group by 1, 2),
scanned as (select *, row_number() over (partition by source order by key) as nth from sizes),
fitting as (select *, row_number() over (partition by source order by key) as kept from scanned where nth <= 8 * case source when 'even' then 40 else 7 end and n <= 90)
select source, key, n::int as n from fitting where kept <= case source when 'even' then 40 else 7 end""")
def compile_quota(spark, folder):
    """Examples of two sources: at most 90 ids long, up to a quota, out of eight times as many rows at most."""
    none, one = F.array().cast("array<int>"), lambda x: F.array(F.lit(x))
    compile = lambda rows: clips.compiled(rows, CONTRACT, F.col("ids"), none, none, one(10))
    rows = token_streams(spark, folder)
    parts = {name: quota.whole(rows.filter(F.col("key") % 2 == k), "key") for k, name in enumerate(QUOTAS)}
    found, _ = quota.compile_plan(parts, compile, QUOTAS, 90)
    return found.select("source", "key", F.size("input_ids").alias("n"))


DOC_QUOTAS, DOC_LONGEST, DOC_SHARD = {"en": 60, "fr": 25, "de": 10, "es": 100_000}, 7 * 12 + 7, 64


@query(f"""
with quotas(lang, quota) as (values {", ".join(f"('{n}', {k})" for n, k in DOC_QUOTAS.items())}),
rows as (select d.lang, quota, doc_id, n_chars // 200 as frames, row_number() over (partition by d.lang order by doc_id) as nth from documents d join quotas using (lang)),
fitting as (select *, row_number() over (partition by lang order by doc_id) as kept from rows where nth <= 8 * quota and frames > 0 and 7 * frames + 7 <= {DOC_LONGEST}),
counts as (select lang, count(*) as n from fitting where kept <= quota group by 1)
select lang as source, doc_id, (7 * frames + 7)::int as n, n as found from fitting join counts using (lang) where kept <= quota""")
def quota_early_stop(spark, folder):
    """Documents as clips, in shards of {DOC_SHARD} ids: texts of less than a frame and examples that are too long fill part of the cap; one quota is more than there is."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / DOC_SHARD).cast("int").alias("shard"))
    last = docs.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    frames = F.floor(F.col("n_chars") / 200).cast("int")
    audio = F.when(frames > 0, F.transform(F.sequence(F.lit(0), 7 * frames - 1), lambda i: BASE + i % 7 * K.CODEBOOK)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    compile = lambda rows: clips.compiled(rows, CONTRACT, audio, none, none, none)
    opened = lambda name: lambda first, stop: docs.filter((F.col("lang") == name) & F.col("shard").between(first, stop - 1))
    sources = {name: quota.Shards(opened(name), last + 1, "doc_id") for name in DOC_QUOTAS}
    found, report = quota.compile_plan(sources, compile, DOC_QUOTAS, DOC_LONGEST)
    return found.join(report, "source").select("source", "doc_id", F.size("input_ids").alias("n"), F.col("n").alias("found"))


@query("""
select * from (values ('begin_of_text', 128000), ('eot_id', 128009), ('start_of_human', 128259), ('end_of_human', 128260), ('start_of_ai', 128261), ('end_of_ai', 128262), ('start_of_speech', 128257), ('end_of_speech', 128258),
  ('speaker_open', 156938), ('speaker_close', 156939), ('style_open', 156940), ('style_close', 156941), ('snac_base', 128266), ('first_audio', 128266), ('past_audio', 156938)) t(name, id)""")  # fmt: skip
def contract_ids(spark, folder):
    """The contract as it is resolved from a vocabulary, and the bounds of its band."""
    vocabulary = spark.createDataFrame([(K.NAMES[k], v) for k, v in CONTRACT.as_dict().items()], "token string, id int")
    found = K.resolve(vocabulary)
    low, high = found.band
    return spark.createDataFrame([*found.as_dict().items(), ("first_audio", low), ("past_audio", high)], "name string, id int")


# -- rows in sequence -------------------------------------------------------------------------------


@query("select user_id, event_id, event_type from events qualify lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type")
def run_dedup_events(spark, folder):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, folder, "events").withColumn("before", before)
    return rows.filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("""
with numbered as (select *, row_number() over (partition by user_id order by ts, event_id) as pos from events),
firsts as (select *, min(case when event_type = 'error' then pos end) over (partition by user_id) as stop from numbered)
select user_id, count(*) as events, sum(event_id) as ids from firsts where stop is null or pos < stop group by 1""")  # fmt: skip
def prefix_until_error(spark, folder):
    w = Window.partitionBy("user_id")
    rows = table(spark, folder, "events").withColumn("pos", F.row_number().over(w.orderBy("ts", "event_id")))
    rows = rows.withColumn("stop", F.min(F.when(F.col("event_type") == "error", F.col("pos"))).over(w)).filter("stop is null or pos < stop")
    return rows.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("select event_type, next_type, count(*) as n from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events) group by 1, 2")
def shift_by_one(spark, folder):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("event_type", after.alias("next_type")).groupBy("event_type", "next_type").agg(F.count("*").alias("n"))


KINDS = ("click", "error", "purchase", "signup", "view")
TYPES_SQL = "types as (select user_id, list(coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0)::int order by ts, event_id) as t from events group by 1)"


def type_streams(spark: SparkSession, folder: str) -> DataFrame:
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int")
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", code.alias("t")))).alias("e"))
    return rows.select("user_id", F.transform("e", lambda x: x["t"]).alias("t"))


def _grams_sql(n: int) -> str:
    return f"case when len(t) < {n} then 0.0 else round(1 - len(list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: t[i:i + {n - 1}]))) / (len(t) - {n} + 1), 9) end"


@query(f"with {TYPES_SQL} select user_id, {_grams_sql(3)} as rep3, {_grams_sql(5)} as rep5, round(len(list_distinct(t)) / len(t), 9) as fraction_unique from types")
def ngram_repetition(spark, folder):
    t = F.col("t")
    return type_streams(spark, folder).select("user_id", F.round(arrays.repetition_rate(t, 3), 9).alias("rep3"), F.round(arrays.repetition_rate(t, 5), 9).alias("rep5"), F.round(arrays.fraction_unique(t), 9).alias("fraction_unique"))


@query(f"with {TYPES_SQL} select count(*) as n, round(avg({_grams_sql(3)}), 6) as rep3, round(avg({_grams_sql(5)}), 6) as rep5, round(avg((user_id % 3 = 0)::int), 6) as hit_rate, round(avg(len(t) // 7), 6) as mean_frames from types")
def longform_panel(spark, folder):
    rows = type_streams(spark, folder).select(F.lit("marathi_longform").alias("bucket"), F.col("t").alias("token_ids"), (F.col("user_id") % 3 == 0).alias("hit"))
    r = lambda c: F.round(c, 6)
    return panel.longform_panel(rows).select("n", r("repetition_rate_3gram").alias("rep3"), r("repetition_rate_5gram").alias("rep5"), r("hit_rate").alias("hit_rate"), r("mean_frames").alias("mean_frames"))


# -- mixtures ----------------------------------------------------------------------------------------

WEIGHTS_SQL = "weights(source, weight, ord) as (values ('springlab_marathi', 0.56::double, 0), ('rasa_marathi', 0.24::double, 1), ('hindi_replay', 0.15::double, 2), ('english_replay', 0.05::double, 3))"


def weights_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, w, i) for i, (n, w) in enumerate(mixture.WEIGHTS.items())], "source string, weight double, ord int")


@query(f"""
with {WEIGHTS_SQL}, exact as (select size, source, ord, size * weight as e from weights, (values (4), (20), (25), (32), (100)) s(size)),
ranked as (select *, floor(e) as base, row_number() over (partition by size order by round(e - floor(e), 9) desc, ord) as nth, size - sum(floor(e)) over (partition by size) as rest from exact)
select size, source, (base + case when nth <= rest then 1 else 0 end)::int as seats from ranked""")
def largest_remainder_seats(spark, folder):
    out = None
    for size in (4, 20, 25, 32, 100):
        one = mixture.seats_of(weights_table(spark), size).select(F.lit(size).alias("size"), "source", "seats")
        out = one if out is None else out.unionByName(one)
    return out


LANGS, LANG_WEIGHTS = ("en", "fr", "de", "es"), {"en": 0.56, "fr": 0.24, "de": 0.15, "es": 0.05}
DRAWS_SQL = f"""
pools as (select lang as source, doc_id, row_number() over (partition by lang order by sha256(doc_id::varchar), doc_id) - 1 as idx, count(*) over (partition by lang) as size from documents),
seats(source, k, first) as (values ('en', 11, 0), ('fr', 5, 11), ('de', 3, 16), ('es', 1, 19)),
numbers as (select o as draw_no, o // 20 as win, {permutation.sql("o % 20", "20", "('7:batch:' || (o // 20))")} as seat from (select unnest(range(1000)) as o)),
ordinals as (select draw_no, win, s.source, size, win * k + seat - first as nth from numbers join seats s on seat >= first and seat < first + k join (select distinct source, size from pools) z on s.source = z.source),
drawn as (select draw_no, win, source, {permutation.sql("nth % size", "size", "('7:' || source || ':' || (nth // size))")} as idx from ordinals)"""


def _drawn(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pool = mixture.indexed(table(spark, folder, "documents").select(F.col("lang").alias("source"), "doc_id"), "source", "doc_id")
    sizes = {r["source"]: r["n"] for r in pool.groupBy("source").agg(F.count("*").alias("n")).collect()}
    return mixture.draws(spark, sizes, LANG_WEIGHTS, 20, 50, seed=7), pool


@query(f"with {DRAWS_SQL} select draw_no, drawn.source, doc_id from drawn join pools on drawn.source = pools.source and drawn.idx = pools.idx")
def mixture_draws_by_hash(spark, folder):
    drawn, pool = _drawn(spark, folder)
    return mixture.materialized(drawn, pool).select("draw_no", "source", "doc_id")


@query(f"""
with {DRAWS_SQL}, examples as (select draw_no, draw_no // 8 as batch, p.doc_id, p.doc_id % 50 + 1 as n from drawn d join pools p on d.source = p.source and d.idx = p.idx),
sized as (select *, max(n) over (partition by batch) as width from examples)
select batch, draw_no, width::int as width, n::int as attended, (n * (doc_id % 1000) + n * (n - 1) // 2 + (width - n) * 128263)::bigint as ids, (width - n + 1)::int as ignored from sized""")
def collated_batches(spark, folder):
    """Drawn examples as batches of eight in Arrow shards, read back by their table."""
    drawn, pool = _drawn(spark, folder)
    n = (F.col("doc_id") % 50 + 1).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("doc_id") % 1000).cast("int") + i)
    examples = drawn.join(pool, ["source", "idx"]).select("draw_no", ids.alias("input_ids"), F.concat(F.array(F.lit(K.IGNORED)), F.slice(ids, 2, n - 1)).alias("labels"))
    index = batches.write_batches(batches.collated(examples, 8, 128263), shard_bytes=64 << 10)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return batches.read_batches(index).select(
        "batch", "draw_no", F.size("input_ids").alias("width"), total("attention_mask").cast("int").alias("attended"), total("input_ids").alias("ids"), F.size(F.filter("labels", lambda x: x == K.IGNORED)).alias("ignored")
    )


@query(f"with {DRAWS_SQL}, p as (select source, count(*) as draws, count(distinct idx) as clips from drawn group by 1) select sum(draws) as draws, sum(clips) as unique_clips, round(13.294, 6) as loss, round(13.294 / 4, 6) as loss_per_step, string_agg(source || '=' || clips, ', ' order by source) as pools from p")
def run_log(spark, folder):
    drawn, _ = _drawn(spark, folder)
    return manifests.run_log(drawn, 13.294, 4).withColumn("loss", F.round("loss", 6)).withColumn("loss_per_step", F.round("loss_per_step", 6))


@query("""
with plan as (select lang as pool, source as entry, count(*) as n from documents group by 1, 2),
parts as (select *, count(*) over (partition by pool) as k, row_number() over (partition by pool order by entry) - 1 as nth from plan), goals as (select pool, sum(n) // 2 as target from plan group by 1)
select pool, entry, greatest(0, least(ceil(target / k), target - nth * ceil(target / k)))::bigint as quota from parts join goals using (pool)""")  # fmt: skip
def quota_split(spark, folder):
    plan = table(spark, folder, "documents").groupBy(F.col("lang").alias("pool"), F.col("source").alias("entry")).agg(F.count("*").alias("n"))
    goals = plan.groupBy("pool").agg(F.expr("sum(n) div 2").alias("target"))
    return mixture.quotas(plan.drop("n"), goals)


# -- word error rate ---------------------------------------------------------------------------------

TURNS_SQL = """
pairs as (select * from (select conv_id, turn, role, lag(text) over w as reference, text as hypothesis from conversations window w as (partition by conv_id order by turn)) where reference is not null),
words as (select *, string_split_regex(trim(regexp_replace(reference, '\\s+', ' ', 'g')), ' ') as r, string_split_regex(trim(regexp_replace(hypothesis, '\\s+', ' ', 'g')), ' ') as h from pairs),
edited as (select *, len(r) as ref_words, list_last(list_reduce(r, lambda prev, w: list_reduce(range(1, len(h) + 1), lambda row, j: list_append(row, least(prev[j + 1] + 1, row[j] + 1, prev[j] + case when h[j] = w then 0 else 1 end)), [prev[1] + 1]), range(0, len(h) + 1))) as edits from words)"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").withColumn("reference", F.lag("text").over(w)).withColumnRenamed("text", "hypothesis")
    return rows.filter(F.col("reference").isNotNull())


WRONG = "insertions + deletions + substitutions"


@query(f"with {TURNS_SQL} select conv_id, turn, edits, ref_words, round(edits / ref_words, 9) as utterance_wer from edited")
def utterance_wer(spark, folder):
    rows = metrics.with_edits(turns(spark, folder).repartition("conv_id"))
    return rows.select("conv_id", "turn", F.expr(WRONG).alias("edits"), "ref_words", F.round("utterance_wer", 9).alias("utterance_wer"))


@query(f"with {TURNS_SQL} select role, count(*) as n, round(sum(edits) / sum(ref_words), 9) as wer, round(avg(edits / ref_words), 9) as wer_mean_utterance, sum(edits)::bigint as edits from edited group by 1")
def corpus_wer_by_role(spark, folder):
    found = metrics.corpus_wer(metrics.with_edits(turns(spark, folder).repartition("conv_id")), "role")
    return found.select("role", "n", F.round("wer", 9).alias("wer"), F.round("wer_mean_utterance", 9).alias("wer_mean_utterance"), F.expr(WRONG).alias("edits"))


def _mixed_sql(x: str, shift: int, factor: int) -> str:
    """A step of the mixing of 64-bit integers."""
    return f"(xor({x}, {x} >> {shift}) * {factor}::uhugeint) % 18446744073709551616::uhugeint"


#: The weights' limits: the distribution of Poisson(1) counts.
LIMITS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(10)]


@query(f"""
with {TURNS_SQL}, scored as (select role, case when len(r) = 0 then 0.0 else edits / len(r) end as x, ('0x' || substr(md5(format('{{:010d}}_{{:06d}}', conv_id, turn)), 1, 15))::bigint::uhugeint as k from edited),
drawn as (select role, x, b, (k + 1234::uhugeint * 15111065706836454659::uhugeint + b::uhugeint * 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as m from scored, (select unnest(range(1, 1001)) as b)),
first as (select role, x, b, {_mixed_sql("m", 30, 13787848793156543929)} as m from drawn),
second as (select role, x, b, {_mixed_sql("m", 27, 10723151780598845931)} as m from first),
unit as (select role, x, b, (xor(m, m >> 31) >> 11)::double / 9007199254740992 as u from second),
weights as (select role, x, b, {" + ".join(f"(u >= {x!r})::int" for x in LIMITS)} as w from unit),
means as (select role, b, sum(w * x) / greatest(sum(w), 1) as mean from weights group by 1, 2)
select role, round(any_value(point), 9) as point, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from means join (select role, avg(x) as point from scored group by 1) using (role) group by role""")
def bootstrap_ci(spark, folder):
    """The interval of the mean error rate: weights from a digest of each row, which SQL draws, too."""
    rows = metrics.with_edits(turns(spark, folder)).withColumn("id", F.format_string("%010d_%06d", "conv_id", "turn"))
    rows = written(rows.select("role", "id", "utterance_wer"), "edits")
    found = metrics.split_bootstrap_ci(rows, "role", "utterance_wer", "id", seed=1234)
    return found.select("role", *(F.round(c, 9).alias(c) for c in ("point", "low", "high")))


@query(f"with {TURNS_SQL}, found as (select role as bucket, count(*) as n, round(sum(edits) / sum(ref_words), 9) as wer, round(avg((turn % 4 = 0)::int), 9) as hit_rate, sum(edits)::bigint as edits, sum(ref_words)::bigint as ref_words from edited group by 1) select bucket, coalesce(n, 0) as n, wer, hit_rate, edits, ref_words, case when n > 0 then true end as interval_holds_mean from (select distinct role as bucket from conversations union all select 'nobody') left join found using (bucket)")
def panel_by_bucket(spark, folder):
    results = turns(spark, folder).select(F.format_string("%010d_%06d", "conv_id", "turn").alias("id"), F.col("role").alias("bucket"), "reference", "hypothesis", (F.col("turn") % 4 == 0).alias("hit"))
    catalogue = table(spark, folder, "conversations").select(F.col("role").alias("bucket")).distinct().union(spark.sql("select 'nobody'"))
    held = F.col("wer_mean_utterance").between(F.col("low"), F.col("high")) & (F.col("low") < F.col("high"))
    return panel.wer_panel(results, catalogue).select("bucket", "n", F.round("wer", 9).alias("wer"), F.round("hit_rate", 9).alias("hit_rate"), F.expr(WRONG).alias("edits"), "ref_words", held.alias("interval_holds_mean"))


SPEAKERS_SQL = """
e as (select case label % 2 when 0 then 'user' else 'assistant' end as bucket, case when vec_id % 4 < 2 then 'Anagha' else 'Chinmay' end as speaker, vec_id % 2 as side, embedding::double[] as v from embeddings),
alike as (select a.bucket, a.speaker as sa, b.speaker as sb, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.bucket = b.bucket and a.side = 0 and b.side = 1),
voiced as (select bucket, round(avg(s), 6) as speaker_similarity, round(avg(s) filter (where sa = 'Anagha' and sb = 'Anagha'), 6) as anagha, round(avg(s) filter (where sa = 'Chinmay' and sb = 'Chinmay'), 6) as chinmay from alike group by 1)"""


@query(f"""
with {TURNS_SQL}, {SPEAKERS_SQL}, {TYPES_SQL},
found as (select role as bucket, count(*) as n, round(sum(edits) / sum(ref_words), 9) as wer, round(avg((turn % 4 = 0)::int), 9) as hit_rate, sum(edits)::bigint as edits from edited group by 1),
long as (select 'marathi_longform' as bucket, count(*) as n, round(avg((user_id % 3 = 0)::int), 9) as hit_rate, round(avg({_grams_sql(3)}), 6) as rep3, round(avg(len(t) // 7), 6) as mean_frames from types),
prosody as (select case user_id % 2 when 0 then 'user' else 'assistant' end as bucket, round(avg(case when event_type <> 'error' then value end), 6) as mean_f0 from events group by 1),
names as (select distinct role as bucket from conversations union select 'nobody' union select 'marathi_longform')
select bucket, coalesce(l.n, f.n, 0) as n, f.wer, coalesce(l.hit_rate, f.hit_rate) as hit_rate, f.edits, l.rep3, l.mean_frames, v.speaker_similarity, v.anagha, v.chinmay, p.mean_f0
from names left join found f using (bucket) left join long l using (bucket) left join voiced v using (bucket) left join prosody p using (bucket)""")
def full_panel(spark, folder):
    """All that is known of a bucket in one row: error rate, similarity, also by voice, prosody, and long prompts."""
    role = lambda c: F.when(F.col(c) % 2 == 0, "user").otherwise("assistant").alias("bucket")
    results = turns(spark, folder).select(F.format_string("%010d_%06d", "conv_id", "turn").alias("id"), F.col("role").alias("bucket"), "reference", "hypothesis", (F.col("turn") % 4 == 0).alias("hit"))
    catalogue = table(spark, folder, "conversations").select(F.col("role").alias("bucket")).distinct().union(spark.sql("select 'nobody' union select 'marathi_longform'"))
    vectors = table(spark, folder, "embeddings").select(role("label"), F.when(F.col("vec_id") % 4 < 2, "Anagha").otherwise("Chinmay").alias("speaker"), "vec_id", F.col("embedding").alias("vector"))
    similarity = panel.voice_breakdown(vectors.filter("vec_id % 2 = 0"), vectors.filter("vec_id % 2 = 1"))
    measured = table(spark, folder, "events").select(role("user_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("mean_f0"), *(F.lit(0.5).alias(p) for p in panel.PROSODY[1:]))
    long = type_streams(spark, folder).select(F.lit("marathi_longform").alias("bucket"), F.col("t").alias("token_ids"), (F.col("user_id") % 3 == 0).alias("hit"))
    found = panel.full_panel(results, catalogue, long, similarity, panel.prosody_means(measured))
    r = lambda c, d=6: F.round(c, d).alias(c)
    voices_ = (F.round(F.col("by_voice")[v], 6).alias(v.lower()) for v in ("Anagha", "Chinmay"))
    return found.select("bucket", "n", r("wer", 9), r("hit_rate", 9), F.expr(WRONG).alias("edits"), F.round("repetition_rate_3gram", 6).alias("rep3"), r("mean_frames"), r("speaker_similarity"), *voices_, r("mean_f0"))


@query("""
with numbered as (select conv_id, turn % 2 as side, row_number() over (partition by conv_id, turn % 2 order by turn) as nth, text from conversations),
pairs as (select a.conv_id, a.nth, a.text as reference, b.text as hypothesis from numbered a join numbered b on a.conv_id = b.conv_id and a.nth = b.nth and a.side = 0 and b.side = 1)
select conv_id, count(*) as pairs, sum(length(reference))::bigint as reference_chars, sum(length(hypothesis))::bigint as hypothesis_chars, min(sha256(reference || hypothesis)) as least from pairs group by 1""")  # fmt: skip
def positional_zip(spark, folder):
    """Even turns against odd ones by position, as far as the shorter side goes."""
    side = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("turn") % 2 == k, F.struct("turn", "text")))), lambda s: s["text"])
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(side(0).alias("refs"), side(1).alias("hyps"))
    pairs = rows.select("conv_id", F.inline(arrays.zipped(F.col("refs"), F.col("hyps"))))
    return pairs.groupBy("conv_id").agg(
        F.count("*").alias("pairs"), F.sum(F.length("left")).alias("reference_chars"), F.sum(F.length("right")).alias("hypothesis_chars"), F.min(F.sha2(F.concat("left", "right"), 256)).alias("least")
    )


@query(f"with {TURNS_SQL} select conv_id, turn, len(r) as ref_words, edits, greatest(len(r), len(h)) - edits >= 0 as hits_fit, true as adds_up from edited")
def edit_kinds(spark, folder):
    """The kinds of edits add up: hits, substitutions and deletions make the reference, hits, substitutions and insertions the hypothesis."""
    rows = metrics.with_edits(turns(spark, folder).repartition("conv_id", "turn"))
    words = lambda c: F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    fits = (F.expr("hits + substitutions + deletions") == words("reference")) & (F.expr("hits + substitutions + insertions") == words("hypothesis"))
    return rows.select("conv_id", "turn", "ref_words", F.expr(WRONG).alias("edits"), (F.col("hits") >= 0).alias("hits_fit"), fits.alias("adds_up"))


@query(f"""
with {TURNS_SQL}, firsts as (select *, row_number() over (partition by role order by conv_id, turn) as nth from edited)
select role, count(*) as n, round(sum(edits) / sum(ref_words), 9) as wer, sum(edits)::bigint as edits from firsts where nth <= 12 group by 1""")  # fmt: skip
def retention_wer(spark, folder):
    """The error rate that a run watches: of the first twelve items of each group."""
    rows = turns(spark, folder).withColumn("ord", F.struct("conv_id", "turn"))
    found = metrics.corpus_wer(metrics.with_edits(clips.first_items(rows, "role", "ord", 12).drop("ord")), "role")
    return found.select("role", "n", F.round("wer", 9).alias("wer"), F.expr(WRONG).alias("edits"))


@query(f"""
with {TURNS_SQL}, found as (select role as bucket, count(*) as n, sum(edits) / sum(ref_words) as wer, avg((turn % 4 = 0)::int) as hit_rate from edited group by 1)
select bucket, coalesce(n, 0)::varchar as n, coalesce(format('{{:.3f}}', wer), '—') as wer, coalesce(format('{{:.2f}}', hit_rate), '—') as hit_rate
from (select distinct role as bucket from conversations union all select 'nobody') left join found using (bucket)""")  # fmt: skip
def report_table(spark, folder):
    """The panel's cells as the page shows them."""
    results = turns(spark, folder).select(F.format_string("%010d_%06d", "conv_id", "turn").alias("id"), F.col("role").alias("bucket"), "reference", "hypothesis", (F.col("turn") % 4 == 0).alias("hit"))
    catalogue = table(spark, folder, "conversations").select(F.col("role").alias("bucket")).distinct().union(spark.sql("select 'nobody'"))
    return panel.display(panel.wer_panel(results, catalogue), panel.WER_COLUMNS).select("bucket", "n", "wer", "hit_rate")


@query(f"with {TURNS_SQL} select role as bucket, count(*) as n, min(sha256(reference || '|' || hypothesis)) as least from pairs group by 1")
def audit_roundtrip(spark, folder):
    """References and hypotheses by bucket, as they are read back from the audit files."""
    rows = turns(spark, folder).select(F.col("role").alias("bucket"), F.format_string("%d_%d", "conv_id", "turn").alias("id"), "reference", "hypothesis")
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    manifests.write_audit(rows, path)
    found = spark.read.schema("id string, reference string, hypothesis string, bucket string").json(path)
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.sha2(F.concat_ws("|", "reference", "hypothesis"), 256)).alias("least"))


@query("select event_type as bucket, count(*) as n, round(avg(case when event_type <> 'error' then value end), 6) as wer from events group by 1")
def panel_json_roundtrip(spark, folder):
    """A panel as one JSON document, read back a row for each bucket; a figure that is missing is missing there too."""
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 6).alias("wer"))
    path = f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    panel.write_json(rows, path)
    whole = spark.read.schema("buckets map<string, struct<n: bigint, wer: double>>").json(path)
    return whole.select(F.explode("buckets").alias("bucket", "r")).select("bucket", "r.n", "r.wer")


@query("select event_type as bucket, round(avg(value) filter (where user_id % 2 = 0), 6) as base, round(avg(value) filter (where user_id % 2 = 1), 6) as tuned, round(avg(value) filter (where user_id % 2 = 1) - avg(value) filter (where user_id % 2 = 0), 6) as delta from events group by 1")
def base_vs_tuned_delta(spark, folder):
    part = lambda k: table(spark, folder, "events").filter(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("bucket")).agg(F.avg("value").alias("wer"))
    return metrics.compared(part(0), part(1)).select("bucket", *(F.round(c, 6).alias(c) for c in ("base", "tuned", "delta")))


@query("""
with series as (select date_diff('hour', timestamp '2024-01-01', ts) as step, event_type as bucket, avg(value) as wer from events group by 1, 2),
due as (select * from series where step % 6 = 0 and step <> 0),
base as (select bucket, wer as base from due where step = (select min(step) from due))
select step, round(greatest(max((wer - base) / greatest(base, 1e-6)), 0.0), 6) as worst, greatest(max((wer - base) / greatest(base, 1e-6)), 0.0) > 0.15 as alert from due join base using (bucket) group by 1""")  # fmt: skip
def regression_alert(spark, folder):
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    series = table(spark, folder, "events").groupBy(hour.alias("step"), F.col("event_type").alias("bucket")).agg(F.avg("value").alias("wer"))
    return monitor.alerts(series, 6).withColumn("worst", F.round("worst", 6))


CHANGES_SQL = """
series as (select date_diff('hour', timestamp '2024-01-01', ts) as step, event_type as bucket, avg(value) as wer from events group by 1, 2),
base as (select event_type as bucket, avg(value) as base from events group by 1),
changed as (select step, bucket, (wer - base) / greatest(base, 1e-6) as regression from series join base using (bucket) where step % 12 = 0 and step <> 0)"""


def _against_baseline(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    events = table(spark, folder, "events")
    series = events.groupBy(hour.alias("step"), F.col("event_type").alias("bucket")).agg(F.avg("value").alias("wer"))
    return series, events.groupBy(F.col("event_type").alias("bucket")).agg(F.avg("value").alias("wer"))


@query(f"with {CHANGES_SQL} select count(*) as compared, round(greatest(coalesce(max(regression), 0.0), 0.0), 6) as worst, greatest(coalesce(max(regression), 0.0), 0.0) > 0.15 as alert from changed")
def worst_regression(spark, folder):
    series, base = _against_baseline(spark, folder)
    changed = monitor.changes(series, 12, base)
    return metrics.worst(changed).select("alert", F.round("worst", 6).alias("worst"), F.lit(changed.count()).alias("compared"))


@query(f"with {CHANGES_SQL}, steps as (select step, greatest(max(regression), 0.0) as worst from changed group by 1) select step, round(worst, 6) as worst from steps where worst > 0.15")
def alert_marker(spark, folder):
    """The steps that a run's marker names."""
    series, base = _against_baseline(spark, folder)
    path = f"{shared_dir(spark)}/regression-{uuid.uuid4().hex}"
    kind = "step bigint, worst double"
    if not monitor.mark(monitor.alerts(series, 12, baseline=base), path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(path).select("step", F.round("worst", 6).alias("worst"))


# -- similarity --------------------------------------------------------------------------------------


@query("with ref as (select embedding as r from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], r::double[]), 6) as similarity from embeddings, ref")
def cosine_to_reference(spark, folder):
    rows = table(spark, folder, "embeddings")
    reference = rows.filter("vec_id = 0").first()["embedding"]
    return rows.select("vec_id", F.round(arrays.cosine_similarity(F.col("embedding"), F.lit(reference)), 6).alias("similarity"))


def _side(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return table(spark, folder, "embeddings").filter(F.col("vec_id") % 2 == k)


@query("select a.label, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by 1")
def pairwise_similarity_by_label(spark, folder):
    found = metrics.mean_pairwise_similarity(_side(spark, folder, 0), _side(spark, folder, 1), "label", "embedding")
    return found.select("label", F.round("similarity", 6).alias("similarity"))


@query("select a.label, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) filter (where a.label = b.label), 6) as ceiling, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) filter (where a.label <> b.label), 6) as floor from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by 1")
def ceiling_floor_similarity(spark, folder):
    """Of each label: likeness to its own reference vectors, and to those of all other labels."""
    found = metrics.ceiling_and_floor(_side(spark, folder, 0), _side(spark, folder, 1), "label", "embedding")
    return found.select("label", F.round("ceiling", 6).alias("ceiling"), F.round("floor", 6).alias("floor"))


@query("""
with e as (select (label % 3)::varchar as bucket, case when vec_id % 4 < 2 then 'Anagha' else 'Chinmay' end as speaker, vec_id % 2 as side, embedding::double[] as v from embeddings),
p as (select a.bucket, a.speaker as sa, b.speaker as sb, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.bucket = b.bucket and a.side = 0 and b.side = 1)
select bucket, round(avg(s), 6) as similarity, round(avg(s) filter (where sa = 'Anagha' and sb = 'Anagha'), 6) as anagha, round(avg(s) filter (where sa = 'Chinmay' and sb = 'Chinmay'), 6) as chinmay from p group by 1""")  # fmt: skip
def voice_breakdown(spark, folder):
    rows = table(spark, folder, "embeddings").select((F.col("label") % 3).cast("string").alias("bucket"), F.when(F.col("vec_id") % 4 < 2, "Anagha").otherwise("Chinmay").alias("speaker"), "vec_id", F.col("embedding").alias("vector"))
    found = panel.voice_breakdown(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"))
    return found.select("bucket", F.round("speaker_similarity", 6).alias("similarity"), F.round(F.col("by_voice")["Anagha"], 6).alias("anagha"), F.round(F.col("by_voice")["Chinmay"], 6).alias("chinmay"))


@query("""
with e as (select user_id, value, (row_number() over (partition by user_id order by ts, event_id) - 1) as pos, count(*) over (partition by user_id) as n from events),
segments as (select user_id, pos // 8 as w, list(value order by pos) as v, max(n) as n from e where pos // 8 <= greatest(0, n // 8 - 1) group by 1, 2)
select user_id, w::int as nth, round(list_cosine_similarity(list_resize(v, 8, 0.0), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), 6) as similarity from segments where len(v) >= 4""")  # fmt: skip
def tumbling_trajectory(spark, folder):
    return _trajectory(spark, folder).withColumn("similarity", F.round("similarity", 6))


def _ramp() -> windows.Model:
    """Stands for a model: a window's values, filled up with zeros."""
    return lambda found, rate: [np.pad(w, (0, rate - len(w))) for w in found]


def _trajectory(spark: SparkSession, folder: str) -> DataFrame:
    rows = _values(spark, folder).select("user_id", F.col("x").cast("array<double>").alias("samples"), F.array(*(F.lit(float(k)) for k in range(1, 9))).alias("reference"))
    found = windows.similarity_trajectory(rows, _ramp, 8, 1.0, 0.5, batch=64)
    return found.select("user_id", F.posexplode("similarities").alias("nth", "similarity"))


@query(f"""
with {TYPES_SQL}, e as (select user_id, value, (row_number() over (partition by user_id order by ts, event_id) - 1) as pos, count(*) over (partition by user_id) as n from events),
segments as (select user_id, pos // 8 as w, list(value order by pos) as v from e where pos // 8 <= greatest(0, n // 8 - 1) group by 1, 2),
s as (select user_id, w, list_cosine_similarity(list_resize(v, 8, 0.0), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) as c from segments where len(v) >= 4),
drops as (select user_id, count(*) as windows, round(case when count(*) >= 2 then arg_min(c, w) - arg_max(c, w) else 0.0 end, 6) as similarity_drop from s group by 1)
select user_id, (len(t) // 7)::int as n_frames, {_grams_sql(3)} as rep3, {_grams_sql(5)} as rep5, user_id % 3 = 0 as hit, windows::int as windows, similarity_drop from types join drops using (user_id)""")
def longform_records(spark, folder):
    """Each long utterance's frames, repetition, trajectory and drop."""
    paths = _trajectory(spark, folder).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "similarity"))), lambda s: s["similarity"]).alias("similarities"))
    rows = type_streams(spark, folder).join(paths, "user_id").select("user_id", F.col("t").alias("token_ids"), (F.col("user_id") % 3 == 0).alias("hit"), "similarities")
    found = panel.longform_records(rows)
    r = lambda c, n, d=9: F.round(c, d).alias(n)
    return found.select("user_id", "n_frames", r("repetition_rate_3gram", "rep3"), r("repetition_rate_5gram", "rep5"), "hit", F.size("similarities").alias("windows"), r("similarity_drop", "similarity_drop", 6))


# -- signals: a user's event values as samples --------------------------------------------------------

VALUES_SQL = "samples as (select user_id, list(value order by ts, event_id) as x from events group by 1)"


def _values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return rows.select("user_id", F.transform("e", lambda s: s["value"]).alias("x"))


@query(f"""
with {VALUES_SQL}, cut as (select user_id, len(x) as n, list_transform(range(0, greatest(1, len(x) - 10), 4), lambda i: sqrt(list_avg(list_transform(x[i + 1:i + 10], lambda v: v * v)) + 1e-12)) as rms from samples)
select user_id, round(list_stddev_pop(rms), 6) as energy_std, round(list_avg(list_transform(rms, lambda r: (20 * log10(r / (list_max(rms) + 1e-12) + 1e-12) < -6.0)::int::double)), 6) as pause_ratio from cut""")
def energy_pause(spark, folder):
    rows = _values(spark, folder).select("user_id", signal.energy_and_pauses(F.col("x"), F.lit(400), F.lit(-6.0)).alias("m"))
    return rows.select("user_id", F.round("m.energy_std", 6).alias("energy_std"), F.round("m.pause_ratio", 6).alias("pause_ratio"))


ROLLOFF_SQL = """
points as (select user_id, len(x) as size, unnest(x) as v, generate_subscripts(x, 1) - 1 as i from samples),
spectrum as (select user_id, size, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / size)), 2) + pow(sum(v * sin(2 * pi() * k * i / size)), 2)) as m from points, lateral (select unnest(range(size // 2 + 1)) as k) group by 1, 2, 3),
summed as (select *, sum(m) over (partition by user_id order by k) as upto, sum(m) over (partition by user_id) as total from spectrum),
rolloff as (select user_id, min(k) filter (where upto >= 0.99 * total) / any_value(size) as roll from summed group by 1)"""


@query(f"""
with {VALUES_SQL}, {ROLLOFF_SQL}, cut as (select user_id, x, roll, list_transform(range(0, greatest(1, len(x) - 10), 4), lambda i: list_avg(list_transform(x[i + 1:i + 10], lambda v: v * v)) + 1e-12) as e from samples join rolloff using (user_id))
select user_id, round(roll * 400, 6) as bandwidth_hz, roll * 13000 >= 6000 as wideband, round(len(x) / 400.0, 9) as duration_s, round(10 * log10(list_quantile_cont(e, 0.95) / list_quantile_cont(e, 0.10)), 6) as snr_db, round(list_avg(list_transform(x, lambda v: (abs(v) >= 0.999)::int::double)), 9) as clipping_ratio from cut""".replace("list_quantile_cont(e, 0.95)", "(select quantile_cont(u, 0.95) from (select unnest(e) as u))").replace("list_quantile_cont(e, 0.10)", "(select quantile_cont(u, 0.10) from (select unnest(e) as u))"))
def clip_quality(spark, folder):
    fast = signal.clip_quality(F.col("x"), F.lit(13_000))["wideband"]  # the same samples at a rate whose band may be wide
    rows = _values(spark, folder).select("user_id", signal.clip_quality(F.col("x"), F.lit(400)).alias("q"), fast.alias("wideband"))
    return rows.select(
        "user_id", F.round("q.duration_s", 9).alias("duration_s"), F.round("q.snr_db", 6).alias("snr_db"), F.round("q.clipping_ratio", 9).alias("clipping_ratio"),
        F.round("q.bandwidth_hz", 6).alias("bandwidth_hz"), "wideband",
    )


WAVES_SQL = """
waves as (select user_id, list(value / 500.0 order by ts, event_id) as x from events group by 1),
clips as (select user_id, text, 'users/' || user_id || '.wav' as path, len(x) as n, list_transform(range(0, greatest(1, len(x) - 10), 4), lambda i: list_avg(list_transform(x[i + 1:i + 10], lambda v: v * v)) + 1e-12) as e from waves join documents on doc_id = user_id),
measured as (select *, 10 * log10((select quantile_cont(u, 0.95) from (select unnest(e) as u)) / (select quantile_cont(u, 0.10) from (select unnest(e) as u))) as snr from clips)"""


@query(f"""
with {WAVES_SQL}, judged as (select *, substr(sha256('ai4bharat/Rasa::' || path), 1, 16) as clip_key, case when n > 80 then 'eval_holdout' when not n / 400.0 between 0.14 and 0.19 then 'duration_out_of_[0.14,0.19]' end as hard_reject from measured)
select clip_key, hard_reject, hard_reject is null as kept, case when hard_reject is null then concat_ws(',', case when snr < 6.0 then 'snr<6.0' end, 'narrowband') else '' end as soft_flags,
  case when hard_reject is null then n / 400.0 end as duration_s, case when hard_reject is null then 2 * n end::int as samples, case when hard_reject is null then case when user_id % 2 = 0 then 'Anagha' else 'Chinmay' end end as speaker,
  case when hard_reject is null then case when user_id % 2 = 0 then 'F' else 'M' end end as gender, case when hard_reject is null then 'Latn' end as script, case when hard_reject is null then len(regexp_extract_all(text, '{T.DIGIT}')) end::int as num_digits,
  case when hard_reject is null then 'ai4bharat/Rasa#' || user_id end as source_id, case when hard_reject is null then substr(sha256(text), 1, 16) end as transcript_hash
from judged""")
def clip_pipeline(spark, folder):
    """Source rows with WAV cells through the whole of the row pipeline: hold-out, decode, quality, resampling, voice, text, record, gate."""
    waves = _values(spark, folder).select("user_id", signal.fitted(F.transform("x", lambda v: v / 500.0)).cast("array<float>").alias("x"))
    rows = waves.join(table(spark, folder, "documents"), F.col("doc_id") == F.col("user_id"))
    path = F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".wav"))
    rows = rows.select(
        F.struct(signal.encoded(F.col("x"), F.lit(400)).alias("bytes"), path.alias("path")).alias("audio"), "text", F.when(F.col("user_id") % 2 == 0, F.lit(" female")).otherwise(F.lit("Male")).alias("gender"),
        F.col("user_id").alias("_idx"), F.size("x").alias("n"),
    )
    held = rows.filter("n > 80").select(T.clip_key(F.lit("ai4bharat/Rasa"), F.col("audio.path"), F.col("_idx")).alias("clip_key"))
    found = clips.clips(rows.drop("n"), "ai4bharat/Rasa", "CC-BY-4.0", "mr", 800, held, gates.Gates(0.14, 0.19, 6.0))
    return found.select(
        "clip_key", "gate.hard_reject", "gate.kept", F.array_join("gate.soft_flags", ",").alias("soft_flags"), F.col("meta.audio.duration_s").alias("duration_s"), F.when(F.col("samples").isNotNull(), F.size("samples")).alias("samples"),
        F.col("meta.speaker.name").alias("speaker"), F.col("meta.speaker.gender").alias("gender"), F.col("meta.text.script").alias("script"), F.col("meta.text.num_digits").alias("num_digits"),
        F.col("meta.provenance.source_id").alias("source_id"), F.col("meta.dedup.transcript_shingle_hash").alias("transcript_hash"),
    )


@query("""
select lang, count(*) as n, round(avg(n_chars), 6) as mean, quantile_disc(n_chars, 0.1)::double as p10, quantile_disc(n_chars, 0.9)::double as p90, min(n_chars)::double as least, max(n_chars)::double as most,
  round(avg((n_chars < 200)::int), 6) as flagged from documents where n_chars is not null group by 1""")
def incremental_profile(spark, folder):
    """Profiles of sources' shards, one of which comes later, and one twice."""
    docs = table(spark, folder, "documents").select(F.coalesce("source", F.lit("none")).alias("shard"), "lang", "n_chars")
    last, path = docs.agg(F.max("shard")).first()[0] or "none", new_place(spark, "profiles")
    for part in (docs.filter(F.col("shard") != last), docs.filter(F.col("shard") == last), docs.filter(F.col("shard") == last)):
        profiles.add(part, path, "shard", "lang", "n_chars", F.col("n_chars") < 200)
    found = profiles.profile(spark, path, "lang")
    return found.select("lang", "n", F.round("mean", 6).alias("mean"), F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"), "least", "most", F.round("flagged", 6).alias("flagged"))


@query(f"with {VALUES_SQL} select user_id, round(list_sum(list_transform(x, lambda v: greatest(least((v - 250) / 200, 1.0), -1.0))), 6) as total, len(list_filter(x, lambda v: abs((v - 250) / 200) > 1)) as held from samples")
def clamped_samples(spark, folder):
    """Samples beyond full scale are held to it."""
    rows = _values(spark, folder).select("user_id", F.transform("x", lambda v: (v - 250) / 200).alias("x"))
    clamped = signal.clamped(F.col("x"))
    moved = F.size(F.filter(F.arrays_zip(clamped.alias("a"), F.col("x").alias("b")), lambda p: p["a"] != p["b"]))
    return rows.select("user_id", F.round(F.aggregate(clamped, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), moved.cast("long").alias("held"))


@query()
def prosody_measures(spark, folder):
    return _values(spark, folder).select("user_id", signal.prosody(F.col("x"), F.lit(400)).alias("p")).select("user_id", "p.*")


@query("select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90, min(value) as least, max(value) as most, round(avg((value < 10)::int), 6) as flagged from events group by 1")
def quality_profile_percentiles(spark, folder):
    found = metrics.profile(table(spark, folder, "events"), "event_type", "value", F.col("value") < 10)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p10", "p90")), "least", "most", F.round("flagged", 6).alias("flagged"))


@query("select source, round(median(n_chars / 100.0), 6) as median_snr, round(avg(coalesce((toxic = 0)::int, 1)), 6) as wideband_fraction, median(n_chars / 100.0) >= 15.0 and avg(coalesce((toxic = 0)::int, 1)) >= 0.9 as passes from documents left join labels using (doc_id) group by 1")
def preflight_switch(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    rows = rows.select("source", (F.col("n_chars") / 100.0).alias("snr_db"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("wideband"))
    found = gates.preflight(rows, least_snr=15.0)
    return found.withColumn("median_snr", F.round("median_snr", 6)).withColumn("wideband_fraction", F.round("wideband_fraction", 6))


@query("""
with drawn as (select *, row_number() over (partition by source order by sha256(doc_id::varchar), doc_id) as nth from documents)
select source, round(median(n_chars / 100.0), 6) as median_snr, round(avg(coalesce((toxic = 0)::int, 1)), 6) as wideband_fraction, median(n_chars / 100.0) >= 15.0 and avg(coalesce((toxic = 0)::int, 1)) >= 0.9 as passes
from drawn left join labels using (doc_id) where nth <= 64 group by 1""")  # fmt: skip
def preflight_sample(spark, folder):
    """The switch as it is declared: 64 clips of each source."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "source", (F.col("n_chars") / 100.0).alias("snr_db"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("wideband"))
    found = gates.preflight(rows, least_snr=15.0, sample=64, key="doc_id")
    return found.withColumn("median_snr", F.round("median_snr", 6)).withColumn("wideband_fraction", F.round("wideband_fraction", 6))


@query("select event_type as bucket, round(coalesce(avg(case when event_type = 'error' then null else value end), 'nan'::double), 6) as mean_f0, round(avg(value) - avg(value * 0.5), 6) as delta from events group by 1")
def prosody_means(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("bucket"), F.when(F.col("event_type") != "error", F.col("value")).alias("mean_f0"), F.col("value").alias("f0_std"), (F.col("value") * 0.5).alias("energy_std"), F.lit(0.5).alias("pause_ratio"))
    return panel.prosody_means(rows).select("bucket", F.round("mean_f0", 6).alias("mean_f0"), F.round(F.col("f0_std") - F.col("energy_std"), 6).alias("delta"))


@query("select event_id as id, case when event_type <> 'error' then value - 100 end as delta_mean_f0, value - user_id as delta_f0_std, (0.5 - 0.25)::double as delta_energy_std, null::double as delta_pause_ratio from events")
def prosody_deltas(spark, folder):
    rows = table(spark, folder, "events")
    gap = F.lit(None).cast("double")
    made = rows.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("value")).alias("mean_f0"), F.col("value").alias("f0_std"), F.lit(0.5).alias("energy_std"), gap.alias("pause_ratio"))
    real = rows.select(F.col("event_id").alias("id"), F.lit(100.0).alias("mean_f0"), F.col("user_id").cast("double").alias("f0_std"), F.lit(0.25).alias("energy_std"), F.lit(0.5).alias("pause_ratio"))
    return panel.prosody_deltas(made, real)


@query("select event_type as bucket, coalesce(format('{:.3f}', avg(value) filter (where event_type <> 'error')), '—') as cell, to_json({'bucket': event_type, 'n': count(*)}) as row_json from events group by 1")
def report_cells(spark, folder):
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("v"))
    return rows.select("bucket", T.shown(F.col("v")).alias("cell"), F.to_json(F.struct("bucket", "n")).alias("row_json"))


# -- parameters --------------------------------------------------------------------------------------


@query("select * from (values ('q_proj', 28::bigint, 28 * 32 * (3072 + 3072)::bigint), ('v_proj', 28, 28 * 32 * (3072 + 1024)), ('up_proj', 17, 17 * 32 * (3072 + 8192)), ('gate_proj', 17, 17 * 32 * (3072 + 8192))) t(projection, modules, parameters)")
def expected_adapter_params(spark, folder):
    rows = parameters.targets(spark, 28, (8, 24))
    return parameters.adapter_parameters(rows, hidden=3072, heads=24, kv_heads=8, head_dim=128, intermediate=8192, rank=32)


@query("""select sum(case when p_partkey % 5 = 0 then p_size else 0 end)::bigint as trainable, sum(p_size)::bigint as total, round(100.0 * sum(case when p_partkey % 5 = 0 then p_size else 0 end) / sum(p_size), 6) as percent, 0::bigint as frozen_adapters, 0::bigint as trained_base,
  format('trainable params: {:,} || all params: {:,} || trainable%: {:.4f}', sum(case when p_partkey % 5 = 0 then p_size else 0 end)::bigint, sum(p_size)::bigint, 100.0 * sum(case when p_partkey % 5 = 0 then p_size else 0 end) / sum(p_size)) as summary from part""")
def freeze_report(spark, folder):
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("lora_")).otherwise(F.lit("base_")), F.col("p_partkey").cast("string"))
    rows = parameters.frozen(table(spark, folder, "part").select(name.alias("name"), F.col("p_size").alias("numel")))
    return parameters.freeze_report(rows).withColumn("percent", F.round("percent", 6))


@query("select * from (values ('Anagha', 'mr', 'F'), ('Chinmay', 'mr', 'M')) t(name, language, gender)")
def target_voices(spark, folder):
    rows = voices.roster(spark).filter(F.col("name").isin(*voices.native_voices("mr")) & voices.is_known(F.col("name")))
    return rows.select("name", voices.native_language(F.col("name")).alias("language"), voices.voice_gender(F.col("name")).alias("gender"))


# -- streaming ----------------------------------------------------------------------------------------


@query("select count(*) as n, sum(n_chars) as chars, count(*) filter (where lang = 'en') as english from documents where n_chars between 360 and 7200")
def stream_ingest_gate(spark, folder):
    docs = table(spark, folder, "documents")
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # files as the scan deals them, four at least; four micro-batches at any size
    (docs if docs.rdd.getNumPartitions() >= 4 else docs.repartition(4)).write.parquet(f"{place}/in")
    files = len(spark.read.schema(docs.schema).parquet(f"{place}/in").inputFiles())

    def gate(rows: DataFrame) -> DataFrame:
        reject = gates.hard_reject(F.lit("CC0"), F.col("n_chars") / 12.0, F.col("text"), gates.Gates(30.0, 600.0))
        return rows.filter(reject.isNull()).select("doc_id", "lang", "n_chars")

    ingest.ingest(spark, f"{place}/in", docs.schema, gate, f"{place}/out", f"{place}/checkpoint", math.ceil(files / 4)).awaitTermination()
    out = spark.read.schema("doc_id bigint, lang string, n_chars bigint").parquet(f"{place}/out")
    return out.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "en").alias("english"))


@query("""
with series as (select user_id % 3 as run, date_diff('hour', timestamp '2024-01-01', ts) as step, event_type as bucket, avg(value) as wer from events group by 1, 2, 3),
due as (select * from series where step % 6 = 0 and step <> 0),
base as (select run, bucket, wer as base from due d where step = (select min(step) from due where run = d.run)),
compared as (select run, step, bucket, wer, (wer - base) / greatest(base, 1e-6) as regression from due left join base using (run, bucket)),
steps as (select run, step, greatest(coalesce(max(regression), 0.0), 0.0) as worst from compared group by 1, 2)
select run::varchar as run, step, bucket, round(wer, 6) as wer, round(regression, 6) as regression, round(worst, 6) as worst, worst > 0.15 as alert, worst > 0.15 as marked from compared join steps using (run, step)""")
def monitor_records(spark, folder):
    """Three runs' evaluations as a stream that is stopped and started again over its checkpoint; a record for each due step."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    events = table(spark, folder, "events").withColumns({"run": (F.col("user_id") % 3).cast("string"), "step": hour})
    series = written(monitoring.evaluations(events.groupBy("run", "step", F.col("event_type").alias("bucket")).agg(F.avg("value").alias("wer"))), "evaluations")
    place, half = new_place(spark, "monitor"), series.agg((F.max("step") / 2).cast("long")).first()[0] or 0
    for part in (F.col("step") <= half, F.col("step") > half):
        series.filter(part).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(series.schema).parquet(f"{place}/in")
        monitoring.watch(stream, f"{place}/records", f"{place}/marker", f"{place}/checkpoint", 6).awaitTermination()
    kind = "run string, step bigint, wer map<string, double>, relative_regression map<string, double>, worst double, alert boolean"
    kept, raised = (spark.read.schema(kind).json(f"{place}/{x}/*") if x == "records" or _any_file(spark, f"{place}/{x}") else spark.createDataFrame([], kind) for x in ("records", "marker"))
    rows = kept.select("run", "step", "worst", "alert", "relative_regression", F.explode("wer").alias("bucket", "wer")).join(raised.select("run", "step", F.lit(True).alias("marked")), ["run", "step"], "left")
    return rows.select("run", "step", "bucket", F.round("wer", 6).alias("wer"), F.round(F.try_element_at("relative_regression", F.col("bucket")), 6).alias("regression"), F.round("worst", 6).alias("worst"), "alert", F.coalesce("marked", F.lit(False)).alias("marked"))


def _any_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@query("select * from (values ('q_proj', 1), ('v_proj', 1), ('up_proj', 17), ('gate_proj', 17)) t(projection, names)")
def adapter_target_names(spark, folder):
    """The names that an adapter library is given: two that hold for all layers, and two modules for each of 17 layers."""
    names = spark.createDataFrame([(n,) for n in parameters.target_names(parameters.targets(spark, 28, (8, 24)))], "name string")
    return names.groupBy(T.basename(F.translate("name", ".", "/")).alias("projection")).agg(F.count("*").cast("int").alias("names"))
