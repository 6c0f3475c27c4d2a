"""Mixing sources to target weights by highest quotients (Sainte-Lague), in DataFrame operations only.

Sizes are words.  Each source's target is its weighted share of all words, at most ``most_repeats``
times what it has; what is above is shared again by weight.  All words are cut into ``n_blocks``
equal blocks; the blocks go to sources by the highest quotients target / (2k + 1), which gives
whole numbers of blocks, and are dealt to shards in turn, which gives each source a whole number of
blocks in each shard.  Only a few quotients near each source's share are compared, as all others
are certain to win or to lose.

Then blocks are chosen.  A source's documents are laid out in a seeded order and cut into blocks; it takes
whole passes over them, and of the next pass the blocks that a seeded phase picks, evenly spread:
block i of n goes into the r that are left when (i * r + phase) mod n < r.  Copies of blocks are numbered in
the order of passes, and each shard takes as many of them as its quota says.

Positions come from per-bucket totals (first digits of the seeded hash), so a source that holds a
third of all rows is spread over many small windows.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source, the
last one; ties are broken by doc_id and size, so rows that are equal may change places, with the
same result; an empty table gives no rows; without any word all targets are 0; input columns other
than doc_id, text and source are ignored, and ``mix_documents`` hands all of them through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from spindrift.storage import keep


WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Blocks that all words are cut into: a source misses its target by about a block at most.
N_BLOCKS = 1 << 20
MOST_REPEATS = 3
SEED = 11
BUCKET_DIGITS = 3
N_SHARDS = 8


def _tag():
    """Tells rows apart that share a doc_id, or have none."""
    return F.xxhash64(F.col("text").cast("string"), F.lit(SEED))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _tag().alias("tag"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(sid, source, source_size, target, total) of every source of sized(source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    )
    # water level: fill sources from the one that is full first
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    return (
        src.withColumn("total", F.sum("source_size").over(every)).withColumn("level", level)
        .withColumn("lambda", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(every)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("lambda") * F.col("weight")), F.lit(0.0)))
        .select("sid", "source", "source_size", "target", "total")
    )


def block_quotas(targets: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """targets plus block (words in a block) and quota (blocks that the source gets)."""
    every = Window.partitionBy()
    t = (
        targets.withColumn("block", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / n_blocks).cast("long")))
        .withColumn("blocks", F.expr("total div block"))
        .withColumn("near", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
        .withColumn("off", F.abs(F.col("blocks") - F.sum("near").over(every)) + F.count("*").over(every))
        .withColumn("reach", F.ceil(F.col("target") / F.greatest(F.col("total"), F.lit(1)) * F.col("off")).cast("long") + 1)
        .withColumn("sure", F.greatest(F.lit(0).cast("long"), F.col("near") - F.col("reach")))
        .withColumn("open", F.col("blocks") - F.sum("sure").over(every))
    )
    seats = (
        t.where("target > 0").select("sid", "target", "open", F.explode(F.sequence("sure", F.col("sure") + 2 * F.col("reach"))).alias("k"))
        .withColumn("rank", F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "sid", "k")))
        .where("rank <= open").groupBy("sid").agg(F.count("*").alias("won"))
    )
    return t.join(seats, "sid", "left").select("sid", "source", "source_size", "target", "total", "block", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def shard_quotas(quotas: DataFrame, n_shards: int) -> DataFrame:
    """(sid, source, shard, blocks): blocks are numbered source by source and dealt to shards in turn."""
    before = F.coalesce(F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = lambda n: F.floor((n - 1 - F.col("shard") + n_shards) / n_shards)
    return (
        quotas.withColumn("before", before).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        .select("sid", "source", "shard", (upto(F.col("before") + F.col("quota")) - upto(F.col("before"))).cast("long").alias("blocks"))
    )


def _digits(text, digits: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, n_blocks: int = N_BLOCKS, most_repeats: int = MOST_REPEATS, seed: int = SEED, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, source, tag, size, source_size, target, taken, shard_words) for documents(doc_id, text, source); shard_words adds up to taken."""
    sized = keep(_sized(docs))
    phase = _digits(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00null"))), 12) % F.col("n")
    quotas = (
        block_quotas(source_targets(sized, weights, most_repeats), n_blocks)
        .withColumn("n", F.expr("greatest(1L, cast(ceil(source_size / block) as bigint))")).withColumn("quota", F.least("quota", F.col("n") * most_repeats))
    )
    quotas = keep(quotas.withColumn("passes", F.expr("quota div n")).withColumn("r", F.expr("quota % n")).withColumn("phase", phase))
    # a row for each source and shard: in shard g the source's copies from starts[g] to starts[g + 1]
    dealt = shard_quotas(quotas, n_shards).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("q"))
    starts = dealt.select("sid", F.expr(f"transform(sequence(0, {n_shards}), g -> aggregate(slice(q, 1, g), 0L, (s, x) -> s + x.blocks))").alias("starts"))
    # copy o of the last pass is block (o' n - phase) / r, rounded up, where o' leaves out a first block that isn't picked
    marks = "transform(starts, s -> if(s - passes * n >= r, n, ((greatest(s - passes * n, 0L) + int(phase >= r)) * n - phase + r - 1) div greatest(r, 1L)))"
    sources = keep(quotas.join(starts, "sid").withColumn("marks", F.expr(marks)).select("sid", "source", "source_size", "target", "block", "n", "passes", "r", "phase", "starts", "marks"))

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.join(sources.select("sid", F.col("source").alias("its_source")), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source").withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.withColumn("ahead", F.sum("held").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).drop("held")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, ["sid", "bucket"]).withColumn("at", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    # a document's words in blocks b0 to b1: of each whole pass a shard has a run of blocks, of the last one the picked among a run
    whole = " + ".join(f"int({p} < passes) * greatest(0L, least(at + size, least(get(starts, g + 1) - {p} * n, n) * block) - greatest(at, greatest(get(starts, g) - {p} * n, 0L) * block))" for p in range(most_repeats))
    picked = lambda i: f"int(({i} * r + phase) % n < r)"
    before = lambda x: f"if({x} <= 0, 0L, (({x} - 1) * r + phase) div n - int(phase >= r) + 1)"
    last = lambda lo, hi: (
        f"(block * if(least({hi}, b1) > greatest({lo}, b0 + 1), {before(f'least({hi}, b1)')} - ({before(f'greatest({lo}, b0 + 1)')}), 0L)"
        f" + int(b0 >= {lo} and b0 < {hi}) * {picked('b0')} * (least(at + size, (b0 + 1) * block) - at) + int(b1 > b0 and b1 >= {lo} and b1 < {hi}) * {picked('b1')} * (at + size - b1 * block))"
    )
    of_shard = f"transform(sequence(0, {n_shards - 1}), g -> {whole} + {last('get(marks, g)', 'get(marks, g + 1)')})"
    return (
        placed.drop("source").join(sources, "sid").withColumns({"b0": F.expr("at div block"), "b1": F.expr("(at + greatest(size, 1L) - 1) div block")})
        .withColumn("shard_words", F.expr(f"if(size > 0, {of_shard}, array_repeat(0L, {n_shards}))")).withColumn("taken", F.expr(f"if(size > 0, passes * size + {last('0L', 'n')}, 0L)"))
        .select("doc_id", "source", "tag", "size", "source_size", "target", "taken", "shard_words")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as many times as its words are taken, rounded to whole documents.

    Rounding moves a source by less than a word in two for each of its blocks that cuts a document.  Rows that
    share doc_id, source and text get the rounded mean of what is taken of them.
    """
    plan = mix_plan(docs, **options).where("size > 0")
    times = plan.groupBy("doc_id", "source", "tag").agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times")).where("times > 0")
    rows = docs.where(F.col("text").cast("string").rlike(WORD)).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), _tag().alias("t"))
    mixed = rows.join(times, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("t") == F.col("tag")))
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shard_words", ",").alias("shard_words"))


#: Every quotient is enumerated here, which the operator avoids, and blocks are dealt to shards one by one.
OP7_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), src as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as sid from sized group by source
), w as (
  select *, cast([1, 2, 3][(sid - 1) % 3 + 1] as double) as weight, cast(source_size * 3 as double) as cap, cast(sum(source_size) over () as bigint) as total from src
), lv as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as level from w
), la as (
  select level as lambda from lv where level <= cap / weight order by cap / weight, sid limit 1
), t as (
  select lv.*, least(cap, la.lambda * weight) as target, greatest(1, cast(ceil(total / 1048576::double) as bigint)) as block from lv, la
), seats as (
  select sid, target / (2 * k + 1) as quotient, k from (select sid, target, unnest(range(0, cast(floor(target / block) as bigint) + 25)) as k from t where target > 0)
), won as (
  select sid, count(*) as quota from (select sid, row_number() over (order by quotient desc, sid, k) as rk from seats)
  where rk <= (select max(total // block) from t) group by sid
), s as (
  select *, quota // n as passes, quota % n as r, ('0x' || substr(md5('11:' || coalesce(source, chr(0) || 'null')), 1, 12))::bigint % n as phase
  from (select t.*, n, least(coalesce(quota, 0), 3 * n) as quota from (select *, greatest(1, cast(ceil(source_size / block::double) as bigint)) as n from t) t left join won using (sid))
), numbered as (
  select sid, coalesce(sum(quota) over (order by sid rows between unbounded preceding and 1 preceding), 0)::bigint as before, quota from s
), dealt as (
  select sid, list(cast(coalesce(blocks, 0) as bigint) order by shard) as q from (select sid, shard, (select count(*) from range(before, before + quota) u(x) where x % 8 = shard) as blocks
    from numbered, range(8) g(shard)) group by sid
), starts as (
  select sid, list_transform(range(9), lambda g: coalesce(list_sum(q[1:g]), 0)::bigint) as starts from dealt
), p as (
  select d.*, s.*exclude (source), starts.starts,
    cast(sum(size) over (partition by s.sid order by md5('11:' || coalesce(cast(doc_id as varchar), 'null')), doc_id, size rows unbounded preceding) as bigint) - size as pos
  from sized d join s on d.source is not distinct from s.source join starts on starts.sid = s.sid
), parts as (
  select *, unnest(range(pos // block, case when size > 0 then (pos + size - 1) // block + 1 else pos // block + 1 end)) as i from p
), copies as (
  select *, greatest(0, least(pos + size, (i + 1) * block) - greatest(pos, i * block)) as words,
    list_concat(list_transform(range(passes), lambda x: x * n + i), case when (i * r + phase) % n < r then [passes * n + (i * r + phase) // n - (phase >= r)::int] else [] end) as us
  from parts
), shares as (
  select doc_id, size, source_size, target, pos, sid, list_transform(range(8), lambda g: words * len(list_filter(us, lambda u: u >= starts[g + 1] and u < starts[g + 2]))) as part from copies
)
select doc_id, size, source_size, target, (sum(part[1]) + sum(part[2]) + sum(part[3]) + sum(part[4]) + sum(part[5]) + sum(part[6]) + sum(part[7]) + sum(part[8]))::bigint as taken,
  concat_ws(',', sum(part[1])::bigint, sum(part[2])::bigint, sum(part[3])::bigint, sum(part[4])::bigint, sum(part[5])::bigint, sum(part[6])::bigint, sum(part[7])::bigint, sum(part[8])::bigint) as shard_words
from shares group by doc_id, size, source_size, target, pos, sid
"""
