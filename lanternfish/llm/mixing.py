"""Mixing sources to target weights in fixed-length blocks.

Each source's words are packed, document after document, into blocks of ``BLOCK`` words; the last block of a source may be
shorter. A mix is a sequence of slots, dealt to output shards of ``SLOTS_PER_SHARD`` slots. The slots of all sources, one
source after another, go to places by one pseudorandom permutation of all places, so the counts by source of a
shard are a multinomial draw from what the sources' quotas still hold, and every quota is met exactly. The k-th slot of a
source takes the block that a pseudorandom permutation of the source's full blocks gives, another one for each epoch;
its short block comes first in an epoch. The last slot of a source takes the first words of its block only, as many as
the target lacks. Slots meet blocks in a join by source and block number.

Targets share all words by weight; a source stops at ``MAX_EPOCHS`` times its size, and the excess is shared
again by weight among the others. Only sums for each source reach the driver, at most ``MAX_SOURCES``; draws and
slots are made in tasks.

Scale: documents move once, to a part of their source, a hash of id and text of about ``ROWS_PER_PART`` rows; offsets
of the parts come from their sums. A hot source is many parts, its slots are made in runs of ``RUN``, and its blocks spread
by number.

Defined results: a null text has no words and takes none; null is a source of its own, the last; repeated rows
are packed one after the other, and rows that tie in id and size are ordered by their text's hash; an empty table
gives no rows; other columns are ignored, whatever their names; a text of any length is packed whole, over as many
blocks as it fills. All on the rows is DataFrame operations, and the same rows give the same mix.
"""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, table, words

BLOCK = 128
MAX_EPOCHS = 3
MAX_SOURCES = 100_000
ROWS_PER_PART = 2048
SLOTS_PER_SHARD = 4096
#: Slots of a source that are made from one row, and slots that a task makes at least.
RUN, SLOTS_PER_TASK = 1 << 14, 1 << 16
MOST_TASKS = 20_000
SEED = 20240229
#: Rounds of a permutation.
ROUNDS = 12


def targets(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """Share sum(sizes) by weight, no share above most times its size."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        left = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def permuted(rows: DataFrame, x: str, n: str, salt: str) -> DataFrame:
    """Replace x, from 0 to n - 1, by its place in a pseudorandom permutation of these numbers.

    Each round pairs every number with another by a sum modulo n, and swaps the two or not by a hash of the greater.
    That is a bijection for every n, so nothing has to be drawn again. Rounds are projections, which
    compile to one loop.
    """
    for r in range(ROUNDS):
        sum_ = F.pmod(F.xxhash64(salt, F.lit(r)), F.col(n))
        rows = rows.withColumn("_other", sum_ - F.col(x))
        rows = rows.withColumn("_other", F.when(F.col("_other") < 0, F.col("_other") + F.col(n)).otherwise(F.col("_other")))
        swap = F.xxhash64(salt, F.lit(r), F.greatest(x, "_other")).bitwiseAND(F.lit(1)) == 1
        rows = rows.withColumn(x, F.when(swap, F.col("_other")).otherwise(F.col(x)))
    # a generator's output hides what it is made of: filters on it are not pushed into the rounds, which would multiply them
    return rows.withColumn(x, F.explode(F.array(x))).drop("_other")


def _packed(docs: DataFrame, text: str, source: str, ident: str, carry: list[str]) -> tuple[DataFrame, list]:
    """Rows (id, source, size, first word's place in the source), and (source, size, rows) by source."""
    body = F.col(f"`{text}`")
    rows = checkpointed(docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.size(words(body)).cast("bigint").alias("size"), F.xxhash64(body).alias("_text"), *carry))
    seen = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = seen.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sorted(((r["source"], r["size"], r["n"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    parts = max(1, -(-sum(n for _, _, n in sums) // ROWS_PER_PART))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(parts)))
    by_part = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("doc_id", "size", "_text", *carry).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside)
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["_source"]) & (placed["part"] == offsets["_part"]))
    return joined.select("doc_id", "source", "size", (F.col("part_start") + F.col("inside")).alias("start"), *carry), sums


def slots_for(goal: int, size: int) -> tuple[int, int]:
    """How many slots a source of so many words needs for goal words, and how many words its last slot takes too many."""
    if not goal:
        return 0, 0
    blocks, first = -(-size // BLOCK), size % BLOCK or BLOCK
    epochs, rest = divmod(goal, size)
    if not rest:
        return epochs * blocks, 0
    more = 1 + max(0, -(-(rest - first) // BLOCK))
    return epochs * blocks + more, first + (more - 1) * BLOCK - rest


def plan(sums: list, weights: tuple = (5, 2, 1), seed: int = SEED) -> list[dict]:
    """For each source: size, target, blocks, slots in the mix, the place of its first slot, and the salt of its permutations."""
    goal = targets([s for _, s, _ in sums], [weights[i % len(weights)] for i in range(len(sums))])
    rng, out, base = Random(seed), [], 0
    for i, ((name, size, _), t) in enumerate(zip(sums, goal)):
        quota, excess = slots_for(min(round(t), MAX_EPOCHS * size), size)
        out.append({"source_no": i, "source": name, "source_size": size, "target": t, "full": size // BLOCK, "tail": size % BLOCK, "quota": quota, "excess": excess, "base": base, "salt": rng.getrandbits(30)})
        base += quota
    return out


def dealt_slots(spark, sources: list[dict], seed: int = SEED) -> DataFrame:
    """(shard, place, source_no, epoch, block, upto) of each slot; upto: how many words of the block it takes."""
    total = sum(s["quota"] for s in sources)
    fields = ["source_no", "full", "tail", "quota", "excess", "base", "salt"]
    listed = spark.createDataFrame([tuple(s[f] for f in fields) for s in sources if s["quota"]], T.StructType([T.StructField(f, T.IntegerType() if f == "source_no" else T.LongType()) for f in fields]))
    runs = listed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / RUN))).alias("run"))
    runs = runs.repartition(min(MOST_TASKS, max(8, -(-total // SLOTS_PER_TASK))), "source_no", "run")
    last = F.least((F.col("run") + 1) * RUN, F.col("quota")) - 1
    slots = runs.select("*", F.explode(F.sequence(F.col("run") * RUN, last)).alias("k")).drop("run")
    slots = permuted(slots.withColumn("place", F.col("base") + F.col("k")).withColumn("_n", F.lit(max(1, total))).withColumn("_salt", F.lit(seed)), "place", "_n", "_salt")
    blocks = F.col("full") + (F.col("tail") > 0).cast("int")
    slots = slots.withColumn("epoch", F.floor(F.col("k") / blocks)).withColumn("_at", F.col("k") % blocks - (F.col("tail") > 0).cast("int"))
    slots = slots.withColumn("_short", F.col("_at") < 0).withColumn("block", F.greatest("_at", F.lit(0).cast("bigint"))).withColumn("_salt", F.xxhash64("salt", "epoch")).withColumn("_n", F.greatest("full", F.lit(1).cast("bigint")))
    slots = permuted(slots, "block", "_n", "_salt")
    size = F.when(F.col("_short"), F.col("tail")).otherwise(F.lit(BLOCK))
    upto = size - F.when(F.col("k") == F.col("quota") - 1, F.col("excess")).otherwise(0)
    return slots.select(F.floor(F.col("place") / SLOTS_PER_SHARD).alias("shard"), "place", "source_no", "epoch", F.when(F.col("_short"), F.col("full")).otherwise(F.col("block")).alias("block"), upto.alias("upto"))


def mixed_parts(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", weights: tuple = (5, 2, 1), seed: int = SEED, carry: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The packed documents with their source's plan, what the slots take of them, and the plan.

    Parts: doc_id, source_no, start, size, block, epoch, shard, from_word, n_words and the carried columns.
    """
    spark = docs.sparkSession
    packed, sums = _packed(docs, text, source, ident, list(carry))
    sources = plan(sums, weights, seed)
    fields = [("source_no", T.IntegerType()), ("_name", packed.schema["source"].dataType), ("source_size", T.LongType()), ("target", T.DoubleType())]
    listed = spark.createDataFrame([(s["source_no"], s["source"], s["source_size"], s["target"]) for s in sources], T.StructType([T.StructField(n, t) for n, t in fields]))
    # bounded by MAX_SOURCES
    packed = packed.join(F.broadcast(listed), packed["source"].eqNullSafe(listed["_name"])).drop("_name")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = packed.where("size > 0").select("doc_id", "source_no", "start", "size", *carry, F.explode(F.sequence(first, last)).alias("block"))
    # both sides grow with the words: few runs make many slots, which size estimates don't see
    met = pieces.join(dealt_slots(spark, sources, seed).hint("merge"), ["source_no", "block"])
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("upto"))
    parts = met.where(high > low).withColumn("from_word", low - F.col("start")).withColumn("n_words", high - low).drop("upto", "place")
    return packed, parts, listed


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words in the mix, repeats counted) and first_shard of each document.

    first_shard is the first output shard with words of the document, null where the mix leaves it out.
    """
    packed, parts, _ = mixed_parts(docs, **how)
    got = parts.groupBy("source_no", "start", "doc_id").agg(F.sum("n_words").alias("got"), F.min("shard").alias("first_shard"))
    got = got.select(F.col("source_no").alias("_no"), F.col("start").alias("_start"), "got", "first_shard")
    # documents with words start at different places of their source
    out = packed.join(got, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: for each epoch a row with what the mix takes of a document, with the columns of docs.

    A row whose words are all taken keeps its text as it is; else its taken words stand in order, a space
    between. n_chars, where docs have it, is counted again. Documents that the mix leaves out go. Texts move once, to
    the plan made without them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select("doc_id", "source", "text", F.struct(*columns).alias("_doc"), F.md5(F.to_json(F.struct(*columns))).alias("_row"))
    _, parts, _ = mixed_parts(keyed.select("doc_id", "source", "text", "_row"), carry=["_row"], **how)
    spans = F.array_sort(F.collect_list(F.struct("from_word", "n_words")))
    taken = parts.groupBy("_row", "source_no", "start", "size", "epoch").agg(spans.alias("_spans"), F.sum("n_words").alias("_n"))
    taken = taken.select("_row", "_spans", (F.col("_n") == F.col("size")).alias("_whole"))
    met = keyed.select("_row", "_doc").dropDuplicates(["_row"]).join(taken, "_row")
    met = met.withColumn("_words", F.when(~F.col("_whole"), words(F.col("_doc.text"))))
    part = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice("_words", (s["from_word"] + 1).cast("int"), s["n_words"].cast("int")))), " ")
    met = met.withColumn("_text", F.when(F.col("_whole"), F.col("_doc.text")).otherwise(part))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return met.select(*[made.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def op10_query(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
