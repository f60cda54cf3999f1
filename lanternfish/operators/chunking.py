"""Markdown documents to section-aware chunks of bounded size.

Lines become rows, a section is a running count of headings, a unit a running count of boundaries, and the joining
of small units one fold over a section's units, which only carries their additive token counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

CHUNKER_VERSION = 1


@dataclass(frozen=True)
class ChunkOptions:
    target_tokens: int = 350
    min_tokens: int = 40
    max_tokens: int = 500
    overlap_ratio: float = 0.15  # part of the fingerprint only


def lines_of(docs: DataFrame, key: str = "source", body: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no, line, heading, is_heading, is_list, is_bold, blank, section_id) of each line, and carried columns."""
    split = docs.select(key, *carry, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\r?\n")).alias("line_no", "line"))
    line = F.col("line")
    flags = split.select("*", X.is_heading(line).alias("is_heading"), X.is_list_item(line).alias("is_list"), X.is_bold_label(line).alias("is_bold"), X.is_blank(line).alias("blank"), X.heading_text(line).alias("heading"))
    order = Window.partitionBy(key).orderBy("line_no")
    return flags.withColumn("section_id", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _in_order(key: Column, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])


def sections_of(lines: DataFrame, key: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, section_id, heading, slug, occurrence, text, tokens, list_items, bold_labels) of each non-empty section."""
    heading = F.coalesce(F.max(F.when(F.col("is_heading"), F.col("heading"))), F.lit("root"))
    grouped = lines.groupBy(key, "section_id").agg(
        heading.alias("heading"),
        X.trim(F.array_join(_in_order(F.col("line_no"), F.col("line")), "\n")).alias("text"),
        F.sum(F.col("is_list").cast("bigint")).alias("list_items"),
        F.sum(F.col("is_bold").cast("bigint")).alias("bold_labels"),
        *[F.max(c).alias(c) for c in carry],
    )
    kept = grouped.where("text <> ''").withColumn("slug", X.slugify(F.col("heading"))).withColumn("tokens", X.estimate_tokens(F.col("text")))
    order = Window.partitionBy(key, "slug").orderBy("section_id")
    return kept.withColumn("occurrence", F.row_number().over(order) - 1)


def units_of(lines: DataFrame, key: str = "source") -> DataFrame:
    """(key, section_id, unit_no, unit) of each non-empty unit: a paragraph, list item, label or heading."""
    order = Window.partitionBy(key, "section_id").orderBy("line_no")
    begins = F.lag("blank").over(order).isNotNull() & ~F.col("blank") & (F.lag("blank").over(order) | F.col("is_heading") | F.col("is_bold") | F.col("is_list"))
    marked = lines.withColumn("begins", begins.cast("int"))
    numbered = marked.withColumn("unit_no", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(key, "section_id", "unit_no").agg(X.trim(F.array_join(_in_order(F.col("line_no"), F.col("line")), "\n")).alias("unit"))
    return grouped.where("unit <> ''")


def word_windows(text: Column, target: int, most: int) -> Column:
    """Windows of ``most`` words, ``target`` words apart."""
    kept = F.filter(F.split(text, f"[{X.WS}]+"), lambda w: w != F.lit(""))
    starts = F.when(F.size(kept) > 0, F.sequence(F.lit(1), F.size(kept), F.lit(target))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(kept, i, most), " "))


_PART = "struct<lo:int,hi:int,windows:boolean,latin:bigint,cjk:bigint,rest:bigint>"


def _fold(units: Column, o: ChunkOptions) -> Column:
    """Ranges of units that become one chunk each, as an array of _PART.

    windows: unit lo is too long and cut into windows; units lo + 1 to hi, if any, belong to its last window.
    """

    def size(x: Column) -> Column:
        return X.token_sum(x["latin"], x["cjk"], x["rest"])

    def part(lo: Column, hi: Column, windows: Column, sums: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), windows.alias("windows"), *[sums[c].alias(c) for c in ("latin", "cjk", "rest")]).cast(_PART)

    def plus(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in ("latin", "cjk", "rest")])

    none = F.lit(None).cast(_PART)
    no = F.lit(False)
    start = F.struct(F.array().cast(f"array<{_PART}>").alias("out"), none.alias("open"))

    def state(out: Column, open_: Column) -> Column:
        return F.struct(out.alias("out"), open_.alias("open"))

    def flushed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"])))

    def step(s: Column, u: Column) -> Column:
        alone = part(u["no"], u["no"], no, u)
        grown = F.when(s["open"].isNull(), alone).otherwise(part(s["open"]["lo"], u["no"], no, plus(s["open"], u)))
        joins = s["open"].isNotNull() & (size(grown) <= o.max_tokens)
        # a small unit joins what is open, or opens anew where that would be too much
        small_out = F.when(s["open"].isNull() | joins, s["out"]).otherwise(flushed(s))
        small_open = F.when(joins, grown).otherwise(alone)
        small = F.when(size(small_open) >= o.min_tokens, state(F.concat(small_out, F.array(small_open)), none)).otherwise(state(small_out, small_open))
        large = F.when(joins, state(F.concat(s["out"], F.array(grown)), none)).otherwise(state(F.concat(flushed(s), F.array(alone)), none))
        long = state(F.concat(flushed(s), F.array(part(u["no"], u["no"], F.lit(True), u["tail"]))), none)
        return F.when(size(u) > o.max_tokens, long).when(size(u) < o.min_tokens, small).otherwise(large)

    def finish(s: Column) -> Column:
        last = F.element_at(s["out"], -1)
        merged = part(last["lo"], s["open"]["hi"], last["windows"], plus(last, s["open"]))
        fits = (size(s["open"]) < o.min_tokens) & (F.size(s["out"]) > 0)
        fits = fits & F.when(F.size(s["out"]) > 0, size(merged) <= o.max_tokens).otherwise(no)
        return F.when(s["open"].isNull(), s["out"]).when(fits, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(merged))).otherwise(flushed(s))

    return F.aggregate(units, start, step, finish)


def coalesce_units(units: DataFrame, options: ChunkOptions, key: str = "source") -> DataFrame:
    """(key, section_id, part, part_text): units joined to chunks within their section."""
    o = options
    windows = word_windows(F.col("unit"), o.target_tokens, o.max_tokens)
    tail = X.token_parts(F.coalesce(F.element_at(windows, -1), F.lit("")))
    rows = units.select(key, "section_id", "unit_no", "unit", *[c.alias(n) for n, c in X.token_parts(F.col("unit")).items()], F.struct(*[c.alias(n) for n, c in tail.items()]).alias("tail"))
    gathered = rows.groupBy(key, "section_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "unit", "latin", "cjk", "rest", "tail"))).alias("units"))
    numbered = F.transform("units", lambda u, i: F.struct(i.alias("no"), u["latin"].alias("latin"), u["cjk"].alias("cjk"), u["rest"].alias("rest"), u["tail"].alias("tail")))
    ranges = gathered.select(key, "section_id", "units", F.explode(F.filter(_fold(numbered, o), lambda x: x.isNotNull())).alias("r"), F.lit(0).alias("_"))

    def joined(lo: Column, hi: Column) -> Column:
        return F.array_join(F.transform(F.slice("units", lo + 1, F.greatest(hi - lo + 1, F.lit(0))), lambda u: u["unit"]), "\n\n")

    lo, hi = F.col("r.lo"), F.col("r.hi")
    cut = word_windows(F.get("units", lo)["unit"], o.target_tokens, o.max_tokens)
    rest = F.concat(F.element_at(cut, -1), F.lit("\n\n"), joined(lo + 1, hi))
    with_rest = F.when(hi > lo, F.concat(F.slice(cut, 1, F.size(cut) - 1), F.array(rest))).otherwise(cut)
    texts = F.when(F.col("r.windows"), with_rest).otherwise(F.array(X.trim(joined(lo, hi))))
    exploded = ranges.select(key, "section_id", lo.alias("lo"), F.posexplode(texts).alias("i", "part_text"))
    order = Window.partitionBy(key, "section_id").orderBy("lo", "i")
    return exploded.select(key, "section_id", (F.row_number().over(order) - 1).alias("part"), "part_text")


def chunk_documents(docs: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """Chunks of documents (source, absolute_path, text, mtime), with ids, hashes, token counts and metadata.

    Sections that need no split stay whole; parts of fewer than min_tokens are dropped and numbers not closed up.
    """
    o = options or ChunkOptions()
    lines = lines_of(docs, carry=("absolute_path", "mtime"))
    sections = sections_of(lines, carry=("absolute_path", "mtime")).withColumn("split", X.needs_split(F.col("tokens"), F.col("list_items"), F.col("bold_labels"), o.target_tokens, o.max_tokens))
    split = sections.where("split").select("source", "section_id")
    parts = coalesce_units(units_of(lines.join(split, ["source", "section_id"], "left_semi")), o)
    keys = ["source", "section_id", "heading", "slug", "occurrence", "absolute_path", "mtime"]
    whole = sections.where("not split").select(*keys, F.lit(0).alias("part"), F.col("text").alias("part_text"))
    cut = sections.where("split").select(*keys).join(parts, ["source", "section_id"])
    rows = whole.unionByName(cut).withColumn("part_text", X.trim(F.col("part_text"))).withColumn("token_count", X.estimate_tokens(F.col("part_text")).cast("int"))
    rows = rows.where((F.col("part_text") != "") & (F.col("token_count") >= o.min_tokens))
    return rows.select(
        X.chunk_id(F.col("source"), F.col("slug"), F.col("occurrence"), F.col("part")).alias("id"),
        F.col("part_text").alias("text"),
        "source",
        F.col("heading").alias("section"),
        X.content_hash(F.col("part_text")).alias("hash"),
        "mtime",
        "token_count",
        F.struct(X.infer_date(F.col("absolute_path"), F.col("mtime")).alias("date"), X.infer_type(F.col("source")).alias("type")).alias("metadata"),
    )


def fingerprint(options: ChunkOptions) -> Column:
    """Hash of the chunker's version and options."""
    o = options
    inner = F.struct(F.lit(o.target_tokens).alias("targetTokens"), F.lit(o.min_tokens).alias("minTokens"), F.lit(o.max_tokens).alias("maxTokens"), F.lit(o.overlap_ratio).alias("overlapRatio"))
    return F.sha2(F.to_json(F.struct(F.lit(CHUNKER_VERSION).alias("chunkerVersion"), inner.alias("chunking"))), 256)
