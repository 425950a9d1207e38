"""Outlines, chapters, pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_noise, split_text
from ..session import ensure_checkpoint_dir


def chunk_pages(pages: DataFrame, key: str, text: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """key, ord, text of the windows of each text."""
    cut = pages.select(key, F.explode(split_text(F.col(text), size, overlap)).alias("c"))
    return cut.select(key, F.col("c.ord").alias("ord"), F.col("c.text").alias("text"))


def section_bounds(toc: DataFrame, file: str = "file_id", total: str = "total_pages") -> DataFrame:
    """Adds parent_ord and page_end to outline entries (file, ord, level, page, total).

    The parent is the nearest entry before with a smaller level; a section ends on the page before the next entry of
    the same or a smaller level, or on the last page. Two windows over the file, one from its start and one from its end,
    each of which carries the nearest entry of every level along: running frames, so the work is linear in the entries.
    """
    here = Window.partitionBy(file)
    before = here.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r[0] for r in toc.select("level").distinct().collect() if r[0] is not None)  # a handful
    if not levels:
        return toc.withColumns({"parent_ord": F.lit(None).cast(toc.schema["ord"].dataType), "page_end": F.col(total)})
    entry = F.struct("ord", "page")
    near = {f"_p{k}": F.last(F.when(F.col("level") == n, F.col("ord")), ignorenulls=True).over(before) for k, n in enumerate(levels)}
    near |= {f"_n{k}": F.last(F.when(F.col("level") == n, entry), ignorenulls=True).over(after) for k, n in enumerate(levels)}
    seen = toc.withColumns(near)
    parent = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(f"_p{k}")) for k, n in enumerate(levels)]))
    following = F.array_min(F.array(*[F.when(F.col("level") >= n, F.col(f"_n{k}")) for k, n in enumerate(levels)]))
    out = seen.withColumns({"parent_ord": parent, "_next": following})
    return out.withColumn("page_end", F.when(F.col("_next").isNotNull(), F.greatest(F.col("page"), F.col("_next.page") - 1)).otherwise(F.col(total))).drop("_next", *near)


def page_chapters(pages: DataFrame, chapters: DataFrame, file: str = "file_id") -> DataFrame:
    """As-of join: each page's chapter is the one with the largest (page_start, ord) up to it; null before the first.

    Pages and chapters are merged in one window of their file, at linear cost.
    """
    p = pages.select(file, F.col("page"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_ord"), F.lit(None).cast("long").alias("chapter_id"))
    c = chapters.select(file, F.col("page_start").alias("page"), F.lit(0).alias("_kind"), F.col("ord").alias("_ord"), F.col("id").cast("long").alias("chapter_id"))
    last = F.last("chapter_id", ignorenulls=True).over(Window.partitionBy(file).orderBy("page", "_kind", "_ord"))
    return p.unionByName(c).withColumn("chapter_id", last).where("_kind = 1").select(file, "page", "chapter_id")


#: Pages of a bucket of the range join.
BUCKET = 64


def figures_of(chapters: DataFrame, figures: DataFrame, file: str = "file_id") -> DataFrame:
    """Range join: figures whose page lies in a chapter's pages.

    A chapter stands in every bucket of pages that it touches, a figure in one, so that figures meet only chapters
    which come near their page.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    c = chapters.where("page_start <= page_end").select(file, F.col("id").alias("chapter_id"), "page_start", "page_end", F.explode(F.sequence(bucket("page_start"), bucket("page_end"))).alias("_bucket"))
    f = figures.select(file, F.col("id").alias("figure_id"), "page", bucket("page").alias("_bucket"))
    return c.join(f, [file, "_bucket"]).where(F.col("page").between(F.col("page_start"), F.col("page_end"))).select("chapter_id", "figure_id", "page")


def figure_counts(chapters: DataFrame, figures: DataFrame, file: str = "file_id") -> DataFrame:
    """chapter_id, figures, first: how many figures lie in a chapter's pages, and the least id among them; none, no row.

    Figures are counted by page before the range join and chapters of equal bounds meet the pages once, so that the pairs of
    chapters and figures are never made, however many figures and chapters one file has.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    bounds = [file, "page_start", "page_end"]
    pages = figures.groupBy(file, "page").agg(F.count("*").alias("_n"), F.min("id").alias("_first")).withColumn("_bucket", bucket("page"))
    ranges = chapters.where("page_start <= page_end").select(*bounds).distinct().withColumn("_bucket", F.explode(F.sequence(bucket("page_start"), bucket("page_end"))))
    met = ranges.join(pages, [file, "_bucket"]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    found = met.groupBy(*bounds).agg(F.sum("_n").alias("figures"), F.min("_first").alias("first"))
    return chapters.select(F.col("id").alias("chapter_id"), *bounds).join(found, bounds).groupBy("chapter_id").agg(F.sum("figures").alias("figures"), F.min("first").alias("first"))


def top_level(chapters: DataFrame, rounds: int = 64) -> DataFrame:
    """id, top_id: the ancestor without a parent in the table. Pointers are doubled each round, so depth d takes log d rounds."""
    spark = chapters.sparkSession
    ids = chapters.select(F.col("id").alias("p"))
    up = chapters.select("id", F.col("parent_id").alias("to")).join(ids, F.col("to") == F.col("p"), "left").select("id", F.coalesce("p", "id").alias("to"))
    ensure_checkpoint_dir(spark)
    for _ in range(rounds):
        step = up.select(F.col("id").alias("m"), F.col("to").alias("next"))
        new = up.join(step, F.col("to") == F.col("m")).select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")).checkpoint()
        up = new.select("id", "to")
        if not new.where("moved").limit(1).count():
            return up.select("id", F.col("to").alias("top_id"))
    raise ValueError("the outline has a cycle")


def neighbours(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Adds prev and next key in the order of the group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({"prev": F.lag(key).over(w), "next": F.lead(key).over(w)})


def extraction_windows(chunks: DataFrame, size: int = 10, file: str = "file_id", order: str = "ord") -> DataFrame:
    """Adds window: consecutive runs of size chunks, noise left out unless a file has nothing else."""
    noisy = is_noise(F.col("text"))
    real = F.max(~noisy).over(Window.partitionBy(file))
    kept = chunks.withColumns({"_noise": noisy, "_real": real}).where(~F.col("_noise") | ~F.col("_real")).drop("_noise", "_real")
    place = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    return kept.withColumn("window", F.floor(place / size).cast("int"))


def passages(windows: DataFrame, cap: int = 1200, file: str = "file_id", order: str = "ord") -> DataFrame:
    """file, window, passage: the first cap characters of each chunk, joined by blank lines."""
    part = F.struct(F.col(order).alias("o"), F.substring("text", 1, cap).alias("t"))
    return windows.groupBy(file, "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("passage"))


def even_sample(rows: DataFrame, limit: int, group: str, order: str) -> DataFrame:
    """Up to limit rows of each group at the places floor(i * n / limit)."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # the least j with floor(j * n / limit) >= i lands on i if i was picked
    j = F.ceil(F.col("_i") * limit / F.col("_n"))
    return placed.where((F.col("_n") <= limit) | ((j < limit) & (F.floor(j * F.col("_n") / limit) == F.col("_i")))).drop("_i", "_n")


def body_size(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """file, body: the font size with the most characters; the first seen of equals."""
    sizes = lines.groupBy(file, "size").agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"))
    return sizes.groupBy(file).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def running_lines(lines: DataFrame, pages: int | str, file: str = "file_id") -> DataFrame:
    """Texts of at most 120 characters on max(3, a tenth) of the pages: headers and footers.

    ``pages`` is the number of pages, or the column of lines that has it for each file.
    """
    total = F.max(F.col(pages) if isinstance(pages, str) else F.lit(pages))
    found = lines.where(F.length("text") <= 120).groupBy(file, "text").agg(F.count_distinct("page").alias("pages"), total.alias("_total"))
    return found.where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("_total") / 10))).drop("_total")


def detect_headings(lines: DataFrame, pages: int | str | DataFrame, file: str = "file_id") -> DataFrame:
    """file, ord, level, text, page of the headings among lines (file, ord, page, text, size, bold), as running_lines() has pages.

    A table as ``pages`` (file, total_pages) also says which files are looked at. The sizes of a file are few, so the lines are
    shuffled once, to the sizes of their file, and the pages that show a text are counted where its lines have met.
    """
    from ..functions.text import heading_level

    sizes = lines.groupBy(file, "size").agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("first"), *([F.max(pages).alias("_pages")] if isinstance(pages, str) else []))
    known = F.max("_pages") if isinstance(pages, str) else F.lit(None if isinstance(pages, DataFrame) else pages).cast("int")
    scale = sizes.groupBy(file).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"), F.sort_array(F.collect_set("size"), asc=False).alias("_sizes"), known.alias("_pages"))
    if isinstance(pages, DataFrame):
        scale = scale.drop("_pages").join(pages.select(file, F.col("total_pages").alias("_pages")), file)
    scale = scale.withColumn("_big", F.slice(F.filter("_sizes", lambda s: s >= F.col("body") + 1.0), 1, 6)).drop("_sizes")
    rank = F.array_position("_big", F.col("size")).cast("int")
    sized = lines.select(file, "ord", "page", "text", "size", "bold").join(scale.hint("shuffle_hash"), file).withColumn("size_rank", F.when(rank > 0, rank)).drop("_big")
    spread = F.size(F.collect_set("page").over(Window.partitionBy(file, "text")))
    running = (F.length("text") <= 120) & (spread >= F.greatest(F.lit(3), F.floor(F.col("_pages") / 10)))
    level = heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("body"), F.col("size_rank"))
    bigger = F.col("bold") | (F.col("size") >= F.col("body") + 1.0)  # what any heading is; cheaper to ask
    kept = sized.withColumn("_running", F.coalesce(running, F.lit(False))).where(bigger & ~F.col("_running"))
    return kept.withColumn("level", level).where("level is not null").select(file, "ord", "level", "text", "page")
