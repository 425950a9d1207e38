"""Wiki pages as text: rendering, links and files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINK = re.compile(r"\[\[([^\]]*?)\]\]?")
FOLDERS = ("entities", "concepts", "topics", "queries")


def linkify(prose: str, refs: list[tuple[str, str]]) -> str:
    """Prose with one link for each ref (slug, name): written links are undone first, longer names are linked first."""
    names = dict(refs)

    def plain(m: re.Match) -> str:
        head, bar, shown = m[1].partition("|")
        return shown if bar else names.get(head, head)

    out = LINK.sub(plain, prose)
    for slug, name in sorted(refs, key=lambda r: -len(r[1])):
        if f"[[{slug}|" in out:
            continue
        parts = re.split(r"(\[\[[^\]]*\]\])", out)  # every other part is a link
        for i in range(0, len(parts), 2):
            parts[i], n = re.subn(rf"(?<!\w){re.escape(name)}(?!\w)", lambda m, s=slug, n=name: f"[[{s}|{n}]]", parts[i], count=1)
            if n:
                break
        out = "".join(parts)
    return out


#: The HTML that pages are rendered to.
SHAPES = {
    "title": '<h1 class="wiki-title">{}</h1>', "section": "<h2>{}</h2>", "meta": '<p class="wiki-meta">{}</p>', "text": "<p>{}</p>", "rule": "<hr>",
    "list": '<ul class="wiki-list">', "item": "<li>{}</li>", "end": "</ul>",
    "link": '<a class="wikilink" href="/wiki/page/{}">{}</a>', "strong": "<strong>{}</strong>", "em": "<em>{}</em>", "cite": '<em class="cite">({})</em>',
}
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"}


class _Inline:
    """One pass over a line: each kind of span is opened by its first characters, and its contents are read the same way."""

    OPENERS = {"[[": "_link", "**": "_strong", "_(": "_cite", "*": "_em"}
    SLUG = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-")

    def __init__(self, line: str):
        self.line = line

    def html(self) -> str:
        out, at = [], 0
        while at < len(self.line):
            span = next(filter(None, (getattr(self, how)(at) for mark, how in self.OPENERS.items() if self.line.startswith(mark, at))), None)
            if span:
                shown, at = span
            else:
                shown, at = ESCAPES.get(self.line[at], self.line[at]), at + 1
            out.append(shown)
        return "".join(out)

    def _within(self, at: int, opener: int, closer: str) -> tuple[str, int] | None:
        end = self.line.find(closer, at + opener)
        return None if end < 0 else (self.line[at + opener : end], end + len(closer))

    def _link(self, at: int) -> tuple[str, int] | None:
        found = self._within(at, 2, "]]")
        if not found:
            return None
        slug, _, shown = found[0].partition("|")
        if not slug or not self.SLUG.issuperset(slug) or "]" in shown:
            return None
        return SHAPES["link"].format(slug, _Inline(shown).html() or slug), found[1]

    def _strong(self, at: int) -> tuple[str, int] | None:
        found = self._within(at, 2, "**")
        return (SHAPES["strong"].format(_Inline(found[0]).html()), found[1]) if found and found[0] and "*" not in found[0] else None

    def _cite(self, at: int) -> tuple[str, int] | None:
        found = self._within(at, 2, ")")
        return (SHAPES["cite"].format(_Inline(found[0]).html()), found[1] + 1) if found and self.line.startswith("_", found[1]) else None

    def _em(self, at: int) -> tuple[str, int] | None:
        """Up to the next asterisk that no bold span within takes: bold is resolved first."""
        end = at + 1
        while (end := self.line.find("*", end)) >= 0:
            bold = self._strong(end) if self.line.startswith("**", end) else None
            if not bold:
                break
            end = bold[1]
        return (SHAPES["em"].format(_Inline(self.line[at + 1 : end]).html()), end + 1) if end > at + 1 else None


def _block(line: str) -> tuple[str, str]:
    """Shape and contents of a line that is not blank."""
    if line.strip() == "---":
        return "rule", ""
    for mark, kind in (("- ", "item"), ("# ", "title"), ("## ", "section"), ("> ", "meta")):
        if line.startswith(mark):
            return kind, line[len(mark) :]
    return "text", line


def render_markdown(text: str) -> str:
    """The Markdown of wiki pages as escaped HTML: headings, lists, quotes, rules, links, bold, italics, citations."""
    out, listed = [], False
    for line in map(str.rstrip, text.splitlines()):
        kind, rest = _block(line) if line else ("", "")
        if listed != (kind == "item"):
            listed = not listed
            out.append(SHAPES["list" if listed else "end"])
        if kind:
            out.append(SHAPES[kind].format(_Inline(rest).html()))
    return "\n".join([*out, SHAPES["end"]] if listed else out)


@F.pandas_udf(StringType())
def rendered(text: pd.Series) -> pd.Series:
    return text.map(lambda t: render_markdown(t) if t is not None else None)


def entity_pages(entities: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """path, content of a page for each active entity: title, meta line, and its active claims with their sources.

    sources: claim_id, sources, as provenance() gives them.
    """
    from ..operators.entities import with_slugs

    line = F.concat(F.lit("- "), F.col("text"), F.when(F.coalesce("sources", F.lit("")) != "", F.concat(F.lit(" _(source: "), F.col("sources"), F.lit(")_"))).otherwise(""))
    told = claims.where("status = 'active'").join(sources, F.col("id") == F.col("claim_id"), "left").select("entity_id", F.struct("id", line.alias("l")).alias("x"))
    lists = told.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("lines"))
    e = with_slugs(entities).where("status = 'active'").join(lists, F.col("id") == F.col("entity_id"), "left")
    meta = F.concat(F.lit("> "), F.col("type"), F.lit(" · "), F.col("source_count").cast("string"), F.lit(" sources"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("name")), meta, F.concat(F.lit("## Claims\n\n"), F.coalesce("lines", F.lit("*None yet.*"))))
    return e.select(F.concat(F.lit("entities/"), F.col("slug"), F.lit(".md")).alias("path"), F.concat(body, F.lit("\n")).alias("content"))


def index_page(entities: DataFrame) -> DataFrame:
    """One row: the index of active entities by type."""
    from ..operators.entities import with_slugs

    line = F.struct("name", F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.col("name"), F.lit("]]")).alias("l"))
    by_type = with_slugs(entities).where("status = 'active'").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines"))
    part = F.struct("type", F.concat(F.lit("## "), F.initcap("type"), F.lit("\n\n"), F.col("lines")).alias("t"))
    return by_type.agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("content")).select(F.lit("index.md").alias("path"), "content")


def scaffold(root: str) -> None:
    """Folders and seed files of a wiki on local disk; what is there stays."""
    for name in FOLDERS:
        os.makedirs(os.path.join(root, name), exist_ok=True)
    for name, text in (("index.md", "# Index\n"), ("log.md", "# Log\n"), ("overview.md", "# Overview\n")):
        path = os.path.join(root, name)
        if not os.path.exists(path):
            with open(path, "w") as f:
                f.write(text)


def write_pages(pages: DataFrame, root: str) -> dict[str, str]:
    """Write (path, content) under a local folder, one page after the other; returns the hash of each.

    A wiki is a folder of small files on one machine; pages stream to it partition by partition.
    """
    hashes = {}
    for row in pages.select("path", "content").toLocalIterator():
        path = os.path.join(root, row["path"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(row["content"])
        hashes[row["path"]] = hashlib.sha256(row["content"].encode()).hexdigest()
    return hashes


def append_log(root: str, line: str) -> None:
    with open(os.path.join(root, "log.md"), "a") as f:
        f.write(f"- {line}\n")


def read_pages(spark, root: str) -> DataFrame:
    """path (relative), content of all Markdown files of a wiki."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root)
    full = F.regexp_replace(F.input_file_name(), "^file:/+", "/")
    return files.select(F.substr(full, F.lit(len(os.path.abspath(root)) + 2)).alias("path"), F.col("value").alias("content"))


def answer_page(title: str, answer: str, pages: list[tuple[str, str]], excerpts: list[str]) -> str:
    """A filed answer with the distinct pages and excerpts it drew on, in the order they came."""
    lines = [f"- [[{slug}|{name}]]" for slug, name in dict(pages).items()] + [f"- {x}" for x in dict.fromkeys(excerpts)]
    return f"# {title}\n\n{answer.strip()}\n\n## Sources\n\n" + "\n".join(lines) + "\n"


def file_answer(existing: str | None, title: str, answer: str, pages: list[tuple[str, str]], excerpts: list[str], date: str) -> str | None:
    """Content after filing an answer: a new page, a dated update of an old one, or None if the page says it already."""
    if existing is None:
        return answer_page(title, answer, pages, excerpts)
    if answer.strip() in existing:
        return None
    return existing.rstrip("\n") + f"\n\n## Update {date}\n\n{answer.strip()}\n"


def topic_pages(clusters: DataFrame, chapters: DataFrame, files: DataFrame, entities: DataFrame, claims: DataFrame, cap: int = 15) -> DataFrame:
    """path, content of a page for each topic cluster (top_id, entities): its entities, those with the most claims first, and their first active claim."""
    from pyspark.sql import Window

    from ..functions.text import slug
    from ..operators.entities import first_claims, with_slugs

    n = claims.groupBy("entity_id").agg(F.count("*").alias("n_claims"))
    each = clusters.select("top_id", F.explode("entities").alias("entity_id")).join(n, "entity_id", "left").join(first_claims(claims).select("entity_id", "claim"), "entity_id", "left")
    named = with_slugs(entities).where("status = 'active'").select(F.col("id").alias("entity_id"), "name", "slug")
    rn = F.row_number().over(Window.partitionBy("top_id").orderBy(F.desc(F.coalesce("n_claims", F.lit(0))), "entity_id"))
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.col("name"), F.lit("]]"), F.when(F.col("claim").isNotNull(), F.concat(F.lit(" — "), F.col("claim"))).otherwise(""))
    lists = each.join(named, "entity_id").withColumn("rn", rn).where(F.col("rn") <= cap).groupBy("top_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    c = chapters.select(F.col("id").alias("top_id"), "title", "file_id").join(files.select(F.col("id").alias("file_id"), "filename"), "file_id")
    stem = slug(F.regexp_replace("filename", r"\.[^.]+$", ""), 80)
    return lists.join(c, "top_id").select(
        F.concat(F.lit("topics/"), stem, F.lit("--"), slug(F.col("title"), 80), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), F.col("title"), F.lit("\n\n> "), F.col("filename"), F.lit("\n\n"), F.col("lines"), F.lit("\n")).alias("content"),
    )


def _key_entities(touched: DataFrame, entities: DataFrame, claims: DataFrame, cap: int) -> DataFrame:
    """id, name, type, slug, claim, rn of the entities (id) with the most claims: their order and their first active claim."""
    from pyspark.sql import Window

    from ..operators.entities import first_claims, with_slugs

    counts = claims.groupBy("entity_id").agg(F.count("*").alias("n"))
    first = first_claims(claims).select("entity_id", "claim")
    e = with_slugs(entities).where("status in ('active', 'unresolved')").join(touched.select("id"), "id", "left_semi")
    rated = e.join(counts, F.col("id") == F.col("entity_id"), "left").drop("entity_id").join(first, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
    rn = F.row_number().over(Window.orderBy(F.desc(F.coalesce("n", F.lit(0))), "id"))
    return rated.select("id", "name", "type", "slug", "claim", rn.alias("rn")).where(F.col("rn") <= cap)


def source_page(file: DataFrame, clusters: DataFrame, chapters: DataFrame, entities: DataFrame, claims: DataFrame, topics: DataFrame, mentioned: int, prose: Callable[[str], str] | None = None, stamp: str = "", cap: int = 15, most: int = 40) -> tuple[str, str] | None:
    """path, content of a file's profile: what it is, a lead paragraph, its covered chapters, its key entities.

    file: one row (filename, format, byte_size, created_at); clusters: top_id, entities, n of its chapters; topics: path
    of the topic pages there are, to which chapters link; prose: a model for the lead, left out if it fails or there is
    none. None if nothing was extracted from the file. What a profile holds is bounded by cap and most.
    """
    from ..functions.text import human_size, slug

    f = file.select("filename", "format", human_size(F.col("byte_size")).alias("size"), F.date_format("created_at", "yyyy-MM-dd").alias("day"), slug(F.regexp_replace("filename", r"\.[^.]+$", ""), 80).alias("stem")).first()
    covered = clusters.join(chapters.select(F.col("id").alias("top_id"), "title", "ord"), "top_id")
    total = covered.count()
    if not total:
        return None
    placed = covered.withColumn("path", F.concat(F.lit(f"topics/{f['stem']}--"), slug(F.col("title"), 80), F.lit(".md"))).join(topics.select("path", F.lit(True).alias("there")), "path", "left")
    lines = [
        f"- {f'[[{r['path'][7:-3]}|{r['title']}]]' if r['there'] else r['title']} — {r['n']} entities"
        for r in placed.orderBy("ord").limit(most).select("path", "title", "there", "n").collect()
    ]
    if total > most:
        lines.append(f"- _(+{total - most} more chapters)_")
    key = _key_entities(clusters.select(F.explode("entities").alias("id")).distinct(), entities, claims, cap).orderBy("rn").collect()
    tops = [r[0] for r in chapters.where("parent_id is null").orderBy("ord").select("title").collect()]
    digest = "\n".join(f"- [[{r['slug']}|{r['name']}]] ({r['type']}): {r['claim'] or ''}" for r in key)
    lead = ""
    if prose:
        try:
            lead = prose(f"DOCUMENT: {f['filename']}\nTABLE OF CONTENTS:\n" + ("\n".join(f"- {t}" for t in tops) or "(no outline)") + f"\n\nKEY ENTITIES:\n{digest}").strip()
        except Exception:  # noqa: BLE001  the page is whole without a lead
            lead = ""
    out = [f"# {f['filename']}", f"> **source** · {f['format']} · {f['size']} · {len(tops)} chapters · {mentioned} entities · ingested {f['day'] or 'unknown'}"]
    out += [linkify(lead, [(r["slug"], r["name"]) for r in key])] if lead else []
    out += ["## Contents", "\n".join(lines)]
    out += ["## Key entities", " · ".join(f"[[{r['slug']}|{r['name']}]]" for r in key)] if key else []
    return f"sources/{f['stem']}.md", "\n\n".join(out) + f"\n\n---\n{stamp}".rstrip() + "\n"


def overview_page(before: str, filename: str, touched: DataFrame, entities: DataFrame, claims: DataFrame, prose: Callable[[str], str], cap: int = 12, most: int = 6000) -> str | None:
    """The overview revised by a model in the light of one more source; None if it says nothing, so that the page stays."""
    body = before.removeprefix("# Overview").strip()[:most]
    key = _key_entities(touched, entities, claims, cap).orderBy("rn").collect()
    lines = "\n".join(f"- [[{r['slug']}|{r['name']}]] ({r['type']}): {r['claim'] or ''}" for r in key)
    try:
        text = prose(f"CURRENT OVERVIEW:\n{body or '(empty — this is the first source)'}\n\nNEW SOURCE: {filename}\nIt contributed {touched.count()} entities; the most substantial:\n{lines}").strip()
    except Exception:  # noqa: BLE001  authored prose is optional
        return None
    return f"# Overview\n\n{text}\n" if text else None


def stale_topics(written: DataFrame, pages: DataFrame, stem: str) -> DataFrame:
    """Topic pages of a file (by the stem of its name) that its last run has not written."""
    return pages.where(F.col("path").startswith(f"topics/{stem}--")).join(written.select("path"), "path", "left_anti").select("path")


def missing_files(rendered_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Rendered pages whose file is not there; a page that exists is never overwritten."""
    return rendered_pages.join(pages.select("path"), "path", "left_anti")
