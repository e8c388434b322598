"""Main text of web pages by wrapper induction.

The layout of a page is its tree of blocks, items of lists laid over each other. The
layouts of one host are aligned by simple tree matching into a template, whose leaves
are the host's slots. Slots that hold the same on its pages belong to the template;
slots whose content varies are the article.

What elements say of themselves comes first (a ``nav``, a form, a class ``advert``;
an ``article``), as a host with few pages proves nothing. A host's slots are judged if
its pages hold at least ``VARIED`` different texts:

- where pages mark their article, a slot that fills once a page and holds one text on
  ``CONSTANT`` of them is template;
- elsewhere a text that stands in its slot on ``COMMON`` of the pages is template, and
  so is a slot whose texts come ``REPEATED`` times each on average.

Only distinct layouts are aligned, in groups of bounded size whose templates are
aligned in turn, so a host may hold any share of all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import pin, same
from tallyframe.llm.markup import aligned, layout, mark

VARIED = 8
CONSTANT, COMMON, REPEATED = 0.9, 0.5, 10
FAN_IN = 1024  # layouts, or templates, that one task aligns
BROADCAST_BYTES = 16 << 20
LAYOUT, WHOLE = -1, -2  # leaves that stand for a page's layout and for all its text


def host(url: Column) -> Column:
    """The host of a URL in lower case; of anything else, and of null, the empty string."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def facts(pages: DataFrame) -> DataFrame:
    """What the pages of each host hold: ``host``, ``layout``, ``leaf``, ``mark``, ``pages``, ``texts``, ``form``.

    A row for each layout and leaf and each text there (its hash in ``mark``), on how many
    pages and how often. Leaves that repeat on a page whose article is marked are lists,
    never template; they are counted as a whole (null mark). ``form`` is the layout itself.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for name, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                form, leaves, texts = layout(page)
                key = mark(form)
                seen = {(LAYOUT, 0): 1, (WHOLE, mark("\n".join(texts))): 1}
                often = [0] * (max(leaves, default=-1) + 1)
                for leaf in leaves:
                    often[leaf] += 1
                for leaf, text in zip(leaves, texts):
                    at = (leaf, None if often[leaf] > 1 and not form.startswith("body") else mark(text))
                    seen[at] = seen.get(at, 0) + 1
                for (leaf, what), n in seen.items():
                    row = found.setdefault((name, key, leaf, what), [0, 0, form if leaf == LAYOUT else None])
                    row[0] += 1
                    row[1] += n
            columns = list(zip(*((*k, *v) for k, v in found.items()))) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5, pa.string()])],
                ["host", "layout", "leaf", "mark", "pages", "texts", "form"])

    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(
        read, "host string, layout bigint, leaf bigint, mark bigint, pages bigint, texts bigint, form string")
    return rows.groupBy("host", "layout", "leaf", "mark").agg(
        F.sum("pages").alias("pages"), F.sum("texts").alias("texts"), F.first("form", ignorenulls=True).alias("form"))


def slots(layouts: DataFrame) -> DataFrame:
    """(host, layout, leaf, slot): the slot of the host's template that each leaf of each layout (host, layout, form) fills."""
    def align(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        form, found = aligned(list(zip(table["key"].to_pylist(), table["form"].to_pylist())))
        keys = list(found)
        return pa.table({
            "host": pa.array([key[0].as_py()] * len(keys), pa.string()), "part": pa.array([key[1].as_py()] * len(keys), pa.int64()),
            "key": pa.array(keys, pa.int64()), "slots": pa.array([found[k] for k in keys], pa.list_(pa.int64())),
            "form": pa.array([form] + [None] * (len(keys) - 1), pa.string())})

    many = layouts.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("parts"))
    below = layouts.join(many, "host").select("host", F.col("layout").alias("key"), "form", F.expr("pmod(layout, parts)").alias("part"))
    reached = None
    while True:
        level = pin(below.groupBy("host", "part").applyInArrow(
            align, "host string, part bigint, key bigint, slots array<bigint>, form string"))
        if reached is None:
            reached = level.select("host", F.col("key").alias("layout"), "slots", "part")
        else:
            up = level.select(F.col("host").alias("h"), F.col("key").alias("k"), F.col("slots").alias("upper"), F.col("part").alias("next"))
            reached = pin(reached.join(up, (F.col("host") == F.col("h")) & (F.col("part") == F.col("k"))).select(
                "host", "layout", F.expr("transform(slots, s -> upper[int(s)])").alias("slots"), F.col("next").alias("part")))
        if not level.where("part > 0").limit(1).count():
            return reached.select("host", "layout", F.posexplode("slots").alias("leaf", "slot"))
        below = level.where("form IS NOT NULL").select(
            "host", F.col("part").alias("key"), "form", F.expr(f"part div {FAN_IN}").alias("part"))


def template(found: DataFrame) -> DataFrame:
    """What is no article: (host, layout, whole, single), leaves of a layout, and (leaf, mark) of texts there."""
    hosts = (found.where(F.col("leaf") == WHOLE).groupBy("host", "mark").agg(F.sum("pages").alias("pages"))
             .groupBy("host").agg(F.count("*").alias("varied"), F.sum("pages").alias("all_pages"))
             .where(F.col("varied") >= VARIED).select("host", "all_pages"))
    judged = pin(found.join(hosts, "host"))
    layouts = judged.where(F.col("leaf") == LAYOUT)
    placed = slots(layouts.select("host", "layout", "form"))
    marked = layouts.select("host", "layout", (~F.col("form").startswith("body")).alias("marked"))
    texts = judged.where("leaf >= 0").drop("form").join(placed, ["host", "layout", "leaf"]).join(marked, ["host", "layout"])
    texts = pin(texts.select("host", "layout", "leaf", "slot", "marked", "mark", "pages", "texts", "all_pages"))
    by_text = texts.groupBy("host", "slot", "mark").agg(
        F.sum("pages").alias("pages"), F.sum("texts").alias("texts"), F.first("marked").alias("marked"),
        F.first("all_pages").alias("all_pages"))
    by_slot = by_text.groupBy("host", "slot").agg(
        F.count("mark").alias("different"), F.sum("texts").alias("texts"), F.max("pages").alias("most"),
        F.sum("pages").alias("pages"), F.count_if(F.col("mark").isNull()).alias("lists"),
        F.first("marked").alias("marked"))
    repeated = by_slot.where(F.when(
        F.col("marked"), (F.col("lists") == 0) & (F.col("pages") >= VARIED) & (F.col("most") >= CONSTANT * F.col("pages")))
        .otherwise(F.col("texts") >= REPEATED * F.col("different")) & (F.col("texts") >= VARIED)).select("host", "slot", "marked")
    common = by_text.where(~F.col("marked") & (F.col("pages") >= COMMON * F.col("all_pages"))).select("host", "slot", "mark")
    fixed = by_text.where("marked AND mark IS NOT NULL").join(repeated.where("marked"), ["host", "slot"], "left_semi").where(
        F.col("pages") >= VARIED).select("host", "slot", "mark")
    leaves = texts.select("host", "layout", "leaf", "slot").distinct()
    whole = leaves.join(repeated.where("NOT marked"), ["host", "slot"], "left_semi").groupBy("host", "layout").agg(
        F.collect_set("leaf").alias("whole"))
    single = (texts.select("host", "layout", "leaf", "slot", "mark").distinct()
              .join(common.unionByName(fixed), ["host", "slot", "mark"], "left_semi")
              .groupBy("host", "layout").agg(F.collect_set(F.struct("leaf", "mark")).alias("single")))
    return whole.join(single, ["host", "layout"], "full")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pages' ``page_id``, ``url`` and ``text``: the article's blocks, each a line, white space in them single.

    A null or empty html, and a page without an article, gives an empty text. Pages that
    repeat, also under one page_id, are each extracted; a null url counts as one host.
    """
    out = pin(template(pin(facts(pages))))
    small = (out.agg(F.sum(F.size("whole") * 8 + F.size("single") * 24 + F.length("host") + 64)).first()[0] or 0) <= broadcast_bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [layout(page) for page in batch["html"].to_pylist()]
            blocks = [[{"leaf": leaf, "mark": mark(text), "text": text} for leaf, text in zip(leaves, texts)]
                      for _, leaves, texts in done]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], batch["host"], pa.array([mark(form) for form, _, _ in done], pa.int64()),
                 pa.array(blocks, pa.list_(pa.struct([("leaf", pa.int64()), ("mark", pa.int64()), ("text", pa.string())])))],
                ["page_id", "url", "host", "layout", "blocks"])

    names = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.schema.fields[:3])
    blocks = names.mapInArrow(read, f"{fields}, layout bigint, blocks array<struct<leaf:bigint,mark:bigint,text:string>>")
    drops = out.withColumnsRenamed({"host": "h", "layout": "l"})
    kept = blocks.join(F.broadcast(drops) if small else drops, (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")), "left")
    article = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("whole", b["leaf"]), F.lit(False))
                       & ~F.coalesce(F.array_contains("single", F.struct(b["leaf"].alias("leaf"), b["mark"].alias("mark"))), F.lit(False)))
    return kept.select("page_id", "url", F.array_join(F.transform(article, lambda b: b["text"]), "\n").alias("text"))
