"""Blocks of text from a stream of tags: what stands between block tags, with the element it is in, how deep, and its links.

Tags are rows. Inline tags only join text. A paragraph ends at the next block tag even without its end tag, and an item or cell ends where the next one of
its kind begins; an end tag of a paragraph that has ended says nothing. The depth is a running sum over block tags, and the element at a
depth is the last one that opened there. Navigation, footers and heads are not narrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import squeezed

# Block elements, kinds that end their own kind, what is not narrated, and entities by the character they stand for.
BLOCKS = "html head title body main header footer nav aside section article div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption level1 level2 level3 doctitle docauthor pagenum note".split()
ENDS_ITS_KIND = "li dt dd tr td th".split()
LEFT_OUT = "nav footer head".split()
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "hellip": "…", "laquo": "«", "raquo": "»", "amp": "&"}
TAG = r"""</?[a-zA-Z][a-zA-Z0-9:-]*(?:[^<>"']|"[^"]*"|'[^']*')*>"""
UNREAD = r"(?s)<!--.*?-->|<![^>]*>|<\?.*?\?>|<script[ >].*?</script>|<style[ >].*?</style>"


def unescaped(text: Column) -> Column:
    """Named entities as characters, the ampersand last."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, tag, depth, text, links: the narrated blocks of each page in reading order."""
    clean = F.regexp_replace(html, UNREAD, "")
    parts = F.arrays_zip(F.split(clean, TAG, -1).alias("piece"), F.regexp_extract_all(clean, F.lit(TAG), F.lit(0)).alias("tag"))
    rows = pages.filter(F.col(html).isNotNull()).select(key, F.posexplode(parts).alias("at", "t")).select(key, "at", F.col("t.piece").alias("piece"), F.col("t.tag").alias("written"))
    name = F.lower(F.regexp_extract("written", "^</?([a-zA-Z0-9:-]+)", 1))
    rows = rows.withColumns({"name": name, "closes": F.coalesce(F.startswith("written", F.lit("</")), F.lit(False))})
    rows = rows.withColumn("is_block", F.coalesce(F.col("name").isin(*BLOCKS) & ~F.endswith("written", F.lit("/>")), F.lit(False)))
    order = Window.partitionBy(key).orderBy("at")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a piece stands before its row's tag
    rows = rows.withColumn("after", F.sum(F.col("is_block").cast("int")).over(until)).withColumn("block", F.col("after") - F.col("is_block").cast("int"))
    link = (F.col("name") == "a") & F.col("written").rlike("(?i)\\shref\\s*=")
    piece = F.when(F.col("name") == "br", F.concat("piece", F.lit(" "))).otherwise(F.col("piece"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", piece.alias("piece")))), lambda p: p["piece"]), "")
    texts = rows.groupBy(key, "block").agg(text.alias("text"), F.count_if(link & ~F.col("is_block")).alias("links"))

    events = rows.filter("is_block").select(key, F.col("after").alias("block"), "name", "closes")
    order = Window.partitionBy(key).orderBy("block")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumns({"last_name": F.lag("name").over(order), "last_closes": F.lag("closes").over(order)})
    after_open = F.coalesce(~F.col("last_closes"), F.lit(False))
    in_p = after_open & (F.col("last_name") == "p")
    implied = (in_p & ~((F.col("name") == "p") & F.col("closes"))) | (after_open & ~F.col("closes") & (F.col("last_name") == F.col("name")) & F.col("name").isin(*ENDS_ITS_KIND))
    step = F.when(F.col("closes") & (F.col("name") == "p") & ~in_p, 0).when(F.col("closes"), -1).otherwise(1) - F.when(implied, 1).otherwise(0)
    out = F.when(F.col("name").isin(*LEFT_OUT), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    events = events.withColumns({"depth": F.sum(F.coalesce(step, F.lit(0))).over(until), "out": F.sum(out).over(until)})
    same_depth = Window.partitionBy(key, "depth").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("tag", F.last(F.when(~F.col("closes"), F.col("name")), ignorenulls=True).over(same_depth)).filter("out = 0")
    found = texts.join(events.select(key, "block", "tag", "depth"), [key, "block"]).withColumn("text", squeezed(unescaped(F.col("text")))).filter("text <> ''")
    return found.select(key, (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), "tag", F.col("depth").cast("int").alias("depth"), "text", F.col("links").cast("int").alias("links"))
