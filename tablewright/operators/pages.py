"""Main text of web pages: blocks repeated on many pages of a host are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import text_blocks
from tablewright.operators.ranking import is_small, slices
from tablewright.session import durable


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def block_id(block: Column) -> Column:
    """Digest of a block: counting and joining move these instead of the text."""
    return F.sha2(block, 256)


def page_block_ids(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(page, host, block_id): the different blocks of every page."""
    return pages.select(
        page,
        url_host(F.col(url)).alias("host"),
        F.explode(F.array_distinct(F.transform(text_blocks(F.col(html)), block_id))).alias("block_id"),
    )


def repeated_blocks(
    pages: DataFrame, ids: DataFrame, url: str, max_share: float, min_pages: int
) -> DataFrame:
    """(host, block_id) found on more than ``max_share`` of a host's pages."""
    seen = ids.groupBy("host", "block_id").agg(F.count(F.lit(1)).alias("pages"))
    sizes = pages.groupBy(url_host(F.col(url)).alias("host")).agg(
        F.count(F.lit(1)).alias("host_pages")
    )
    shares = seen.filter(F.col("pages") >= min_pages).join(sizes, "host")
    return shares.filter(F.col("pages") > F.col("host_pages") * max_share).select("host", "block_id")


def main_text(
    pages: DataFrame,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    max_page_share: float = 0.5,
    min_pages: int = 3,
    salts: int | None = None,
) -> DataFrame:
    """(page, text): each page without the blocks its host repeats.

    Only digests are counted and shuffled. The repeated blocks of a host, at most
    its blocks per page over the share, become one array, which is joined to the
    pages and filtered in place: broadcast when all arrays are small in bytes, so
    no page moves; else by host, with a salt per page for a huge host.
    """
    ids = page_block_ids(pages, page, url, html)
    repeated = repeated_blocks(pages, ids, url, max_page_share, min_pages)
    dropped = durable(repeated.groupBy("host").agg(F.collect_set("block_id").alias("_dropped")))
    keyed = pages.select(page, url_host(F.col(url)).alias("host"), text_blocks(F.col(html)).alias("_blocks"))
    if is_small(dropped):
        joined = keyed.join(F.broadcast(dropped), "host", "left")
    else:
        salts = salts or slices(pages)
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(page), F.lit(salts)).cast("int"))
        spread = dropped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, ["host", "_salt"], "left")
    kept = F.filter(
        "_blocks", lambda b: ~F.coalesce(F.array_contains(F.col("_dropped"), block_id(b)), F.lit(False))
    )
    return joined.select(page, F.array_join(kept, "\n").alias("text"))
