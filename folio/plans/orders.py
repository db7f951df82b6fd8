"""Queries of the reading orders. SQL cannot express their recursion; they are tested on small pages and by properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import layout as L
from folio.operators import reading as R
from folio.sources.blocks import blocks


def reading_order_naive(spark, sf_dir):
    return R.reading_orders(blocks(spark, sf_dir), "naive")


def reading_order_gap_tree(spark, sf_dir):
    return R.reading_orders(blocks(spark, sf_dir), "gap_tree")


def reading_order_xy_cut(spark, sf_dir):
    """Pages read upside down and from the end, as the inside of a figure is."""
    return R.reading_orders(blocks(spark, sf_dir), "xy_cut", reverse=True)


def reading_order_xy_cut_exp(spark, sf_dir):
    return R.reading_orders(blocks(spark, sf_dir), "xy_cut_exp")


def sorted_pages(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return R.sorted_pages(b, L.column_types(b))


def page_regions(spark, sf_dir):
    return R.page_regions(blocks(spark, sf_dir).where(~F.col("type").isin("pageheader", "pagenumber")))


QUERIES = {f.__name__: f for f in (reading_order_naive, reading_order_gap_tree, reading_order_xy_cut, reading_order_xy_cut_exp, sorted_pages, page_regions)}
SQL: dict[str, str] = {}
