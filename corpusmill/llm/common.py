"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: Blanks of any kind that may surround a line (space, tab, CR, no-break and typographic blanks).
BLANKS = " \t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, over all cores also where it is one small file."""
    return spread(table(spark, sf_dir, name))


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def single_blanks(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), "  +", " ")


def url_host(url: Column) -> Column:
    """Authority of an absolute URL as it stands; '' where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def normal_host(host: Column) -> Column:
    """Lower case without outer blanks, leading www. and a final dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"\.$", ""), r"^www\.", "")


def pages_with_host(pages: DataFrame, meta: DataFrame | None, keep: list[str]) -> DataFrame:
    """Pages with markdown, and their host: source_domain of the page's first metadata row that has one, else the URL's host.

    Metadata is first cut to one row a page, so repeated metadata rows never repeat pages.
    """
    own = normal_host(url_host(F.col("url")))
    rows = pages.where(F.col("markdown").isNotNull()).select(*keep, own.alias("_url_host"))
    if meta is None:
        return rows.withColumnRenamed("_url_host", "host")
    first = (
        meta.where(F.col("source_domain").isNotNull() & F.col("page_id").isNotNull())
        .groupBy(F.col("page_id").alias("_meta_page"))
        .agg(F.min_by(normal_host(F.col("source_domain")), F.col("meta_id")).alias("_meta_host"))
    )
    return rows.join(first, F.col("page_id") == F.col("_meta_page"), "left").select(
        *keep, F.coalesce(F.col("_meta_host"), F.col("_url_host"), F.lit("")).alias("host")
    )


def send(spark: SparkSession, model: Any) -> Broadcast:
    """Broadcast of a model of bounded size, with the code of its class; receive() opens it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def receive(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)
