"""The three entry points as plans: conversion, retrieval, learning (B16, F16, F18, F19, §3).

Pages come in as rows; what reads scans, drawings or models is outside and gives boxes or pages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, learning, reports, retrieval, tables


class Converted(NamedTuple):
    tables: DataFrame
    audit: audit.Audit
    boq: audit.Audit
    chunks: DataFrame
    index: DataFrame


def route(suffix, mode):
    """office files by their suffix, others by the mode that was asked for."""
    return F.when(F.lower(suffix).isin("xlsx", "xlsm", "docx"), "office").when(mode.isin("fast_text", "rapid_ocr", "vn_ocr"), mode).otherwise("model")


def convert(pages: DataFrame, page_tables: DataFrame, mode: str = "text", most: int = 3000) -> Converted:
    """From pages and their tables to classified and audited tables, chunks and the sheet index."""
    typed = tables.classified(page_tables)
    bars = audit.audit_rebar(typed.where("category = 'rebar_schedule'"))
    bills = audit.audit_boq(typed.where("category = 'boq'"))
    rows = pages.select(F.col("doc_id").alias("source"), "page", F.coalesce("metadata.so_hieu_ban_ve", F.lit("")).alias("sheet"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    flat = pages.select("doc_id", "page", "metadata.so_hieu_ban_ve", "metadata.ten_ban_ve", "tables")
    return Converted(typed, bars, bills, retrieval.chunks(rows, mode, most), reports.sheet_index(flat))


def office_warnings(warnings, more):
    """without the warning of a blank page, and with those of the source."""
    return F.concat(F.filter(warnings, lambda w: w != "blank page"), F.coalesce(more, F.array().cast("array<string>")))


def ask(chunks: DataFrame, pages: DataFrame, queries: DataFrame, history: DataFrame | None = None, k: int = 4) -> DataFrame:
    """Retrieval: (query_id, messages) for a model to answer."""
    ordered = chunks.join(pages.select(F.col("doc_id").alias("source"), "page", F.col("metadata.so_hieu_ban_ve").alias("so_hieu_ban_ve")), ["source", "page"], "left").withColumn("so_hieu_ban_ve", F.coalesce("so_hieu_ban_ve", F.lit(""))).withColumn("ord", F.col("id"))
    return retrieval.prompts(retrieval.search(ordered, queries, k), queries, history, k)


class Knowledge(NamedTuple):
    terms: DataFrame
    verified: DataFrame
    phrases: DataFrame
    abbreviations: DataFrame


def learn(pages: DataFrame, history: DataFrame) -> Knowledge:
    """Learning from documents that are not in the history: (doc_id, page, method, text) rows."""
    fresh = learning.not_learned(pages, history.select(F.col("document").alias("doc_id")), "doc_id")
    verified = learning.verified_terms(learning.trusted_pages(fresh))
    return Knowledge(learning.terms(fresh), verified, learning.verified_map(verified), learning.abbreviations(fresh))
