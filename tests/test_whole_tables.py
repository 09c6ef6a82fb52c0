"""Queries over whole tables: no row of the table may be left out."""

import os
import re
import unicodedata

import pytest

import __spark_entry__
from silverbarn.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")


def _rows(spark, name):
    return __spark_entry__.queries()[name](spark, DATA).collect()


def test_every_document_in_every_script_has_a_slug(spark):
    def slug(text):
        kept = "".join(c if unicodedata.category(c)[0] in "LN" else "-" for c in (text or "").lower())
        return re.sub("-+", "-", kept).strip("-") or "unknown"

    texts = table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert {r.doc_id: r.slug for r in _rows(spark, "slug_dash")} == {r.doc_id: slug(r.text) for r in texts}


def test_every_order_is_parsed_as_an_instance(spark):
    orders = table(spark, DATA, "orders").select("o_orderkey", "o_totalprice").collect()
    assert sorted((r.accession, r.value) for r in _rows(spark, "xbrl_facts")) == sorted((f"acc{r.o_orderkey}", r.o_totalprice) for r in orders)


def test_the_two_loads_hold_every_event_and_overlap_in_part(spark):
    events = table(spark, DATA, "events").selectExpr("user_id", "to_date(ts) AS day", "event_type").collect()
    old = {(r.user_id, r.day) for r in events if r.event_type == "purchase"}
    new = {(r.user_id, r.day) for r in events if r.event_type != "purchase"}
    assert {(r.user_id, r.day) for r in _rows(spark, "upsert_coalesce")} == old | new
    fate = {(r.user_id, r.day): r.outcome for r in _rows(spark, "strict_insert")}
    assert fate == {k: "rejected" if k in old else "accepted" for k in new} and len(set(fate.values())) == 2
