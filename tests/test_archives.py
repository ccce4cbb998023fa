"""Zip archives read by executors: members, scope, reasons, required columns."""

import zipfile

import pytest

from offerloom.sources import archives, feeds

SPEC = feeds.FeedSpec("shop", rejected_paths="^pieces", rejected_titles="occasion")
HEAD = "ID;Title;link;product_type;unread\n"


def zipped(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in members.items():
            archive.writestr(name.replace("_", "."), text)
    return f"file://{path}"


def test_members_scope_and_reasons(spark, tmp_path):
    zipped(tmp_path / "a.zip", one_csv="﻿" + HEAD + '1;"two\nlines; and ""quotes""";u1;gloves;z\n2;t;u2;Pieces / x;z\n\n3;Occasion;u3;;z\n4;;u4;;z\n5;t;u5;;z;more\n6;t;u6\n7; été ;u7;;z\n', two_TXT=HEAD, three_md="not read")
    zipped(tmp_path / "b.zip", four_csv=HEAD + "".join(f"{k};t{k};u;;z\n" for k in range(11_000)), empty_csv="ID;title;url\n")
    rows = archives.read_archives(spark, [f"file://{tmp_path}"], SPEC)
    assert set(rows.columns) == {"member", "line", "reason", "records", *feeds.DEFAULT_ALIASES}
    one = rows.where("member like '%one.csv'").collect()
    assert {(r.sku, r.title, r.url, r.category, r.line) for r in one if r.reason is None} == {("1", 'two\nlines; and "quotes"', "u1", "gloves", 0), ("7", "été", "u7", None, 7)}
    assert {r.reason: r.records for r in one if r.reason} == {"category": 1, "title": 1, "incomplete": 1, "ragged": 2}
    assert rows.where("member like '%four.csv' and reason is null").selectExpr("sum(cast(sku as long)) as s", "count(distinct line) as n").collect()[0][:] == (sum(range(11_000)), 11_000)
    assert rows.rdd.getNumPartitions() == 4 and rows.where("member like '%two%' or member like '%empty%'").count() == 0


def test_a_missing_column_is_refused(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", one_csv="id;title\n1;t\n")
    with pytest.raises(Exception, match="no column for url"):
        archives.read_archives(spark, [path], SPEC).collect()
