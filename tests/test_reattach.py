"""Reattachment: which offers move, what holds them, and the log."""

import datetime

from offerloom.operators import reattach

DAY = datetime.date


def test_moves_and_log(spark):
    offers = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", False), (4, "c", False), (5, "d", False), (6, "e", False), (7, "f", False), (8, None, False), (9, "a", False)], "offer_id long, gtin string, resolved boolean")
    units = spark.createDataFrame([("a", "own", False), ("b", "own", False), ("c", "own", True), ("d", "same", False), ("e", "own", False), ("f", "own", False)], "gtin string, identity string, conflict boolean")
    linked = spark.createDataFrame([("a", 10, "x"), ("a", 10, "x"), ("b", 11, "x"), ("b", 12, "x"), ("c", 13, "x"), ("d", 14, "same"), ("e", 15, "x"), ("f", 16, "x"), (None, 17, "x"), *((f"g{k}", 16, "x") for k in range(25))], "gtin string, product long, identity string")
    refused = spark.createDataFrame([("e",), ("e",)], "gtin string")
    moved = reattach.moves(offers, units, linked, refused)
    # b has two products, c a conflict, d the same identity, e is refused, f's product has 26 barcodes
    assert {tuple(r) for r in moved.collect()} == {(1, "a", 10, "own", False), (9, "a", 10, "own", False)}
    log = spark.createDataFrame([(1, "z", 9, "old", DAY(2024, 1, 1)), (3, "b", 11, "old", DAY(2024, 1, 1))], "offer_id long, gtin string, product long, own_hash string, night date")
    assert {tuple(r) for r in reattach.logged(log, moved, "2024-01-02").collect()} == {(1, "a", 10, "own", DAY(2024, 1, 2)), (9, "a", 10, "own", DAY(2024, 1, 2)), (3, "b", 11, "old", DAY(2024, 1, 1))}
    held = reattach.moves(offers, units, linked, refused, offers_most=1)
    assert {r.held for r in held.collect()} == {True}
    assert sorted(map(tuple, reattach.logged(log, held, "2024-01-02").collect())) == sorted(map(tuple, log.collect()))
    assert reattach.moves(offers.limit(0), units, linked, refused).count() == 0
