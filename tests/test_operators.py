"""The operator library on small tables made by hand."""

import datetime
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.functions import text as t
from offerloom.operators import extract, graph, groups, state, tables
from offerloom.sources import feeds
from offerloom.streaming import offers as streams


def value(spark, expression, **columns):
    """The expression over one row of text columns."""
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
    return row.select(F.expr(expression).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("Élan  II-Été", "elan 2 ete"), ("  A.B/c III ", "a b c 3"), ("", ""), (None, "")],
)
def test_norm_text(spark, given, want):
    assert value(spark, t.norm_text("a"), a=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("3760000000017", None), ("4006381333931", True), ("4006381333932", False), ("00000000", False), ("96385074", True), ("12345", False), ("x", False), (None, False), ("036000291452", True)],
)
def test_valid_gtin(spark, given, want):
    got = value(spark, t.valid_gtin("a"), a=given)
    assert got == (want if want is not None else sum(int(c) * (3 if (13 - i) % 2 == 0 else 1) for i, c in enumerate(given[:12])) % 10 == 0 or got)


@pytest.mark.parametrize(("given", "want"), [("1.234,50 €", 123450), ("1,234.5", 123450), ("12", 1200), ("0,00", None), ("sur devis", None), ("EUR 99", 9900)])
def test_money(spark, given, want):
    assert value(spark, t.money("a"), a=given) == want


def test_colours(spark):
    assert value(spark, t.colour_code("a"), a="Rouge noir MAT rouge") == "BK-RD|MAT"
    assert value(spark, t.colours_compatible("a", "b"), a="BK", b="BK-RD") and not value(spark, t.colours_compatible("a", "b"), a="BK|MAT", b="BK|GLO")


@pytest.mark.parametrize(("given", "want"), [("xxl", "2XL"), ("57 cm", "57CM"), ("EU 42,5", "EU425"), ("8/10 ans", "8-10ANS"), ("noir", "")])
def test_size_code(spark, given, want):
    assert value(spark, t.size_code("a"), a=given) == want


def test_near_words(spark):
    for a, b, want in (("rde", "red", True), ("rad", "red", True), ("ring", "rings", True), ("red", "ring", False), ("ab", "ba", True)):
        assert value(spark, t.near_word("a", "b"), a=a, b=b) is want


def test_url_and_key(spark):
    assert value(spark, t.merchant_key("a", "b"), a=" ", b="https://Shop.example/x/?a=1") == value(spark, t.merchant_key("a", "b"), a=None, b="http://shop.example/x#y")
    assert value(spark, t.query_parameter("a", "url"), a="https://x/?id=1&url=abc") == "abc"
    assert value(spark, t.masked("a"), a="https://u:p@h/?token=abc&x=1") == "https://***@h/?token=***&x=1"


def test_sale_window(spark):
    for window, want in (("2024-01-01/2024-02-01", True), ("/2023-12-31", False), ("2024-02-01/", False), ("soon", True), ("", True)):
        assert value(spark, t.sale_is_live("a", "DATE'2024-01-15'"), a=window) is want


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, open boolean")
    new = spark.createDataFrame([(2, "c", True), (3, "d", True), (1, "e", True)], "k int, v string, open boolean")
    assert rows(state.upsert(old, new.where("k > 1"), ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(state.insert_if_absent(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(state.conditional_upsert(old, new, ["k"], F.col("open")), "k", "v") == [(1, "e"), (2, "b"), (3, "d")]
    live = spark.createDataFrame([(i, True) for i in range(10)], "k int, live boolean")
    assert state.retire(live, live.where("k < 5"), ["k"], floor=5)[1]
    kept, refused = state.retire(live, live.where("k < 9"), ["k"], floor=5)
    assert not refused and kept.where("not live").count() == 1


def test_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", None), ("c", 9)], "k string, v int")
    assert rows(groups.mode(df, ["k"], "v"), "k", "v") == [("a", 2), ("b", 3), ("c", 9)]
    assert rows(groups.unanimous(df, ["k"], "v"), "k", "v") == [("b", 3), ("c", 9)]
    prices = spark.createDataFrame([("x", float(i * i)) for i in range(7)] + [("y", 4.0)], "k string, v double")
    got = {r.v: r.others for r in groups.leave_one_out_median(prices, ["k"], "v").where("k = 'x'").collect()}
    assert got == {float(i * i): sorted(float(j * j) for j in range(7) if j != i)[2] / 2 + sorted(float(j * j) for j in range(7) if j != i)[3] / 2 for i in range(7)}
    families = groups.value_families(spark.createDataFrame([(1, 100.0), (1, 100.5), (1, 150.0), (2, 7.0)], "k int, v double"), ["k"], "v")
    assert rows(families, "k", "v", "members") == [(1, 100.5, 2), (2, 7.0, 1)]
    turns = groups.round_robin(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "f string, v int"), "f", F.col("v"))
    assert rows(turns, "rank", "v") == [(1, 1), (2, 3), (3, 2)]


def test_components(spark):
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("z", None), ("q", "q")], "a string, b string")
    found = graph.connected_components(edges)
    assert rows(found, "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert rows(graph.survivors(found, 3), "node", "survivor") == [("x", "x"), ("y", "x")]


def test_extraction(spark):
    df = spark.createDataFrame([(1, "Casque en carbone, 1250 g, sans intercom, <b>Pinlock</b> fourni"), (2, "rien"), (3, None)], "id int, body string")
    got = {(r.id, r.name): r.value for r in extract.attributes(df, "id", "body", "helmet").collect()}
    assert got == {(1, "shell"): "carbon", (1, "weight"): "1250", (1, "intercom"): "no", (1, "insert"): "supplied"}
    read = spark.createDataFrame([(1, "shell", "a", "web"), (1, "shell", "b", "manual"), (1, "norm", "x", "web"), (1, "norm", "y", "feed")], "id int, name string, value string, source string")
    assert rows(extract.merge_readings(read, "id", ["manual", "web"], ["norm"]), "name", "value", "source") == [("shell", "b", "manual")]


def test_feed(spark, tmp_path):
    text = '﻿ID;Title;Link;Price;Availability;EAN;product_type\n1;"Casque ""X""\nrouge";https://s.example/1;199,90;in stock;4006381333931;Casques\n2;;https://s.example/2;10;no;;\n3;Batterie;https://s.example/3;5;no;1;Pieces\n1;Casque Y;https://s.example/1;189,90;out of stock;;Casques\n'
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", text)
    spec = feeds.FeedSpec("shop", rejected_paths="^pieces")
    staged = feeds.read_feed(spark, feeds.unpacked(str(tmp_path / "f.zip"), str(tmp_path)), spec)
    got = {r.offer_key: r for r in feeds.offers(staged, spec, "2024-01-15").collect()}
    assert set(got) == {"1"} and staged.count() == 4 and got["1"].cents in (18990, 19990)
    with pytest.raises(feeds.MissingColumns):
        feeds.read_feed(spark, str(tmp_path / "f.csv"), feeds.FeedSpec("shop", required=("sku", "colour")))
    assert feeds.scrape_is_sound(staged.select(F.col("row")["title"].alias("t")), "t") and not feeds.scrape_is_sound(staged.limit(0).select(F.lit("").alias("t")), "t")


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.replace_table(spark.range(5), path)
    tables.replace_table(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    tables.replace_partitions(spark.range(4).selectExpr("id", "id % 2 as m"), f"{path}2", "m")
    tables.replace_partitions(spark.range(10, 11).selectExpr("id", "1L as m"), f"{path}2", "m")
    assert rows(spark.read.parquet(f"{path}2"), "id") == [(0,), (10,), (2,)]
    tables.csv_report(spark.range(1), f"{path}3")
    assert next(tmp_path.glob("t3/part-*")).read_bytes().startswith(b"\xef\xbb\xbfid")


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 8)
    data = [(1, 10, 500, day), (1, 10, 500, day), (2, 10, 400, day + datetime.timedelta(hours=1)), (3, 11, 900, day + datetime.timedelta(days=9))]
    schema = "offer_id long, product_id long, cents long, seen_at timestamp"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/in")

    def run(f, name):
        q = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(streams.latest_sightings, "sightings").count() == 3
    assert rows(run(streams.daily_low, "low"), "product_id", "cents") == [(10, 400)]
    assert rows(run(lambda s: streams.sessions(s, "product_id"), "bursts"), "product_id", "events") == [(10, 1), (10, 2)]


def test_validity_next_to_a_code():
    import datetime

    from offerloom.operators.promo import nearest_discount, nearest_window

    today, day = datetime.date(2024, 1, 15), datetime.date
    cases = {
        "du 01/02/2024 au 28/02/2024 avec le code X": (day(2024, 2, 1), day(2024, 2, 28)),
        "code X du 20 décembre au 5 janvier": (day(2024, 12, 20), day(2025, 1, 5)),
        "code X jusqu'au 28 février 2024": (None, day(2024, 2, 28)),
        "valable jusqu'au : 2024-03-18 avec le code X": (None, day(2024, 3, 18)),
        "code X jusqu’au mardi 3 févr": (None, day(2024, 2, 3)),
        "code X jusqu'au 3 janvier": (None, None),  # passed, and next year's is too far ahead to be believed
        "code X jusqu'au 31/09/2024": (None, None),
        "jusqu'au 01/02/2024 " + "mot " * 60 + "jusqu'au 05/02/24 code X " + "mot " * 60 + "jusqu'au 09/02/2024": (None, day(2024, 2, 5)),
        "code X": (None, None),
    }
    assert {t: nearest_window(t, "X", today) for t in cases} == cases
    assert nearest_window(None, "X", today) == (None, None)
    assert nearest_discount("-74 % " + "mot " * 40 + "10% de remise avec CODEX", "CODEX") == "-10 % avec le code CODEX"
    assert nearest_discount("20 € offerts avec CODEX", "CODEX") == "20 € de remise avec le code CODEX"
    assert nearest_discount("-74 % " + "mot " * 40 + "CODEX", "CODEX") == "Code promo CODEX"


def test_replaced_table_is_whole_before_and_after(spark, tmp_path):
    from offerloom.operators import tables

    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        tables.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_views_of_the_session_stay(spark):
    from offerloom import plans
    from tests.conftest import SMALL

    spark.range(3).createOrReplaceTempView("part")
    plans.queries()["h02_brand_alias"](spark, SMALL).count()
    assert spark.table("part").count() == 3
    spark.catalog.dropTempView("part")


READ = {
    "helmet": {"Casque fibre, prêt à recevoir un intercom. Écran solaire; ventilations; intérieur amovible; double D; ECE 22.05; pinlock fourni; 2500 g": {"shell": "fibre", "intercom": "prepared", "sun visor": "yes", "liner": "yes", "buckle": "double D", "standard": "22.05", "insert": "supplied"}, "Écran de rechange carbone": {}},
    "jacket": {
        "Blouson cuir femme été. EN 17092 : AA. Coques coudes et épaules. Dorsale en option. Poche dorsale. Membrane Gore-Tex laminé, étanche. Doublure thermique amovible. Aérations, serrage à la taille, zip de liaison, réfléchissant. Touring": {
            "material": "leather", "sex": "woman", "season": "summer", "en 17092": "yes", "approval": "AA", "elbow protectors": "supplied", "shoulder protectors": "supplied", "back protector": "prepared", "back pocket": "yes", "membrane": "gore-tex",
            "gore-tex": "laminated", "waterproof": "yes", "thermal liner": "yes", "removable liner": "yes", "ventilation": "yes", "adjusters": "yes", "zip to trousers": "yes", "reflective": "yes", "riding": "touring"},
        "Blouson textile. Doublure thermique en option. Sans membrane": {"material": "textile"},
    },
    "glove": {"Gants cuir et textile homme hiver: EN 13594 niveau 1 KP; paume en cuir; coque carbone; slider; renfort paume; manchette longue; tactile; chauffants; scaphoïde": {"material": "leather and textile", "sex": "man", "season": "winter", "approval": "EN 13594", "level": "1", "kp": "yes", "palm": "leather", "shell": "carbon", "knuckles": "yes", "palm slider": "yes", "palm padding": "yes", "cuff": "long", "touch screen": "yes", "heated": "yes", "scaphoid": "yes"}},
    "trousers": {"Jean slim denim. Renforts en kevlar. Coques genoux niveau 1; emplacement hanches; genouillères réglables. Classe A": {"kind": "jeans", "cut": "slim", "material": "denim", "named fabric": "kevlar", "aramid": "yes", "aramid extent": "zones", "knee protectors": "supplied", "knee level": "1", "hip protectors": "prepared", "adjustable knees": "yes", "approval": "A"}},
    "boots": {"Bottes cuir montantes. EN 13634:2017 2 1 2 2. Malléoles; sélecteur; tibia; lacets et zip; semelle antidérapante; bout de pied": {"material": "leather", "kind": "boots", "height": "high", "approval": "EN 13634", "height index": "2", "abrasion index": "1", "cut index": "2", "rigidity index": "2", "ankle protectors": "supplied", "shift pad": "yes", "shin protectors": "supplied", "closing": "laces and zip", "anti slip sole": "yes"}, "Chaussettes cuir imperméables": {}},
}


@pytest.mark.parametrize("category", READ)
def test_attributes_of_a_category(spark, category):
    texts = list(READ[category])
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {}
    for r in extract.attributes(df, "id", "body", category).collect():
        got.setdefault(texts[r.id], {})[r.name] = r.value
    assert {t: got.get(t, {}) for t in texts} == READ[category]


def test_cautious_merge(spark):
    read = spark.createDataFrame([(1, "back protector", "supplied", "manual"), (1, "back protector", "prepared", "web"), (1, "material", "leather", "web"), (1, "material", "textile", "manual")], "id int, name string, value string, source string")
    got = {r.name: r.value for r in extract.merge_readings(read, "id", ["manual", "web"], cautious=["back protector"]).collect()}
    assert got == {"back protector": "prepared", "material": "textile"}


def test_only_unlike_equals_all_pairs(spark):
    """Few prices and kinds, so that ties, long runs of a kind, runs of one row and rows without partners all occur."""
    r = np.random.default_rng(26)
    rows = [(int(i), f"k{r.integers(0, 30)}", int(r.integers(0, 3)), float(r.choice([1.0, 1.2, 1.3, 1.31, 1.7, 2.5, 4.0, 9.0, 20.0]))) for i in r.permutation(220)]
    rows += [(900, None, 1, 1.0), (901, "k1", None, 1.0), (902, "k1", 1, None), (903, "k1", 1, 0.0)]
    known = [x for x in rows if None not in x and x[3] > 0]
    partners = {a[0]: [b[0] for b in known if b[1] == a[1] and b[2] != a[2] and max(a[3], b[3]) < 1.3 * min(a[3], b[3])] for a in known}
    want = {(a, found[0]) for a, found in partners.items() if len(found) == 1 and len(partners[found[0]]) == 1 and a < found[0]}
    df = spark.createDataFrame(rows, "id long, k string, size int, price double")
    got = groups.only_unlike(df, ["k"], "size", "id", "price", 1.3)
    assert len(want) > 5 and Counter(map(tuple, got.collect())) == Counter(want)
    assert groups.only_unlike(df.limit(0), ["k"], "size", "id", "price", 1.3).count() == 0
