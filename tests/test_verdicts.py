"""Verdicts on groups of products, on literal groups and against a reading of each group's rows one by one."""

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from offerloom.operators.verdicts import group_verdicts

OFFERS = "grp int, product int, colour string, genre string, year int, size string, gtin string, ref string, price double"
A, B, FAR = "3435980372770", "3435980372787", "3435980399990"


def read(group):
    """The verdict and its reasons, from the rows of one group."""
    of = defaultdict(list)
    for row in group:
        of[row[0]].append(row[1:])
    first = {p: rows[0] for p, rows in of.items()}
    colours = sorted({c for c, *_ in first.values() if c not in (None, "", "unknown")})
    unknown = any(c in (None, "", "unknown") for c, *_ in first.values())
    sexes, ages = sorted({(g or "U-A").split("-")[0] for _, g, *_ in first.values()} - {"U"}), sorted({(g or "U-A").split("-")[-1] for _, g, *_ in first.values()})
    years = sorted({str(y) for _, _, y, *_ in first.values() if y})
    sizes = defaultdict(lambda: defaultdict(set))
    for p, rows in of.items():
        for *_, size, gtin, _, _ in rows:
            if size:
                sizes[size][p] |= {gtin} - {None}
    doubled = [s for s, x in sizes.items() if len(x) > 1]
    clashes = sorted(s for s in doubled if len(set().union(*sizes[s].values())) > 1)
    medians = [statistics.median(prices) for rows in of.values() if (prices := [r[-1] for r in rows if r[-1] is not None])]
    ratio = max(medians) / min(medians) if len(medians) > 1 and min(medians) > 0 else 1.0
    vetoes = [f"{n}: {' / '.join(v)}" for n, v in (("colours", colours), ("sexes", sexes), ("ages", ages), ("years", years)) if len(v) > 1]
    vetoes += [f"sizes with other barcodes: {' / '.join(clashes)}"] * bool(clashes) + [f"median prices {ratio:.1f} times apart"] * (ratio > 3)
    if vetoes:
        return "refused", vetoes
    codes = {p: {r[4] for r in rows} - {None} for p, rows in of.items()}
    refs = {p: {r[5] for r in rows} - {None} for p, rows in of.items()}
    code = any(codes[p] & codes[q] for p in of for q in of if p != q)
    ref = all(refs.values()) and bool(set.intersection(*refs.values()))
    complete = not doubled and all(any(r[3] for r in rows) for rows in of.values())
    close = lambda a, b: a[:9] == b[:9] and abs(int(a[:12]) - int(b[:12])) <= 20
    near = complete and all(any(close(a, b) for a in codes[p] for q in of if q != p for b in codes[q]) for p in of)
    one = len(colours) == 1 and not unknown
    signals = ["a barcode on two products"] * code + ["one reference"] * ref + ["sizes complete each other"] * complete + ["neighbouring barcodes"] * near
    signals += [f"colour: {colours[0]}"] if one else ["a colour unknown"] * unknown
    note = "safe" if one and ratio <= 1.5 and (code or ref) else "probable" if one and ratio <= 1.5 and near else "doubtful"
    return note, [*signals, f"median prices {ratio:.2f} times apart"]


LITERAL = {  # what is known of a group's offers, and its verdict
    "safe": [(1, "BK|MAT", "H-A", 2024, "M", A, "R1", 100.0), (2, "BK|MAT", "U-A", None, "L", B, "R1", 120.0)],
    "probable": [(1, "BK", "H-A", None, "M", A, None, 100.0), (2, "BK", "H-A", None, "L", B, None, 100.0)],
    "doubtful": [(1, "BK", "H-A", None, "M", A, None, 100.0), (2, "BK", "H-A", None, "L", FAR, None, 100.0)],
    "doubtful ": [(1, "BK", "H-A", None, "M", A, "R1", 100.0), (2, None, "H-A", None, "L", B, "R1", 100.0)],
    "doubtful  ": [(1, "BK", "H-A", None, "M", A, "R1", 100.0), (2, "BK", "H-A", None, "L", B, "R1", 160.0)],
    "refused": [(1, "BK|MAT", "H-A", 2024, "M", A, "R1", 100.0), (2, "BK|GLO", "F-E", 2023, "M", B, "R1", 400.0)],
    "refused ": [(1, "BK", "H-A", None, "M", A, "R1", 100.0), (2, "BK", "H-A", None, "M", B, "R1", 100.0)],
}


def test_literal_and_random_groups(spark):
    r = random.Random(11)
    groups = list(LITERAL.values())
    for _ in range(120):
        facts = {p: (r.choice([None, "", "BK", "BK", "BK", "unknown", "WH"][: r.choice([4, 5, 7])]), r.choice(["U-A", "H-A", "H-A", None, "F-A", "H-E"][: r.choice([4, 6])]), r.choice([None, 2024, 0])) for p in range(r.randint(1, 4))}
        codes = [str(343598037270 + r.randint(0, 60)) + "0" for _ in range(4)] + [None]
        groups.append([(p, *facts[p], r.choice([None, "S", "M", "L", "XL"]), r.choice(codes), r.choice([None, "R1", "R1", "R2"]), r.choice([None, *map(float, range(90, 130)), 350.0])) for p in facts for _ in range(r.randint(1, 4))])
    rows = [(g, *row) for g, group in enumerate(groups) for row in group] + [(None, *LITERAL["safe"][0])]
    df = spark.createDataFrame(rows, OFFERS).withColumn("products", F.lit("clash")).withColumn("near", F.lit(1))
    got = {x.grp: (x.verdict, x.reasons) for x in group_verdicts(df).collect()}
    assert got == {g: read(group) for g, group in enumerate(groups)}
    assert [got[k][0] for k in range(len(LITERAL))] == [name.strip() for name in LITERAL]
    assert {v for v, _ in got.values()} == {"safe", "probable", "doubtful", "refused"}
    assert group_verdicts(df.limit(0)).count() == 0
