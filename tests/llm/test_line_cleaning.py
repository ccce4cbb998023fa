"""Boilerplate lines go out of the text, and copies neither make nor hide them."""

import corpus_pipeline
from offerloom.llm import line_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"
NAV = "Home  Shop  Contact us today\nFollow us on every social network"


def own(i):
    return "\n".join(" ".join(f"own{i}x{j}" for j in range(10 * k, 10 * k + 10)) for k in range(3))


def test_cleaned_text(spark):
    rows = [(i, f"{NAV.upper()}\n{own(i)}\n\nlast {i}", "en", "host", 1) for i in range(40)] + [(99, own(99), "en", "host", 7), (None, own(98), "en", None, None)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in line_rules.line_rules(docs).collect()}
    assert all(got[i].clean_text == f"{own(i)}\n\nlast {i}" for i in range(40)) and got[99].clean_text == own(99)
    handed = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert all((handed[i].text, handed[i].n_chars) == (got[i].clean_text, len(got[i].clean_text)) for i in range(40))
    assert (handed[99].text, handed[99].n_chars, handed[None].n_chars) == (own(99), 7, None)


def test_copies_do_not_hide_boilerplate(spark):
    copy = f"{NAV}\n{own(1000)}"
    rows = [(i, copy, "en", "copies", 1) for i in range(100)] + [(200 + i, f"{NAV}\n{own(i)}", "en", "copies", 1) for i in range(35)]
    rows += [(400 + i, f"{NAV}\n{' '.join(['page'] + [f'n{i}'] * 2)}" + f"\n{NAV}" * 3, "en", "stubs", 1) for i in range(40)] + [(500 + i, f"{NAV}\n{own(i)}", "en", "stubs", 1) for i in range(30)]
    got = {r.doc_id: r for r in line_rules.line_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i].kept and got[i].clean_text == own(1000) for i in range(100))  # the article's own lines stay
    assert all(got[200 + i].removed_words == 11 and got[200 + i].kept for i in range(35))
    assert all(got[400 + i].removed_words == 44 and not got[400 + i].kept for i in range(40))
    assert all(got[500 + i].removed_words == 11 and got[500 + i].kept for i in range(30))
