"""Text statistics against plain Python, and tails on clear texts."""

import random

import pytest

from weftgraph.llm import quality

PROSE = "The court has considered the letter and finds that it was not sent in time. It follows that the appeal must fail, and that each side should bear its own costs. "
LIST = "\n".join(f"{k}. Exhibit {k * 7}" for k in range(1, 40))
TABLE = "\n".join(f"{k * 13}\t{k * 7.5:.2f}\t--\tn/a" for k in range(1, 40))
NAMES = " | ".join(f"Mar{k}ter, {chr(65 + k % 26)}." for k in range(60))


def prose(seed):
    """Sentences of varying words and lengths, as a court would write them."""
    rng = random.Random(seed)
    nouns, verbs = "letter claim appeal order contract payment notice party witness hearing report lease".split(), "considered refused accepted dismissed granted reviewed received".split()
    one = lambda: f"The {rng.choice(['court', 'judge', 'clerk', 'tribunal'])} {rng.choice(verbs)} the {rng.choice(nouns)} {rng.choice(['of the', 'for a', 'in this', 'with the'])} {rng.choice(nouns)}{rng.choice([', and found that it was late', ' because of its length', '', ', which was not in time'])}."
    return "\n".join(" ".join(one() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 12)))


def satz(seed):
    rng = random.Random(seed)
    worte = "Brief Antrag Bescheid Vertrag Zeuge Termin Bericht Beschluss".split()
    one = lambda: f"Das Gericht hat den {rng.choice(worte)} {rng.choice(['geprüft', 'verworfen', 'erhalten'])} und {rng.choice(['stellt fest', 'ist der Ansicht', 'meint'])}, dass {rng.choice(['er', 'der ' + rng.choice(worte)])} nicht {rng.choice(['zur Zeit kam', 'in der Sache hilft', 'mit dem Recht im Einklang ist'])}."
    return "\n".join(" ".join(one() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 12)))


def one(text):
    return dict(zip(quality._NAMES[1:], quality.statistics_of(text, quality._Words())))


def test_statistics():
    s = one("The cat sat.\nOn a mat\n12 -- x!")
    assert s["n_words"] == 9 and s["mean_word_length"] == pytest.approx(sum(map(len, "The cat sat. On a mat 12 -- x!".split())) / 9)
    assert s["punct_line_share"] == pytest.approx(2 / 3) and s["common_share"] == pytest.approx(3 / 9)
    assert s["symbol_ratio"] == pytest.approx(4 / sum(map(len, "The cat sat. On a mat 12 -- x!".split())))
    assert quality.statistics_of(" \n\t", quality._Words()) is None
    assert one(PROSE * 3)["lang_found"] == "en" and one("12 34 56")["lang_found"] == ""


def test_not_prose(spark):
    rows = [(k, prose(k), "x") for k in range(200)]
    bad = {1000: LIST, 1001: TABLE, 1002: NAMES, 1003: "qx7" * 400, 1004: "the of and to " * 50, 1005: "same line\n" * 60}
    fine = {2000: "\n".join([*map(prose, range(20)), TABLE[:60]]), 2001: None, 2002: "", 2003: "  \n "}
    df = spark.createDataFrame(rows + [(i, t, "x") for i, t in (bad | fine).items()] + [(1000, LIST, "x")], "doc_id long, text string, n_words string")
    assert sorted(r.doc_id for r in quality.not_prose(df).collect()) == sorted([*bad, 1000])
    stats = quality.text_statistics(df)
    assert stats.count() == df.count() and stats.where("n_words = 0 and common_share is null").count() == 3
    assert quality.not_prose(df.limit(0)).count() == 0


FORM = "\n".join(f"{k}. Name: ____ [ ] the {k * 31}-{k}" for k in range(1, 30))
SOUP = "the of and to in that " * 30
VORDRUCK = "\n".join(f"{k}. Name der Partei: ____ [ ] {k * 31}-{k}" for k in range(1, 30))


@pytest.mark.parametrize("copied", [FORM, LIST, TABLE, NAMES, SOUP, VORDRUCK])
def test_third_of_rows_is_one_junk_text(spark, copied):
    rows = [(k, prose(k)) for k in range(180)] + [(k, satz(k)) for k in range(180, 240)]
    bad = {1000 + k: copied for k in range(140)} | {2000: FORM, 2001: LIST, 2002: TABLE, 2003: NAMES, 2004: "qx7" * 400, 2005: SOUP, 2006: "same line\n" * 60}
    df = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.not_prose(df).collect()) == sorted(bad)


def test_percentiles(spark):
    df = spark.createDataFrame([(k, PROSE + "- " * k) for k in range(100)], "doc_id long, text string")
    stats = quality.text_statistics(df)
    got = {r.doc_id: r for r in quality.scored(stats, quality.sketches(stats)).collect()}
    for s in ("symbol_ratio", "log_n_words"):
        assert got[0][f"{s}_pct"] <= 0.05 and got[99][f"{s}_pct"] >= 0.97 and got[50][f"{s}_pct"] == pytest.approx(0.5, abs=0.06)
    assert all(f"{s}_z" in r for r in got.values() for s in quality.STATISTICS)
