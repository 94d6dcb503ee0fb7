import random

from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.llm.spellings import Nicknames, close, entities, number, parse_author, parse_title, segment_join, spelling_entities, variant_pairs
from pyspark.sql import functions as F

SHORT = [("Katherine", "Kate"), ("William", "Bill"), ("Christopher", "Kit")]


def groups(spark, values, field):
    df = spark.createDataFrame([(v,) for v in values], "value string").where("value is not null").distinct()
    short = spark.createDataFrame(SHORT, "given_name string, short_name string")
    out = {}
    for r in entities(df, short, field).collect():
        out.setdefault(r["entity"], set()).add(r["value"])
    return sorted(map(sorted, out.values()))


def test_people_and_bodies(spark):
    same = [
        ["Katherine Brelefizaki", "Brelefizaki, Kate", "BRELEFIZAKI, Katherine", "katherine  brelefizaki ", "Prof. Dr. Katherine R. Brelefizaki", "Katherine Brelefzaki (ed.)", "K. Brelefizaki", "Brelefizaki, K. R.", "Katherine Brelefiazki", "Hatherine Brelefizaki"],
        ["William Griragukh", "Bill Griragukh", "Willima Griragukh", "W. Griragukh"],
        ["Valentina Griragukh", "Griragukh, Valentina A."],
        ["Academy of Moral Weather, Vuzocuminster", "Acad. of Moral Weather, Vuzocuminster", "The Academy of Moral Weather at Vuzocuminster", "Moral Weather, Academy of, Vuzocuminster", "Academy of Moral Weather (Vuzocumisnter)"],
        ["Academy of Moral Weather, Hefebostadt"],
        ["Institute of Moral Weather, Vuzocuminster"],
        ["Dorothea Bivugrizaki"], ["Frederick Bivugrizaki"], ["D. F. Someoneelse"],
    ]
    values = [v for g in same for v in g] + ["", " ", "n/a", "Unknown", "anon.", None]
    assert groups(spark, values, "author") == sorted(map(sorted, same))


def test_misspelt_body_of_a_hot_place(spark):
    topics = [a + b for a in ("bral", "fost", "grem", "kliv", "morn") for b in ("adix", "ebur", "ithon", "oquel", "uzzen")]
    values = [f"Society of {t.title()}, {u.title()}" for i, t in enumerate(topics) for u in topics[:i]]  # 300 forms
    values += [f"Society of {t.title()}, Nonemohaven" for t in topics] + [f"Society of Clouds, {t.title()}" for t in topics]
    values += ["Society of Clouds, Nonemohaven", "Soceity of Clouds, Nonemohaven"]
    got = groups(spark, values, "author")
    assert ["Soceity of Clouds, Nonemohaven", "Society of Clouds, Nonemohaven"] in got
    assert len(got) == len(values) - 1


def test_short_and_given_surnames(spark):
    same = [["Dorothea Lee", "Lee, Dorothea", "D. Lee", "Dorothea R. Lee"], ["Valentina Alexander", "Alexander, V."], ["Alexander Vuzocumin", "A. Vuzocumin"], ["Alexander Hefebost"], ["Frederick Lee"], ["Valentina Katherine", "Katherine, Valentina"], ["Katherine Grubost"]]
    filler = [f"Alexander {w}" for w in ("Quilbradeth", "Nostiverung", "Plemokarst")]
    got = groups(spark, [v for g in same for v in g] + filler, "author")
    assert sorted(map(sorted, same)) == [g for g in got if not set(g) & set(filler)]


def test_two_edits_or_swaps_from_five_letters_on(spark):
    keys = ["society", "soicety", "harlow", "ahrlwo", "qbrlow", "stonewall", "tsonewlal"]
    df = spark.createDataFrame([(k, k, "s") for k in keys], "form string, key string, also string")
    got = {tuple(x) for x in segment_join(df).collect()}
    assert {(a, b) for a in keys for b in keys if a < b and close(a, b, 2) <= 2} <= got


def test_initials_that_fit_two_people_join_neither(spark):
    got = groups(spark, ["William Kazakh", "Wilhelmina Kazakh", "W. Kazakh"], "author")
    assert ["W. Kazakh"] in got


def test_titles(spark):
    same = [
        ["The Silent Witness & the Emblem", "the silent witness and the emblem", "The_Silent_Witness_and_the_Emblem: Essays on Debt", "Silent Witness and the Emblem, The (2nd ed.)", "The Silent Witnes and the Emblem -- copy", "  The Silent Witness and The Emblem [scan]"],
        ["The Murmur of Solemn Village, Volume I", "Murmur of Solemn Village, The, Vol. 1", "The Murmur of Solemn Village (vol. I)"],
        ["The Murmur of Solemn Village, Volume II"],
        ["The Murmur of Solemn Village, Vol. XIII", "The Murmur of Solemn Village, Volume 13"],
        ["The Murmur of Solemn Village, Vol. XIV"], ["The Murmur of Solemn Village, Vol. XL"], ["The Murmur of Solemn Village"],
        ["On Durable Matter and Habit"], ["On Durable Letter and Habit"],
    ]
    filler = [f"On {a} {b} and Proof" for a in ("Quiet", "Late", "Bitter") for b in ("Matter", "Letter")]
    got = groups(spark, [v for g in same for v in g] + filler, "title")
    assert sorted(map(sorted, same)) == [g for g in got if not set(g) & set(filler)]


def test_pairs_shape_and_empty_table(spark):
    df = spark.createDataFrame([("A. Brelefizaki", 1), ("a. brelefizaki", 2), ("A. Brelefizaki", 3), (None, 4)], "author string, value string")
    assert [tuple(r) for r in variant_pairs(df, "author").collect()] == [("author", "A. Brelefizaki", "a. brelefizaki")]
    assert variant_pairs(df.limit(0), "author").count() == 0
    named = spelling_entities(df, "author").collect()
    assert {r["value"] for r in named} == {"A. Brelefizaki", "a. brelefizaki"} and len({r["entity"] for r in named}) == 1


def test_roman_numerals():
    assert [number(x) for x in ("i", "IV", "xiv", "XL", "MCMXC", "12", "q", "")] == [1, 4, 14, 40, 1990, 12, 0, 0]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_segment_join_loses_nothing(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcd") for _ in range(r.randrange(5, 14))) for _ in range(120)]
    keys = set(base)
    for b in base:
        w = list(b)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], ["x"], [w[i], "y"]])
        keys.add("".join(w))
    keys = sorted(k for k in keys if k)
    df = spark.createDataFrame([(k, k, "s") for k in keys], "form string, key string, also string")
    got = {(x[0], x[1]) for x in segment_join(df).collect()}
    budget = lambda n: 3 if n >= 8 else 1 if n >= 5 else 0
    want = {(a, b) for a in keys for b in keys if a < b and levenshtein(a, b) <= budget(min(len(a), len(b)))}
    assert want <= got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_banded_distance(a, b):
    n = close(a, b, 3)
    assert n == close(b, a, 3) and n <= max(levenshtein(a, b), 0) and (n > 0 or a == b) or n == 4


def test_parsing():
    assert parse_author("Hikirurthy, Kit")[:2] == ("person", ["kit", "hikirurthy"])
    assert parse_author("various")[0] == parse_author("?")[0] == parse_author("N/A")[0] == "none"
    assert parse_title("X of the Y: Lectures, 1930, Volume III")[4] == 3
    assert Nicknames(SHORT).same("kate", "katherine", {}) == 0 and Nicknames(SHORT).same("kate", "william", {}) == 9


def test_hot_string_costs_nothing(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "Dorothea Mohagilmor").otherwise(F.concat(F.lit("Person Number"), F.col("id").cast("string"))).alias("author")).where("author like 'Doro%'")
    assert variant_pairs(df, "author").count() == 0
