import random

from colophon.llm.leaks import cut_leaks, find_leaks, remove_leaks

WORDS = "river stone lantern harbour window gravity ledger promise mirror season village thread copper meadow signal anchor velvet canyon ember willow saddle pepper marble hollow cinder basket turnip walnut".split()


def passage(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


ITEMS = "item_id bigint, ground_truth string, query string"
DOCS = "doc_id bigint, text string, item_id bigint, share double"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 5, 0.5) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "q") for i, t in items], ITEMS)
    return sorted((r["doc_id"], r["item_id"]) for r in find_leaks(d, q, **kw).collect())


def changed(text, share, seed=0):
    r = random.Random(seed)
    return " ".join("other" + str(r.randrange(999)) if r.random() < share else w for w in text.split())


def test_whole_changed_cut_and_broken(spark):
    p = [passage(i) for i in range(12)]
    items = [(i, t) for i, t in enumerate(p)] + [(100, p[0])]
    frame = " and the of one with lies between ".join
    docs = [
        (1, "Before. " + p[0].upper() + " After."),
        (2, changed(p[1], 0.2)),
        (3, " ".join(p[2].split()[:28])),  # seven tenths
        (4, " ".join(p[3].split()[:16])),  # four tenths
        (5, p[4].replace("a", "a-\na", 3)),
        (6, frame(["x", "y", "z"] * 5)),
        (7, " filler ".join(p[5].split()[::3])),  # scattered words, not running text
        (8, p[6] + "\n\n" + p[7]),
        (13, p[9].replace("e", "е").replace("o", "о\u200b")),  # look-alikes and invisible characters
        (9, None), (10, ""), (11, "short"), (12, "filler words " * 20000 + p[8]),
    ]
    got = leaks(spark, docs, items)
    assert got == [(1, 0), (1, 100), (2, 1), (3, 2), (5, 4), (8, 6), (8, 7), (12, 8), (13, 9)]
    assert leaks(spark, docs, items, max_grams=100) == got  # in slices, with the same result


def test_every_place_of_a_document_is_tried(spark):
    p = passage(1, 80)
    part = " ".join(p.split()[:45])  # 0.56 of it intact: many hits, no leak
    whole = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(p.split()))
    gap = " filler" * 200 + " "
    docs = [(1, part), (2, part + gap + whole), (3, whole + gap + part), (4, gap.join([part] * 6 + [whole] + [part] * 6)), (5, gap.join([part] * 6))]
    assert leaks(spark, docs, [(7, p)]) == [(2, 7), (3, 7), (4, 7)]


def test_shared_frames_are_no_leak(spark):
    frame = "there is no {} that does not {} renew its {} because the reader who {} the {} also {} its {} in the third chapter"
    fill = lambda seed: frame.format(*[w + str(seed) for w in random.Random(seed).sample(WORDS, 7)])
    items = [(i, fill(i)) for i in range(20)]
    docs = [(i, fill(1000 + i)) for i in range(50)]
    assert leaks(spark, docs, items) == []
    assert leaks(spark, [(1, fill(3))], items) == [(1, 3)]


def test_empty_and_null(spark):
    assert leaks(spark, [], [(1, passage(1))]) == []
    assert leaks(spark, [(1, passage(1))], []) == []
    assert leaks(spark, [(1, passage(1))], [(1, None), (2, ""), (3, "two words")]) == []


def test_removal(spark):
    docs = spark.createDataFrame([(1, passage(1)), (2, "clean text")], "doc_id bigint, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, passage(1))], "item_id bigint, ground_truth string"))
    assert [r["doc_id"] for r in remove_leaks(docs, found).collect()] == [2]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "nothing here"), ("b", passage(1))], "doc_id string, text string").repartition(2)
    items = spark.createDataFrame([("x", passage(1))], "item_id string, ground_truth string")
    assert [tuple(r)[:2] for r in find_leaks(docs, items).collect()] == [("b", "x")]


def test_every_third_word_replaced(spark):
    p = passage(1, 60)
    third = " ".join("other" if i % 3 == 2 else w for i, w in enumerate(p.split()))  # no three words in a row are intact
    fifth = " ".join("other" if i % 5 in (2, 4) else w for i, w in enumerate(p.split()))  # six tenths, scattered
    half = " ".join("other" if i % 2 else w for i, w in enumerate(p.split()))
    assert leaks(spark, [(1, third), (2, fifth), (3, half)], [(7, p)]) == [(1, 7), (2, 7)]


def test_partial_decoys_do_not_hide_a_copy(spark):
    p = passage(2, 80).split()
    decoy = " ".join(p[:40]) + " filler" * 100 + " "
    real = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(p))
    assert leaks(spark, [(1, decoy * 5 + real), (2, decoy * 5)], [(7, " ".join(p))]) == [(1, 7)]


def test_places_and_cuts(spark):
    p, q = passage(3), passage(4)
    broken = q.replace("e", "\u0435", 3).replace("a", "a-\na", 1)
    text = "Before it. " + p + " Between \u200bthem. " + broken + " After. " + p + " End."
    docs = spark.createDataFrame([(1, text, 9), (2, "clean text", 9), (3, None, 9), (1, text, 9)], "doc_id bigint, text string, cut_chars int")
    items = spark.createDataFrame([(7, p), (8, q)], "item_id bigint, ground_truth string")
    rows = find_leaks(docs.limit(1), items, every=True).collect()
    assert sorted((r["item_id"], text[r["first_char"] : r["last_char"]]) for r in rows) == [(7, p), (7, p), (8, broken)]
    cut = sorted((r["doc_id"], r["text"] or "", r["cut_chars"]) for r in cut_leaks(docs, items).collect())
    rest = "Before it.   Between \u200bthem.   After.   End."
    assert cut == [(1, rest, len(p) * 2 + len(broken))] * 2 + [(2, "clean text", 0), (3, "", 0)]
    assert cut_leaks(docs, items, max_grams=30).collect()[0]["text"] == rest  # in slices
    assert cut_leaks(docs.limit(0), items).count() == 0
